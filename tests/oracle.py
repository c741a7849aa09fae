"""Run a registered query and its SQL twin and compare them row by row."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int):
        return float(value)
    return value


def _sort_key(row):
    return tuple((v is None, str(round(v, 6) if isinstance(v, float) else v)) for v in row)


def rows(columns, raw):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(_plain(r[i]) for i in order) for r in raw]
    return [columns[i] for i in order], sorted(made, key=_sort_key)


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


def compare(df, con, sql: str) -> tuple[str, int]:
    """('ok' or the first difference, number of rows)."""
    spark_cols, spark_rows = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    duck_cols, duck_rows = rows([d[0] for d in cur.description], cur.fetchall())
    if spark_cols != duck_cols:
        return f"columns {spark_cols} vs {duck_cols}", len(spark_rows)
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} vs {len(duck_rows)}", len(spark_rows)
    exact = True
    for x, y in zip(spark_rows, duck_rows):
        if not all(same(a, b) for a, b in zip(x, y)):
            return f"{spark_cols}: {x} vs {y}", len(spark_rows)
        exact = exact and x == y
    return ("ok" if exact else "ok (last bits differ)"), len(spark_rows)
