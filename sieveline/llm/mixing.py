"""Mixing to target weights: raking of token weights to marginals, then calibrated sampling."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import bare_words, fresh, stage, unit_hash

MAX_SWEEPS = 30
TOLERANCE = 1e-12
#: A marginal with more values than this belongs in coarser groups first.
MAX_VALUES = 100_000

# --- fixed values: topics by the marks they leave in a text, first match wins --
TOPIC_MARKS = (
    ("legal", ("Licensed under", "General Public License", "All rights reserved")),
    ("tabular", (" | ",)),
    ("contact", ("@", "+1 (")),
)
OTHER_TOPIC = "prose"


def topic_of(text: Column) -> Column:
    """The topic of a text by its marks; ``prose`` for the rest, null and empty texts included."""
    out = F.lit(OTHER_TOPIC)
    for topic, marks in reversed(TOPIC_MARKS):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(text, F.lit(m))
        out = F.when(hit, topic).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Number of runs without ASCII blanks; null counts as empty."""
    return F.size(bare_words(text)).cast("long")


def tempered(cells: DataFrame, column: str, power: float, least: float = 0.0) -> dict[str, float]:
    """Target shares of a column: its token shares to a power, scaled to one.

    ``power`` below 1 lifts small groups. The result has one number per value.
    """
    rows = cells.groupBy(column).agg(F.sum("tokens").alias("t")).where("t > 0").limit(MAX_VALUES + 1).collect()
    if len(rows) > MAX_VALUES:
        raise ValueError(f"{column} has more than {MAX_VALUES} values; group them first")
    total = float(sum(r.t for r in rows))
    raised = {r[column]: max((float(r.t) / total) ** power, least) for r in sorted(rows, key=lambda r: r[column])}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


def rake(
    cells: DataFrame, targets: Mapping[str, Mapping[str, float]], sweeps: int = MAX_SWEEPS, tolerance: float = TOLERANCE
) -> dict[str, dict[str, float]]:
    """Iterative proportional fitting: a factor per value of each marginal.

    ``cells`` holds (marginal columns, tokens). In turn each marginal's factors
    are scaled so that its weighted shares meet the targets, until a whole sweep
    changes no factor by more than ``tolerance`` or ``sweeps`` are done. The
    driver holds one factor for each value of each marginal, never the cells.
    A value without a target gets factor 0, a target without tokens is left
    out and its share goes to the others.
    """
    factors: dict[str, dict[str, float]] = {}
    for m, shares in targets.items():
        there = {r[0] for r in cells.where("tokens > 0").select(m).distinct().collect()}
        kept = {k: float(v) for k, v in shares.items() if k in there and v > 0}
        whole = sum(kept.values())
        targets = {**targets, m: {k: v / whole for k, v in kept.items()} if whole else {}}
        factors[m] = {k: 1.0 for k in targets[m]}
    if not all(factors.values()):
        return factors
    # Values become positions once, so that a sweep looks factors up in arrays and joins nothing.
    order = {m: sorted(f) for m, f in factors.items()}
    placed = cells
    for m, values in order.items():
        at = cells.sparkSession.createDataFrame(list(zip(values, range(len(values)))), f"`{m}` string, `_at_{m}` int")
        placed = placed.join(F.broadcast(at), m)  # MAX_VALUES rows at most
    placed = stage(placed.select("tokens", *(f"_at_{m}" for m in order)), "cells")
    scale = {m: [1.0] * len(values) for m, values in order.items()}
    for _ in range(sweeps):
        moved = 0.0
        for m in order:
            weight = F.lit(1.0)
            for n, f in scale.items():
                weight = weight * F.get(F.from_json(F.lit(json.dumps(f)), "array<double>"), F.col(f"_at_{n}"))
            mass = placed.groupBy(f"_at_{m}").agg(F.sum(F.col("tokens") * weight)).collect()
            mass = {i: float(v) for i, v in mass}
            whole = sum(mass.values())
            for i, value in enumerate(order[m]):
                now = mass.get(i, 0.0) / whole if whole else 0.0
                step = targets[m][value] / now if now else 1.0
                moved = max(moved, abs(step - 1.0))
                scale[m][i] *= step
        if moved <= tolerance:
            break
    return {m: dict(zip(order[m], scale[m])) for m in order}


def weighted(rows: DataFrame, factors: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``rows`` with column ``weight``, the product of their factors; unknown values weigh 0."""
    spark = rows.sparkSession
    weight = F.lit(1.0)
    for m, f in factors.items():
        name = f"_{m}_factor"
        table = spark.createDataFrame(sorted(f.items()), f"`{m}` string, `{name}` double")
        rows = rows.join(F.broadcast(table), m, "left")  # MAX_VALUES rows at most
        weight = weight * F.coalesce(F.col(name), F.lit(0.0))
    return rows.withColumn("weight", weight).drop(*(f"_{m}_factor" for m in factors))


def sampling_rate(cells: DataFrame, share: float) -> float:
    """The rate t with sum(tokens * min(1, t * weight)) = share of all tokens.

    Cells whose probability reaches 1 leave the sum, and the rate is taken
    again from the rest; each round is one aggregate, and rounds only raise t.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goal, rate = share * total, 0.0
    for _ in range(64):
        full = F.col("weight") * rate >= 1.0
        r = cells.agg(
            F.sum(F.when(full, F.col("tokens"))).alias("sure"),
            F.sum(F.when(~full, F.col("tokens") * F.col("weight"))).alias("open"),
        ).first()
        if not r.open or r.open <= 0:
            return rate
        new = (goal - float(r.sure or 0)) / float(r.open)
        if new <= rate * (1 + 1e-12):
            return rate
        rate = new
    return rate


def mix(
    docs: DataFrame,
    powers: Mapping[str, float],
    share: float,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic: Column | None = None,
    tokens: Column | None = None,
) -> DataFrame:
    """``docs`` with topic, n_tokens, weight, probability, sampled and sample_weight.

    Source, language and topic are the marginals. Their targets are the token
    shares raised to ``powers``; raking fits one weight per cell so that all
    three are met at once. A document is drawn with probability
    min(1, t * weight), where t spends ``share`` of all tokens, by a hash of its
    id, so retried tasks agree; sample_weight (weight / probability) of the
    drawn keeps weighted marginals at the targets. Probabilities are by cell: documents
    that repeat an id are drawn together, and null ids too.

    ``topic`` and ``tokens`` replace what is read from the text. The rows are
    read twice, for the cells and for the result, so a caller that needs no
    texts in the result should pass both, taken once.

    A null source or language is the value ``unknown``. Documents without
    tokens change no share and follow their cell; if a cell has no tokens at
    all, its weight is 0. Added columns get other names where ``docs`` has the
    same; the existing columns stay. An empty table gives an empty result.
    """
    names = {n: fresh(docs, n) for n in ("topic", "n_tokens", "weight", "probability", "sampled", "sample_weight")}
    inner = {"source": fresh(docs, "_source"), "lang": fresh(docs, "_lang"), "topic": names["topic"]}
    unknown = lambda c: F.coalesce(docs[c].cast("string"), F.lit("unknown"))
    rows = docs.withColumns(
        {
            inner["source"]: unknown("source"),
            inner["lang"]: unknown("lang"),
            inner["topic"]: topic_of(docs[text_col]) if topic is None else topic,
            names["n_tokens"]: token_count(docs[text_col]) if tokens is None else tokens,
        }
    )
    by = list(inner.values())
    cells = stage(rows.groupBy(*by).agg(F.sum(names["n_tokens"]).alias("tokens")), "cells")
    targets = {inner[m]: tempered(cells, inner[m], p) for m, p in powers.items()}
    factors = rake(cells, targets)
    heavy = stage(weighted(cells, factors), "cells")
    rate = sampling_rate(heavy, share)
    out = rows.join(heavy.select(*by, F.col("weight").alias(names["weight"])), by)
    w, p = F.col(names["weight"]), F.col(names["probability"])
    return (
        out.withColumn(names["probability"], F.least(F.lit(1.0), w * rate))
        .withColumn(names["sampled"], unit_hash(F.col(id_col), seed) < p)
        .withColumn(names["sample_weight"], F.when(F.col(names["sampled"]), w / p))
        .select(*docs.columns, *names.values())
    )
