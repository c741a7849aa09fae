"""Principal components and whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Vectors are put on an integer grid, so the scatter is summed in exact integers whatever the
partitioning. The d x d scatter alone reaches the driver; rows never do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRID, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries from here on don't fit the grid's exact sums and count as non-finite.
LARGEST = float(2**31)
#: Rows multiplied at once.
BLOCK = 4096
MAX_SWEEPS = 60
_EXACT = 2**62
Wide = np.longdouble


@dataclass(frozen=True)
class Basis:
    """Mean, components as columns and their eigenvalues, largest first, of ``n`` vectors."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if self.trace else np.zeros(0)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are numbers that the grid can hold."""
    c = lambda x: x.cast("double")
    bad = lambda x: x.isNull() | F.isnan(c(x)) | (F.abs(c(x)) >= LARGEST)
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def on_grid(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(GRID))).cast("long") + F.lit(SHIFT))


def grid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows that can be used; x is a long array. Vectors of an unusual length are left out.

    The usual length is the most frequent one, of equally frequent ones the largest.
    """
    kept = df.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    lengths = kept.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    usual = lengths.agg(F.max_by("d", F.struct("n", "d"))).scalar()
    return kept.where(F.size("vector") == usual).select("id", on_grid(F.col("vector")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield _matrix(batch.column("x").slice(at, BLOCK))


def _exact_product(z: np.ndarray) -> np.ndarray:
    """z'z in integers; in Python's own where 64 bits could overflow."""
    top = int(np.abs(z).max()) if z.size else 0
    return z.T @ z if top * top * len(z) < _EXACT else z.astype(object).T @ z.astype(object)


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the sum of every dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for x in _blocks(batches):
            n, total = n + len(x), total + x.sum(axis=0)
        if n:
            made = [n, *map(int, total)]
            yield pa.record_batch([pa.array(range(len(made))), pa.array([Decimal(v) for v in made], pa.decimal128(38))], ["i", "v"])

    parts = vectors.select("x").mapInArrow(add, "i long, v decimal(38,0)")
    got = [int(r.v) for r in parts.groupBy("i").agg(F.sum("v").cast("decimal(38,0)").alias("v")).orderBy("i").collect()]
    return (got[0], got[1:]) if got else (0, [])


def _scatter(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """n squared times the covariance, exactly, as an array of integers.

    Vectors are centred at the whole part m of the mean before they are
    multiplied; r = sum - n m then corrects for the rest: n sum(zz') - rr'.
    """
    middle = np.array([s // n for s in sums], dtype=np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches):
            made = _exact_product(x - middle).astype(object)
            total = made if total is None else total + made
        if total is not None:
            i, j = np.triu_indices(len(middle))
            values = pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38))
            yield pa.record_batch([pa.array(i), pa.array(j), values], ["i", "j", "v"])

    parts = vectors.select("x").mapInArrow(add, "i long, j long, v decimal(38,0)")
    cells = parts.groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    out = np.zeros((len(sums), len(sums)), dtype=object)
    for r in cells:
        out[r.i, r.j] = out[r.j, r.i] = n * int(r.v) - rest[r.i] * rest[r.j]
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = LL' for a positive semidefinite matrix, one column for each of its rank.

    The largest diagonal left is the next pivot, so in pivot order L is lower
    triangular. What is left below the rounding of the largest entry is no rank.
    """
    d = len(a)
    left = np.diag(a).astype(Wide).copy()
    floor = d * 8 * np.finfo(Wide).eps * max(left.max(initial=Wide(0)), Wide(0))
    columns: list[np.ndarray] = []
    for _ in range(d):
        p = int(np.argmax(left))
        if left[p] <= floor:
            break
        column = a[:, p].astype(Wide)
        for c in columns:
            column = column - c * c[p]
        column = column / np.sqrt(left[p])
        columns.append(column)
        left = left - column * column
        left[p] = 0
    return np.stack(columns, axis=1) if columns else np.zeros((d, 0), dtype=Wide)


def _rounds(r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of r columns once, in rounds of disjoint pairs."""
    order = list(range(r + r % 2))
    for _ in range(len(order) - 1):
        half = len(order) // 2
        pairs = [(a, b) for a, b in zip(order[:half], order[: half - 1 : -1]) if a < r and b < r]
        if pairs:
            yield tuple(np.array(side) for side in zip(*pairs))
        order = [order[0], order[-1], *order[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of factor factor', largest first.

    Pairs of columns are rotated until all are orthogonal; their squared norms
    are then the eigenvalues and the columns over their norms the eigenvectors.
    The largest entry of a vector is positive.
    """
    g = factor.astype(Wide).copy()
    small = 4 * np.finfo(Wide).eps
    for _ in range(MAX_SWEEPS):
        turned = False
        for i, j in _rounds(g.shape[1]):
            x, y = g[:, i], g[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(xy) > small * np.sqrt(xx * yy)
            if not turn.any():
                continue
            turned = True
            safe = np.where(turn, xy, Wide(1))
            zeta = (yy - xx) / (2 * safe)
            t = np.where(zeta >= 0, Wide(1), Wide(-1)) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn, t, Wide(0))
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            g[:, i], g[:, j] = c * x - s * y, s * x + c * y
        if not turned:
            break
    else:
        raise RuntimeError(f"columns are not orthogonal after {MAX_SWEEPS} sweeps")
    norms = np.sqrt((g * g).sum(0))
    order = np.argsort(-norms, kind="stable")
    vectors = g[:, order] / norms[order]
    if vectors.size:
        top = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])
    return (norms[order] ** 2).astype(float), vectors.astype(float)


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Basis:
    """The first ``k`` components of the grid vectors (id, x); fewer where the rank is smaller."""
    n, sums = _sums(vectors)
    if not n:
        return Basis(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    scatter = _scatter(vectors, n, sums)
    covariance = np.array([[Wide(int(v)) for v in row] for row in scatter]) / (Wide(n) * Wide(n))
    values, components = one_sided_jacobi(pivoted_cholesky(covariance))
    return Basis(n, tuple(sums), components[:, :k], values[:k], float(np.trace(covariance)))


def project(vectors: DataFrame, basis: Basis) -> DataFrame:
    """(id, deviation, whitened): the exact squared distance from the mean times n squared, and the whitened array."""
    n, sums = basis.n, np.array(basis.sums, dtype=object)
    scale = basis.components / np.sqrt(basis.eigenvalues)
    whole = np.array([s // n for s in basis.sums], dtype=np.int64)
    part = np.array([(s % n) / n for s in basis.sums])
    kind = vectors.schema["id"].dataType

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (sums - n * whole).astype(object)
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _matrix(batch.column("x")) - whole
            top = int(np.abs(z).max()) * n + n
            if top * top * z.shape[1] < _EXACT:
                away = (z * n - rest.astype(np.int64)) ** 2
            else:
                away = (z.astype(object) * n - rest) ** 2
            far = away.sum(axis=1)
            white = (z - part) @ scale
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pa.array([Decimal(int(v)) if v < 10**38 else None for v in far], pa.decimal128(38)),
                    pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), white.shape[1]).cast(pa.list_(pa.float64())),
                ],
                ["id", "deviation", "whitened"],
            )

    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("deviation", T.DecimalType(38, 0)),
            T.StructField("whitened", T.ArrayType(T.DoubleType())),
        ]
    )
    return vectors.mapInArrow(made, schema)


def identity_error(projected: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity, over all rows.

    Every task centres its own rows at their mean before multiplying and gives
    one row of moments; those are merged, so a table of any size is exact.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, moments = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            w = _matrix(batch.column("whitened"))
            here = w.mean(axis=0)
            away = here - mean
            both = n + len(w)
            moments = moments + (w - here).T @ (w - here) + np.outer(away, away) * (n * len(w) / both)
            mean, n = mean + away * (len(w) / both), both
        if n:
            i, j = (a.ravel() for a in np.indices((k, k)))
            yield pa.record_batch(
                [pa.array(i), pa.array(j), pa.array(np.full(k * k, n)), pa.array(mean[i]), pa.array(mean[j]), pa.array(moments.ravel())],
                ["i", "j", "n", "a", "b", "m"],
            )

    parts = projected.select("whitened").mapInArrow(add, "i long, j long, n long, a double, b double, m double")
    n, a, b = F.sum("n"), F.sum(F.col("n") * F.col("a")), F.sum(F.col("n") * F.col("b"))
    between = F.sum(F.col("n") * F.col("a") * F.col("b")) - a * b / n
    cells = parts.groupBy("i", "j").agg(((F.sum("m") + between) / n).alias("v"))
    off = F.abs(F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return float(cells.agg(F.max(off)).first()[0] or 0.0)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, holds a null or non-finite entry (or one
    of 2**31 or more) or has not the table's usual length are dropped. Every
    other row is fitted and returned, rows that repeat and rows without id too.
    Other columns are left out, whatever their names. Components with eigenvalue
    0 are not there, so equal vectors, one vector or an empty table give no row.
    ``deviation`` is decimal(38,0), null beyond that.

    The driver holds d x d numbers for vectors of d entries, whatever the number of rows.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    vectors = grid_vectors(df, id_col, vector_col)
    basis = fit(vectors, k)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"{id_col} is the name of a result column")
    made = len(basis.eigenvalues)
    if not made:
        empty = df.select(F.col(id_col)).limit(0)
        kinds = ("int", "long", "decimal(38,0)", "double", "double", "double")
        return empty.select(id_col, *[F.lit(None).cast(t).alias(n) for n, t in zip(names[1:], kinds)])
    projected = project(vectors, basis)
    error = identity_error(projected, made)
    shares = F.array(*[F.lit(float(v)) for v in basis.explained])
    rows = projected.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(basis.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
