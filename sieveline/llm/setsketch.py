"""Near-duplicate classes of documents by SetSketch registers.

A register is the number of steps of a geometric scale that the smallest of a set's exponential random
numbers lies below 1, cut to 16 bits. Registers of a union are the larger ones of its parts, and equal
registers of two sets are the likelier the more alike the sets are. Bands of registers find candidates, the
counts of larger, equal and smaller registers judge them by likelihood, and the whole sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import stage, unstage
from sieveline.llm.components import components
from sieveline.llm.similar import shingles

SHINGLE_WORDS = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Sets of similarity s share a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.99994 at 0.8.
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Base of the scale, rate of the exponential numbers and highest register but one.
BASE, RATE, STEPS = 1.001, 20.0, 2**16 - 2
#: A candidate goes when similarity 0.8 is less likely than the best estimate by more than this factor's
#: logarithm; a pair that has it is lost so with a probability of about 5e-7.
DOUBT = 12.0
#: Buckets of up to so many sets are compared in pairs, fuller ones with one of their sets at a time.
SMALL, STAR_ROUNDS = 8, 2
#: What is apart in a full bucket then is dealt by further registers, so many that sets of this similarity
#: rarely meet, and so often that sets of similarity 0.8 miss each other in a bucket with probability e ** -4.
CROWD, TRIES = 0.7, 4.0
#: Parts that the shingles of a set in a crowd are counted in.
PARTS = 64

_random = np.random.default_rng(23)
_FACTORS = _random.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _random.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_LOG_BASE = math.log(BASE)


def registers(numbers: np.ndarray) -> np.ndarray:
    """The registers of a set of well-mixed 64-bit numbers; all 0 for an empty set."""
    if not len(numbers):
        return np.zeros(REGISTERS, dtype=np.uint16)
    least = np.full(REGISTERS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(numbers), 2048):
        part = (numbers[at : at + 2048, None] ^ _MASKS) * _FACTORS
        np.minimum(least, part.min(axis=0), out=least)
    share = (least.astype(float) + 0.5) / 2.0**64
    smallest = -np.log1p(-np.minimum(share, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / _LOG_BASE), 0, STEPS + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def cardinality(made: np.ndarray) -> float:
    """The estimated size of the set behind registers."""
    low = np.power(BASE, -made.astype(float)).sum()
    return len(made) * (1 - 1 / BASE) / (RATE * _LOG_BASE * low) if made.any() else 0.0


def _chance(x: np.ndarray) -> np.ndarray:
    """The probability that a register is larger when a share x of the union is its set's alone."""
    return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / _LOG_BASE


def log_likelihood(j: np.ndarray, u: np.ndarray, larger: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Of similarity j for sets with shares u and 1 - u of both sizes, of whose registers so many are larger and smaller."""
    v = 1 - u
    up, down = _chance(u - v * j), _chance(v - u * j)
    same = np.clip(1 - up - down, 1e-12, 1)
    return larger * np.log(up) + smaller * np.log(down) + (REGISTERS - larger - smaller) * np.log(same)


def estimate(n_a: np.ndarray, n_b: np.ndarray, larger: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """The similarity of greatest joint likelihood, by golden section; the likelihood has one maximum."""
    u = n_a / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    shrink = (math.sqrt(5) - 1) / 2
    for _ in range(40):
        x, y = high - shrink * (high - low), low + shrink * (high - low)
        left = log_likelihood(x, u, larger, smaller) >= log_likelihood(y, u, larger, smaller)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def plausible(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether pairs of registers (rows of a and b) of sets of known sizes may be that similar."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    best, u, least = estimate(n_a, n_b, larger, smaller), n_a / (n_a + n_b), np.full(len(n_a), percent / 100)
    doubt = log_likelihood(best, u, larger, smaller) - log_likelihood(least, u, larger, smaller)
    return (best >= percent / 100) | (doubt <= DOUBT)


@lru_cache(maxsize=32)
def _set_of(text: str, words: int) -> np.ndarray:
    return shingles(text, words)


def linked(a: str, b: str, percent: int = PERCENT, words: int = SHINGLE_WORDS) -> bool:
    x, y = _set_of(a, words), _set_of(b, words)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return bool(len(x) and len(y)) and 100 * both >= percent * (len(x) + len(y) - both)


def sketch_column(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """(n, node, made) of each text: the size of its shingle set, a number of 128 bits that stands for it, its registers."""

    @F.pandas_udf("n long, node binary, made binary")
    def sketched(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            sets = [shingles(t, words) for t in texts]
            yield pd.DataFrame(
                {
                    "n": pd.Series([len(s) for s in sets], dtype="int64"),
                    "node": [xxhash.xxh128_digest(s.tobytes()) for s in sets],
                    "made": [registers(s).astype(">u2").tobytes() for s in sets],
                }
            )

    return sketched(text)


def _plausible_column(percent: int) -> Column:
    rows = lambda c: np.frombuffer(b"".join(c), dtype=">u2").reshape(len(c), REGISTERS)

    @F.pandas_udf("boolean")
    def judged(n_a: pd.Series, n_b: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="bool")
        return pd.Series(plausible(n_a.to_numpy(float), n_b.to_numpy(float), rows(a), rows(b), percent))

    return judged("n_a", "n_b", "made_a", "made_b")


def _linked_column(percent: int, words: int) -> Column:
    @F.pandas_udf("boolean")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in parts:
            yield pd.Series([linked(a, b, percent, words) for a, b in zip(left, right)], dtype="bool")

    return judged("text_a", "text_b")


def _band(made: Column, at: int, rows: int = ROWS) -> Column:
    return F.xxhash64(F.lit(at), F.substring(made, 2 * rows * at + 1, 2 * rows))


def _couples(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) within the buckets of ``rows`` that aren't tied yet and whose sizes allow a link."""
    one = rows.select("bucket", F.col("num").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "alone", "parts", "root")])
    two = rows.select("bucket", F.col("num").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "alone", "parts", "root")])
    both = one.join(two, "bucket").where("a < b and root_a <> root_b")
    # Each bound stands in this once: Spark works out what repeats for all pairs, whatever the rest of the condition.
    enough = lambda most: most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    # What a set holds alone among all candidates is in no intersection.
    most = F.least(F.col("n_a") - F.col("alone_a"), F.col("n_b") - F.col("alone_b"))
    # Nor is more of a part than the set holds there that has less of it.
    less = F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y).cast("long"))
    within = F.aggregate(less, F.lit(0).cast("long"), lambda total, x: total + x)
    return both.where(enough(most) & F.coalesce(enough(within), F.lit(True))).select("a", "b")


def _near_sizes(percent: int) -> Column:
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _shingle_column(text: Column, words: int) -> Column:
    @F.pandas_udf("array<long>")
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([shingles(t, words).view(np.int64) for t in texts], dtype="object")

    return made(text)


def shared_counts(text: str, alone: np.ndarray | None, words: int) -> np.ndarray | None:
    """How many shingles of each part, by their numbers, a set holds that aren't its alone; none for sets past 16 bits."""
    made = shingles(text, words)
    if len(made) >= 2**15:
        return None
    if alone is not None:
        made = np.setdiff1d(made, np.asarray(alone, dtype=np.int64).view(np.uint64), assume_unique=True)
    return np.bincount((made % np.uint64(PARTS)).astype(np.int64), minlength=PARTS).astype(np.int16)


def _shared_column(words: int) -> Column:
    @F.pandas_udf("array<smallint>")
    def made(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, alone in parts:
            yield pd.Series([shared_counts(t, a, words) for t, a in zip(texts, alone)], dtype="object")

    return made("text", "shingles")


def _with_alone(rows: DataFrame, held: DataFrame, percent: int, words: int) -> DataFrame:
    """``rows`` with the number of shingles that only their set holds and the parts of the others, without sets that
    so can't have a link.

    In a crowd of edited copies the edits are what a set holds alone and what
    it lacks of the others' parts, and they decide most pairs without comparing
    them. No union in a bucket is smaller than its smallest set.
    """
    texts = held.join(rows.select("num").distinct(), "num")
    each = texts.select("num", F.explode(_shingle_column(F.col("text"), words)).alias("shingle"))
    once = each.groupBy("shingle").agg(F.count("*").alias("sets"), F.min("num").alias("num")).where("sets = 1")
    alone = once.groupBy("num").agg(F.count("*").alias("alone"), F.collect_list("shingle").alias("shingles"))
    facts = texts.join(alone, "num", "left").select("num", F.coalesce("alone", F.lit(0)).alias("alone"), _shared_column(words).alias("parts"))
    least = rows.groupBy("bucket").agg(F.min("n").alias("least"))
    found = rows.drop("alone", "parts").join(stage(facts, "alone"), "num").join(least, "bucket")
    most = F.col("n") - F.col("alone")
    return found.where(most * 100 >= (F.col("n") + F.greatest(F.col("least") - most, F.lit(0))) * percent).drop("least")


def _crowds(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Full buckets dealt out by further registers, drawn by a hash; more of them the fuller the bucket is."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"))
    words = F.greatest(F.lit(1), F.ceil(F.log(F.col("size") / SMALL) / F.lit(-math.log(CROWD)))).cast("int")
    sizes = stage(sizes.withColumn("words", words), "crowds")
    tries = F.ceil(F.lit(TRIES) / F.pow(F.lit(PERCENT / 100), F.col("words"))).cast("int")
    dealt = rows.join(sizes, "bucket").join(nodes.select("num", "made"), "num")
    dealt = dealt.select("bucket", "num", "n", "alone", "parts", "words", "made", F.explode(F.sequence(F.lit(1), tries)).alias("try"))
    word = lambda i: F.substring(F.col("made"), (2 * F.pmod(F.xxhash64("bucket", "try", i), F.lit(REGISTERS)) + 1).cast("int"), F.lit(2))
    key = F.transform(F.sequence(F.lit(1), F.col("words")), word)
    return dealt.select(F.xxhash64("bucket", "try", key).alias("bucket"), "num", "n", "alone", "parts")


def links(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], percent: int = PERCENT, words: int = SHINGLE_WORDS) -> DataFrame:
    """(num, root) of the sets that are tied by links; root is the smallest number reachable.

    ``nodes`` (num, n, made) are different sets, staged; ``texts(wanted)`` gives
    (num, text) for the numbers in ``wanted``. A bucket of more than ``SMALL``
    sets isn't paired with itself. First every set is compared with the smallest
    and the largest number it shares a bucket with, which ties most of a large
    class. Then, in a round, the sets of a full bucket that aren't tied to one
    of them are compared with that one, which leaves the bucket. Buckets that
    stay full are dealt by further registers, and what meets there again is
    compared in pairs, so nothing that shares a band is dropped unseen.
    """
    bands = [_band(F.col("made"), i) for i in range(BANDS)]
    unknown = F.lit(0).cast("long").alias("alone"), F.lit(None).cast("array<smallint>").alias("parts")
    rows = nodes.select(F.explode(F.array(*bands)).alias("bucket"), "num", "n", *unknown)
    ends = rows.groupBy("bucket").agg(F.min("num").alias("low"), F.max("num").alias("high")).where("low < high")
    ends = stage(ends, "bands")
    open_ = stage(rows.join(ends, "bucket"), "bands")
    unstage(ends)
    held = stage(texts(open_.select("num").distinct()), "band-texts")
    facts = lambda s: nodes.select(F.col("num").alias(s), F.col("n").alias(f"n_{s}"), F.col("made").alias(f"made_{s}"))
    text_of = lambda s: held.select(F.col("num").alias(s), F.col("text").alias(f"text_{s}"))

    def tied(pairs: DataFrame, roots: DataFrame | None) -> DataFrame | None:
        """The roots after the links among ``pairs`` are added."""
        judged = pairs.distinct().join(facts("a"), "a").join(facts("b"), "b").where(_near_sizes(percent))
        likely = stage(judged.where(_plausible_column(percent)).select("a", "b"), "likely")
        if likely.isEmpty():
            return roots
        both = likely.join(text_of("a"), "a").join(text_of("b"), "b")
        found = both.where(_linked_column(percent, words)).select("a", "b")
        found = found if roots is None else found.union(roots.select(F.col("num").alias("a"), F.col("root").alias("b")))
        made = stage(components(found).withColumnRenamed("node", "num"), "roots")
        unstage(likely, roots)
        return made

    met = open_.groupBy("num").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    met = met.select("num", F.explode(F.array("low", "high")).alias("other")).where("num <> other")
    roots = tied(met.select(F.least("num", "other").alias("a"), F.greatest("num", "other").alias("b")), None)
    for turn in range(STAR_ROUNDS + 2):
        named = open_.select("bucket", "num", "n", "alone", "parts")
        named = named.withColumn("root", F.col("num")) if roots is None else named.join(roots, "num", "left").withColumn("root", F.coalesce("root", "num"))
        apart = named.groupBy("bucket").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
        apart = stage(apart.where("low <> high").select("bucket", "size"), "apart")
        named = stage(named.join(apart, "bucket"), "open")
        unstage(open_, apart)
        if named.isEmpty():
            break
        dealt = turn > STAR_ROUNDS
        small, full = named.where((F.col("size") <= SMALL) | F.lit(dealt)), named.where((F.col("size") > SMALL) & ~F.lit(dealt))
        pairs = _couples(small, percent)
        if turn < STAR_ROUNDS:
            star = F.min(F.struct(F.xxhash64("num", F.lit(turn)).alias("order"), "num", "root")).alias("star")
            stars = stage(full.groupBy("bucket").agg(star), "stars")
            rest = full.join(stars, "bucket").where("num <> star.num")
            pair = rest.where("root <> star.root").select(F.least("num", "star.num").alias("a"), F.greatest("num", "star.num").alias("b"))
            pairs, open_ = pairs.union(pair), stage(rest.select("bucket", "num", "n", "alone", "parts"), "open")
        elif turn == STAR_ROUNDS:
            full = stage(_with_alone(full, held, percent, words), "crowds")
            open_ = stage(_crowds(full, nodes), "crowds")
        roots = tied(pairs, roots)
        unstage(named)
    unstage(held)
    return nodes.select("num", F.col("num").alias("root")).limit(0) if roots is None else roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row: the size of its set of four-word shingles and its class.

    The class is the smallest id reachable by links. Texts of equal sets are
    one node before any search, so copies of any number are one row there.
    Null and empty texts and those without words have no shingle and are linked
    with nothing: the class is their own id. Rows without id take part and get
    the smallest id of the others, or null; ``kept`` is whether id and class
    are the same. Repeated rows come out repeated, other columns are left out
    whatever their names, an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = rows.select("id", F.xxhash64("text").alias("words"), sketch_column(F.col("text")).alias("s"))
    prints = stage(made.select("id", "words", "s.*"), "sketches")
    # Of equal sets the row with the smallest id stands for all; ids may be missing.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "words")).alias("first")
    nodes = prints.where("n > 0").groupBy("node").agg(first, F.any_value("n").alias("n"), F.any_value("made").alias("made"))
    nodes = stage(nodes.withColumn("num", F.monotonically_increasing_id()), "nodes")

    def texts(wanted: DataFrame) -> DataFrame:
        """The text of the row that stands for a node, found by its id and hash."""
        known = nodes.join(wanted, "num").select("num", "first.none", F.coalesce(F.col("first.id").cast("string"), F.lit("")).alias("id"), "first.words")
        keyed = rows.select(F.col("id").isNull().alias("none"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("words"), "text")
        return keyed.join(known, ["none", "id", "words"]).groupBy("num").agg(F.any_value("text").alias("text"))

    tied = links(nodes.select("num", "n", "made"), texts, percent)
    classes = nodes.select("num", "node", F.col("first.id").alias("id")).join(tied, "num", "left").withColumn("root", F.coalesce("root", "num"))
    least = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    named = stage(classes.join(least, "root").select("node", "component_id"), "classes")
    empty = prints.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = prints.where("n > 0").select("id", "n", "node").join(named, "node").select("id", "n", "component_id").union(empty)
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
