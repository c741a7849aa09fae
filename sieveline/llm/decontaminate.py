"""Benchmark decontamination: n-gram seeds, an upper bound on the score, then Smith-Waterman alignment of words."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SEED_WORDS = 3
#: Least alignment score, as a share of the score of the whole item.
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items go through the documents in blocks of about so many words, which bounds what a task holds.
BLOCK_WORDS = 400_000

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits, so punctuation and case don't hide a copy."""
    return WORD.findall((text or "").lower())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of word ids; 0 matches nothing in ``passage``.

    One row of the table at a time: gaps within a row are a running maximum.
    """
    score, end = _best(item, passage)
    if not score:
        return 0, 0, 0
    again, length = _best(item[::-1], passage[:end][::-1], at_least=score)
    return score, end - length, end


def _best(item: np.ndarray, passage: np.ndarray, at_least: int | None = None) -> tuple[int, int]:
    """Best score and the first position after it; with ``at_least``, the first to reach it."""
    n = len(passage)
    slope = -GAP * np.arange(1, n + 1, dtype=np.int64)
    row = np.zeros(n + 1, dtype=np.int64)
    best, end = 0, 0
    for w in item:
        step = row[:-1] + np.where(passage == w, MATCH, MISMATCH)
        top = np.maximum(np.maximum(step, row[1:] + GAP), 0)
        row[1:] = np.maximum.accumulate(top + slope) - slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
            if at_least is not None and best >= at_least:
                break
    return best, end


class Items:
    """A block of test items as word ids, with their n-grams."""

    def __init__(self, texts: Sequence[str | None], n: int = SEED_WORDS):
        self.n = n
        words = [words_of(t) for t in texts]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.base = len(self.ids) + 1
        if self.base**n >= 2**63:
            raise ValueError("too many different words in a block of items")
        self.items = [np.array([self.ids[w] for w in ws], dtype=np.int64) for ws in words]
        self.grams = [self.codes(i) for i in self.items]
    def numbers(self, text: str | None) -> np.ndarray:
        ws = words_of(text)
        return np.fromiter(map(self.ids.get, ws, [0] * len(ws)), dtype=np.int64, count=len(ws))

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """A number for each n-gram, 0 where a word is in no item."""
        if len(ids) < self.n:
            return np.zeros(0, np.int64)
        out, known = np.zeros(len(ids) - self.n + 1, np.int64), np.ones(len(ids) - self.n + 1, bool)
        for k in range(self.n):
            part = ids[k : len(ids) - self.n + 1 + k]
            out = out * self.base + part
            known &= part > 0
        return np.where(known, out, 0)

    def seeds(self) -> "Seeds":
        """Every n-gram of every item."""
        places = defaultdict(list)
        for item, grams in enumerate(self.grams):
            for at, gram in enumerate(grams.tolist()):
                places[gram].append((item, at))
        return Seeds(self, places)


def _bound(good: np.ndarray) -> int:
    """At least the score of any alignment of a sequence whose words have a partner only where ``good``.

    A word inside an alignment gains MATCH at most with a partner, and costs a
    mismatch or a gap without one, so the best run of such gains is a bound.
    """
    total = np.concatenate(([0], np.cumsum(np.where(good, MATCH, max(MISMATCH, GAP)))))
    return int((total - np.minimum.accumulate(total)).max())


class Seeds:
    """Finds passages of items in texts."""

    def __init__(self, items: Items, places: dict[int, list[tuple[int, int]]]):
        self.items = items
        self.codes = np.array(sorted(places), dtype=np.int64)
        # Items and offsets of seed number i stand at ends[i]:ends[i + 1].
        flat = [where for code in self.codes.tolist() for where in places[code]]
        self.item, self.offset = np.array(flat, dtype=np.int64).reshape(-1, 2).T
        self.ends = np.cumsum([0, *(len(places[code]) for code in self.codes.tolist())])
        self.member = np.zeros(items.base, dtype=bool)

    def _hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, diagonals) of the seeds among the n-grams of a text, in order."""
        seed = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
        at = np.flatnonzero(self.codes[seed] == grams)
        first, n = self.ends[seed[at]], np.diff(self.ends)[seed[at]]
        row = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        item, diagonal = self.item[row], np.repeat(at, n) - self.offset[row]
        order = np.lexsort((diagonal, item))
        return item[order], diagonal[order]

    def can_reach(self, word_ids: np.ndarray, passage: np.ndarray, least: float) -> bool:
        """Whether an alignment of an item in a passage may score ``least``, by the words they share."""
        self.member[word_ids] = True
        enough = _bound(self.member[passage]) >= least
        self.member[word_ids] = False
        return enough and _bound(np.isin(word_ids, passage)) >= least

    def find(self, text: str | None, min_score: float = MIN_SCORE) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, words) of the best passage of each item found in a text."""
        ids = self.items.numbers(text)
        grams = self.items.codes(ids)
        if not len(grams) or not len(self.codes):
            return []
        items, diagonals = self._hits(grams)
        out = []
        starts = np.flatnonzero(np.diff(items, prepend=-1))
        for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(items)]):
            item, at = int(items[start]), diagonals[start:stop]
            word_ids, best = self.items.items[item], None
            perfect = MATCH * len(word_ids)
            # Each step off the seed's diagonal costs a gap, so a passage that scores enough leaves it by no more than this.
            slack = max(3, int(perfect * (1 - min_score)) // -GAP)
            cuts = np.flatnonzero(np.diff(at) > slack) + 1
            for near in np.split(at, cuts):
                low = max(0, int(near[0]) - slack)
                passage = ids[low : int(near[-1]) + len(word_ids) + slack]
                # A later passage counts only if it is better.
                least = min_score * perfect if best is None else best[1] * perfect + 1
                if not self.can_reach(word_ids, passage, least):
                    continue
                score, first, end = align(word_ids, passage)
                if score / perfect >= min_score and (best is None or score / perfect > best[1]):
                    best = (item, score / perfect, low + first, end - first)
            if best:
                out.append(best)
        return out


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[DataFrame, list[str | None]]]:
    """(positions with ids, texts) of each block of items; the number of blocks follows their words."""
    rows = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_WORDS))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        block = rows.where(place == b).collect()
        if block:
            spark, kind = items.sparkSession, rows.schema["item_id"].dataType.simpleString()
            ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], f"item int, item_id {kind}")
            yield ids, [r.text for r in block]


def find_copies(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """(id, item_id, score, first_word, n_words) for each document and item it holds a copy of.

    Every n-gram of three words of an item is looked up in each document. Where
    the words shared around a hit could reach the least score, the passage is
    aligned with the item word by word. The score is the alignment's share of
    a perfect one; the first best passage of a document is returned. No n-gram
    is too frequent to lead to a passage, so a copy in many documents is found
    in all of them, edited or not.

    Items pass in blocks of bounded size, each through all documents, which are
    never shuffled. Null and empty texts and items of less than three words
    match nothing. Rows that repeat are reported each; other columns are
    ignored.
    """
    out = docs.sparkSession.createDataFrame(
        [], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, "
        "score double, first_word long, n_words long"
    )
    # As text, an id passes through pandas unchanged, null or not.
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType
    for ids, texts in _blocks(benchmark, item_col, item_text_col):
        seeds = Items(texts).seeds()

        def search(parts: Iterator[pd.DataFrame], seeds=seeds) -> Iterator[pd.DataFrame]:
            for part in parts:
                found = [(k, *f) for k, text in zip(part["id"], part["text"]) for f in seeds.find(text, min_score)]
                yield pd.DataFrame(found, columns=["id", "item", "score", "first_word", "n_words"])

        found = rows.mapInPandas(search, "id string, item int, score double, first_word long, n_words long")
        named = found.join(F.broadcast(ids), "item")  # a block of items
        out = out.unionByName(named.select(F.col("id").cast(kind).alias(id_col), "item_id", "score", "first_word", "n_words"))
    return out


def contamination_column(text: Column, seeds: Seeds, min_score: float = MIN_SCORE) -> Column:
    """The best alignment score of a text with any item of the block, 0 if none reaches ``min_score``."""

    @F.pandas_udf("double")
    def best(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([max((f[1] for f in seeds.find(t, min_score)), default=0.0) for t in texts], dtype="float64")

    return best(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows that hold a copy of an item; columns and other rows as they are."""
    for _, texts in _blocks(benchmark, "item_id", "text"):
        docs = docs.where(contamination_column(F.col(text_col), Items(texts).seeds(), min_score) < min_score)
    return docs
