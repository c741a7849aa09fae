"""Faults of chat transcripts and their cheapest repair, found by Knuth's lightest-derivation agenda.

A repair reads a conversation's rows in order and writes roles of the form (s?(ua)+)?. What has been
written is one of four states: nothing yet, a system message, an open user message, a closed exchange.
The deductions are

    prefix(i, q)   edit(i, q, r)       prefix(k, q)   span(k, q, r)
    ---------------------------- ,     ----------------------------
         prefix(i + 1, r)                   prefix(k + 1, r)

where an edit keeps, re-roles or deletes row i, or inserts a message before it, and span(k, q, r) is the
lightest way through the k-th chunk of a long conversation. The weight of a conclusion is the sum of the
costs and the joined audit letters. Both only grow, so the weight is superior and the item popped first
from the agenda is final. Of two audits of one item and one cost neither starts with the other: the longer
one would only add insertions, which cost. So what is appended never changes their order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import BLANKS, stage

KEEP_COST, ROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
NOTHING, SYSTEM, OPEN, CLOSED = range(4)
STATES = (NOTHING, SYSTEM, OPEN, CLOSED)
FINAL = (NOTHING, CLOSED)
#: Rows of a conversation that one task repairs at once; longer conversations are chains of chunks.
CHUNK = 256
FINE, TRUNCATED, REMOVE = "0", "1", "2"
LEGAL = ("su", "ua", "au")
NOT_BLANK = r"[^\x20\x09-\x0D]"
#: The message written next from a state, and the state it leads to.
NEXT = {NOTHING: ("user", OPEN), SYSTEM: ("user", OPEN), OPEN: ("assistant", CLOSED), CLOSED: ("user", OPEN)}

CHART = "array<struct<start:int,end:int,cost:long,audit:string>>"


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns with faults by a checksum of ``conv:turn``; null texts, roles and parts of the key are one space.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 takes its full
    stops, question and exclamation marks, 3 repeats it and 4 makes its role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        blank(role).alias("role"),
        blank(text).alias("text"),
        (F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20).alias("fault"),
    )
    fault = F.col("fault")
    changed = rows.where(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("times"),
    )
    return changed.select("conv_id", "turn", "role", "text", F.explode("times").alias("time")).drop("time")


def edits(state: int, role: str, fault: str) -> Iterator[tuple[int, int, str]]:
    """(state after, cost, audit letter) of every edit of one row."""
    yield state, DELETE_COST, "D"
    if fault == REMOVE:
        return
    more = TRUNCATED_COST if fault == TRUNCATED else 0
    wanted, after = NEXT[state]
    if role == wanted[0]:
        yield after, KEEP_COST + more, "K"
    elif role == "s" and state == NOTHING:
        yield SYSTEM, KEEP_COST + more, "K"
    yield after, ROLE_COST + more, "R"


@lru_cache(maxsize=20_000)
def chart(codes: str) -> tuple[tuple[int, int, int, str], ...]:
    """(start, end, cost, audit): the lightest way through a chunk from each state to each state.

    ``codes`` has two letters a row, the role's initial and the fault. For each
    start the agenda runs until every item at the chunk's end is final.
    """
    n = len(codes) // 2
    out = []
    for start in STATES:
        agenda = [(0, "", 0, start)]
        final: dict[tuple[int, int], tuple[int, str]] = {}
        while agenda:
            cost, audit, at, state = heapq.heappop(agenda)
            if (at, state) in final:
                continue
            final[at, state] = (cost, audit)
            after = NEXT[state][1]
            if (at, after) not in final:
                heapq.heappush(agenda, (cost + INSERT_COST, audit + "I", at, after))
            if at < n:
                for after, more, letter in edits(state, codes[2 * at], codes[2 * at + 1]):
                    if (at + 1, after) not in final:
                        heapq.heappush(agenda, (cost + more, audit + letter, at + 1, after))
        out += [(start, end, *final[n, end]) for end in STATES if (n, end) in final]
    return tuple(out)


Step = tuple[int, int, str, int]  # chunk, start state, audit, cost


class Survivors:
    """The lightest chain of spans to each state, chunk after chunk, of one conversation.

    Steps that all chains share are settled and given out, so only what still
    differs is held. A state is dropped when a closed exchange is cheaper by
    more than anything that state alone allows (keeping a system message).
    """

    def __init__(self) -> None:
        self.cost, self.steps = {NOTHING: 0}, {NOTHING: []}

    def _weight(self, state: int) -> tuple[int, str]:
        return self.cost[state], "".join(s[2] for s in self.steps[state])

    def add(self, chunk: int, spans: Iterable[tuple[int, int, int, str]]) -> list[Step]:
        best: dict[int, tuple[int, str, int, str, int]] = {}
        weights = {q: self._weight(q) for q in self.cost}
        for start, end, cost, audit in spans:
            if start in weights:
                total, so_far = weights[start]
                made = (total + cost, so_far + audit, start, audit, cost)
                if end not in best or made[:2] < best[end][:2]:
                    best[end] = made
        closed = best[CLOSED][0]
        allowed = {NOTHING: closed + DELETE_COST, SYSTEM: closed}
        best = {q: b for q, b in best.items() if b[0] <= allowed.get(q, b[0])}
        self.steps = {q: [*self.steps[start], (chunk, start, audit, cost)] for q, (_, _, start, audit, cost) in best.items()}
        self.cost = {q: b[0] for q, b in best.items()}
        return self._settled()

    def _settled(self) -> list[Step]:
        chains = list(self.steps.values())
        n = 0
        while all(len(c) > n for c in chains) and len({c[n] for c in chains}) == 1:
            n += 1
        out = chains[0][:n]
        self.steps = {q: c[n:] for q, c in self.steps.items()}
        return out

    def end(self) -> list[Step]:
        """The steps still open on the lightest chain to the goal."""
        return self.steps[min((q for q in FINAL if q in self.cost), key=self._weight)]


def repaired(rows: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str]]:
    """The (role, text) messages that an audit makes of a chunk's rows, starting in ``state``."""
    out, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        role, after = NEXT[state]
        text = ""
        if letter != "I":
            kept, text = rows[at]
            at += 1
            if letter == "K":
                role = kept
                after = SYSTEM if kept[:1] == "s" else after
        out.append((role, text))
        state = after
    return out


def lightest(codes: str) -> tuple[int, str]:
    """(cost, audit) of one conversation given by its codes, as one chunk."""
    return min((cost, audit) for start, end, cost, audit in chart(codes) if start == NOTHING and end in FINAL)


def _chart_column(codes: Column) -> Column:
    @F.pandas_udf(CHART)
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("start", "end", "cost", "audit")
        for batch in parts:
            yield pd.Series([[dict(zip(names, s)) for s in chart(c)] for c in batch], dtype="object")

    return made(codes)


def _repaired_column(rows: Column, audit: Column, state: Column) -> Column:
    @F.pandas_udf("array<struct<role:string,text:string>>")
    def made(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for messages, audits, states in parts:
            out = []
            for m, a, q in zip(messages, audits, states):
                got = repaired([(r["role"], r["text"]) for r in m], a, q)
                out.append([{"role": r, "text": t} for r, t in got])
            yield pd.Series(out, dtype="object")

    return made(rows, audit, state)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decide every chunk of the conversations that stream by, ordered by key and chunk."""
    names = ["key", "chunk", "state", "audit", "cost", "illegal"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]

    def give(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    key = chain = None
    last = ""
    crossed: dict[int, int] = {}
    out: list = []

    def put(steps: list[Step]) -> None:
        out.extend((key, chunk, start, audit, cost, crossed.pop(chunk, 0)) for chunk, start, audit, cost in steps)

    for batch in batches:
        for row in batch.to_pylist():
            if chain is None or row["key"] != key:
                if chain:
                    put(chain.end())
                key, chain, last, crossed = row["key"], Survivors(), "", {}
            roles = last + row["codes"][::2]
            crossed[row["chunk"]] = sum(roles[i : i + 2] not in LEGAL for i in range(len(roles) - 1))
            last = roles[-1]
            put(chain.add(row["chunk"], [(s["start"], s["end"], s["cost"], s["audit"]) for s in row["spans"]]))
        if out:
            yield give(out)
            out.clear()
    if chain:
        put(chain.end())
    if out:
        yield give(out)


@dataclass(frozen=True)
class Repair:
    """``faults``: conv_id, gaps, blank, duplicate, truncated of each conversation. ``chunks``: key, conv_id,
    chunk, audit, cost, illegal and the ``repaired`` messages of each chunk, in the order of ``chunk``."""

    faults: DataFrame
    chunks: DataFrame

    def messages(self) -> DataFrame:
        """(conv_id, chunk, at, role, text): the repaired conversations, a row per message."""
        each = self.chunks.select("conv_id", "chunk", F.posexplode("repaired").alias("at", "m"))
        return each.select("conv_id", "chunk", "at", "m.role", "m.text")


def _key(conv: Column) -> Column:
    """A join key of a conversation id that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Find the faults of every conversation and its cheapest repair.

    Rows go by turn, nulls first, then by role and text; rows equal in all of
    them are interchangeable. A null role or text is one space, a null
    conversation id is a conversation of its own. Other columns are left out,
    whatever their names. An empty table gives empty results.

    Rows are sorted by range over all tasks and numbered, so a conversation of
    any length is spread over many of them; each run of ``CHUNK`` rows is
    charted on its own, and one row per chunk is chained. First mentions of a
    message are found by aggregating before the join.
    """
    order = [F.col(c).asc_nulls_first() for c in ("key", "turn", "role", "text")]
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(
        F.col(conv).alias("conv_id"), _key(F.col(conv)).alias("key"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text")
    )
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    rows = stage(rows.withColumn("chunk", F.floor(F.col("pos") / CHUNK)), "turns")

    trimmed = F.rtrim(F.col("text"), F.lit(" " + BLANKS))
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    short = rows.select(
        "key",
        "turn",
        "chunk",
        "pos",
        F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(NOT_BLANK)).alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        said.alias("said"),
    )
    again = short.where(~F.col("blank")).groupBy("key", "said").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    again = stage(again.where("n > 1").select("key", "said", "first"), "repeats")
    marked = short.join(again, ["key", "said"], "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    marked = marked.select("key", "turn", "chunk", "pos", "initial", "blank", duplicate.alias("duplicate"), (~F.col("blank") & ~duplicate & F.col("cut")).alias("truncated"))
    marked = stage(marked, "faults")

    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    faults = marked.groupBy("key").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    fault = F.when(F.col("blank") | F.col("duplicate"), REMOVE).when(F.col("truncated"), TRUNCATED).otherwise(FINE)
    coded = marked.select("key", "chunk", "pos", F.concat(initial, fault).alias("code"))
    codes = coded.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("c"))
    charted = codes.select("key", "chunk", F.array_join(F.col("c.code"), "").alias("codes"))
    charted = charted.withColumn("spans", _chart_column(F.col("codes")))
    chained = charted.repartition("key").sortWithinPartitions("key", "chunk")
    decided = stage(chained.mapInArrow(_chain, "key string, chunk long, state int, audit string, cost long, illegal long"), "repairs")

    messages = rows.groupBy("key", "chunk").agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("rows")
    )
    both = messages.join(decided, ["key", "chunk"])
    made = both.withColumn("repaired", _repaired_column(F.col("rows"), F.col("audit"), F.col("state"))).drop("rows", "state")
    return Repair(faults, made)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and audit of each conversation whose chunks stream by in order."""
    import hashlib

    key, audit, digest, lines = None, [], hashlib.sha256(), 0
    out: list = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != key:
                if key is not None:
                    out.append((key, "".join(audit), digest.hexdigest()))
                key, audit, digest, lines = row["key"], [], hashlib.sha256(), 0
            audit.append(row["audit"])
            if row["piece"]:
                digest.update((b"\n" if lines else b"") + row["piece"].encode("utf-8", "surrogatepass"))
                lines += 1
        if out:
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*out)], ["key", "audit", "repaired_sha256"])
            out = []
    if key is not None:
        yield pa.record_batch([pa.array([v]) for v in (key, "".join(audit), digest.hexdigest())], ["key", "audit", "repaired_sha256"])


def summarise(conversations: DataFrame, done: Repair, conv: str = "conv_id") -> DataFrame:
    """One row per conversation id of ``conversations``: its faults, cost, audit and the hash of its repaired text.

    Hashing runs through a conversation's bytes in order, so one task streams
    them, a row per chunk; it holds one Arrow batch and the audit.
    """
    line = F.transform("repaired", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    pieces = done.chunks.select("key", "chunk", "audit", F.array_join(line, "\n").alias("piece"))
    pieces = pieces.repartition("key").sortWithinPartitions("key", "chunk")
    hashed = pieces.mapInArrow(_digests, "key string, audit string, repaired_sha256 string")
    sums = done.chunks.groupBy("key").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    every = conversations.select(F.col(conv).alias("conv_id")).distinct().withColumn("key", _key(F.col("conv_id")))
    joined = every.join(done.faults, "key", "left").join(sums, "key", "left").join(hashed, "key", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        F.col("conv_id").alias(conv),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
