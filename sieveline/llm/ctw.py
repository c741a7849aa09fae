"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. For each prefix of decisions and each context
of up to ``DEPTH`` bytes a Krichevsky-Trofimov estimator counts training bits,
and the weighted mixture over all prunings of the context tree gives the
probability of a bit. The model is a Spark table from (context, byte) to log
probability; no task and no driver holds it whole.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import stage

DEPTH = 5
#: Contexts of this many bytes divide the tree among tasks; shorter ones are at most 256 ** 1 * 255 nodes.
SPLIT = 2
#: Text bytes that one task scores at a time.
CHUNK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
#: A chunk's n-grams travel in so many packed rows, and its words in as many; a prime.
BUCKETS = 127
#: Chunks whose packed rows of a bucket one task holds.
GROUP_CHUNKS = 1024
END = b"\n"

_TABLE = 256
_GAMMA_HALF = np.array([math.lgamma(i + 0.5) for i in range(_TABLE)])
_GAMMA_ONE = np.array([math.lgamma(i + 1.0) for i in range(_TABLE)])


def tokens(text: str | None) -> list[bytes]:
    """Words without ASCII blanks, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def normal_form(words: Sequence[bytes]) -> bytes:
    """What is scored: the words with one blank between, then the end mark. It holds no other end mark."""
    return b" ".join(words) + END


def _log_gamma(n: np.ndarray, shift: float, table: np.ndarray) -> np.ndarray:
    """log Gamma(n + shift) for whole n: a table for small ones, Stirling's series above."""
    x = np.maximum(n, _TABLE) + shift
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _TABLE, table[np.minimum(n, _TABLE - 1).astype(np.int64)], series)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to any order of n0 zeros and n1 ones."""
    half = _log_gamma(n0, 0.5, _GAMMA_HALF) + _log_gamma(n1, 0.5, _GAMMA_HALF)
    return half - math.log(math.pi) - _log_gamma(n0 + n1, 1.0, _GAMMA_ONE)


def _share(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Posterior weight of a node's own estimate against its children's."""
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def gram_codes(data: bytes, depth: int) -> np.ndarray:
    """(context, byte) of each position from ``depth`` on as a number, the oldest byte first."""
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    out = np.zeros(max(0, len(a) - depth), np.int64)
    for k in range(depth + 1):
        out = (out << 8) | a[k : len(a) - depth + k]
    return out


def _slices(texts: Sequence[bytes], depth: int) -> Iterator[list[tuple[int, bytes]]]:
    """Batches of (number of a text, piece of it with its context), of bounded size.

    A text longer than a piece is cut with its context repeated, so positions
    are the same whatever the pieces; a cut text appears in several.
    """
    pad = END * depth
    batch, size = [], 0
    for number, text in enumerate(texts):
        padded = pad + text
        for at in range(0, len(text), SLICE_BYTES):
            piece = padded[at : at + depth + SLICE_BYTES]
            if size and size + len(piece) > SLICE_BYTES:
                yield batch
                batch, size = [], 0
            batch.append((number, piece))
            size += len(piece)
    if batch:
        yield batch


def _codes(batch: list[tuple[int, bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the scored positions, first of each piece, number of its text)."""
    codes = gram_codes(b"".join(p for _, p in batch), depth)
    lengths = np.array([len(p) for _, p in batch])
    starts = np.cumsum(lengths) - lengths
    keep = np.ones(len(codes) + depth, bool)
    keep[(starts[:, None] + np.arange(depth)).ravel()] = False
    codes = codes[keep[depth:]]
    firsts = np.cumsum(lengths - depth) - (lengths - depth)
    return codes, firsts, np.array([n for n, _ in batch])


def _count_chunk(depth: int):
    def count(part: pd.DataFrame) -> pd.DataFrame:
        """Distinct n-grams and words of a chunk with their training counts; 0 where only held-out texts have them."""
        words, grams, seen = Counter(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for train in (True, False):
            forms = []
            for text in part["text"][part["train"] == train]:
                ws = tokens(text)
                words.update(ws) if train else words.update(dict.fromkeys(ws, 0))
                forms.append(normal_form(ws))
            for batch in _slices(forms, depth):
                made, n = np.unique(_codes(batch, depth)[0], return_counts=True)
                both = np.concatenate([grams, made])
                n = np.concatenate([seen, n if train else np.zeros(len(n), np.int64)])
                grams, at = np.unique(both, return_inverse=True)
                seen = np.bincount(at, n, minlength=len(grams)).astype(np.int64)
            words[END] += len(forms) if train else 0
        chunk = int(part["chunk"].iloc[0])
        return pd.DataFrame([(chunk, *r) for r in [*_pack_grams(grams, seen), *_pack_words(words)]], columns=["chunk", "bucket", "keys", "n"])

    return count


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def _numbers(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _pack_grams(grams: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, keys, counts): sorted n-grams by remainder, as differences."""
    bucket = grams % BUCKETS
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            yield int(bucket[part[0]]), _squeeze(np.diff(grams[part], prepend=0)), _squeeze(n[part])


def _pack_words(words: Counter) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, keys, counts) of words by remainder of their checksum; a word holds no blank."""
    parts: dict[int, list[bytes]] = {}
    for w in words:
        parts.setdefault(BUCKETS + zlib.crc32(w) % BUCKETS, []).append(w)
    for bucket, ws in parts.items():
        yield bucket, zstandard.compress(b" ".join(ws), 1), _squeeze(np.fromiter((words[w] for w in ws), np.int64, len(ws)))


def _gram_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, "int64"))


def _word_keys(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b" ")


def _merge_bucket(part: pd.DataFrame) -> pd.DataFrame:
    """Counts of a bucket summed over the chunks of a group, a row per n-gram or word."""
    if part["bucket"].iloc[0] < BUCKETS:
        keys, n = np.concatenate([_gram_keys(k) for k in part["keys"]]), np.concatenate([_numbers(c, "int64") for c in part["n"]])
        grams, at = np.unique(keys, return_inverse=True)
        return pd.DataFrame({"gram": grams, "word": "", "n": np.bincount(at, n, minlength=len(grams)).astype(np.int64)})
    words = Counter()
    for keys, n in zip(part["keys"], part["n"]):
        for w, c in zip(_word_keys(keys), _numbers(n, "int64").tolist()):
            words[w] += c
    return pd.DataFrame({"gram": -1, "word": [w.decode("utf-8", "surrogatepass") for w in words], "n": list(words.values())})


def _answer_bucket(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    """The chunks' packed rows of a bucket with the value of each of their keys."""
    if not len(asked):
        return pd.DataFrame({"chunk": [], "bucket": [], "keys": [], "values": []})
    if asked["bucket"].iloc[0] < BUCKETS:
        grams, values = table["gram"].to_numpy(), table["value"].to_numpy()
        order = np.argsort(grams)
        grams, values = grams[order], values[order]
        found = [values[np.searchsorted(grams, _gram_keys(k))] for k in asked["keys"]]
    else:
        value = {w.encode("utf-8", "surrogatepass"): v for w, v in zip(table["word"], table["value"])}
        found = [np.array([value[w] for w in _word_keys(k)]) for k in asked["keys"]]
    return asked[["chunk", "bucket", "keys"]].assign(values=[_squeeze(v) for v in found])


def _mix_branch(depth: int):
    def mix(part: pd.DataFrame) -> pd.DataFrame:
        """Mixtures below one context of ``SPLIT`` bytes: a probability per n-gram and decision, and the branch's nodes."""
        gram, n = part["gram"].to_numpy(), part["n"].to_numpy(dtype=np.float64)
        byte, columns, nodes = gram & 255, {}, []
        for j in range(8):
            bit = (byte >> (7 - j)) & 1
            node = (1 << j) | (byte >> (8 - j))
            at, first, zeros, ones = {}, {}, {}, {}
            for d in range(SPLIT, depth + 1):
                key = (((gram >> 8) & ((1 << 8 * d) - 1)) << 8) | node
                _, first[d], at[d] = np.unique(key, return_index=True, return_inverse=True)
                ones[d] = np.bincount(at[d], n * bit)
                zeros[d] = np.bincount(at[d], n * (1 - bit))
            weight, share = log_kt(zeros[depth], ones[depth]), {}
            for d in range(depth - 1, SPLIT - 1, -1):
                below = np.bincount(at[d][first[d + 1]], weight, minlength=len(first[d]))
                own = log_kt(zeros[d], ones[d])
                share[d], weight = _share(own, below), np.logaddexp(own, below) - math.log(2)
            p = None
            for d in range(depth, SPLIT - 1, -1):
                hit = np.where(bit == 1, ones[d][at[d]], zeros[d][at[d]])
                own = (hit + 0.5) / ((zeros[d] + ones[d])[at[d]] + 1)
                p = own if p is None else share[d][at[d]] * own + (1 - share[d][at[d]]) * p
            columns[f"p{j}"] = p
            top = first[SPLIT]
            nodes.append(
                pd.DataFrame(
                    {"gram": -1, "last": (gram[top] >> 8) & 255, "node": node[top], "zeros": zeros[SPLIT], "ones": ones[SPLIT], "weight": weight}
                )
            )
        out = pd.concat([pd.DataFrame({"gram": gram, **columns}), *nodes], ignore_index=True)
        return out.reindex(columns=MIXED).fillna(0.0).astype({"gram": "int64", "last": "int32", "node": "int32"})

    return mix


MIXED = ["gram", *(f"p{j}" for j in range(8)), "last", "node", "zeros", "ones", "weight"]
MIXED_SCHEMA = "gram long, " + ", ".join(f"p{j} double" for j in range(8)) + ", last int, node int, zeros double, ones double, weight double"


def learn(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, logp): log10 probability of every n-gram's byte after its context, from (gram, n).

    The tree is cut into branches by the last two bytes of a context, each
    mixed in one task from counts that were summed before; the hottest pair
    has a few hundredths of a natural text's n-grams. What remains above, 256
    contexts of one byte and the empty one, comes to the driver: 65,536 rows
    at most, whatever the corpus.
    """
    branch = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    mixed = stage(counts.groupBy(branch.alias("branch")).applyInPandas(_mix_branch(depth), MIXED_SCHEMA), "ctw")
    rows = mixed.where("gram < 0").groupBy("last", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weight"))).collect()
    zeros, ones, below = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        zeros[r["last"], r.node], ones[r["last"], r.node], below[r["last"], r.node] = r.zeros, r.ones, r.weight
    own = log_kt(zeros, ones)
    share1 = _share(own, below)
    weight = np.logaddexp(own, below) - math.log(2)
    share0 = _share(log_kt(zeros.sum(0), ones.sum(0)), weight.sum(0))
    one1 = (ones + 0.5) / (zeros + ones + 1)
    one0 = (ones.sum(0) + 0.5) / (zeros.sum(0) + ones.sum(0) + 1)

    def finish(parts):
        for part in parts:
            gram = part["gram"].to_numpy()
            byte, last, total = gram & 255, (gram >> 8) & 255, np.zeros(len(gram))
            for j in range(8):
                bit, node = (byte >> (7 - j)) & 1, (1 << j) | (byte >> (8 - j))
                p = part[f"p{j}"].to_numpy()
                p1 = np.where(bit == 1, one1[last, node], 1 - one1[last, node])
                p = share1[last, node] * p1 + (1 - share1[last, node]) * p
                p0 = np.where(bit == 1, one0[node], 1 - one0[node])
                total += np.log10(share0[node] * p0 + (1 - share0[node]) * p)
            yield pd.DataFrame({"gram": gram, "logp": total})

    return mixed.where("gram >= 0").select("gram", *(f"p{j}" for j in range(8))).mapInPandas(finish, "gram long, logp double")


def _score_chunk(depth: int, n_train: int, n_words: int):
    floor = n_train + 0.5 * (n_words + 1)

    def score(docs: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        """Scores of a chunk's texts from the n-grams and words that occur in it."""
        is_gram = table["bucket"].to_numpy() < BUCKETS
        of_grams, of_words = table[is_gram], table[~is_gram]
        grams = np.concatenate([_gram_keys(k) for k in of_grams["keys"]])
        logp = np.concatenate([_numbers(v, "float64") for v in of_grams["values"]])
        order = np.argsort(grams)
        grams, logp = grams[order], logp[order]
        known = {}
        for keys, values in zip(of_words["keys"], of_words["values"]):
            known.update((w, c) for w, c in zip(_word_keys(keys), _numbers(values, "float64").tolist()) if c > 0)
        value = {w: math.log10((c + 0.5) / floor) for w, c in known.items()}
        new = math.log10(0.5 / floor)
        rows, forms = [], []
        for text in docs["text"]:
            ws = tokens(text)
            form = normal_form(ws)
            ws.append(END)
            found = [value[w] for w in ws if w in value]
            rows.append((len(ws), len(found), math.fsum(found) + new * (len(ws) - len(found)), len(form)))
            forms.append(form)
        totals = np.zeros(len(forms))
        for batch in _slices(forms, depth):
            codes, firsts, numbers = _codes(batch, depth)
            np.add.at(totals, numbers, np.add.reduceat(logp[np.searchsorted(grams, codes)], firsts))
        out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base_score", "n_bytes"])
        return out.assign(id=docs["id"].to_numpy(), held_out=~docs["train"].to_numpy(dtype=bool), score=totals)

    return score


SCORES = "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def score_documents(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    The model learns from all rows that are not ``held_out``, and scores all.
    ``score`` is the log10 probability of a text's normal form, end included;
    ``base_score`` is that of its tokens under a smoothed word count. A null
    text is empty and consists of its end. Null ids and repeated rows are
    scored as they are, other columns are ignored, an empty table gives an
    empty result. ``depth`` is 3 to 6.

    Texts are dealt to chunks of about ``chunk_bytes`` by a hash of the row, so
    no source or group of copies fills one; only fully repeated rows meet. A
    chunk is first reduced to its distinct n-grams and words, packed into a few
    rows by remainder. Counts and the model are tables keyed by n-gram or word;
    a bucket of them meets the chunks' rows of that bucket, a group of chunks
    at a time, and sends back just the entries that occur in a chunk.
    """
    if not SPLIT < depth <= 6:
        raise ValueError("depth must be 3 to 6")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = max(1, -(-int(size) // chunk_bytes))
    kind = docs.schema[id_col].dataType
    train = ~F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), train.alias("train"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    group = F.floor(F.col("chunk") / GROUP_CHUNKS).cast("int")
    seen = rows.groupBy("chunk").applyInPandas(_count_chunk(depth), "chunk int, bucket int, keys binary, n binary")
    seen = stage(seen.withColumn("part", group), "ctw")

    counts = seen.groupBy("bucket", "part").applyInPandas(_merge_bucket, "gram long, word string, n long")
    counts = stage(counts.groupBy("gram", "word").agg(F.sum("n").alias("n")), "ctw")
    total = counts.where("gram < 0 and n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_train, n_words = int(total.n or 0), int(total.v)

    model = learn(counts.where("gram >= 0").select("gram", "n"), depth).select(
        (F.col("gram") % BUCKETS).cast("int").alias("bucket"), "gram", F.lit("").alias("word"), F.col("logp").alias("value")
    )
    known = counts.where("gram < 0").select(
        (BUCKETS + F.crc32("word") % BUCKETS).cast("int").alias("bucket"), "gram", "word", F.col("n").cast("double").alias("value")
    )
    # One copy of the model for each group of chunks.
    parts = F.explode(F.sequence(F.lit(0), F.lit((chunks - 1) // GROUP_CHUNKS))).alias("part")
    table = model.unionByName(known).select("*", parts)
    asked = seen.groupBy("bucket", "part").cogroup(table.groupBy("bucket", "part"))
    table = asked.applyInPandas(_answer_bucket, "chunk int, bucket int, keys binary, values binary")
    scored = rows.groupBy("chunk").cogroup(table.groupBy("chunk")).applyInPandas(_score_chunk(depth, n_train, n_words), SCORES)
    return scored.select(
        F.col("id").cast(kind).alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
