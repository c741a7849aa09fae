import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import ctw
from sieveline.llm.common import table
from sieveline.llm.toxicity import in_fold


def brute(train, text, depth):
    """log10 probability by the definition, on a dictionary of all contexts."""
    counts = Counter()
    for t in train:
        data = b"\n" * depth + ctw.normal_form(ctw.tokens(t))
        for i in range(depth, len(data)):
            for j in range(8):
                node, bit = (1 << j) | (data[i] >> (8 - j)), (data[i] >> (7 - j)) & 1
                for d in range(depth + 1):
                    counts[data[i - d : i], node, bit] += 1
    contexts = {(c, n) for c, n, _ in counts}
    children = {}
    for c, n in contexts:
        if c:
            children.setdefault((c[1:], n), []).append((c, n))
    weight = {}

    def own(k):
        n0, n1 = counts[(*k, 0)], counts[(*k, 1)]
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)

    def below(k):
        return sum(weight[c] for c in children.get(k, []))

    for k in sorted(contexts, key=lambda k: -len(k[0])):
        weight[k] = own(k) if len(k[0]) == depth else np.logaddexp(own(k), below(k)) - math.log(2)
    total = 0.0
    data = b"\n" * depth + ctw.normal_form(ctw.tokens(text))
    for i in range(depth, len(data)):
        for j in range(8):
            node, bit = (1 << j) | (data[i] >> (8 - j)), (data[i] >> (7 - j)) & 1
            p = None
            for d in range(depth, -1, -1):
                k = (data[i - d : i], node)
                pe = (counts[(*k, bit)] + 0.5) / (counts[(*k, 0)] + counts[(*k, 1)] + 1)
                if p is None:
                    p = pe
                else:
                    w = 1 / (1 + math.exp(below(k) - own(k)))
                    p = w * pe + (1 - w) * p
            total += math.log10(p)
    return total


ROWS = [(i, t) for i, t in enumerate(["The cat sat on the mat", "the CAT\t sat", "", None, "dogs bark é 日本", "a cat, a dog", "zq \0 xw"] * 3)]


@pytest.mark.parametrize("depth", [3, 5, 6])
def test_against_the_definition(spark, depth, monkeypatch):
    monkeypatch.setattr(ctw, "SLICE_BYTES", 7)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in ROWS], "doc_id long, text string, score string").repartition(4)
    got = {r.doc_id: r for r in ctw.score_documents(docs, F.col("doc_id") % 7 > 4, depth=depth, chunk_bytes=40).collect()}
    train = [t for i, t in ROWS if i % 7 <= 4]
    for i, t in ROWS:
        assert got[i].score == pytest.approx(brute(train, t, depth), rel=1e-9)
        assert got[i].held_out == (i % 7 > 4)


def test_base_score(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    train = [ctw.tokens(t) + [ctw.END] for i, t in ROWS if i % 7 <= 4]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    for r in ctw.score_documents(docs, F.col("doc_id") % 7 > 4, chunk_bytes=60).collect():
        ws = ctw.tokens(ROWS[r.doc_id][1]) + [ctw.END]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))


def test_probabilities_of_the_next_byte_sum_to_one(spark):
    # All 256 continuations of a context seen in training, as held-out n-grams.
    data = b"\n" * 5 + b"abab abba abab\n"
    codes, n = np.unique(ctw.gram_codes(data, 5), return_counts=True)
    context = int(codes[3]) >> 8
    rows = dict(zip(map(int, codes), map(int, n)))
    for b in range(256):
        rows.setdefault((context << 8) | b, 0)
    model = ctw.learn(spark.createDataFrame(list(rows.items()), "gram long, n long"))
    assert sum(10**r.logp for r in model.collect() if r.gram >> 8 == context) == pytest.approx(1.0)


def test_held_out_texts_of_the_tables(spark):
    r = ctw.score_documents(table(spark, "/root/testdata/sf0.1", "documents"), in_fold("doc_id", 5, 1))
    r = r.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (2**60 + 1, None)], "doc_id long, text string")
    got = ctw.score_documents(docs, in_fold("doc_id", 5, 1)).collect()
    assert sorted((r.doc_id for r in got), key=str) == [2**60 + 1, None, None]
    assert ctw.score_documents(docs.limit(0), F.lit(False)).collect() == []
    assert all(r.train_tokens == 0 and r.score < 0 and r.base_score == 0 for r in ctw.score_documents(docs, F.lit(True)).collect())
