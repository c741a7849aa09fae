import itertools

import corpus_pipeline as P
import pytest

from sieveline.llm import copies as S
from sieveline.llm import simhash
from sieveline.llm.common import table


def plain(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def alike(a, b):
    return bool(a) and len(a & b) >= 0.8 * len(a | b)


def tied(sets):
    """{key: smallest key reachable} by comparing all pairs."""
    group = {k: k for k in sets}
    edges = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if alike(sets[a], sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return group


def test_the_stage_leaves_no_similar_pair(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    before = simhash.keep_one(docs).collect()
    stage = dict(P.STAGES)["near duplicates"]
    kept = {tuple(r) for r in stage(spark, docs, "").collect()}
    group = tied({r.doc_id: plain(r.text) for r in before})
    assert kept == {tuple(r) for r in before if group[r.doc_id] == r.doc_id} and len(before) - len(kept) == 5


def test_chains_nulls_and_a_large_class(spark):
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join([*words[i:], *(f"x{j}" for j in range(i))]) for i in range(0, 24, 3)]
    large = [" ".join([*(f"y{i}" for i in range(80)), f"z{n}"]) for n in range(40)]
    texts = [*chain, *large, None, "", "one two", "One  TWO", " ".join(words[::-1])]
    rows = [(100 - i, t, "x") for i, t in enumerate(texts)] + [(None, large[0] + " end", "y"), (None, "a b c d e f", "z"), (100, chain[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number string")
    got = S.keep_one(docs).collect()
    group = tied({k: plain(t) for k, t, _ in rows if k is not None})
    # Texts without words are one class; rows of one id and text are one.
    want = {(k, t or "") for k, t, _ in rows if k is not None and group[k] == k}
    want -= {(k, "") for k, t, _ in rows if not t and k != min(k for k, t, _ in rows if not t)}
    assert sorted((r.doc_id, r.text or "") for r in got if r.doc_id) == sorted(want)
    assert [r.text for r in got if r.doc_id is None] == ["a b c d e f"]
    assert S.keep_one(docs.limit(0)).collect() == []


INNER = "id words root first key dropped fp s n node made num fingerprint component _id _fp _group _key bucket a b low high".split()


@pytest.mark.parametrize("keep", [S.keep_one, simhash.keep_one])
def test_columns_of_inner_names(spark, keep):
    docs = spark.createDataFrame(
        [(i, "one text of six words here", *[f"{c}{i}" for c in INNER]) for i in range(3)] + [(9, "another one", *INNER)],
        ["doc_id", "text", *INNER],
    )
    got = sorted(tuple(r) for r in keep(docs).collect())
    assert got == sorted(tuple(r) for r in docs.where("doc_id in (0, 9)").collect())
