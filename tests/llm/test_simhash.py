import itertools
import random

import pytest

from sieveline.llm import simhash
from sieveline.llm.common import table
from sieveline.llm.components import components

SCHEMA = "doc_id long, text string, fp string"


def brute(rows):
    """{row index: smallest reachable id} by comparing all fingerprints."""
    fps = [simhash.fingerprint(t) & (2**64 - 1) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            parent[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    least = {g: min([k for k in ids if k is not None], default=None) for g, ids in groups.items()}
    return fps, [least[find(i)] for i in range(len(rows))]


def test_against_all_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps, least = brute(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (f"{f:016x}", c) for (k, _), f, c in zip(rows, fps, least)}


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(3, None), (2, ""), (None, " \t"), (9, "One two three four"), (9, "one TWO three\nfour"), (None, "x")]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], SCHEMA)
    got = sorted(simhash.near_duplicates(docs).collect(), key=str)
    _, least = brute(rows)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(2, 2), (3, 2), (9, 9), (9, 9)]
    assert {r.component_id for r in got if r.doc_id is None} == {2, None}
    assert all(r.fingerprint == "0" * 16 for r in got if r.component_id == 2)
    kept = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [2, 9, None] and kept[0].fp == "clash"
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.keep_one(docs.limit(0)).collect() == []


@pytest.mark.parametrize("hot", [0, 3, 64])
@pytest.mark.parametrize("distance", [1, 2])
def test_links_keep_every_connection_at_any_bucket_bound(spark, hot, distance):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(6)]
    fps = set()
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(random.randrange(5)):
                x ^= 1 << random.randrange(64)
            fps.add(x)
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), distance, hot)
    far = [r for r in edges.collect() if bin((r.a ^ r.b) & (2**64 - 1)).count("1") > distance]
    assert not far
    got = {r.node: r.root for r in components(edges).collect()}
    want = {x: x for x in fps}
    for _ in fps:
        changed = False
        for x, y in itertools.combinations(fps, 2):
            if bin((x ^ y) & (2**64 - 1)).count("1") <= distance and want[x] != want[y]:
                want[x] = want[y] = min(want[x], want[y])
                changed = True
        if not changed:
            break
    assert {x: got.get(x, x) for x in fps} == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7), (None, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {7: 7, 5: 5} | {i: 100 for i in range(100, 161)} | {i: 5 for i in range(200, 260)}
