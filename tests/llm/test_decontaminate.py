import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import decontaminate as D

ITEM = "Which of the seven rivers crosses the northern plain before it meets the grey salt lake near Orrun?"


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            s = D.MATCH if a[i] == b[j] else D.MISMATCH
            h[i + 1, j + 1] = max(0, h[i, j] + s, h[i, j + 1] + D.GAP, h[i + 1, j] + D.GAP)
    return int(h.max())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(0, 4), max_size=14))
def test_alignment_against_the_full_table(a, b):
    score, start, end = D.align(np.array(a, np.int64), np.array(b, np.int64))
    assert score == smith_waterman(a, b)
    if score:
        assert smith_waterman(a, b[start:end]) == score


def test_exact_edited_partial_and_clean(spark):
    random.seed(3)
    noise = lambda n: " ".join(random.choice("the of in a lake plain rivers it salt near".split()) for _ in range(n))
    edited = ITEM.replace("seven", "eight").replace("grey ", "").replace("before", "long before")
    texts = [noise(40) + " " + ITEM + noise(30), noise(500) + " " + edited.upper() + " " + noise(5), noise(900), None, "", ITEM[:30]]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "of the"), (None, "")], "item_id long, text string")
    got = D.find_copies(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 7), (0, 7), (1, 7)]
    assert {r.first_word for r in got} == {40, 500} and max(r.score for r in got) == 1.0
    assert sorted(r.doc_id for r in D.decontaminate(docs, bench).collect()) == [2, 3, 4, 5]
    assert D.find_copies(docs.limit(0), bench).collect() == [] and D.find_copies(docs, bench.limit(0)).collect() == []
    assert D.decontaminate(docs, bench.limit(0)).count() == 7


def test_an_item_in_most_documents_keeps_its_seeds(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 20 + (ITEM if i % 3 else "")) for i in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert {r.doc_id for r in D.find_copies(docs, bench).collect()} == {i for i in range(60) if i % 3}


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    items = [f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, "x y z " + items[i] + " end") for i in range(12)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_WORDS", 20)
    assert sorted((r.doc_id, r.item_id) for r in D.find_copies(docs, bench).collect()) == [(i, i) for i in range(12)]


def test_edited_copies_of_a_frequent_item_are_all_found(spark):
    random.seed(1)
    words = D.words_of(ITEM)[:15]
    edit = lambda: " ".join(random.choice(["foo", "bar", "baz", "qux"]) if random.random() < 0.25 else w for w in words)
    texts = [f"start{i} {edit()} end" for i in range(300)]
    ids = {w: i + 1 for i, w in enumerate(words)}
    item = [ids[w] for w in words]
    scores = [smith_waterman(item, [ids.get(w, 0) for w in t.split()]) for t in texts]
    want = {i for i, s in enumerate(scores) if s >= D.MIN_SCORE * D.MATCH * len(item)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r.score for r in D.find_copies(docs, bench).collect()}
    assert got == {i: scores[i] / (D.MATCH * len(item)) for i in want} and 200 < len(want) < 300
    assert {r.doc_id for r in D.decontaminate(docs, bench).collect()} == set(range(300)) - want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), min_size=1, max_size=14))
def test_no_passage_that_scores_is_passed_over(a, b):
    seeds = D.Items(["one two three four"]).seeds()
    assert seeds.can_reach(np.array(a, np.int64), np.array(b, np.int64), smith_waterman(a, b))
