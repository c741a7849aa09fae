import random

import pytest
from pyspark.sql import functions as F

from sieveline.llm import toxicity as T
from sieveline.llm.common import table

GRAMMAR = T.Grammar({"idiot": 3.0, "vequ*": 4.0})


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("You are an idiot", ["targeted"]),
        ("you IDIOT!", ["targeted"]),
        ("not an idiot", ["negated"]),
        ("not. idiot", ["plain"]),
        ('he said idiot. "vequai"', ["reported", "reported"]),
        ("I will kill you", ["threat"]),
        ("I will not kill you", []),
        ("vequ vequor veque, ve", ["plain"] * 3),
        ('he said "you are an idiot"', ["reported"]),
        ('"you are an idiot" he said', ["reported"]),
        ("you are not an idiot", ["negated"]),
        ("he wrote that he will kill you", []),
        ("", []),
        (None, []),
    ],
)
def test_clauses(text, kinds):
    assert [k for _, k, _, _ in GRAMMAR.matches(text)] == kinds


def test_direct_clauses_score_above_denied_and_reported_ones():
    grammar = T.Grammar({"idiot": 3.0}, (-4.0, 0.5, 0.2, 0.3))
    direct, bare, reported, denied = map(
        grammar.score, ("You are an idiot.", "What an idiot.", 'She said "you are an idiot".', "You are not an idiot.")
    )
    assert direct > bare > reported > denied > grammar.score("You are kind.")
    assert grammar.score("I will kill you.") > bare > grammar.score("I will not kill you.")


def test_later_words_of_a_stem_weigh_by_their_own_form():
    grammar = T.Grammar({"vequ*3": 5.0, "vequ*": 1.0, "other": 2.0})
    assert [w for *_, w in grammar.matches("vequa x vequo. vequi vequa")] == [1.0, 1.0, 5.0, 5.0]
    assert grammar.matches("you other")[0][1:] == ("targeted", "other", 2.5)


def test_the_composition_reads_as_its_parts_do():
    machines = [T.near("N"), T.near("P"), T.near("T"), T.since("R"), T.inside("Q")]
    start, arcs = T.compose(*machines)
    rng = random.Random(1)
    for _ in range(200):
        word = rng.choices(T.SYMBOLS, k=12)
        whole, parts = start, [m[0] for m in machines]
        for i, s in enumerate(word):
            whole, said = arcs[whole, s]
            alone = [m[1][q, s] for m, q in zip(machines, parts)]
            parts = [q for q, _ in alone]
            assert said == tuple(o for _, o in alone)
            back = word[max(0, i - T.REACH) : i]
            assert said == ("N" in back, "P" in back, "T" in back, "R" in word[:i], word[:i].count("Q") % 2 == 1)


def test_learned_from_labels_alone(spark):
    rows = [(i, f"plain words number{i % 7} " * 8 + ("grompt" + "abcdef"[i % 6] * (i % 3 + 1) if i % 9 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = T.score_documents(docs, labels).collect()
    assert len(got) == 600 and any(r.held_out for r in got)
    assert all(r.predicted == int(r.doc_id % 9 == 0) for r in got)


def test_held_out_accuracy_on_the_tables(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = table(spark, sf_dir, "labels")
    got = T.score_documents(table(spark, sf_dir, "documents"), labels).join(labels, "doc_id").where("held_out")
    r = got.agg(
        F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"),
        F.sum(F.col("predicted") * F.col("toxic")).alias("tp"),
        F.sum("toxic").alias("p"),
    ).first()
    # Some texts labelled toxic there hold no toxic word at all.
    assert r.right > 0.985 and r.tp / r.p > 0.88


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, None), (1, None), (None, "x"), (2, "")], schema)
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    got = T.score_documents(docs, labels).collect()
    assert len(got) == 4 and {(r.score, r.predicted) for r in got} == {(0.5, 0)}
    assert T.score_documents(docs.limit(0), labels.limit(0)).collect() == []
