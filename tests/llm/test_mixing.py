import pytest

from sieveline.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, weight string"
POWERS = {"source": 0.5, "lang": 0.5, "topic": 1.0}


def rake_by_hand(cells, targets, sweeps=200):
    w = {k: 1.0 for k in cells}
    for _ in range(sweeps):
        for m, shares in enumerate(targets):
            whole = sum(cells[k] * w[k] for k in cells)
            mass = {}
            for k in cells:
                mass[k[m]] = mass.get(k[m], 0) + cells[k] * w[k]
            w = {k: w[k] * shares[k[m]] / (mass[k[m]] / whole) for k in cells}
    return w


def test_weights_meet_all_marginals(spark):
    docs = [(i, "a b c " * (1 + i % 7) + ("x | y" if i % 5 == 0 else ""), f"s{min(i % 9, 3)}", "en" if i % 3 else "fr") for i in range(300)]
    df = spark.createDataFrame([(*d, "mine") for d in docs], SCHEMA)
    rows = mixing.mix(df, POWERS, 0.4).collect()
    assert {r.weight for r in rows} == {"mine"}
    cells = {}
    for r in rows:
        k = (r.source, r.lang, r.topic)
        cells[k] = cells.get(k, 0) + r.n_tokens
    total = sum(cells.values())
    targets = []
    for m, p in enumerate(POWERS.values()):
        mass = {}
        for k, t in cells.items():
            mass[k[m]] = mass.get(k[m], 0) + t / total
        whole = sum(v**p for v in mass.values())
        targets.append({k: v**p / whole for k, v in mass.items()})
    want = rake_by_hand(cells, targets)
    for r in rows:
        assert r.weight_ == pytest.approx(want[(r.source, r.lang, r.topic)], rel=1e-8)
        assert r.sample_weight is None or r.sample_weight == pytest.approx(r.weight_ / r.probability)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(0.4 * total)
    again = {r.doc_id: r.sampled for r in mixing.mix(df.repartition(5), POWERS, 0.4).collect()}
    assert again == {r.doc_id: r.sampled for r in rows}


def test_nulls_empties_repeats(spark):
    rows = [(1, None, None, None), (1, "", "s", "en"), (None, " a  b\n", "s", "en"), (2, "a b", "s", None), (2, "a b", "s", None)]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    got = mixing.mix(df, POWERS, 1.0).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 2, 2, 2]
    assert [r.weight_ for r in got if r.source is None] == [0.0]
    assert all(r.sampled for r in got if r.n_tokens)
    assert mixing.mix(df.limit(0), POWERS, 0.5).collect() == []


def test_unmet_targets_are_left_out(spark):
    cells = spark.createDataFrame([("a", "x", 3), ("b", "x", 1)], "source string, lang string, tokens long")
    f = mixing.rake(cells, {"source": {"a": 0.5, "b": 0.5, "missing": 1.0}, "lang": {"x": 1.0}})
    assert f["source"]["b"] == pytest.approx(3 * f["source"]["a"]) and "missing" not in f["source"]
