import corpus_pipeline as P
from pyspark.sql import functions as F

from sieveline.llm import mixing, simhash, toxicity
from sieveline.llm.common import table
from sieveline.llm.queries import MIX_POWERS, MIX_SEED, MIX_SHARE

SF = "/root/testdata/sf0.01"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_every_stage_decides_as_a_plain_loop_does(spark):
    docs = table(spark, SF, "documents")
    before = docs.collect()
    labels = table(spark, SF, "labels")

    kept = P.drop_toxic(spark, docs, SF)
    grammar = toxicity.fit_grammar(docs, labels.where(~toxicity.in_fold("doc_id", 3, 1)))
    want = [r for r in before if grammar.score(r.text) < toxicity.THRESHOLD]
    assert rows(kept) == set(map(tuple, want)) and len(want) < len(before)

    kept = simhash.keep_one(docs)
    prints = {r.doc_id: simhash.fingerprint(r.text) & (2**64 - 1) for r in before}
    group = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if group[a] < group[b] and bin(prints[a] ^ prints[b]).count("1") <= 2:
                    group[b], changed = group[a], True
    assert rows(kept) == {tuple(r) for r in before if group[r.doc_id] == r.doc_id}

    kept = P.drop_contaminated(spark, docs, SF)
    items = [" ".join(t.text.split()).lower() for t in table(spark, SF, "benchmark").collect()]
    holds = {r.doc_id for r in before if any(i in " ".join(r.text.split()).lower() for i in items)}
    left = {r.doc_id for r in kept.collect()}
    assert holds and not holds & left and len(left) > len(before) - 1.5 * len(holds) - 3

    masked = {r.doc_id: r for r in P.mask_secrets(spark, docs, SF).collect()}
    told = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit('token = "([0-9a-f]{40})"'), 1).alias("s")).collect()
    assert set(masked) == set(prints) and any(r.s for r in told)
    for r in told:
        assert not any(s in masked[r.doc_id].text.lower() for s in r.s)
    assert all(masked[r.doc_id].text == r.text for r, t in zip(before, told) if r.doc_id == t.doc_id and not t.s)

    mixed = P.sample_mix(spark, docs, SF)
    drawn = mixing.mix(docs, MIX_POWERS, MIX_SHARE, MIX_SEED).where("sampled")
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in drawn.collect()}


def test_run_and_columns(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for _, apply in P.STAGES[:-1]:
        assert apply(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.columns[: len(docs.columns)] == docs.columns
    n, ids = got.count(), got.select("doc_id").distinct().count()
    assert 0 < n == ids < docs.count()
