import itertools
import random

import numpy as np
import pytest

pytest.importorskip("sieveline.llm")
from sieveline.llm import setsketch as K  # noqa: E402


def plain(text, words=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()


def classes(rows):
    """{position: (set size, smallest id reachable)} by comparing all pairs."""
    sets = [plain(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and 5 * len(a & b) >= 4 * len(a | b):
            group[top(j)] = top(i)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(ids) if ids else None))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, node string, n int")
    got = K.near_duplicates(docs.repartition(3)).collect()
    by = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=by) == sorted(classes(rows), key=by)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def test_chains_copies_nulls_and_repeats(spark):
    words = [f"w{i}" for i in range(90)]
    chain = [" ".join([*words[i:], *(f"x{j}" for j in range(i))]) for i in range(0, 32, 4)]
    exact = [" ".join(words[:52]), " ".join(words[:52]).upper(), "  ".join(words[4:52])]
    texts = [*chain, *exact, None, None, "", " \t", "one two", "One\x0bTWO", "one two three", "é ü", "É ü", " ".join(words[::-1])]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    rows += [(None, chain[0]), (None, "alone by itself is this"), (None, None), (7, chain[3]), (7, chain[3]), (7, "other words of the same id")]
    check(spark, rows)
    assert K.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_large_class_and_long_texts(spark):
    rng = random.Random(4)
    base = [f"b{rng.randrange(500)}" for _ in range(120)]
    rows = [(i, edited(rng, base, rng.randrange(5))) for i in range(120)]
    long = [f"l{rng.randrange(10**6)}" for _ in range(30_000)]
    rows += [(500, " ".join(long)), (501, edited(rng, long, 900)), (502, edited(rng, long, 2500))]
    check(spark, rows)


@pytest.mark.parametrize("turns", [0, 2])
def test_a_crowd_below_the_bound(spark, monkeypatch, turns):
    """Templated texts that aren't links meet far less often than in pairs, and a linked pair among them is found."""
    monkeypatch.setattr(K, "STAR_ROUNDS", turns)
    common = [f"c{i}" for i in range(300)]
    texts = [" ".join([*common[:260], *(f"v{i}-{j}" for j in range(100))]) for i in range(500)]
    texts.append(" ".join(texts[17].split()[:-8]))
    rows = list(enumerate(texts))
    seen = []
    real = K._couples

    def counted(*a):
        made = real(*a)
        seen.append(made.distinct().count())
        return made

    monkeypatch.setattr(K, "_couples", counted)
    got = {r.doc_id: r.component_id for r in K.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[500] == 17 and sum(k != v for k, v in got.items()) == 1
    assert sum(seen) < 0.5 * 500 * 499 / 2, seen


def test_edits_that_few_share_rule_pairs_out(spark):
    """Texts whose every edit is in another, too, hold nothing alone; what they lack keeps them apart, and no link is lost."""
    rng = random.Random(9)
    base, n = [f"b{i}" for i in range(300)], 60
    edits = [{rng.randrange(300): f"e{i}-{j}" for j in range(10)} for i in range(n)]
    texts = [" ".join((edits[i] | edits[(i + 1) % n]).get(at, w) for at, w in enumerate(base)) for i in range(n)]
    texts += [texts[5].replace("b150", "other"), " ".join(base), " ".join(base[:270])]
    sets = [plain(t) for t in texts]
    held = spark.createDataFrame(list(enumerate(texts)), "num long, text string")
    rows = spark.createDataFrame([(1, i, len(s), 0, None, i) for i, s in enumerate(sets)], "bucket long, num long, n long, alone long, parts array<smallint>, root long")
    got = {(r.a, r.b) for r in K._couples(K._with_alone(rows, held, 80, 4), 80).collect()}
    linked = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert (5, n) in linked and (n + 1, n + 2) in linked and linked <= got
    assert len(got) < 0.1 * len(sets) ** 2 / 2, len(got)


def test_part_counts_leave_out_what_is_alone_and_very_large_sets():
    text = " ".join(f"w{i}" for i in range(100))
    made = K.shingles(text, 4)
    assert K.shared_counts(text, None, 4).sum() == 97
    assert K.shared_counts(text, made[:30].view(np.int64), 4).sum() == 67
    assert K.shared_counts(" ".join(map(str, range(2**15 + 3))), None, 4) is None


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    numbers = rng.integers(0, 2**64, 30_000, dtype=np.uint64)
    a, b = numbers[:20_000], numbers[4_000:24_000]
    x, y = K.registers(a), K.registers(b)
    assert (K.merge(x, y) == K.registers(np.union1d(a, b))).all()
    assert K.cardinality(x) == pytest.approx(20_000, rel=0.3) and K.cardinality(K.registers(a[:0])) == 0
    got = K.estimate(np.array([20_000.0]), np.array([20_000.0]), np.array([(x > y).sum()]), np.array([(x < y).sum()]))
    assert got[0] == pytest.approx(16_000 / 24_000, abs=0.12)
    assert (K.registers(a[:1]) > 0).all()


def test_the_estimate_is_the_likeliest():
    rng = np.random.default_rng(3)
    n_a, n_b = rng.integers(50, 100, 40).astype(float), rng.integers(50, 100, 40).astype(float)
    larger, smaller = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    got = K.estimate(n_a, n_b, larger, smaller)
    u = n_a / (n_a + n_b)
    grid = np.linspace(0, 1, 2001)[:, None] * (np.minimum(n_a, n_b) / np.maximum(n_a, n_b))
    best = K.log_likelihood(grid, u, larger, smaller).max(axis=0)
    assert (K.log_likelihood(got, u, larger, smaller) >= best - 1e-6).all()


def test_pairs_at_the_bound_share_a_band_and_pass_the_likelihood():
    rng = np.random.default_rng(8)
    met = passed = 0
    for _ in range(1500):
        n = int(rng.integers(10, 400))
        part = rng.integers(0, 2**64, n * 10, dtype=np.uint64)
        a, b = part[: 9 * n], part[n:]  # 8 n of 10 n
        x, y = K.registers(a), K.registers(b)
        met += (x == y).reshape(K.BANDS, K.ROWS).all(axis=1).any()
        passed += K.plausible(np.array([len(a)], float), np.array([len(b)], float), x[None], y[None])[0]
    assert met >= 1499 and passed == 1500
