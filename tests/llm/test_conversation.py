import itertools
import random

import pyarrow.parquet as pq
import pytest

pytest.importorskip("sieveline.llm")
from oracle import compare, connect  # noqa: E402

from sieveline.llm import conversation as C  # noqa: E402
from sieveline.llm.queries import ORACLE, QUERIES  # noqa: E402

NAME = "op13_conversation_repair"
LETTERS = [r + f for r in "suax" for f in "012"]


def brute(codes):
    """All edit strings with up to two insertions at a place, the least (cost, audit) that gives legal roles."""
    rows = [codes[i : i + 2] for i in range(0, len(codes), 2)]
    best = None
    gaps = itertools.product(range(3), repeat=len(rows) + 1)
    for inserted, chosen in itertools.product(gaps, itertools.product("KRD", repeat=len(rows))):
        audit = "I" * inserted[0] + "".join(c + "I" * n for c, n in zip(chosen, inserted[1:]))
        at, cost, roles, ok = 0, 0, "", True
        for letter in audit:
            want = "a" if roles.endswith("u") else "u"
            if letter == "I":
                cost, roles = cost + 2, roles + want
                continue
            role, fault = rows[at]
            at += 1
            if letter == "D":
                cost += 3
                continue
            ok = ok and fault != "2"
            cost += fault == "1"
            if letter == "R":
                cost, roles = cost + 2, roles + want
            elif role == want or (role == "s" and not roles):
                roles += role
            else:
                ok = False
        body = roles.removeprefix("s")
        if ok and (not roles or (body and body == "ua" * (len(body) // 2))) and (best is None or (cost, audit) < best):
            best = (cost, audit)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_the_agenda_against_all_edits(n):
    random.seed(n)
    every = ["".join(c) for c in itertools.product(LETTERS, repeat=n)]
    for codes in every if n < 3 else random.sample(every, 60):
        assert C.lightest(codes) == brute(codes), codes


def test_chains_of_chunks_give_the_same():
    random.seed(9)
    weights = {"all": [1] * 12, "removed": [1, 0, 9] * 4, "good": [1, 1, 0, 9, 1, 1, 9, 1, 1, 0, 0, 0]}
    for w in weights.values():
        for _ in range(150):
            n = random.randint(1, 30)
            rows = random.choices(LETTERS, w, k=n)
            chain, steps, at = C.Survivors(), [], 0
            while at < n:
                size = random.randint(1, 6)
                steps += chain.add(at, C.chart("".join(rows[at : at + size])))
                at += size
            steps += chain.end()
            got = (sum(s[3] for s in steps), "".join(s[2] for s in steps))
            assert got == C.lightest("".join(rows))


def test_survivors_hold_little():
    chain = C.Survivors()
    held = 0
    for chunk in range(2000):
        chain.add(chunk, C.chart("u0a0u1x0"))
        held = max(held, sum(len(s) for s in chain.steps.values()))
    assert held < 20


ROWS = [
    (None, None, "user", "no ids."),
    (None, 3, "assistant", "neither here."),
    (1, 0, "system", "Be kind."),
    (1, 1, "user", None),
    (1, 2, None, "who said it?"),
    (1, 2, "assistant", "a tie."),
    (1, 2, "assistant", "a tie."),
    (2, 5, "", "empty role"),
    (2, 9, "User", "upper case initial."),
    (2, 7, "unknown", "an initial of u\n \x0b"),
    (3, 1, "user", " \t\x0b\x0c\r\n"),
    (3, 2, "assistant", " "),
    (3, 3, "user", "emoji \U0001f600!"),
    (4, None, "user", "x" * 50_000 + "."),
]


def write(spark, tmp_path, rows):
    made = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, chunk string, pos int")
    pq.write_table(made.toArrow(), tmp_path / "conversations.parquet", row_group_size=64)
    return str(tmp_path)


@pytest.mark.parametrize("chunk", [1, 2, 256])
def test_nulls_ties_and_clashing_columns(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rows = ROWS + [(c, t, random.Random(c * 40 + t).choice(["user", "assistant", "system"]), f"t{t % 7}.") for c in range(10, 40) for t in range(c % 23)]
    sf_dir = write(spark, tmp_path, rows)
    said, n = compare(QUERIES[NAME](spark, sf_dir), connect(sf_dir), ORACLE[NAME])
    assert said.startswith("ok") and n > 30


def test_a_long_conversation_in_many_partitions(many_partitions, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 16)
    rows = [(7, t, ["user", "assistant"][t % 2], f"message {t % 90}" + "." * (t % 3)) for t in range(400)] + [(8, 0, "user", "hi.")]
    sf_dir = write(many_partitions, tmp_path, rows)
    said, n = compare(QUERIES[NAME](many_partitions, sf_dir), connect(sf_dir), ORACLE[NAME])
    assert said.startswith("ok") and n == 2


def test_messages_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi."), (1, 1, "user", "you there?")], "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in C.repair(df).messages().orderBy("chunk", "at").select("role", "text").collect()]
    assert got == [("user", "hi."), ("assistant", "you there?")]
    empty = df.limit(0)
    assert C.summarise(empty, C.repair(C.damage(empty))).count() == 0
