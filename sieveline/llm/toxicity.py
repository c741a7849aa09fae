"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer turns words into weighted symbols (insult, threat, target,
negation, report, quotation mark). Five clause transducers read the symbols and
say for each what acts on it; their composition tells the kind of a match, which
weighs the word. A logistic model learned from labels turns the matches of a
text into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import stage

#: Labelled rows a model is fitted on at most; the lowest hashes of their ids are taken.
FIT_ROWS = 20_000
#: Insult patterns a grammar keeps at most, by strength of evidence: a bound on the model, far above what rows in the thousands attest.
LEXICON = 20_000
#: Least likelihood-ratio statistic of a pattern, about one false pattern in 30,000 tried.
LEAST_EVIDENCE = 17.0
#: Log odds below this are chance; weights count from here.
ODDS_FLOOR = 1.5
STEMS = range(4, 9)
REACH = 3  # words over which a negation, target or threat acts
THRESHOLD = 0.7

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
SYMBOL = re.compile(r"[^\W\d_]+|[\"«»“”„]")

# --- fixed values: closed word classes of the grammar, by language ------------
TARGETS = frozenset(
    "you your yours yourself u they them their he him his she her these those "
    "du dich dir dein ihr euch sie ihn tu te toi ton vous votre ils eux elle tú ti tu usted ustedes ellos".split()
)
NEGATIONS = frozenset(
    "not no never none neither nor without isn aren wasn don doesn nicht kein keine nie niemals ohne "
    "pas jamais non aucun sans no nunca jamás sin ningún".split()
)
REPORTS = frozenset(
    "said says say wrote writes quoted quote reported called claims claimed alleged sagte sagt schrieb nannte "
    "dit disait écrit appelé dijo dice escribió llamó".split()
)
THREATS = frozenset(
    "kill kills hurt destroy shoot beat burn stab töten umbringen zerstören tuer détruire frapper matar destruir golpear".split()
)
QUOTES = frozenset("\"«»“”„")

#: Words with a part of their own in a clause; they are no insults.
CLOSED = TARGETS | NEGATIONS | REPORTS | THREATS

#: What a match of each kind weighs against a bare insult: aimed ones more, denied and reported ones less.
KIND_WEIGHTS = {"plain": 1.0, "targeted": 1.25, "negated": 0.25, "reported": 0.4, "threat": 1.25}
KINDS = tuple(KIND_WEIGHTS)
#: The weight of a threat word, which needs a target near it; about that of a well attested insult.
THREAT_WEIGHT = 4.0
FEATURES = ("strongest", "sum", "density")
#: A sum of weights beyond this adds nothing.
ENOUGH = 30.0
#: Other, insult, threat, target, negation, report, quotation mark.
SYMBOLS = "OITPNRQ"

#: A transducer: start state and (state, symbol) to (state, output).
Machine = tuple[object, dict[tuple[object, str], tuple[object, object]]]


def near(symbol: str) -> Machine:
    """Outputs whether ``symbol`` was read among the last ``REACH`` symbols."""
    arcs = {}
    for left in range(REACH + 1):
        for s in SYMBOLS:
            arcs[left, s] = (REACH if s == symbol else max(0, left - 1), left > 0)
    return 0, arcs


def since(symbol: str) -> Machine:
    """Outputs whether ``symbol`` was read before."""
    return False, {(seen, s): (seen or s == symbol, seen) for seen in (False, True) for s in SYMBOLS}


def inside(symbol: str) -> Machine:
    """Outputs whether an odd number of ``symbol`` was read: whether a quotation is open."""
    return False, {(odd, s): (odd != (s == symbol), odd) for odd in (False, True) for s in SYMBOLS}


def compose(*machines: Machine) -> Machine:
    """The transducer that reads a symbol with all machines at once and outputs what each of them does.

    Only pairs of states that can be reached are made.
    """
    start = tuple(m[0] for m in machines)
    arcs, pending = {}, [start]
    while pending:
        state = pending.pop()
        if (state, SYMBOLS[0]) in arcs:
            continue
        for s in SYMBOLS:
            steps = [arcs_of[q, s] for q, (_, arcs_of) in zip(state, machines)]
            arcs[state, s] = (tuple(q for q, _ in steps), tuple(o for _, o in steps))
            pending.append(arcs[state, s][0])
    return start, arcs


def kind_of(symbol: str, negated: bool, targeted: bool, threatened: bool, reported: bool, quoted: bool) -> str | None:
    """The kind of match that a symbol completes, if any."""
    if symbol == "I":
        return "reported" if reported or quoted else "negated" if negated else "targeted" if targeted else "plain"
    # A denied or reported threat is none.
    aimed = (symbol == "P" and threatened) or (symbol == "T" and targeted)
    return "threat" if aimed and not (negated or reported or quoted) else None


START, _ARCS = compose(near("N"), near("P"), near("T"), since("R"), inside("Q"))
#: The clause transducer: (state, symbol) to (state, kind of match or None).
TRANSITIONS = {(q, s): (after, kind_of(s, *out)) for (q, s), (after, out) in _ARCS.items()}


#: A pattern also has a form for its second and its third word in a text: some stems are insults only where they pile up.
TIMES = 3


def stems(word: str) -> Iterator[str]:
    """The patterns a word fits: itself, and ``stem*`` for each stem length."""
    yield word
    for n in STEMS:
        if len(word) >= n:
            yield word[:n] + "*"


def nth(pattern: str, n: int) -> str:
    """The form of a pattern for the n-th word of a text that fits it."""
    return pattern if n < 2 else f"{pattern}{min(n, TIMES)}"


@dataclass
class Grammar:
    """Insult patterns with weights, the best attested first, and the logistic model on the features."""

    insults: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (0.0,) * (len(FEATURES) + 1)
    cache: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def __post_init__(self):
        self.rank = {p: i for i, p in enumerate(self.insults)}
        self.bases = {p.rstrip("23") for p in self.insults}

    def fits(self, word: str) -> tuple[str, ...]:
        """The patterns of the grammar, in any form, that a word fits."""
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            found = self.cache[word] = () if word in CLOSED else tuple(p for p in stems(word) if p in self.bases)
        return found

    def weight(self, word: str, seen: Counter) -> float:
        """The weight of the best attested form a word fits, 0 if none; ``seen`` counts the patterns of the text so far."""
        best = None
        for p in self.fits(word):
            seen[p] += 1
            for n in range(min(seen[p], TIMES), 0, -1):
                at = self.rank.get(nth(p, n))
                if at is not None and (best is None or at < best[0]):
                    best = (at, self.insults[nth(p, n)])
        return best[1] if best else 0.0

    def symbol(self, word: str, seen: Counter) -> tuple[str, float]:
        for name, words in (("P", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("T", THREATS), ("Q", QUOTES)):
            if word in words:
                return name, THREAT_WEIGHT if name == "T" else 1.0
        w = self.weight(word, seen)
        return ("I", w) if w else ("O", 0.0)

    def matches(self, text: str | None) -> list[tuple[int, str, str, float]]:
        """(clause number, kind, word, weight) of every match, reading each clause through all transducers.

        A threat is complete at its target or at its word, whichever comes
        last, and has the threat's weight.
        """
        out, seen = [], Counter()
        for n, clause in enumerate(CLAUSE.split((text or "").lower())):
            state = START
            for word in SYMBOL.findall(clause):
                name, w = self.symbol(word, seen)
                state, kind = TRANSITIONS[state, name]
                if kind:
                    out.append((n, kind, word, (w if name == "I" else THREAT_WEIGHT) * KIND_WEIGHTS[kind]))
        return out

    def features(self, text: str | None) -> list[float]:
        """Numbers of a whole text; all zero where no clause matches."""
        low = (text or "").lower()
        words = WORD.findall(low)
        distinct = set(words)
        # Clauses are only read where a match can be: an insult or a threat.
        if not any(map(self.fits, distinct)) and THREATS.isdisjoint(distinct):
            return [0.0] * len(FEATURES)
        weights = [w for _, _, _, w in self.matches(text)]
        # Per 100 words: chance matches grow with a text, insults stand out in it.
        density = 100.0 * sum(weights) / (len(words) + 50.0)
        return [max(weights, default=0.0), min(sum(weights), ENOUGH), min(density, ENOUGH)]

    def score(self, text: str | None) -> float:
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], self.features(text)))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def _pattern_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with each pattern, by label, summed per batch."""
    for part in parts:
        seen = (Counter(), Counter())
        for text, label in zip(part["text"], part["label"]):
            words = Counter(WORD.findall((text or "").lower()))
            fits = Counter()
            for w, n in words.items():
                if w not in CLOSED:
                    fits.update(dict.fromkeys(stems(w), n))
            seen[int(label)].update([nth(p, k) for p, n in fits.items() for k in range(1, min(n, TIMES) + 1)])
        keys = list(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({"pattern": keys, "toxic": [seen[1][k] for k in keys], "clean": [seen[0][k] for k in keys]})


def learn_insults(labelled: DataFrame, toxic: int, clean: int, least: float = LEAST_EVIDENCE, keep: int = LEXICON) -> dict[str, float]:
    """Patterns over-represented in toxic texts, with their log odds above the floor, from (text, label)."""
    counts = labelled.mapInPandas(_pattern_counts, "pattern string, toxic long, clean long")
    counts = counts.groupBy("pattern").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    t, c = F.col("t"), F.col("c")
    share = toxic / (toxic + clean)
    term = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    both = t + c
    evidence = 2 * (
        term(t, both * share) + term(c, both * (1 - share))
        + term(toxic - t, toxic - both * share) + term(clean - c, clean - both * (1 - share))
    )
    odds = F.log((t + 0.5) / (toxic + 1.0)) - F.log((c + 0.5) / (clean + 1.0))
    rows = (
        counts.where(t * clean > c * toxic * 3)
        .select("pattern", odds.alias("odds"), evidence.alias("g"))
        .where((F.col("g") >= least) & (F.col("odds") > ODDS_FLOOR + 0.1))
        .orderBy(F.desc("g"), "pattern")
        .limit(keep)
        .collect()
    )
    return {r.pattern: float(r.odds) - ODDS_FLOOR for r in rows}


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 0.1, rounds: int = 200) -> tuple[float, ...]:
    """Logistic regression on rows that stand for ``n`` texts each: ridge-penalised, no coefficient below 0.

    A match never lowers a score. Newton steps on the free coefficients; those
    that would turn negative are held at 0 and freed again when it helps.
    """
    a = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.array([1e-6] + [penalty] * x.shape[1])
    b = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -40, 40)))
        slope = a.T @ (n * (y - p)) - ridge * b
        free = np.ones(len(b), bool)
        free[1:] = (b[1:] > 0) | (slope[1:] > 0)
        curve = a[:, free].T @ (a[:, free] * (n * p * (1 - p))[:, None]) + np.diag(ridge[free])
        step = np.zeros(len(b))
        step[free] = np.clip(np.linalg.solve(curve, slope[free]), -2, 2)
        new = b + step
        new[1:] = np.maximum(new[1:], 0)
        moved, b = np.abs(new - b).max(), new
        if moved < 1e-8:
            break
    return tuple(map(float, b))


def fit_grammar(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS
) -> Grammar:
    """A grammar learned from labelled rows, ``fit_rows`` at most, with the best ``LEXICON`` patterns at most.

    Ids that repeat in ``labels`` count once, as toxic if any row says so;
    null ids and labels are left out. With no toxic or no clean row the grammar
    has no insults, and every text scores one half.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    ids = ids.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fit = stage(rows.join(F.broadcast(ids), "id").select("text", "label"), "labelled")  # fit_rows ids at most
    clean, toxic = 0, 0
    for r in fit.groupBy("label").count().collect():
        clean, toxic = (clean, r["count"]) if r.label == 1 else (r["count"], toxic)
    if not clean or not toxic:
        return Grammar()
    grammar = Grammar(learn_insults(fit, toxic, clean))

    def numbers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"x": [grammar.features(t) for t in part["text"]], "label": part["label"]})

    seen = fit.mapInPandas(numbers, "x array<double>, label int")
    # Equal feature rows are one row with a count: most texts match nothing.
    rows = seen.groupBy("x", "label").count().collect()
    rows.sort(key=lambda r: (r.x, r.label))
    x, y, n = (np.array([r[k] for r in rows], dtype=float) for k in ("x", "label", "count"))
    return Grammar(grammar.insults, fit_logistic(x, y, n))


def score_column(text: Column, grammar: Grammar) -> Column:
    """The score of each text, 0 to 1; null and empty texts have the score of a text without matches."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([grammar.score(t) for t in texts], dtype="float64")

    return scored(text)


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into a fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, fold: int = 1
) -> DataFrame:
    """(id, held_out, score, predicted) of every row, from a grammar learned outside the held-out fold.

    The score depends on the text alone. Repeated rows stay, null ids are never
    held out, other columns are ignored, and an empty table gives an empty
    result.
    """
    held = in_fold(id_col, folds, fold)
    grammar = fit_grammar(docs, labels.where(~held), id_col, text_col, label_col)
    rows = docs.select(F.col(id_col), held.alias("held_out"), score_column(F.col(text_col), grammar).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
