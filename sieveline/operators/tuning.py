"""Staged search over boosted-tree settings; all settings and folds of a stage share their passes."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import settings as S
from sieveline.operators import models as L
from sieveline.operators.boosting import BoostedTrees, Fit, probability_column
from sieveline.operators.models import KEY, LABEL
from sieveline.operators.splits import with_stratified_folds
from sieveline.sources.staging import stage


@dataclass(frozen=True)
class Search:
    """The tried settings with their scores, and the best of them."""

    name: str
    tried: tuple[S.BoostParams, ...]
    scores: tuple[float, ...]
    best: S.BoostParams
    best_score: float
    model: BoostedTrees


def combinations(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def weighted_f1(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The F1 of both classes weighted by their rows, from counts of (label, prediction)."""
    def of(label: int, prediction: int):
        hit = (F.col(LABEL) == label) & (F.col("prediction") == prediction)
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("double")

    cells = counts.groupBy(*by).agg(of(1, 1).alias("tp"), of(0, 0).alias("tn"), of(0, 1).alias("fp"), of(1, 0).alias("fn"))
    wrong = F.col("fp") + F.col("fn")
    f1 = lambda hit: F.coalesce(F.try_divide(2 * F.col(hit), 2 * F.col(hit) + wrong), F.lit(0.0))
    ones, zeros = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return cells.select(*by, ((f1("tp") * ones + f1("tn") * zeros) / (ones + zeros)).alias("weighted_f1"))


def search(
    df: DataFrame,
    features: Sequence[str],
    candidates: Sequence[S.BoostParams],
    k: int = 5,
    seed: int = 42,
    name: str = "search",
) -> Search:
    """Cross-validate the candidates on weighted F1 over stratified folds; the first best one wins.

    One binned table serves the fits of all candidates and folds, and one pass
    scores every row by the models that did not see it. The winner is refit
    on all rows.
    """
    folded = stage(with_stratified_folds(df, KEY, LABEL, k, seed), "search-folds")
    fits = [Fit(c, f"fold <> {i}") for c in candidates for i in range(k)]
    models = L.fit_all(folded, features, fits)
    scores = probability_column(models)
    own = [F.get("s", F.lit(j * k) + F.col("fold")) for j in range(len(candidates))]
    each = folded.withColumn("s", scores).select(LABEL, "fold", F.posexplode(F.array(*own)).alias("candidate", "p"))
    counts = each.groupBy("candidate", "fold", LABEL, (F.col("p") >= 0.5).cast("int").alias("prediction")).agg(F.count("*").alias("n"))
    means = weighted_f1(stage(counts, "search-counts"), ["candidate", "fold"]).groupBy("candidate").agg(F.avg("weighted_f1").alias("m"))
    got = {r.candidate: r.m for r in means.collect()}
    ranked = tuple(float(got.get(j, 0.0)) for j in range(len(candidates)))
    at = max(range(len(ranked)), key=lambda i: (ranked[i], -i))
    return Search(name, tuple(candidates), ranked, candidates[at], ranked[at], L.fit(df, features, candidates[at]))


def grid_search(
    df: DataFrame, features: Sequence[str], base: S.BoostParams, grid: Mapping[str, Sequence], **options
) -> Search:
    """Every combination of the grid on top of ``base``."""
    return search(df, features, [replace(base, **c) for c in combinations(grid)], **options)


def random_search(
    df: DataFrame,
    features: Sequence[str],
    base: S.BoostParams,
    space: Mapping[str, Sequence],
    draws: int = 50,
    seed: int = 42,
    **options,
) -> Search:
    """Distinct random combinations; learning rate and trees stay those of ``base``."""
    size = 1
    for values in space.values():
        size *= len(values)
    picks = random.Random(seed).sample(range(size), min(draws, size))
    candidates = []
    for pick in picks:
        chosen = {}
        for name, values in space.items():
            pick, at = divmod(pick, len(values))
            chosen[name] = values[at]
        candidates.append(replace(base, **chosen))
    return search(df, features, candidates, seed=seed, **options)


def tune(
    df: DataFrame,
    features: Sequence[str],
    base: S.BoostParams = S.BoostParams(),
    grids: S.TuningGrids = S.TuningGrids(),
    use_random: bool = True,
    **options,
) -> list[Search]:
    """Tree shape, then sampling, then learning rate, then random draws.

    Each stage starts from the best settings of the one before. The result
    lists every stage; the last one is final.
    """
    stages = []
    for name, grid in (("tree", grids.tree), ("sampling", grids.sampling), ("learning", grids.learning)):
        found = grid_search(df, features, base, grid, name=name, **options)
        stages.append(found)
        base = found.best
    if use_random:
        stages.append(
            random_search(df, features, base, grids.random, grids.random_draws, name="random", **options)
        )
    return stages


def history(df: DataFrame, stages: Sequence[Search]) -> DataFrame:
    """One row per tried setting: stage, position, settings as JSON, score, best flag."""
    rows = [
        (s.name, i, json.dumps(vars(c)), score, c == s.best)
        for s in stages
        for i, (c, score) in enumerate(zip(s.tried, s.scores))
    ]
    return df.sparkSession.createDataFrame(
        rows, "stage string, candidate int, params string, weighted_f1 double, is_best boolean"
    )
