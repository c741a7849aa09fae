"""A training corpus from the documents table: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import copies, decontaminate, mixing, secrets, toxicity
from sieveline.llm.common import fresh, stage, table
from sieveline.llm.queries import MIX_POWERS, MIX_SEED, MIX_SHARE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a grammar learned from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.in_fold("doc_id", 3, 1))
    score = fresh(docs, "score")
    scored = docs.withColumn(score, toxicity.score_column(F.col("text"), toxicity.fit_grammar(docs, labels)))
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, by SimHash fingerprints and by five-word shingles at 0.8 or more."""
    return copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.redact(docs, secrets.fit_forest(secrets.labelled_findings(docs)))


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target mix, with topic, n_tokens and the weights that calibrate them."""
    mixed = mixing.mix(docs, MIX_POWERS, MIX_SHARE, MIX_SEED)
    drawn = fresh(docs, "sampled")
    return mixed.where(drawn).drop(drawn)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", mask_secrets),
    ("mixing", sample_mix),
]

#: SQL can't express the models of these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
