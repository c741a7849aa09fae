"""Staged intermediate tables.

A staged table is written once under the folder named by
``spark.checkpoint.dir`` and read back. It ends the lineage of an iterative
job, survives the loss of executors, and gives the optimizer real column and
size information, so later joins choose broadcast only for small tables.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The shared folder of this application's staged tables."""
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/sieveline/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="sieveline-")
    return _LOCAL_ROOTS[app]


def staged_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the staging folder and read it back."""
    spark = df.sparkSession
    path = staged_path(spark, label)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.staged_at = path
    return made


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unstage(*tables: DataFrame | None) -> None:
    """Delete staged tables that newer ones have replaced; nothing that is still to run may read them.

    Tables that ``stage`` did not return, such as a selection of one, are left alone.
    """
    for t in tables:
        if t is not None and getattr(t, "staged_at", None):
            _delete(t.sparkSession, t.staged_at)


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core, for work that is heavy per row.

    A small staged table has few files and would keep most cores idle. A table
    that already has enough partitions is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def clear_staging(spark: SparkSession) -> None:
    """Delete the tables this application has staged. Call when a job ends."""
    _delete(spark, staging_root(spark))
