import json

import pytest

from sieveline import schemas
from sieveline.plans.star_schema import companies
from sieveline.sources import readers, writers
from sieveline.sources.staging import clear_staging, stage, staging_root
from sieveline.streaming.portfolio import portfolio_stream, screen_stream
from sieveline.plans.jobs import screen_portfolio


def test_csv_needs_a_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path), fmt="csv")


def test_sector_dictionary_and_lines(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"A": "Mining", "B": "Other"}, indent=1))
    got = {tuple(r) for r in readers.read_sector_dictionary(spark, str(tmp_path / "map.json")).collect()}
    assert got == {("A", "Mining"), ("B", "Other")}


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame(
        [("A", 1, 1, 0.9, 0.9, 1), ("B", 0, None, None, 0.5, 0)], schemas.PREDICTIONS
    )
    writers.write_table(df, str(tmp_path / "t"), fmt)
    back = readers.read_table(spark, str(tmp_path / "t"), schemas.PREDICTIONS, fmt)
    assert sorted(back.collect()) == sorted(df.collect())


def test_report_keeps_nulls(spark, tmp_path):
    writers.write_report(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first().value == '{"a":1,"b":null}'


def test_labeled_features_join_only_when_needed(spark):
    labels = spark.createDataFrame([("A", "x", 1)], "symbol string, sector string, shariah_compliant int")
    features = spark.createDataFrame([("A", "y", 0.5)], "symbol string, sector string, roa double")
    joined, names = readers.labeled_features(labels, features)
    assert names == ["roa"] and joined.first().sector == "x" and joined.first().roa == 0.5
    again, names = readers.labeled_features(joined, features)
    assert again is joined and names == ["roa"]


def test_staging(spark):
    df = stage(spark.range(10), "check")
    assert df.count() == 10
    plan = df._jdf.queryExecution().toString()
    assert "FileScan" in plan or "Scan parquet" in plan or "Relation" in plan
    assert staging_root(spark).startswith(spark.conf.get("spark.checkpoint.dir", staging_root(spark)))


def test_stream_decides_like_the_batch(spark, sf_dir, tmp_path):
    portfolio = companies(spark, sf_dir).withColumnRenamed("symbol", "ticker")
    portfolio.repartition(3).write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    arriving = portfolio_stream(spark, str(tmp_path / "in"), stored.schema, files_per_batch=1)
    query = screen_stream(arriving, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = screen_portfolio(stored)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_clear_staging(spark):
    path = stage(spark.range(3), "gone").inputFiles()[0]
    assert path
    clear_staging(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not fs.exists(hadoop)
