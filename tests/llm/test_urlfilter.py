from pyspark.sql import functions as F

from sieveline.llm import urlfilter as U

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def judge(spark, urls, listed, **kw):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = U.judge_urls(pages, spark.createDataFrame([(u,) for u in listed], "url string"), RULES, **kw).collect()
    return {r.page_id: r for r in got}


def test_rules_and_parts(spark):
    urls = ["http://A.Example.NET/en/1", "http://b.net", "http://b.net/x?y#z", "https://x.example.com/de/?q", None, "no-scheme/x",
            "http://notexample.com/de/", "ftp://k.org/fr/", "http://q.org?x=/fr/", "x://y://z/w"]
    got = judge(spark, urls, [])
    seen = [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))]
    assert seen == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("b.net", "", None, "allow"), ("b.net", "/x", "net/", "block"),
        ("x.example.com", "/de/", "example.com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("notexample.com", "/de/", None, "allow"), ("k.org", "/fr/", "org/fr/", "allow"), ("q.org", "", None, "allow"),
        ("y:", "//z/w", None, "allow")]


def test_listed_urls_are_found_whatever_the_filter_lets_through(spark):
    urls = [f"https://www.h{i % 50}.example.com/p{i}/?utm_source=a&k={i}#f" for i in range(400)] + ["http://H7.example.com/p7?k=7"] * 3
    listed = [f"http://h{i % 50}.example.com/p{i}?k={i}" for i in range(0, 400, 7)] + [None, "bad"]
    for bits in (1, 16):
        got = judge(spark, urls, listed, bits_per_key=bits)
        blocked = {i for i, r in got.items() if r.verdict == "block"}
        assert blocked == set(range(0, 400, 7)) | {400, 401, 402}


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    words, blocks = U.bloom_filter(keys, 3000)
    probe = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), "id").withColumn("block", U._block(F.col("key"), blocks))
    hit = F.lit(True)
    for i, m in enumerate(U._masks(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    rows = probe.join(words, "block", "left").select("id", F.coalesce(hit, F.lit(False)).alias("hit")).collect()
    assert all(r.hit for r in rows if r.id < 3000)
    assert sum(r.hit for r in rows if r.id >= 3000) < 60


def test_empty(spark):
    assert judge(spark, ["http://a.com/x"], [])[0].verdict == "allow"
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.judge_urls(empty, empty.select("url"), RULES).collect() == []
