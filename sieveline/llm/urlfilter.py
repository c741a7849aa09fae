"""URL verdicts: prefix rules first, then a blocked Bloom filter before an exact join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import lower_ascii, stage

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]

BITS_PER_KEY = 16
WORDS = 8  # of 64 bits in a block
WORD_BITS = 64
#: The filter is broadcast up to this size, known from its block count; beyond it, it is joined by shuffle.
BROADCAST_BYTES = 32 << 20
MAX_RULES = 1000
# --- fixed values: query parameters that don't change a page, by prefix -------
TRACKING = ("utm_", "ref=", "fbclid=", "gclid=")


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a URL, each empty for a null or a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path, F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def canonical_url(url: Column, tracking: Sequence[str] = TRACKING) -> Column:
    """Host without ``www.``, path without closing slashes, query without tracking; null without a host.

    Scheme and fragment are left out, so variants of an address are one key.
    """
    host, path, query = url_parts(url)
    keep = lambda p: (p != "") & ~_any(p.startswith(t) for t in tracking)
    args = F.array_join(F.filter(F.split(query, "&"), keep), "&")
    bare = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))
    return F.when(host != "", F.concat(bare, F.when(args != "", F.concat(F.lit("?"), args)).otherwise("")))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does.

    A rule fits its host and all subdomains when the path starts with the
    rule's. Its name is host and path; of equally long names the first in
    alphabetical order wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the expression takes {MAX_RULES}")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(x) for x in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _masks(key: Column) -> list[Column]:
    """One bit for each word of a block."""
    return [_bit(F.xxhash64(key, F.lit(i))) for i in range(WORDS)]


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(WORD_BITS)).cast("int"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def bloom_filter(keys: DataFrame, n_keys: int, bits_per_key: int = BITS_PER_KEY) -> tuple[DataFrame, int]:
    """(blocks with their words, number of blocks) of the column ``key``.

    Keys fall into blocks of 512 bits and set one bit in each of a block's
    words. The words of a block are combined before the shuffle, and the size
    follows from the number of keys.
    """
    blocks = max(1, -(-n_keys * bits_per_key // (WORDS * WORD_BITS)))
    bits = [m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))]
    made = keys.select(_block(F.col("key"), blocks).alias("block"), *bits)
    return made.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))), blocks


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    bits_per_key: int = BITS_PER_KEY,
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    A fitting rule decides. Otherwise a URL is blocked if its canonical form is
    that of a URL in ``listed`` (column ``url``). The filter passes all listed
    URLs and few others, and only what it passes goes to the exact join. Null
    URLs and URLs without ``://`` have empty parts, fit no rule and are not
    listed, so they are allowed. Repeated rows and ids stay. Other columns of
    either table are ignored; an empty list blocks nothing.
    """
    keys = listed.select(canonical_url(F.col("url")).alias("key")).where("key is not null").distinct()
    keys = stage(keys, "listed")
    words, blocks = bloom_filter(keys, keys.count(), bits_per_key)
    if blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES:
        words = F.broadcast(words)
    host, path, _ = url_parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select(
        "id", host.alias("host"), path.alias("path"), canonical_url(F.col("url")).alias("key")
    )
    name, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "ruled": verdict, "block": _block(F.col("key"), blocks)})
    passes = F.lit(True)
    for i, m in enumerate(_masks(F.col("key"))):
        passes = passes & (F.col(f"w{i}").bitwiseAND(m) == m)
    probed = rows.join(words, "block", "left").withColumn(
        "possible", F.coalesce(passes & F.col("key").isNotNull() & F.col("ruled").isNull(), F.lit(False))
    )
    probed = probed.select("id", "host", "path", "rule", "ruled", "key", "possible")
    hits = probed.where("possible").join(keys.withColumn("listed", F.lit(True)), "key", "left")
    rest = probed.where("not possible").withColumn("listed", F.lit(False))
    judged = hits.select(*rest.columns).unionByName(rest)
    listed_now = F.coalesce("listed", F.lit(False))
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(listed_now, "block").otherwise("allow")).alias("verdict"),
    )
