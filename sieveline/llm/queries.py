"""Queries of the operators in this folder over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import (
    conversation,
    ctw,
    decontaminate,
    extract,
    mixing,
    secrets,
    setsketch,
    simhash,
    topk,
    toxicity,
    urlfilter,
    warc,
    whiten,
)
from sieveline.llm.common import stage, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op7_simhash_near_duplicates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


# --- mixing ----------------------------------------------------------------------
MIX_POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
MIX_SHARE = 0.7
MIX_SEED = 17
MARGINS = tuple(MIX_POWERS)
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _mixing_sql() -> str:
    topic = " ".join(
        f"WHEN {' OR '.join(f"contains(text, '{m}')" for m in marks)} THEN '{name}'" for name, marks in mixing.TOPIC_MARKS
    )
    parts = [
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
  CASE {topic} ELSE '{mixing.OTHER_TOPIC}' END AS topic, len({WORDS_SQL}) AS n_tokens FROM documents)""",
        """c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, 1.0::DOUBLE AS w
  FROM d GROUP BY ALL)""",
    ]
    for m, p in MIX_POWERS.items():
        parts.append(
            f"""t_{m} AS MATERIALIZED (SELECT {m}, pow(s, {p}) / sum(pow(s, {p})) OVER () AS share FROM
  (SELECT {m}, sum(tokens) / sum(sum(tokens)) OVER () AS s FROM c0 GROUP BY {m} HAVING sum(tokens) > 0))"""
        )
    n = 0
    for _ in range(mixing.MAX_SWEEPS):
        for m in MIX_POWERS:
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, coalesce(w * share /
  (sum(tokens * w) OVER (PARTITION BY {m}) / sum(tokens * w) OVER ()), 0) AS w FROM c{n} LEFT JOIN t_{m} USING ({m}))"""
            )
            n += 1
    parts.append(
        f"""steps AS (SELECT w, row_number() OVER (ORDER BY w DESC, source, lang, topic) AS n, (({MIX_SHARE} * sum(tokens) OVER ()) -
    coalesce(sum(tokens) OVER (ORDER BY w DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(tokens * w) OVER () -
    coalesce(sum(tokens * w) OVER (ORDER BY w DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS t
  FROM c{n} WHERE tokens * w > 0),
rate AS (SELECT arg_min(t, n) AS t FROM steps WHERE t * w < 1),
p AS (SELECT source, lang, topic, w, least(1.0, w * t) AS p FROM c{n}, rate),
u AS (SELECT d.*, w, p,
  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{MIX_SEED}'), 1, 13))::BIGINT / pow(2, 52) < p AS sampled
  FROM d JOIN p USING (source, lang, topic))"""
    )
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, source, lang, topic, n_tokens, round(w, 6) AS weight, round(p, 6) AS probability, sampled,
  CASE WHEN sampled THEN round(w / p, 6) END AS sample_weight FROM u"""


@query("op1_mixing_to_target_weights", _mixing_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents")
    read = [mixing.topic_of(F.col("text")).alias("subject"), mixing.token_count(F.col("text")).alias("words")]
    docs = stage(texts.select("doc_id", "source", "lang", *read), "mix")
    mixed = mixing.mix(docs, MIX_POWERS, MIX_SHARE, MIX_SEED, topic=F.col("subject"), tokens=F.col("words"))
    unknown = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    numbers = [F.round(c, 6).alias(c) for c in ("weight", "probability", "sample_weight")]
    return mixed.select("doc_id", unknown("source"), unknown("lang"), "topic", "n_tokens", "sampled", *numbers)


# --- URL filters -----------------------------------------------------------------
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Words of host labels that put a crawled address on the list.
SPAM_LABELS = ("spam", "pills", "casino", "replica", "loans")
SPAM_HOST = rf"(^|[.-])({'|'.join(SPAM_LABELS)})([.-]|$)"


def _url_sql() -> str:
    tracking = " AND ".join(f"NOT starts_with(x, '{t}')" for t in urlfilter.TRACKING)
    ruled = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in ruled]
    name = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ruled))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ruled))
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
s AS (SELECT page_id,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS args FROM r),
a AS (SELECT *, array_to_string(list_filter(string_split(args, '&'), lambda x: x <> '' AND {tracking}), '&') AS kept FROM s),
k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/+$', '') ||
  CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS key FROM a),
listed AS (SELECT DISTINCT key FROM k WHERE regexp_matches(host, '{SPAM_HOST}'))
SELECT page_id, host, path, CASE {name} END AS rule,
  CASE {verdict} WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM k"""


@query("op10_url_filter", _url_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, _, _ = urlfilter.url_parts(F.col("url"))
    listed = pages.where(host.rlike(SPAM_HOST)).select("url")
    return urlfilter.judge_urls(pages, listed, URL_RULES)


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_benchmark_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit_forest(secrets.labelled_findings(docs)))


# --- exact search ----------------------------------------------------------------
TOP_K = 10
QUERY_STEP = 50  # every row whose id it divides is a query

TOP_K_SQL = f"""
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, e.vec_id AS id,
  CAST(list_sum(list_transform(list_zip(q.bits, e.bits), lambda x: CAST(x[1] <> x[2] AS INTEGER))) AS INTEGER) AS distance
  FROM e AS q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p)
SELECT query_id, rank, id, distance FROM r WHERE rank <= {TOP_K}"""


@query("op8_exact_top_k", TOP_K_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.sign_code(F.col("embedding")).alias("code"))
    return topk.nearest(codes, codes.where(F.col("id") % QUERY_STEP == 0), TOP_K)


# --- WARC ------------------------------------------------------------------------
_LETTERS = " || ".join(
    f"substr('{warc.BASE32}', ((('0x' || substr(h, {5 * i + 1}, 5))::INTEGER >> {shift}) & 31) + 1, 1)"
    for i in range(8)
    for shift in (15, 10, 5, 0)
)
WARC_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, {_LETTERS} AS payload_digest, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""


@query("op9_warc_bundles", WARC_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


@query("op2_html_main_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"), extract.train(extract.labelled_pages()))


@query("op4_context_tree_score")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"), toxicity.in_fold("doc_id", 5, 1))


# --- whitening -------------------------------------------------------------------
@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long is null; the operator has it as a decimal."""
    made = whiten.whiten(table(spark, sf_dir, "embeddings"))
    return made.withColumn("deviation", F.col("deviation").try_cast("long"))


# --- conversation repair ---------------------------------------------------------
_END = "chr(1)"  # between a state's cost and audit, compared as one string, and its text


def _edit(v: str, cost: str, letter: str, line: str) -> str:
    at = f"strpos({v}, {_END})"
    return (
        f"(printf('%010d', CAST(substr({v}, 1, 10) AS BIGINT) + {cost}) || substr({v}, 11, {at} - 11) || '{letter}' || {_END}"
        f" || substr({v}, {at} + 1) || {line})"
    )


def _conversation_sql() -> str:
    insert = lambda v, role: _edit(v, "2", "I", f"chr(10) || '{role}:'")
    delete = lambda v: _edit(v, "3", "D", "''")
    kept = lambda v: _edit(v, "more", "K", "chr(10) || role || ':' || text")

    def says(v: str, role: str) -> str:
        changed = _edit(v, "(2 + more)", "R", f"chr(10) || '{role}:' || text")
        return f"CASE WHEN must THEN NULL WHEN initial = '{role[0]}' THEN {kept(v)} ELSE {changed} END"

    def closed(source: str) -> str:
        """The states of ``source`` (w0 to w3) with the insertions that improve them."""
        x2 = f"least(w2, {insert('w0', 'user')}, {insert('w1', 'user')}, {insert('w3', 'user')})"
        one = f"SELECT *, {x2} AS x2 FROM ({source})"
        two = f"SELECT *, least(w3, {insert('x2', 'assistant')}) AS x3 FROM ({one})"
        return f"SELECT key, n, w0 AS v0, w1 AS v1, least(x2, {insert('x3', 'user')}) AS v2, x3 AS v3 FROM ({two})"

    moved = f"""SELECT s.key, s.n + 1 AS n, {delete('v0')} AS w0,
  least({delete('v1')}, CASE WHEN NOT must AND initial = 's' THEN {kept('v0')} END) AS w1,
  least({delete('v2')}, {says('v0', 'user')}, {says('v1', 'user')}, {says('v3', 'user')}) AS w2,
  least({delete('v3')}, {says('v2', 'assistant')}) AS w3
  FROM s JOIN r ON r.key = s.key AND r.n = s.n + 1"""
    first = f"SELECT DISTINCT key, 0 AS n, '0000000000' || {_END} AS w0, NULL::VARCHAR AS w1, NULL::VARCHAR AS w2, NULL::VARCHAR AS w3 FROM r"
    return rf"""
WITH RECURSIVE bits AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
c AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(c // 256, t[xor(c % 256, b) % 256 + 1])), 4294967295) % 20 AS fault FROM k, bits),
d AS (SELECT conv_id, coalesce('=' || CAST(conv_id AS VARCHAR), '') AS key, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS time FROM c WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS n,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM d),
e AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY key, role, text ORDER BY n) > 1 AS duplicate FROM o),
r AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS initial, blank OR duplicate AS must,
  NOT blank AND NOT duplicate AND regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS truncated,
  CASE WHEN truncated THEN 1 ELSE 0 END AS more,
  coalesce(lag(substr(role, 1, 1)) OVER (PARTITION BY key ORDER BY n) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM e),
s AS ({closed(first)} UNION ALL {closed(moved)}),
f AS (SELECT key, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM r GROUP BY key),
g AS (SELECT key, gaps, blank, duplicate, truncated, illegal, least(v0, v3) AS v FROM f JOIN s USING (key, n)),
h AS (SELECT *, strpos(v, {_END}) AS cut FROM g)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(v, 1, 10) AS BIGINT), 0) AS cost,
  coalesce(substr(v, 11, cut - 11), '') AS audit, sha256(coalesce(substr(v, cut + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || CAST(conv_id AS VARCHAR), '') AS key FROM conversations) AS i LEFT JOIN h USING (key)"""


@query("op13_conversation_repair", _conversation_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "conversations")
    return conversation.summarise(whole, conversation.repair(conversation.damage(whole)))


# --- SetSketch near-duplicates ---------------------------------------------------
def _setsketch_sql() -> str:
    """All pairs that share a shingle, counted; classes by spreading the smallest id along links."""
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT doc_id, regexp_extract_all(coalesce(low, ''), '[^\x20\x09-\x0D]+') AS words FROM t),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS made FROM w),
k AS MATERIALIZED (SELECT made_key, min(doc_id) AS node, any_value(made) AS made, len(any_value(made)) AS n
  FROM (SELECT doc_id, made, md5(array_to_string(list_sort(made), chr(10))) AS made_key FROM s WHERE len(made) > 0) GROUP BY made_key),
m AS (SELECT doc_id, made_key FROM (SELECT doc_id, md5(array_to_string(list_sort(made), chr(10))) AS made_key FROM s WHERE len(made) > 0)),
g AS MATERIALIZED (SELECT node, n, unnest(made) AS shingle FROM k),
p AS (SELECT a.node AS a, b.node AS b, a.n AS n_a, b.n AS n_b, count(*) AS common FROM g AS a JOIN g AS b USING (shingle)
  WHERE a.node < b.node AND 100 * least(a.n, b.n) >= {setsketch.PERCENT} * greatest(a.n, b.n) GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * common >= {setsketch.PERCENT} * (n_a + n_b - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
c AS (SELECT a AS node, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.made) AS n_shingles, coalesce(c.component_id, k.node, s.doc_id) AS component_id,
  s.doc_id = coalesce(c.component_id, k.node, s.doc_id) AS kept
FROM s LEFT JOIN m USING (doc_id) LEFT JOIN k USING (made_key) LEFT JOIN c ON c.node = k.node"""


@query("op12_setsketch_near_duplicates", _setsketch_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))
