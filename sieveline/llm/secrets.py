"""Secret scan: candidate strings, a random forest against false positives, and redaction. JVM expressions only."""

from __future__ import annotations

import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import bare_words, fresh, stage

LONG, SHORT = 16, 8
#: Documents that lend words and numbers to the labelled findings, the lowest hashes of their ids.
FIT_DOCUMENTS = 400
LENT_WORDS = 7
TREES, DEPTH = 40, 8
THRESHOLD = 0.5
MASK = "[SECRET]"

# --- fixed values: characters of a candidate and words beside it --------------
CHARS = r"[A-Za-z0-9+/_=.~-]"
SECRET_WORDS = r"(?:key|token|secret|passw\w*|passphrase|pwd|credential\w*|auth\w*|bearer|akia)"
OTHER_WORDS = (
    r"(?:commit|sha\d*|md5|hash|checksum|digest|etag|uuid|guid|version|release|build|order|invoice|isbn|page|ref|id|"
    r"phone|tel|card|account|mail|ip|see|http\w*|path|file|image)"
)
SIGN = "[=:]+>?"
ASSIGNED = rf"(?i){SECRET_WORDS}[\"']?\s*{SIGN}\s*[\"']?$"
#: A word that says what the next one is without a sign: the next needs a digit, and none after Bearer.
NAMED, BEARER = r"(?i)(^|[^a-z])(passw\w*|passphrase|pwd|token|secret)$", r"(?i)(^|[^a-z])bearer$"
#: A quoted value ends within so many words.
QUOTED_WORDS = 16
# --- fixed values: words and letter pairs of ordinary strings -------------------
DICTIONARY = (
    "account admin api article auth blog build change com config content data default demo dummy example file from here home "
    "html http image index info insert item key license list local login mail main module name news number order org page "
    "password path phone placeholder post product public release sample search secret section server session site source "
    "static string system test text that the this time title token user value version view web with word www your"
).split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()

FEATURES = (
    "length", "digits", "upper", "symbols", "changes", "pairs", "variety", "words", "hex", "numeric", "slashes", "dots",
    "dashes", "secret_before", "other_before", "assigned", "quoted", "url_before", "repeats", "marks", "blanks",
)


def suspicious(text: Column) -> Column:
    """Whether a text can hold a candidate at all: it has a digit, a secret's keyword before a sign, or a bearer."""
    return F.coalesce(text.rlike(rf"[0-9]|(?i){SECRET_WORDS}[\"']?\s*[=:]|(?i)bearer\s"), F.lit(False))


def candidates(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, word, candidate, before): strings that may be secrets.

    A candidate is a run of letters, digits and ``+/_=.~-``: of 16 or more with
    a digit among them or after ``Bearer``, or of 8 or more assigned to a word
    like ``token`` or ``password``, or with a digit right after ``password``.
    What is assigned is a candidate as a whole too, whatever its characters: a
    value in quotes with its blanks, each counted as one, or all up to the next
    blank. ``word`` is the number of its word, ``before`` the three words
    before and what stands in its word before it. Closing dots don't belong to
    it, nor do commas, semicolons, colons, brackets and quotes that close an
    unquoted value. Texts without digit, keyword or bearer are passed over unread.
    """
    words = F.col("_words")
    at = lambda i: F.get(words, i)
    after = lambda i, pattern: (i > 0) & at(i - 1).rlike(pattern)
    signed = rf"{SIGN}[\"']?$"
    worth = lambda i: (
        ((F.length(at(i)) >= LONG) & (at(i).rlike("[0-9]") | after(i, BEARER)))
        | ((F.length(at(i)) >= SHORT) & (at(i).rlike("[=:]") | after(i, signed) | after(i, NAMED)))
        | at(i).rlike(rf"(?i){SECRET_WORDS}[\"']?{SIGN}[\"']") | (at(i).rlike("^[\"']") & after(i, signed))
    )
    spot = lambda i: F.struct(
        i.alias("word"), at(i).alias("full"),
        F.array_join(F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " ").alias("left"),
        F.array_join(F.slice(words, i + 1, F.lit(QUOTED_WORDS)), " ").alias("line"),
    )
    rows = docs.where(suspicious(F.col(text_col))).select(*keep, bare_words(text_col).alias("_words"))
    numbers = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    spots = rows.select(*keep, F.explode(F.transform(F.filter(numbers, worth), spot)).alias("_s")).select(*keep, "_s.*")

    # An assignment written without blanks is one run: what follows its first sign is the value.
    value = lambda run: F.regexp_extract(run, r"^[A-Za-z_][\w.-]{0,40}=+([^=].*)$", 1)
    bare = lambda run: F.regexp_replace(F.when(value(run) != "", value(run)).otherwise(run), r"^\.+|\.+$", "")
    inside = lambda c: F.substring(F.col("full"), F.lit(1), F.instr("full", c) - 1)
    piece = lambda c: F.struct(c.alias("candidate"), F.concat_ws(" ", "left", inside(c)).alias("before"))
    runs = F.transform(F.regexp_extract_all("full", F.lit(rf"({CHARS}{{{SHORT},}})"), 1), bare)
    long = lambda p: (F.length(p.candidate) >= LONG) & (p.candidate.rlike("[0-9]") | p.before.rlike(r"(?i)bearer\s*$"))
    named = lambda p: p.candidate.rlike("[0-9]") & p.before.rlike(NAMED[:-1] + r"\s+$")
    kept = lambda p: (F.length(p.candidate) >= SHORT) & (long(p) | named(p) | p.before.rlike(ASSIGNED))

    # The whole value, from the opening quote or the sign on.
    head = F.regexp_extract("full", rf"(?i)^(.*?{SECRET_WORDS}[\"']?{SIGN})[^=:>]", 1)
    rest = F.substring(F.col("line"), F.length(head) + 1, F.length("line"))
    quoted = F.coalesce(*(F.nullif(F.regexp_extract(rest, rf"^{q}([^{q}]+){q}", 1), F.lit("")) for q in "\"'"))
    plain = F.regexp_replace(F.regexp_extract(rest, r"^[\"']?([^ ]*)", 1), r"[.,;:)\]}>\"']+$", "")
    quote = F.regexp_extract(rest, "^([\"']?)", 1)
    whole = F.struct(F.coalesce(quoted, plain).alias("candidate"), F.concat_ws(" ", "left", F.concat(head, quote)).alias("before"))
    assigned = F.filter(F.array(whole), lambda p: (F.length(p.candidate) >= SHORT) & p.before.rlike(ASSIGNED))
    both = F.array_union(F.filter(F.transform(runs, piece), kept), assigned)
    return spots.select(*keep, "word", F.explode(both).alias("_p")).select(*keep, "word", "_p.candidate", "_p.before")


def with_features(found: DataFrame) -> DataFrame:
    """``found`` with the numbers the forest reads: length, character transitions, dictionary, path, neighbours."""
    c, b = F.col("candidate"), F.col("before")
    n = F.length(c).cast("double")
    share = lambda pattern: (n - F.length(F.regexp_replace(c, pattern, ""))) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    classes = F.regexp_replace(classes, "[^aA0]", "-")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    flag = lambda x: x.cast("double")
    near = lambda words: flag(b.rlike(rf"(?i)(^|[^a-z]){words}[^a-z]{{0,6}}$"))
    return found.withColumns(
        {
            "length": F.least(n, F.lit(200.0)),
            "digits": share("[0-9]"),
            "upper": share("[A-Z]"),
            "symbols": 1.0 - share("[A-Za-z0-9]"),
            "changes": (runs - 1) / n,
            "pairs": share(f"(?i){'|'.join(PAIRS)}"),
            "variety": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40.0)),
            "words": share(f"(?i){'|'.join(DICTIONARY)}"),
            "hex": flag(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
            "numeric": flag(c.rlike("^[0-9.+-]+$")),
            "slashes": share("/"),
            "dots": share("[.]"),
            "dashes": share("[-_]"),
            "secret_before": near(SECRET_WORDS),
            "other_before": near(OTHER_WORDS),
            "assigned": flag(b.rlike(r"[=:][\"'\s]*$")),
            "quoted": flag(b.rlike(r"[\"']$")),
            "url_before": flag(b.rlike(r"(://|www\.|@)\S*$")),
            "marks": share(r"[^A-Za-z0-9+/_=.~\s-]"),
            "blanks": share(r"\s"),
            "repeats": (n - F.length(F.regexp_replace(c, r"(.)\1{2,}", "$1"))) / n,
        }
    )


def _lowest(ids: DataFrame, n: int) -> DataFrame:
    """The ``n`` ids with the lowest hashes.

    Hashes are uniform, so a cut at twice the share of ``n`` in the counted ids
    leaves about 2 n of them at every size, and only those are sorted.
    """
    count = ids.agg(F.approx_count_distinct("id")).first()[0]
    cut = min(2**64 * 2 * n // max(count, 1), 2**64 - 1) - 2**63
    few = ids.where(F.xxhash64("id") <= cut).distinct()
    return few.orderBy(F.xxhash64("id"), "id").limit(n)


def labelled_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = FIT_DOCUMENTS) -> DataFrame:
    """(text, label) of findings with known answers: secrets, and strings that only look like them.

    Words come from ``documents`` ids of ``docs`` at most, random characters
    from digests of their ids, so the set has the language of the corpus. Rows
    that repeat an id lend the smallest of their word lists; null ids are one
    id. With no rows there are no findings.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    words = F.filter(bare_words("text"), lambda w: w.rlike(r"^\w{3,}$"))
    lent = base.join(F.broadcast(_lowest(base.select("id"), documents)), "id")  # ``documents`` ids at most
    base = lent.select("id", F.slice(words, 1, LENT_WORDS).alias("w")).groupBy("id").agg(F.min("w").alias("w"))
    pick = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit("lorem"))
    h = lambda salt: F.sha1(F.concat("id", F.lit(f"|{salt}")))
    b64 = lambda salt, n: F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat("id", F.lit(f"|{salt}")), 256))), r"\s", ""), 1, n)
    num = lambda salt, n: F.substring(F.translate(h(salt), "abcdef", "012345"), 1, n)
    signs = lambda salt, n: F.translate(b64(salt, n), "aeimquyCGKOSW37+/", "!@#$%^&*?!@#$%^&*")
    letters = lambda salt, n: F.translate(b64(salt, n), "0123456789+/=", "ghijkmnpqrstu")
    t = F.concat
    lit = F.lit
    secret = [
        t(lit('token = "'), h("a"), lit('"')),
        t(lit('TOKEN = "'), F.upper(h("b")), lit('"')),
        t(lit("api_key: "), F.md5(h("c"))),
        t(lit('password="'), b64("d", 20), lit('"')),
        t(lit("Authorization: Bearer "), b64("e", 40)),
        t(lit("secret = '"), b64("f", 32), lit("'")),
        t(lit("client_secret="), b64("g", 28)),
        t(lit("access key AKIA"), F.upper(F.substring(h("h"), 1, 16))),
        t(lit('"auth_token": "'), F.substring(h("i"), 1, 32), lit('",')),
        t(lit("pwd: "), b64("j", 12)),
        t(lit("credential = "), F.substring(h("k"), 1, 24)),
        t(lit('password = "'), signs("ba", 16), lit('"')),
        t(lit("DB_PASSWORD="), signs("bb", 12)),
        t(lit("password => '"), signs("bc", 10), lit("'")),
        t(lit("password: "), pick(0), lit("!"), pick(1), lit("#"), num("bd", 1)),
        t(lit('passwd = "'), b64("be", 6), lit("!"), pick(0), lit("#"), num("bf", 4), lit('"')),
        t(lit("pwd="), pick(0), num("bg", 2), lit("$"), pick(1), lit("&")),
        t(lit('passphrase: "'), pick(0), lit(" "), pick(1), lit("! "), num("bh", 3), lit(" "), pick(2), lit('"')),
        t(lit("Authorization: Bearer "), letters("bi", 32)),
        t(lit("password "), F.lower(b64("bj", 7)), num("bk", 1), F.lower(b64("bl", 2))),
        t(lit("password => "), F.lower(b64("bm", 7)), num("bn", 1), F.lower(b64("bo", 2))),
    ]
    other = [
        t(lit("commit "), h("l")),
        t(lit("sha256: "), F.sha2(h("m"), 256)),
        t(lit("checksum = "), F.md5(h("n"))),
        t(lit('etag: "'), F.md5(h("o")), lit('"')),
        t(lit("id "), F.regexp_replace(F.md5(h("p")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")),
        t(lit("/"), pick(0), lit("/"), pick(1), lit("/2024/"), num("q", 6), lit("/"), pick(2), lit(".html")),
        t(lit("http://www."), F.lower(pick(0)), lit(".example.com/en/"), num("r", 9), lit("?ref="), pick(1)),
        t(pick(0), lit("-"), pick(1), lit("-"), pick(2), lit("-2024-01-"), num("s", 2)),
        t(lit("card "), num("t", 16)),
        t(pick(0), lit(" "), num("u", 16)),
        t(lit("order "), num("v", 20)),
        t(F.lower(pick(0)), lit("."), num("w", 2), lit("@mail7.example.com")),
        t(lit("version-1."), num("x", 2), lit(".0-"), pick(0), lit("-"), pick(1)),
        t(lit('token = "your-token-here-'), num("y", 4), lit('"')),
        t(lit('password: "example-password-'), num("z", 2), lit('"')),
        t(lit('api_key = "xxxxxxxxxxxxxxxx'), num("aa", 4), lit('"')),
        t(pick(0), pick(1), pick(2), pick(3), num("ab", 3)),
        t(lit("key: "), pick(0), lit("/"), pick(1), lit("-"), pick(2), num("ac", 1)),
        t(lit("secret: "), pick(0), pick(1), pick(2)),
        t(lit("page="), num("ad", 8), lit("&"), pick(0), lit("="), pick(1)),
        t(lit('password = "${'), F.upper(pick(0)), lit('_PASSWORD}"')),
        t(lit("password=<your-"), F.lower(pick(0)), lit("-password>")),
        t(lit("token: {{"), pick(0), lit("."), pick(1), lit("}}")),
        t(lit('secret: "'), pick(0), lit(" "), pick(1), lit(" "), pick(2), lit('"')),
        t(lit('author: "'), pick(0), lit(" "), pick(1), lit('"')),
        t(lit("key: "), pick(0), lit("("), pick(1), lit(")")),
        t(lit("password "), pick(0), pick(1), num("bp", 4)),
        t(lit("bearer "), pick(0), pick(1), pick(2), pick(3)),
        t(lit("phone +1-"), num("ae", 3), lit("-555-"), num("af", 4), lit("-"), num("ag", 4)),
    ]
    row = lambda text, label: F.struct(
        F.concat(pick(4), lit(" "), pick(5), lit(" "), text, lit(" "), pick(6)).alias("text"), lit(label).alias("label")
    )
    made = base.select(F.explode(F.array(*(row(x, 1) for x in secret), *(row(x, 0) for x in other))).alias("r"))
    return made.select("r.text", "r.label")


def fit_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> PipelineModel | None:
    """A random forest on labelled findings (text, label); None without findings of both labels."""
    rows = stage(with_features(candidates(findings, "text", ("label",))).select("label", *FEATURES), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_features"), forest]).fit(rows)


def judge(found: DataFrame, model: PipelineModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """``found`` with the forest's score and whether it reaches the threshold; without a model all are secrets."""
    columns = found.columns
    if model is None:
        scored = found.withColumn("score", F.lit(1.0))
    else:
        scored = model.transform(with_features(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*columns, "score", (F.col("score") >= threshold).cast("int").alias("secret"))


def scan(docs: DataFrame, model: PipelineModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word, candidate, before, score, secret): every candidate of every row, judged.

    Null and empty texts have none. Repeated rows and null ids are reported as
    they are; a candidate that repeats is reported at each word. Other columns
    are ignored. No shuffle: a row's words stay in its task.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return judge(candidates(rows, "_text", ("_id",)), model).withColumnRenamed("_id", id_col)


def redact(docs: DataFrame, model: PipelineModel | None, text_col: str = "text", mask: str = MASK, chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret of a text replaced by ``mask``, wherever it stands in it.

    All rows and columns stay; ``chars_col``, where present, is counted again
    in texts that change. Texts that can't hold a candidate pass straight
    through; the others meet their secrets by a digest of the text, one row for
    each different text, so copies add nothing and adaptive execution splits
    large groups.
    """
    mark = fresh(docs, "digest")
    maybe = docs.where(suspicious(F.col(text_col))).withColumn(mark, F.sha2(F.col(text_col), 256))
    found = judge(candidates(maybe.select(F.col(mark).alias("_key"), F.col(text_col).alias("_text")), "_text", ("_key",)), model)
    secrets = found.where("secret = 1").groupBy("_key", "candidate").agg(F.lit(1))
    # The secrets of one text, longest first so that none hides inside another.
    longest = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)
    per_text = stage(secrets.groupBy("_key").agg(F.array_sort(F.collect_list("candidate"), longest).alias("_secrets")), "secrets")
    joined = maybe.join(per_text, maybe[mark] == per_text["_key"], "left")
    # A blank in a secret stands for any run of blanks.
    quoted = lambda s: F.concat(F.lit(r"\Q"), F.replace(F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(" "), F.lit(r"\E[\x20\x09-\x0D]+\Q")), F.lit(r"\E"))
    spaced = lambda text, s: F.regexp_replace(text, quoted(s), F.lit(re.sub(r"([\\$])", r"\\\1", mask)))
    masked = lambda text, s: F.when(F.contains(s, F.lit(" ")), spaced(text, s)).otherwise(F.replace(text, s, F.lit(mask)))
    clean = F.aggregate("_secrets", F.col(text_col), masked)
    made = joined.withColumn(text_col, F.when(F.col("_secrets").isNull(), F.col(text_col)).otherwise(clean))
    if chars_col in docs.columns:
        counted = F.length(F.col(text_col)).cast(docs.schema[chars_col].dataType)
        made = made.withColumn(chars_col, F.when(F.col("_secrets").isNull(), F.col(chars_col)).otherwise(counted))
    return made.select(*docs.columns).union(docs.where(~suspicious(F.col(text_col))))
