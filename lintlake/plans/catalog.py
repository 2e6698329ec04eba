"""The registered queries, each over the whole of the driver's tables, and the SQL that checks them."""

from __future__ import annotations

import io
import warnings
import zipfile
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import FNV_OFFSET
from ..operators import blocks, clones, metrics, rules, scoring, store, views
from ..parse.udf import parse
from ..options import DEFAULT_PROFILE, CustomProfile, MetricRule
from ..report import json_rows
from ..session import materialize, scratch_path, spread
from ..sources import listing
from ..sources.ignore import IgnoreRule, ignored, in_excluded_directory
from . import samples as G
from . import sqltext as S
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def big(column):
    return column.cast("bigint")


# sources and filters


@query("q01_source_scan", "SELECT source AS project_key, doc_id, lang FROM documents WHERE lang IN ('en', 'de') ORDER BY source, doc_id")
def q01(spark, d):
    return T.read(spark, d, "documents").where(F.col("lang").isin("en", "de")).select(F.col("source").alias("project_key"), "doc_id", "lang").orderBy(F.collate("project_key", "UNICODE"), "doc_id")


@query("q02_scanned_skipped", "SELECT CAST(count(*) AS BIGINT) AS scanned, CAST(count(*) FILTER (lang IS NULL OR lang NOT IN ('en', 'de')) AS BIGINT) AS skipped FROM documents")
def q02(spark, d):
    return T.read(spark, d, "documents").agg(F.count("*").alias("scanned"), F.count_if(~F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))).alias("skipped"))


IGNORE = (
    IgnoreRule("", 0, "fr", False, True, False),
    IgnoreRule("", 1, "de/1*", False, False, True),
    IgnoreRule("", 2, "*7", False, False, False),
    IgnoreRule("", 3, "*17", True, False, False),
    IgnoreRule("en", 4, "2?", False, False, False),
)


@query(
    "q03_ignore_rules",
    """
WITH p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^[a-z]+://[^/]+/([^?#]*[^?#/])', 1) AS path FROM pages),
d AS (SELECT page_id, path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^([^/]*)/', 1) ELSE '' END AS dir FROM p)
SELECT page_id, path,
  CASE WHEN regexp_matches(path, '^en/(?:[^/]*/)*2[^/](?:/.*)?$') THEN TRUE WHEN regexp_matches(path, '^(?:[^/]*/)*[^/]*17(?:/.*)?$') THEN FALSE
       WHEN regexp_matches(path, '^(?:[^/]*/)*[^/]*7(?:/.*)?$') THEN TRUE WHEN regexp_matches(path, '^de/1[^/]*$') THEN TRUE ELSE FALSE END
  OR CASE WHEN regexp_matches(dir, '17$') THEN FALSE WHEN regexp_matches(dir, '7$') THEN TRUE ELSE dir = 'fr' END AS ignored
FROM d""",
)
def q03(spark, d):
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://[^/]+/([^?#]*[^?#/])", 1)
    df = T.read(spark, d, "pages").select("page_id", path.alias("path"))
    return df.select("page_id", "path", (ignored(list(IGNORE), F.col("path")) | in_excluded_directory(F.col("path"))).alias("ignored"))


EXTENSIONS = [".py", ".java", ".CPP", ".h", ".txt", ".hxx", ""]


@query(
    "q04_extension_language",
    f"""
WITH p AS (SELECT doc_id, source || '/' || doc_id || {EXTENSIONS}[CAST(doc_id % 7 AS INTEGER) + 1] AS path, lower({EXTENSIONS}[CAST(doc_id % 7 AS INTEGER) + 1]) AS e FROM documents)
SELECT doc_id, path, CASE e WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.cpp' THEN 'cpp' WHEN '.hxx' THEN 'cpp' WHEN '.h' THEN 'c' END AS language FROM p""",
)
def q04(spark, d):
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 7 + 1).cast("int"))
    df = T.read(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"))
    return df.withColumn("language", X.language_of(F.col("path")))


# lines and structure


@query("q05_line_metrics", f"WITH {S.METRICS} SELECT doc_id, totalLines AS total_lines, totalLines - blank AS code_lines FROM met")
def q05(spark, d):
    lines = X.lines(F.col("text"))
    code = F.filter("lines", lambda x: ~X.is_blank(x))
    return T.documents(spark, d).select("doc_id", lines.alias("lines")).select("doc_id", big(F.size("lines")).alias("total_lines"), big(F.size(code)).alias("code_lines"))


@query(
    "q06_comment_density",
    f"""
WITH c AS (SELECT conv_id, turn, role, {S.lines("coalesce(text, '')")} AS l FROM conversations),
n AS (SELECT conv_id, turn, CAST(len(l) AS BIGINT) AS total, CAST(len(list_filter(l, lambda x: {S.comment("x", "CASE WHEN role = 'user' THEN 'python' ELSE 'java' END")})) AS BIGINT) AS comments FROM c)
SELECT conv_id, turn, comments, CASE WHEN total > 0 THEN comments / total ELSE 0.0 END AS density FROM n""",
)
def q06(spark, d):
    language = F.when(F.col("role") == "user", "python").otherwise("java")
    df = T.read(spark, d, "conversations").select("conv_id", "turn", language.alias("language"), X.lines(F.coalesce("text", F.lit(""))).alias("lines"))
    n = big(F.size(F.filter("lines", lambda x: X.pure_comment(x, F.col("language")))))
    df = df.select("conv_id", "turn", n.alias("comments"), F.size("lines").alias("total"))
    return df.select("conv_id", "turn", "comments", F.when(F.col("total") > 0, F.col("comments") / F.col("total")).otherwise(F.lit(0.0)).alias("density"))


@query(
    "q07_structure_counts",
    """
SELECT regexp_extract(coalesce(html, ''), '<html lang="([a-z]*)"', 1) AS language, CAST(count(*) AS BIGINT) AS files,
  CAST(sum(len(regexp_extract_all(html, '<p[ >]'))) AS BIGINT) AS paragraphs, CAST(sum(len(regexp_extract_all(html, '<a[ >]'))) AS BIGINT) AS links,
  CAST(sum(len(regexp_extract_all(html, '<(div|article|nav|footer)[ >]'))) AS BIGINT) AS sections
FROM pages GROUP BY 1""",
)
def q07(spark, d):
    count = lambda p: F.sum(F.regexp_count("html", F.lit(p))).cast("bigint")
    df = T.read(spark, d, "pages").withColumn("language", F.regexp_extract(F.coalesce("html", F.lit("")), '<html lang="([a-z]*)"', 1))
    return df.groupBy("language").agg(F.count("*").alias("files"), count("<p[ >]").alias("paragraphs"), count("<a[ >]").alias("links"), count("<(div|article|nav|footer)[ >]").alias("sections"))


@query(
    "q08_unit_spans",
    f"""
WITH c AS (SELECT conv_id, turn, role, CAST(len({S.lines("coalesce(text, '')")}) AS BIGINT) AS n FROM conversations),
s AS (SELECT conv_id, turn, role, n, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_line FROM c)
SELECT conv_id, turn, role, end_line - n + 1 AS start_line, end_line FROM s""",
)
def q08(spark, d):
    df = T.read(spark, d, "conversations").select("conv_id", "turn", "role", big(F.size(X.lines(F.coalesce("text", F.lit(""))))).alias("n"))
    end = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn"))
    return df.withColumn("end_line", end).select("conv_id", "turn", "role", (F.col("end_line") - F.col("n") + 1).alias("start_line"), "end_line")


@query(
    "q09_complexity",
    f"""SELECT doc_id, CAST(1 + len(list_filter({S.WORDS}, lambda w: list_contains({list(T.DECISIONS)}, w))) + len(regexp_extract_all(coalesce(text, ''), '&&|\\|\\|')) AS BIGINT) AS complexity FROM documents""",
)
def q09(spark, d):
    decided = F.size(F.filter(T.words(F.col("text")), lambda w: w.isin(*T.DECISIONS)))
    return T.documents(spark, d).select("doc_id", big(1 + decided + F.regexp_count("text", F.lit(r"&&|\|\|"))).alias("complexity"))


@query(
    "q10_nesting_depth",
    """
WITH t AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '</?(?:nav|ul|li|div|article|footer)[ >]') AS tags FROM pages),
e AS (SELECT page_id, i, CASE WHEN starts_with(tags[i], '</') THEN -1 ELSE 1 END AS v FROM (SELECT page_id, tags, unnest(range(1, len(tags) + 1)) AS i FROM t)),
r AS (SELECT page_id, sum(v) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM e)
SELECT t.page_id, CAST(coalesce(max(depth), 0) AS BIGINT) AS nesting_depth FROM t LEFT JOIN r ON r.page_id = t.page_id GROUP BY t.page_id""",
)
def q10(spark, d):
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("</?(?:nav|ul|li|div|article|footer)[ >]"), F.lit(0))
    state = F.struct(F.lit(0).alias("now"), F.lit(-(2**31)).alias("top"))

    def step(s, tag):
        now = s["now"] + F.when(tag.startswith("</"), -1).otherwise(1)
        return F.struct(now.alias("now"), F.greatest(s["top"], now).alias("top"))

    top = F.aggregate(tags, state, step, lambda s: s["top"])
    return T.read(spark, d, "pages").select("page_id", big(F.when(F.size(tags) > 0, top).otherwise(F.lit(0))).alias("nesting_depth"))


@query(
    "q11_project_metrics",
    f"""WITH {S.METRICS}
SELECT project_key, CAST(sum(totalLines) AS BIGINT) AS "totalLines", CAST(sum(totalLines - blank - commentLines) AS BIGINT) AS ncloc, CAST(sum(commentLines) AS BIGINT) AS "commentLines",
  CASE WHEN sum(totalLines) > 0 THEN sum(commentLines) / sum(totalLines) ELSE 0.0 END AS "commentDensity", CAST(count(*) AS BIGINT) AS "functionCount", CAST(0 AS BIGINT) AS "classCount",
  sum(complexity) / count(*) AS "avgComplexity", CAST(max(complexity) AS BIGINT) AS "maxComplexity",
  CAST(count(*) FILTER (complexity > 20) AS BIGINT) AS "overComplexFunctions", CAST(count(*) FILTER (totalLines > 150) AS BIGINT) AS "overLongFunctions", CAST(count(*) FILTER (nesting > 6) AS BIGINT) AS "deeplyNestedFunctions",
  CAST(0 AS DOUBLE) AS "cloneRate" FROM met GROUP BY project_key""",
)
def q11(spark, d):
    return metrics.project_metrics(T.line_metrics(spark, d), spark.createDataFrame([], "project_key string, clone_rate double"), DEFAULT_PROFILE)


@query(
    "q12_threshold_counts",
    r"""
WITH c AS (SELECT conv_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS n, length(coalesce(text, '')) AS chars FROM conversations)
SELECT conv_id, CAST(count(*) FILTER (n > 50) AS BIGINT) AS over_words, CAST(count(*) FILTER (chars > 400) AS BIGINT) AS over_chars FROM c GROUP BY conv_id""",
)
def q12(spark, d):
    text = F.coalesce("text", F.lit(""))
    df = T.read(spark, d, "conversations").select("conv_id", F.size(T.words(text)).alias("n"), F.length(text).alias("chars"))
    return df.groupBy("conv_id").agg(F.count_if(F.col("n") > 50).alias("over_words"), F.count_if(F.col("chars") > 400).alias("over_chars"))


# clones


@query(
    "q13_token_classes",
    r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]') AS t FROM documents)
SELECT doc_id, CAST(len(list_filter(t, lambda x: regexp_matches(x, '^\p{L}'))) AS BIGINT) AS n_id, CAST(len(list_filter(t, lambda x: regexp_matches(x, '^\p{N}'))) AS BIGINT) AS n_num,
  CAST(len(list_filter(t, lambda x: NOT regexp_matches(x, '^[\p{L}\p{N}]'))) AS BIGINT) AS n_other FROM t""",
)
def q13(spark, d):
    kind = lambda x: F.when(x.rlike(r"^\p{L}"), "identifier").when(x.rlike(r"^\p{N}"), "number").otherwise(x)
    t = F.regexp_extract_all("text", F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"), F.lit(0))
    df = T.documents(spark, d).select("doc_id", F.transform(t, lambda x: clones.token_value(kind(x))).alias("v"))
    n = lambda f: big(F.size(F.filter("v", f)))
    return df.select("doc_id", n(lambda x: x == "ID").alias("n_id"), n(lambda x: x == "NUM").alias("n_num"), n(lambda x: ~x.isin("ID", "NUM")).alias("n_other"))


@query("q14_gram_hashes", f"WITH {S.GRAMS} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_grams, CAST(min(h) AS BIGINT) AS low, CAST(max(h) AS BIGINT) AS high, CAST(sum(h) AS BIGINT) AS total FROM grams GROUP BY doc_id")
def q14(spark, d):
    total = F.aggregate("k_gram_hashes", F.lit(0).cast("bigint"), lambda s, h: s + h)
    df = T.token_sets(spark, d).where(F.size("k_gram_hashes") > 0)
    return df.select("doc_id", big(F.size("k_gram_hashes")).alias("n_grams"), F.array_min("k_gram_hashes").alias("low"), F.array_max("k_gram_hashes").alias("high"), total.alias("total"))


@query("q15_minhash", f"WITH {S.GRAMS}, {S.SIGNATURE} SELECT doc_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY s) AS signature FROM sig GROUP BY doc_id")
def q15(spark, d):
    return T.signed_sets(spark, d).where(F.size("signature") > 0).select("doc_id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query("q16_bands", f"WITH {S.GRAMS}, {S.SIGNATURE}, {S.BANDS} SELECT file, band, band_key FROM bands")
def q16(spark, d):
    return clones.bands(T.signed_sets(spark, d), ["file"])


def _representatives(sets):
    return clones.representatives(sets, clones.classes(sets, ["project_key"], "file", "k_gram_hashes"), ["project_key"], "file")


@query(
    "q17_lsh_candidates",
    f"""WITH {S.GRAMS}, {S.SIGNATURE}, {S.BANDS},
cls AS (SELECT project_key, file, min(file) OVER (PARTITION BY project_key, k) AS class_id FROM (SELECT project_key, file, list_sort(list(h)) AS k FROM grams GROUP BY ALL)),
rep AS (SELECT bands.* FROM bands JOIN cls ON cls.project_key = bands.project_key AND cls.file = bands.file AND cls.class_id = cls.file)
SELECT DISTINCT a.project_key, a.file AS id_a, b.file AS id_b FROM rep a JOIN rep b ON a.project_key = b.project_key AND a.band = b.band AND a.band_key = b.band_key AND a.file < b.file""",
)
def q17(spark, d):
    return clones.lsh_pairs(_representatives(T.signed_sets(spark, d)), ["project_key"], "file")


CLASSES = "cls AS MATERIALIZED (SELECT project_key, file, min(file) OVER (PARTITION BY project_key, k) AS class_id FROM (SELECT project_key, file, list_sort(list(h)) AS k FROM grams GROUP BY ALL))"


@query(
    "q18_exact_pairs",
    f"""WITH {S.GRAMS}, {S.PAIRS}, {CLASSES}
SELECT good.project_key, file_a AS id_a, file_b AS id_b, jaccard, CAST(matching_k_grams AS BIGINT) AS matching_k_grams FROM good
SEMI JOIN (SELECT project_key, class_id FROM cls) x ON x.project_key = good.project_key AND x.class_id = file_a
SEMI JOIN (SELECT project_key, class_id FROM cls) y ON y.project_key = good.project_key AND y.class_id = file_b""",
)
def q18(spark, d):
    """Pairs between representatives of equal gram sets; q18_classes has the membership."""
    return clones.similar_pairs(_representatives(T.token_sets(spark, d)), ["project_key"], "file", "k_gram_hashes", 0.2)


@query("q18_classes", f"WITH {S.GRAMS}, {CLASSES} SELECT project_key, file, class_id FROM cls")
def q18_classes(spark, d):
    return clones.classes(T.token_sets(spark, d), ["project_key"], "file", "k_gram_hashes").drop("n")


def _sets(spark, d):
    return T.token_sets(spark, d).withColumn("signature", F.array().cast("array<bigint>"))


def _top(spark, d, sets=None, common=None):
    return clones.project_pairs(sets or _sets(spark, d), 0.2, mode="exact", common=common)


@query("q19_top_pairs", f"WITH {S.GRAMS}, {S.PAIRS}, {S.TOP} SELECT project_key, file_a, file_b, jaccard, CAST(matching_k_grams AS BIGINT) AS matching_k_grams, CAST(seq AS BIGINT) AS seq FROM top")
def q19(spark, d):
    return _top(spark, d).select("project_key", "file_a", "file_b", "jaccard", "matching_k_grams", big(F.col("seq")).alias("seq"))


HISTORY = """
hmet AS (SELECT a.project_key, a.file AS file_a, b.project_key AS from_key, b.file AS from_file, count(*) AS m FROM grams a JOIN grams b ON a.h = b.h AND a.project_key <> b.project_key GROUP BY ALL),
hsim AS (SELECT hmet.*, m / (x.n + y.n - m) AS jaccard FROM hmet JOIN cnt x ON x.project_key = hmet.project_key AND x.file = file_a JOIN cnt y ON y.project_key = from_key AND y.file = from_file),
hist AS MATERIALIZED (SELECT project_key, file_a, 'history/' || from_key || '/' || from_file AS file_b, jaccard, m AS matching_k_grams, row_number() OVER (PARTITION BY project_key ORDER BY jaccard DESC, m DESC, file_a, from_key, from_file) AS seq FROM hsim WHERE jaccard >= 0.2)
"""


def _history(spark, d, sets=None, common=None):
    sets = sets or _sets(spark, d)
    return clones.history_pairs(sets, sets, 0.2, mode="exact", common=common)


def _both(spark, d):
    """Own pairs and history of the same sets; what the sets have in common is found once, if either needs it."""
    sets = _sets(spark, d)
    common = cache(lambda: clones.common_files(sets))
    return _top(spark, d, sets, common), _history(spark, d, sets, common)


@query("q20_history_pairs", f"WITH {S.GRAMS}, {HISTORY} SELECT project_key, file_a, file_b, jaccard, CAST(matching_k_grams AS BIGINT) AS matching_k_grams, CAST(seq AS BIGINT) AS seq FROM hist WHERE seq <= 50")
def q20(spark, d):
    return _history(spark, d).select("project_key", "file_a", "file_b", "jaccard", "matching_k_grams", big(F.col("seq")).alias("seq"))


def _positions(spark, d):
    """Tokens with their lines, per document."""
    df = T.documents(spark, d).select(F.col("source").alias("project_key"), T.file_name(F.col("doc_id")).alias("file"), X.lines(F.col("text")).alias("l"))
    per = F.flatten(F.transform("l", lambda x, i: F.transform(T.words(x), lambda w: F.struct(w.alias("v"), (i + 1).alias("at")))))
    df = df.select("project_key", "file", per.alias("t"))
    return df.select("project_key", "file", F.transform("t", lambda x: x["v"]).alias("values"), F.transform("t", lambda x: x["at"]).alias("lines"))


@query(
    "q21_repeated_blocks",
    f"WITH {S.BLOCKS} SELECT project_key, file AS file_a, file AS file_b, 'block' AS kind, 1.0::DOUBLE AS jaccard, CAST(k - 11 AS BIGINT) AS matching_k_grams, s1 AS start_line_a, e1 AS end_line_a, s2 AS start_line_b, e2 AS end_line_b, CAST(rank AS BIGINT) AS rank FROM blocks",
)
def q21(spark, d):
    return blocks.block_pairs(_positions(spark, d))


RATE = """
whole AS (SELECT DISTINCT project_key, unnest([file_a, file_b]) AS file FROM top),
rate AS (SELECT met.project_key, CASE WHEN sum(totalLines - blank - commentLines) > 0 THEN least(1.0, sum(CASE WHEN whole.file IS NOT NULL THEN totalLines - blank - commentLines ELSE 0 END) / sum(totalLines - blank - commentLines)) ELSE 0.0 END AS clone_rate
  FROM met LEFT JOIN whole ON whole.project_key = met.project_key AND whole.file = met.file GROUP BY met.project_key)
"""
_M, _P = S.METRICS.replace("met0", "lm0").replace("met AS", "lm AS").replace("FROM met0", "FROM lm0"), S.PAIRS
_RATE = RATE.replace("FROM met LEFT", "FROM lm LEFT").replace("met.", "lm.")
RATES = f"WITH {S.GRAMS}, {_P}, {S.TOP}, {_M}, {_RATE}"


def _rates(spark, d):
    return clones.clone_rate(_top(spark, d), T.line_metrics(spark, d))


@query("q22_clone_rate", f"{RATES} SELECT project_key, clone_rate FROM rate")
def q22(spark, d):
    """Of the best five own pairs alone, as its SQL has it; q22_merged_rate is the rate of a report."""
    return _rates(spark, d)


def _blocks(spark, d, most=blocks.PER_FILE):
    order = Window.partitionBy("project_key").orderBy(F.collate("file_a", "UNICODE"), "file_a", "rank")
    return blocks.block_pairs(_positions(spark, d), most=most).withColumn("seq", F.row_number().over(order)).drop("rank")


def _merged(spark, d):
    """The report's list: blocks, own pairs and history; read in several branches, so written once."""
    return materialize(clones.merged_pairs(_blocks(spark, d), *_both(spark, d)), "merged")


def _merged_rates(spark, d):
    return clones.clone_rate(_merged(spark, d), T.line_metrics(spark, d))


MERGED = f"""{S.GRAMS}, {S.PAIRS}, {S.TOP}, {HISTORY}, {S.BLOCKS},
listed AS (SELECT project_key, file AS file_a, file AS file_b, 'block' AS kind, 1.0 AS jaccard, k - 11 AS m, s1, e1, s2, e2, 1 AS source_ord, row_number() OVER (PARTITION BY project_key ORDER BY file, rank) AS place FROM blocks
  UNION ALL SELECT project_key, file_a, file_b, 'file', jaccard, matching_k_grams, NULL, NULL, NULL, NULL, 2, seq FROM top UNION ALL SELECT project_key, file_a, file_b, 'file', jaccard, matching_k_grams, NULL, NULL, NULL, NULL, 3, seq FROM hist WHERE seq <= 50),
merged AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY kind DESC, jaccard DESC, m DESC, source_ord, place) AS seq FROM listed) WHERE seq <= 50)"""
MERGED_RATE = f"""{_M},
whole AS (SELECT DISTINCT project_key, unnest([file_a, file_b]) AS file FROM merged WHERE kind = 'file'),
copied AS (SELECT project_key, file, count(DISTINCT line) AS n FROM (SELECT project_key, file_a AS file, unnest(range(s1, e1 + 1) || range(s2, e2 + 1)) AS line FROM merged WHERE kind = 'block') GROUP BY ALL),
rate AS (SELECT project_key, CASE WHEN sum(own) > 0 THEN least(1.0, sum(CASE WHEN is_whole THEN own ELSE least(own, n) END) / sum(own)) ELSE 0.0 END AS clone_rate
  FROM (SELECT lm.project_key, totalLines - blank - commentLines AS own, whole.file IS NOT NULL AS is_whole, coalesce(copied.n, 0) AS n FROM lm LEFT JOIN whole ON whole.project_key = lm.project_key AND whole.file = lm.file LEFT JOIN copied ON copied.project_key = lm.project_key AND copied.file = lm.file) GROUP BY project_key)"""
MERGED_RATES = f"WITH {MERGED}, {MERGED_RATE}"


@query("q22_merged_rate", f"{MERGED_RATES} SELECT project_key, clone_rate FROM rate")
def q22_merged(spark, d):
    """The rate of the report's merged list, cut to 50 as in the report."""
    return _merged_rates(spark, d)


@query("q22_untruncated_rate")
def q22_untruncated(spark, d):
    """The rate of all file pairs, own and history, and all blocks, no list cut: tested by brute force, no SQL."""
    cloned = clones.cloned_files(T.token_sets(spark, d), 0.2)
    return clones.clone_rate(cloned.unionByName(_blocks(spark, d, most=None).drop("seq")), T.line_metrics(spark, d))


# rules


@query(
    "q23_text_rules",
    r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id, 'secret' AS rule_id FROM t WHERE regexp_matches(x, '(?i)(?:password|passwd|secret|token|api[_-]?key|credential)') AND regexp_matches(x, '["''][^"'']+["'']')
UNION ALL SELECT doc_id, 'malloc' FROM t WHERE regexp_matches(x, '(?:^|[^A-Za-z0-9_])(?:the|die)\s+[a-z]') AND NOT regexp_matches(x, '(?:^|[^A-Za-z0-9_])free\s')
UNION ALL SELECT doc_id, 'secret-assign' FROM t WHERE regexp_matches(x, '(?i)(?:password|passwd|secret|token|api[_-]?key)\s*[:=]')
UNION ALL SELECT page_id, 'page-script' FROM pages WHERE regexp_matches(coalesce(html, ''), '<script[ >]')""",
)
def q23(spark, d):
    x = F.col("text")
    df = T.documents(spark, d)
    tests = {"secret": x.rlike(rules.CREDENTIAL) & x.rlike(rules.QUOTED), "malloc": x.rlike(rf"{rules.LEFT}(?:the|die)\s+[a-z]") & ~x.rlike(rf"{rules.LEFT}free\s"), "secret-assign": x.rlike(r"(?i)(?:password|passwd|secret|token|api[_-]?key)\s*[:=]")}
    hits = F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()])
    out = df.select("doc_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("rule_id"))
    page = T.read(spark, d, "pages").where(F.coalesce("html", F.lit("")).rlike("<script[ >]"))
    return out.union(page.select(F.col("page_id").alias("doc_id"), F.lit("page-script").alias("rule_id")))


@query(
    "q24_metric_rules",
    r"""
WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM conversations)
SELECT conv_id, turn, 'long' AS rule_id, 'The turn is too long: ' || len(w) AS message FROM c WHERE len(w) > 100
UNION ALL SELECT conv_id, turn, 'many', 'The turn has too many words: ' || len(list_distinct(w)) FROM c WHERE len(list_distinct(w)) > 60""",
)
def q24(spark, d):
    df = T.read(spark, d, "conversations").select("conv_id", "turn", T.words(F.coalesce("text", F.lit(""))).alias("w"))
    n, k = F.size("w"), F.size(F.array_distinct("w"))
    row = lambda rule, text, v: F.struct(F.lit(rule).alias("rule_id"), F.concat(F.lit(text), v.cast("string")).alias("message"))
    hits = F.array(F.when(n > 100, row("long", "The turn is too long: ", n)), F.when(k > 60, row("many", "The turn has too many words: ", k)))
    return df.select("conv_id", "turn", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("conv_id", "turn", "h.*")


FINDING_COLUMNS = 'project_key, id, ruleId, severity, type, file, line, "column", message, snippet'


def _findings(spark, d):
    return rules.distinct_findings(T.line_findings(spark, d))


@query("q25_finding_dedupe", f"WITH {S.FOUND} SELECT {FINDING_COLUMNS} FROM finding")
def q25(spark, d):
    return _findings(spark, d)


@query("q26_sorted_findings", f'WITH {S.FOUND} SELECT file, line, "column", ruleId, snippet FROM finding ORDER BY file, line, "column", ruleId')
def q26(spark, d):
    return rules.sort_findings(_findings(spark, d)).select("file", "line", "column", "ruleId", "snippet")


@query("q27_by_severity", f"WITH {S.FOUND} SELECT project_key, severity, CAST(count(*) AS BIGINT) AS n FROM finding GROUP BY ALL")
def q27(spark, d):
    return scoring.findings_by_severity(_findings(spark, d)).select("project_key", "severity", "n")


def _deductions(spark, d, profile, rates=_rates):
    files = T.line_metrics(spark, d)
    projects = metrics.project_metrics(files, rates(spark, d), profile)
    return scoring.deductions(projects, files, _findings(spark, d), profile)


def _deduction_sql(penalties: str, complexity: tuple | None, length: tuple | None, nesting: tuple | None, rate: tuple | None, rates: str = RATES) -> str:
    parts = [f"SELECT project_key, 'finding' AS category, severity || ' findings' AS label, CAST(count(*) AS BIGINT) AS n, count(*) * {penalties} AS points FROM finding GROUP BY project_key, severity"]
    for rule, column, label in ((complexity, "complexity", "Functions over the complexity limit"), (length, "totalLines", "Functions over the length limit"), (nesting, "nesting", "Functions over the nesting limit")):
        if rule:
            parts.append(f"SELECT project_key, 'metric', '{label}', CAST(count(*) FILTER ({column} > {rule[0]}) AS BIGINT), count(*) FILTER ({column} > {rule[0]}) * {rule[1]} FROM lm GROUP BY project_key")
    if rate:
        parts.append(f"SELECT project_key, 'metric', 'Clone rate over the limit', NULL, greatest(0.0, clone_rate - {rate[0]}) * {rate[1]} FROM rate")
    return f"{rates}, {S.FOUND}, ded AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE points > 0), tot AS (SELECT rate.project_key, greatest(0.0, least(100.0, 100.0 - coalesce(sum(points), 0.0))) AS score FROM rate LEFT JOIN ded ON ded.project_key = rate.project_key GROUP BY rate.project_key)"


PENALTY = "CASE severity WHEN 'BLOCKER' THEN 5.0::DOUBLE WHEN 'CRITICAL' THEN 3.0::DOUBLE WHEN 'MAJOR' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END"
DEFAULT_RULES = (PENALTY, (20, "1.0::DOUBLE"), (150, "0.5::DOUBLE"), (6, "0.5::DOUBLE"), ("0.2::DOUBLE", "10.0::DOUBLE"))
DEFAULT_SQL, DEFAULT_MERGED = _deduction_sql(*DEFAULT_RULES), _deduction_sql(*DEFAULT_RULES, MERGED_RATES)
CUSTOM = CustomProfile(finding_penalties={"MINOR": 0.25}, metric_rules={"maxComplexity": MetricRule(100, 2), "cloneRate": MetricRule(0.1, 4)}, pass_score=75)
CUSTOM_RULES = (PENALTY.replace("0.5::DOUBLE", "0.25::DOUBLE"), (100, "2.0::DOUBLE"), None, None, ("0.1::DOUBLE", "4.0::DOUBLE"))
CUSTOM_SQL, CUSTOM_MERGED = _deduction_sql(*CUSTOM_RULES), _deduction_sql(*CUSTOM_RULES, MERGED_RATES)


_Q28 = " SELECT project_key, category, label, coalesce(n, 0) AS n, round(points, 6) AS points FROM ded"


@query("q28_deductions", DEFAULT_SQL + _Q28)
def q28(spark, d, rates=_rates):
    df = _deductions(spark, d, DEFAULT_PROFILE, rates).select("project_key", F.explode("deductions").alias("x"))
    return df.select("project_key", "x.category", "x.label", F.coalesce("x.count", F.lit(0)).alias("n"), F.round("x.points", 6).alias("points"))


_Q29 = " SELECT project_key, round(score, 6) AS score, score >= 60 AS passed, CAST(CASE WHEN score >= 60 THEN 0 ELSE 1 + (SELECT count(*) FROM ded WHERE ded.project_key = tot.project_key) END AS BIGINT) AS n_reasons FROM tot"


@query("q29_score_gate", DEFAULT_SQL + _Q29)
def q29(spark, d, rates=_rates):
    df = scoring.gate(_deductions(spark, d, DEFAULT_PROFILE, rates), DEFAULT_PROFILE)
    return df.select("project_key", F.round("score", 6).alias("score"), "passed", big(F.size("failure_reasons")).alias("n_reasons"))


_Q30 = " SELECT project_key, 'custom' AS profile_id, round(score, 6) AS score, 75.0::DOUBLE AS pass_score, score >= 75 AS passed FROM tot"


@query("q30_custom_score", CUSTOM_SQL + _Q30)
def q30(spark, d, rates=_rates):
    profile = CUSTOM.profile()
    df = scoring.gate(_deductions(spark, d, profile, rates), profile)
    return df.select("project_key", "profile_id", F.round("score", 6).alias("score"), "pass_score", "passed")


# the same by the merged list's rate


@query("q28_merged_deductions", DEFAULT_MERGED + _Q28)
def q28_merged(spark, d):
    return q28(spark, d, _merged_rates)


@query("q29_merged_score_gate", DEFAULT_MERGED + _Q29)
def q29_merged(spark, d):
    return q29(spark, d, _merged_rates)


@query("q30_merged_custom_score", CUSTOM_MERGED + _Q30)
def q30_merged(spark, d):
    return q30(spark, d, _merged_rates)


# store


def _stored(spark, d):
    df = T.documents(spark, d)
    return df.select(F.col("source").alias("project_key"), T.file_name(F.col("doc_id")).alias("file"), F.col("lang").alias("language"), F.length("text").cast("bigint").alias("ncloc"))


@query(
    "q31_store_upsert",
    f"""
WITH s AS (SELECT source AS project_key, {S.FILE} AS file, lang AS language, CAST(length(coalesce(text, '')) AS BIGINT) AS ncloc FROM documents),
fresh AS (SELECT project_key, file || '-new' AS file, language, ncloc + 1 AS ncloc FROM s WHERE project_key IN ('src1', 'src2'))
SELECT * FROM s WHERE project_key NOT IN ('src1', 'src2', 'src3') UNION ALL SELECT * FROM fresh""",
)
def q31(spark, d):
    """Two projects are replaced; a third, that is saved without files, is emptied."""
    stored = _stored(spark, d)
    fresh = stored.where(F.col("project_key").isin("src1", "src2")).withColumns({"file": F.concat("file", F.lit("-new")), "ncloc": F.col("ncloc") + 1})
    return store.replaced(stored, fresh, spark.createDataFrame([("src1",), ("src2",), ("src3",)], "project_key string"))


@query(
    "q32_store_load",
    f"""
WITH p AS (SELECT source AS project_key, max(doc_id) AS updated FROM documents GROUP BY source),
f AS (SELECT source AS project_key, {S.FILE} AS file, n_chars FROM documents),
e AS (SELECT event_type, CAST(count(*) AS BIGINT) AS n_props FROM events WHERE props IS NOT NULL AND json_valid(props) GROUP BY event_type)
SELECT p.project_key, CAST(updated AS BIGINT) AS updated, file, CAST(n_chars AS BIGINT) AS n_chars, CAST((SELECT sum(n_props) FROM e) AS BIGINT) AS n_props FROM f JOIN p ON p.project_key = f.project_key ORDER BY p.project_key, file""",
)
def q32(spark, d):
    docs = T.documents(spark, d)
    projects = docs.groupBy(F.col("source").alias("project_key")).agg(F.max("doc_id").alias("updated"))
    files = docs.select(F.col("source").alias("project_key"), T.file_name(F.col("doc_id")).alias("file"), big(F.col("n_chars")).alias("n_chars"))
    valid = F.from_json("props", "map<string,string>").isNotNull()
    n = T.read(spark, d, "events").agg(F.count_if(F.coalesce(valid, F.lit(False))).alias("n"))
    return files.join(projects, "project_key").withColumn("n_props", n.select(big(F.col("n"))).scalar()).select("project_key", "updated", "file", "n_chars", "n_props").orderBy("project_key", "file")


@query(
    "q33_legacy_import",
    f"""
WITH s AS (SELECT source AS project_key, {S.FILE} AS file, lang AS language, CAST(n_chars AS BIGINT) AS ncloc, doc_id FROM documents)
SELECT project_key, file, language, ncloc, CAST(1 AS BIGINT) AS n_hashes FROM s WHERE doc_id % 3 <> 0 AND project_key NOT IN ('src0', 'src4')""",
)
def q33(spark, d):
    """Legacy documents, one per file; every third has no hashes and is dropped, two projects are there already."""
    docs = T.documents(spark, d)
    hashes = F.when(F.col("doc_id") % 3 != 0, F.array(F.lit(FNV_OFFSET)))
    file = F.struct(T.file_name(F.col("doc_id")).alias("file"), F.col("lang").alias("language"), F.lit(1).alias("tokenCount"), hashes.alias("kGramHashes"), F.array(F.lit(1)).alias("signature"), F.col("n_chars").alias("ncloc"))
    project = F.struct(F.col("source").alias("projectKey"), F.lit("2024-01-01T00:00:00Z").alias("updatedAt"), F.array(file).alias("files"))
    legacy = docs.select(F.to_json(F.struct(F.lit(1).alias("version"), F.create_map(F.col("source"), project).alias("projects"))).alias("value"))
    present = spark.createDataFrame([("src0",), ("src4",)], "project_key string")
    rows = store.legacy_rows(legacy).join(present, "project_key", "left_anti")
    return rows.select("project_key", "file", "language", "ncloc", big(F.size("k_gram_hashes")).alias("n_hashes"))


# views and report


@query("q34_findings_filter", f"WITH {S.FOUND} SELECT project_key, file, line, ruleId, message FROM finding WHERE severity = 'MAJOR' AND lang = 'en' AND contains(lower(ruleId || ' ' || file || ' ' || message), 'signs d')")
def q34(spark, d):
    files = T.documents(spark, d).select(F.col("source").alias("project_key"), T.file_name(F.col("doc_id")).alias("file"), F.col("lang").alias("language"))
    return views.filter_findings(_findings(spark, d), files, severity="MAJOR", language="en", text="Signs d").select("project_key", "file", "line", "ruleId", "message")


@query("q35_pagination", "SELECT doc_id, source, CAST((SELECT greatest(1, ceil(count(*) / 10)) FROM documents) AS BIGINT) AS pages FROM documents ORDER BY doc_id LIMIT 10 OFFSET 20")
def q35(spark, d):
    docs = T.read(spark, d, "documents")
    pages = docs.agg(views.page_count(F.count("*")).alias("pages"))
    return views.page(docs.select("doc_id", "source"), 3, F.col("doc_id")).withColumn("pages", pages.scalar())


@query("q36_distinct_files", f"WITH {S.FOUND} SELECT DISTINCT file FROM finding ORDER BY file")
def q36(spark, d):
    return views.distinct_files(_findings(spark, d))


REPORT_FIELDS = "struct<projectKey:string,metrics:struct<totalLines:bigint,ncloc:bigint,cloneRate:double>,fileMetrics:array<struct<file:string,ncloc:bigint>>,findings:array<struct<id:string,line:bigint>>,clonePairs:array<struct<fileA:string,fileB:string,kind:string,jaccardSimilarity:double,matchingKGrams:bigint,startLineA:bigint,endLineB:bigint>>,score:struct<score:double,passed:boolean,maxScore:double,passScore:double,failureReasons:array<string>>>"


@query(
    "q37_report_json",
    f"""{DEFAULT_MERGED},
f AS (SELECT project_key, count(*) AS n_files, string_agg(file, ',' ORDER BY file) AS files, sum(totalLines) AS lines, sum(totalLines - blank - commentLines) AS code FROM lm GROUP BY project_key),
g AS (SELECT project_key, count(*) AS n, string_agg(id, ',' ORDER BY file, line, "column", ruleId) AS ids FROM finding GROUP BY project_key),
p AS (SELECT project_key, string_agg(concat_ws(':', file_a, file_b, kind, m, s1, e2), ',' ORDER BY seq) AS pairs, sum(jaccard) AS similarity FROM merged GROUP BY project_key)
SELECT rate.project_key, CAST(lines AS BIGINT) AS total_lines, CAST(code AS BIGINT) AS ncloc, round(clone_rate, 9) AS clone_rate, files, coalesce(ids, '') AS findings, coalesce(pairs, '') AS pairs, round(coalesce(similarity, 0.0), 6) AS similarity, round(score, 6) AS score, score >= 60 AS passed,
  CAST(CASE WHEN score >= 60 THEN 0 ELSE 1 + (SELECT count(*) FROM ded WHERE ded.project_key = rate.project_key) END AS BIGINT) AS n_reasons
FROM rate JOIN tot ON tot.project_key = rate.project_key JOIN f ON f.project_key = rate.project_key LEFT JOIN g ON g.project_key = rate.project_key LEFT JOIN p ON p.project_key = rate.project_key""",
)
def q37(spark, d):
    """The report documents, read back by their field names."""
    r = reports(spark, d).select("project_key", F.from_json("report", REPORT_FIELDS).alias("r")).select("project_key", "r.*")
    pair = lambda x: F.concat_ws(":", x["fileA"], x["fileB"], x["kind"], x["matchingKGrams"].cast("string"), x["startLineA"].cast("string"), x["endLineB"].cast("string"))
    listed = lambda c, f: F.array_join(F.transform(c, f), ",")
    similarity = F.aggregate("clonePairs", F.lit(0.0), lambda s, x: s + x["jaccardSimilarity"])
    return r.select(
        "project_key", F.col("metrics.totalLines").alias("total_lines"), F.col("metrics.ncloc").alias("ncloc"), F.round("metrics.cloneRate", 9).alias("clone_rate"),
        listed("fileMetrics", lambda x: x["file"]).alias("files"), listed("findings", lambda x: x["id"]).alias("findings"), listed("clonePairs", pair).alias("pairs"), F.round(similarity, 6).alias("similarity"),
        F.round("score.score", 6).alias("score"), F.col("score.passed").alias("passed"), big(F.size("score.failureReasons")).alias("n_reasons"),
    )


def reports(spark, d):
    """(project_key, report) of all projects."""
    files = T.line_metrics(spark, d)
    pairs = _merged(spark, d)
    projects = metrics.project_metrics(files, clones.clone_rate(pairs, files), DEFAULT_PROFILE)
    found = _findings(spark, d)
    scores = scoring.score_projects(projects, files, found, DEFAULT_PROFILE)
    return json_rows(projects, files.drop("doc_id"), found, pairs, scores)


@query(
    "q38_formats",
    """
WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h FROM pages)
SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(h, '<title>([^<]*)', 1) || '<' || u || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
  CASE WHEN length(h) % 2 = 0 THEN u || ':' || length(h) || '-' || (length(h) + 1) ELSE u END AS location, regexp_replace(regexp_replace(u, '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS file_name FROM p""",
)
def q38(spark, d):
    h, u = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    n = F.length(h)
    text = F.concat(F.regexp_extract(h, "<title>([^<]*)", 1), F.lit("<"), u, F.lit(">"))
    return T.read(spark, d, "pages").select("page_id", X.escape_html(text).alias("escaped"), X.location(u, F.when(n % 2 == 0, n), n + 1).alias("location"), X.report_name(u).alias("file_name"))


@query(
    "q38_numbers",
    "SELECT l_orderkey, l_linenumber, format('{:,.2f}', round(l_extendedprice, 2)) AS price, format('{:,.0f}', round(l_quantity, 0)) AS quantity, format('{:,.1f}', round(l_discount * 100, 1)) || '%' AS discount FROM lineitem",
)
def q38_numbers(spark, d):
    df = T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.number(F.col("l_extendedprice"), 2).alias("price"), X.number(F.col("l_quantity")).alias("quantity"), X.percent(F.col("l_discount")).alias("discount"))
    return df


@query(
    "q39_language_rules",
    "WITH n AS (SELECT CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'java' WHEN 'fr' THEN 'c' ELSE 'cpp' END AS language, count(*) AS files FROM documents GROUP BY 1), r AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{r.rule_id}', '{r.severity}', '{r.language}')" for r in rules.all_rules())
    + ") t(rule_id, severity, language)) SELECT r.language, rule_id, severity, CAST(files AS BIGINT) AS files FROM n JOIN r ON r.language = n.language",
)
def q39(spark, d):
    language = F.when(F.col("lang") == "en", "python").when(F.col("lang") == "de", "java").when(F.col("lang") == "fr", "c").otherwise("cpp")
    n = T.read(spark, d, "documents").groupBy(language.alias("language")).agg(F.count("*").alias("files"))
    return rules.catalogue(spark).join(n, "language").select("language", "rule_id", "severity", "files")


@query(
    "q40_lsh_recall",
    f"""WITH {S.GRAMS}, {S.PAIRS}, {S.SIGNATURE}, {S.BANDS}, {S.LSH}, {CLASSES},
g AS (SELECT good.* FROM good SEMI JOIN cls x ON x.project_key = good.project_key AND x.class_id = file_a SEMI JOIN cls y ON y.project_key = good.project_key AND y.class_id = file_b)
SELECT CAST(floor(jaccard * 10 + 1e-9) AS BIGINT) AS tenth, CAST(count(*) AS BIGINT) AS pairs, CAST(count(lsh.file_a) AS BIGINT) AS found
FROM g LEFT JOIN lsh ON lsh.project_key = g.project_key AND lsh.file_a = g.file_a AND lsh.file_b = g.file_b GROUP BY 1""",
)
def q40(spark, d):
    reps = _representatives(T.signed_sets(spark, d))
    exact = clones.similar_pairs(reps, ["project_key"], "file", "k_gram_hashes", 0.2)
    lsh = clones.lsh_pairs(reps, ["project_key"], "file").withColumn("hit", F.lit(1))
    both = exact.join(lsh, ["project_key", "id_a", "id_b"], "left")
    return both.groupBy(big(F.floor(F.col("jaccard") * 10 + 1e-9)).alias("tenth")).agg(F.count("*").alias("pairs"), F.count("hit").alias("found"))


@query(
    "q41_merged_pairs",
    f"""WITH {S.GRAMS}, {S.PAIRS}, {S.TOP}, {HISTORY},
u AS (SELECT project_key, file_a, file_b, jaccard, matching_k_grams, 1 AS source_ord, seq FROM top UNION ALL SELECT project_key, file_a, file_b, jaccard, matching_k_grams, 2, seq FROM hist WHERE seq <= 50),
r AS (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY jaccard DESC, matching_k_grams DESC, source_ord, seq) AS k FROM u)
SELECT project_key, file_a, file_b, jaccard, CAST(matching_k_grams AS BIGINT) AS matching_k_grams, CAST(k AS BIGINT) AS seq FROM r WHERE k <= 50""",
)
def q41(spark, d):
    """File pairs of both kinds in the report's order, as the SQL has it; q41_merged_blocks has the blocks too."""
    own, old = _both(spark, d)
    none = own.limit(0)
    return clones.merged_pairs(none, own, old).select("project_key", "file_a", "file_b", "jaccard", "matching_k_grams", big(F.col("seq")).alias("seq"))


@query(
    "q41_merged_blocks",
    f"WITH {MERGED} SELECT project_key, file_a, file_b, kind, CAST(jaccard AS DOUBLE) AS jaccard, CAST(m AS BIGINT) AS matching_k_grams, coalesce(s1, 0) AS start_line_a, coalesce(e1, 0) AS end_line_a, coalesce(s2, 0) AS start_line_b, coalesce(e2, 0) AS end_line_b, CAST(seq AS BIGINT) AS seq FROM merged",
)
def q41_blocks(spark, d):
    """The report's whole list, with the blocks that come after a project's file pairs; file pairs have lines 0."""
    lines = [F.coalesce(c, F.lit(0)).alias(c) for c in ("start_line_a", "end_line_a", "start_line_b", "end_line_b")]
    return _merged(spark, d).select("project_key", "file_a", "file_b", "kind", "jaccard", "matching_k_grams", *lines, big(F.col("seq")).alias("seq"))


# the real parsers, metrics and rules, over source files made from the documents' ids


def _sources(spark, d):
    return parse(spread(G.sources(T.read(spark, d, "documents")), "file"))


@query(
    "q42_file_metrics",
    f"""WITH {G.SHAPES}, {G.FILES} SELECT project_key, file, language, CAST(totalLines AS BIGINT) AS total_lines, CAST(totalLines - blanks - commentLines AS BIGINT) AS ncloc, CAST(commentLines AS BIGINT) AS comment_lines, commentLines / totalLines AS density,
  CAST(2 AS BIGINT) AS functions, CAST(1 AS BIGINT) AS classes, CAST(1 AS BIGINT) AS imports FROM files""",
)
def q42(spark, d):
    return metrics.file_metrics(_sources(spark, d)).select("project_key", "file", "language", F.col("totalLines").alias("total_lines"), "ncloc", F.col("commentLines").alias("comment_lines"), F.col("commentDensity").alias("density"), F.col("functionCount").alias("functions"), F.col("classCount").alias("classes"), F.col("importCount").alias("imports"))


@query(
    "q43_function_metrics",
    f"""WITH {G.SHAPES}, {G.UNITS} SELECT project_key, file, language, name, CAST(startLine AS BIGINT) AS start_line, CAST(endLine AS BIGINT) AS end_line, CAST(endLine - startLine + 1 AS BIGINT) AS lines, CAST(complexity AS BIGINT) AS complexity, CAST(nestingDepth AS BIGINT) AS nesting, CAST(paramCount AS BIGINT) AS params FROM units""",
)
def q43(spark, d):
    rows = views.function_rows(metrics.file_metrics(_sources(spark, d)))
    return rows.select("project_key", "file", "language", "name", F.col("startLine").alias("start_line"), F.col("endLine").alias("end_line"), "lines", "complexity", F.col("nestingDepth").alias("nesting"), F.col("paramCount").alias("params"))


_TEXTS = {r.rule_id: r for r in rules.RULES}
_ROWS = ", ".join(f"({i}, '{r}', '{_TEXTS[r].severity}', '{_TEXTS[r].type}', {line}, {column}, '{_TEXTS[r].description}{more}')" for i, s in enumerate(G.SNIPPETS) for r, line, column, more in s.findings)
_LINES = ", ".join("[" + ", ".join("'" + x.replace("'", "''") + "'" for x in s.content.split("\n")) + "]" for s in G.SNIPPETS)
_EXT = ", ".join(f"'{dict(zip(G.LANGUAGES, G.EXTENSIONS, strict=True))[s.language]}'" for s in G.SNIPPETS)
SNIPPETS = f"""place AS (SELECT source AS project_key, CAST(doc_id % {len(G.SNIPPETS)} AS INTEGER) AS i, 's' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.' || [{_EXT}][CAST(doc_id % {len(G.SNIPPETS)} AS INTEGER) + 1] AS file FROM documents),
broken AS (SELECT project_key, ruleId || ':' || file || ':' || line || ':' || col AS id, ruleId, severity, type, file, line, col, message, substr(trim([{_LINES}][place.i + 1][line]), 1, 240) AS snippet FROM place JOIN (VALUES {_ROWS}) v(i, ruleId, severity, type, line, col, message) ON v.i = place.i)"""


def _broken(spark, d):
    parsed = parse(spread(G.snippets(T.read(spark, d, "documents")), "file"))
    return parsed, rules.findings(parsed, metrics.file_metrics(parsed))


@query("q44_rule_findings", f'WITH {SNIPPETS} SELECT project_key, id, ruleId, severity, type, file, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS "column", message, snippet FROM broken')
def q44(spark, d):
    """All rules: calls, nodes, texts and function metrics, with their places and messages."""
    return _broken(spark, d)[1]


_TOKEN_GRAMS = f"""{G.SHAPES}, {G.TOKENS},
grams AS (SELECT DISTINCT project_key, file, language, len(t) AS n, {S.fnv("array_to_string(list_slice(t, i, i + least(12, len(t)) - 1), chr(1))")} AS h FROM (SELECT *, unnest(range(1, len(t) - least(12, len(t)) + 2)) AS i FROM tokens))"""


@query(
    "q45_fingerprints",
    f"""WITH {_TOKEN_GRAMS}, {S.SIGNATURE.replace("project_key, doc_id, file", "project_key, file")}
SELECT g.*, s.signature FROM (SELECT project_key, file, language, CAST(max(n) AS BIGINT) AS token_count, CAST(12 AS BIGINT) AS k_gram_size, CAST(count(*) AS BIGINT) AS n_grams, CAST(sum(h) AS BIGINT) AS total FROM grams GROUP BY ALL) g
JOIN (SELECT project_key, file, string_agg(CAST(v AS VARCHAR), ',' ORDER BY s) AS signature FROM sig GROUP BY ALL) s ON s.project_key = g.project_key AND s.file = g.file""",
)
def q45(spark, d):
    parsed = _sources(spark, d)
    made = clones.fingerprints(parsed, metrics.file_metrics(parsed))
    total = F.aggregate("k_gram_hashes", F.lit(0).cast("bigint"), lambda s, h: s + h)
    return made.select("project_key", "file", "language", "token_count", "k_gram_size", big(F.size("k_gram_hashes")).alias("n_grams"), total.alias("total"), F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query("q46_report_of_sources", f"""WITH {G.SHAPES}, {G.FILES}, {G.UNITS}, {SNIPPETS}
SELECT f.project_key, CAST(files AS BIGINT) AS files, CAST(lines AS BIGINT) AS total_lines, CAST(functions AS BIGINT) AS functions, mean AS mean_complexity, CAST(most AS BIGINT) AS max_complexity, CAST(deep AS BIGINT) AS deep, coalesce(found, 0) AS findings
FROM (SELECT project_key, count(*) AS files, sum(totalLines) AS lines FROM files GROUP BY ALL) f JOIN (SELECT project_key, count(*) AS functions, sum(complexity) / count(*) AS mean, max(complexity) AS most, count(*) FILTER (nestingDepth > 6) AS deep FROM units GROUP BY ALL) u ON u.project_key = f.project_key
LEFT JOIN (SELECT project_key, CAST(count(*) AS BIGINT) AS found FROM broken GROUP BY ALL) b ON b.project_key = f.project_key""")
def q46(spark, d):
    """Project metrics of parsed files, and the number of findings of the project's other files."""
    files = metrics.file_metrics(_sources(spark, d))
    none = spark.createDataFrame([], "project_key string, clone_rate double")
    found = _broken(spark, d)[1].groupBy("project_key").agg(F.count("*").alias("findings"))
    rolled = metrics.project_metrics(files, none, DEFAULT_PROFILE).join(files.groupBy("project_key").agg(F.count("*").alias("files")), "project_key").join(found, "project_key", "left")
    return rolled.select("project_key", "files", F.col("totalLines").alias("total_lines"), F.col("functionCount").alias("functions"), F.col("avgComplexity").alias("mean_complexity"), F.col("maxComplexity").alias("max_complexity"), F.col("deeplyNestedFunctions").alias("deep"), F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"))


# sources and the store, written and read back


IGNORE_FILES = [("", "# generated\n\nfr/\n/de/1*\n*7\n!*17\n"), ("en", "2?\n")]


def _entries(spark, d):
    """Pages as files of a tree with two ignore files; every fifth lies in a directory that is never entered."""
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://[^/]+/([^?#]*[^?#/])", 1)
    file = F.concat(F.when(F.col("page_id") % 5 == 0, F.lit("lib/vendor/")).otherwise(""), path, F.when(F.col("page_id") % 3 == 0, F.lit(".txt")).otherwise(F.lit("")))
    pages = T.read(spark, d, "pages").select(F.concat(file, F.lit("/p"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, F.lit(".py")).otherwise(F.lit(".md"))).alias("file"), F.coalesce("html", F.lit("")).alias("content"))
    return pages.unionByName(spark.createDataFrame([(f"{base}/.gitignore".lstrip("/"), text) for base, text in IGNORE_FILES], "file string, content string"))


_TREE = """
p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^[a-z]+://[^/]+/([^?#]*[^?#/])', 1) || CASE WHEN page_id % 3 = 0 THEN '.txt' ELSE '' END AS dir FROM pages WHERE page_id % 5 <> 0),
f AS (SELECT page_id, dir || '/p' || page_id || CASE WHEN page_id % 2 = 0 THEN '.py' ELSE '.md' END AS file, dir, CASE WHEN contains(dir, '/') THEN regexp_extract(dir, '^([^/]*)/', 1) ELSE '' END AS top FROM p),
v AS (SELECT file, page_id, CASE WHEN regexp_matches(dir, '^en/(?:[^/]*/)*2[^/](?:/.*)?$') THEN TRUE WHEN regexp_matches(dir, '^(?:[^/]*/)*[^/]*17(?:/.*)?$') THEN FALSE WHEN regexp_matches(dir, '^(?:[^/]*/)*[^/]*7(?:/.*)?$') THEN TRUE WHEN regexp_matches(dir, '^de/1[^/]*$') THEN TRUE ELSE dir = 'fr' END
  OR (top <> '' AND CASE WHEN regexp_matches(top, '17$') THEN FALSE WHEN regexp_matches(top, '7$') THEN TRUE ELSE top = 'fr' END) AS out FROM f)
"""


@query("q47_discovered_files", f"WITH {_TREE} SELECT 'p' AS project_key, file, 'python' AS language FROM v WHERE NOT out AND page_id % 2 = 0")
def q47(spark, d):
    """Ignore files are parsed, nested ones apply below their directory; excluded directories and other languages go."""
    return listing.discovered(_entries(spark, d), "p").drop("content")


@query("q48_scan_counts", f"WITH {_TREE} SELECT count(*) AS scanned, count(*) FILTER (out OR page_id % 2 <> 0) AS skipped FROM v")
def q48(spark, d):
    return listing.counts(_entries(spark, d))


def _packed(spark, d, name, write):
    """Documents written by tasks under a new shared folder: ``write`` gets a task's files and its number."""
    folder = scratch_path(spark, name)
    files = T.documents(spark, d).select(F.concat(F.lit("src/"), F.col("source"), F.lit("/"), T.file_name(F.col("doc_id")), F.lit(".py")).alias("file"), "text")

    def run(batches):
        from pyspark import TaskContext

        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        write(folder, TaskContext.get().partitionId(), rows)
        yield pa.RecordBatch.from_pydict({"n": [len(rows)]})

    files.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return folder


_SCANNED = f"SELECT 'src/' || source || '/' || {S.FILE} || '.py' AS file, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents"


@query("q49_zip_scan", _SCANNED)
def q49(spark, d):
    def write(folder, part, rows):
        out = io.BytesIO()
        with warnings.catch_warnings(), zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            warnings.simplefilter("ignore", UserWarning)  # names repeat on purpose
            for file, text in rows:
                z.writestr(file, "replaced by the entry that follows")
                z.writestr(file, text)
        listing.put(f"{folder}/part-{part}.zip", out.getvalue())

    return listing.archives(spark, f"{_packed(spark, d, 'zips', write)}/*.zip").select("file", big(F.length("content")).alias("n"))


@query("q50_directory_scan", _SCANNED)
def q50(spark, d):
    def write(folder, part, rows):
        for file, text in rows:
            listing.put(f"{folder}/{file}", text.encode())
        listing.put(f"{folder}/src/node_modules/x{part}.py", b"never seen")

    return listing.directory(spark, _packed(spark, d, "tree", write)).select("file", big(F.length("content")).alias("n"))


@query(
    "q51_store_round_trip",
    f"""WITH s AS (SELECT source AS project_key, {S.FILE} AS file, lang AS language, CAST(length(coalesce(text, '')) AS BIGINT) AS ncloc, doc_id FROM documents)
SELECT project_key, file, language, ncloc FROM s WHERE project_key NOT IN ('src1', 'src2', 'src3') AND doc_id % 10 <> 0 UNION ALL SELECT project_key, file || '-new', language, ncloc FROM s WHERE project_key IN ('src1', 'src2')""",
)
def q51(spark, d):
    """Saved, then two projects replaced and one emptied, then loaded; every tenth file has no hashes and is left out."""
    path = scratch_path(spark, "store")
    row = _stored(spark, d).join(T.documents(spark, d).select(T.file_name(F.col("doc_id")).alias("file"), "doc_id"), "file")
    hashes = F.when(F.col("doc_id") % 10 != 0, F.array(F.lit(FNV_OFFSET))).otherwise(F.array().cast("array<bigint>"))
    made = row.select("project_key", F.lit(None).cast("timestamp").alias("updated_at"), "file", "language", F.lit(1).cast("bigint").alias("token_count"), F.lit(1).cast("bigint").alias("k_gram_size"), hashes.alias("k_gram_hashes"), F.array(F.lit(1).cast("bigint")).alias("signature"), "ncloc")
    keys = [r["source"] for r in T.read(spark, d, "documents").select("source").distinct().collect()]  # the projects of one save
    store.save(made, path, keys)
    fresh = made.where(F.col("project_key").isin("src1", "src2")).withColumns({"file": F.concat("file", F.lit("-new")), "k_gram_hashes": F.array(F.lit(FNV_OFFSET))})
    store.save(fresh, path, ["src1", "src2", "src3"])
    return store.load(spark, path).select("project_key", "file", "language", "ncloc")


@query(
    "q52_history_bands",
    f"""WITH {S.GRAMS}, {S.SIGNATURE}, {S.BANDS},
met AS (SELECT DISTINCT a.project_key, a.file AS file_a, b.project_key AS from_key, b.file AS from_file FROM bands a JOIN bands b ON a.band = b.band AND a.band_key = b.band_key AND a.project_key <> b.project_key),
num AS (SELECT met.project_key, file_a, from_key, from_file, count(*) AS m FROM met JOIN grams x ON x.project_key = met.project_key AND x.file = file_a JOIN grams y ON y.project_key = from_key AND y.file = from_file AND y.h = x.h GROUP BY ALL),
sim AS (SELECT num.*, m / (x.n + y.n - m) AS jaccard FROM num JOIN cnt x ON x.project_key = num.project_key AND x.file = file_a JOIN cnt y ON y.project_key = from_key AND y.file = from_file)
SELECT project_key, file_a, 'history/' || from_key || '/' || from_file AS file_b, jaccard, CAST(m AS BIGINT) AS matching_k_grams, CAST(seq AS BIGINT) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY jaccard DESC, m DESC, file_a, from_key, from_file) AS seq FROM sim WHERE jaccard >= 0.2) WHERE seq <= 50""",
)
def q52(spark, d):
    """History over shared bands, as for large inputs."""
    sets = T.signed_sets(spark, d)
    return clones.history_pairs(sets, sets, 0.2, mode="lsh").select("project_key", "file_a", "file_b", "jaccard", "matching_k_grams", big(F.col("seq")).alias("seq"))


@query(
    "q53_previews",
    f"""WITH {S.FOUND} SELECT project_key, CAST(seq AS BIGINT) AS seq, id FROM (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY file, line, "column", ruleId) AS seq FROM finding) WHERE seq <= 5""",
)
def q53(spark, d):
    return views.preview(_findings(spark, d)).select("project_key", big(F.col("seq")).alias("seq"), "id")


@query(
    "q54_tab_counts",
    f"""WITH {S.FOUND}, {S.METRICS} SELECT project_key, 'files' AS tab, CAST(count(*) AS BIGINT) AS n FROM met GROUP BY ALL UNION ALL SELECT project_key, 'functions', CAST(count(*) AS BIGINT) FROM met GROUP BY ALL UNION ALL SELECT project_key, 'findings', CAST(count(*) AS BIGINT) FROM finding GROUP BY ALL""",
)
def q54(spark, d):
    files = T.line_metrics(spark, d)
    return views.tab_counts(files, _findings(spark, d), spark.createDataFrame([], "project_key string"))


@query(
    "q55_dates_and_shares",
    "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M') AS shown, greatest(0.0, least(100.0, value / 50.0 * 100.0)) AS percent FROM events",
)
def q55(spark, d):
    return T.read(spark, d, "events").select("event_id", X.shown_date(F.col("ts")).alias("shown"), scoring.score_percent(F.col("value"), F.lit(50.0)).alias("percent"))


@query(
    "q56_entries_as_map",
    "SELECT user_id, map_from_entries(list(struct_pack(k := event_type, v := v) ORDER BY event_type))::VARCHAR AS entries FROM (SELECT user_id, event_type, max(CAST(event_id AS BIGINT)) AS v FROM events GROUP BY ALL) GROUP BY user_id",
)
def q56(spark, d):
    made = views.as_map(T.read(spark, d, "events").where("event_type is not null"), "event_type", "event_id", "user_id")
    shown = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", "), F.lit("}"))
    return made.select("user_id", shown.alias("entries"))
