"""The driver's tables seen as projects, files, tokens and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clones
from ..operators.metrics import FUNCTION_TYPE
from ..session import materialize, spread

DECISIONS = ("if", "for", "while", "and", "or", "the", "de", "die")
#: rule, severity, type, pattern of a line (no look-around, so that SQL engines agree), in the order they are found
LINE_RULES = (
    ("line-secret", "CRITICAL", "VULNERABILITY", r"(?i)(password|passwd|secret|token|api[_-]?key|credential).*[=:]"),
    ("line-signs", "MAJOR", "BUG", r"[#*%$&]{3}"),
    ("line-license", "MINOR", "CODE_SMELL", r"^Licensed under"),
    ("line-signs", "MAJOR", "BUG", r"[#*%$&]{3} "),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents"), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))


def file_name(doc_id: Column) -> Column:
    """Names whose order is that of the ids."""
    return F.concat(F.lit("d"), F.lpad(doc_id.cast("string"), 12, "0"))


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_key, doc_id, file, k_gram_hashes): distinct hashes of 12-word grams.

    Pair queries need them in several branches, so they are hashed once and written.
    """
    df = documents(spark, sf_dir).select(F.col("source").alias("project_key"), "doc_id", file_name(F.col("doc_id")).alias("file"), words(F.col("text")).alias("t"))
    return materialize(clones.with_gram_hashes(df, "t"), "grams", "zstd")  # half of each number is zeros


def signed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(clones.minhash(token_sets(spark, sf_dir)), "signatures")


def line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the line rules, ids repeated where two rules of one name match; ord is the order they are found in."""
    lines = documents(spark, sf_dir).select(F.col("source").alias("project_key"), file_name(F.col("doc_id")).alias("file"), "lang", F.posexplode(X.lines(F.col("text"))).alias("row", "line_text"))
    hits = F.array(*[F.when(F.col("line_text").rlike(p), F.struct(F.lit(r).alias("ruleId"), F.lit(s).alias("severity"), F.lit(t).alias("type"), F.lit(f"{r} {i}").alias("message"), F.lit(i).alias("ord"))) for i, (r, s, t, p) in enumerate(LINE_RULES)])
    df = lines.select("project_key", "file", "lang", (F.col("row") + 1).cast("bigint").alias("line"), "line_text", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return df.select("project_key", F.concat_ws(":", "h.ruleId", "file", F.col("line").cast("string"), F.lit("1")).alias("id"), "h.ruleId", "h.severity", "h.type", "file", "line", F.lit(1).cast("bigint").alias("column"), "h.message", F.substring(X.trimmed(F.col("line_text")), 1, 240).alias("snippet"), "h.ord")


def line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with one function each: its complexity from decision words, its lines, its nesting from its length."""
    lines, t = X.lines(F.col("text")), words(F.col("text"))
    language = F.when(F.col("lang") == "en", "python").otherwise("java")
    df = documents(spark, sf_dir).select("doc_id", F.col("source").alias("project_key"), file_name(F.col("doc_id")).alias("file"), language.alias("language"), lines.alias("lines"), t.alias("t"), F.length("text").alias("n"))
    decided = F.size(F.filter("t", lambda w: w.isin(*DECISIONS)))
    comments = F.size(F.filter("lines", lambda x: X.pure_comment(x, F.col("language")))).cast("bigint")
    blank = F.size(F.filter("lines", X.is_blank)).cast("bigint")
    total = F.size("lines").cast("bigint")
    fn = F.struct(F.lit("body").alias("name"), F.lit(1).alias("startLine"), total.alias("endLine"), (1 + decided).alias("complexity"), total.alias("lines"), F.floor(F.col("n") / 1000).alias("nestingDepth"), F.lit(0).alias("paramCount"))
    return df.select("project_key", "doc_id", "file", "language", total.alias("totalLines"), (total - blank - comments).alias("ncloc"), comments.alias("commentLines"), F.lit(0).cast("bigint").alias("classCount"), F.array(fn).cast(FUNCTION_TYPE).alias("functions"))
