"""Line, comment and function metrics: file-local expressions over the node array, then rollups by project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..options import ScoreProfile
from .languages import types

FUNCTION_TYPE = "array<struct<name:string,startLine:bigint,endLine:bigint,complexity:bigint,lines:bigint,nestingDepth:bigint,paramCount:bigint>>"


def with_text_rows(df: DataFrame) -> DataFrame:
    """``df`` with the content's rows as the parser counts them, which node_text() reads."""
    return df.withColumn("_text", F.split("content", "\n", -1))


def node_text(node: Column) -> Column:
    """The source of a node, from the rows it spans: the work is that of the node's length, wherever it lies in the file."""
    row = lambda i: F.get("_text", node[i])
    one = F.substring(row("start_row"), node["start_col"] + 1, node["end_col"] - node["start_col"])
    first = F.substring(row("start_row"), node["start_col"] + 1, F.lit((1 << 31) - 1))
    between = F.slice("_text", node["start_row"] + 2, F.greatest(F.lit(0), node["end_row"] - node["start_row"] - 1))
    many = F.array_join(F.concat(F.array(first), between, F.array(F.substring(row("end_row"), F.lit(1), node["end_col"]))), "\n")
    return F.when(node["start_row"] == node["end_row"], one).otherwise(many)


def below(node: Column) -> Column:
    """Strict descendants of a node."""
    return F.slice("nodes", node["pre"] + F.lit(2), node["last"] - node["pre"])


def subtree(node: Column) -> Column:
    return F.slice("nodes", node["pre"] + F.lit(1), node["last"] - node["pre"] + 1)


def _size(array: Column) -> Column:
    return F.size(array).cast("bigint")


def _complexity(fn: Column) -> Column:
    decisions = _size(F.filter(below(fn), lambda n: n["named"] & F.array_contains(F.col("_decision"), n["type"])))
    logical = F.filter(subtree(fn), lambda n: n["type"] == "binary_expression")
    signs = F.aggregate(logical, F.lit(0).cast("bigint"), lambda s, n: s + F.regexp_count(node_text(n), F.lit(r"&&|\|\|")))
    return F.lit(1) + decisions + signs


def _nesting(fn: Column) -> Column:
    own = F.filter(below(fn), lambda n: F.array_contains(F.col("_nesting"), n["type"]))
    depths = F.transform(own, lambda x: F.size(F.filter(own, lambda y: (y["pre"] <= x["pre"]) & (x["pre"] <= y["last"]))))
    return F.coalesce(F.array_max(depths), F.lit(0)).cast("bigint")


def _parameters(fn: Column) -> Column:
    field = F.get(F.filter(below(fn), lambda n: (n["parent"] == fn["pre"]) & (n["field"] == "parameters")), F.lit(0))
    first = F.get(F.filter(subtree(fn), lambda n: n["named"] & n["type"].contains("parameter")), F.lit(0))
    holder = F.coalesce(field, first)
    inside = _size(F.filter(below(holder), lambda n: n["named"] & F.array_contains(F.col("_parameter"), n["type"])))
    return F.when(holder.isNull(), F.lit(0)).when(F.array_contains(F.col("_parameter"), holder["type"]), F.lit(1)).otherwise(inside).cast("bigint")


def functions() -> Column:
    """Function metrics in pre-order; nested functions are rows of their own and count in the outer one too."""
    found = F.filter("nodes", lambda n: n["named"] & F.array_contains(F.col("_function"), n["type"]))
    row = lambda n: F.struct(
        F.coalesce(n["name"], F.lit("<anonymous>")).alias("name"),
        (n["start_row"] + 1).cast("bigint").alias("startLine"),
        (n["end_row"] + 1).cast("bigint").alias("endLine"),
        _complexity(n).cast("bigint").alias("complexity"),
        (n["end_row"] - n["start_row"] + 1).cast("bigint").alias("lines"),
        _nesting(n).alias("nestingDepth"),
        _parameters(n).alias("paramCount"),
    )
    return F.transform(found, row).cast(FUNCTION_TYPE)


def file_metrics(parsed: DataFrame) -> DataFrame:
    """One row per file of ``parsed`` (with content and nodes): counts, density and nested functions. No shuffle."""
    kinds = {f"_{k}": types(k) for k in ("function", "class", "import", "comment", "decision", "nesting", "parameter")}
    df = with_text_rows(parsed.withColumns({"content": F.coalesce("content", F.lit("")), **kinds})).withColumns({"_lines": X.lines(F.col("content"))})
    comments = F.filter("nodes", lambda n: F.array_contains(F.col("_comment"), n["type"]))
    rows = F.array_distinct(F.flatten(F.transform(comments, lambda n: F.sequence(n["start_row"], n["end_row"]))))
    df = df.withColumn("_rows", rows)
    code = F.filter("_lines", lambda line, i: ~X.is_blank(line) & ~(F.array_contains(F.col("_rows"), i) & X.pure_comment(line, F.col("language"))))
    count = lambda kind: _size(F.filter("nodes", lambda n: n["named"] & F.array_contains(F.col(f"_{kind}"), n["type"])))
    total, commented = _size(F.col("_lines")), _size(F.col("_rows"))
    return df.select(
        "project_key",
        "file",
        "language",
        total.alias("totalLines"),
        _size(code).alias("ncloc"),
        commented.alias("commentLines"),
        F.when(total > 0, commented / total).otherwise(F.lit(0.0)).alias("commentDensity"),
        count("function").alias("functionCount"),
        count("class").alias("classCount"),
        count("import").alias("importCount"),
        functions().alias("functions"),
    )


def max_complexity() -> Column:
    """Of a file row; 0 without functions."""
    return F.coalesce(F.array_max(F.transform("functions", lambda f: f["complexity"])), F.lit(0))


def project_metrics(files: DataFrame, clone_rates: DataFrame, profile: ScoreProfile, keys: DataFrame | None = None) -> DataFrame:
    """The eleven aggregates of each project. Ratios are of sums; thresholds count strictly larger values, 0 if not set.

    ``keys`` (project_key): projects that get a row of zeros where they have no files.
    """

    def above(metric: str, field: str) -> Column:
        rule = profile.metric_rules.get(metric)
        return F.lit(0).cast("bigint") if rule is None else F.sum(_size(F.filter("functions", lambda f: f[field] > F.lit(rule.threshold))))

    total = F.sum("totalLines")
    complexity = F.aggregate("functions", F.lit(0).cast("bigint"), lambda s, f: s + f["complexity"])
    n = F.sum(_size(F.col("functions")))
    rolled = files.groupBy("project_key").agg(
        total.alias("totalLines"),
        F.sum("ncloc").alias("ncloc"),
        F.sum("commentLines").alias("commentLines"),
        F.when(total > 0, F.sum("commentLines") / total).otherwise(F.lit(0.0)).alias("commentDensity"),
        n.alias("functionCount"),
        F.sum("classCount").alias("classCount"),
        F.when(n > 0, F.sum(complexity) / n).otherwise(F.lit(0.0)).alias("avgComplexity"),
        F.coalesce(F.max(max_complexity()), F.lit(0)).alias("maxComplexity"),
        above("maxComplexity", "complexity").alias("overComplexFunctions"),
        above("maxFunctionLines", "lines").alias("overLongFunctions"),
        above("maxNestingDepth", "nestingDepth").alias("deeplyNestedFunctions"),
    )
    if keys is not None:
        rolled = keys.select("project_key").distinct().join(rolled, "project_key", "left").fillna(0)
    return rolled.join(clone_rates.select("project_key", F.col("clone_rate").alias("cloneRate")), "project_key", "left").withColumn("cloneRate", F.coalesce("cloneRate", F.lit(0.0)))
