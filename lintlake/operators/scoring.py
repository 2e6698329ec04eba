"""Score and gate: deductions for findings, function metrics and the clone rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import ScoreProfile, clamp

DEDUCTION = "array<struct<category:string,label:string,count:bigint,points:double>>"
#: metric, field of a function, aggregate that stands in where there are no function rows, label
FUNCTION_METRICS = (
    ("maxComplexity", "complexity", "overComplexFunctions", "Functions over the complexity limit"),
    ("maxFunctionLines", "lines", "overLongFunctions", "Functions over the length limit"),
    ("maxNestingDepth", "nestingDepth", "deeplyNestedFunctions", "Functions over the nesting limit"),
)


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """(project_key, severity, n, first): counts, and the place of the first finding, which orders the groups."""
    return findings.groupBy("project_key", "severity").agg(F.count("*").alias("n"), F.min(F.struct("file", "line", "column", "ruleId")).alias("first"))


def deductions(projects: DataFrame, files: DataFrame, findings: DataFrame, profile: ScoreProfile) -> DataFrame:
    """(project_key, cloneRate, deductions) for each row of ``projects`` (the project metrics)."""
    severities = F.create_map(*[F.lit(x) for k, v in profile.finding_penalties.items() for x in (k, float(v))])
    points = F.col("n") * F.coalesce(F.try_element_at(severities, F.col("severity")), F.lit(0.0))
    own = findings_by_severity(findings).withColumn("points", points).where("points > 0")
    entry = F.struct("first", F.struct(F.lit("finding").alias("category"), F.concat(F.col("severity"), F.lit(" findings")).alias("label"), F.col("n").alias("count"), F.col("points").alias("points")).alias("d"))
    own = own.groupBy("project_key").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["d"]).alias("by_finding"))

    counts, names = [], []
    for metric, field, _, _ in FUNCTION_METRICS:
        if rule := profile.metric_rules.get(metric):
            counts.append(_above(field, rule.threshold).alias(f"n_{metric}"))
            names.append(metric)
    per = files.groupBy("project_key").agg(F.sum(F.size("functions").cast("bigint")).alias("n_functions"), *counts)
    df = projects.join(per, "project_key", "left").join(own, "project_key", "left")
    parts = [F.coalesce(F.col("by_finding").cast(DEDUCTION), F.array().cast(DEDUCTION))]
    for metric, _, aggregate, label in FUNCTION_METRICS:
        if metric in names:
            rule = profile.metric_rules[metric]
            n = F.when(F.coalesce("n_functions", F.lit(0)) > 0, F.col(f"n_{metric}")).otherwise(F.col(aggregate)).cast("bigint")
            lost = n * F.lit(float(rule.penalty))
            parts.append(_entry(lost > 0, "metric", label, n, lost))
    if rule := profile.metric_rules.get("cloneRate"):
        lost = F.greatest(F.lit(0.0), F.col("cloneRate") - F.lit(float(rule.threshold))) * F.lit(float(rule.penalty))
        parts.append(_entry(lost > 0, "metric", "Clone rate over the limit", F.lit(None).cast("bigint"), lost))
    return df.select("project_key", F.flatten(F.array(*parts)).alias("deductions"))


def _above(field: str, threshold: float) -> Column:
    return F.sum(F.size(F.filter("functions", lambda f: f[field] > F.lit(threshold))).cast("bigint"))


def _entry(holds: Column, category: str, label: str, count: Column, points: Column) -> Column:
    one = F.array(F.struct(F.lit(category).alias("category"), F.lit(label).alias("label"), count.alias("count"), points.cast("double").alias("points"))).cast(DEDUCTION)
    return F.when(holds, one).otherwise(F.array().cast(DEDUCTION))


def gate(deducted: DataFrame, profile: ScoreProfile, pass_score: float | None = None) -> DataFrame:
    """Score, pass line, verdict and, if it failed, the reasons. Scores are raw doubles; only texts are rounded."""
    line = float(clamp(profile.pass_score if pass_score is None else pass_score, 0.0, 100.0))
    total = F.aggregate("deductions", F.lit(0.0), lambda s, d: s + d["points"])
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - total))
    df = deducted.withColumn("score", score).withColumn("passed", F.col("score") >= F.lit(line))
    texts = F.transform("deductions", lambda d: F.concat(d["label"], F.lit(": -"), F.format_string("%.1f", d["points"])))
    first = F.array(F.concat(F.lit("Score "), F.format_string("%.1f", F.col("score")), F.lit(f" is below the pass line {line:g}")))
    reasons = F.when(F.col("passed"), F.array().cast("array<string>")).otherwise(F.concat(first, texts))
    return df.select("project_key", F.lit(profile.profile_id).alias("profile_id"), F.lit(profile.version).alias("profile_version"), F.lit(profile.provenance).alias("provenance"), "score", F.lit(100.0).alias("max_score"), F.lit(line).alias("pass_score"), "passed", "deductions", reasons.alias("failure_reasons"))


def score_percent(score: Column, most: Column) -> Column:
    """The share of a score that a ring shows, 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score / most * 100))


def score_projects(projects: DataFrame, files: DataFrame, findings: DataFrame, profile: ScoreProfile, pass_score: float | None = None) -> DataFrame:
    return gate(deductions(projects, files, findings, profile), profile, pass_score)
