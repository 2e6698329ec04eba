"""The whole analysis as one plan: files to metrics, findings, clones, rate, score and stored fingerprints."""

from __future__ import annotations

import json
import logging
import time
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import report as R
from ..operators import blocks, clones, metrics, rules, scoring, store
from ..options import DEFAULT_PROFILE, ScanOptions, checked_project_key, default_project_key
from ..parse.udf import parse
from ..schemas import FINGERPRINTS, PAIRS
from ..sources import listing

log = logging.getLogger(__name__)
FINDINGS = "project_key string, id string, ruleId string, severity string, type string, file string, line bigint, column bigint, message string, snippet string"


@dataclass
class Analysis:
    """Lazy frames, each keyed by project_key."""

    files: DataFrame
    findings: DataFrame
    fingerprints: DataFrame
    clone_pairs: DataFrame
    projects: DataFrame
    scores: DataFrame | None
    held: list[DataFrame] = field(default_factory=list)

    def functions(self) -> DataFrame:
        return self.files.select("project_key", "file", "language", F.inline("functions"))

    def reports(self) -> DataFrame:
        return R.json_rows(self.projects, self.files, self.findings, self.clone_pairs, self.scores)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def analyze_files(files: DataFrame, options: ScanOptions | None = None, store_path: str | None = None, mode: str = "auto", keys: DataFrame | None = None) -> Analysis:
    """Analyse ``files`` (project_key, file, language, content) of any number of projects at once.

    ``mode`` of pairing: "exact" finds every pair, "auto" does so up to 10,000 pairs of files and goes by LSH bands above
    (which miss most pairs of low similarity), "lsh" always goes by bands. ``keys`` (project_key) names projects that are
    reported even if they have no files. Branches that the options switch off are not built. The history is that of other projects; a store that cannot be
    read counts as empty.
    """
    options = options or ScanOptions()
    spark = files.sparkSession
    profile = options.profile() if options.scoring else DEFAULT_PROFILE
    parsed = parse(files.where(F.col("language").isin(*options.languages))).persist(StorageLevel.DISK_ONLY)
    per_file = metrics.file_metrics(parsed).persist(StorageLevel.MEMORY_AND_DISK)
    found = rules.findings(parsed, per_file) if options.rules else spark.createDataFrame([], FINDINGS)
    prints = clones.fingerprints(parsed, per_file).persist(StorageLevel.MEMORY_AND_DISK)
    if options.clone_detection:
        try:
            stored = store.load(spark, store_path) if store_path else spark.createDataFrame([], FINGERPRINTS)
        except Exception as error:  # noqa: BLE001  the scan goes on without history
            log.warning("stored fingerprints cannot be read: %s", error)
            stored = spark.createDataFrame([], FINGERPRINTS)
        own = clones.project_pairs(prints, options.clone_threshold, mode=mode)
        pairs = clones.merged_pairs(blocks.project_blocks(parsed), own, clones.history_pairs(prints, stored, options.clone_threshold, mode=mode))
    else:
        pairs = spark.createDataFrame([], PAIRS).select(F.lit("").alias("project_key"), "*", F.lit(0).alias("seq"))
    found, pairs = found.persist(StorageLevel.MEMORY_AND_DISK), pairs.persist(StorageLevel.MEMORY_AND_DISK)
    rates = clones.clone_rate(pairs, per_file)
    projects = metrics.project_metrics(per_file, rates, profile, keys)
    scores = scoring.score_projects(projects, per_file, found, profile, options.pass_score) if options.scoring else None
    return Analysis(per_file, found, prints, pairs, projects, scores, [parsed, per_file, found, prints, pairs])


def _finish(analysis: Analysis, key: str, source_name: str, started: float) -> dict[str, Any]:
    out = json.loads(analysis.reports().where(F.col("project_key") == key).first()["report"])
    return out | {"sourceName": source_name, "scannedAt": datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"), "durationMs": int((time.time() - started) * 1000)}


def analyze_entries(entries: DataFrame, project_key: str, options: ScanOptions | None = None, store_path: str | None = None, source_name: str = "", mode: str = "auto") -> dict[str, Any]:
    """The report of one project, also of one without files; ``mode`` as in analyze_files(). Its fingerprints replace those stored before. A store that fails only warns."""
    started, key, options = time.time(), checked_project_key(project_key), options or ScanOptions()
    keys = entries.sparkSession.createDataFrame([(key,)], "project_key string")
    analysis = analyze_files(listing.discovered(entries, key, options.languages), options, store_path, mode, keys)
    try:
        out = _finish(analysis, key, source_name, started)
        if store_path:
            try:
                store.save(analysis.fingerprints, store_path, [key])
            except Exception as error:  # noqa: BLE001
                log.warning("fingerprints cannot be stored: %s", error)
        return out
    finally:
        analysis.release()


def analyze_directory(spark: SparkSession, root: str, project_key: str, options: ScanOptions | None = None, store_path: str | None = None, mode: str = "auto") -> dict[str, Any]:
    return analyze_entries(listing.directory(spark, root), project_key, options, store_path, root, mode)


def analyze_upload(spark: SparkSession, path: str, original_name: str, project_key: str | None = None, options: ScanOptions | None = None, store_path: str | None = None, mode: str = "auto") -> dict[str, Any]:
    """A ZIP, by its original name, or one source file. Without a project key the upload's name gives one."""
    key = default_project_key(original_name) if project_key is None else project_key
    return analyze_entries(listing.upload(spark, path, original_name), key, options, store_path, original_name, mode)
