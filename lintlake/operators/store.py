"""The fingerprint store: Parquet partitioned by project, replaced project by project."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FINGERPRINTS, LEGACY

COLUMNS = [f.name for f in FINGERPRINTS.fields]
EMPTY_MARK = ""  # file of the row that stands for a project without files


def store_path(path: str | None = None) -> str:
    """The argument, else FINGERPRINT_DB_PATH, else a folder beside the data."""
    return path or os.environ.get("FINGERPRINT_DB_PATH") or "data/fingerprints"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and any(s.getPath().getName().startswith("project_key=") for s in fs.listStatus(p))


def load(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """Stored fingerprints in order of project and file; rows without hashes or signature are left out.

    ``exclude``: projects that are not read (a partition filter). A store that does not exist is empty.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], FINGERPRINTS)
    df = spark.read.schema(FINGERPRINTS).parquet(path).select(*COLUMNS)
    if exclude:
        df = df.where(~F.col("project_key").isin(exclude))
    usable = (F.size("k_gram_hashes") > 0) & (F.size("signature") > 0) & (F.col("file") != EMPTY_MARK)
    return df.where(F.coalesce(usable, F.lit(False))).orderBy("project_key", "file")


def replaced(stored: DataFrame, fresh: DataFrame, projects: DataFrame) -> DataFrame:
    """The store after the upsert: rows of the projects given go, fresh rows come."""
    return stored.join(projects.select("project_key").distinct(), "project_key", "left_anti").unionByName(fresh)


def save(fresh: DataFrame, path: str, projects: list[str]) -> None:
    """Replace each of ``projects`` by its rows in ``fresh``; one without files is left with none.

    Each project is one partition that a dynamic overwrite replaces as a whole; an empty project gets a row without
    hashes, which load() leaves out, so that its old partition is replaced as well.
    """
    spark = fresh.sparkSession
    rows = fresh.withColumn("updated_at", F.current_timestamp()).select(*COLUMNS)
    keys = spark.createDataFrame([(k,) for k in projects], "project_key string")
    blank = keys.join(rows.select("project_key").distinct(), "project_key", "left_anti")
    values = {"updated_at": F.current_timestamp(), "file": F.lit(EMPTY_MARK)}
    marks = blank.select(*[F.col("project_key") if f.name == "project_key" else values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FINGERPRINTS.fields])
    wanted = rows.join(F.broadcast(keys), "project_key", "left_semi")
    wanted.unionByName(marks).repartition("project_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_key").parquet(path)


def legacy_rows(documents: DataFrame, text_col: str = "value") -> DataFrame:
    """Fingerprints in legacy JSON documents; files without hashes are dropped, bad JSON gives nothing."""
    parsed = documents.select(F.from_json(text_col, LEGACY).alias("d"))
    projects = parsed.select(F.explode(F.map_values("d.projects")).alias("p"))
    files = projects.select(F.col("p.projectKey").alias("project_key"), F.to_timestamp("p.updatedAt").alias("updated_at"), F.explode("p.files").alias("f"))
    rows = files.select("project_key", "updated_at", F.col("f.file").alias("file"), F.col("f.language").alias("language"), F.col("f.tokenCount").alias("token_count"), F.col("f.kGramSize").alias("k_gram_size"), F.col("f.kGramHashes").alias("k_gram_hashes"), F.col("f.signature").alias("signature"), F.col("f.ncloc").alias("ncloc"))
    return rows.where(F.coalesce(F.size("k_gram_hashes") > 0, F.lit(False)))


def import_legacy(spark: SparkSession, json_path: str, path: str) -> int:
    """Bring a legacy JSON store in, once: a marker file tells that it was done. Projects already stored stay as they are."""
    marker = f"{path}/_legacy_json_imported"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(marker)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        return 0
    n = 0
    source = jvm.org.apache.hadoop.fs.Path(json_path)
    if source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(source):
        rows = legacy_rows(spark.read.text(json_path, wholetext=True))
        if _exists(spark, path):
            rows = rows.join(spark.read.schema(FINGERPRINTS).parquet(path).select("project_key").distinct(), "project_key", "left_anti")
        n = rows.count()
        if n:
            rows.select(*COLUMNS).repartition("project_key").write.mode("append").partitionBy("project_key").parquet(path)
    fs.mkdirs(p.getParent())
    fs.create(p, True).close()
    return n
