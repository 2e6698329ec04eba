"""A corpus pipeline: quality, near-duplicates, benchmark contamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one reads from Parquet. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import decontam, packing, quality, secret_scan, simhash
from lintlake.llm.common import scratch_path
from lintlake.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score below 0.3).

    Null, empty and wordless texts have no neighbours and the score of the sample's share of good labels; they stay where
    that reaches the line. Repeated rows and null ids are judged like any; of contradicting labels the smallest counts;
    without labels all stay. Other columns than those of ``documents`` go here.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs.select(*COLUMNS), model, threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash component: that with the smallest doc_id.

    Links are op1's, words in threes and at most 3 differing bits. Rows count, not ids: an id with several texts keeps
    those that are no copies; a row without an id stays only if its component has none with one; null and empty texts are
    one component.
    """
    return simhash.keep_one(docs.select(*COLUMNS), radius=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item.

    Null, empty and wordless texts hold none and stay; items without words have no windows; repeated rows and null ids
    are treated like any; an empty benchmark drops nothing.
    """
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of each secret; keeps all rows, repeated ones, null and empty texts as they are.

    ``n_chars`` is counted anew where a text changed.
    """
    return secret_scan.redact(docs.select(*COLUMNS))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens; one row per piece.

    A null or empty text is its end token alone; repeated rows are packed each; null ids are packed like any.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), size=1024, end_id=2)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("best-fit packing", best_fit),
]

#: No stage but the third can be expressed in SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
