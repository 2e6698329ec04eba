"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text of a sample, for each label.
SAMPLE_BYTES = 48 << 20


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing may be learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, each: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(text, label) of at most ``each`` rows of ``labels`` with label 0 and as many with 1, in the order of a hash of
    doc_id, and of each label no more than ``most_bytes`` of text: the order is followed until they are reached.

    Held-out rows, null labels and ids, and labels without a document are left out. An id with contradicting labels has
    the smallest; one with several documents is one row, that with the smallest text. Null texts are empty. The ids are
    at most ``2 * each``, so they are broadcast to the documents, which are not shuffled; before texts of an id meet,
    each task has cut them to one.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.where("label = 0").orderBy(*order).limit(each).union(known.where("label = 1").orderBy(*order).limit(each))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_size", size).where(F.col("_size") <= most_bytes).select("text", "label")
