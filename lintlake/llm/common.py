"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, scratch_path, spread

__all__ = ["ALL_ONES", "columns", "connected_components", "discard", "filesystem", "materialize", "pieces", "put_in_place", "scratch_path", "spread", "with_arrow"]

ALL_ONES = 0xFFFFFFFFFFFFFFFF


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024, text: str | None = None, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and, if ``text`` names a column, about ``size`` of its bytes."""
    for batch in batches:
        step = rows
        if text is not None and batch.num_rows:
            mean = max(1, batch.column(batch.schema.get_field_index(text)).nbytes // batch.num_rows)
            step = max(1, min(rows, size // mean))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def with_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], text: str | None = None, rows: int = 1024) -> DataFrame:
    """``df`` through a batch function that ``make`` builds once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for piece in pieces(batches, rows, text):
            yield one(piece)

    return df.mapInArrow(run, schema)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, by the names that Hadoop gives the stores (``s3a``) or a plain path."""
    scheme, sep, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if sep and scheme in ("s3a", "s3n") else uri)


def put_in_place(fs: pafs.FileSystem, draft: str, name: str) -> None:
    """Give a finished file its name; one that a task before left there goes, since some stores move onto no file."""
    if fs.get_file_info(name).type != pafs.FileType.NotFound:
        fs.delete_file(name)
    fs.move(draft, name)


def columns(batch: pa.RecordBatch, **new: object) -> pa.RecordBatch:
    """A batch of the given columns; Arrow arrays stay as they are."""
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in new.items()})


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b, both long); component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges no longer change. Every step is an aggregation and an
    equi-join on the node, so a hub is pre-aggregated for its minimum and its join side can be split; each round is
    written to the shared folder and the one before it removed. No edge reaches the driver. Null ends and loops are dropped.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialize(edges, label), None
    while True:
        print_ = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (print_["n"], print_["s"]) == before or not print_["n"]:
            break
        before = (print_["n"], print_["s"])
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        edges, last = materialize(small, label), edges
        discard(last)
    # stars now: every edge points from a node to the smallest node of its component
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
