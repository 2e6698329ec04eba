"""WARC archives: written from pages, read back, and transactions assembled.

Writing: each page becomes a request, a response (or, if an earlier page has the same payload, a revisit) and a metadata
record; request and metadata name the response by WARC-Concurrent-To. One gzip archive per task, a member per record, is
written under a temporary name in the shared folder and moved into place, so a repeated task replaces its own archive.

Reading: every archive is parsed once to rows of headers and, if asked for, payloads; requests, responses and metadata
are then joined by the ids that they concur with, one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, materialize, pieces, put_in_place, scratch_path

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space for URLs
DATE = "2024-01-01T00:00:00Z"
RECORD = "archive string, place long, record_id string, type string, concurrent_to string, target_uri string, date string, content_type string, payload_digest string, payload_bytes long, refers_to string, http string, block string"


def sha1_32(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return " ".join(value.split())


def with_first_copies(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, first_id, copy): first_id is the smallest page_id with the same payload if that is another page.

    Equal payloads are found by their SHA-256, pre-aggregated to one row each. copy numbers rows of equal page_id from 0.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    key = F.unhex(F.sha2("html", 256))
    firsts = source.select(key.alias("key"), "page_id").groupBy("key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    twice = source.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1 and page_id is not null").select("page_id")
    if twice.isEmpty():
        source = source.withColumn("copy", F.lit(0))
    else:
        again = source.join(twice, "page_id", "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy("page_id").orderBy("url", "html")) - 1)
        source = source.join(twice, "page_id", "left_anti").withColumn("copy", F.lit(0)).unionByName(again)
    joined = source.withColumn("key", key).join(firsts, "key", "left")
    return joined.select("page_id", "url", "html", F.when(F.coalesce(F.col("first_id") != F.col("page_id"), F.col("first_id").isNotNull()), F.col("first_id")).alias("first_id"), "copy")


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``folder``; one row (archive, records) for each.

    Archives are named by the URI that ``folder`` is given as. Payloads of at least ``least`` bytes that an earlier page has too become revisits. A null html is an empty payload;
    null urls and ids are written as empty. Repeated rows: the rows with the smallest page_id are all responses.
    """

    def ids(page_id: int | None, extra: str, kind: str) -> str:
        return uuid.uuid5(SPACE, f"{kind}:{page_id}:{extra}").urn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        part = f"part-{context.partitionId():06d}.warc.gz"
        name = f"{root}/{part}"
        draft = f"{root}/_draft-{context.partitionId():06d}-{context.taskAttemptId()}"
        n = 0
        with fs.open_output_stream(draft, compression=None) as out:

            def put(*record) -> None:
                nonlocal n
                packed = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(packed.compress(_record(*record)) + packed.flush())
                n += 1

            put("warcinfo", uuid.uuid5(SPACE, f"{folder}{name}").urn, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            for batch in pieces(batches, 512):
                for page_id, url, html, first, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    revisit = first is not None and len(payload) >= least
                    uri, own, target = _one_line(url or ""), "" if page_id is None else str(page_id), []
                    if uri:
                        target = [("WARC-Target-URI", uri)]
                    main = ids(page_id, str(copy), "response") if page_id is not None else ids(None, uuid.uuid4().hex, "response")
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    headers = [*target, ("WARC-Payload-Digest", f"sha1:{sha1_32(payload)}"), ("Content-Type", "application/http; msgtype=response")]
                    if revisit:
                        headers += [("WARC-Refers-To", f"<{ids(first, '0', 'response')}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    host, _, path = uri.partition("://")[2].partition("/")
                    asked = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
                    with_main = [*target, ("WARC-Concurrent-To", f"<{main}>")]
                    put("request", uuid.uuid5(SPACE, f"request:{main}").urn, [*with_main, ("Content-Type", "application/http; msgtype=request")], asked)
                    put("revisit" if revisit else "response", main, headers, http if revisit else http + payload)
                    put("metadata", uuid.uuid5(SPACE, f"metadata:{main}").urn, [*with_main, ("Content-Type", "application/warc-fields")], f"page-id: {own}\r\n".encode())
        put_in_place(fs, draft, name)
        yield pa.RecordBatch.from_pydict({"archive": pa.array([f"{folder.rstrip('/')}/{part}"]), "records": pa.array([n], pa.int64())})

    return with_first_copies(pages).mapInArrow(run, "archive string, records long")


def _members(stream) -> Iterator[bytes]:
    """Records of an archive, one gzip member each; no more than one is held."""
    held = b""
    while True:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not held:
                held = stream.read(1 << 20)
                if not held:
                    break
            out.append(unpack.decompress(held))
            held = unpack.unused_data if unpack.eof else b""
        if out:
            yield b"".join(out)
        if not unpack.eof:
            return


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    return headers, rest[: int(headers.get("content-length", 0))]


def _row(archive: str, place: int, raw: bytes, with_payload: bool) -> tuple:
    headers, block = parse_record(raw)
    kind, http, payload, text, n_bytes = headers.get("warc-type"), None, None, None, None
    digest = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
    if kind in ("response", "revisit"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = top.decode("utf-8", "replace")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.split("\r\n")[1:])}
        if kind == "response":
            n_bytes, digest = len(payload), sha1_32(payload)  # of what was read, not of what is said of it
        else:
            payload, n_bytes = None, int(fields.get("content-length", 0))
    else:
        text = block.decode("utf-8", "replace")
    strip = lambda v: v.strip("<>") if v else None
    row = (archive, place, strip(headers.get("warc-record-id")), kind, strip(headers.get("warc-concurrent-to")), headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("content-type"), digest, n_bytes, strip(headers.get("warc-refers-to")), http, text)
    return (*row, payload) if with_payload else row


def read(spark: SparkSession, archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives named in column ``archive`` (path or URI); ``payload`` only if asked for."""
    schema = RECORD + (", payload binary" if with_payload else "")
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64() if f.endswith("long") else pa.binary() if f.endswith("binary") else pa.string() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, path = filesystem(archive)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for place, raw in enumerate(_members(stream)):
                        rows.append(_row(archive, place, raw, with_payload))
                        size += len(raw) if with_payload else 600
                        if size > 4 << 20:
                            yield table(rows)
                            rows, size = [], 0
                if rows:
                    yield table(rows)

    return archives.select("archive").mapInArrow(run, schema)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit, with the request and metadata records that concur with it.

    Columns: record_id, type, target_uri, date, payload_digest, payload_bytes, refers_to, http (and payload, if the
    records have it), request, metadata (structs, null if there is none). Records of other types, and those that concur
    with nothing that was read, are left out.
    """
    main = records.where(F.col("type").isin("response", "revisit"))
    keep = ["record_id", "type", "target_uri", "date", "payload_digest", "payload_bytes", "refers_to", "http", *(c for c in records.columns if c == "payload")]
    side = lambda kind: records.where(F.col("type") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id"), F.col("target_uri"), F.col("date"), F.col("block")).alias(kind))
    return main.select(*keep).join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write ``pages`` and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to) per page."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    written = materialize(write(pages, folder, least), "warc-archives")
    n = max(1, written.count())
    records = materialize(read(spark, written.select("archive").repartition(n)), "warc-records")
    met = captures(records)
    own = F.expr("try_cast(regexp_extract(metadata.block, 'page-id: *(-?[0-9]+)', 1) as long)")
    rows = met.select("record_id", F.col("type").alias("record_type"), "payload_digest", "payload_bytes", F.col("refers_to").alias("first_record"), own.alias("page_id"))
    targets = rows.where("record_type = 'response'").select(F.col("record_id").alias("first_record"), F.col("page_id").alias("refers_to"))
    wanted = rows.where("record_type = 'revisit'").select("first_record").distinct()
    targets = targets.join(wanted, "first_record", "left_semi").dropDuplicates(["first_record"])
    return rows.join(targets, "first_record", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


__all__ = ["captures", "parse_record", "read", "round_trip", "sha1_32", "with_first_copies", "write"]
