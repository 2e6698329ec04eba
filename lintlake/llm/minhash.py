"""MinHash fingerprints over word 5-shingles: universal hash permutations in numpy, bands joined in Spark.

A shingle's base value mixes the XXH64 of its words; permutation k maps it to ``a_k * x + b_k`` modulo 2^64 (odd a_k, a
universal family), and the signature keeps, per permutation, 16 mixed bits of the smallest value. Two signatures agree
in a share of places that estimates the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, connected_components, discard, materialize, pieces, with_arrow
from .decontam import bitmap
from .simhash import LOWER, Forest

PERMUTATIONS, WIDTH = 128, 5
CACHE = 300_000
#: Text of a range of documents that one task holds, and the most ranges: their bounds are held by every task.
RANGE_BYTES, RANGES = 32 << 20, 100_000
U = np.uint64


def family(k: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of k permutations."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**64, k, dtype=U) | U(1), rng.integers(0, 2**64, k, dtype=U)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Hasher:
    """Signatures of texts; holds the permutations and a bounded cache of word hashes."""

    def __init__(self, k: int = PERMUTATIONS, width: int = WIDTH, seed: int = 20) -> None:
        self.a, self.b = family(k, seed)
        self.width, self.words = width, WordHash()
        self.powers = family(width, seed + 1)[0]

    def word_hashes(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
        return np.fromiter(map(self.words.__getitem__, words), U, len(words))

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """Base value of each window of ``width`` words; of all words if there are fewer; none without words."""
        if not len(words):
            return words
        w = min(self.width, len(words))
        n = len(words) - w + 1
        x = np.zeros(n, U)
        for i in range(w):
            x += words[i : i + n] * self.powers[i]
        x ^= x >> U(32)
        x *= U(0x9E3779B97F4A7C15)
        return x ^ (x >> U(29))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFFFFFFFFFF, U)
        for at in range(0, len(shingles), 512):
            values = np.multiply.outer(shingles[at : at + 512], self.a)
            values += self.b
            np.minimum(low, values.min(axis=0), out=low)
        return low

    @staticmethod
    def signature(minima: np.ndarray) -> np.ndarray:
        return ((minima * U(0xD6E8FEB86659FD93)) >> U(48)).astype(">u2")

    def of(self, text: str | None) -> np.ndarray:
        return self.signature(self.minima(self.shingles(self.word_hashes(text or ""))))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal places: an estimate of the Jaccard similarity, 1 for equal texts."""
    return float(np.count_nonzero(a == b)) / len(a)


class Ranges:
    """Ranges of (doc_id, hash of the text), about equally full: an id that fills several is cut by the hash."""

    def __init__(self, quantiles: list[int]) -> None:
        ids, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
        self.ids = np.repeat(ids, times)
        nth = np.arange(len(self.ids)) - np.repeat(np.cumsum(times) - times, times)
        share = np.repeat(times, times).astype(object)
        # the first cut of an id lies before all its texts, the others at equal steps of their hashes
        self.hashes = np.array([-(2**63) + int(i) * 2**64 // int(n) for i, n in zip(nth, share, strict=True)], np.int64)

    def of(self, rank: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Range numbers: how many cuts are not above (rank, hash)."""
        low, high = np.searchsorted(self.ids, rank, side="left"), np.searchsorted(self.ids, rank, side="right")
        out = low.copy()
        for i in np.flatnonzero(high > low):
            out[i] = low[i] + np.searchsorted(self.hashes[low[i] : high[i]], hashes[i], side="right")
        return out


_BLOCK = pa.schema([("doc_id", pa.int64()), ("rank", pa.int64()), ("hash", pa.int64()), ("text", pa.large_string())])


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _BLOCK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(blocks: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blocks])


def _dealt(docs: DataFrame, n_ranges: int) -> DataFrame:
    """(part, guest, block): the documents of a range in compressed blocks, dealt by range; the first document of each
    range comes as a guest to the range before (to the last one, that of the first), where it is the successor."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("rank"), F.xxhash64(text).alias("hash"), text.alias("text"))
    wanted = [i / n_ranges for i in range(1, n_ranges)]
    cuts = source.agg(F.percentile_approx("rank", wanted, max(10_000, 4 * n_ranges))).first()[0] or []
    ranges = spark.sparkContext.broadcast(Ranges(sorted(cuts)))  # fewer numbers than ranges

    def lowest():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rank, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((hashes, rank))
            part, first = np.unique(ranges.value.of(rank, hashes)[order], return_index=True)
            return columns(batch, part=part.astype(np.int64), rank=rank[order][first], hash=hashes[order][first])

        return one

    found = with_arrow(source.select("rank", "hash"), "part long, rank long, hash long", lowest, rows=1 << 16)
    firsts = {r["part"]: tuple(r["low"]) for r in found.groupBy("part").agg(F.min(F.struct("rank", "hash")).alias("low")).collect()}  # a row per range
    order = sorted(firsts)
    shared = spark.sparkContext.broadcast({firsts[p]: order[i - 1] for i, p in enumerate(order)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = ranges.value, shared.value
        for batch in pieces(batches, 1 << 14, "text"):
            table = pa.table({"doc_id": batch.column(0), "rank": batch.column(1), "hash": batch.column(2), "text": batch.column(3).cast(pa.large_string())}, schema=_BLOCK)
            rank, hashes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            part = own.of(rank, hashes)
            rows = [(int(p), 0, np.flatnonzero(part == p)) for p in np.unique(part)]
            rows += [(before[k], 1, np.array([i])) for i, k in enumerate(zip(rank.tolist(), hashes.tolist(), strict=True)) if k in before]
            for p, guest, at in rows:
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int64()), "guest": pa.array([guest], pa.int32()), "block": pa.array([_packed(table.take(at))], pa.binary())})

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return source.mapInArrow(run, "part long, guest int, block binary").repartition(n_parts, "part").sortWithinPartitions("part", "guest")


def fingerprint_with_edit(docs: DataFrame, k: int = PERMUTATIONS) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likenesses.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text
    has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document in ascending
    doc_id; after the last comes the first. Null texts are empty; texts without words share one fingerprint. Rows with a
    null doc_id come first; rows with equal doc_id are ordered by the hash of their text, so a repeated row may be its
    own successor. Extra columns are dropped; an empty table gives an empty result.

    Documents are dealt by ranges of doc_id, in compressed blocks, so their text is shuffled once. A task holds one range
    at a time, however many rows one id has: at most a quarter of a shuffle partition and, by the optimizer's estimate of
    the table, ``RANGE_BYTES`` of text (more only beyond ``RANGES`` ranges, some 3 TB).
    """
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = 2 * int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # texts are stored compressed
    dealt = _dealt(docs, max(2, min(RANGES, max(4 * n_parts, size // RANGE_BYTES))))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    fields = [(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(k)

        def measure(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
            """Words, minima of the shingles that no edit reaches, minima of all, number of shared shingles."""
            words = hasher.word_hashes(text)
            shingles = hasher.shingles(words)
            kept = len(text[: len(text) - len(text) // 4].encode("utf-8", "surrogatepass").split()) - 1
            shared = max(0, kept - hasher.width + 1)
            part = hasher.minima(shingles[:shared])
            return words, part, np.minimum(part, hasher.minima(shingles[shared:])), shared

        def row(doc_id: int | None, text: str, measured: tuple, next_text: str, next_measured: tuple) -> tuple:
            words, part, all_, shared = measured
            cut = len(text) // 4
            edited = text[: len(text) - cut] + next_text[:cut]
            new = hasher.word_hashes(edited)
            changed = hasher.shingles(new[shared:] if shared else new)
            a, b, c = hasher.signature(all_), hasher.signature(np.minimum(part, hasher.minima(changed))), hasher.signature(next_measured[2])
            return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), likeness(a, b), likeness(a, c)

        def ranged(blocks: list[bytes], guest: bytes | None) -> Iterator[pa.RecordBatch]:
            table = _unpacked(blocks)
            order = np.lexsort((table.column("hash").to_numpy(), table.column("rank").to_numpy()))
            table = table.take(order)
            if guest is not None:
                table = pa.concat_tables([table, _unpacked([guest]).slice(0, 1)])
            out, last = [], None
            for part in table.to_batches(max_chunksize=512):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    measured = measure(text)
                    if last is not None:
                        out.append(row(*last, text, measured))
                    last = (doc_id, text, measured)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])
                    out = []

        at, blocks, guest = None, [], None
        for batch in batches:
            for part, is_guest, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    if blocks:
                        yield from ranged(blocks, guest)
                    at, blocks, guest = part, [], None
                if is_guest:
                    guest = guest or block
                else:
                    blocks.append(block)
        if blocks:
            yield from ranged(blocks, guest)

    return dealt.mapInArrow(run, schema)


def similar_within(members: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of a spanning forest of the pairs of sorted sets whose Jaccard similarity reaches ``threshold``."""
    sizes = np.array([len(m) for m in members], np.int64)
    forest = Forest(len(members))
    for i in range(len(members) - 1):
        j = np.arange(i + 1, len(members))
        fits = (forest.label[j] != forest.label[i]) & (np.minimum(sizes[j], sizes[i]) >= threshold * np.maximum(sizes[j], sizes[i]) - 1e-9)
        j = j[fits & (sizes[j] > 0)]
        if not len(j) or not sizes[i]:
            continue
        all_ = np.concatenate([members[k] for k in j])
        place = np.minimum(np.searchsorted(members[i], all_), sizes[i] - 1)
        both = np.add.reduceat((members[i][place] == all_).astype(np.int64), np.cumsum(sizes[j]) - sizes[j])
        near = j[(both > 0) & (both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9)]
        forest.add(np.full(len(near), i), near)
    return forest.links()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 32, k: int = PERMUTATIONS, bucket: int = 256) -> DataFrame:
    """(doc_id, fingerprint, class_id, tree_links) for every row of ``docs``.

    Distinct shingle sets whose signatures meet in a band of ``k / bands`` places are candidates; links are those whose
    exact Jaccard similarity of 5-word shingle sets reaches ``threshold``. class_id: smallest doc_id reachable over
    links. tree_links: links of the row's set in a spanning forest of its class, not all its links: those of a group of
    copies grow with its square. Sets are compared inside their band bucket, a bucket of more than ``bucket`` sets in
    pairs of chunks; buckets of several bands with the same members are one, so a set travels once for each different
    bucket. Texts are read twice: for signatures, and for the shingles of one document of each set that shares a
    bucket, which a bitmap of fixed size tells; no other shingles leave their task. Null, empty and wordless texts form
    one class; null doc_ids get a class but never name one; repeated rows stay repeated; extra columns are dropped.
    """
    rows = k // bands

    def hashed(hasher: Hasher, text: str | None) -> tuple[np.ndarray, int]:
        shingles = np.unique(hasher.shingles(hasher.word_hashes(text or "")).view(np.int64))
        return shingles, int(np.array([xxhash.xxh64_intdigest(shingles.tobytes())], U).view(np.int64)[0])

    def sign():
        hasher = Hasher(k)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [hashed(hasher, text) for text in batch.column(2).to_pylist()]
            prints = [hasher.signature(hasher.minima(s.view(U))).tobytes() for s, _ in made]
            return columns(batch, doc_id=batch.column(0), mark=batch.column(1), set_id=pa.array([i for _, i in made], pa.int64()), fingerprint=pa.array(prints, pa.binary()))

        return one

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("mark"), F.col("text").alias("text"))
    signed = materialize(with_arrow(source, "doc_id long, mark long, set_id long, fingerprint binary", sign, "text"), "minhash")
    sets = materialize(signed.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("mark").alias("mark"), F.first("fingerprint").alias("fingerprint")), "minhash-sets")
    keyed = sets.select("set_id", F.posexplode(F.array(*[F.expr(f"xxhash64(substring(fingerprint, {2 * rows * b + 1}, {2 * rows}))") for b in range(bands)])).alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, ["band", "key"]).withColumn("chunks", F.ceil(F.col("n") / bucket).cast("int"))
    met = met.withColumn("chunk", F.pmod(F.xxhash64("set_id", F.lit(1)), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    lists = met.groupBy("band", "key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")).agg(F.array_sort(F.collect_list("set_id")).alias("ids"))
    lists = materialize(lists.where(F.size("ids") > 1).select("ids").distinct(), "minhash-buckets")
    place = lists.select(F.xxhash64("ids").alias("x"), F.xxhash64(F.lit(1), "ids").alias("y"), F.explode("ids").alias("set_id"))
    marks = sets.join(place.select("set_id").distinct(), "set_id", "left_semi").select(F.col("mark").alias("shingle"))
    held = docs.sparkSession.sparkContext.broadcast(bitmap(marks))

    def unfold():
        hasher = Hasher(1)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            known = held.value.has(batch.column(0).to_numpy().view(U))
            made = [hashed(hasher, text) for text in batch.column(1).filter(pa.array(known)).to_pylist()]
            return columns(batch, set_id=pa.array([i for _, i in made], pa.int64()), shingles=pa.array([s for s, _ in made], pa.list_(pa.int64())))

        return one

    wanted = with_arrow(source.select("mark", "text"), "set_id long, shingles array<long>", unfold, "text").groupBy("set_id").agg(F.first("shingles").alias("shingles"))
    groups = place.join(wanted, "set_id").groupBy("x", "y").agg(F.collect_list(F.struct("set_id", "shingles")).alias("members")).select("members")

    def verify():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = [], []
            for members in batch.column(0):
                own = members.values
                ids = own.field("set_id").to_numpy()
                i, j = similar_within([x.values.to_numpy() for x in own.field("shingles")], threshold)
                a.append(ids[i])
                b.append(ids[j])
            both = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
            return columns(batch, a=both[0].astype(np.int64), b=both[1].astype(np.int64))

        return one

    edges = materialize(with_arrow(groups, "a long, b long", verify, rows=64).distinct(), "minhash-links")
    discard(lists)
    found = connected_components(edges, "minhash-links")
    degree = edges.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("tree_links"))
    member = found.withColumnRenamed("node", "set_id").join(sets.select("set_id", "rep"), "set_id")
    linked = member.join(member.groupBy("component").agg(F.min("rep").alias("lowest")), "component").select("set_id", "lowest")
    table = sets.select("set_id", "rep").join(linked, "set_id", "left").join(degree, "set_id", "left").select("set_id", F.coalesce("lowest", "rep").alias("class_id"), F.coalesce("tree_links", F.lit(0)).alias("tree_links"))
    table = materialize(table, "minhash-table")  # so that the last join has a shuffle on either side, and a hot set is split
    return signed.select("doc_id", "fingerprint", "set_id").join(table, "set_id").select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "class_id", "tree_links")
