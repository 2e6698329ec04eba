"""SimHash near-duplicates with bit-sliced comparison.

A 64-bit fingerprint per text (majority vote of the bits of its shingles' XXH64), links between fingerprints that differ
in at most ``radius`` bits, and the connected components of those links.

Candidates: the 64 bits are cut into ``radius + 2`` blocks; two fingerprints within the radius agree on at least two of
them, so every pair of blocks gives a table of buckets keyed by those bits, and each link is found in some bucket. Equal
fingerprints are collapsed before. A bucket of more than ``bucket`` fingerprints is dealt into chunks, and each pair of
chunks is compared in a task of its own, so no bucket is cut and none meets in one task.

Comparison: the bit planes of a bucket are stored vertically (bit b of 64 fingerprints in one word); the distances of
64 pairs advance together by carry-save counters, plane by plane, and words whose 64 counters have all passed the radius
are abandoned. Of the links in a bucket only a spanning forest is emitted: components stay the same.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALL_ONES, columns, connected_components, materialize, with_arrow

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
FULL = np.uint64(ALL_ONES)
SMALL = 96


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned integer; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), seed)
    n = len(words) - width + 1
    hashes = np.fromiter((digest(b" ".join(g), seed) for g in zip(*(words[i:] for i in range(width)), strict=False)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint's bits as a signed long. A null text has no words."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            return columns(batch, doc_id=batch.column(0), fp=fps.view(np.int64))

        return one

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_arrow(source, "doc_id long, fp long", make, "text")


def planes(fps: np.ndarray) -> np.ndarray:
    """Vertical bit planes: (64, words + 2), lane i of plane b is bit i % 64 of word i // 64; the rest is zero."""
    lanes = -(-len(fps) // 64) * 64
    bits = np.zeros((lanes, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    return np.concatenate([packed, np.zeros((64, 2), np.uint64)], axis=1)


def lanes_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, lane) of each bit that is set."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.nonzero(bits)


def survivors(differs, over: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save counting. differs(b, at): words of plane b in which pairs differ, for the positions ``at``.

    over: lanes that don't count (set bits). Returns the positions left and their words of lanes within the radius.
    """
    n_bits = radius.bit_length()
    start = (1 << n_bits) - 1 - radius  # so that radius + 1 differences overflow the counter
    at = np.flatnonzero(over != FULL)
    over = over[at]
    count = [np.full(len(at), FULL if start >> i & 1 else 0, np.uint64) for i in range(n_bits)]
    for b in range(64):
        carry = differs(b, at)
        for i in range(n_bits):
            count[i], carry = count[i] ^ carry, count[i] & carry
        over = over | carry
        if b % 8 == 7:
            alive = over != FULL
            if not alive.all():
                at, over, count = at[alive], over[alive], [c[alive] for c in count]
                if not len(at):
                    break
    return at, ~over


class Forest:
    """Spanning forest of links that arrive in parts."""

    def __init__(self, n: int) -> None:
        self.label, self.kept = np.arange(n), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            new = a != b
            i, j, a, b = i[new], j[new], a[new], b[new]
            if not len(i):
                return
            high, low = np.maximum(a, b), np.minimum(a, b)
            high, first = np.unique(high, return_index=True)
            self.kept.append((i[first], j[first]))
            parent = np.arange(len(self.label))
            parent[high] = low[first]
            while not np.array_equal(parent, up := parent[parent]):
                parent = up
            self.label = parent[self.label]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([k[0] for k in self.kept]), np.concatenate([k[1] for k in self.kept])


def links_within(fps: np.ndarray, sizes: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of a spanning forest of the links in each group; groups lie one after another in ``fps``.

    Small groups of the batch are compared together, every lane with the lane ``shift`` further; a large one block by
    block, 64 members against all that follow.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    group = np.repeat(np.arange(len(sizes)), sizes)
    forest = Forest(len(fps))
    small = np.flatnonzero((sizes <= SMALL)[group]) if len(sizes) else np.zeros(0, np.int64)
    if len(small) > 1:
        part, own = planes(fps[small]), group[small]
        for shift in range(1, int(sizes[sizes <= SMALL].max())):
            same = np.zeros(part.shape[1] * 64, np.uint8)
            same[: len(own) - shift] = own[:-shift] == own[shift:]
            alive = np.packbits(same, bitorder="little").view("<u8")[:-2]
            if not alive.any():
                break
            q, r = divmod(shift, 64)

            def differs(b: int, at: np.ndarray, q=q, r=r) -> np.ndarray:
                moved = part[b, at + q] >> np.uint64(r)
                if r:
                    moved = moved | part[b, np.minimum(at + q + 1, part.shape[1] - 1)] << np.uint64(64 - r)
                return part[b, at] ^ moved

            at, found = survivors(differs, ~alive, radius)
            w, lane = lanes_of(found)
            i = at[w] * 64 + lane
            forest.add(small[i], small[i + shift])
    for g in np.flatnonzero(sizes > SMALL):
        lo, n = starts[g], int(sizes[g])
        part = planes(fps[lo : lo + n])[:, :-2]
        n_words = part.shape[1]
        lane_no = np.arange(n_words * 64)
        for q0 in range(0, n, 64):
            block = fps[lo + q0 : lo + min(n, q0 + 64)]
            first, wide = q0 // 64, n_words - q0 // 64
            used = (lane_no[None, first * 64 :] > q0 + np.arange(len(block))[:, None]) & (lane_no[None, first * 64 :] < n)
            alive = np.packbits(used, axis=1, bitorder="little").view("<u8").reshape(-1)

            def differs(b: int, at: np.ndarray, part=part, block=block, first=first, wide=wide) -> np.ndarray:
                own = np.where(block >> np.uint64(b) & np.uint64(1), FULL, np.uint64(0))
                return part[b, first + at % wide] ^ own[at // wide]

            at, found = survivors(differs, ~alive, radius)
            w, lane = lanes_of(found)
            forest.add(lo + q0 + at[w] // wide, lo + (first + at[w] % wide) * 64 + lane)
    return forest.links()


def links(fps: DataFrame, radius: int = 3, bucket: int = 4096) -> DataFrame:
    """(a, b): links between the distinct values of ``fp`` that give the components of all pairs within the radius."""
    n = radius + 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    masks = []
    for pair in combinations(range(n), 2):
        mask = sum(((1 << cuts[k + 1]) - (1 << cuts[k])) for k in pair)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, ["t", "key"]).withColumn("chunks", F.ceil(F.col("n") / bucket).cast("int"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    met = met.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    groups = met.groupBy("t", "key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")).agg(F.collect_list("fp").alias("fps"))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(0)
            sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
            i, j = links_within(values.view(np.uint64), sizes, radius)
            return columns(batch, a=values[i], b=values[j])

        return one

    return with_arrow(groups.where(F.size("fps") > 1).select("fps"), "a long, b long", make, rows=4096)


def _labelled(fps: DataFrame, radius: int, bucket: int) -> DataFrame:
    """(fp, label, lowest) for each value of ``fp`` in ``fps`` (doc_id, fp): the smallest fingerprint and the smallest
    doc_id that links reach."""
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-reps")
    found = connected_components(links(reps.select("fp"), radius, bucket), "simhash-links")
    member = found.withColumnRenamed("node", "fp").join(reps, "fp")
    lowest = member.groupBy("component").agg(F.min("rep").alias("lowest"))
    linked = member.join(lowest, "component").select("fp", "component", "lowest")
    table = reps.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("label"), F.coalesce("lowest", "rep").alias("lowest"))
    return materialize(table, "simhash-table")  # so that the last join has a shuffle on either side, and a hot fingerprint is split


def components(docs: DataFrame, radius: int = 3, bucket: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    fingerprint: 16 lower-case hex digits. component_id: the smallest doc_id among the rows that links of at most
    ``radius`` differing bits reach, the row included. Null and empty texts have fingerprint zero, which links like any
    other. Rows with a null doc_id get a component but never name one (null if no row of it has an id); repeated rows
    stay repeated; extra columns are dropped; an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    table = _labelled(fps, radius, bucket)
    return fps.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("lowest").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = 3, bucket: int = 4096) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id, all columns as they were.

    Rows, not ids, are kept: an id that several texts have stands for a row of each. Of rows with the same id the one
    with the smaller hash of its text stays, of rows that are repeated with their text one. A row without an id stays
    only if no row of its component has one. Null and empty texts are one component.

    Documents meet the rows that stay by a shuffle at every size: those grow with the documents, and a broadcast while
    they are few would only hide what the stage costs.
    """
    text = F.coalesce("text", F.lit(""))
    marks = {"_id": F.col("doc_id").cast("long"), "_x": F.xxhash64(text), "_y": F.xxhash64(F.lit(17), text)}
    keyed = docs.select(*[v.alias(k) for k, v in marks.items()], "text")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.fromiter((fingerprint(t) for t in batch.column(3).to_pylist()), np.uint64, batch.num_rows)
            return columns(batch, doc_id=batch.column(0), _x=batch.column(1), _y=batch.column(2), fp=fps.view(np.int64))

        return one

    fps = materialize(with_arrow(keyed, "doc_id long, _x long, _y long, fp long", make, "text"), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_x", "_y")
    stay = fps.join(_labelled(fps, radius, bucket), "fp").groupBy("label").agg(F.min(row).alias("r"))
    stay = stay.select(F.col("r.doc_id").alias("_id"), F.col("r._x").alias("_x"), F.col("r._y").alias("_y"))
    again = fps.groupBy(F.col("doc_id").alias("_id"), "_x", "_y").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    stay, again = materialize(stay, "simhash-stay"), materialize(again, "simhash-again")
    same = lambda side: F.col("_id").eqNullSafe(side["_i"]) & (F.col("_x") == side["_a"]) & (F.col("_y") == side["_b"])
    renamed = lambda df: df.select(F.col("_id").alias("_i"), F.col("_x").alias("_a"), F.col("_y").alias("_b"))
    wanted = renamed(stay).hint("shuffle_hash")
    kept = docs.withColumns(marks).join(wanted, same(wanted), "left_semi")
    if not again.isEmpty():  # rows repeated with id and text: one of them, by the other columns
        twice = renamed(again)
        rest = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
        order = Window.partitionBy("_id", "_x", "_y").orderBy(*rest, "text")
        once = kept.join(twice, same(twice), "left_semi").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        kept = kept.join(twice, same(twice), "left_anti").unionByName(once)
    return kept.select(*docs.columns)
