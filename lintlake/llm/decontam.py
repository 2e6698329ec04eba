"""Benchmark decontamination as a prefix-filtered set join over word windows.

Each benchmark item gives its windows of ``window`` consecutive words (a shorter item is one window); a window is the
set of its word shingles. All shingles are ordered by rarity, their document frequency over the whole corpus. Exact
containment (overlap 1) needs every shingle of the window, so the necessary prefix is its rarest one: documents and
windows are joined on that in Spark. The shingle's offset in the window bounds where the window must begin and end in the
document (positional and length bounds), and what is left is verified word by word.

Neither side is held in memory as a whole. Tasks hold a bitmap of fixed size (``filter_bits``) of the benchmark's
shingles, with which documents give out only those that may meet one; a benchmark that fills it makes the join larger,
not the result other. Documents are read twice, for frequencies and for the join, and their texts are never shuffled.
Equal texts have equal results and are joined once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, with_arrow

#: Words of a window and of a shingle, bits of a filter (8 MB).
WINDOW, SHINGLE, FILTER_BITS = 10, 3, 1 << 26
#: Upper case to lower case; ASCII signs that are no letter or digit to a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
U = np.uint64
BASE, MIX = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
CHUNK = 1 << 20


def _powers(base: U, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS = _powers(BASE, CHUNK)
INVERSE = _powers(U(pow(int(BASE), -1, 1 << 64)), CHUNK)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(32)) * MIX
    return x ^ x >> U(29)


class Words:
    """The words of some texts: where they begin and end in ``raw``, their 64-bit hashes, and the text of each."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        self.raw = (data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None else b"").translate(TABLE)
        offsets = offsets - offsets[0]
        letters = np.frombuffer(self.raw, np.uint8)
        inside = letters != 32
        first = inside.copy()
        cut = offsets[1:-1][offsets[1:-1] < len(letters)]
        first[1:] &= ~inside[:-1]
        first[cut] = inside[cut]  # texts lie one after another
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cut[cut > 0] - 1] = inside[cut[cut > 0] - 1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hash = self._hashes(letters)
        self.doc = np.searchsorted(offsets, self.begin, side="right") - 1
        self.sizes = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.before = np.cumsum(self.sizes) - self.sizes

    def _hashes(self, letters: np.ndarray) -> np.ndarray:
        """Sums of bytes times powers of an odd number, from prefix sums over stretches of whole words."""
        out = np.zeros(len(self.begin), U)
        at = 0
        while at < len(out):
            origin = self.begin[at]
            to = max(at + 1, int(np.searchsorted(self.end, origin + CHUNK, side="right")))
            own = letters[origin : self.end[to - 1]].astype(U) + U(1)
            if len(own) <= CHUNK:
                sums = np.concatenate([np.zeros(1, U), np.cumsum(own * POWERS[: len(own)], dtype=U)])
                lo, hi = self.begin[at:to] - origin, self.end[at:to] - origin
                out[at:to] = (sums[hi] - sums[lo]) * INVERSE[lo]
            else:  # one word longer than a stretch
                value, scale = np.zeros(1, U), np.ones(1, U)
                for p in range(0, len(own), CHUNK):
                    part = own[p : p + CHUNK]
                    value += (part * POWERS[: len(part)]).sum(dtype=U) * scale
                    scale *= POWERS[-1:] * BASE
                out[at] = value[0]
            at = to
        return _mixed(out)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of every run of ``width`` words of one text."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        x = np.full(n, U(width), U)
        for i in range(width):
            x = x * BASE + self.hash[i : n + i]
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        return at, _mixed(x[at])

    def text(self, lo: int, hi: int) -> str:
        """The words from lo to hi, joined by single spaces."""
        return b" ".join([self.raw[b:e] for b, e in zip(self.begin[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True)]).decode("utf-8", "surrogatepass")


class Filter:
    """A bitmap of shingle hashes, two bits each: says no for certain, or perhaps."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.mask, self.words = U(bits - 1), words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in self.places(hashes, self.mask):
            out[out] = (self.words[place[out] >> U(6)] >> (place[out] & U(63)) & U(1)).astype(bool)
        return out

    @staticmethod
    def places(hashes: np.ndarray, mask: U) -> tuple[np.ndarray, np.ndarray]:
        return hashes & mask, hashes >> U(32) & mask


def bitmap(shingles: DataFrame, bits: int = FILTER_BITS) -> Filter:
    """The filter of the column ``shingle``: tasks fold theirs, and at most ``bits / 64`` words reach the driver."""
    if bits & (bits - 1) or not 64 <= bits <= 1 << 31:
        raise ValueError("filter_bits must be a power of two from 64 to 2^31")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            h = batch.column(0).to_numpy().view(U)
            place = np.unique(np.concatenate(Filter.places(h, U(bits - 1))))
            word, first = np.unique(place >> U(6), return_index=True)
            value = np.bitwise_or.reduceat(U(1) << (place & U(63)), first) if len(first) else np.zeros(0, U)
            return pa.RecordBatch.from_pydict({"word": word.astype(np.int64), "bits": value.view(np.int64)})

        return one

    folded = with_arrow(shingles.select("shingle"), "word long, bits long", make, rows=1 << 20).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, U)
    words[folded.column("word").to_numpy()] = folded.column("bits").to_numpy().view(U)
    return Filter(bits, words)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id string, window, m, shingles): every window of every item, its words joined by spaces, their number, and
    the hashes of its shingles in order. Null and wordless items have none."""
    schema = "item_id string, window string, m int, width int, shingles array<long>"

    def run(batches):
        for batch in pieces(batches, 256, "text", 1 << 20):
            names, out = batch.column(0).to_pylist(), {"item_id": [], "window": [], "m": [], "width": [], "shingles": []}
            words = Words(batch.column(1))
            hashes = {}
            for w in range(1, shingle + 1):
                hashes[w] = np.zeros(len(words.hash) + 1, U)
                at, h = words.shingles(w)
                hashes[w][at] = h
            for k, (first, n) in enumerate(zip(words.before.tolist(), words.sizes.tolist(), strict=True)):
                for s in range(first, first + max(1, n - window + 1) if n else first):
                    m = min(window, n)
                    width = min(shingle, m)
                    out["item_id"].append(names[k])
                    out["window"].append(words.text(s, s + m))
                    out["m"].append(m)
                    out["width"].append(width)
                    out["shingles"].append(hashes[width][s : s + m - width + 1].view(np.int64))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("item_id", pa.string()), ("window", pa.string()), ("m", pa.int32()), ("width", pa.int32()), ("shingles", pa.list_(pa.int64()))]))

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).mapInArrow(run, schema)


def _frequencies(texts: DataFrame, filter_: Filter, widths: list[int]) -> DataFrame:
    """(shingle, df): in how many documents each shingle occurs that passes the filter, over all documents."""
    held = texts.sparkSession.sparkContext.broadcast(filter_)

    def make():
        known = held.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(batch.column(0))
            found = []
            for w in widths:
                at, h = words.shingles(w)
                fits = known.has(h)
                own = np.column_stack([words.doc[at[fits]].astype(U), h[fits]])
                found.append(np.unique(own, axis=0)[:, 1] if len(own) else own[:, 1])
            value, n = np.unique(np.concatenate(found) if found else np.zeros(0, U), return_counts=True)
            return pa.RecordBatch.from_pydict({"shingle": value.view(np.int64), "n": n.astype(np.int64)})

        return one

    return with_arrow(texts, "shingle long, n long", make, "text").groupBy("shingle").agg(F.sum("n").alias("df"))


def _scan(docs: DataFrame, filter_: Filter, widths: list[int], window: int) -> DataFrame:
    """(doc_id, key, n_words, met): of each document the shingles that pass the filter, with the words around them that a
    window can reach: met is an array of (shingle, at, before, context), at the position, before the words ahead of it."""
    held = docs.sparkSession.sparkContext.broadcast(filter_)
    met = pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("context", pa.string())]))
    shown = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_words", pa.int64()), ("met", met)])

    def make():
        known = held.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(batch.column(2))
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for w in widths:
                at, h = words.shingles(w)
                fits = np.flatnonzero(known.has(h))
                reach = window - w if w == max(widths) else 0  # a shorter shingle is a window of its own
                for p, x in zip(at[fits].tolist(), h[fits].view(np.int64).tolist(), strict=True):
                    k = int(words.doc[p])
                    first, n = int(words.before[k]), int(words.sizes[k])
                    lo, hi = max(first, p - reach), min(first + n, p + w + reach)
                    rows[k].append({"shingle": x, "at": p - first, "before": p - lo, "context": words.text(lo, hi)})
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words.sizes), pa.array(rows, met)], schema=shown)

        return one

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").alias("text"))
    return with_arrow(source, "doc_id long, key binary, n_words long, met array<struct<shingle:long,at:int,before:int,context:string>>", make, "text")


def text_key() -> Column:
    """What stands for a text: its SHA-256; a null text is empty."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """What the documents and the benchmark have in common, as two tables.

    The first has a row per document: (doc_id, key, n_words). The second a row per text with an occurrence: (key, n_hit,
    items): n_hit is the number of words inside any occurrence of a window, items the sorted item_ids (as strings) with a
    window that occurs. Items with a null id count for hits but are not listed.
    """
    made = materialize(benchmark_windows(benchmark, window, shingle), "windows")
    windows = made.groupBy("window").agg(F.first("m").alias("m"), F.first("width").alias("width"), F.first("shingles").alias("shingles"))
    parts = materialize(windows.select("window", "m", "width", F.size("shingles").alias("n"), F.posexplode("shingles").alias("offset", "shingle")), "window-shingles")
    widths = sorted(r["width"] for r in parts.select("width").distinct().collect())  # at most ``shingle`` numbers
    frequency = _frequencies(docs.select("text"), bitmap(parts, filter_bits), widths)
    rarest = F.min(F.struct("df", "shingle", "offset")).alias("r")
    prefix = parts.join(frequency, "shingle").groupBy("window", "m", "n").agg(F.count("*").alias("there"), rarest).where("there = n")
    prefix = materialize(prefix.select("window", "m", F.col("r.shingle").alias("shingle"), F.col("r.offset").alias("offset")), "window-prefixes")
    found = materialize(_scan(docs, bitmap(prefix, filter_bits), widths, window), "contamination")

    once = found.where(F.size("met") > 0).groupBy("key").agg(F.first("met").alias("met"))
    near = once.select("key", F.inline("met")).join(prefix, "shingle").where("offset <= before")
    words = F.slice(F.split("context", " "), F.col("before") - F.col("offset") + 1, F.col("m"))
    same = near.where(F.array_join(words, " ") == F.col("window")).select("key", (F.col("at") - F.col("offset")).alias("start"), "m", "window")
    # windows with the same items are one class, texts with the same classes have the same items
    owners = made.where("item_id is not null").select("window", "item_id").distinct()
    of_window = owners.groupBy("window").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("class"))
    place = F.struct("start", (F.col("start") + F.col("m")).alias("end"))
    per = same.join(of_window, "window", "left").groupBy("key").agg(F.array_sort(F.collect_set(place)).alias("spans"), F.array_sort(F.collect_set("class")).alias("classes"))
    state = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    grow = lambda s, x: F.struct(F.greatest(s["to"], x["end"]).alias("to"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["to"], x["start"]))).alias("n"))
    per = materialize(per.select("key", F.aggregate("spans", state, grow, lambda s: s["n"]).alias("n_hit"), "classes", F.sha2(F.array_join("classes", ","), 256).alias("set")), "contaminated")
    sets = per.groupBy("set").agg(F.first("classes").alias("classes")).select("set", F.explode("classes").alias("class"))
    one_window = of_window.groupBy("class").agg(F.min("window").alias("window"))
    listed = sets.join(one_window, "class").join(owners, "window").select("set", "item_id").distinct().groupBy("set").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    hits = per.join(listed, "set", "left").select("key", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return found.select("doc_id", "key", "n_words"), materialize(hits, "contaminated-items")


def report(docs: DataFrame, benchmark: DataFrame, **how: int) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) for every row of ``docs``.

    Null and empty texts have no words; without items nothing is hit. Null ids and repeated rows stay as they are; extra
    columns are dropped. ``how`` goes to scanned().
    """
    rows, hits = scanned(docs, benchmark, **how)
    all_ = rows.join(hits, "key", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return all_.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def clean(docs: DataFrame, benchmark: DataFrame, **how: int) -> DataFrame:
    """``docs`` without the contaminated rows; the other rows, repeated ones and null texts too, and all columns as they
    were. A text meets the contaminated ones by its key; the optimizer broadcasts those only where they are few."""
    _, hits = scanned(docs, benchmark, **how)
    return docs.withColumn("_key", text_key()).join(hits.select(F.col("key").alias("_key")), "_key", "left_anti").select(*docs.columns)
