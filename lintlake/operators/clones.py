"""Clone detection: normalised tokens, k-gram fingerprints, exact and LSH pairs, history, clone rate."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import FNV_OFFSET, FNV_PRIME, MASK, MIX_A, MIX_B, MIX_STEP, SEPARATOR
from ..session import materialize

#: Sizes of the signature, its bands, grams; limits of results; pairs that are compared exhaustively.
SIGNATURE, BANDS, ROWS, GRAM = 128, 16, 8, 12
FILE_PAIRS, HISTORY_PAIRS, REPORT_PAIRS, EXHAUSTIVE = 5, 50, 50, 10_000


def token_value(type_: Column) -> Column:
    """Class of a leaf by its node type; null for comments."""
    t = F.lower(type_)
    has = lambda *words: F.coalesce(*[F.when(t.contains(w), True) for w in words], F.lit(False))
    return (
        F.when(has("comment"), None)
        .when(has("identifier") | t.endswith("_name"), "ID")
        .when(has("string", "template", "char_literal"), "STR")
        .when(has("number", "integer", "float", "decimal", "hex"), "NUM")
        .otherwise(type_)
    )


def tokens() -> Column:
    """Normalised tokens of a row's nodes: leaves of all kinds, empty ones and comments left out."""
    leaves = F.filter("nodes", lambda n: n["leaf"] & (n["end_off"] > n["start_off"]))
    made = F.transform(leaves, lambda n: F.struct(token_value(n["type"]).alias("value"), (n["start_row"] + 1).alias("line")))
    return F.filter(made, lambda x: x["value"].isNotNull())


def list_parts(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of an array column one after another, and how many each row has (0 for null)."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), sizes


def _units(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 code units of all words, each followed by the separator, and where each word begins (with the end)."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if len(words) else np.zeros(1, np.int64)
    if len(raw) and raw.max() >= 0x80:
        starts = (raw & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(starts.astype(np.int64) + (raw >= 0xF0))])
        units = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-16-le"), "<u2")
        offsets = before[offsets]
    else:
        units = raw.astype(np.uint16)
    out = np.full(len(units) + len(words), ord(SEPARATOR), np.uint16)
    out[np.arange(len(units)) + np.repeat(np.arange(len(words)), np.diff(offsets))] = units
    return out, offsets + np.arange(len(words) + 1)


def _fnv(units: np.ndarray, begin: np.ndarray, size: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """FNV-1a of runs of ``units``; the runs of a block advance together, the longest first."""
    out = np.empty(len(begin), np.uint32)
    prime = np.uint32(FNV_PRIME)
    for at in range(0, len(begin), block):
        own = size[at : at + block]
        order = np.argsort(-own, kind="stable")
        place, length = begin[at : at + block][order], own[order]
        h = np.full(len(order), FNV_OFFSET, np.uint32)
        growing = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        for n in growing.tolist():
            h[:n] ^= units[place[:n]]
            h[:n] *= prime
            place[:n] += 1
        out[at + order] = h
    return out


def _all_grams(words: pa.StringArray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """FNV-1a hashes of all grams of all lists in order, and how many each list has."""
    units, begins = _units(words)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    width = np.minimum(k, counts)
    grams = np.where(counts > 0, counts - width + 1, 0)
    start = np.repeat(first, grams) + np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams)
    begin = begins[start]
    return _fnv(units, begin, begins[start + np.repeat(width, grams)] - 1 - begin), grams


def ordered_gram_hashes(words: pa.StringArray, counts: np.ndarray, k: int = GRAM) -> list[np.ndarray]:
    """Hashes of each list's grams of min(k, n) values, in order; ``words`` are the values of all lists."""
    hashes, grams = _all_grams(words, counts, k)
    return np.split(hashes.astype(np.int64), np.cumsum(grams)[:-1]) if len(grams) else []


def _distinct_grams(column: pa.ListArray, k: int) -> pa.ListArray:
    """Distinct hashes of each list's grams, in order of first appearance."""
    hashes, grams = _all_grams(*list_parts(column), k)
    of = np.repeat(np.arange(len(grams), dtype=np.uint64), grams)
    kept = np.sort(np.unique(of << np.uint64(32) | hashes, return_index=True)[1])
    sizes = np.bincount(of[kept].astype(np.int64), minlength=len(grams)) if len(grams) else grams
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[kept].astype(np.int64)))


def _mapped(df: DataFrame, column: str, out: str, work, rows: int = 512) -> DataFrame:
    """``df`` with ``column`` (an array) replaced by the array<bigint> ``out`` that ``work`` makes of an Arrow array of it."""
    keep = [c for c in df.columns if c not in (column, out)]
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), T.StructField(out, T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], work(part.column(part.num_columns - 1))], names=[*keep, out])

    return df.select(*keep, column).mapInArrow(run, schema)


def with_gram_hashes(df: DataFrame, values: str, out: str = "k_gram_hashes", k: int = GRAM) -> DataFrame:
    """``df`` with the tokens in ``values`` replaced by their distinct gram hashes, in order of first appearance.

    Arrow batches: all grams of a batch are hashed together from the buffer of its words. The hashes are used several
    times downstream, and a mapped column is never evaluated twice.
    """
    return _mapped(df, values, out, lambda column: _distinct_grams(column, k))


def _signatures(column: pa.ListArray, size: int = SIGNATURE, block: int = 1 << 15) -> pa.ListArray:
    """MinHash signatures of lists of 32-bit hashes, list after list within a block; empty for an empty list."""
    values, counts = list_parts(column)
    v = values.to_numpy(zero_copy_only=False).astype(np.uint32)
    seeds = (np.arange(1, size + 1, dtype=np.uint64) * MIX_STEP & MASK).astype(np.uint32)
    full = np.flatnonzero(counts)
    low = np.full((size, len(full)), MASK, np.uint32)
    ends = np.cumsum(counts[full])
    for at in range(0, len(v), block):
        part = v[at : at + block]
        lo, hi = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, at + len(part) - 1, side="right")
        cuts = np.maximum((ends - counts[full])[lo : hi + 1] - at, 0)
        for s, seed in enumerate(seeds):
            h = part ^ seed
            h ^= h >> np.uint32(16)
            h *= np.uint32(MIX_A)
            h ^= h >> np.uint32(13)
            h *= np.uint32(MIX_B)
            h ^= h >> np.uint32(16)
            np.minimum(low[s, lo : hi + 1], np.minimum.reduceat(h, cuts), out=low[s, lo : hi + 1])
    sizes = np.where(counts > 0, size, 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(low.T).reshape(-1).astype(np.int64)))


def minhash(df: DataFrame, hashes: str = "k_gram_hashes", out: str = "signature") -> DataFrame:
    """``df`` with the MinHash signature of an array of 32-bit hashes; empty for none. Arrow batches, numpy."""
    return _mapped(df.withColumn("_h", F.col(hashes)), "_h", out, _signatures)


def fingerprints(parsed: DataFrame, metrics: DataFrame) -> DataFrame:
    """(project_key, file, language, token_count, k_gram_size, k_gram_hashes, signature, ncloc) per file."""
    df = parsed.select("project_key", "file", "language", F.transform(tokens(), lambda t: t["value"]).alias("values"))
    n = F.size("values").cast("bigint")
    df = df.select("project_key", "file", "language", n.alias("token_count"), F.least(F.lit(GRAM), F.greatest(F.lit(1), n)).cast("bigint").alias("k_gram_size"), "values")
    return minhash(with_gram_hashes(df, "values")).join(metrics.select("project_key", "file", "ncloc"), ["project_key", "file"])


def bands(df: DataFrame, keep: list[str], signature: str = "signature") -> DataFrame:
    """(keep..., band, band_key): one row per band of each full signature; shorter ones have no bands."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.array_join(F.slice(signature, b * ROWS + 1, ROWS).cast("array<string>"), ",").alias("key")))
    full = df.where(F.size(signature) >= BANDS * ROWS)
    return full.select(*keep, F.explode(keys).alias("k")).select(*keep, F.col("k.band").alias("band"), F.col("k.key").alias("band_key"))


def jaccard(matching: Column, n_a: Column, n_b: Column) -> Column:
    return matching / (n_a + n_b - matching)


def set_key(hashes: str) -> Column:
    """16 bytes that stand for a set of hashes: two 64-bit hashes, differently seeded, of the sorted array."""
    ordered = F.sort_array(F.array_compact(hashes))  # without nulls it is sorted as plain numbers
    part = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.unhex(F.concat(part(F.xxhash64(ordered)), part(F.xxhash64(F.lit(17), ordered))))


def classes(sets: DataFrame, scope: list[str], id_col: str, hashes: str) -> DataFrame:
    """(scope..., id, n, class_id): class_id is the smallest id of the scope with the same set of ``n`` hashes, so copies
    are joined once. Sets without hashes have no row; the hashes themselves are not shuffled."""
    rows = sets.where(F.size(hashes) > 0).select(*scope, id_col, F.size(hashes).cast("bigint").alias("n"), set_key(hashes).alias("_key"))
    rows = materialize(rows, "set-keys")  # read on both sides of the join, and a key is a sort of its set
    least = rows.groupBy(*scope, "_key").agg(F.min(id_col).alias("class_id"))
    return rows.join(least, [*scope, "_key"]).drop("_key")


def representatives(sets: DataFrame, members: DataFrame, scope: list[str], id_col: str) -> DataFrame:
    """Of ``sets`` one for each class that classes() found."""
    return sets.join(members.where(F.col(id_col) == F.col("class_id")).select(*scope, id_col), [*scope, id_col], "left_semi")


def _packed(values: np.ndarray, of: np.ndarray) -> bytes:
    """Ascending hashes and the places of their sets: differences, byte by byte over all rows, compressed."""
    planes = [np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T, of.astype(np.uint32).view(np.uint8).reshape(-1, 4).T]
    return pa.Codec("zstd", compression_level=1).compress(b"".join(x.tobytes() for x in planes), asbytes=True)


def _unpacked(block: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(block, 12 * rows, asbytes=True), np.uint8).reshape(12, rows)
    values = np.cumsum(np.ascontiguousarray(raw[:8].T).view(np.uint64).reshape(-1), dtype=np.uint64)
    return values.astype(np.uint32) if values[-1] <= MASK else values, np.ascontiguousarray(raw[8:].T).view(np.uint32).reshape(-1)


def _ascending(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both by ascending values, then places; 32-bit hashes travel through the sort with their places as one number."""
    if len(values) and values.max() > MASK:
        order = np.lexsort((of, values))
        return values[order], of[order]
    both = np.sort(values << np.uint64(32) | of)
    return both >> np.uint64(32), both & np.uint64(MASK)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalizer."""
    x = x + np.uint64(seed)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _repeated(parts: list[tuple[np.ndarray, np.ndarray]], bases: np.ndarray, pieces: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, that occur more than once in ``parts``, with their places (counted on from ``bases``). They are
    looked at piece by piece, so that only what is kept is held as a whole."""
    kept = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    low, high = min((int(v[0]) for v, _ in parts), default=0), max((int(v[-1]) for v, _ in parts), default=0)
    cuts = [np.searchsorted(v, np.array([low + (high - low + 1) * i // pieces for i in range(1, pieces)], v.dtype)) for v, _ in parts]
    cuts = [[0, *c.tolist(), len(v)] for c, (v, _) in zip(cuts, parts, strict=True)]
    for i in range(pieces if parts else 0):
        of = np.concatenate([p[c[i] : c[i + 1]] + np.uint64(b) for (_, p), c, b in zip(parts, cuts, bases, strict=False)])
        values, of = _ascending(np.concatenate([v[c[i] : c[i + 1]] for (v, _), c in zip(parts, cuts, strict=True)]).astype(np.uint64), of)
        same = values[1:] == values[:-1]
        held = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(values) else np.zeros(0, bool)
        kept.append((values[held], of[held]))
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def _common(values: np.ndarray, of: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, gram, w, df, x, y), by place, of what _repeated() gives: hashes with the same places are one entry, told by
    the number of places and two 64-bit sums (exclusive or) over ``ids``, which stand for the places."""
    of = of.astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(values)))
    if not len(starts):
        return (of, *[np.zeros(0, np.int64)] * 5)
    x, y = (np.bitwise_xor.reduceat(_mixed(ids, seed)[of], starts) for seed in (1, 17))
    order = np.lexsort((values[starts], y, x, sizes))
    new = np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in (sizes, x, y)], axis=0)])
    first, w = order[new], np.diff(np.append(np.flatnonzero(new), len(order)))
    n = sizes[first]
    place = of[np.repeat(starts[first] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    order = np.argsort(place, kind="stable")
    return place[order], *(np.repeat(c, n)[order].view(np.int64) for c in (values[starts[first]], w, n, x[first], y[first]))


def common_grams(sets: DataFrame, keys: list[str], hashes: str, chunk: int = 1 << 20, span: int = 12 << 20) -> DataFrame:
    """(keys..., n, gram, w): of each set of ``n`` hashes, told by ``keys``, what it has in common with any other.

    Grams that occur in exactly the same sets are one entry: ``gram`` is one of them (of hashes from 0 on the smallest),
    ``w`` their number. Most grams occur in one set only, and to find that out each must meet its like: sets are taken in chunks of some
    ``chunk`` grams, and a chunk's grams are dealt by ranges of hashes as compressed blocks of (difference to the one
    before, place of the set in the chunk), some 3 bytes a gram. A range has some ``span`` bytes of ``sets`` by the
    optimizer's estimate; hashes of more than 32 bits go to the last one. Sets' own rows travel once, beside the blocks,
    to their entries. A chunk is named by its task and its sets in their order; if a lost task's second attempt meets them
    in another order while its first is still in use, places without a set remain and raise an error. Written once.
    """
    size = int(str(sets._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = max(1, min(4096, -(-size // span)))
    rows = sets.where(F.size(hashes) > 0).select(*keys, F.size(hashes).cast("bigint").alias("n"), F.xxhash64(*keys).alias("_id"), hashes)
    own = [T.StructField(f.name, f.dataType) for f in rows.schema if f.name in (*keys, "n")]  # null in the rows of blocks
    long = T.LongType()
    place = [T.StructField("_chunk", long), T.StructField("_at", long)]
    dealt = T.StructType([*own, *place, T.StructField("_range", long), T.StructField("_rows", long), T.StructField("_block", T.BinaryType())])
    entries = ["gram", "w", "df", "x", "y"]
    gathered = T.StructType([*own, *place, *(T.StructField(c, long) for c in entries)])
    names = [f.name for f in own]

    def flush(batches, nth):
        first = batches[0].schema
        whole = pa.Table.from_batches(batches).select([*names, "_id"])
        values, counts = zip(*(list_parts(b.column(len(names) + 1)) for b in batches), strict=True)
        ids = np.append(whole.column("_id").to_numpy(), [TaskContext.get().partitionId(), nth]).view(np.uint64)
        name = int(np.bitwise_xor.reduce(_mixed(ids + _mixed(np.arange(len(ids), dtype=np.uint64), 3), 5)).view(np.int64))
        place = np.arange(len(whole))
        named = [whole.column(c).combine_chunks() for c in names]
        yield pa.RecordBatch.from_arrays([*named, pa.array(np.full(len(place), name)), pa.array(place), pa.array(place % ranges), pa.nulls(len(place), pa.int64()), pa.nulls(len(place), pa.binary())], names=dealt.names)
        v, of = _ascending(np.concatenate([x.to_numpy(zero_copy_only=False) for x in values]).view(np.uint64), np.repeat(place, np.concatenate(counts)).astype(np.uint64))
        cuts = np.searchsorted(np.minimum(v, np.uint64(MASK)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(cuts))
        blocks = [_packed(v[cuts[r] : cuts[r + 1]], of[cuts[r] : cuts[r + 1]]) for r in full]
        none = [pa.nulls(len(full), first.field(c).type) for c in names]
        yield pa.RecordBatch.from_arrays([*none, pa.array(np.full(len(full), name)), pa.nulls(len(full), pa.int64()), pa.array(full), pa.array(np.diff(cuts)[full]), pa.array(blocks, pa.binary())], names=dealt.names)

    def deal(batches):
        held, n, nth = [], 0, 0
        for whole in batches:
            for from_ in range(0, whole.num_rows, 128):
                batch = whole.slice(from_, 128)
                held.append(batch)
                n += int(list_parts(batch.column(len(names) + 1))[1].sum())
                if n >= chunk:
                    yield from flush(held, nth)
                    held, n, nth = [], 0, nth + 1
        if held:
            yield from flush(held, nth)

    def gather(table):
        sets_, blocks = (table.filter(table.column(c).is_valid()) for c in ("_at", "_block"))
        parts = [_unpacked(b.as_py(), n) for b, n in zip(blocks.column("_block"), blocks.column("_rows").to_pylist(), strict=True)]
        bases = np.cumsum([0, *(int(of.max()) + 1 for _, of in parts)])
        chunks = np.repeat(blocks.column("_chunk").to_numpy(), np.diff(bases)) if parts else np.zeros(0, np.int64)
        at = np.arange(bases[-1]) - np.repeat(bases[:-1], np.diff(bases))
        v, of = _repeated(parts, bases)
        del parts
        of, *found = _common(v, of, _mixed(chunks.view(np.uint64), 0) + at.astype(np.uint64))
        found = [np.concatenate([np.zeros(len(sets_), np.int64), c]) for c in found]
        place = [np.concatenate([sets_.column(c).to_numpy(), x[of]]) for c, x in (("_chunk", chunks), ("_at", at))]
        named = [pa.chunked_array([*sets_.column(c).chunks, pa.nulls(len(of), table.schema.field(c).type)]) for c in names]
        return pa.Table.from_arrays([*named, *map(pa.array, place), *map(pa.array, found)], names=gathered.names)

    met = rows.mapInArrow(deal, dealt).groupBy("_range").applyInArrow(gather, gathered)
    whole = met.repartition("_chunk", "_at").groupBy("_chunk", "_at", "df", "x", "y").agg(*[F.max(c).alias(c) for c in names], F.min("gram").alias("gram"), F.sum("w").alias("w"))
    of_set = Window.partitionBy("_chunk", "_at")
    told = whole.select(*[F.max(c).over(of_set).alias(c) for c in names], "df", "gram", "w").where("df > 0")
    n = F.when(F.col("n").isNull(), F.raise_error(F.lit("a place of a chunk has no set: its task ran twice in different orders"))).otherwise(F.col("n"))
    return materialize(told.select(*keys, n.cast("bigint").alias("n"), "gram", "w"), "common-grams")


def shared_grams(sets: DataFrame, scope: list[str], id_col: str, hashes: str, rows: DataFrame | None = None) -> DataFrame:
    """(scope..., id, n, df, gram, w, rest): of each set what it has in common with other sets of its scope.

    Grams that occur in exactly the same sets are one entry: ``gram`` is the smallest of them, ``w`` their number and
    ``df`` the number of sets, so a passage that a group of files shares is joined once and not once per gram. Such
    grams are told by their count and two 64-bit sums (exclusive or) over the ids of their sets. Grams of one set only
    meet nothing and are left out; ``n`` still counts them. Rare entries come first: ``rest`` is the number of grams
    from an entry's first on, in that order. ``rows``, if given, is what common_grams() gave for ``sets``. Written once,
    for it is read for candidates and for their verification.
    """
    named = lambda df: df.select(*scope, F.col(id_col).alias("id"), "n", "gram", "w")
    rows = named(common_grams(sets, [*scope, id_col], hashes)) if rows is None else materialize(named(rows), "own-grams")
    print_ = [F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(17), "id")).alias("y")]
    common = rows.groupBy(*scope, "gram").agg(F.count("*").alias("df"), F.max("w").alias("w"), *print_).where("df > 1")
    entries = common.groupBy(*scope, "df", "x", "y").agg(F.min("gram").alias("gram"), F.sum("w").alias("w")).drop("x", "y")
    held = rows.drop("w").join(entries, [*scope, "gram"])
    own = Window.partitionBy(*scope, "id")
    later = F.sum("w").over(own.orderBy(F.desc("df"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return materialize(held.withColumn("rest", later), "shared-grams")


def _chunked(rows: DataFrame, keys: list[str], id_col: str, size: str, chunk: int) -> DataFrame:
    """``rows`` with _chunk, _lo, _hi: groups of equal ``keys`` with more than ``chunk`` rows (by column ``size``) are
    dealt into chunks, and a row is in as many pairs of chunks as there are chunks; no pair of rows is lost."""
    chunks = F.ceil(F.col(size) / chunk).cast("int")
    cut = rows.withColumn("_chunk", F.pmod(F.xxhash64(id_col), chunks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return cut.withColumns({"_lo": F.least("_chunk", "_other"), "_hi": F.greatest("_chunk", "_other")}).drop("_other")


def _met(rows: DataFrame, keys: list[str], id_col: str, *more: Column) -> DataFrame:
    """Self-join of chunked ``rows`` on ``keys`` and their pair of chunks, as a and b with a's id below b's."""
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*keys, "_lo", "_hi"]]
    once = (F.col("a._lo") == F.col("a._hi")) | (F.col("a._chunk") != F.col("b._chunk"))
    return a.join(b, [*same, F.col(f"a.{id_col}") < F.col(f"b.{id_col}"), once, *more])


def candidate_pairs(shared: DataFrame, scope: list[str], threshold: float, flags: tuple[str, ...] = (), either: Column | None = None, chunk: int = 512) -> DataFrame:
    """(scope..., id_a, id_b), id_a < id_b: all pairs that may reach the threshold, by an equi-join of prefixes.

    ``shared`` is what shared_grams() gives. Two sets with Jaccard >= t have one of the first n - ceil(t * n) + 1 grams of
    each in common, and at the first common gram enough must be left on both sides (size and positional bounds). An
    entry of more than ``chunk`` sets is joined in pairs of chunks. ``either`` is a further condition on a and b, over
    the columns ``flags`` of ``shared``.
    """
    n = F.col("n")
    prefix = shared.where((n - F.col("rest")) <= n - F.ceil(F.lit(threshold) * n - 1e-9)).select(*scope, "id", "n", "rest", "gram", "df", *flags)
    total = (F.col("a.n") + F.col("b.n")) * (threshold / (1 + threshold)) - 1e-9
    enough = [_sizes_fit("a.n", "b.n", threshold), F.least("a.rest", "b.rest") >= total]
    joined = _met(_chunked(prefix, [*scope, "gram"], "id", "df", chunk), [*scope, "gram"], "id", *enough, *([either] if either is not None else []))
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in scope], F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def _sizes_fit(a: str, b: str, threshold: float) -> Column:
    return (F.col(a) * 1.0 >= F.col(b) * threshold - 1e-9) & (F.col(b) * 1.0 >= F.col(a) * threshold - 1e-9)


def lsh_pairs(signed: DataFrame, scope: list[str], id_col: str, chunk: int = 512) -> DataFrame:
    """(scope..., id_a, id_b): pairs that share a band; a large bucket is joined in pairs of chunks."""
    keyed = bands(signed, [*scope, id_col])
    sizes = keyed.groupBy(*scope, "band", "band_key").agg(F.count("*").alias("_size")).where("_size > 1")
    keys = [*scope, "band", "band_key"]
    joined = _met(_chunked(keyed.join(sizes, keys), keys, id_col, "_size", chunk), keys, id_col)
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in scope], F.col(f"a.{id_col}").alias("id_a"), F.col(f"b.{id_col}").alias("id_b")).distinct()


def verified(pairs: DataFrame, shared: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """Pairs with their exact similarity: at least the threshold, and something in common.

    An entry of shared_grams() and its weight travel as one number (gram in the upper bits), so what two sets have in
    common is an intersection of short arrays.
    """
    mark = F.shiftleft(F.col("gram"), 31).bitwiseOR(F.col("w"))
    sets = shared.groupBy(*scope, "id", "n").agg(F.collect_list(mark).alias("marks"))
    side = lambda x: sets.select(*scope, F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("marks").alias(f"m_{x}"))
    both = pairs.join(side("a"), [*scope, "id_a"]).join(side("b"), [*scope, "id_b"])
    m = F.aggregate(F.array_intersect("m_a", "m_b"), F.lit(0).cast("bigint"), lambda s, x: s + x.bitwiseAND(F.lit((1 << 31) - 1)))
    both = both.withColumn("matching_k_grams", m).withColumn("jaccard", jaccard(F.col("matching_k_grams"), F.col("n_a"), F.col("n_b")))
    return both.where((F.col("matching_k_grams") > 0) & (F.col("jaccard") >= threshold)).select(*scope, "id_a", "id_b", "jaccard", "matching_k_grams")


def similar_pairs(sets: DataFrame, scope: list[str], id_col: str, hashes: str, threshold: float) -> DataFrame:
    """(scope..., id_a, id_b, jaccard, matching_k_grams), id_a < id_b: all pairs of sets that reach the threshold."""
    shared = shared_grams(sets, scope, id_col, hashes)
    return verified(candidate_pairs(shared, scope, threshold), shared, scope, threshold)


def _thresholds(threshold: float) -> list[float]:
    """A list of the best few is looked for among very similar pairs first; it is complete once it is long enough."""
    return [t for t in (0.8, 0.5) if t > threshold] + [threshold]


def project_pairs(fps: DataFrame, threshold: float = 0.2, limit: int = FILE_PAIRS, mode: str = "auto", common: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The first ``limit`` file pairs of each project by similarity, matching grams, file order.

    mode: "exact" finds all pairs, "lsh" those that share a band, "auto" is exact for projects of at most 10,000 pairs
    of files and LSH for larger ones. Copies are joined once as a class and of each class only as many files as
    the limit can need are put back, so no group of copies is expanded. Pairs are looked for from the top: projects
    with ``limit`` pairs of copies need no others, for all others are less similar, and their grams are not looked at;
    those with ``limit`` exact pairs at 0.8 need no lower ones, and so on down to the threshold. ``common``, called at
    most once and only if projects are left open, gives common_files() of ``fps``, where others need it too.
    """
    key = ["project_key"]
    members = materialize(classes(fps, key, "file", "k_gram_hashes"), "classes")
    sizes = members.groupBy("project_key", "class_id").agg(F.count("*").alias("c"))
    copies = sizes.groupBy("project_key").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("k"))
    counts = fps.groupBy("project_key").agg(F.count("*").alias("n_files"))
    small = (F.col("n_files") * (F.col("n_files") - 1) / 2 <= EXHAUSTIVE) if mode == "auto" else F.lit(mode == "exact")
    open_ = materialize(copies.where(F.col("k") < limit).join(counts, "project_key").select("project_key", "k", small.alias("small")), "open-projects")
    parts = []
    if not open_.isEmpty():
        # the sets themselves are not shuffled for these two joins: the grams in common are found first
        rows = common() if common else common_files(fps.join(F.broadcast(open_.select("project_key")), "project_key", "left_semi"))
        reps = members.where("file = class_id").join(open_.select("project_key"), "project_key", "left_semi").select("project_key", "file")
        shared = shared_grams(reps, key, "file", "k_gram_hashes", rows.join(reps, ["project_key", "file"], "left_semi"))
        left, within = shared.join(open_.where("small").select("project_key"), "project_key", "left_semi"), open_.select("project_key", "k")
        for t in _thresholds(threshold) if mode in ("exact", "auto") else ():
            found = materialize(verified(candidate_pairs(left, key, t), left, key, t), "project-pairs")
            if t != threshold:
                count = found.groupBy("project_key").agg(F.count("*").alias("k")).unionByName(within).groupBy("project_key").agg(F.sum("k").alias("k"))
                done = materialize(count.where(F.col("k") >= limit).select("project_key"), "complete")
                parts.append(found.join(done, "project_key", "left_semi"))
                left = left.join(done, "project_key", "left_anti")
                if left.isEmpty():
                    break
            else:
                parts.append(found)
        if mode in ("lsh", "auto"):
            signed = representatives(fps.select("project_key", "file", "signature"), members, key, "file")
            parts.append(verified(lsh_pairs(signed.join(open_.where("not small").select("project_key"), "project_key", "left_semi"), key, "file"), shared, key, threshold))
    own = members.where("file = class_id")
    between = own.select("project_key", F.col("class_id").alias("id_a"), F.col("class_id").alias("id_b"), F.lit(1.0).alias("jaccard"), F.col("n").alias("matching_k_grams"))
    for part in parts:
        between = between.unionByName(part)
    first = F.row_number().over(_window(["project_key", "class_id"], [F.collate("file", "UNICODE"), F.col("file")]))
    some = members.select("project_key", "class_id", "file").withColumn("_r", first).where(F.col("_r") <= limit + 1)
    side = lambda x: some.select("project_key", F.col("class_id").alias(f"id_{x}"), F.col("file").alias(f"f_{x}"))
    full = between.join(side("a"), ["project_key", "id_a"]).join(side("b"), ["project_key", "id_b"])
    place = lambda c: F.struct(F.collate(c, "UNICODE"), F.col(c))
    full = full.withColumn("_swap", place("f_a") > place("f_b")).where((F.col("id_a") != F.col("id_b")) | (place("f_a") < place("f_b")))
    full = full.select("project_key", "jaccard", "matching_k_grams", F.when(F.col("_swap"), F.col("f_b")).otherwise(F.col("f_a")).alias("file_a"), F.when(F.col("_swap"), F.col("f_a")).otherwise(F.col("f_b")).alias("file_b"))
    order = [F.desc("jaccard"), F.desc("matching_k_grams"), F.collate("file_a", "UNICODE"), F.collate("file_b", "UNICODE"), F.col("file_a"), F.col("file_b")]
    top = full.withColumn("seq", F.row_number().over(_window(["project_key"], order))).where(F.col("seq") <= limit)
    return top.select("project_key", "file_a", "file_b", F.lit("file").alias("kind"), "jaccard", "matching_k_grams", *_no_lines(), "seq")


def _no_lines() -> list[Column]:
    return [F.lit(None).cast("bigint").alias(c) for c in ("start_line_a", "end_line_a", "start_line_b", "end_line_b")]


def _window(keys: list[str], order: list[Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def common_files(fps: DataFrame) -> DataFrame:
    """common_grams() of files, told by project_key, file and id, their set's key."""
    return common_grams(fps.withColumn("id", set_key("k_gram_hashes")), ["project_key", "file", "id"], "k_gram_hashes")


def history_pairs(current: DataFrame, stored: DataFrame, threshold: float = 0.2, limit: int = HISTORY_PAIRS, mode: str = "auto", common: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Pairs of each current project's files with files stored for other projects, which are labelled as history.

    Exhaustive where files times stored files of others are at most 10,000 (or mode is "exact"), else over shared bands.
    Files with equal sets of grams, current or stored, are one set that is joined once; of each set only the files that
    the limit can need are put back: the first ``limit`` of a current project, and of the stored ones the first ``limit``
    of each project and twice that in all, so that enough are left without the project's own. Pairs are looked for from
    the top, as in project_pairs(): projects with ``limit`` pairs of equal sets need no others, and only if there are
    others the sets themselves, not just their keys, are brought together. ``common`` as in project_pairs(), of current
    and stored files.
    """
    n_all = stored.count() if mode == "auto" else 0
    counts = current.groupBy("project_key").agg(F.count("*").alias("n_cur"))
    own = stored.groupBy("project_key").agg(F.count("*").alias("n_own"))
    sizes = counts.join(own, "project_key", "left").withColumn("small", F.col("n_cur") * (F.lit(n_all) - F.coalesce("n_own", F.lit(0))) <= EXHAUSTIVE)
    named = lambda fps: fps.where(F.size("k_gram_hashes") > 0).withColumn("id", set_key("k_gram_hashes"))
    keyed = lambda fps: named(fps).select("project_key", "file", "id", F.size("k_gram_hashes").cast("bigint").alias("n"))
    old = materialize(keyed(stored), "history-stored")
    cur = materialize((old if current is stored else keyed(current)).join(sizes.select("project_key", "small"), "project_key"), "history-current")
    by_file = [F.collate("file_a", "UNICODE"), F.col("file_a")]
    members_a = cur.select("project_key", F.col("id").alias("id_a"), F.col("file").alias("file_a")).withColumn("_r", F.row_number().over(_window(["project_key", "id_a"], by_file))).where(F.col("_r") <= limit).drop("_r")
    members_b = old.select(F.col("id").alias("id_b"), F.col("project_key").alias("from_key"), F.col("file").alias("from_file")).withColumn("_r", F.row_number().over(_window(["id_b", "from_key"], [F.col("from_file")]))).where(F.col("_r") <= limit)
    members_b = materialize(members_b.withColumn("_r", F.row_number().over(_window(["id_b"], [F.col("from_key"), F.col("from_file")]))).where(F.col("_r") <= 2 * limit).drop("_r"), "history-members")
    order = [F.desc("jaccard"), F.desc("matching_k_grams"), *by_file, F.col("from_key"), F.col("from_file")]
    equal = cur.select("id", "n").distinct().join(old.select("id"), "id", "left_semi").select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("jaccard"), F.col("n").alias("matching_k_grams"))

    def best(found: DataFrame | None, projects: DataFrame) -> DataFrame:
        """The first ``limit`` rows of ``projects`` from equal sets and from pairs of sets, in both directions."""
        both = equal
        if found is not None:
            turned = found.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "jaccard", "matching_k_grams")
            both = found.select("id_a", "id_b", "jaccard", "matching_k_grams").unionByName(turned).unionByName(equal)
        full = both.join(members_a.join(projects, "project_key", "left_semi"), "id_a").join(members_b, "id_b").where("project_key <> from_key")
        return full.withColumn("seq", F.row_number().over(_window(["project_key"], order))).where(F.col("seq") <= limit)

    def complete(top: DataFrame) -> DataFrame:
        return materialize(top.groupBy("project_key").agg(F.count("*").alias("k")).where(F.col("k") >= limit).select("project_key"), "complete")

    projects = cur.select("project_key", (F.col("small") if mode == "auto" else F.lit(mode == "exact")).alias("small")).distinct()
    top = materialize(best(None, projects.select("project_key")), "history-pairs")
    done = complete(top)
    parts = [top.join(done, "project_key", "left_semi")]
    open_ = materialize(projects.join(done, "project_key", "left_anti"), "history-left")
    if not open_.isEmpty():
        sides = old.select("id", F.lit(True).alias("old")).unionByName(cur.select("id", F.lit(False).alias("old")))
        sets = materialize(sides.groupBy("id").agg(F.max("old").alias("old")), "history-sets")
        files = lambda fps: fps.select("project_key", "file", "k_gram_hashes")
        rows = common() if common else common_files(stored if current is stored else files(current).unionByName(files(stored)))
        shared = shared_grams(sets, [], "id", "k_gram_hashes", rows.select("id", "n", "gram", "w").distinct())  # files of equal sets have equal rows
        left = open_.where("small").select("project_key")
        for t in _thresholds(threshold) if mode in ("exact", "auto") else ():
            wanted = cur.join(left, "project_key", "left_semi").select("id").distinct().withColumn("wanted", F.lit(True))
            marked = shared.join(sets.select("id", "old"), "id").join(wanted, "id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
            either = (F.col("a.wanted") & F.col("b.old")) | (F.col("b.wanted") & F.col("a.old"))
            found = verified(candidate_pairs(marked, [], t, ("old", "wanted"), either), shared, [], t)
            top = materialize(best(found, left), "history-pairs")
            if t != threshold:
                done = complete(top)
                parts.append(top.join(done, "project_key", "left_semi"))
                left = materialize(left.join(done, "project_key", "left_anti"), "history-left")
                if left.isEmpty():
                    break
            else:
                parts.append(top)
        if mode in ("lsh", "auto"):
            large = open_.where("not small").select("project_key")
            ids = cur.join(large, "project_key", "left_semi").select("id").distinct()
            signs = named(current).select("id", "signature", F.lit(False).alias("old")).unionByName(named(stored).select("id", "signature", F.lit(True).alias("old")))
            signed = materialize(signs.groupBy("id").agg(F.first("signature").alias("signature"), F.max("old").alias("old")), "history-signatures")
            keyed = bands(signed.join(ids, "id", "left_semi"), ["id"]).select("band", "band_key", F.col("id").alias("id_a"))
            met = keyed.join(bands(signed.where("old"), ["id"]).select("band", "band_key", F.col("id").alias("id_b")), ["band", "band_key"]).where("id_a <> id_b")
            pairs = met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
            parts.append(best(verified(pairs, shared, [], threshold), large))
    top = parts[0]
    for part in parts[1:]:
        top = top.unionByName(part)
    label = F.concat(F.lit("history/"), F.col("from_key"), F.lit("/"), F.col("from_file"))
    return top.select("project_key", "file_a", label.alias("file_b"), F.lit("file").alias("kind"), "jaccard", "matching_k_grams", *_no_lines(), "seq")


def cloned_files(fps: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Every file that has a pair in its own or another project of ``fps``, as a pair with itself; no list is cut.

    Files of equal gram sets are one class whatever their project; a class of two or more, or one that meets another,
    is cloned as a whole, so no pair of files is made.
    """
    named = fps.where(F.size("k_gram_hashes") > 0).withColumn("id", set_key("k_gram_hashes"))
    sets = materialize(named.groupBy("id").agg(F.first("k_gram_hashes").alias("k_gram_hashes"), F.count("*").alias("n_files")), "cloned-sets")
    met = similar_pairs(sets, [], "id", "k_gram_hashes", threshold)
    cloned = met.select(F.explode(F.array("id_a", "id_b")).alias("id")).union(sets.where("n_files > 1").select("id")).distinct()
    files = named.select("project_key", "file", "id").join(cloned, "id", "left_semi")
    return files.select("project_key", F.col("file").alias("file_a"), F.col("file").alias("file_b"), F.lit("file").alias("kind"), F.lit(None).cast("double").alias("jaccard"), F.lit(None).cast("bigint").alias("matching_k_grams"), *_no_lines())


def merged_pairs(blocks: DataFrame, own: DataFrame, history: DataFrame, limit: int = REPORT_PAIRS) -> DataFrame:
    """The report's list per project: file pairs before blocks, then similarity and matching grams; ties keep the order
    blocks, own pairs, history. Each input has seq, its order within the project."""
    parts = [df.withColumn("source_ord", F.lit(i)) for i, df in enumerate((blocks, own, history))]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = [F.when(F.col("kind") == "file", 0).otherwise(1), F.desc("jaccard"), F.desc("matching_k_grams"), F.col("source_ord"), F.col("seq")]
    top = union.withColumn("_n", F.row_number().over(_window(["project_key"], order))).where(F.col("_n") <= limit)
    return top.withColumn("seq", F.col("_n")).drop("_n", "source_ord")


def clone_rate(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """(project_key, clone_rate) for each project of ``metrics``.

    A file in any file pair counts with all its code lines; others with the union of their block ranges, at most their
    code lines. Names that are no file of the project count nothing. 0 if there are no code lines, at most 1.
    """
    whole = pairs.where("kind <> 'block'").select("project_key", F.explode(F.array("file_a", "file_b")).alias("file")).distinct().withColumn("whole", F.lit(True))
    sides = F.array(F.struct(F.col("file_a").alias("file"), F.col("start_line_a").alias("s"), F.col("end_line_a").alias("e")), F.struct(F.col("file_b").alias("file"), F.col("start_line_b").alias("s"), F.col("end_line_b").alias("e")))
    ranges = pairs.where("kind = 'block'").select("project_key", F.explode(sides).alias("r")).select("project_key", "r.*").where("s is not null and e >= s")
    cloned = ranges.select("project_key", "file", F.explode(F.sequence("s", "e")).alias("line")).distinct().groupBy("project_key", "file").agg(F.count("*").alias("n"))
    files = metrics.select("project_key", "file", "ncloc").join(whole, ["project_key", "file"], "left").join(cloned, ["project_key", "file"], "left")
    own = F.when(F.col("whole"), F.col("ncloc")).otherwise(F.least(F.col("ncloc"), F.coalesce("n", F.lit(0))))
    total = F.sum("ncloc")
    return files.groupBy("project_key").agg(F.when(total > 0, F.least(F.lit(1.0), F.sum(own) / total)).otherwise(F.lit(0.0)).alias("clone_rate"))
