"""Best-fit packing of token sequences by minimum bin slack.

Only the histogram of piece lengths is planned over: at most ``size`` numbers, whatever the corpus. Per bin, the longest
piece left is placed and a bitset subset-sum over the lengths available (each as often as it is left) finds the fullest
feasible filling of the rest; that combination is removed, as many times at once as the counts allow. Pieces then take
their places by their number within their length, which is computed in parallel over salted groups.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, materialize, with_arrow

class Encoder:
    """Token ids as the tokenizers library gives them for a file, by a faster engine where both must agree.

    For a byte-level BPE whose merges are in the order of their ids, texts of code points below U+0250 without special
    strings go through tiktoken with ranks read from the same file; any other text, and any other kind of file, goes
    through the library itself, so ids never depend on how the two differ in Unicode tables or special strings. So does
    a text that the fast engine refuses: its pattern backtracks over white space, and a very long run exceeds its stack.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.odd = regex.compile("|".join([r"[^\x00-\u024f]", *map(regex.escape, special)]))
        self.ranks = self._ranks(spec, special)

    @staticmethod
    def _ranks(spec: dict, special: dict[str, int]):
        """The fast engine for this file, or None."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or model["type"] != "BPE" or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            return None
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            return None
        import tiktoken

        shown = [b for b in range(256) if chr(b).isprintable() and b != 32]  # these bytes stand for themselves, the rest from U+0100 on
        char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(char[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
        # fixed value: the pre-token pattern of byte-level pre-tokenizers
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.ranks is not None and not self.odd.search(text):
            try:
                return np.asarray(self.ranks.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes()
            except ValueError:  # too long a run for its regular expressions
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cut_pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens: whole if it fits, else pieces of ``size`` of which the first may be shorter."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return ([(0, head)] if head else []) + [(s, size) for s in range(head, n, size)]


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times): the multiset of available lengths with the largest sum of at most ``room``; longer ones preferred."""
    sizes = sorted(s for s, n in counts.items() if n and s <= room)
    window = (1 << room + 1) - 1
    reach, stages = 1, []
    for s in sizes:
        stages.append(reach)
        left, step = min(counts[s], room // s), 1
        while left:  # 1, 2, 4, ... copies at a time reach any number of them
            take = min(step, left)
            reach |= reach << take * s & window
            left, step = left - take, step * 2
    rest, chosen = reach.bit_length() - 1, []
    for s, before in zip(reversed(sizes), reversed(stages), strict=True):
        for times in range(min(counts[s], rest // s), -1, -1):
            if before >> rest - times * s & 1:
                break
        if times:
            chosen.append((s, times))
            rest -= times * s
    return chosen


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Places of all pieces: (length, first, end, sequence, offset), sorted.

    Piece number r of its length, first <= r < end, goes to sequence ``sequence + r - first`` at ``offset``.
    """
    left = {s: n for s, n in histogram.items() if n and s > 0}
    used, out, base = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        filling = fullest(left, size - longest)
        left[longest] += 1
        combo = dict(filling)
        combo[longest] = combo.get(longest, 0) + 1
        times = min(left[s] // n for s, n in combo.items())
        offset = 0
        for s, n in sorted(combo.items(), reverse=True):
            for _ in range(n):
                out.append((s, used[s], used[s] + times, base, offset))
                used[s] += times
                offset += s
            left[s] -= n * times
            if not left[s]:
                del left[s]
        base += times
    return sorted(out)


@lru_cache(maxsize=1)
def _lookup(rows: tuple) -> dict[int, tuple[np.ndarray, ...]]:
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:])
    return {s: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for s, v in by.items()}


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens; one row per piece.

    Columns: doc_id, piece (from 0), start (the document's ids before it), length, ids_crc32 (of its ids as
    little-endian unsigned 32-bit), sequence_id, offset (place in the sequence, gapless from 0). A document is its ids
    and then ``end_id``; a null text is empty. Longer documents are cut into pieces of ``size``, the first may be
    shorter. Rows with a null id are packed like any other; repeated rows are packed each; extra columns are dropped.
    Ids themselves are not shuffled: a piece is read back by doc_id, start and length.
    """
    ending = np.array([end_id], "<u4").tobytes()

    def make():
        encoder = Encoder(tokenizer)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, out = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                raw = encoder.ids(text or "") + ending
                for k, (start, n) in enumerate(cut_pieces(len(raw) // 4, size)):
                    out.append((doc_id, k, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)])))
            names = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(names)], names=[n for n, _ in names])

        return one

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = materialize(with_arrow(source, "doc_id long, piece int, start long, length long, ids_crc32 long", make, "text"), "pieces")
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("number", F.col("own") + F.col("before"))
    rows = tuple(plan({r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}, size))  # at most ``size`` lengths
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def place():
        by = _lookup(shared.value)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                first, _, base, off = by[int(s)]
                i = np.searchsorted(first, number[at], side="right") - 1
                sequence[at], offset[at] = base[i] + number[at] - first[i], off[i]
            return columns(batch, **{n: batch.column(k) for k, n in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))}, sequence_id=sequence, offset=offset)

        return one

    wanted = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return with_arrow(wanted, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", place, rows=10_000)
