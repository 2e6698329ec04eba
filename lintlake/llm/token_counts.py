"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to frequencies.

Each block of documents becomes per-document frequencies of its pre-tokens; the block's distinct pre-tokens that are not
yet known go once through the tokenizer, which gives their number of pieces; frequencies times pieces sum to the count.
The join is made in memory, block by block, with a bounded dictionary per task: as a shuffle it would carry one row for
nearly every word of the corpus (figures in the README).
"""

from __future__ import annotations

import os
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, with_arrow

KNOWN = 400_000


class PieceCounts:
    """Pieces per pre-token of a tokenizer whose pre-tokens never hold white space (it must drop or split at it).

    A pre-token here is a run between the six ASCII white-space characters; what the tokenizer splits further inside, it
    splits the same way for the run alone, special strings included.
    """

    def __init__(self, path: str, known: int = KNOWN) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known, self.most = {}, known

    def learn(self, new: list[bytes]) -> dict[bytes, int]:
        """Pieces of each of ``new``; what the bound allows of them is kept for later blocks."""
        learnt: dict[bytes, int] = {}
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            got = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False)
            learnt.update(zip(part, map(len, got), strict=True))
        if len(self.known) + len(learnt) > self.most:
            self.known.clear()
        self.known.update(islice(learnt.items(), self.most))
        return learnt

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        raw = [(t or "").encode("utf-8") for t in texts]
        frequencies = [Counter(r.split()) for r in raw]
        distinct = set().union(*frequencies)
        pieces = {w: self.known[w] for w in distinct if w in self.known}  # the block's own: complete whatever the bound
        pieces |= self.learn([w for w in distinct if w not in pieces])
        sums = [sum([n * pieces[w] for w, n in f.items()]) for f in frequencies]
        return np.fromiter(map(len, raw), np.int64, len(raw)), np.array(sums, np.int64)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; ``tokenizer`` is the path of a tokenizers .json file.

    No begin, end or added special tokens; special strings inside texts count as the library takes them by default; no
    truncation. Null and empty texts have 0 bytes and 0 tokens. Null ids and repeated rows are kept as they are; extra
    columns are dropped.
    """

    def make():
        counts = PieceCounts(tokenizer)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_bytes, n_tokens = counts.count(batch.column(1).to_pylist())
            return columns(batch, doc_id=batch.column(0), n_bytes=n_bytes, n_tokens=n_tokens, over_limit=n_tokens > limit)

        return one

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_arrow(source, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make, "text", rows=512)
