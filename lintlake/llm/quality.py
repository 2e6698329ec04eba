"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are words, hashed into buckets, and what does not depend on the language: n-grams of character classes with runs
collapsed (the shape of words, marks and lines) and how much words and lines repeat, in bins that weigh as much as some
dozen n-grams (``REPEATS``). Weighted term vectors of a bounded labelled sample give, by a
truncated singular value decomposition, a small latent space. The sample's latent vectors are sent to all tasks; every
document's cosines with all of them are computed exactly, block by block, and its nearest neighbours vote, weighted by
the eighth power of their similarity (``POWER``), so that a near neighbour outvotes several far ones.
"""

from __future__ import annotations

import io
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, with_arrow
from .decontam import Words
from .sampling import held_out, labelled_sample

#: Bound of the labelled rows of each label, latent dimensions, neighbours.
SAMPLE, DIMENSIONS, NEIGHBOURS = 1500, 48, 15
#: Power of a similarity as the weight of a vote.
POWER = 8
#: Weights of the bins of repetition: the same word twice running, few distinct words in a stretch, lines that repeat.
REPEATS = (8.0, 4.0, 4.0)


def _classes() -> np.ndarray:
    """Class of each byte: lower case or not ASCII, upper case, digit, blank, line end, and each ASCII sign its own."""
    out = np.zeros(256, np.int64)
    sign = 5
    for b in range(128):
        c = chr(b)
        if c.isupper():
            out[b] = 1
        elif c.isdigit():
            out[b] = 2
        elif c in "\n\r":
            out[b] = 4
        elif c.isspace():
            out[b] = 3
        elif not c.isalpha():
            out[b] = min(sign, 39)
            sign += b > 32
    return out


CLASS = _classes()
N = 40
BINS = 16
TERMS = N * N + 2048 + 3 * BINS
#: Buckets of words, and the weight of a word beside the other terms; chosen on rows that are not held out.
WORD_BITS, WORD_WEIGHT = 11, 0.5


def _bin(share: float) -> int:
    return min(BINS - 1, int(share * BINS))


def term_counts(text: str | None) -> np.ndarray:
    """Term weights of a text before idf: logarithms of relative n-gram counts, and marks for repetition."""
    out = np.zeros(TERMS, np.float32)
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return out
    c = CLASS[raw]
    c = c[np.concatenate([[True], c[1:] != c[:-1]])]
    if len(c) > 1:
        pairs = np.bincount(c[:-1] * N + c[1:], minlength=N * N)
        out[: N * N] = pairs * (1000.0 / len(c))
    if len(c) > 2:
        triples = (c[:-2] * N + c[1:-1]) * N + c[2:]
        out[N * N : N * N + 2048] = np.bincount(triples * 40503 % 65521 % 2048, minlength=2048) * (1000.0 / len(c))
    out = np.log1p(out)
    words = text.split()
    if words:
        at = N * N + 2048
        same = sum(map(eq, words, words[1:])) / len(words)
        lines = text.split("\n")
        # a long text repeats words anyway, so distinct words are looked at in stretches
        stretch = [len(set(words[i : i + 200])) / len(words[i : i + 200]) for i in range(0, len(words), 200)]
        out[at + _bin(same)] = REPEATS[0]
        out[at + BINS + _bin(sum(stretch) / len(stretch))] = REPEATS[1]
        out[at + 2 * BINS + _bin(1 - len(set(lines)) / len(lines))] = REPEATS[2]
    return out


def term_matrix(texts: list[str | None]) -> np.ndarray:
    """Term weights of texts before idf, a row each: those of term_counts(), then of the buckets of words."""
    words = Words(pa.array(texts, pa.string()))
    held = np.zeros((len(texts), 1 << WORD_BITS), np.float32)
    np.add.at(held, (words.doc, (words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)), 1)
    held *= (1000.0 / np.maximum(words.sizes, 1))[:, None].astype(np.float32)
    return np.hstack([np.stack([term_counts(t) for t in texts]), np.log1p(held) * np.float32(WORD_WEIGHT)])


class Model:
    """idf, projection, unit vectors of the sample and their labels."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, prior: float, neighbours: int = NEIGHBOURS) -> None:
        self.idf, self.basis, self.vectors, self.labels, self.prior, self.neighbours = idf, basis, vectors, labels, prior, neighbours

    def project(self, terms: np.ndarray) -> np.ndarray:
        z = (terms * self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str | None], block: int = 128) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, weighted by similarity to the power ``POWER``; the sample's share
        where no neighbour has a similarity above 0."""
        out = np.full(len(texts), self.prior)
        k = min(self.neighbours, len(self.labels))
        if not k:
            return out
        for at in range(0, len(texts), block):
            near = self.project(term_matrix(texts[at : at + block])) @ self.vectors.T
            best = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(near, best, 1), 0.0) ** POWER
            total = weight.sum(axis=1)
            votes = (weight * self.labels[best]).sum(axis=1)
            out[at : at + block] = np.where(total > 1e-12, votes / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(texts: list[str | None], labels: list[int], dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Arrays of a Model. The decomposition is a randomised range finder with power steps, from a fixed seed."""
    parts = [term_matrix(texts[i : i + 256]) for i in range(0, len(texts), 256)]
    x = np.concatenate(parts) if parts else np.zeros((0, TERMS + (1 << WORD_BITS)), np.float32)
    seen = (x > 0).sum(axis=0)
    idf = (np.log((1 + len(x)) / (1 + seen)) + 0.3).astype(np.float32)
    x = x * idf
    d = max(1, min(dimensions, *x.shape) if len(x) else 1)
    q = np.random.Generator(np.random.PCG64(3)).standard_normal((x.shape[1], d + 8)).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0] if len(x) else np.linalg.qr(q)[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False) if len(x) else (0, 0, np.eye(q.shape[1], dtype=np.float32))
    basis = np.ascontiguousarray((q @ vt.T)[:, :d]).astype(np.float32)
    z = x @ basis
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    y = np.array(labels, np.float32)
    return {"idf": idf, "basis": basis, "vectors": z.astype(np.float32), "labels": y, "prior": np.float64(y.mean() if len(y) else 0.5)}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """A model from at most ``sample`` labelled rows of each label (and SAMPLE_BYTES of their texts), held-out rows
    excepted: see labelled_sample() for labels that contradict and ids that repeat. Without labelled rows every score is
    0.5. The same rows give the same model in whatever order they arrive."""
    rows = labelled_sample(docs, labels, "quality", sample)

    def run(batches):
        texts, y = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            y += b.column(1).to_pylist()
        order = sorted(range(len(y)), key=lambda i: (texts[i] or "", y[i]))  # the same model however the rows arrive
        out = io.BytesIO()
        np.savez_compressed(out, **fit([texts[i] for i in order], [y[i] for i in order], dimensions))
        yield pa.RecordBatch.from_pydict({"model": pa.array([out.getvalue()], pa.binary())})

    made = rows.repartition(1).mapInArrow(run, "model binary").first()
    got = np.load(io.BytesIO(made["model"])) if made else fit([], [])  # an empty sample may have no task at all
    return Model(got["idf"], got["basis"], got["vectors"], got["labels"], float(got["prior"]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts have no terms, so no neighbour votes and the sample's share of label 1 is their score. Null ids
    (never held out) and repeated rows stay; extra columns are dropped.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = held.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = own.scores(batch.column(2).to_pylist())
            return columns(batch, doc_id=batch.column(0), held_out=batch.column(1), score=s, predicted=(s >= threshold).astype(np.int32))

        return one

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").alias("text"))
    return with_arrow(source, "doc_id long, held_out boolean, score double, predicted int", make, "text")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score below the threshold; all columns as they were.

    Null, empty and wordless texts have the sample's share of label 1 as their score and stay where that reaches the
    threshold: on purpose, since nothing tells against them. Rows with null ids and repeated rows are scored like any.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def make():
        own = held.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(own.scores(batch.column(at).to_pylist()) >= threshold))

        return one

    return with_arrow(docs, docs.schema, make, "text")
