"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic of its words' weights (words and their beginnings);
a document is toxic if any sentence is: its score is the noisy-or of theirs. The weights are learnt from document labels alone, and then also tell
which sentences offend.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_arrow
from .sampling import labelled_sample

#: Bound of the labelled rows that a model is fitted on, for each label.
SAMPLE = 2000
SENTENCE = re.compile(r"[.!?\n]+")
EDGE = ".,;:!?\"'()[]{}<>*#%&$|-_/\\"


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences of a text, in code points, without what ends them; blank ones are left out."""
    out, at = [], 0
    for m in SENTENCE.finditer(text or ""):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text or "")))
    return [(s, e) for s, e in out if e > s and not text[s:e].isspace()]


def features(word: str) -> list[str]:
    """What a word as written stands for: itself and its beginnings, for endings vary."""
    w = word.lower().strip(EDGE)
    return [w, *(f"{w[:n]}~" for n in (4, 5) if len(w) > n)] if w else []


class _Ids(dict):
    """Feature numbers of words as written; bounded."""

    def __init__(self, known: dict[str, int], most: int = 300_000) -> None:
        self.known, self.most = known, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = tuple(k for f in features(word) if (k := self.known.get(f)))
        return value


def bags(texts: list[str | None], ids: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all sentences (distinct in each), sizes of the sentences, sentences of each text."""
    found, sizes, counts = [], [], []
    get = ids.__getitem__
    for text in texts:
        parts = [p for p in SENTENCE.split(text or "") if p and not p.isspace()]
        counts.append(len(parts))
        for p in parts:
            own = set().union(*map(get, p.split()))
            found += own
            sizes.append(len(own))
    return np.array(found, np.int64), np.array(sizes, np.int64), np.array(counts, np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of the given sizes."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def fit(texts: list[str], labels: np.ndarray, rounds: int = 600, rate: float = 0.1, penalty: float = 1e-4, least: int = 4, screen: int = 200) -> tuple[dict[str, float], float]:
    """Weights of words and the bias: proximal gradient steps on the noisy-or likelihood, classes weighted alike.

    Each step draws weights towards zero by ``penalty`` (an absolute-value penalty), so words that tell nothing get no
    weight at all and do not add up over the many sentences of a long document. Features that occur in fewer than
    ``least`` texts, or have no weight after ``screen`` rounds, are left out.
    """
    seen: dict[str, int] = {}
    for text in texts:
        for f in {f for w in set(text.split()) for f in features(w)}:
            seen[f] = seen.get(f, 0) + 1
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    words, sizes, counts = bags(texts, _Ids(vocabulary))
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    doc = np.repeat(np.arange(len(counts)), counts)
    y = np.asarray(labels, np.float64)
    share = y.mean() if len(y) else 0.5
    weight = np.where(y > 0.5, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / max(1, len(y))
    theta = np.zeros(len(vocabulary) + 1)
    theta[0] = -4.0  # the bias
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = np.clip(theta[0] + _sums(theta[words], sizes), -30, 30)
        p = 1 / (1 + np.exp(-z))
        miss = _sums(np.log1p(np.exp(z)), counts)  # minus the logarithm of the share that all sentences are clean
        any_ = np.clip(-np.expm1(-miss), 1e-6, 1 - 1e-9)
        slope = np.where(y > 0.5, -(1 - any_) / any_, 1.0) * weight
        g_sentence = slope[doc] * p
        grad = np.bincount(words, g_sentence[sentence], len(theta))
        grad[0] = g_sentence.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        scale = np.sqrt(v / (1 - 0.999**step)) + 1e-8
        theta -= rate * (m / (1 - 0.9**step)) / scale
        drawn = rate * penalty / scale
        drawn[0] = 0.0
        theta = np.sign(theta) * np.maximum(np.abs(theta) - drawn, 0.0)
        if step == screen:
            kept = (theta != 0)[words]
            words, sentence = words[kept], sentence[kept]
            sizes = np.bincount(sentence, minlength=len(sizes))
    return {w: float(theta[i]) for w, i in vocabulary.items() if abs(theta[i]) > 1e-3}, float(theta[0])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """A model from the labelled rows of ``docs`` whose crc32(doc_id as text) mod 5 is not 0: at most ``sample`` of each
    label and SAMPLE_BYTES of their texts; see labelled_sample() for labels that contradict and ids that repeat.

    Without labelled rows, or with one label only, every score is that of the bias. Rows are sorted before they are
    fitted, so the model does not depend on how the tables are partitioned.
    """
    rows = labelled_sample(docs, labels, label_col, sample)

    def run(batches):
        texts, y = [], []
        for b in batches:
            texts += [t or "" for t in b.column(0).to_pylist()]
            y += b.column(1).to_pylist()
        order = sorted(range(len(y)), key=lambda i: (texts[i], y[i]))
        weights, bias = fit([texts[i] for i in order], np.array([y[i] for i in order])) if len(set(y)) > 1 else ({}, -4.0)
        out = io.BytesIO()
        np.savez_compressed(out, words=np.array(list(weights), dtype="U"), weights=np.array(list(weights.values()), np.float64), bias=np.float64(bias))
        yield pa.RecordBatch.from_pydict({"model": pa.array([out.getvalue()], pa.binary())})

    made = rows.repartition(1).mapInArrow(run, "model binary").first()
    if not made:  # an empty sample may have no task at all
        return {}, -4.0
    got = np.load(io.BytesIO(made["model"]))
    return dict(zip(got["words"].tolist(), got["weights"].tolist(), strict=True)), float(got["bias"])


class Scorer:
    def __init__(self, model: tuple[dict[str, float], float]) -> None:
        weights, self.bias = model
        self.ids = _Ids({w: i + 1 for i, w in enumerate(weights)})
        self.theta = np.array([0.0, *weights.values()])

    def sentence_scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all sentences one after another, and the number in each text."""
        words, sizes, counts = bags(texts, self.ids)
        z = np.clip(self.bias + _sums(self.theta[words], sizes), -30, 30)
        return 1 / (1 + np.exp(-z)), counts

    def scores(self, texts: list[str | None]) -> np.ndarray:
        p, counts = self.sentence_scores(texts)
        return np.clip(-np.expm1(_sums(np.log1p(-np.minimum(p, 1 - 1e-12)), counts)), 0.0, 1.0)


def score(docs: DataFrame, model: tuple[dict[str, float], float], threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, offending) for every row of ``docs``.

    offending: spans (start, end, score), in code points, of the sentences with a score of ``threshold`` or more. Null,
    empty and wordless texts score 0. Null ids and repeated rows stay; extra columns are dropped.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def make():
        scorer = Scorer(held.value)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            p, counts = scorer.sentence_scores(texts)
            ends = np.cumsum(counts)
            total = np.clip(-np.expm1(_sums(np.log1p(-np.minimum(p, 1 - 1e-12)), counts)), 0.0, 1.0)
            spans = []
            for text, e, n in zip(texts, ends, counts, strict=True):
                own = p[e - n : e]
                spans.append([{"start": a, "end": b, "score": float(s)} for (a, b), s in zip(sentences(text), own, strict=True) if s >= threshold] if n and own.max() >= threshold else [])
            return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(total), "predicted": pa.array((total >= threshold).astype(np.int32)), "offending": pa.array(spans, kind)})

        return one

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return with_arrow(source, "doc_id long, score double, predicted int, offending array<struct<start:long,end:long,score:double>>", make, "text")
