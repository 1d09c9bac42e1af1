"""Operator 4: toxicity by cumulative-link ordinal regression on sparse text features.

Severity has the grades 0 to 3.  Labels only say toxic or not, so the grades above 0 are set on the training sample:
words that are far more frequent in its toxic texts are markers, and toxic texts are graded by thirds of their number
of markers.  The model P(grade <= k) = sigmoid(threshold_k - w.x) shares one weight for each feature across the
ordered thresholds; x has log(1 + count) of the lower-cased words
and word beginnings.  The output is the expected grade.

The sample is bounded by SAMPLE rows of at most SAMPLE_BYTES; every row is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import text_chunks
from touchline.llm.quality_cnn import labelled_sample

SAMPLE, SAMPLE_BYTES = 4000, 40_000
GRADES = 3
#: A word enters the model if so many sampled texts have it.
LEAST_TEXTS = 3
PREFIX = 4
#: Probability of any toxicity from which a text is flagged.
FLAG = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> Counter:
    """Counts of lower-cased words, and of the first PREFIX letters of longer ones (compounds and inflections)."""
    counts = Counter(_WORD.findall(text.lower())) if text else Counter()
    for w, n in list(counts.items()):
        if len(w) > PREFIX:
            counts["^" + w[:PREFIX]] += n
    return counts


class Ordinal:
    """weights: by word; cuts: ascending thresholds."""

    def __init__(self, weights: dict[str, float], cuts: list[float]) -> None:
        self.weights, self.cuts = weights, cuts

    def logit(self, counts: Counter) -> float:
        get = self.weights.get
        return sum(w * log1p(n) for w, n in ((get(t), n) for t, n in counts.items()) if w is not None)

    def above(self, logits: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(np.array(self.cuts)[None, :] - logits[:, None], -30, 30)))


def grades(counts: list[Counter], toxic: np.ndarray) -> np.ndarray:
    """0 for clean texts; 1 to GRADES for toxic ones, by thirds of their number of markers."""
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    inside, outside = Counter(), Counter()
    for c, t in zip(counts, toxic, strict=True):
        (inside if t else outside).update(c.keys())
    markers = {w for w, n in inside.items() if n >= LEAST_TEXTS and log((n + 0.5) / (n_toxic + 1)) - log((outside[w] + 0.5) / (n_clean + 1)) > 2.5}
    load = np.array([sum(n for w, n in c.items() if w in markers) for c in counts], float)
    out = np.zeros(len(counts), int)
    if toxic.sum():
        edges = np.quantile(load[toxic == 1], [k / GRADES for k in range(1, GRADES)])
        out[toxic == 1] = 1 + np.searchsorted(edges, load[toxic == 1], "left")
    return out


def fit(texts: list[str], toxic: np.ndarray, steps: int = 250, rate: float = 0.1, decay: float = 2e-4) -> Ordinal:
    """Adam on the likelihood of the grades, full batch, sparse rows.  Without toxic rows nothing is ever toxic."""
    counts = [features(t) for t in texts]
    df = Counter(w for c in counts for w in c)
    words = {w: i for i, w in enumerate(sorted(w for w, n in df.items() if n >= LEAST_TEXTS))}
    y = grades(counts, toxic)
    rows = [(r, words[w], log1p(n)) for r, c in enumerate(counts) for w, n in c.items() if w in words]
    if not rows or not toxic.sum():
        return Ordinal({}, [4.0 + k for k in range(GRADES)])
    r, c, x = (np.array(v) for v in zip(*rows, strict=True))
    w, raw = np.zeros(len(words)), np.array([2.0, *[-0.5] * (GRADES - 1)])  # first cut, then logs of the gaps
    params, m, v = [w, raw], [np.zeros_like(w), np.zeros_like(raw)], [np.zeros_like(w), np.zeros_like(raw)]
    rank = np.arange(GRADES)
    for step in range(1, steps + 1):
        cuts = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
        z = np.bincount(r, x * w[c], len(texts))
        p = 1 / (1 + np.exp(-np.clip(np.concatenate([[-40.0], cuts, [40.0]])[None, :] - z[:, None], -40, 40)))
        own = np.maximum(p[np.arange(len(y)), y + 1] - p[np.arange(len(y)), y], 1e-9)
        slope = p * (1 - p)
        up, down = slope[np.arange(len(y)), y + 1] / own, slope[np.arange(len(y)), y] / own
        dz = (up - down) / len(y)
        dcut = np.array([(down[y == k + 1].sum() - up[y == k].sum()) for k in rank]) / len(y)
        draw = np.array([dcut.sum(), *[dcut[k:].sum() * np.exp(raw[k]) for k in range(1, GRADES)]])
        for k, g in enumerate((np.bincount(c, x * dz[r], len(words)) + decay * w, draw)):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    cuts = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
    return Ordinal({t: float(w[i]) for t, i in words.items() if abs(w[i]) > 1e-4}, cuts.tolist())


def train_toxicity(docs: DataFrame, labels: DataFrame) -> Ordinal:
    texts, marks = labelled_sample(docs, labels, "toxic", SAMPLE, SAMPLE_BYTES)
    return fit(texts, marks)


def score_toxicity(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity (0 to 3), score (probability of any grade above 0), predicted (1 if the score is at least FLAG).

    Null and empty texts have no features.  Repeated and null ids are rows like others; other columns are ignored; an empty table
    gives no rows; very long texts are scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the words of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            z = [own.logit(features(t)) for a, b, _, _ in text_chunks(batch.column(1)) for t in batch.column(1).slice(a, b - a).to_pylist()]
            above = own.above(np.array(z, float))
            first = above[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1)), pa.array(first), pa.array((first >= FLAG).astype(np.int32))], ["doc_id", "expected_severity", "score", "predicted"])

    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bare.mapInArrow(run, "doc_id long, expected_severity double, score double, predicted int")
