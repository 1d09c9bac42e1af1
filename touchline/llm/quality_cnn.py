"""Operator 1: quality classifier, a byte-level convolutional network in numpy.

A text is padded to blocks of 16 bytes; each filter sees three neighbouring blocks (48 bytes), so neighbouring chunks
overlap by two thirds and together cover the whole document, whatever its length.  Filter outputs are max-pooled over
the document and combined into one probability.  Bytes are embedded; next to the embedding a byte carries whether the
same byte stood a word or so earlier, which lets linear filters see repetition.

The network is fitted with Adam on a bounded sample of labelled rows (SAMPLE rows of at most SAMPLE_BYTES each) and
then scores every row in Arrow batches; the weights are a few kilobytes in the closure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import claim_worker, text_chunks

#: Bound of the training sample: rows, and bytes of a row (longer rows are not drawn; they are scored like all).
SAMPLE, SAMPLE_BYTES = 3000, 40_000
BLOCK, SPAN, DIM, FILTERS = 16, 3, 6, 32
#: Distances at which a byte is compared with an earlier one.
LAGS = tuple(range(3, 13))
EPOCHS, BATCH, RATE = 14, 32, 0.01
#: Bytes of text that are scored at once.
STEP = 1 << 18


def in_fold(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded bytes, repetition channel, and the first block of each document (n + 1 places, SPAN - 1 pads each)."""
    sizes = np.diff(offsets)
    n = np.maximum(-(-sizes // BLOCK), 1) + SPAN - 1
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(first[-1]) * BLOCK, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - offsets[:-1], sizes)] = data
    again = np.zeros(len(out), np.float32)
    pairs = (out[1:].astype(np.uint16) << 8) | out[:-1]
    for lag in LAGS:
        same = (pairs[lag:] == pairs[:-lag]) & (out[lag + 1 :] > 32) & (out[lag:-1] > 32)
        again[lag + 1 :][same] = 1.0
    return out, again, first


class Network:
    """Weights and the two passes."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.w = {
            "embed": r.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "conv": r.normal(0, (BLOCK * (DIM + 1) * SPAN) ** -0.5, (SPAN, BLOCK * (DIM + 1), FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": r.normal(0, 0.3, FILTERS).astype(np.float32),
            "last": np.zeros(1, np.float32),
        }

    def inputs(self, data: np.ndarray, again: np.ndarray) -> np.ndarray:
        x = np.empty((len(data), DIM + 1), np.float32)
        x[:, :DIM] = self.w["embed"][data]
        x[:, DIM] = again
        return x.reshape(-1, BLOCK * (DIM + 1))

    def activations(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.w["conv"].transpose(1, 0, 2).reshape(x.shape[1], SPAN * FILTERS)
        a = z[: len(z) - SPAN + 1, :FILTERS].copy()
        for j in range(1, SPAN):
            a += z[j : len(z) - SPAN + 1 + j, j * FILTERS : (j + 1) * FILTERS]
        return a

    def pooled(self, data: np.ndarray, again: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest activation of each filter in each document, and the inputs and activations."""
        x = self.inputs(data, again)
        a = self.activations(x)
        stop = first[1:] - (SPAN - 1)
        bounds = np.stack([first[:-1], stop], 1).ravel()
        a = np.concatenate([a, np.full((SPAN - 1, FILTERS), -np.inf, np.float32)])
        return np.maximum.reduceat(a, bounds[:-1] if bounds[-1] >= len(a) else bounds, axis=0)[::2], x, a

    def score(self, data: np.ndarray, offsets: np.ndarray, step: int = STEP) -> np.ndarray:
        """Probabilities of texts; a single text longer than ``step`` bytes is pooled stretch by stretch."""
        padded, again, first = blocks(data, offsets)
        if len(offsets) == 2 and len(padded) > step:
            places = int(first[-1]) - (SPAN - 1)
            top = np.full((1, FILTERS), -np.inf, np.float32)
            for a in range(0, places, step // BLOCK):
                b = (min(a + step // BLOCK, places) + SPAN - 1) * BLOCK
                stretch = self.activations(self.inputs(padded[a * BLOCK : b], again[a * BLOCK : b]))
                top = np.maximum(top, stretch.max(axis=0))
        else:
            top, _, _ = self.pooled(padded, again, first)
        return _sigmoid(np.tanh(top + self.w["bias"]) @ self.w["out"] + self.w["last"][0])

    def gradients(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        padded, again, first = blocks(data, offsets)
        top, x, a = self.pooled(padded, again, first)
        hidden = np.tanh(top + self.w["bias"])
        wrong = (_sigmoid(hidden @ self.w["out"] + self.w["last"][0]) - labels) / len(labels)
        into = wrong[:, None] * self.w["out"] * (1 - hidden**2)
        g = {"out": hidden.T @ wrong, "last": wrong.sum(keepdims=True), "bias": into.sum(0), "conv": np.zeros_like(self.w["conv"]), "embed": np.zeros_like(self.w["embed"])}
        for d in range(len(labels)):
            place = first[d] + np.argmax(a[first[d] : first[d + 1] - (SPAN - 1)], axis=0)
            for j in range(SPAN):
                g["conv"][j] += (x[place + j] * into[d][:, None]).T
                back = (self.w["conv"][j].T * into[d][:, None]).reshape(FILTERS, BLOCK, DIM + 1)[:, :, :DIM]
                seen = padded.reshape(-1, BLOCK)[place + j]
                np.add.at(g["embed"], seen.ravel(), back.reshape(-1, DIM))
        return g


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam on the cross-entropy; the same sample gives the same weights.  Without rows, an untrained network."""
    net, r, step = Network(seed), np.random.default_rng(seed), 0
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    rounds = epochs if len(texts) >= 1000 else epochs * 3  # small samples get more passes
    for epoch in range(rounds):
        order = r.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])])
            g = net.gradients(np.frombuffer(b"".join(texts[i] for i in rows), np.uint8), offsets, labels[rows])
            step += 1
            rate = RATE * (1 - epoch / rounds) + 1e-4
            for k, w in net.w.items():
                g[k] = g[k].astype(np.float32) + 1e-4 * w
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """At most ``rows`` labelled texts of at most ``size`` bytes outside the held-out fold, in the order of a hash."""
    drawn = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
        .filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~in_fold(F.col("_id")))
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).filter(F.octet_length("_text") <= size)
    found = text.join(F.broadcast(drawn), "_id").orderBy(F.xxhash64("_id"), "_id", "_text").limit(rows).collect()  # bounded by rows
    return [r["_text"] for r in found], np.array([r["_label"] for r in found], np.float32)


def train_quality(docs: DataFrame, labels: DataFrame) -> Network:
    texts, marks = labelled_sample(docs, labels, "quality", SAMPLE, SAMPLE_BYTES)
    blank = max(1, len(texts) // 100) if texts else 0  # a text without content is no good text
    return fit([*[t.encode() for t in texts], *[b""] * blank], np.concatenate([marks, np.zeros(blank, np.float32)]))


def score_quality(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row.  Null and empty texts get the score of a blank; repeated and null ids are rows
    like others; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("quality")
        for batch in batches:
            scores = [net.score(data, offsets) for _, _, data, offsets in text_chunks(batch.column(1), STEP)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores or [np.zeros(0)]).astype(np.float64))], ["doc_id", "score"])

    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bare.mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, net: Network, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is at least ``least``.

    Only texts go to Python and only scores come back.  Null and empty texts get the score of a blank; repeated rows
    and rows with equal or null ids are judged each; columns may have any names; an empty table gives an empty one.
    """

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim_worker("quality")
        for column in texts:
            scores = [net.score(data, offsets) for _, _, data, offsets in text_chunks(column, STEP)]
            yield pa.array(np.concatenate(scores or [np.zeros(0)]).astype(np.float64))

    return docs.filter(score(F.col(text_col).cast("string")) >= least)
