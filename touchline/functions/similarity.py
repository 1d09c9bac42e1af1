"""Similarity of names by matching blocks: the longest common block, then the longest ones to its left and right, and so on.

The ratio is twice the matched letters over all letters.  All pairs of a batch are worked on together in numpy: a round
finds the longest block of every open pair of intervals and opens the two that remain beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from touchline.durable import materialize

#: Pairs that one numpy step holds.
STEP = 4096


def _points(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one row for each text, filled up to the longest; and lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(lengths.max(initial=0))), fill, np.int64)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), "<u4")
    return out, lengths


def _longest(a: np.ndarray, b: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b, and length of the longest common block of a[x0:x1] and b[y0:y1]; the first in a, then in b."""
    n, width = b.shape
    column = np.arange(width)
    open_y = (column >= y0[:, None]) & (column < y1[:, None])
    run = np.zeros((n, width + 1), np.int64)
    size, end_x, end_y = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(int(x1.max(initial=0))):
        live = (i >= x0) & (i < x1)
        equal = (b == a[:, i : i + 1]) & open_y & live[:, None]
        run[:, 1:] = np.where(equal, run[:, :-1] + 1, 0)
        best = run.argmax(1)
        longest = run[np.arange(n), best]
        better = longest > size
        size[better], end_x[better], end_y[better] = longest[better], i + 1, best[better]
    return end_x - size, end_y - size, size


def block_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """The ratio of each pair; 1 for two empty texts.  Time is a small multiple of the product of the lengths."""
    a, la = _points(left, -1)
    b, lb = _points(right, -2)
    matched = np.zeros(len(left), np.int64)
    pair = np.flatnonzero((la > 0) & (lb > 0))
    x0, y0, x1, y1 = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64), la[pair], lb[pair]
    while len(pair):
        i, j, k = _longest(a[pair], b[pair], x0, x1, y0, y1)
        np.add.at(matched, pair, k)
        # what stays to the left and to the right of the block
        pair = np.concatenate([pair, pair])
        x0, x1 = np.concatenate([x0, i + k]), np.concatenate([i, x1])
        y0, y1 = np.concatenate([y0, j + k]), np.concatenate([j, y1])
        keep = np.concatenate([k, k]) > 0
        keep &= (x0 < x1) & (y0 < y1)
        pair, x0, x1, y0, y1 = pair[keep], x0[keep], x1[keep], y0[keep], y1[keep]
    total = la + lb
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


def bare(name: Column) -> Column:
    """Lower case, only a-z, digits and spaces, without blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", ""))


def bound(a: Column, b: Column) -> Column:
    """What the ratio can reach at most by the lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 2.0 * F.least(F.length(a), F.length(b)) / total).otherwise(1.0)


@F.arrow_udf(DoubleType())
def block_ratio(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The ratio of two string columns; null if either is."""
    for left, right in columns:
        out = []
        for at in range(0, len(left), STEP):
            x, y = left.slice(at, STEP).to_pylist(), right.slice(at, STEP).to_pylist()
            known = [k for k in range(len(x)) if x[k] is not None and y[k] is not None]
            row = [None] * len(x)
            for k, v in zip(known, block_ratios([x[k] for k in known], [y[k] for k in known]).tolist(), strict=True):
                row[k] = v
            out += row
        yield pa.array(out, pa.float64())


def with_ratio(pairs: DataFrame, a: str, b: str, name: str, least: float = 0.0) -> DataFrame:
    """Rows whose columns a and b have a ratio of ``least`` or more, with it as ``name``.

    Each distinct pair of names is compared once, and only if its lengths allow ``least``; the scores are written and
    joined back.  Written first, so that Spark can split a pair of names that very many rows have.  Rows with a null name go."""
    possible = pairs.filter(bound(F.col(a), F.col(b)) >= least)
    distinct = possible.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    scored = materialize(distinct.withColumn("_ratio", block_ratio("_a", "_b"))).filter(F.col("_ratio") >= least)
    return possible.join(scored, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b"))).drop("_a", "_b").withColumnRenamed("_ratio", name)
