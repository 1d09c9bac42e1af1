"""Shared pieces of the corpus operators: durable intermediates and vectorised word hashing.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` everywhere.  The numpy half works on the raw UTF-8 bytes of an
Arrow string column, a few megabytes at a time, so memory does not follow the length of a batch.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from touchline.durable import Materialized, drop_path, materialize, shared_dir  # noqa: F401

#: One word, as a Java/DuckDB/Python regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step holds (a longer document is a step of its own).
CHUNK_BYTES = 1 << 20

def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: they go when the driver collects its garbage, which a
    driver with free memory may not do for long.  What the first round lets go of may hold more, hence the second."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


_owner: list[str] = [""]
#: What lets go of a worker's caches.
caches: list[Callable[[], None]] = []


def claim_worker(name: str) -> None:
    """Python workers live on from one operator to the next: the first task of another one drops what the former cached."""
    if _owner[0] != name:
        _owner[0] = name
        for forget in caches:
            forget()
        gc.collect()
        pa.default_memory_pool().release_unused()


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------------------------------------------
# vectorised words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
caches.append(_powers.clear)


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.ones(1, np.uint64)
        while len(have) < size:
            step = np.uint64(pow(base, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _window_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end], independent of the place where the run stands."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=total[1:])
    return (total[end] - total[start]) * _power(_INVERSE, len(values) + 1)[start]


class Words:
    """The words of some documents: byte spans, hashes, and for each document its range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        """data: bytes of the texts, one behind the other; offsets: n + 1 places where they begin and end."""
        self.data = _LOWER[data] if lower else data
        ink = ~_SPACE[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = ink[:-1], ink[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner], after[inner - 1] = False, False
        self.start = np.flatnonzero(ink & ~before)
        self.end = np.flatnonzero(ink & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return mix(_window_sums(_BYTE[self.data], self.start, self.end) + (self.end - self.start).astype(np.uint64))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words that lies in one document; and for each document its range of runs.

    Run j of document d starts at its word j, so ranges have max(0, words - k + 1) entries.
    """
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    ranges = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(ranges[-1]) + np.repeat(first[:-1] - ranges[:-1], counts)
    if not len(place):
        return np.zeros(0, np.uint64), ranges
    return mix(_window_sums(words, place, place + k) + np.uint64(k)), ranges


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of steps of about ``size`` bytes; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        last = min(last, n)
        yield row, last, data[at[row] : at[last]], at[row : last + 1] - at[row]
        row = last


def ragged(values: np.ndarray, ranges: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values."""
    return pa.ListArray.from_arrays(pa.array(ranges.astype(np.int32)), pa.array(values, kind))
