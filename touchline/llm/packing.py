"""Operator 9: packing by concatenate and cut.

All documents stand behind one another in one long stream of ids, which is cut into fixed windows; a document that
crosses a cut leaves a boundary record in each window.  Two passes give the places: the first encodes each input
partition and keeps running sums inside it, the second adds the prefix sum of the partition totals.  No row is
shuffled; the totals are one row for each partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import claim_worker, materialize, text_chunks
from touchline.llm.tokens import STEP_BYTES, encoder, vocabulary_path

WINDOW, END_ID = 4096, 2


def encode_partitions(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, before (ids of the partition's earlier documents), n (with the end id), ids (two bytes each where
    the vocabulary allows it, zstd-compressed by the table's codec)."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim_worker("tokens")
        part, before, encode = TaskContext.get().partitionId(), 0, encoder(path).encode
        if max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) > 1 << 16:
            raise ValueError("packing keeps ids in two bytes: the vocabulary has more than 65,536")
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a, b, _, _ in text_chunks(batch.column(1), STEP_BYTES):
                blobs = [np.frombuffer(x + end, "<u4").astype("<u2") for x in encode(batch.column(1).slice(a, b - a))]
                n = np.array([len(x) for x in blobs], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(starts), pa.array(n), pa.array([x.tobytes() for x in blobs], pa.binary())],
                    ["doc_id", "part", "before", "n", "ids"],
                )

    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bare.mapInArrow(run, "doc_id long, part int, before long, n long, ids binary")


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Sequences are numbered from 0 and all but the last are full.  A null or empty text is the end id alone.  Rows
    with equal or null ids are documents of their own.  An empty table gives no pieces; other columns are ignored.
    The vocabulary must have at most 65,536 ids.
    """
    kept = materialize(encode_partitions(docs, vocabulary, end_id, id_col, text_col))
    totals = kept.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))
    placed = kept.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                wide = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
                n = len(wide)
                edges = [0, *range(window - at % window, n, window), n]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    piece = wide[a:b].tobytes()
                    rows.append((doc_id, a, b - a, zlib.crc32(piece), n, (at + a) // window, (at + a) % window, piece))
                if len(rows) >= 4096:
                    yield _pieces(rows)
                    rows = []
            if rows:
                yield _pieces(rows)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    *numbers, ids = zip(*rows, strict=True)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in numbers], pa.array(ids, pa.binary())], names)
