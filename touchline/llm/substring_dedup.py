"""Operator 6: substring deduplication with a log-structured index of window fingerprints.

A window is 35 consecutive words of one document.  Every word is removed that a window covers whose word sequence
starts anywhere else too; windows are judged on the input.

The fingerprint of a window is its *anchor*: the least hash among the 8-word runs inside it (the leftmost, on ties).
Equal windows have equal anchors at equal places, so only windows with a repeated anchor can be repeated, and windows
next to each other share anchors: about one fingerprint for 14 words enters the index.

The index keeps immutable runs, sorted by fingerprint and bucketed alike.  A new batch becomes a run, which is
merge-joined with the runs of history; then runs of equal level are compacted into one of the next level.  Fingerprints
that repeat are verified: maximal stretches of windows with one anchor (*segments*) are compared by a hash of all
their words, and where an anchor has different segments, window by window, with two independent hashes.

A text decides alone what is removed from it, so all work is keyed by the text; groups of copies shrink to counts
before they are shuffled, and no key gathers rows of a group in one task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import Materialized, Words, _window_sums, claim_worker, drop_path, free_names, materialize, mix, release, shared_dir, text_chunks

WINDOW, GRAM = 35, 8
#: Batches in which a whole table is fed to a new index.
BATCHES = 4
#: Runs of one level that are compacted into one of the next.
FAN = 2
_SALT = np.uint64(0xA0761D6478BD642F)


class FingerprintIndex:
    """Sorted immutable runs of (fp, n), bucketed by fp, as tables of the session's catalog."""

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark, self.runs = spark, []
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _write(self, df: DataFrame, level: int) -> str:
        name = f"touchline_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}"
        df.repartition(self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", path).option("compression", "zstd").saveAsTable(name)
        self.runs.append((level, name))
        return name

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch of fingerprints (column fp); gives those of the batch that now have been seen twice or more.

        The result is written before the runs are compacted."""
        earlier = [n for _, n in self.runs]
        run = self.spark.table(self._write(batch.groupBy("fp").agg(F.count("*").alias("n")), 0))
        seen = run.select("fp", "n")
        for name in earlier:
            old = self.spark.table(name).select("fp", F.col("n").alias("m"))
            seen = seen.hint("merge").join(old.hint("merge"), "fp", "left").select("fp", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        found = materialize(seen.filter("n > 1").select("fp"))
        self.compact()
        return found

    def compact(self) -> None:
        while True:
            levels = [level for level, _ in self.runs]
            full = next((x for x in levels if levels.count(x) >= FAN), None)
            if full is None:
                return
            a, b = [name for level, name in self.runs if level == full][:2]
            merged = self.spark.table(a).alias("a").hint("merge").join(self.spark.table(b).alias("b").hint("merge"), "fp", "full").select("fp", (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"))
            self._write(merged, full + 1)
            for name in (a, b):
                self.drop(name)
            self.runs = [r for r in self.runs if r[1] not in (a, b)]

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, f"{shared_dir(self.spark).rstrip('/')}/{name}")

    def close(self) -> None:
        for _, name in self.runs:
            self.drop(name)
        self.runs = []


def _segments(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all segments in order: document, first word in the document, windows, anchor hash, hash of all words;
    and the word hashes with the flat places of the segments' first words."""
    h, first = words.hashes(), words.first
    counts = np.maximum(np.diff(first) - (window - 1), 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(doc)) + np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), h, none
    grams = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    whole = np.arange(len(h) - gram + 1)
    grams[: len(whole)] = mix(_window_sums(h, whole, whole + gram))
    # leftmost least gram of each window, by doubling
    width, span, best = window - gram + 1, 1, np.arange(len(h))
    while span < width:
        step = min(span, width - span)
        other = np.minimum(best[np.minimum(np.arange(len(h)) + step, len(h) - 1)], len(h) - 1)
        best = np.where(grams[best] <= grams[other], best, other)
        span += step
    anchor = best[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    place = at[begin]
    context = mix(_window_sums(h, place, place + n + window - 1) + n.astype(np.uint64))
    return doc[begin], place - first[doc[begin]], n, grams[anchor[begin]], context, h, place


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """Texts with their keys t1, t2 (a 64-bit hash and a checksum)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(text.alias("text"), F.xxhash64(text).alias("t1"), F.crc32(text).alias("t2"))


def segments_of(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text_col: str = "text") -> DataFrame:
    """fp, ctx, t1, t2, start, n of each segment of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("windows")
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(0)):
                doc, start, n, fp, ctx, _, _ = _segments(Words(data, offsets), window, gram)
                rows = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp.view(np.int64)), pa.array(ctx.view(np.int64)), batch.column(1).take(rows), batch.column(2).take(rows), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["fp", "ctx", "t1", "t2", "start", "n"],
                )

    return _keyed(docs, text_col).mapInArrow(run, "fp long, ctx long, t1 long, t2 long, start int, n int")


def _windows_of(rows: DataFrame, window: int) -> DataFrame:
    """ctx, i, w1, w2: the windows of chosen segments.  rows: text, starts, ns, ctxs (lists)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("windows")
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(0)):
                words = Words(data, offsets)
                h = words.hashes()
                lists = [batch.column(k).slice(a, b - a) for k in (1, 2, 3)]
                counts = np.diff(np.asarray(lists[0].offsets))
                start, n, ctx = (np.asarray(x.flatten()) for x in lists)
                place = np.repeat(words.first[:-1], counts) + start
                i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(place, n) + i
                w1 = mix(_window_sums(h, at, at + window))
                w2 = mix(_window_sums(mix(h ^ _SALT), at, at + window))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ctx, n)), pa.array(i.astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], ["ctx", "i", "w1", "w2"])

    return rows.mapInArrow(run, "ctx long, i int, w1 long, w2 long")


def repeated_marks(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, text_col: str = "text") -> DataFrame:
    """t1, t2, marks: for each text with repeated windows, its segments (start, mask) with one bit for each window."""
    spark = docs.sparkSession
    if window - gram + 1 > 62:
        raise ValueError("the windows of an anchor must fit a mask of 62 bits")
    segments = Materialized(segments_of(docs, window, gram, text_col))
    index = FingerprintIndex(spark)
    repeated = None
    for k in range(batches):
        found = index.add(segments.read().filter(F.pmod("t1", F.lit(batches)) == k).select("fp"))
        repeated = found if repeated is None else repeated.unionByName(found)
        release(spark)
    index.close()
    # tables of distinct keys are written before they are joined, so that Spark can split a hot key of the other side
    distinct = Materialized(repeated.distinct())
    chosen = Materialized(segments.read().join(distinct.read(), "fp"))
    segments.drop()
    distinct.drop()
    release(spark)
    # copies of a segment shrink to a count; an anchor whose segments are all alike needs no closer look
    alike = Materialized(chosen.read().groupBy("fp", "ctx").agg(F.count("*").alias("c"), F.min("n").alias("n"), F.min(F.struct("t1", "t2", "start")).alias("one")))
    forms = alike.read().groupBy("fp").agg(F.count("*").alias("forms"), F.sum("c").alias("all"))
    judged = Materialized(alike.read().join(forms.filter("all > 1"), "fp"))
    alike.drop()
    release(spark)
    full = judged.read().filter("c > 1").select("ctx", (F.expr("shiftleft(1L, n)") - 1).alias("mask"))
    mixed = judged.read().filter("forms > 1").select("ctx", "c", "n", "one.t1", "one.t2", "one.start")
    per_text = materialize(mixed.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "n", "ctx")).alias("x")))
    # a text that several rows have is looked at once
    texts = _keyed(docs, text_col).join(per_text.hint("merge"), ["t1", "t2"]).groupBy("t1", "t2").agg(F.first("text").alias("text"), F.first("x").alias("x")).select("text", F.col("x.start").alias("starts"), F.col("x.n").alias("ns"), F.col("x.ctx").alias("ctxs"))
    windows = Materialized(_windows_of(texts, window).distinct().join(mixed.select("ctx", "c"), "ctx"))
    release(spark)
    twice = materialize(windows.read().groupBy("w1", "w2").agg(F.sum("c").alias("c")).filter("c > 1").select("w1", "w2"))
    part = windows.read().join(twice, ["w1", "w2"]).groupBy("ctx").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    masks = materialize(full.unionByName(part).groupBy("ctx").agg(F.bit_or("mask").alias("mask")))
    windows.drop()
    judged.drop()
    release(spark)
    marked = chosen.read().select("ctx", "t1", "t2", "start").distinct().join(masks, "ctx")
    found = materialize(marked.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "mask")).alias("marks")))
    chosen.drop()
    release(spark)
    return found


def _with_marks(docs: DataFrame, marks: DataFrame, text_col: str) -> DataFrame:
    """The rows, and behind their columns the lists of starts and masks of their texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t, c, found, starts, masks = free_names(docs, "text", "sum", "marks", "starts", "masks")
    keyed = docs.withColumns({t: F.xxhash64(text), c: F.crc32(text)})
    met = keyed.join(marks.select(F.col("t1").alias(t), F.col("t2").alias(c), F.col("marks").alias(found)), [t, c], "left")
    lists = [F.coalesce(F.col(found)["start"], F.array().cast("array<int>")).alias(starts), F.coalesce(F.col(found)["mask"], F.array().cast("array<bigint>")).alias(masks)]
    return met.select(*[F.col(f"`{x}`") for x in docs.columns], *lists)


def _strip(column: pa.Array, starts: pa.Array, masks: pa.Array, window: int, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
    """(first row, end row, words, removed words, kept words joined by a space) of steps through a batch."""
    for a, b, data, offsets in text_chunks(column):
        words = Words(data, offsets)
        own = starts.slice(a, b - a)
        counts = np.diff(np.asarray(own.offsets))
        place = np.repeat(words.first[:-1], counts) + np.asarray(own.flatten())
        mask = np.asarray(masks.slice(a, b - a).flatten())
        edge = np.zeros(len(words.start) + 1, np.int64)
        for bit in range(bits):
            at = place[(mask >> bit) & 1 == 1] + bit
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept = [k.rstrip(b" ") for k in _kept_bytes(words, offsets, ~gone)]
        yield a, b, np.diff(words.first), np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first]), kept


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the kept words joined by one space) of every row.

    Null, empty and short texts keep all words.  Repeated rows are documents of their own, so equal texts with a
    window remove each other.  Null ids are rows like others; other columns are ignored.
    """
    marks = repeated_marks(docs, window, gram, batches, text_col)
    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bits = window - gram + 1

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("windows")
        for batch in rows:
            for a, b, n_words, n_gone, kept in _strip(batch.column(1), batch.column(2), batch.column(3), window, bits):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n_words), pa.array(n_gone), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([k.decode("utf-8", "replace") for k in kept])],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return _with_marks(bare, marks, "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows, with all their columns, without their repeated words.

    A text that loses words becomes its kept words joined by one space, and a column of lengths follows it; other
    texts stay as they are.  Rows that lose all their words go; null, empty and short texts stay.  Repeated rows are
    documents of their own.  Columns may have any names; an empty table gives an empty one.
    """
    marks = repeated_marks(docs, window, gram, batches, text_col)
    at, n, bits = docs.columns.index(text_col), len(docs.columns), window - gram + 1
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("windows")
        for batch in rows:
            for a, b, n_words, n_gone, kept in _strip(batch.column(at), batch.column(n), batch.column(n + 1), window, bits):
                columns = [batch.column(i).slice(a, b - a) for i in range(n)]
                texts = [k.decode("utf-8", "replace") if g else t for k, g, t in zip(kept, n_gone.tolist(), columns[at].to_pylist(), strict=True)]
                columns[at] = pa.array(texts, columns[at].type)
                if length is not None:
                    columns[length] = pa.array([len(t) if g else x for t, g, x in zip(texts, n_gone.tolist(), columns[length].to_pylist(), strict=True)], columns[length].type)
                yield pa.RecordBatch.from_arrays(columns, docs_names).filter(pa.array((n_gone < n_words) | (n_words == 0)))

    docs_names = docs.columns
    return _with_marks(docs, marks, text_col).mapInArrow(run, docs.schema)


def _kept_bytes(words: Words, offsets: np.ndarray, keep: np.ndarray) -> Iterator[bytes]:
    """Bytes of the kept words of each document, each followed by a space where a byte follows."""
    edge = np.zeros(len(words.data) + 1, np.int64)
    np.add.at(edge, words.start[keep], 1)
    np.add.at(edge, np.minimum(words.end[keep] + 1, len(words.data)), -1)
    chosen = np.cumsum(edge[:-1]) > 0
    data = words.data.copy()
    ink = np.zeros(len(data) + 1, np.int64)
    np.add.at(ink, words.start, 1)
    np.add.at(ink, words.end, -1)
    data[np.cumsum(ink[:-1]) == 0] = 32
    # a word at the end of its document must not take the next document's first byte
    last = offsets[1:][(np.diff(words.first) > 0)]
    ends = words.end[words.first[1:][np.diff(words.first) > 0] - 1]
    tight = last[(ends == last) & (last < len(data))]
    starts = np.zeros(len(data), bool)
    starts[words.start[keep]] = True
    chosen[tight] &= starts[tight]
    at = np.concatenate([[0], np.cumsum(chosen)])[offsets]
    out = data[chosen].tobytes()
    for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield out[x:y]
