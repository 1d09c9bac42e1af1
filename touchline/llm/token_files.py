"""Operator 8: token ids in files compressed by Re-Pair grammars.

Documents are range-partitioned by id, so that each partition is a shard of the ascending order.  A shard is a row of
blocks; a block holds the symbols of its documents after frequent pairs of ids were replaced, round by round, by
nonterminals, together with the rules and the length of each rule's expansion.  A block decodes on its own, and the
lengths let a reader find any id of a document without expanding what lies before it.

A block is one record of a Parquet file (see SCHEMA), so writing is committed by Spark's committer and files can lie
in any store that Spark reaches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import Materialized, claim_worker, text_chunks
from touchline.llm.tokens import STEP_BYTES, encoder, vocabulary_path

END_ID = 2
#: Rounds of replacement, pairs replaced in a round, and the occurrences that a pair needs.
ROUNDS, PAIRS, LEAST = 4, 512, 24
_SLOTS = 1 << 17
#: Bytes of text in a block.
BLOCK_BYTES = 2 << 20
#: shard and block place; before: ids of the shard's earlier blocks; n_ids; per document its id, ids and symbols;
#: first: the first nonterminal; rules: uint32 pairs; lengths: uint32; symbols: uint16, or uint32 if wide.
SCHEMA = "shard int, block int, before long, n_ids long, doc_ids array<long>, doc_tokens array<int>, doc_symbols array<int>, first int, rules binary, lengths binary, wide boolean, symbols binary"


def compress(ids: np.ndarray, first: int, barrier: int = END_ID, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k says that symbol ``first + k`` stands for the pair rules[k].

    Pairs with the barrier are never replaced, so a document's last id stays a symbol.  The pairs of one round never
    overlap: no symbol is the left part of one and the right part of another.
    """
    narrow = first + rounds * PAIRS <= 1 << 16 and (not len(ids) or int(ids.max()) < 1 << 16)  # a pair fits into 32 bits, which sort faster
    kind, half, spread, drop = (np.uint32, 16, 2654435761, 15) if narrow else (np.uint64, 32, 0x9E3779B97F4A7C15, 47)
    seq, rules = ids.astype(kind), []
    for _ in range(rounds):
        if len(seq) < 2:
            break
        left, right = seq[:-1], seq[1:]
        codes = (left << kind(half)) | right
        slot = ((codes * kind(spread)) >> kind(drop)).astype(np.int64)
        counts = np.bincount(slot, minlength=_SLOTS)
        floor = max(LEAST, int(np.partition(counts, -4 * PAIRS)[-4 * PAIRS]))
        place = np.flatnonzero((counts >= floor)[slot] & (left != barrier) & (right != barrier) & (left != right))
        code = codes[place]
        pairs, n = np.unique(code, return_counts=True)
        chosen, lefts, rights = [], set(), set()
        best = np.lexsort((pairs, -n))[: 4 * PAIRS]
        for pair, count in zip(pairs[best].tolist(), n[best].tolist(), strict=True):
            a, b = pair >> half, pair & ((1 << half) - 1)
            if count < LEAST or len(chosen) == PAIRS:
                break
            if a not in rights and b not in lefts:
                lefts.add(a)
                rights.add(b)
                chosen.append(pair)
        if not chosen:
            break
        chosen.sort()
        table, likely = np.array(chosen, kind), np.zeros(_SLOTS, bool)
        likely[(table * kind(spread)) >> kind(drop)] = True
        place = place[likely[slot[place]]]
        code = codes[place]
        at = np.minimum(np.searchsorted(table, code), len(table) - 1)
        hit = table[at] == code
        seq = seq.copy()
        seq[place[hit]] = first + len(rules) + at[hit]
        keep = np.ones(len(seq), bool)
        keep[place[hit] + 1] = False
        seq = seq[keep]
        rules += [(c >> half, c & ((1 << half) - 1)) for c in chosen]
    return seq.astype(np.uint32), np.array(rules, np.uint32).reshape(-1, 2)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    lengths: list[int] = []
    for a, b in rules.tolist():
        lengths.append((lengths[a - first] if a >= first else 1) + (lengths[b - first] if b >= first else 1))
    return np.array(lengths, np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for: each rule is expanded once, from those before it, and copied to its places."""
    if not len(rules):
        return symbols.astype(np.uint32)
    parts: list[list[int]] = []
    for a, b in rules.tolist():
        parts.append((parts[a - first] if a >= first else [a]) + (parts[b - first] if b >= first else [b]))
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    flat, begin = np.fromiter(chain.from_iterable(parts), np.uint32, int(size.sum())), np.cumsum(size) - size
    more = np.flatnonzero(symbols >= first)
    rule = symbols[more].astype(np.int64) - first
    counts = np.ones(len(symbols), np.int64)
    counts[more] = size[rule]
    out, place = np.repeat(symbols.astype(np.uint32), counts), (np.cumsum(counts) - counts)[more]
    for k in range(int(counts.max(initial=0))):  # a rule's expansion has at most 2 ** ROUNDS ids
        if k:
            deep = counts[more] > k
            more, rule, place = more[deep], rule[deep], place[deep]
        out[place + k] = flat[begin[rule] + k]
    return out


def read_ids(block: dict, doc: int, start: int, stop: int) -> np.ndarray:
    """ids start..stop of the block's document number ``doc``; only the symbols that touch the range are expanded."""
    first = block["first"]
    rules = np.frombuffer(block["rules"], "<u4").reshape(-1, 2)
    lengths = np.frombuffer(block["lengths"], "<u4")
    at = int(sum(block["doc_symbols"][:doc]))
    own = np.frombuffer(block["symbols"], "<u4" if block["wide"] else "<u2")[at : at + block["doc_symbols"][doc]].astype(np.int64)
    size = np.ones(len(own), np.int64)
    size[own >= first] = lengths[own[own >= first] - first]
    ends = np.cumsum(size)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    skip = start - int(ends[a - 1] if a else 0)
    return expand(own[a:b], rules, first)[skip : skip + stop - start]


def write_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> Materialized:
    """Encode whole texts and write the shards in ascending order of ids (nulls first, then by text hash)."""
    path = vocabulary_path(vocabulary)
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim_worker("tokens")
        shard, block, before, coder = TaskContext.get().partitionId(), 0, 0, encoder(path)
        first, end = max(coder.tokenizer.get_vocab_size(), end_id + 1), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            steps = ((a, batch.column(1).slice(a, b - a)) for a, b, _, _ in text_chunks(batch.column(1), STEP_BYTES))
            blocks = ((a + c, a + d, blobs[c:d]) for a, texts in steps for blobs in [coder.encode(texts)] for c, d, _, _ in text_chunks(texts, BLOCK_BYTES))
            for a, b, blobs in blocks:
                blobs = [x + end for x in blobs]
                counts = np.array([len(x) // 4 for x in blobs], np.int64)
                ids = np.frombuffer(b"".join(blobs), "<u4")
                symbols, rules = compress(ids, first, end_id)
                lengths = expansion_lengths(rules, first)
                size = np.ones(len(symbols), np.int64)
                size[symbols >= first] = lengths[symbols[symbols >= first] - first]
                last = np.searchsorted(np.cumsum(size), np.cumsum(counts)) + 1
                wide = first + len(rules) > 1 << 16
                row = {
                    "shard": shard, "block": block, "before": before, "n_ids": int(counts.sum()), "doc_ids": batch.column(0).slice(a, b - a).to_pylist(), "doc_tokens": counts.tolist(),
                    "doc_symbols": np.diff(last, prepend=0).tolist(), "first": first, "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "wide": wide,
                    "symbols": symbols.astype("<u4" if wide else "<u2").tobytes(),
                }
                block, before = block + 1, before + row["n_ids"]
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return Materialized(bare.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, SCHEMA))


_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())),
    ("doc_symbols", pa.list_(pa.int32())), ("first", pa.int32()), ("rules", pa.binary()), ("lengths", pa.binary()), ("wide", pa.bool_()), ("symbols", pa.binary()),
])


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 from the files.

    An empty table has no files and no rows; a null or empty text is its end id alone; rows with equal ids follow one
    another.
    """
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    bases = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).cast("long").alias("base"))
    names = ["base", "before", "doc_ids", "doc_tokens", "first", "rules", "wide", "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = dict(zip(names, (batch.column(i)[k] for i in range(len(names))), strict=True))
                rules = np.frombuffer(x["rules"].as_buffer(), "<u4").reshape(-1, 2)
                ids = expand(np.frombuffer(x["symbols"].as_buffer(), "<u4" if x["wide"].as_py() else "<u2"), rules, x["first"].as_py()).astype("<u4")
                counts = np.array(x["doc_tokens"].as_py(), np.int64)
                ends = np.cumsum(counts)
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                starts = x["base"].as_py() + x["before"].as_py() + ends - counts
                yield pa.RecordBatch.from_arrays([x["doc_ids"].values, pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(F.broadcast(bases), "shard").select(*names)
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
