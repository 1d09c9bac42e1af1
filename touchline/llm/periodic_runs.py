"""Operator 12: periodic runs of words, found with suffix-tree LCE queries from Lyndon-root candidates.

A run is a maximal stretch of words with smallest period q and at least max(6, 4 q) words.  For each stretch of a text
that can hold one:

1. Ukkonen suffix trees of the stretch and of its reversal.
2. An Euler tour of each tree with string depths.  The least depth between two leaves is that of their lowest common
   ancestor, so a sparse table answers how far two suffixes (or two prefixes, in the reversal) agree in constant time.
   Its levels are made one after the other and each answers its queries, so memory stays linear.
3. The longest Lyndon word at each place under the order of the symbols and under its inverse: it ends where the next
   smaller (or next greater) suffix starts, by the order of the tree's leaves.
4. Each Lyndon word is extended to both sides as far as its period holds.  Every run has a Lyndon root, so none is missed.

Which stretches can hold one: every five words of a run recur in it, either three times or within three words, so
words outside such recurring fives are in no run.  The filter compares hashes and lets too much through at worst;
the trees are built on the words themselves.

Rows are independent, there is no shuffle, and memory in a task follows the longest stretch of one text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import claim_worker, mix, text_chunks

#: A run has at least LEAST words and POWER periods.
LEAST, POWER = 6, 4
#: Length of the recurring word sequences that the filter looks at.
GRAM = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


class SuffixTree:
    """Ukkonen's tree of a list of symbols; the last symbol must be unique.

    Node 0 is the root; the edge into node v is symbols[first[v]:last[v]]; leaves have no ``kids``."""

    def __init__(self, symbols: list[int]) -> None:
        self.symbols, n = symbols, len(symbols)
        first, last, kids, link = [0], [0], [{}], [0]
        at, edge, length, waiting = 0, 0, 0, 0
        for i, c in enumerate(symbols):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                below = kids[at]
                v = below.get(symbols[edge])
                if v is None:
                    below[symbols[edge]] = len(first)
                    first.append(i)
                    last.append(n)
                    kids.append(None)
                    link.append(0)
                    if unlinked:
                        link[unlinked], unlinked = at, 0
                else:
                    span = last[v] - first[v]
                    if length >= span:
                        edge, length, at = edge + span, length - span, v
                        continue
                    middle = first[v] + length
                    if symbols[middle] == c:
                        if unlinked:
                            link[unlinked] = at
                        length += 1
                        break
                    split = len(first)
                    first += [first[v], i]
                    last += [middle, n]
                    kids += [{symbols[middle]: v, c: split + 1}, None]
                    link += [0, 0]
                    first[v] = middle
                    below[symbols[edge]] = split
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                waiting -= 1
                if at:
                    at = link[at]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.first, self.last, self.kids = first, last, kids

    def tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String depths along the Euler tour, the place of each suffix's leaf in it, and each suffix's rank."""
        first, last, kids, n = self.first, self.last, self.kids, len(self.symbols)
        depths, place, rank = [0], [0] * n, [0] * n
        top = kids[0]
        stack, above, leaves = [iter([top[s] for s in sorted(top)])], [0], 0
        while stack:
            v = next(stack[-1], None)
            if v is None:
                stack.pop()
                above.pop()
                if above:
                    depths.append(above[-1])
                continue
            depth = above[-1] + last[v] - first[v]
            below = kids[v]
            if below is None:
                suffix = n - depth
                place[suffix], rank[suffix] = len(depths), leaves
                leaves += 1
                depths += [depth, above[-1]]
            else:
                depths.append(depth)
                stack.append(iter([below[s] for s in sorted(below)]))
                above.append(depth)
        return np.array(depths, np.int32), np.array(place, np.int64), np.array(rank, np.int64)


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low:high + 1]) of each query by a sparse table, one level after the other."""
    out = np.zeros(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table, width = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            table = np.minimum(table[: len(table) - width], table[width:])
            width *= 2
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[low[own]], table[high[own] - width + 1])
    return out


def common_extension(depths: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of suffixes i and j (different ones)."""
    x, y = place[i], place[j]
    return range_minima(depths, np.minimum(x, y), np.maximum(x, y)).astype(np.int64)


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value; len(rank) if there is none."""
    values, out, stack = rank.tolist(), [len(rank)] * len(rank), []
    for i, r in enumerate(values):
        while stack and values[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: list[int], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of non-negative symbols with at least max(least, power * period) of them, in order.  power is 2 or more."""
    n = len(symbols)
    if n < max(least, power):
        return []
    depths, place, rank = SuffixTree([*symbols, -1]).tour()
    back_depths, back_place, _ = SuffixTree([*symbols[::-1], -1]).tour()
    rank = rank[:n]
    here = np.arange(n)
    i = np.concatenate([here, here])
    j = np.concatenate([next_smaller(rank), next_smaller(-rank)])
    # the period must fit into the stretch so often, else there is no run; the end sorts before all symbols, so under the
    # inverse order a word up to it need not be a Lyndon word, and runs up to it have their root under the first order
    fits = ((j - i) * power <= n) & ((j < n) | (np.arange(2 * n) < n))
    i, j = i[fits], j[fits]
    right = np.zeros(len(i), np.int64)
    inside = j < n
    right[inside] = common_extension(depths, place, i[inside], j[inside])
    left = np.zeros(len(i), np.int64)
    inside = (i > 0) & (j <= n)
    # suffix n - i of the reversal is the prefix before place i, read backwards
    left[inside] = common_extension(back_depths, back_place, n - i[inside], n - j[inside])
    period = j - i
    length = left + period + right
    long = length >= np.maximum(least, power * period)
    found = np.unique(np.stack([(i - left)[long], length[long], period[long]], 1), axis=0)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return [tuple(x) for x in found.tolist()]


def stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words that can hold a run."""
    n = len(hashes)
    if n < LEAST:
        return []
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams = grams * _ODD + hashes[k : k + len(grams)]
    grams = mix(grams)
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    again = ordered[1:] == ordered[:-1]
    if not again.any():
        return []
    first = np.flatnonzero(np.concatenate([[True], ~again]))
    count = np.diff(np.concatenate([first, [len(grams)]]))
    keep = np.zeros(len(grams), bool)
    keep[order] = np.repeat(count >= POWER - 1, count)
    near = again & (np.diff(order) <= POWER - 1)
    keep[order[1:][near]] = True
    keep[order[:-1][near]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(keep)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + GRAM, -1)
    covered = np.concatenate([[False], np.cumsum(edge[:n]) > 0, [False]])
    begin, end = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(covered[:-1] & ~covered[1:])
    return [(a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True) if b - a >= LEAST]


def find_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of words, by start and period."""
    if len(words) < LEAST:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = []
    for a, b in stretches(hashes):
        ids: dict[bytes, int] = {}
        out += [(a + s, n, q) for s, n, q in runs_of([ids.setdefault(w, len(ids)) for w in words[a:b]])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_runs(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that are not a repetition inside a run: of each run its first period stays."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [words[k] for k in np.flatnonzero(~gone).tolist()]


def repeat_a_tail(words: list[bytes], number: int | None) -> list[bytes]:
    """The test damage of the contract: for every tenth document (by the checksum of its number) a tail becomes periodic."""
    n = len(words)
    if number is None or not n:
        return words
    h = zlib.crc32(str(number).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int | None, int | None, int | None, int | None]:
    """start, length, period, exponent in thousandths of the run with the greatest exponent; ties by start, then period."""
    best = None
    for start, length, period in runs:  # in order, so that a later one must be greater
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return (None, None, None, None) if best is None else (*best, 1000 * best[1] // best[2])


_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"


def periodic_runs(docs: DataFrame, damage: bool = False, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: n_runs, the strongest run, digests of all runs and of the text without its repetitions, and that text.

    ``damage`` applies ``repeat_a_tail`` before; ``texts`` adds the column ``collapsed`` (kept words joined by a space).
    Null and blank texts have no words and no runs; their digests are those of nothing.  A null id is damaged by nothing.
    Repeated rows are judged each, very long texts whole; an empty table gives no rows; other columns are ignored.
    """
    kinds = [pa.int64()] * 6 + [pa.string()] * (3 if texts else 2)
    names = [x.split()[0] for x in _OUT.split(", ")][: len(kinds)]

    def row(number: int | None, text: bytes) -> tuple:
        words = text.split()  # bytes split at exactly the six blanks of the contract
        if damage:
            words = repeat_a_tail(words, number)
        runs = find_runs(words)
        kept = b" ".join(without_runs(words, runs))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        out = (number, len(runs), *strongest(runs), hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())
        return (*out, kept.decode()) if texts else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("runs")
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                ids, whole = batch.column(0).slice(a, b - a).to_pylist(), data.tobytes()
                rows = [row(ids[k], whole[offsets[k] : offsets[k + 1]]) for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bare.mapInArrow(run, ", ".join(_OUT.split(", ")[: len(kinds)]))
