"""Operator 2: shards of near equal bytes by a minimax contiguous partition.

Rows with equal texts form one atomic group.  Groups stand in the order of their text digests; a shard is a
contiguous run of groups.  The smallest feasible capacity is found by binary search with a greedy check, then the
order is cut there.  A group larger than a fair share of what is left gets a shard of its own first, so that one hot
text doesn't leave other shards empty; the search then covers the rest.

The order is never collected.  The driver sees, for each step, at most a few thousand *cells* (ranges of the running
size): a search over cells bounds the capacity from below (cuts anywhere in a cell) and from above (cuts at known
ends only), and the cells in which a cut can lie are split further by one Spark aggregation until both bounds agree.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import materialize

#: Ranges of the running size in the first look, and parts into which a range is split afterwards.
CELLS, SPLIT = 4096, 64


def running_sums(df: DataFrame, order: list[Column | str], values: dict[str, str]) -> DataFrame:
    """Add to each row the sums of columns over all rows before it in ``order`` (values: new name -> column).

    Two passes: rows are range-partitioned by the order and written once; the totals of the partitions (one row for
    each) give the offsets, and a window inside a partition gives the rest.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = materialize(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    totals = rows.groupBy("_part").agg(*[F.sum(c).cast("long").alias(k) for k, c in values.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = totals.select("_part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).cast("long").alias(f"_{k}") for k in values])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(offsets), "_part")  # as many rows as partitions
    return out.select(*df.columns, *[(F.col(f"_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).cast("long").alias(k) for k, c in values.items()])


class _Cells:
    """Known ends of groups on the line of running sizes; ``hidden`` ones have further ends before them."""

    def __init__(self, rows: list[tuple[int, int]]) -> None:
        rows = sorted(rows)
        self.ends = [e for e, _ in rows]
        self.hidden = [n > 1 for _, n in rows]

    def cuts(self, capacity: int, shards: int, fluid: bool) -> list[int] | None:
        """Greedy cuts at this capacity; None if the shards don't suffice."""
        at, out, total = 0, [], self.ends[-1]
        for _ in range(shards):
            reach = at + capacity
            if reach >= total:
                return [*out, total]
            i = bisect.bisect_right(self.ends, reach)
            known = self.ends[i - 1] if i else 0
            step = reach if fluid and self.hidden[i] else known
            if step <= at:
                return None
            out.append(at := step)
        return None

    def least(self, shards: int, low: int, fluid: bool) -> int:
        high = self.ends[-1]
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, fluid) is None:
                low = mid + 1
            else:
                high = mid
        return low


def minimax_cuts(groups: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """Ends (running sizes) of the shards; groups has ``_end`` (running size with the group) and is stable."""
    if total <= 0:
        return []
    width = max(1, total // CELLS)

    def look(rows: DataFrame, w: int) -> list[tuple[int, int]]:
        cell = F.floor((F.col("_end") - 1) / F.lit(w))
        return [(r[0], r[1]) for r in rows.groupBy(cell.alias("c")).agg(F.max("_end"), F.count("*")).select("max(_end)", "count(1)").collect()]

    known = dict(look(groups, width))
    while True:
        cells = _Cells(list(known.items()))
        low = cells.least(shards, max(largest, -(-total // shards)), True)
        high = cells.least(shards, low, False)
        if low == high:
            return cells.cuts(high, shards, False)
        first, last = cells.cuts(low, shards, True), cells.cuts(high, shards, True)
        touched: set[int] = set()
        for j in range(max(len(first), len(last))):
            a = bisect.bisect_left(cells.ends, min(x[min(j, len(x) - 1)] for x in (first, last)) - j * (high - low))
            b = bisect.bisect_left(cells.ends, max(x[min(j, len(x) - 1)] for x in (first, last)) + j * (high - low))
            touched |= {i for i in range(a, min(b, len(cells.ends) - 1) + 1) if cells.hidden[i]}
        if not touched:  # no hidden end can matter
            touched = {i for i, h in enumerate(cells.hidden) if h}
        width = max(1, width // SPLIT)
        spans = []
        for i in sorted(touched):
            lo, hi = (cells.ends[i - 1] if i else 0), cells.ends[i]
            if spans and spans[-1][1] == lo:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
            known.pop(hi)
        inside = F.lit(False)
        for lo, hi in spans:
            inside = inside | ((F.col("_end") > lo) & (F.col("_end") <= hi))
        known |= dict(look(groups.filter(inside), width))


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard: id, size, text_crc32, shard, slot.

    size: UTF-8 bytes of the text plus 8; a null text has no bytes and is equal to an empty one.
    Rows with equal texts share a shard.  slot counts a shard's rows from 0 without gaps, by digest, then id.
    Null and repeated ids are rows like others.  An empty table gives an empty result; other columns are ignored.
    """
    text = F.col(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"),
        )
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("gsize"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    # groups above a fair share of the rest get a shard each: fewer than there are shards
    alone: list[bytes] = []
    left, free, largest = total, shards, 0
    for digest, gsize in groups.orderBy(F.desc("gsize"), "digest").limit(shards).collect():
        largest = gsize
        if free == 1 or gsize * free <= left:
            break
        alone.append(bytes(digest))
        left, free, largest = left - gsize, free - 1, 0
    rest = groups.filter(~F.col("digest").isin([F.lit(x) for x in alone])) if alone else groups
    if left <= 0:
        cuts, bounds = [], []
    else:
        line = materialize(running_sums(rest, ["digest"], {"_before": "gsize"}).select("digest", (F.col("_before") + F.col("gsize")).alias("_end")))
        cuts = minimax_cuts(line, left, largest, free)
        bounds = [bytes(r[0]) for r in line.filter(F.col("_end").isin(cuts[:-1])).orderBy("_end").select("digest").collect()] if len(cuts) > 1 else []
    shard = F.lit(len(alone))
    for k, bound in enumerate(bounds):
        shard = F.when(F.col("digest") > F.lit(bound), len(alone) + k + 1).otherwise(shard)
    for k, digest in enumerate(alone):
        shard = F.when(F.col("digest") == F.lit(digest), k).otherwise(shard)
    placed = rows.withColumns({"shard": shard.cast("int"), "one": F.lit(1)})
    numbered = materialize(running_sums(placed, ["shard", "digest", "doc_id"], {"place": "one"}))
    starts = numbered.groupBy("shard").agg(F.min("place").alias("start"))  # a row for each shard
    return numbered.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("start")).alias("slot"))
