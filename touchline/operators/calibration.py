"""Isotonic calibration of three-way probabilities, one fit for each league and outcome, all of them in one sorted pass."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.durable import materialize
from touchline.functions.prob import clip

OUTCOMES = {"H": "p_h", "D": "p_d", "A": "p_a"}
#: Newest rows of a league that teach, rows below which it stays as it is, share of the fit, bounds of the result.
NEWEST, LEAST, SHARE, LOW, HIGH = 3000, 200, 0.70, 0.01, 0.98
#: Cells of the unit interval by which fits are looked up.
CELLS = 100
INFINITE = float("inf")


def pool(points: list[tuple[float, float]]) -> list[tuple[float, float, float]]:
    """Pool-adjacent-violators of points (x, y) in order of x: blocks (first x, last x, mean y), y ascending.  Equal x are one point first."""
    blocks: list[list[float]] = []  # first, last, sum, weight
    merged: list[list[float]] = []
    for x, y in points:
        if merged and merged[-1][0] == x:
            merged[-1][1] += y
            merged[-1][2] += 1
        else:
            merged.append([x, y, 1])
    for x, total, weight in merged:
        blocks.append([x, x, total, weight])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, more, heavier = blocks.pop()
            blocks[-1][1] = last
            blocks[-1][2] += more
            blocks[-1][3] += heavier
    return [(a, b, s / w) for a, b, s, w in blocks]


def pieces(blocks: list[tuple[float, float, float]]) -> list[tuple[float, float, float, float]]:
    """The fit as pieces (low, high, y at low, y at high): flat over a block, straight between blocks, flat outside."""
    if not blocks:
        return []
    out, at, y = [], -INFINITE, blocks[0][2]
    for a, b, v in blocks:
        out.append((at, a, y, v))
        if b > a:
            out.append((a, b, v, v))
        at, y = b, v
    return [*out, (at, INFINITE, y, y)]


def fit_isotonic(rows: DataFrame, newest: int = NEWEST, least: int = LEAST) -> DataFrame:
    """league, outcome, low, high, y_low, y_high: the pieces of each league's three fits.

    rows: league, match_date, order columns ``ok, ln, pk, sk``, ftr, p_h, p_d, p_a.  Only rows with a result and all three probabilities count; of a league its
    ``newest`` by date teach, and one with fewer than ``least`` has no fit.  A task streams its sorted rows and holds one fit of
    at most ``newest`` points."""
    known = rows.filter(F.col("ftr").isin(*OUTCOMES) & F.col("p_h").isNotNull() & F.col("p_d").isNotNull() & F.col("p_a").isNotNull())
    latest = Window.partitionBy("league").orderBy(*[F.desc(c) for c in ("match_date", "ok", "ln", "pk", "sk")])
    taught = materialize(known.withColumn("_k", F.row_number().over(latest)).filter(F.col("_k") <= newest).select("league", "ftr", *OUTCOMES.values()))
    enough = taught.groupBy("league").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("league")
    each = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(p).cast("double").alias("p"), (F.col("ftr") == o).cast("double").alias("y")) for o, p in OUTCOMES.items()])
    points = taught.join(enough, "league", "left_semi").select("league", F.explode(each).alias("e")).select("league", "e.*").filter(~F.isnan("p"))
    dealt = points.repartition("league", "outcome").sortWithinPartitions("league", "outcome", "p", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            found = pieces(pool(held))
            columns = [pa.array([key[k]] * len(found), pa.string()) for k in (0, 1)] + [pa.array([f[k] for f in found], pa.float64()) for k in range(4)]
            return pa.RecordBatch.from_arrays(columns, ["league", "outcome", "low", "high", "y_low", "y_high"])

        for batch in batches:
            for league, outcome, p, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != (league, outcome):
                    if held:
                        yield out()
                    key, held = (league, outcome), []
                held.append((p, y))
        if held:
            yield out()

    return dealt.mapInArrow(run, "league string, outcome string, low double, high double, y_low double, y_high double")


def calibrate(rows: DataFrame, fits: DataFrame, key: list[str], share: float = SHARE) -> DataFrame:
    """The rows with cal_h, cal_d, cal_a: ``share`` of the fit and the rest of the raw probability, clipped and made to sum to 1.

    Rows of leagues without fits keep their probabilities, as do rows with an unknown one.  A probability meets its piece by an
    equi-join on league, outcome and a cell of the unit interval, so neither a league nor a fit is held by one task.  ``key`` names a row."""
    cell = lambda x: F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor(x * CELLS))).cast("int")
    spread = fits.withColumn("cell", F.explode(F.sequence(cell(F.greatest(F.lit(0.0), "low")), cell(F.least(F.lit(1.0), "high")))))
    spread = materialize(spread)  # written first, so that Spark can split the rows of a hot league
    each = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(p).cast("double").alias("p")) for o, p in OUTCOMES.items()])
    asked = rows.select("league", *key, F.explode(each).alias("e")).select("league", *key, "e.*").filter("p is not null").withColumn("cell", cell(F.col("p")))
    met = asked.join(spread, ["league", "outcome", "cell"]).filter((F.col("p") >= F.col("low")) & (F.col("p") < F.col("high")))
    steep = F.col("y_high") != F.col("y_low")  # the outer pieces are flat
    value = F.col("y_low") + F.when(steep, (F.col("y_high") - F.col("y_low")) * (F.col("p") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    fitted = met.groupBy(*key).agg(*[F.max(F.when(F.col("outcome") == o, value)).alias(f"_{o}") for o in OUTCOMES])
    mixed = {o: clip((1.0 - share) * F.col(p) + share * F.col(f"_{o}"), LOW, HIGH) for o, p in OUTCOMES.items()}
    total = mixed["H"] + mixed["D"] + mixed["A"]
    return rows.join(fitted, key, "left").select(*rows.columns, *[F.coalesce(mixed[o] / total, F.col(p).cast("double")).alias(f"cal_{o.lower()}") for o, p in OUTCOMES.items()])
