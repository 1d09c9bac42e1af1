"""Models that are judged on rows they have not seen: walk-forward folds and their gate, stacking, a sweep, calibration by league."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.durable import materialize
from touchline.functions.prob import outcome
from touchline.operators import calibration as K
from touchline.operators import matches as M
from touchline.operators import validation as V
from touchline.queries.quality import canon
from touchline.registry import query

LAST = "1998-12-31"
MARKET = ["m_h", "m_d", "m_a"]
PAST = [f"{side}_{c}" for side in ("h", "a") for c in ("gf", "ga", "pts")]
FEATURES = [*MARKET, *PAST]


#: What the rows of a match say themselves.
OWN = ["year", "age", "y", *MARKET]


def priced(spark, sf_dir) -> DataFrame:
    """The canonical rows and OWN: year, age, result (null: unknown) and implied probabilities (null if a price is missing)."""
    inverse = [1.0 / F.col(c) for c in ("odds_h", "odds_d", "odds_a")]
    total = inverse[0] + inverse[1] + inverse[2]
    y = outcome(F.col("hg"), F.col("ag"))
    own = {"year": F.year("match_date"), "age": F.datediff(F.lit(LAST).cast("date"), "match_date").cast("double"), "y": F.when(y == "H", 0).when(y == "D", 1).when(y == "A", 2)}
    return canon(spark, sf_dir).withColumns(own | {n: x / total for x, n in zip(inverse, MARKET, strict=True)})


def outcome_rows(spark, sf_dir) -> DataFrame:
    """league, year, age, y, implied probabilities (null if a price is missing), what both teams did before, and the keys of each match.

    The match's own columns travel with its home side, so both sides meet in one aggregation; the rows are written once, as models read them many times."""
    past = V.history_features(M.sides(priced(spark, sf_dir), *OWN), ["match_date", *M.TIE, "at_home"])
    at = lambda k, c: F.max(F.when(F.col("at_home") == k, F.col(c)))
    history = [at(k, f"past_{c}").alias(f"{p}_{c}") for k, p in ((1, "h"), (0, "a")) for c in ("gf", "ga", "pts")]
    both = past.groupBy("league", *M.TIE, "match_date").agg(*[at(1, c).alias(c) for c in OWN], *history)
    return materialize(both.filter("y is not null").dropna(subset=M.TIE))


@query("m06_walk_forward")
def m06(spark, sf_dir):
    """Each league's years, each judged by a model of the years before; fitted together by Newton steps, so no SQL."""
    return V.walk_forward(outcome_rows(spark, sf_dir), FEATURES, MARKET)


@query("a28_walk_forward_gate")
def a28(spark, sf_dir):
    rows = outcome_rows(spark, sf_dir)
    return V.gate(V.walk_forward(rows, FEATURES, MARKET), rows)


BASES = [V.Spec(1.0, tuple(range(3))), V.Spec(1.0, tuple(range(3, 9)))]
#: The sweep: three ridges, three sets of features, with and without a half-life of two years.
GRID = [V.Spec(ridge, some, half) for ridge in (0.3, 3.0, 30.0) for some in (tuple(range(3)), tuple(range(3, 9)), None) for half in (None, 730.0)]


@query("m10_stacking")
def m10(spark, sf_dir):
    """A market model and a history model, and a second one on their out-of-fold probabilities; no SQL."""
    s = V.stacked(outcome_rows(spark, sf_dir), ["league", *M.TIE], FEATURES, BASES)
    return s.select("league", *M.TIE, "y", "part", *[F.round(F.col("stacked")[k], 6).alias(n) for k, n in enumerate(("p_h", "p_d", "p_a"))])


@query("m11_sweep")
def m11(spark, sf_dir):
    """Eighteen candidates, each judged on rows it has not seen, all trained in the same passes; no SQL."""
    s = V.sweep(outcome_rows(spark, sf_dir), ["league", *M.TIE], FEATURES, GRID)
    grid = F.array(*[F.struct(F.lit(g.ridge).alias("ridge"), F.lit(9 if g.features is None else len(g.features)).alias("n_features"), F.lit(g.half_life).cast("double").alias("half_life")) for g in GRID])
    return s.withColumn("g", F.element_at(grid, F.col("candidate") + 1)).select("candidate", "g.*", *[F.round(c, 6).alias(c) for c in ("accuracy", "log_loss", "brier")], "place")


@query("m01_league_isotonic")
def m01(spark, sf_dir):
    """Calibrated probabilities of every match with prices: one fit for each league and outcome on its newest 3,000; no SQL."""
    rows = priced(spark, sf_dir).filter("y is not null and m_h is not null").dropna(subset=M.TIE)
    named = rows.select("league", "match_date", *M.TIE, F.element_at(F.array(F.lit("H"), F.lit("D"), F.lit("A")), F.col("y") + 1).alias("ftr"), *[F.col(m).alias(p) for m, p in zip(MARKET, K.OUTCOMES.values(), strict=True)])
    found = K.calibrate(named, K.fit_isotonic(named), ["league", *M.TIE])
    return found.select("league", *M.TIE, *[F.round(c, 9).alias(c) for c in ("cal_h", "cal_d", "cal_a")])


@query("m12_importances")
def m12(spark, sf_dir):
    """What moves the outcome model's logits most; fitted by Newton steps, so no SQL."""
    found = V.importances(outcome_rows(spark, sf_dir), FEATURES)
    return found.select("feature", "class", *[F.round(c, 6).alias(c) for c in ("weight", "spread", "importance")], "place")
