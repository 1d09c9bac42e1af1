"""Fixed-shape sequences of a team's last matches, and rolling means with and without a look ahead.

One window pass collects what a step needs; every feature is then computed inside the row, so no feature costs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.prob import clip

STEPS, WIDTH = 20, 22
#: Features of a step, the column each comes from, its scale, and what an unknown value counts as (after scaling).
SCALED: list[tuple[str, float, float]] = [
    ("shots_for", 25, 0.45), ("shots_against", 25, 0.45), ("sot_for", 10, 0.40), ("sot_against", 10, 0.40), ("corners_for", 15, 0.35), ("cards_for", 8, 0.25),
]
CONTEXT: list[tuple[str, float, float]] = [("season_week", 52, 20 / 52), ("travel_distance", 1000, 0.0), ("referee_id", 10, 0.0), ("crowd_size", 100_000, 0.25)]
#: The padding step of a served sequence; that of a training sequence is an unknown match.
SERVED_PAD = [0.0, 0.0, 0.33, 0.45, 0.45, 0.40, 0.40, 0.35, 0.25, 0.50, 0.50, 0.50, 0.50, 0.50, 0.43, 0.50, 0.38, 0.00, 0.00, 0.25, 0.0, 0.5]
TRAINED_PAD = [0.0, 0.0, 1 / 3, 0.45, 0.45, 0.40, 0.40, 0.35, 0.25, 0.5, 0.5, 0.5, 0.5, 0.5, 3 / 7, 0.0, 20 / 52, 0.0, 0.0, 0.25, 0.0, 0.5]
SERVED_REST, SERVED_WEEK = 0.43, 0.38


def team_matches(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Two rows for each match, one from each team's view, with its own and the other's statistics."""
    side = lambda team, other, h, x, y, home: F.struct(F.col(team).alias("team"), F.col(other).alias("opponent"), F.lit(home).alias("was_home"), F.col(f"{x}g").alias("gf"), F.col(f"{y}g").alias("ga"), F.col(h[0]).alias("shots_for"), F.col(h[1]).alias("shots_against"), F.col(f"{x}c").alias("corners_for"), F.col(f"{x}y").alias("cards_for"), F.col(h[2]).alias("xg_for"), F.col(h[3]).alias("xg_against"))
    both = F.array(side("home", "away", ("hs", "aws", "xg_h", "xg_a"), "h", "a", 1.0), side("away", "home", ("aws", "hs", "xg_a", "xg_h"), "a", "h", 0.0))
    return matches.select("league", "match_date", *keys, F.explode(both).alias("s")).select("league", "match_date", *keys, "s.*")


def _points() -> Column:
    return F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)


def _base(columns: list[str], served: bool) -> Column:
    """The 20 features of a step that depend on its match alone (a served one's rest comes from the sequence)."""

    def norm(name: str, scale: float, default: float) -> Column:
        if name not in columns:
            return F.lit(float(default))
        x = F.col(name).cast("double")
        return F.coalesce(F.when(~F.isnan(x), clip(x / scale, 0.0, 1.0)), F.lit(float(default)))

    goals = [clip(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / 5, 0.0, 1.0) for c in ("gf", "ga")]
    f, a = F.col("xg_for").cast("double"), F.col("xg_against").cast("double")
    both = f.isNotNull() & a.isNotNull() & ~F.isnan(f) & ~F.isnan(a)
    gap = F.when(both, clip((f - a + 3.0) / 6.0, 0.0, 1.0)).otherwise(0.5)
    if served:  # unknown without both; shots and the like are never known
        week = F.coalesce(F.dayofyear("match_date") / 365.0, F.lit(SERVED_WEEK))
        middle = [gap, *[F.when(both, F.least(F.lit(1.0), x / 2.0)).otherwise(0.5) for x in (f, a)], F.lit(0.5), norm("opponent_strength", 1, 0.5), F.lit(SERVED_REST), F.col("was_home"), week, norm("travel_distance", 1000, 0.0), F.lit(0.0), F.lit(0.25)]
        return F.array(*goals, _points() / 3, *[F.lit(d) for _, _, d in SCALED], *middle)
    middle = [gap, norm("xg_for", 2, 0.5), norm("xg_against", 2, 0.5), norm("possession", 100, 0.5), norm("opponent_strength", 1, 0.5), norm("rest_days", 7, 3 / 7), F.col("was_home")]
    return F.array(*goals, _points() / 3, *[norm(*s) for s in SCALED], *middle, *[norm(*c) for c in CONTEXT])


def encode(sides: DataFrame, order: list[str], served: bool = False, steps: int = STEPS) -> DataFrame:
    """The rows of ``sides`` with ``sequence`` (steps x 22) and ``mask`` (1 for a match, 0 for padding) of the team's matches before this one.

    Sequences are filled up on the left.  Besides its match's features a step has the run of wins or losses and the points of the last five
    steps before it in the sequence.  ``served`` takes the constants of serving: other padding, no statistics but goals and expected
    goals, the day of the year, and the days since the step before as rest."""
    before = Window.partitionBy("league", "team").orderBy(*order).rowsBetween(-steps, -1)
    step = F.struct(_base(sides.columns, served).alias("x"), _points().alias("p"), F.col("match_date").alias("day"))
    held = sides.withColumn("_step", step).withColumn("_h", F.collect_list("_step").over(before)).drop("_step")
    wins = lambda i: F.transform(F.slice("_h", 1, i), lambda s: F.when(s["p"] == 3, 1).when(s["p"] == 0, -1).otherwise(0))
    run = lambda i: F.aggregate(wins(i), F.lit(0), lambda s, d: F.when(d == 0, 0).when(F.signum(s) == d, s + d).otherwise(d))
    last = lambda i: F.slice("_h", F.greatest(i - 4, F.lit(1)), F.least(i, F.lit(5)))  # noqa: E731 - the five before step i + 1
    form = lambda i: F.when(i > 0, F.aggregate(last(i), F.lit(0), lambda s, e: s + e["p"]) / 15.0).otherwise(0.5)
    streak = lambda i: clip(F.when(i > 0, run(i)).otherwise(0) / 5.0, -1.0, 1.0)

    def whole(s: Column, i: Column) -> Column:
        x = s["x"]
        if served:
            rest = F.when(i > 0, F.coalesce(F.least(F.lit(1.0), F.abs(F.datediff(s["day"], F.try_element_at("_h", F.when(i > 0, i).otherwise(1))["day"])) / 7.0), F.lit(SERVED_REST))).otherwise(SERVED_REST)
            x = F.concat(F.slice(x, 1, 14), F.array(rest), F.slice(x, 16, 5))
        return F.concat(x, F.array(streak(i), form(i)))

    pad = F.array(*[F.lit(float(v)) for v in (SERVED_PAD if served else TRAINED_PAD)])
    empty = F.lit(steps) - F.size("_h")
    found = held.withColumns({"sequence": F.concat(F.array_repeat(pad, empty), F.transform("_h", whole)), "mask": F.concat(F.array_repeat(F.lit(0), empty), F.transform("_h", lambda s: F.lit(1)))})
    return found.drop("_h")


def rolling_means(sides: DataFrame, order: list[str], columns: list[str], static: bool, last: int = 5) -> DataFrame:
    """The rows with mean_... of the team's ``last`` matches of this venue in the league.

    ``static`` takes the last ones of the whole slice for every row, as the models of old were trained (it knows the future);
    otherwise the ones before the row, 0 if there are none.  A window in the one case, a ranking and an aggregation in the other."""
    place = ["league", "team", "was_home"]
    if not static:
        before = Window.partitionBy(*place).orderBy(*order).rowsBetween(-last, -1)
        return sides.select("*", *[F.coalesce(F.avg(c).over(before), F.lit(0.0)).alias(f"mean_{c}") for c in columns])
    newest = Window.partitionBy(*place).orderBy(*[F.desc(c) for c in order])
    tail = sides.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= last).groupBy(*place).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in columns])
    return sides.join(tail, place)
