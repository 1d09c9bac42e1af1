"""Temporal operators over sides (two rows for each match)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from touchline.functions.prob import clip
from touchline.functions.text import season_key
from touchline.operators.matches import TIE


def by_team() -> WindowSpec:
    """A team's rows in their total order."""
    return Window.partitionBy("league", "team").orderBy("match_date", *TIE, "at_home")


def streaks(sides: DataFrame) -> DataFrame:
    """Add ``streak``: the run of wins (+) or losses (-) that ends before the row, at most 5; 0 after a draw.

    Gaps and islands: a new island starts where the result changes, and the place in the island is the length."""
    changed = F.when(F.col("res") == F.lag("res").over(by_team()), 0).otherwise(1)
    islands = sides.withColumn("_change", changed).withColumn("_island", F.sum("_change").over(by_team().rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("league", "team", "_island").orderBy("match_date", *TIE, "at_home"))
    run = F.when(F.col("res") == "W", F.least(F.lit(5), place)).when(F.col("res") == "L", -F.least(F.lit(5), place)).otherwise(0)
    return islands.withColumn("_run", run).withColumn("streak", F.coalesce(F.lag("_run").over(by_team()), F.lit(0))).drop("_change", "_island", "_run")


def running_standings(sides: DataFrame) -> DataFrame:
    """Points and place of each team before each of its match days, among the teams seen earlier in the season.

    The grid has a row for each day of a league's season and team: cumulative sums of team days are carried over it."""
    day = sides.groupBy("league", "season", "match_date", "team").agg(F.sum("pts").alias("pts"), F.sum(F.col("gf") - F.col("ga")).alias("gd"), F.sum("gf").alias("gf"))
    days = day.select("league", "season", "match_date").distinct()
    teams = day.select("league", "season", "team").distinct()
    grid = days.join(teams, ["league", "season"]).join(day, ["league", "season", "match_date", "team"], "left")
    before = Window.partitionBy("league", "season", "team").orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    table = grid.withColumns({"_p": F.sum("pts").over(before), "_d": F.sum("gd").over(before), "_g": F.sum("gf").over(before)})
    seen = table.filter("_p is not null")
    today = Window.partitionBy("league", "season", "match_date")
    ranked = seen.withColumns({"position_before": F.row_number().over(today.orderBy(F.desc("_p"), F.desc("_d"), F.desc("_g"), "team")), "teams_before": F.count("*").over(today)})
    ranked = ranked.select("league", "season", "match_date", "team", F.col("_p").alias("points_before"), "position_before", "teams_before")
    return day.select("league", "season", "match_date", "team").join(ranked, ["league", "season", "match_date", "team"], "left")


def momentum(sides: DataFrame, last: int) -> DataFrame:
    """Points and chance balance of the last matches, weighted from 0.5 (oldest) to 1 (newest)."""
    newest = Window.partitionBy("league", "team").orderBy(F.desc("match_date"), *[F.desc(c) for c in TIE], F.desc("at_home"))
    tail = sides.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= last)
    tail = tail.withColumn("_n", F.count("*").over(Window.partitionBy("league", "team")))
    weight = F.when(F.col("_n") == 1, 0.5).otherwise(0.5 + 0.5 * (F.col("_n") - F.col("_back")) / F.greatest(F.col("_n") - 1, F.lit(1)))
    total = tail.withColumn("_w", weight).groupBy("league", "team").agg(F.sum("_w").alias("w"), F.sum(F.col("pts") * F.col("_w")).alias("p"), F.sum((F.col("xg") - F.col("xga")) * F.col("_w")).alias("d"))
    return total.select("league", "team", (0.8 + F.col("p") / F.col("w") / 3.0 * 0.4 + clip(F.col("d") / F.col("w") * 0.05, -0.1, 0.1)).alias("momentum"))


def chronological_split(matches: DataFrame, share: float) -> DataFrame:
    """Add ``train``: whether a match is in the first ``share`` of its league."""
    league = Window.partitionBy("league")
    return matches.withColumn("train", F.row_number().over(league.orderBy("match_date", *TIE)) <= F.floor(F.count("*").over(league) * share))


def season_choice(matches: DataFrame, least: int) -> DataFrame:
    """For each match day the season whose table is used: the current one once it has ``least`` earlier matches, else
    the newest earlier season with as many, else the current one."""
    day = matches.groupBy("league", season_key(F.col("match_date")).alias("season"), "match_date").agg(F.count("*").alias("n"))
    before = Window.partitionBy("league", "season").orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    day = day.withColumn("matches_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    season = day.groupBy("league", "season").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("league").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    prior = season.withColumn("prior", F.max(F.when(F.col("total") >= least, F.col("season"))).over(earlier)).select("league", "season", "prior")
    used = F.when(F.col("matches_before") >= least, F.col("season")).otherwise(F.coalesce("prior", "season"))
    return day.join(prior, ["league", "season"]).select("league", "match_date", "season", "matches_before", used.alias("used"))


def asof(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], time: str, value: str, default: float) -> DataFrame:
    """Backward as-of join: the last value of the right side at or before the left row's time.

    Both sides are united and the last known value is carried forward, so a key costs one sort and no row is
    multiplied; right has one row for each key and time."""
    keys = [f"_k{i}" for i in range(len(left_keys))]
    a = left.select(*[F.col(c).alias(k) for c, k in zip(left_keys, keys, strict=True)], F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast("double").alias("_v"))
    b = right.select(*[F.col(c).alias(k) for c, k in zip(right_keys, keys, strict=True)], F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"), F.col(value).cast("double").alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    united = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return united.filter("_side = 1").select("_row.*", F.coalesce("_last", F.lit(default)).alias(value))


def with_known_team(rows: DataFrame, known: DataFrame, team: str, found: str) -> DataFrame:
    """Add ``found``: the row's team if ``known`` (league, team) has it, else the least known team of the league with the
    same last word, else null.  Names are resolved once each, not row by row."""
    last = lambda c: F.element_at(F.split(F.lower(F.trim(c)), r"\s+"), -1)
    have = known.select("league", "team").distinct()
    by_word = have.filter(last("team") != "").groupBy("league", last("team").alias("_word")).agg(F.min("team").alias("_near"))
    named = rows.select("league", F.col(team).alias("_team")).distinct().withColumn("_word", last("_team"))
    met = named.join(have.select("league", F.col("team").alias("_team"), F.lit(True).alias("_same")), ["league", "_team"], "left").join(by_word, ["league", "_word"], "left")
    resolved = met.select("league", F.col("_team").alias(team), F.when(F.col("_same"), F.col("_team")).otherwise(F.col("_near")).alias(found))
    return rows.join(resolved, ["league", team], "left")
