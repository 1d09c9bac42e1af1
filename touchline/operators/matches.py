"""Match facts: canonical rows, sides, standings and table pressure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.prob import clip, outcome
from touchline.functions.text import season_key

#: Statistics whose presence makes a row more complete.
STATS = ["odds_h", "odds_a", "hs", "aws", "hc", "ac", "hy", "ay", "referee"]
#: Total order of rows that are otherwise equal.
TIE = ["ok", "ln", "pk", "sk"]
#: Games of a season and relegation slots; others have DEFAULT_RULE.
LEAGUE_RULES = [("PremierLeague", 38, 3), ("LaLiga", 38, 3), ("SerieA", 38, 3), ("Bundesliga", 34, 3), ("Ligue1", 34, 3), ("Championship", 46, 3), ("ScottishPremiership", 38, 1), ("Eredivisie", 34, 3),
                ("LigaNOS", 34, 2), ("BelgianProLeague", 30, 2), ("SuperLig", 38, 4), ("2Bundesliga", 34, 3), ("Ligue2", 34, 3), ("LaLiga2", 42, 4), ("SerieB", 38, 4)]
DEFAULT_RULE = (38, 3)


def completeness(columns: list[str] = STATS) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


def source_priority(source: Column) -> Column:
    src = F.lower(F.coalesce(source, F.lit("")))
    return (
        F.when(src == "closed_prediction", 100)
        .when(src.contains("flashscore"), 98)
        .when(src.contains("statsbomb"), 95)
        .when(src.contains("wyscout"), 94)
        .when(src == "historical_csv", 90)
        .when(src == "openfootball_repo", 84)
        .otherwise(50)
    )


def canonical(contests: DataFrame) -> DataFrame:
    """One best row for each fixture: completeness, confidence, source, a known outcome, then the total order.

    Rows are dealt by fixture before they are ranked: Spark would else also rank, and so sort, what each task reads, whose size
    follows that of the files, and spill it to drop hardly a row."""
    key = [F.lower(F.trim("league")), F.col("match_date"), F.lower(F.trim("home")), F.lower(F.trim("away"))]
    w = Window.partitionBy(*key).orderBy(
        completeness().desc(), F.coalesce("conf", F.lit(0.0)).desc(), source_priority(F.col("source")).desc(), F.when(outcome(F.col("hg"), F.col("ag")).isNotNull(), 1).otherwise(0).desc(), *[F.col(c).desc() for c in TIE]
    )
    known = contests.filter("league is not null and match_date is not null and home is not null and away is not null")
    return known.repartition(*key).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def sides(matches: DataFrame, *keep: str) -> DataFrame:
    """Two rows for each match, one from each team's view; both have the match's ``keep`` columns."""
    both = F.array(
        F.struct(F.col("home").alias("team"), F.col("away").alias("opponent"), F.lit(1).alias("at_home"), F.col("hg").alias("gf"), F.col("ag").alias("ga"), F.col("xg_h").alias("xg"), F.col("xg_a").alias("xga")),
        F.struct(F.col("away").alias("team"), F.col("home").alias("opponent"), F.lit(0).alias("at_home"), F.col("ag").alias("gf"), F.col("hg").alias("ga"), F.col("xg_a").alias("xg"), F.col("xg_h").alias("xga")),
    )
    rows = matches.withColumn("_s", F.explode(both)).select("league", "match_date", "_s.*", *TIE, *keep)
    points = F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    result = F.when(F.col("gf") > F.col("ga"), "W").when(F.col("gf") == F.col("ga"), "D").otherwise("L")
    return rows.withColumns({"pts": points, "res": result, "season": season_key(F.col("match_date"))})


def standings(matches: DataFrame) -> DataFrame:
    """Table of each league and season, ranked by points, goal difference, goals and name."""
    total = sides(matches).groupBy("league", "season", "team").agg(
        F.count("*").alias("played"), F.sum("pts").alias("points"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.sum(F.col("gf") - F.col("ga")).alias("gd"), *[F.sum((F.col("res") == r).cast("int")).alias(n) for r, n in (("W", "wins"), ("D", "draws"), ("L", "losses"))]
    )
    table = Window.partitionBy("league", "season")
    rank = table.orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), "team")
    return total.withColumns({"position": F.row_number().over(rank), "teams_count": F.count("*").over(table)})


def table_pressure(table: DataFrame, rules: DataFrame) -> DataFrame:
    """Late-season, relegation and title pressure of each row of a table, with a label.

    rules: league, season_games, slots; a league without a rule has DEFAULT_RULE."""
    ruled = table.join(F.broadcast(rules), "league", "left").fillna({"season_games": DEFAULT_RULE[0], "slots": DEFAULT_RULE[1]})
    whole = Window.partitionBy("league", "season")
    at = lambda p: F.max(F.when(F.col("position") == p, F.col("points"))).over(whole)
    slots = F.least("slots", F.greatest(F.lit(0), F.col("teams_count") - 1)).cast("int")
    placed = ruled.withColumn("slots", slots).withColumn("safe_pos", F.greatest(F.lit(1), F.col("teams_count") - F.col("slots")).cast("int"))
    placed = placed.withColumns({"safe_points": at(F.col("safe_pos")), "drop_points": at(F.least("teams_count", F.col("safe_pos") + 1)), "lead_points": at(F.lit(1)), "games_left": F.greatest(F.lit(0), F.col("season_games") - F.col("played"))})
    late = clip((F.col("played") / F.greatest(F.lit(1), F.col("season_games")) - 0.55) / 0.35, 0.0, 1.0)
    inside = (F.col("slots") > 0) & (F.col("position") > F.col("safe_pos"))
    above = F.greatest(F.lit(0), F.col("points") - F.col("drop_points"))
    danger = F.when(inside, 1.0).otherwise(clip((7.0 - above) / 7.0, 0.0, 1.0))
    staged = placed.withColumns({"late": late, "relegation_zone": inside, "danger": danger})
    base = clip(F.col("danger") * (0.35 + 0.65 * F.col("late")), 0.0, 1.0)
    pressure = F.when(F.col("relegation_zone") & (F.col("games_left") <= 3), F.greatest(base, F.lit(0.85))).otherwise(base)
    top = F.when(F.col("position") <= 4, clip((5.0 - F.greatest(F.lit(0), F.col("lead_points") - F.col("points"))) / 5.0, 0.0, 1.0) * (0.25 + 0.75 * F.col("late"))).otherwise(0.0)
    staged = staged.withColumns({
        "rank_strength": 1.0 - (F.col("position") - 1) / F.greatest(F.lit(1), F.col("teams_count") - 1),
        "points_to_safety": F.when(F.col("relegation_zone"), F.greatest(F.lit(0), F.col("safe_points") - F.col("points") + 1)),
        "points_above_drop": F.when(~F.col("relegation_zone"), above),
        "relegation_pressure": pressure, "top_pressure": top,
    })
    must = (F.col("relegation_pressure") >= 0.72) & (F.col("games_left") <= 3)
    label = (
        F.when(must, "Survival must-win")
        .when(F.col("relegation_pressure") >= 0.65, "High survival pressure")
        .when(F.col("relegation_pressure") >= 0.35, "Relegation pressure")
        .when(F.col("top_pressure") >= 0.45, "Top-table pressure")
        .otherwise("Normal table context")
    )
    return staged.withColumns({"must_win": must, "label": label}).drop("slots", "safe_pos", "safe_points", "drop_points", "lead_points", "season_games", "danger")


def training_labels(matches: DataFrame) -> DataFrame:
    """Targets of each match.  Corners and cards are final counts; where one is missing, the sum of both teams' means
    over their last five matches with a count, and -1 where there are none."""
    view = lambda team, flag, corners, cards: F.struct(F.col(team).alias("team"), F.lit(flag).alias("at_home"), F.col(corners).alias("corners"), F.col(cards).alias("cards"))
    rows = matches.select("league", "match_date", *TIE, "hg", "ag", F.explode(F.array(view("home", 1, "hc", "hy"), view("away", 0, "ac", "ay"))).alias("v")).select("league", "match_date", *TIE, "hg", "ag", "v.*")
    last = Window.partitionBy("league", "team").orderBy("match_date", *TIE, "at_home").rowsBetween(-5, -1)
    rows = rows.withColumns({"corners5": F.avg("corners").over(last), "cards5": F.avg("cards").over(last)})
    both = lambda x: F.when(F.count(x) == 2, F.sum(x).cast("double"))
    label = lambda x: F.coalesce(both(x), both(f"{x}5"), F.lit(-1.0)).alias(f"y_{x}")
    goals = F.col("hg") + F.col("ag")
    y = F.when(F.col("hg") > F.col("ag"), 0).when(F.col("hg") == F.col("ag"), 1).otherwise(2)
    over = [(goals > n).cast("int").alias(f"y_o{n}5") for n in (1, 2, 3)]
    met = rows.groupBy("league", "match_date", *TIE, "hg", "ag").agg(label("corners"), label("cards"))
    return met.select(*TIE, y.alias("y_1x2"), ((F.col("hg") > 0) & (F.col("ag") > 0)).cast("int").alias("y_btts"), *over, "y_corners", "y_cards")
