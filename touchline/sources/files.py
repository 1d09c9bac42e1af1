"""Readers and writers of match files.  Paths may lie in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.text import first_existing, parse_date

#: Column aliases of season files, in order of preference.
ALIASES = {"date": ["Date", "MatchDate", "date"], "home": ["HomeTeam", "Home", "home_team", "team1"], "away": ["AwayTeam", "Away", "away_team", "team2"], "hg": ["FTHG", "FTHome", "home_score"], "ag": ["FTAG", "FTAway", "away_score"], "ftr": ["FTR", "FTResult"], "hc": ["HC", "HomeCorners", "HomeCorner"]}
#: Bookmakers' columns: the first price above 1 counts.
BOOKMAKERS = {"odds_h": ["B365H", "BbAvH", "PSH", "WHH"], "odds_d": ["B365D", "BbAvD", "PSD", "WHD"], "odds_a": ["B365A", "BbAvA", "PSA", "WHA"]}


def normalise(rows: DataFrame) -> DataFrame:
    """Season rows under any of the known column names: date, teams, goals, result, odds.  Rows without both teams or
    with a date that no format fits go; a missing result follows from the goals."""
    have = rows.columns
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)") if c in have else F.lit(None).cast("double")
    odds = {name: F.coalesce(*[F.when(number(c) > 1.0, number(c)) for c in cs]) for name, cs in BOOKMAKERS.items()}
    picked = rows.select(*[first_existing(have, a).cast("string").alias(n) for n, a in ALIASES.items()], *[x.alias(n) for n, x in odds.items()], *[c for c in ("file",) if c in have])
    goals = picked.withColumns({c: F.expr(f"try_cast({c} AS int)") for c in ("hg", "ag", "hc")}).withColumn("match_date", parse_date(F.col("date")))
    result = F.coalesce(F.upper(F.substring("ftr", 1, 1)), F.when(F.col("hg") > F.col("ag"), "H").when(F.col("hg") == F.col("ag"), "D").when(F.col("hg") < F.col("ag"), "A"))
    return goals.withColumn("ftr", result).filter("match_date is not null and home is not null and away is not null").drop("date")


def read_season_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files with differing headers, united by name."""
    frames = [spark.read.csv(p, header=True).withColumn("file", F.input_file_name()) for p in paths]
    united = frames[0]
    for f in frames[1:]:
        united = united.unionByName(f, allowMissingColumns=True)
    return normalise(united)


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV members of zip archives, one task for each member."""
    from touchline.sources import archives

    return archives.read_zipped_csv(spark, path, columns)


def read_football_json(spark: SparkSession, path: str) -> DataFrame:
    """Files of the form {matches: [{date, team1, team2, score: {ft: [home, away]}}]}, folders included."""
    schema = "matches array<struct<date:string, team1:string, team2:string, score:struct<ft:array<int>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path).select(F.explode("matches").alias("m"))
    ft = F.col("m.score.ft")
    return rows.select(parse_date(F.col("m.date")).alias("match_date"), F.col("m.team1").alias("home"), F.col("m.team2").alias("away"), F.try_element_at(ft, F.lit(1)).alias("hg"), F.try_element_at(ft, F.lit(2)).alias("ag")).filter("match_date is not null")


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    """Open entries of a prediction log (a JSON array)."""
    schema = "id string, date string, league string, home string, away string, prediction string, prob double, odds double, closing_odds double, edge double, result string"
    return spark.read.schema(schema).option("multiLine", True).json(path).filter("result is null or result = 'PENDING'")


def write_league_json(matches: DataFrame, path: str) -> None:
    """One folder of JSON lines for each league."""
    matches.write.mode("overwrite").partitionBy("league").json(path)
