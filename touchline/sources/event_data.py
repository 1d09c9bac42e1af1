"""Match events of two public formats: folders of nested JSON files, and zipped JSON with a map of teams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.archives import read_members

#: Leagues by the name of their competition, and by country.
COMPETITIONS = {"Premier League": "PremierLeague", "La Liga": "LaLiga", "Serie A": "SerieA", "1. Bundesliga": "Bundesliga", "Ligue 1": "Ligue1"}
COUNTRIES = {"England": "PremierLeague", "Spain": "LaLiga", "Italy": "SerieA", "Germany": "Bundesliga", "France": "Ligue1"}

_NAMED = "struct<name: string>"
_CARD = f"struct<card: {_NAMED}>"
#: What is read of the files; all other members of an object are skipped by the parser.
COMPETITION = "competition_id long, season_id long, competition_name string, season_name string"
MATCH = "match_id long, match_date string, home_team struct<home_team_name: string, name: string>, away_team struct<away_team_name: string, name: string>, home_score int, away_score int"
EVENT = f"minute int, team {_NAMED}, possession_team {_NAMED}, type {_NAMED}, shot struct<statsbomb_xg: double, one_on_one: boolean, outcome: {_NAMED}>, pass struct<name: string, type: {_NAMED}>, foul_committed {_CARD}, bad_behaviour {_CARD}"
TAGGED_MATCH = "wyId long, dateutc string, date string, competitionId long, teamsData map<string, struct<side: string, score: int>>"
TAGGED_EVENT = "matchId long, teamId long, eventName string, subEventName string, eventSec double, tags array<struct<id: int>>"


def _lookup(names: dict[str, str], key):
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def _files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON files (arrays or single objects) below a folder, with their file; a broken file gives none."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    parsed = F.from_json("value", f"array<struct<{schema}>>")
    return texts.select(F.explode(parsed).alias("x"), F.col("_metadata.file_path").alias("file")).select("x.*", "file")


def read_nested_events(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Matches (match_id, league, season, match_date, home, away, hg, ag) and events (match_id, side of the team and of the ball, ...).

    The folder holds competitions.json, matches/<competition>/<season>.json and events/<match>.json.  Competitions of other
    leagues, matches without names, a date or events, and broken files go.  Ids of files come from their names."""
    competition = spark.read.schema(COMPETITION).option("multiLine", True).json(f"{folder}/competitions.json").withColumn("league", _lookup(COMPETITIONS, F.col("competition_name"))).filter("league is not null")
    place = lambda k: F.regexp_extract("file", r"([0-9]+)/([0-9]+)\.json$", k).try_cast("long")
    named = lambda s: F.trim(F.coalesce(F.nullif(F.col(f"{s}_team.{s}_team_name"), F.lit("")), F.col(f"{s}_team.name"), F.lit("")))
    matches = _files(spark, f"{folder}/matches", MATCH).withColumns({"competition_id": place(1), "season_id": place(2)})
    matches = matches.join(competition.dropDuplicates(["competition_id", "season_id"]), ["competition_id", "season_id"])
    matches = matches.select("match_id", "league", F.col("season_name").alias("season"), F.left("match_date", F.lit(10)).alias("match_date"), named("home").alias("home"), named("away").alias("away"), F.col("home_score").alias("hg"), F.col("away_score").alias("ag"))
    matches = matches.filter("match_id is not null and home <> '' and away <> '' and match_date <> ''").dropDuplicates(["match_id"])
    events = _files(spark, f"{folder}/events", EVENT).withColumn("match_id", F.regexp_extract("file", r"([0-9]+)\.json$", 1).try_cast("long"))
    met = events.join(matches.select("match_id", "home", "away"), "match_id")
    side = lambda c: F.when(F.trim(c) == F.col("home"), "home").when(F.trim(c) == F.col("away"), "away")
    card = F.coalesce("foul_committed.card.name", "bad_behaviour.card.name", F.lit(""))
    kind, outcome = F.coalesce(F.col("type.name"), F.lit("")), F.coalesce(F.col("shot.outcome.name"), F.lit(""))
    found = met.select(
        "match_id",
        side(F.col("team.name")).alias("side"),
        side(F.col("possession_team.name")).alias("ball"),
        kind.alias("kind"),
        F.coalesce("minute", F.lit(0)).alias("minute"),
        (kind == "Shot").alias("shot"),
        ((kind == "Shot") & outcome.isin("Goal", "Saved", "Saved to Post")).alias("on_target"),
        ((kind == "Shot") & (outcome == "Goal")).alias("goal"),
        F.when(kind == "Shot", F.col("shot.statsbomb_xg")).alias("xg"),
        ((kind == "Shot") & F.coalesce(F.col("shot.one_on_one"), F.lit(False))).alias("big_chance"),
        ((kind == "Pass") & (F.coalesce("pass.name", "pass.type.name", F.lit("")) == "Corner")).alias("corner"),
        (kind == "Foul Committed").alias("foul"),
        (kind.isin("Foul Committed", "Bad Behaviour") & F.contains(card, F.lit("Yellow"))).alias("yellow"),
        (kind.isin("Foul Committed", "Bad Behaviour") & F.contains(card, F.lit("Red"))).alias("red"),
        (kind == "Offside").alias("offside"),
        kind.isin("Pressure", "Duel", "Interception").alias("press"),
    )
    return matches.join(events.select("match_id").distinct(), "match_id", "left_semi"), found


def read_tagged_events(spark: SparkSession, matches_path: str, events_path: str, teams_path: str) -> tuple[DataFrame, DataFrame]:
    """Matches and events as ``read_nested_events`` gives them, from zipped arrays named ..._<country>.json.

    teams_path: a JSON array of wyId, name, officialName.  A match's map of teams is exploded to its sides; matches without two known
    sides, a date or events, and members that can't be read go.  Possession is the share of events."""
    teams = spark.read.schema("wyId long, name string, officialName string").option("multiLine", True).json(teams_path)
    teams = teams.filter("wyId is not null").groupBy("wyId").agg(F.max(F.coalesce(F.nullif("name", F.lit("")), "officialName", F.lit(""))).alias("team"))

    def rows(path: str, schema: str) -> DataFrame:
        held = read_members(spark, path, ".json").filter("content is not null")
        country = F.regexp_extract("member", r"_([^_/]+)\.json$", 1)
        parsed = F.from_json(F.decode("content", "UTF-8"), f"array<struct<{schema}>>")
        return held.select(_lookup(COUNTRIES, country).alias("league"), F.explode(parsed).alias("x")).filter("league is not null").select("league", "x.*")

    said = rows(matches_path, TAGGED_MATCH)
    day = F.left(F.coalesce(F.nullif("dateutc", F.lit("")), "date", F.lit("")), F.lit(10))
    each = said.select("league", F.col("wyId").alias("match_id"), day.alias("match_date"), F.explode("teamsData").alias("id", "data")).select("league", "match_id", "match_date", F.col("id").try_cast("long").alias("wyId"), F.lower("data.side").alias("side"), "data.score")
    each = each.filter("wyId is not null and side in ('home', 'away')").join(teams, "wyId")
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    matches = each.groupBy("league", "match_id", "match_date").agg(of("home", "team").alias("home"), of("away", "team").alias("away"), of("home", "score").alias("hg"), of("away", "score").alias("ag"), of("home", "wyId").alias("home_id"), of("away", "wyId").alias("away_id"))
    matches = matches.filter("match_id is not null and home <> '' and away <> '' and match_date <> ''")
    events = rows(events_path, TAGGED_EVENT).withColumnRenamed("matchId", "match_id")
    met = events.join(matches.select("league", "match_id", "home_id", "away_id"), ["league", "match_id"])
    side = F.when(F.col("teamId") == F.col("home_id"), "home").when(F.col("teamId") == F.col("away_id"), "away")
    tag = lambda *ids: F.coalesce(F.exists("tags", lambda t: t["id"].isin(*ids)), F.lit(False))
    kind, sub = F.coalesce("eventName", F.lit("")), F.coalesce("subEventName", F.lit(""))
    no = F.lit(False)
    found = met.select(
        "match_id",
        side.alias("side"),
        side.alias("ball"),
        kind.alias("kind"),
        F.floor(F.coalesce("eventSec", F.lit(0.0)) / 60).cast("int").alias("minute"),
        (kind == "Shot").alias("shot"),
        ((kind == "Shot") & tag(1801, 101)).alias("on_target"),
        ((kind == "Shot") & tag(101)).alias("goal"),
        F.lit(None).cast("double").alias("xg"),
        no.alias("big_chance"),
        ((kind == "Free Kick") & (sub == "Corner")).alias("corner"),
        (kind == "Foul").alias("foul"),
        ((kind == "Foul") & tag(1702)).alias("yellow"),
        ((kind == "Foul") & tag(1701, 1703)).alias("red"),
        (kind == "Offside").alias("offside"),
        (kind.isin("Duel", "Pass") & tag(1801)).alias("press"),
    )
    seen = events.select("league", "match_id").distinct()
    return matches.join(seen, ["league", "match_id"], "left_semi").select("match_id", "league", "match_date", "home", "away", "hg", "ag"), found
