"""Full match statistics from events, and JSON made of and merged into columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import match_events as E
from touchline.registry import query

#: The test events as events of a match: the user is the match; sides, kinds and minutes are read off the event's number.
MATCH_EVENTS = """SELECT user_id AS match_id, CASE event_id % 9 WHEN 8 THEN NULL ELSE CASE WHEN event_id % 2 = 0 THEN 'home' ELSE 'away' END END AS side,
  CASE event_id % 7 WHEN 6 THEN NULL ELSE CASE WHEN event_id % 7 < 4 THEN 'home' ELSE 'away' END END AS ball, CAST(event_id % 95 AS INT) AS minute,
  event_id % 4 = 0 AS shot, event_id % 8 = 0 AS on_target, event_id % 24 = 0 AS goal, CASE WHEN event_id % 4 = 0 THEN (event_id % 10) / 8.0e0 END AS xg,
  event_id % 60 = 0 AS big_chance, event_id % 13 = 1 AS corner, event_id % 7 = 2 AS foul, event_id % 35 = 9 AS yellow, event_id % 210 = 9 AS red, event_id % 11 = 3 AS offside, event_id % 3 = 1 AS press FROM events"""


def match_events(spark, sf_dir):
    return spark.sql(MATCH_EVENTS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _twin() -> str:
    """One expression for each column, for both sides."""
    out = []
    for s, p in (("home", "h"), ("away", "a")):
        out += [f"CAST(count(*) FILTER (WHERE side = '{s}' AND {c}) AS BIGINT) AS \"{p}{short}\"" for c, short in E.COUNTS.items()]
        out += [f"round(100e0 * count(*) FILTER (WHERE side IS NOT NULL AND ball = '{s}') / nullif(count(*) FILTER (WHERE side IS NOT NULL AND ball IS NOT NULL), 0), 2) AS {p}poss", f"round(coalesce(sum(xg) FILTER (WHERE side = '{s}'), 0e0), 3) AS {p}xg", f"CAST(nullif(count(*) FILTER (WHERE side = '{s}' AND big_chance), 0) AS BIGINT) AS {p}bc", f"CAST(count(*) FILTER (WHERE side = '{s}' AND press) AS BIGINT) AS {s}_press"]
    rest = "round(count(*) FILTER (WHERE side = 'home' AND press) / nullif(CAST(count(*) FILTER (WHERE side IS NOT NULL AND press) AS DOUBLE), 0), 4) AS home_press_share, count(*) FILTER (WHERE goal AND side IS NOT NULL AND minute <= 15) > 0 AS early_goal, count(*) FILTER (WHERE goal AND side IS NOT NULL AND minute >= 75) > 0 AS late_goal, count(*) FILTER (WHERE side IS NOT NULL AND press) >= 90 AS intense"
    return f"WITH e AS ({MATCH_EVENTS}) SELECT match_id, CAST(count(*) AS BIGINT) AS total_events, {', '.join(out)}, {rest} FROM e GROUP BY match_id"


@query("a19_match_stats", _twin())
def a19(spark, sf_dir):
    return E.match_stats(match_events(spark, sf_dir), ["match_id"])


_OLD = "CASE event_id % 4 WHEN 0 THEN concat('{\"source\":\"log\",\"event_learning\":', props, '}') WHEN 1 THEN '{\"event_learning\":7,\"n\":1}' WHEN 2 THEN props ELSE NULL END"


@query("f51_merge_features", f"""WITH m AS (SELECT event_id, json_merge_patch(coalesce(CASE WHEN json_type(json_extract(j, '$.event_learning')) = 'OBJECT' OR json_extract(j, '$.event_learning') IS NULL THEN j ELSE json_merge_patch(j, '{{"event_learning":null}}') END, '{{}}'), json_object('event_learning', json_object('value', value, 'kind', event_type))) AS j
 FROM (SELECT event_id, value, event_type, CAST({_OLD} AS JSON) AS j FROM events)) SELECT event_id, json_extract_string(j, '$.source') AS source, json_extract_string(j, '$.k') AS k, json_extract_string(j, '$.n') AS n, json_extract_string(j, '$.event_learning.k') AS inner_k, json_extract_string(j, '$.event_learning.kind') AS inner_kind, CAST(json_extract_string(j, '$.event_learning.value') AS DOUBLE) AS inner_value FROM m""")
def f51(spark, sf_dir):
    """Features of an event merged into a JSON text that has some, has none, isn't an object there, or is missing."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    merged = e.withColumn("j", E.merge_features(F.expr(_OLD), {"value": F.col("value"), "kind": F.col("event_type")}))
    at = lambda p: F.get_json_object("j", p)
    return merged.select("event_id", at("$.source").alias("source"), at("$.k").alias("k"), at("$.n").alias("n"), at("$.event_learning.k").alias("inner_k"), at("$.event_learning.kind").alias("inner_kind"), at("$.event_learning.value").cast("double").alias("inner_value"))


@query("f54_known_json", """SELECT event_id, '{' || concat_ws(',', '"event_id":' || event_id, CASE WHEN event_id % 3 > 0 THEN '"kind":"' || event_type || '"' END, CASE WHEN event_id % 5 > 1 THEN '"user":' || user_id END) || '}' AS json,
 CAST(1 + CAST(event_id % 3 > 0 AS INT) + CAST(event_id % 5 > 1 AS INT) AS INT) AS n_known FROM events""")
def f54(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    columns = {"event_id": F.col("event_id"), "kind": F.when(F.col("event_id") % 3 > 0, F.col("event_type")), "user": F.when(F.col("event_id") % 5 > 1, F.col("user_id"))}
    return e.select("event_id", E.known_json(columns).alias("json"), F.size(E.known_map(columns)).alias("n_known"))


@query("a20_tagged_stats", """WITH e AS (SELECT user_id AS match_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 2 = 0 THEN 'home' ELSE 'away' END AS side, event_id % 3 = 0 AS shot, event_id % 6 = 0 AS accurate, event_id % 15 = 0 AS scored, event_id FROM events)
 SELECT match_id, CAST(count(*) AS BIGINT) AS total_events, CAST(count(*) FILTER (WHERE side = 'home' AND shot) AS BIGINT) AS hs, CAST(count(*) FILTER (WHERE side = 'away' AND shot) AS BIGINT) AS "as", CAST(count(*) FILTER (WHERE side = 'home' AND shot AND (accurate OR scored)) AS BIGINT) AS hst, CAST(count(*) FILTER (WHERE side = 'away' AND shot AND (accurate OR scored)) AS BIGINT) AS ast,
 round(100e0 * count(*) FILTER (WHERE side = 'home') / nullif(count(*) FILTER (WHERE side IS NOT NULL), 0), 2) AS hposs, CAST(count(*) FILTER (WHERE side = 'home' AND NOT shot AND accurate) AS BIGINT) AS home_press FROM e GROUP BY match_id""")
def a20(spark, sf_dir):
    """The tagged format's statistics, its tags read off the event's number: shots, shots on target by two tags, possession by events."""
    i = F.col("event_id")
    side = F.when(i % 5 == 4, None).when(i % 2 == 0, "home").otherwise("away")
    no, shot, accurate = F.lit(False), i % 3 == 0, i % 6 == 0
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("match_id"), side.alias("side"), side.alias("ball"), F.lit(30).alias("minute"), shot.alias("shot"), (shot & (accurate | (i % 15 == 0))).alias("on_target"), (i % 15 == 0).alias("goal"), F.lit(None).cast("double").alias("xg"), *[no.alias(c) for c in ("big_chance", "corner", "foul", "yellow", "red", "offside")], (~shot & accurate).alias("press"))
    return E.match_stats(e, ["match_id"], E.INTENSE_TAGGED, False).select("match_id", "total_events", "hs", "as", "hst", "ast", "hposs", "home_press")
