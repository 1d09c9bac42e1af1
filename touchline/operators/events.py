"""Free text of pages and event streams turned into statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Home, away, kick-off, goals of a fixture line.
MATCH_LINE = r"^\s*(.+?)\s+(?:v|vs)\.?\s+(.+?)\s+(\d{1,2}:\d{2})\s+(\d+)\s*-\s*(\d+)\s*$"


def parse_match_lines(rows: DataFrame, column: str) -> DataFrame:
    """Add home, away, kickoff, hg, ag; rows whose line is no fixture go."""
    part = lambda i: F.regexp_extract(column, MATCH_LINE, i)
    found = rows.filter(F.col(column).rlike(MATCH_LINE))
    return found.withColumns({"home": part(1), "away": part(2), "kickoff": part(3), "hg": part(4).cast("int"), "ag": part(5).cast("int")})


def scraped_number(text):
    """First number of a text, with a comma or a point; null if there is none."""
    return F.regexp_replace(F.regexp_extract(text, r"-?\d+(?:[.,]\d+)?", 0), ",", ".").try_cast("double")


def parse_stat_lines(pages: DataFrame, keys: list[str], column: str, labels: dict[str, str]) -> DataFrame:
    """home_x and away_x of each label's statistic x, by position in the page's own lines: no shuffle."""
    lines = pages.withColumn("_l", F.split(column, "\n"))
    out = []
    for label, name in labels.items():
        at = F.array_position("_l", label)
        value = lambda i, at=at: F.when(at > 0, scraped_number(F.try_element_at("_l", F.when(at + i > 0, (at + i).cast("int")).otherwise(F.lit(10**6)))))
        out += [value(-1).alias(f"home_{name}"), value(1).alias(f"away_{name}")]
    return lines.select(*keys, *out)


def event_stats(events: DataFrame) -> DataFrame:
    """Counts of one actor's day and its share of all events of the day."""
    e = events.select("user_id", F.to_date("ts").alias("day"), "event_type", "value", (F.hour("ts") * 60 + F.minute("ts")).alias("m"))
    own = e.groupBy("user_id", "day").agg(
        F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.count_if(F.col("value") > 50).alias("on_target"), F.round(F.sum("value"), 4).alias("total_value"), F.count_if(F.col("m") <= 720).alias("early")
    )
    total = e.groupBy("day").agg(F.count("*").alias("total"))
    return own.join(total, "day").withColumn("share", F.round(F.col("n") / F.col("total"), 9)).drop("total")


def tag_stats(events: DataFrame, key: str, tags: dict[str, list[int]]) -> DataFrame:
    """Events of a key that carry one of the listed tag ids, by name."""

    def carries(ids: list[int]):
        return F.exists("tags", lambda t: t["id"].isin(ids))

    return events.groupBy(key).agg(*[F.count_if(carries(ids)).alias(name) for name, ids in tags.items()])
