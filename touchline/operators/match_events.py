"""Match statistics of both sides from their events, one aggregation for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes up to and from which a goal is early or late, and pressing events of an intense match, by format.
EARLY, LATE, INTENSE_NESTED, INTENSE_TAGGED = 15, 75, 90, 600
#: Counted events, and the short names of their columns.
COUNTS = {"shot": "s", "on_target": "st", "foul": "f", "offside": "o", "corner": "c", "yellow": "y", "red": "r"}


def match_stats(events: DataFrame, key: list[str], intense: int = INTENSE_NESTED, advanced: bool = True) -> DataFrame:
    """One row for each match: counts of both sides (hs, as, hst, ast, ...), possession, expected goals, big chances, pressing, early and late goals.

    events: key, side and ball ('home', 'away' or null), minute, xg, and a boolean for each kind.  Events of neither side only count in
    ``total_events``; possession is counted over events of a side.  Shares without anything to divide by, and big chances that
    no side had, are null; so are expected goals and big chances of a format without them (``advanced`` false)."""
    own = lambda s: F.coalesce(F.col("side") == s, F.lit(False))
    n = lambda s, c: F.count_if(own(s) & F.coalesce(c, F.lit(False)))
    aggs = [F.count("*").alias("total_events"), F.count_if(F.col("goal") & F.col("side").isNotNull() & (F.col("minute") <= EARLY)).alias("early"), F.count_if(F.col("goal") & F.col("side").isNotNull() & (F.col("minute") >= LATE)).alias("late")]
    for s, p in (("home", "h"), ("away", "a")):
        aggs += [n(s, F.col(c)).alias(f"{p}{short}") for c, short in COUNTS.items()]
        aggs += [F.count_if(F.col("side").isNotNull() & (F.col("ball") == s)).alias(f"{p}ball"), F.coalesce(F.sum(F.when(own(s), F.col("xg"))), F.lit(0.0)).alias(f"{p}xg"), n(s, F.col("big_chance")).alias(f"{p}bc"), n(s, F.col("press")).alias(f"{p}press")]
    by = events.groupBy(*key).agg(*aggs)
    ball, press = F.col("hball") + F.col("aball"), F.col("hpress") + F.col("apress")
    share = lambda c: F.when(ball > 0, F.round(100.0 * F.col(c) / ball, 2))
    maybe = lambda c: F.nullif(F.col(c), F.lit(0)) if advanced else F.lit(None).cast("long")
    goals = lambda c: F.round(c, 3) if advanced else F.lit(None).cast("double")
    both = [f"{p}{short}" for short in COUNTS.values() for p in ("h", "a")]
    return by.select(
        *key, *both, share("hball").alias("hposs"), share("aball").alias("aposs"), goals("hxg").alias("hxg"), goals("axg").alias("axg"), maybe("hbc").alias("hbc"), maybe("abc").alias("abc"),
        "total_events", F.col("hpress").alias("home_press"), F.col("apress").alias("away_press"), F.when(press > 0, F.round(F.col("hpress") / press, 4)).alias("home_press_share"),
        (F.col("early") > 0).alias("early_goal"), (F.col("late") > 0).alias("late_goal"), (press >= intense).alias("intense"),
    )


def merge_features(json: Column, features: dict[str, Column], name: str = "event_learning") -> Column:
    """The JSON object with ``features`` set in its member ``name``; what isn't an object counts as an empty one.

    Values keep their JSON types; a feature replaces a member of the same name, everything else stays."""
    kind = "map<string, variant>"
    empty = F.from_json(F.lit("{}"), kind)
    whole = F.coalesce(F.from_json(json, kind), empty)
    held = F.try_element_at(whole, F.lit(name))
    part = F.coalesce(F.when(F.schema_of_variant(held).startswith("OBJECT"), held).try_cast(kind), empty)
    fresh = F.from_json(F.to_json(F.struct(*[v.alias(k) for k, v in features.items()]), {"ignoreNullFields": "false"}), kind)
    merged = F.map_concat(F.map_filter(part, lambda k, v: ~k.isin(*features)), fresh)
    rest = F.map_filter(whole, lambda k, v: k != name)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(name), F.parse_json(F.to_json(merged)))))


def known_map(columns: dict[str, Column]) -> Column:
    """A map of the columns that aren't null, as texts."""
    return F.map_filter(F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())


def known_json(columns: dict[str, Column]) -> Column:
    """A JSON object of the columns that aren't null; values keep their types."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in columns.items()]))
