"""Motifs of the current dominance graph: topology, triangles, giant killers, multipliers, changes of strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.graph import triangles
from touchline.operators.matches import TIE


def topology(matches: DataFrame, index: Column, reference: str, days: int = 3650, half_life: int = 365, floor: float = 1200.0) -> DataFrame:
    """Directed edges both ways between two teams whose latest match has a decayed quality index above ``floor``.

    ``matches`` up to ``days`` before the reference day count, undated ones too (without decay); an unknown index is 1200.
    A pair is aggregated once, before its two directions are spread."""
    age = F.datediff(F.lit(reference).cast("date"), "match_date")
    decay = F.coalesce(F.pow(F.lit(0.5), age / half_life), F.lit(1.0))
    value = (F.coalesce(index.cast("double"), F.lit(1200.0)) * decay).alias("weight")
    pair = matches.filter(age.isNull() | age.between(0, days)).select("league", F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"), F.struct("match_date", *TIE).alias("at"), value)
    latest = pair.groupBy("league", "a", "b").agg(F.max_by("weight", "at").alias("weight")).filter(F.col("weight") > floor)
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return latest.select("league", F.explode(ways).alias("e"), "weight").select("league", "e.src", "e.dst", "weight")


def bogey_triangles(edges: DataFrame) -> DataFrame:
    """Sets of three teams on a directed cycle, each once in name order."""
    three = triangles(edges).select("league", F.array_sort(F.array("t1", "t2", "t3")).alias("t"))
    return three.select("league", *[F.col("t")[i].alias(f"t{i + 1}") for i in range(3)]).distinct()


def giant_kills(edges: DataFrame, base: float = 1250.0, full: float = 1250.0, half: float = 1200.0) -> DataFrame:
    """Kills of each team that has any: edges above ``base`` count 1 above ``full`` and a half above ``half``."""
    kill = F.when(F.col("weight") > max(base, full), 1.0).when((F.col("weight") > base) & (F.col("weight") > half), 0.5).otherwise(0.0)
    return edges.groupBy("league", F.col("src").alias("team")).agg(F.sum(kill).alias("kills")).filter("kills > 0")


def multipliers(fixtures: DataFrame, edges: DataFrame, kills: DataFrame, three: DataFrame) -> DataFrame:
    """Expected-goal multipliers mult_h and mult_a of each fixture.

    A giant killer (1.5 kills or more) gets 1.08 at home and 1.05 away; two teams of one triangle get 1.15 for the team
    with the edge and 0.85 for the other instead, the home team's edge first."""
    inside = [(x, y) for x in ("t1", "t2", "t3") for y in ("t1", "t2", "t3") if x != y]
    met = three.select("league", F.explode(F.array(*[F.struct(F.col(x).alias("home"), F.col(y).alias("away")) for x, y in inside])).alias("p")).select("league", "p.home", "p.away").distinct()
    killer = kills.filter("kills >= 1.5").select("league", "team")
    e = edges.select("league", "src", "dst").distinct()
    found = (
        fixtures.join(killer.select("league", F.col("team").alias("home"), F.lit(True).alias("_kh")), ["league", "home"], "left")
        .join(killer.select("league", F.col("team").alias("away"), F.lit(True).alias("_ka")), ["league", "away"], "left")
        .join(met.withColumn("_tri", F.lit(True)), ["league", "home", "away"], "left")
        .join(e.select("league", F.col("src").alias("home"), F.col("dst").alias("away"), F.lit(True).alias("_out")), ["league", "home", "away"], "left")
        .join(e.select("league", F.col("dst").alias("home"), F.col("src").alias("away"), F.lit(True).alias("_in")), ["league", "home", "away"], "left")
    )
    has = lambda c: F.coalesce(c, F.lit(False))
    out, back = has(F.col("_tri") & F.col("_out")), has(F.col("_tri") & F.col("_in"))
    mult_h = F.when(out, 1.15).when(back, 0.85).when(has(F.col("_kh")), 1.08).otherwise(1.0)
    mult_a = F.when(out, 0.85).when(back, 1.15).when(has(F.col("_ka")), 1.05).otherwise(1.0)
    return found.select(*fixtures.columns, mult_h.alias("mult_h"), mult_a.alias("mult_a"))


def strength_change(edges: DataFrame) -> DataFrame:
    """Each team's share of its league's weight in edges marked recent, less its share in the others (0 if absent)."""
    part = lambda flag: F.sum(F.when(F.col("recent") == flag, F.col("weight")).otherwise(0))
    team = edges.groupBy("league", F.col("src").alias("team")).agg(part(True).alias("now"), part(False).alias("before"))
    total = edges.groupBy("league").agg(part(True).alias("all_now"), part(False).alias("all_before"))
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return team.join(total, "league").select("league", "team", (share(F.col("now"), F.col("all_now")) - share(F.col("before"), F.col("all_before"))).alias("change"))
