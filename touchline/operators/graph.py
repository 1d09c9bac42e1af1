"""Match graphs: edges, triangles, centralities, and ratings replayed in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.durable import materialize
from touchline.operators.matches import TIE


def dominance(matches: DataFrame, top: int = 20) -> DataFrame:
    """Directed edges winner -> loser from the last ``top`` decided matches of each pair, with their goal margin."""
    won = F.col("hg") > F.col("ag")
    edges = matches.filter("hg <> ag").select("league", F.when(won, F.col("home")).otherwise(F.col("away")).alias("src"), F.when(won, F.col("away")).otherwise(F.col("home")).alias("dst"), F.abs(F.col("hg") - F.col("ag")).alias("margin"), "match_date", *TIE)
    w = Window.partitionBy("league", "src", "dst").orderBy(F.desc("match_date"), *[F.desc(c) for c in TIE])
    return edges.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).groupBy("league", "src", "dst").agg(F.sum("margin").alias("weight"), F.count("*").alias("n"))


def triangles(edges: DataFrame) -> DataFrame:
    """Distinct directed triangles a -> b -> c -> a, each once with its least team first."""
    e = edges.select("league", "src", "dst")
    a, b, c = (e.select("league", F.col("src").alias(x), F.col("dst").alias(y)) for x, y in (("t1", "t2"), ("t2", "t3"), ("t3", "t1")))
    met = a.filter("t1 < t2").join(b, ["league", "t2"]).filter("t1 < t3").join(c, ["league", "t3", "t1"])
    return met.select("league", "t1", "t2", "t3").distinct()


def pagerank(edges: DataFrame, steps: int = 10, damping: float = 0.85) -> DataFrame:
    """Weighted PageRank of each league's graph by joins; a node without out-edges spreads nothing."""
    nodes = edges.select("league", F.col("src").alias("node")).union(edges.select("league", "dst")).distinct()
    size = nodes.groupBy("league").agg(F.count("*").alias("size"))
    out = edges.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("league", "src"))).select("league", F.col("src").alias("node"), "dst", "share")
    rank = nodes.join(size, "league").withColumn("rank", 1.0 / F.col("size"))
    for _ in range(steps):
        flow = rank.join(out, ["league", "node"]).groupBy("league", F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        rank = nodes.join(size, "league").join(flow, ["league", "node"], "left").withColumn("rank", (1 - damping) / F.col("size") + damping * F.coalesce("flow", F.lit(0.0))).drop("flow")
    return rank.drop("size")


def pagerank_converged(edges: DataFrame, tolerance: float = 1e-10, damping: float = 0.85, every: int = 5) -> DataFrame:
    """``pagerank`` continued until no rank moves by more than ``tolerance`` in a round; ranks are written each few rounds.

    A round shrinks the changes by the damping at least, so it ends on any graph."""
    nodes = edges.select("league", F.col("src").alias("node")).union(edges.select("league", "dst")).distinct()
    size = nodes.groupBy("league").agg(F.count("*").alias("size"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("league", "src"))
    out = materialize(edges.select("league", F.col("src").alias("node"), "dst", share.alias("share")))
    sized = materialize(nodes.join(size, "league"))
    rank = sized.withColumn("rank", 1.0 / F.col("size"))
    while True:
        for _ in range(every):
            flow = rank.join(out, ["league", "node"]).groupBy("league", F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
            before = rank.select("league", "node", F.col("rank").alias("before"))
            new = (1 - damping) / F.col("size") + damping * F.coalesce("flow", F.lit(0.0))
            rank = sized.join(before, ["league", "node"]).join(flow, ["league", "node"], "left").select("league", "node", "size", new.alias("rank"), F.abs(new - F.col("before")).alias("moved"))
        rank = materialize(rank)
        if (rank.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            return rank.select("league", "node", "rank")
        rank = rank.drop("moved")


def replay_ratings(matches: DataFrame, rate: float = 0.035, carry: float = 0.7) -> DataFrame:
    """Home and away ratings of both teams before each match, updated match by match in a league's order.

    The expected goal difference is the home team's home rating less the away team's away rating; both move by ``rate``
    times the error, and their other ratings by ``carry`` of that.

    The fold couples two teams in every step, so a league is one sequence; it is streamed in sorted Arrow batches and
    only the ratings of its teams are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratings: dict[tuple[str, str], list[float]] = {}
        for batch in batches:
            before = np.zeros((len(batch), 2))
            for i, (league, home, away, hg, ag) in enumerate(zip(batch.league, batch.home, batch.away, batch.hg, batch.ag, strict=True)):
                h, a = ratings.setdefault((league, home), [0.0, 0.0]), ratings.setdefault((league, away), [0.0, 0.0])
                before[i] = h[0], a[1]
                step = rate * ((hg - ag) - (h[0] - a[1]))
                h[0], a[1] = h[0] + step, a[1] - step
                h[1], a[0] = h[1] + carry * step, a[0] - carry * step
            yield batch.assign(home_rating=before[:, 0], away_rating=before[:, 1])

    cols = ["league", "match_date", "home", "away", "hg", "ag", *TIE]
    ordered = matches.select(*cols).repartition("league").sortWithinPartitions("league", "match_date", "home", *TIE)
    return ordered.mapInPandas(run, "league string, match_date date, home string, away string, hg int, ag int, ok long, ln int, pk long, sk long, home_rating double, away_rating double")
