"""Graph measures by rounds of joins: decayed match graphs, leading eigenvectors, and weighted betweenness.

No step collects a graph: a round is an equi-join of a state table with the edges and one partial aggregation, written to
the shared folder, and the driver only reads whether the rounds may stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.durable import Materialized, materialize


def decayed_graph(matches: DataFrame, index: Column, reference: str, half_life: float = 90.0, days: int = 730) -> DataFrame:
    """Undirected graph of each league, both directions of each pair: league, src, dst, weight.

    A match weighs index / 100 (1 if unknown), halved every ``half_life`` days; undated ones keep their full weight.
    Matches up to ``days`` before the reference day count, later ones don't.  Pairs are summed before they are spread."""
    age = F.datediff(F.lit(reference).cast("date"), "match_date")
    weight = F.coalesce(index.cast("double") / 100.0, F.lit(1.0)) * F.coalesce(F.pow(F.lit(0.5), age / half_life), F.lit(1.0))
    seen = matches.filter(age.isNull() | age.between(0, days))
    pair = seen.groupBy("league", F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b")).agg(F.sum(weight).alias("weight"))
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    spread = pair.select("league", F.explode(ways).alias("e"), "weight").select("league", "e.src", "e.dst", "weight")
    return spread.groupBy("league", "src", "dst").agg(F.sum("weight").alias("weight"))  # a team against itself counts twice


def eigen_centrality(edges: DataFrame, tolerance: float = 1e-9, every: int = 4, most: int = 250) -> DataFrame:
    """league, node, centrality: the leading eigenvector of each league's symmetric weights, scaled to a greatest entry of 1.

    Power iteration from ones, on the matrix plus half its mean row sum on the diagonal, so that a graph in two halves doesn't
    swing.  A written round has ``every`` multiplications; it is the last one when in every league the residual
    ``|A x - lambda x| / (lambda |x|)`` (greatest entries) is at most ``tolerance``.  In a league of several parts, those of a smaller
    eigenvalue go to 0.  A league that has not settled after ``most`` written rounds gets ones."""
    held = Materialized(edges.select("league", "src", "dst", "weight"))
    e = held.read()
    size = e.groupBy("league").agg((F.sum("weight") / F.countDistinct("src") / 2.0).alias("shift"))
    own = e.select("league", F.col("src").alias("node")).distinct().join(size, "league")
    loops = own.select("league", F.col("node").alias("src"), F.col("node").alias("dst"), F.col("shift").alias("weight"))
    shifted = Materialized(e.unionByName(loops).groupBy("league", F.col("src").alias("node"), "dst").agg(F.sum("weight").alias("weight")))
    state = Materialized(own.select("league", "node", F.lit(1.0).alias("y")))
    held.drop()

    def times(x: DataFrame) -> DataFrame:
        return x.join(shifted.read(), ["league", "node"]).groupBy("league", F.col("dst").alias("node")).agg(F.sum(F.col("y") * F.col("weight")).alias("y"))

    for turn in range(most):
        now = state.read()
        x = now.join(now.groupBy("league").agg(F.max("y").alias("top")), "league").select("league", "node", (F.col("y") / F.col("top")).alias("y"))
        for _ in range(every - 1):
            x = times(x)
        x = materialize(x)
        pair = x.withColumnRenamed("y", "x").join(times(x), ["league", "node"])
        following = Materialized(pair)
        state.drop()
        state = following
        seen = state.read()
        fit = seen.groupBy("league").agg((F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("value"), F.max("x").alias("top"))
        off = F.abs(F.col("y") - F.col("value") * F.col("x")) / (F.col("value") * F.col("top"))
        worst = seen.join(fit, "league").groupBy("league").agg(F.max(off).alias("off"), F.max("y").alias("most"))
        if not worst.filter(F.col("off") > tolerance).limit(1).count() or turn == most - 1:
            settled = F.col("off") <= tolerance
            return seen.join(worst, "league").select("league", "node", F.when(settled, F.col("y") / F.col("most")).otherwise(1.0).alias("centrality"))
    raise ValueError("most must be positive")


def centrality_change(pairs: DataFrame, recent: DataFrame, before: DataFrame, unknown: float = 0.5) -> DataFrame:
    """league, a, b, recent, before, change of each pair: the mean centrality of both teams in two graphs.  A team that a graph lacks has ``unknown``."""
    table = recent.select("league", "node", F.col("centrality").alias("now")).join(before.select("league", "node", F.col("centrality").alias("then")), ["league", "node"], "full")
    side = lambda c: table.select("league", F.col("node").alias(c), F.coalesce("now", F.lit(unknown)).alias(f"now_{c}"), F.coalesce("then", F.lit(unknown)).alias(f"then_{c}"))
    met = pairs.select("league", "a", "b").distinct().join(side("a"), ["league", "a"], "left").join(side("b"), ["league", "b"], "left")
    mean = lambda t: sum(F.coalesce(f"{t}_{c}", F.lit(unknown)) for c in ("a", "b")) / 2.0
    return met.select("league", "a", "b", mean("now").alias("recent"), mean("then").alias("before"), (mean("now") - mean("then")).alias("change"))


def _distances(edges: DataFrame, nodes: DataFrame) -> Materialized:
    """league, source, node, d: lengths of shortest paths between all nodes, from all sources at once.

    A round extends the paths that got shorter in the round before; it ends when none did."""
    state = Materialized(nodes.select("league", F.col("node").alias("source"), "node", F.lit(0.0).alias("d"), F.lit(None).cast("double").alias("old")))
    while True:
        now = state.read()
        frontier = now.filter("old is null or d < old")
        longer = frontier.join(edges, ["league", "node"]).select("league", "source", F.col("dst").alias("node"), (F.col("d") + F.col("weight")).alias("d"), F.lit(None).cast("double").alias("old"))
        both = now.select("league", "source", "node", "d", F.col("d").alias("old")).unionByName(longer)
        following = Materialized(both.groupBy("league", "source", "node").agg(F.min("d").alias("d"), F.min("old").alias("old")))
        state.drop()
        state = following
        if not state.read().filter("old is null or d < old").limit(1).count():
            return state


def _series(first: DataFrame, value: str, links: DataFrame, start: str, end: str) -> Materialized:
    """Sum of ``value`` over all walks along ``links`` from the rows of ``first``, the walk of no step included.

    Steps go from ``start`` to ``end`` of a link; the links have no cycle, so the walks end."""
    total, frontier = Materialized(first), Materialized(first)
    while True:
        walked = frontier.read().withColumnRenamed("node", start).join(links, ["league", "source", start])
        following = Materialized(walked.groupBy("league", "source", F.col(end).alias("node")).agg(F.sum(value).alias(value)))
        frontier.drop()
        frontier = following
        if not frontier.read().limit(1).count():
            frontier.drop()
            return total
        summed = Materialized(total.read().unionByName(frontier.read()).groupBy("league", "source", "node").agg(F.sum(value).alias(value)))
        total.drop()
        total = summed


def betweenness(edges: DataFrame, normalised: bool = True) -> DataFrame:
    """league, node, betweenness of directed edges (league, src, dst, weight), weights as distances.

    Of all shortest paths between two other nodes, the share that passes the node; divided by (n - 1)(n - 2) if
    ``normalised`` and n > 2.  Ties of length count as paths of their own.  Parallel edges count as their shortest one;
    weights must be positive.  Nodes that no path passes have 0; a table without edges gives no rows.

    Distances first, then the edges that lie on shortest paths from each source.  Path counts are a sum over walks from the
    source, dependencies one over walks back: with x(v) = 1 / paths(v) + the sum of x over v's followers, the
    dependency of the source on v is paths(v) x(v) - 1.  Each is a series of joins with as many rounds as the longest
    shortest path has edges; states are keyed by (league, source, node), so no group grows with the graph."""
    held = Materialized(edges.filter("src <> dst").groupBy("league", F.col("src").alias("node"), "dst").agg(F.min("weight").cast("double").alias("weight")))
    e = held.read()
    if e.filter("weight <= 0 or weight is null").limit(1).count():
        raise ValueError("distances must be positive")
    nodes = materialize(e.select("league", "node").union(e.select("league", "dst")).distinct())
    away = _distances(e, nodes)
    d = away.read().select("league", "source", "node", "d")
    onward = d.join(e, ["league", "node"]).withColumnRenamed("node", "u").withColumnRenamed("d", "du")
    reached = d.withColumnRenamed("node", "v").withColumnRenamed("d", "dv")
    on_path = onward.withColumnRenamed("dst", "v").join(reached, ["league", "source", "v"]).filter(F.col("dv") == F.col("du") + F.col("weight"))
    links = Materialized(on_path.select("league", "source", "u", "v"))
    paths = _series(d.filter("node = source").select("league", "source", "node", F.lit(1.0).alias("paths")), "paths", links.read(), "u", "v")
    shares = _series(paths.read().select("league", "source", "node", (1.0 / F.col("paths")).alias("x")), "x", links.read(), "v", "u")
    part = paths.read().join(shares.read(), ["league", "source", "node"]).filter("node <> source")
    passed = part.groupBy("league", "node").agg(F.sum(F.col("paths") * F.col("x") - 1.0).alias("passed"))
    size = nodes.groupBy("league").agg(F.count("*").cast("double").alias("n"))
    scale = F.when(F.lit(normalised) & (F.col("n") > 2), (F.col("n") - 1.0) * (F.col("n") - 2.0)).otherwise(1.0)
    found = nodes.join(size, "league").join(passed, ["league", "node"], "left")
    out = materialize(found.select("league", "node", (F.coalesce("passed", F.lit(0.0)) / scale).alias("betweenness")))
    for table in (held, away, links, paths, shares):
        table.drop()
    return out


def graph_report(centrality: DataFrame, triangles: DataFrame, kills: DataFrame, top: int = 10) -> DataFrame:
    """What a graph snapshot holds: league, kind, place, team, value.

    Of each league the ``top`` teams by centrality, the number of its triangles (no team), and its giant killers by kills.
    Teams are ranked inside their league, so a group is a league's teams."""
    ranked = lambda df, kind, value: df.select("league", F.lit(kind).alias("kind"), F.row_number().over(Window.partitionBy("league").orderBy(F.desc(value), "team")).alias("place"), "team", F.col(value).cast("double").alias("value"))
    best = ranked(centrality.withColumnRenamed("node", "team"), "centrality", "centrality").filter(F.col("place") <= top)
    count = triangles.groupBy("league").agg(F.count("*").cast("double").alias("value")).select("league", F.lit("triangles").alias("kind"), F.lit(1).alias("place"), F.lit(None).cast("string").alias("team"), "value")
    return best.unionByName(count).unionByName(ranked(kills, "killer", "kills"))
