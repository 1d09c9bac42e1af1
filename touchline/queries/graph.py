"""Graph and sequence operators, and models on pyspark.ml."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.bindings import frame
from touchline.operators import centrality as C
from touchline.operators import graph as G
from touchline.operators import models as L
from touchline.queries.markets import pred
from touchline.queries.quality import CANON, canon
from touchline.registry import query

EDGES = CANON + """, d AS (SELECT league, CASE WHEN hg > ag THEN home ELSE away END AS src, CASE WHEN hg > ag THEN away ELSE home END AS dst, abs(hg - ag) AS margin, match_date, ok, ln, pk, sk FROM canon WHERE hg <> ag),
 e AS (SELECT league, src, dst, CAST(sum(margin) AS BIGINT) AS weight, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY league, src, dst ORDER BY match_date DESC, ok DESC, ln DESC, pk DESC, sk DESC) AS r FROM d) WHERE r <= 20 GROUP BY ALL)"""


def edges(spark, sf_dir) -> DataFrame:
    return G.dominance(canon(spark, sf_dir))


@query("g04_dominance", EDGES + " SELECT * FROM e")
def g04(spark, sf_dir):
    return edges(spark, sf_dir)


@query("j14_triangles", EDGES + " SELECT DISTINCT a.league, a.src AS t1, b.src AS t2, c.src AS t3 FROM e a JOIN e b ON a.league = b.league AND a.dst = b.src JOIN e c ON b.league = c.league AND b.dst = c.src AND c.dst = a.src WHERE a.src < b.src AND a.src < c.src")
def j14(spark, sf_dir):
    return G.triangles(edges(spark, sf_dir))


@query("g06_giant_killers", EDGES + ", p AS (SELECT league, src AS team, sum(weight) AS w FROM e GROUP BY ALL) SELECT e.league, e.src AS team, CAST(sum(CASE WHEN q.w > p.w THEN e.n ELSE 0 END) AS BIGINT) AS upsets FROM e JOIN p ON p.league = e.league AND p.team = e.src LEFT JOIN p q ON q.league = e.league AND q.team = e.dst GROUP BY ALL")
def g06(spark, sf_dir):
    e = edges(spark, sf_dir)
    power = e.groupBy("league", "src").agg(F.sum("weight").alias("own"))
    met = e.join(power, ["league", "src"]).join(power.select("league", F.col("src").alias("dst"), F.col("own").alias("theirs")), ["league", "dst"], "left")
    return met.groupBy("league", F.col("src").alias("team")).agg(F.sum(F.when(F.col("theirs") > F.col("own"), F.col("n")).otherwise(0)).alias("upsets"))


#: 150 rounds leave changes below 1e-10, far under the seventh place.
_RANK = """, nodes AS (SELECT league, src AS node FROM e UNION SELECT league, dst FROM e), z AS (SELECT league, count(*) AS size FROM nodes GROUP BY 1), o AS (SELECT league, src, dst, weight / sum(weight) OVER (PARTITION BY league, src) AS share FROM e),
 g AS (SELECT n.league, n.node, size, src, share FROM nodes n JOIN z ON n.league = z.league LEFT JOIN o ON o.league = n.league AND o.dst = n.node),
 pr AS (SELECT n.league, n.node, 1e0 / size AS rank, 0 AS step FROM nodes n JOIN z ON n.league = z.league UNION ALL
 SELECT g.league, g.node, 0.15e0 / any_value(g.size) + 0.85e0 * coalesce(sum(p.rank * g.share), 0), any_value(s.step) + 1 FROM g LEFT JOIN pr p ON p.league = g.league AND p.node = g.src CROSS JOIN (SELECT max(step) AS step FROM pr) s WHERE s.step < 150 GROUP BY g.league, g.node)"""


@query("g07_pagerank", EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + _RANK + " SELECT league, node, round(rank, 7) AS rank FROM pr WHERE step = 150")
def g07(spark, sf_dir):
    return G.pagerank_converged(edges(spark, sf_dir), 1e-12).withColumn("rank", F.round("rank", 7))


@query("g07_pagerank_converged")
def g07_converged(spark, sf_dir):
    """``g07_pagerank`` with two more places and a wider limit."""
    return G.pagerank_converged(edges(spark, sf_dir)).withColumn("rank", F.round("rank", 9))


#: The test tables have no quality index: one derived from a key stands in for it.
INDEX, REFERENCE, SPLIT = "CASE WHEN pk % 10 = 3 THEN NULL ELSE 60 + pk % 41 END", "1998-08-01", 180


def decayed(spark, sf_dir) -> DataFrame:
    return C.decayed_graph(canon(spark, sf_dir), F.expr(INDEX), REFERENCE)


@query("g02_decayed_graph", CANON + f""", w AS (SELECT league, home, away, coalesce(({INDEX}) / 100e0, 1e0) * power(0.5e0, date_diff('day', match_date, DATE '{REFERENCE}') / 90e0) AS w
 FROM canon WHERE date_diff('day', match_date, DATE '{REFERENCE}') BETWEEN 0 AND 730) SELECT league, src, dst, round(sum(w), 6) AS weight FROM (SELECT league, home AS src, away AS dst, w FROM w UNION ALL SELECT league, away, home, w FROM w) GROUP BY ALL""")
def g02(spark, sf_dir):
    return decayed(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query("g03_centrality")
def g03(spark, sf_dir):
    """Leading eigenvector of each league's decayed graph; rounds until it stands still, so no SQL."""
    return C.eigen_centrality(decayed(spark, sf_dir)).withColumn("centrality", F.round("centrality", 6))


@query("g07_betweenness")
def g07_betweenness(spark, sf_dir):
    """Weighted betweenness of the dominance graph, its weights as distances; rounds until no path is left, so no SQL."""
    return C.betweenness(edges(spark, sf_dir)).withColumn("betweenness", F.round("betweenness", 9))


@query("g09_centrality_change")
def g09_change(spark, sf_dir):
    """Change of the mean centrality of each pair that ever met: the last half year's graph against the older one."""
    matches = canon(spark, sf_dir)
    age = F.datediff(F.lit(REFERENCE).cast("date"), "match_date")
    new = F.coalesce(age.between(0, SPLIT), F.lit(False))
    graph = lambda rows: C.eigen_centrality(C.decayed_graph(rows, F.expr(INDEX), REFERENCE))
    pairs = matches.select("league", F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"))
    found = C.centrality_change(pairs, graph(matches.filter(new)), graph(matches.filter(~new)))
    return found.select("league", "a", "b", *[(F.round(c, 6) + 0.0).alias(c) for c in ("recent", "before", "change")])


@query("a18_adjacency", CANON + """, x AS (SELECT league, home AS src, away AS dst, 1 + least(abs(hg - ag), 4) * 0.15e0 AS w FROM canon UNION ALL SELECT league, away, home, 1 + least(abs(hg - ag), 4) * 0.15e0 FROM canon UNION ALL SELECT DISTINCT league, home, home, 1e0 FROM canon),
 s AS (SELECT league, src, dst, sum(w) AS w FROM x GROUP BY ALL) SELECT league, src, dst, round(w / sum(w) OVER (PARTITION BY league, src), 7) AS weight FROM s""")
def a18(spark, sf_dir):
    from pyspark.sql import Window

    w = 1 + F.least(F.abs(F.col("hg") - F.col("ag")), F.lit(4)) * 0.15
    c = canon(spark, sf_dir)
    x = c.select("league", F.col("home").alias("src"), F.col("away").alias("dst"), w.alias("w")).union(c.select("league", "away", "home", w)).union(c.select("league", F.col("home").alias("src"), F.col("home").alias("dst"), F.lit(1.0)).distinct())
    s = x.groupBy("league", "src", "dst").agg(F.sum("w").alias("w"))
    return s.select("league", "src", "dst", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("league", "src")), 7).alias("weight"))


@query("g01_rating_replay")
def g01(spark, sf_dir):
    return G.replay_ratings(canon(spark, sf_dir))


@query("m01_isotonic")
def m01(spark, sf_dir):
    return L.isotonic(frame(spark, sf_dir, "scored"), "p", "y")


@query("m09_outcome_model")
def m09(spark, sf_dir):
    return L.outcome_model(pred(spark, sf_dir), ["p_h", "p_d", "p_a", "p_o25", "p_btts"])
