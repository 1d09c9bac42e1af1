"""Motif queries over the current dominance graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import centrality as C
from touchline.operators import matches as M
from touchline.operators import motifs as G
from touchline.queries.graph import EDGES, decayed, edges
from touchline.queries.quality import CANON, canon
from touchline.registry import query

#: The test tables have no quality index: one derived from a key stands in for it.
INDEX, REFERENCE = "1000 + (pk % 97) * 10", "2001-11-10"
TOPOLOGY = CANON + f""", tw AS (SELECT league, least(home, away) AS a, greatest(home, away) AS b, ({INDEX}) * power(0.5e0, date_diff('day', match_date, DATE '{REFERENCE}') / 365e0) AS weight, row_number() OVER (PARTITION BY league, least(home, away), greatest(home, away) ORDER BY match_date DESC, ok DESC, ln DESC, pk DESC, sk DESC) AS r
 FROM canon WHERE date_diff('day', match_date, DATE '{REFERENCE}') BETWEEN 0 AND 3650), lp AS (SELECT league, a, b, weight FROM tw WHERE r = 1 AND weight > 1200),
 e AS (SELECT league, a AS src, b AS dst, weight FROM lp UNION ALL SELECT league, b, a, weight FROM lp)"""
TRIANGLES = TOPOLOGY + """, tri AS (SELECT DISTINCT league, t[1] AS t1, t[2] AS t2, t[3] AS t3 FROM (SELECT x.league, list_sort([x.src, y.src, z.src]) AS t FROM e x JOIN e y ON x.league = y.league AND x.dst = y.src JOIN e z ON y.league = z.league AND y.dst = z.src AND z.dst = x.src))"""
KILLS = ", kl AS (SELECT league, src AS team, sum(CASE WHEN weight > 1250 THEN 1e0 ELSE 0e0 END) AS kills FROM e GROUP BY ALL HAVING sum(CASE WHEN weight > 1250 THEN 1 ELSE 0 END) > 0)"


def current(spark, sf_dir):
    return G.topology(canon(spark, sf_dir), F.expr(INDEX), REFERENCE)


@query("g04_topology", TOPOLOGY + " SELECT league, src, dst, round(weight, 6) AS weight FROM e")
def g04(spark, sf_dir):
    return current(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query("g05_bogey_triangles", TRIANGLES + " SELECT * FROM tri")
def g05(spark, sf_dir):
    return G.bogey_triangles(current(spark, sf_dir))


@query("g06_giant_kills", TOPOLOGY + KILLS + " SELECT league, team, kills FROM kl")
def g06(spark, sf_dir):
    return G.giant_kills(current(spark, sf_dir))


@query("g08_motif_multipliers", TRIANGLES + KILLS + """, fl AS (SELECT c.league, c.match_date, c.home, c.away, c.ok, c.ln, c.pk, c.sk,
 EXISTS (SELECT 1 FROM tri t WHERE t.league = c.league AND c.home IN (t.t1, t.t2, t.t3) AND c.away IN (t.t1, t.t2, t.t3) AND c.home <> c.away) AS tr, EXISTS (SELECT 1 FROM e WHERE e.league = c.league AND e.src = c.home AND e.dst = c.away) AS o,
 EXISTS (SELECT 1 FROM e WHERE e.league = c.league AND e.src = c.away AND e.dst = c.home) AS i, EXISTS (SELECT 1 FROM kl WHERE kl.league = c.league AND kl.team = c.home AND kills >= 1.5) AS kh, EXISTS (SELECT 1 FROM kl WHERE kl.league = c.league AND kl.team = c.away AND kills >= 1.5) AS ka FROM canon c)
 SELECT league, match_date, home, away, ok, ln, pk, sk, CAST(CASE WHEN tr AND o THEN 1.15 WHEN tr AND i THEN 0.85 WHEN kh THEN 1.08 ELSE 1.0 END AS DOUBLE) AS mult_h, CAST(CASE WHEN tr AND o THEN 0.85 WHEN tr AND i THEN 1.15 WHEN ka THEN 1.05 ELSE 1.0 END AS DOUBLE) AS mult_a FROM fl""")
def g08(spark, sf_dir):
    e = current(spark, sf_dir)
    fixtures = canon(spark, sf_dir).select("league", "match_date", "home", "away", *M.TIE)
    return G.multipliers(fixtures, e, G.giant_kills(e), G.bogey_triangles(e))


_CUT = "2000-01-01"


@query("g09_strength_change", CANON + f""", d AS (SELECT league, CASE WHEN hg > ag THEN home ELSE away END AS src, abs(hg - ag) AS weight, match_date >= DATE '{_CUT}' AS recent FROM canon WHERE hg <> ag),
 t AS (SELECT league, src AS team, coalesce(sum(weight) FILTER (WHERE recent), 0) AS now, coalesce(sum(weight) FILTER (WHERE NOT recent), 0) AS before FROM d GROUP BY ALL)
 SELECT league, team, round(coalesce(now / nullif(sum(now) OVER l, 0), 0e0) - coalesce(before / nullif(sum(before) OVER l, 0), 0e0), 9) AS change FROM t WINDOW l AS (PARTITION BY league)""")
def g09(spark, sf_dir):
    won = F.when(F.col("hg") > F.col("ag"), F.col("home")).otherwise(F.col("away"))
    decided = canon(spark, sf_dir).filter("hg <> ag").select("league", won.alias("src"), F.abs(F.col("hg") - F.col("ag")).alias("weight"), (F.col("match_date") >= F.lit(_CUT).cast("date")).alias("recent"))
    return G.strength_change(decided).withColumn("change", F.round("change", 9))


@query("t06_top_strength", EDGES + ", s AS (SELECT league, src AS team, CAST(sum(weight) AS BIGINT) AS strength FROM e GROUP BY ALL) SELECT league, team, strength, CAST(row_number() OVER (PARTITION BY league ORDER BY strength DESC, team) AS INT) AS place FROM s QUALIFY place <= 10")
def t06(spark, sf_dir):
    """The ten strongest teams of each league; teams are aggregated before the ranking, so a group is a league's teams."""
    s = edges(spark, sf_dir).groupBy("league", F.col("src").alias("team")).agg(F.sum("weight").alias("strength"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("league").orderBy(F.desc("strength"), "team"))).filter("place <= 10")


@query("g10_graph_snapshot")
def g10(spark, sf_dir):
    """What a versioned graph snapshot holds; the centralities are iterated, so no SQL."""
    e = current(spark, sf_dir)
    found = C.graph_report(C.eigen_centrality(decayed(spark, sf_dir)), G.bogey_triangles(e), G.giant_kills(e))
    return found.withColumn("value", F.round("value", 6))
