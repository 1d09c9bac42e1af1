"""Standings and leakage-free features: every value uses earlier rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.bindings import ctes
from touchline.functions.prob import clip, decay
from touchline.operators import matches as M
from touchline.operators import temporal as T
from touchline.queries.quality import CANON, SIDES, canon, contests
from touchline.registry import query

ORD = "match_date, ok, ln, pk, sk"
TABLE = SIDES + """, tab AS (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY points DESC, gd DESC, gf DESC, team) AS position, count(*) OVER (PARTITION BY league, season) AS teams_count FROM
 (SELECT league, season, team, count(*) AS played, sum(pts) AS points, sum(gf) AS gf, sum(ga) AS ga, sum(gf - ga) AS gd, sum(CASE WHEN res = 'W' THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN res = 'D' THEN 1 ELSE 0 END) AS draws,
 sum(CASE WHEN res = 'L' THEN 1 ELSE 0 END) AS losses FROM sides GROUP BY league, season, team))"""


def rules(spark) -> DataFrame:
    return spark.createDataFrame(M.LEAGUE_RULES, "league string, season_games int, slots int")


@query("a13_standings", TABLE + """, p AS (SELECT *, least(3, greatest(0, teams_count - 1)) AS slots, greatest(1, teams_count - least(3, greatest(0, teams_count - 1))) AS safe_pos FROM tab),
 x AS (SELECT *, max(CASE WHEN position = safe_pos THEN points END) OVER w AS safe_points, max(CASE WHEN position = least(teams_count, safe_pos + 1) THEN points END) OVER w AS drop_points, max(CASE WHEN position = 1 THEN points END) OVER w AS lead_points,
 greatest(0, 38 - played) AS games_left, least(1e0, greatest(0e0, (played / 38.0e0 - 0.55e0) / 0.35e0)) AS late, slots > 0 AND position > safe_pos AS zone FROM p WINDOW w AS (PARTITION BY league, season)),
 y AS (SELECT *, greatest(0, points - drop_points) AS above, CASE WHEN zone THEN 1e0 ELSE least(1e0, greatest(0e0, (7e0 - greatest(0, points - drop_points)) / 7e0)) END AS danger FROM x),
 z AS (SELECT *, CASE WHEN zone AND games_left <= 3 THEN greatest(0.85e0, least(1e0, danger * (0.35e0 + 0.65e0 * late))) ELSE least(1e0, danger * (0.35e0 + 0.65e0 * late)) END AS rp,
 CASE WHEN position <= 4 THEN least(1e0, greatest(0e0, (5e0 - greatest(0, lead_points - points)) / 5e0)) * (0.25e0 + 0.75e0 * late) ELSE 0e0 END AS tp FROM y)
 SELECT league, season, team, CAST(position AS INT) AS position, CAST(teams_count AS BIGINT) AS teams_count, CAST(played AS BIGINT) AS played, CAST(points AS BIGINT) AS points, CAST(gf AS BIGINT) AS gf, CAST(ga AS BIGINT) AS ga, CAST(gd AS BIGINT) AS gd,
 CAST(wins AS BIGINT) AS wins, CAST(draws AS BIGINT) AS draws, CAST(losses AS BIGINT) AS losses, CAST(games_left AS BIGINT) AS games_left, round(late, 6) AS late, zone AS relegation_zone, round(1e0 - (position - 1) / greatest(1, teams_count - 1), 6) AS rank_strength,
 CAST(CASE WHEN zone THEN greatest(0, safe_points - points + 1) END AS BIGINT) AS points_to_safety, CAST(CASE WHEN NOT zone THEN above END AS BIGINT) AS points_above_drop, round(rp, 6) AS relegation_pressure, round(tp, 6) AS top_pressure,
 rp >= 0.72e0 AND games_left <= 3 AS must_win, CASE WHEN rp >= 0.72e0 AND games_left <= 3 THEN 'Survival must-win' WHEN rp >= 0.65e0 THEN 'High survival pressure' WHEN rp >= 0.35e0 THEN 'Relegation pressure' WHEN tp >= 0.45e0 THEN 'Top-table pressure' ELSE 'Normal table context' END AS label FROM z""")
def a13(spark, sf_dir):
    out = M.table_pressure(M.standings(canon(spark, sf_dir)), rules(spark))
    rounded = {c: F.round(c, 6) for c in ("late", "rank_strength", "relegation_pressure", "top_pressure")}
    return out.withColumns(rounded | {c: F.col(c).cast("bigint") for c in ("games_left", "points_to_safety", "points_above_drop")}).drop("lead_points")


@query("w05_rest_days", SIDES + f""" SELECT league, team, match_date, ok, ln, pk, sk, at_home, round(coalesce(least(1e0, date_diff('day', lag(match_date) OVER (PARTITION BY league, team ORDER BY {ORD}, at_home), match_date) / 7e0), 0.43e0), 6) AS rest FROM sides""")
def w05(spark, sf_dir):
    s = M.sides(canon(spark, sf_dir))
    days = F.datediff("match_date", F.lag("match_date").over(T.by_team()))
    return s.select("league", "team", "match_date", *M.TIE, "at_home", F.round(F.coalesce(F.least(F.lit(1.0), days / 7.0), F.lit(0.43)), 6).alias("rest"))


@query("w07_form", SIDES + f""" SELECT league, team, match_date, ok, ln, pk, sk, at_home, round(coalesce(sum(pts) OVER w / 15e0, 0.5e0), 6) AS form_last5 FROM sides WINDOW w AS (PARTITION BY league, team ORDER BY {ORD}, at_home ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def w07(spark, sf_dir):
    w = T.by_team().rowsBetween(-5, -1)
    form = F.coalesce(F.sum("pts").over(w) / 15.0, F.lit(0.5))  # of the 15 points of five wins, however many matches there are
    return M.sides(canon(spark, sf_dir)).select("league", "team", "match_date", *M.TIE, "at_home", F.round(form, 6).alias("form_last5"))


@query("w08_streak", SIDES + f""", o AS (SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY {ORD}, at_home) AS i FROM sides),
 g AS (SELECT *, sum(CASE WHEN res = p THEN 0 ELSE 1 END) OVER (PARTITION BY league, team ORDER BY i) AS grp FROM (SELECT *, coalesce(lag(res) OVER (PARTITION BY league, team ORDER BY i), '-') AS p FROM o)),
 r AS (SELECT *, row_number() OVER (PARTITION BY league, team, grp ORDER BY i) AS len FROM g)
 SELECT league, team, match_date, ok, ln, pk, sk, at_home, CAST(coalesce(lag(CASE res WHEN 'W' THEN least(5, len) WHEN 'L' THEN -least(5, len) ELSE 0 END) OVER (PARTITION BY league, team ORDER BY i), 0) AS INT) AS streak FROM r""")
def w08(spark, sf_dir):
    return T.streaks(M.sides(canon(spark, sf_dir))).select("league", "team", "match_date", *M.TIE, "at_home", "streak")


@query("w09_head_to_head", CANON + f""", h AS (SELECT *, CASE WHEN home < away THEN home ELSE away END AS t1, CASE WHEN home < away THEN away ELSE home END AS t2, CASE WHEN hg > ag THEN home WHEN hg < ag THEN away ELSE '' END AS winner FROM canon)
 SELECT league, match_date, home, away, CAST(count(*) OVER w AS BIGINT) AS met, round(coalesce(avg(CASE WHEN hg = ag THEN 1e0 ELSE 0e0 END) OVER w, 1/3e0), 6) AS draw_rate, round(coalesce(avg(hg + ag) OVER w, 2.5e0), 6) AS goals,
 round(coalesce(CASE WHEN home = t1 THEN avg(CASE WHEN winner = t1 THEN 1e0 ELSE 0e0 END) OVER w ELSE avg(CASE WHEN winner = t2 THEN 1e0 ELSE 0e0 END) OVER w END, 1/3e0), 6) AS home_rate,
 round(coalesce(CASE WHEN home = t1 THEN avg(CASE WHEN winner = t2 THEN 1e0 ELSE 0e0 END) OVER w ELSE avg(CASE WHEN winner = t1 THEN 1e0 ELSE 0e0 END) OVER w END, 1/3e0), 6) AS away_rate FROM h WINDOW w AS (PARTITION BY league, t1, t2 ORDER BY {ORD} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def w09(spark, sf_dir):
    w = Window.partitionBy("league", F.array_sort(F.array("home", "away"))).orderBy("match_date", *M.TIE).rowsBetween(-10, -1)
    rate = lambda c, d: F.round(F.coalesce(F.avg(c).over(w), F.lit(d)), 6)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    winner = F.when(F.col("hg") > F.col("ag"), F.col("home")).when(F.col("hg") < F.col("ag"), F.col("away")).otherwise("")
    first, second = F.avg(one(winner == F.least("home", "away"))).over(w), F.avg(one(winner == F.greatest("home", "away"))).over(w)
    own = F.col("home") < F.col("away")
    won = lambda a, b, n: F.round(F.coalesce(F.when(own, a).otherwise(b), F.lit(1 / 3)), 6).alias(n)
    return canon(spark, sf_dir).select("league", "match_date", "home", "away", F.count("*").over(w).alias("met"), rate(one(F.col("hg") == F.col("ag")), 1 / 3).alias("draw_rate"), rate(F.col("hg") + F.col("ag"), 2.5).alias("goals"), won(first, second, "home_rate"), won(second, first, "away_rate"))


@query("w10_congestion", SIDES + " SELECT league, team, match_date, ok, ln, pk, sk, at_home, CAST(count(*) OVER (PARTITION BY league, team ORDER BY match_date RANGE BETWEEN INTERVAL 21 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS BIGINT) AS last21 FROM sides")
def w10(spark, sf_dir):
    w = Window.partitionBy("league", "team").orderBy(F.unix_date("match_date")).rangeBetween(-21, -1)
    return M.sides(canon(spark, sf_dir)).select("league", "team", "match_date", *M.TIE, "at_home", F.count("*").over(w).alias("last21"))


@query("w06_last20", SIDES + f""" SELECT league, team, match_date, ok, ln, pk, sk, at_home, lpad(coalesce(string_agg(res, '') OVER (PARTITION BY league, team ORDER BY {ORD}, at_home ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), ''), 20, '-') AS history FROM sides""")
def w06(spark, sf_dir):
    got = F.array_join(F.collect_list("res").over(T.by_team().rowsBetween(-20, -1)), "")
    return M.sides(canon(spark, sf_dir)).select("league", "team", "match_date", *M.TIE, "at_home", F.lpad(got, 20, "-").alias("history"))


@query("w11_running_standings", SIDES + """, d AS (SELECT league, season, match_date, team, sum(pts) AS pts, sum(gf - ga) AS gd, sum(gf) AS gf FROM sides GROUP BY ALL),
 days AS (SELECT DISTINCT league, season, match_date FROM d), t AS (SELECT y.league, y.season, y.match_date, d.team, sum(d.pts) AS points, sum(d.gd) AS gd, sum(d.gf) AS gf FROM days y JOIN d ON d.league = y.league AND d.season = y.season AND d.match_date < y.match_date GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY league, season, match_date ORDER BY points DESC, gd DESC, gf DESC, team) AS position, count(*) OVER (PARTITION BY league, season, match_date) AS n FROM t)
 SELECT s.league, s.season, s.match_date, s.team, CAST(r.points AS BIGINT) AS points_before, CAST(r.position AS INT) AS position_before, CAST(r.n AS BIGINT) AS teams_before FROM (SELECT DISTINCT league, season, match_date, team FROM sides) s
 LEFT JOIN r ON r.league = s.league AND r.season = s.season AND r.match_date = s.match_date AND r.team = s.team""")
def w11(spark, sf_dir):
    return T.running_standings(M.sides(canon(spark, sf_dir)))


@query("w14_momentum", SIDES + f""", o AS (SELECT league, team, res, pts, xg - xga AS d, row_number() OVER (PARTITION BY league, team ORDER BY match_date DESC, ok DESC, ln DESC, pk DESC, sk DESC, at_home DESC) AS back FROM sides),
 k AS (SELECT *, count(*) OVER (PARTITION BY league, team) AS n FROM o WHERE back <= 5), w AS (SELECT *, CASE WHEN n = 1 THEN 0.5e0 ELSE 0.5e0 + 0.5e0 * (n - back) / (n - 1) END AS wt FROM k)
 SELECT league, team, round(0.8e0 + (sum(pts * wt) / sum(wt) / 3e0) * 0.4e0 + least(0.1e0, greatest(-0.1e0, sum(d * wt) / sum(wt) * 0.05e0)), 6) AS momentum FROM w GROUP BY league, team""")
def w14(spark, sf_dir):
    return T.momentum(M.sides(canon(spark, sf_dir)), 5).withColumn("momentum", F.round("momentum", 6))


@query("w15_split", CANON + f", s AS (SELECT league, row_number() OVER (PARTITION BY league ORDER BY {ORD}) <= floor(count(*) OVER (PARTITION BY league) * 0.8e0) AS train, match_date FROM canon) SELECT league, train, CAST(count(*) AS BIGINT) AS n, min(match_date) AS first_day, max(match_date) AS last_day FROM s GROUP BY ALL")
def w15(spark, sf_dir):
    return T.chronological_split(canon(spark, sf_dir), 0.8).groupBy("league", "train").agg(F.count("*").alias("n"), F.min("match_date").alias("first_day"), F.max("match_date").alias("last_day"))


@query("w16_walk_forward", CANON + """, y AS (SELECT league, year(match_date) AS yr, count(*) AS n FROM canon GROUP BY ALL), f AS (SELECT a.league, a.yr AS test_year, a.n AS test_rows, sum(b.n) AS train_rows FROM y a JOIN y b ON a.league = b.league AND b.yr < a.yr GROUP BY ALL)
 SELECT league, CAST(test_year AS INT) AS test_year, CAST(test_rows AS BIGINT) AS test_rows, CAST(train_rows AS BIGINT) AS train_rows FROM f WHERE train_rows >= 500 AND test_rows >= 80""")
def w16(spark, sf_dir):
    years = canon(spark, sf_dir).groupBy("league", F.year("match_date").alias("test_year")).agg(F.count("*").alias("test_rows"))
    before = Window.partitionBy("league").orderBy("test_year").rowsBetween(Window.unboundedPreceding, -1)
    return years.withColumn("train_rows", F.sum("test_rows").over(before)).filter("train_rows >= 500 and test_rows >= 80")


@query("w17_recency_weight", CANON + " SELECT league, match_date, home, away, round(least(3e0, greatest(0.1e0, exp(-date_diff('day', match_date, max(match_date) OVER (PARTITION BY league)) / 730e0) * greatest(0.25e0, coalesce(conf, 0.9e0)))), 9) AS weight FROM canon")
def w17(spark, sf_dir):
    c = canon(spark, sf_dir)
    newest = c.groupBy("league").agg(F.max("match_date").alias("newest"))  # joined back, so that no league is sorted in one task
    weight = clip(F.exp(-F.datediff("newest", "match_date") / 730.0) * F.greatest(F.lit(0.25), F.coalesce("conf", F.lit(0.9))), 0.1, 3.0)
    return c.join(newest, "league").select("league", "match_date", "home", "away", F.round(weight, 9).alias("weight"))


@query("a25_rolling_tail", SIDES + """, o AS (SELECT *, row_number() OVER (PARTITION BY league, team, at_home ORDER BY match_date DESC, ok DESC, ln DESC, pk DESC, sk DESC) AS back FROM sides)
 SELECT league, team, at_home, round(avg(gf), 6) AS gf5, round(avg(ga), 6) AS ga5, CAST(sum(CASE WHEN back <= 3 THEN pts ELSE 0 END) AS BIGINT) AS pts3, round(avg(CASE WHEN ga = 0 THEN 1e0 ELSE 0e0 END), 6) AS clean FROM o WHERE back <= 5 GROUP BY league, team, at_home""")
def a25(spark, sf_dir):
    w = Window.partitionBy("league", "team", "at_home").orderBy(F.desc("match_date"), *[F.desc(c) for c in M.TIE])
    last = M.sides(canon(spark, sf_dir)).withColumn("back", F.row_number().over(w)).filter("back <= 5")
    return last.groupBy("league", "team", "at_home").agg(F.round(F.avg("gf"), 6).alias("gf5"), F.round(F.avg("ga"), 6).alias("ga5"), F.sum(F.when(F.col("back") <= 3, F.col("pts")).otherwise(0)).alias("pts3"), F.round(F.avg(F.when(F.col("ga") == 0, 1.0).otherwise(0.0)), 6).alias("clean"))


@query("d02_season_choice", SIDES + """, n AS (SELECT league, season, count(*) / 2 AS n FROM sides GROUP BY ALL), m AS (SELECT DISTINCT league, season, match_date FROM sides),
 c AS (SELECT m.league, m.season, m.match_date, (SELECT count(*) / 2 FROM sides s WHERE s.league = m.league AND s.season = m.season AND s.match_date < m.match_date) AS now FROM m)
 SELECT league, match_date, season, CAST(now AS BIGINT) AS matches_before, CASE WHEN now >= 40 THEN season ELSE coalesce((SELECT max(n.season) FROM n WHERE n.league = c.league AND n.season < c.season AND n.n >= 40), season) END AS used FROM c""")
def d02(spark, sf_dir):
    return T.season_choice(canon(spark, sf_dir), 40)


@query("j07_asof_rating", CANON + """, r AS (SELECT league, home AS team, match_date, max(coalesce(conf, 0.5e0)) AS rating FROM canon GROUP BY ALL)
 SELECT c.league, c.match_date, c.home, c.away, coalesce((SELECT arg_max(r.rating, r.match_date) FROM r WHERE r.league = c.league AND r.team = c.away AND r.match_date <= c.match_date), 0.5e0) AS rating FROM canon c""")
def j07(spark, sf_dir):
    """Every canonical row is a rating of its home team."""
    c = canon(spark, sf_dir)
    ratings = c.groupBy("league", F.col("home").alias("team"), "match_date").agg(F.max(F.coalesce("conf", F.lit(0.5))).alias("rating"))
    return T.asof(c.select("league", "match_date", "home", "away"), ratings, ["league", "away"], ["league", "team"], "match_date", "rating", 0.5)


_OTHER = "CASE WHEN ok % 2 = 0 THEN concat('FC ', away) WHEN ok % 3 = 0 THEN concat(away, ' B') ELSE away END"


@query("j07_last_word", CANON + f""", r AS (SELECT league, home AS team, match_date, max(coalesce(conf, 0.5e0)) AS rating FROM canon GROUP BY ALL), c AS (SELECT league, match_date, home, {_OTHER} AS named, CASE WHEN ok % 2 > 0 AND ok % 3 = 0 THEN NULL ELSE away END AS team FROM canon)
 SELECT c.league, c.match_date, c.home, c.named, coalesce((SELECT arg_max(r.rating, r.match_date) FROM r WHERE r.league = c.league AND r.team = c.team AND r.match_date <= c.match_date), 0.5e0) AS rating FROM c""")
def j07_last_word(spark, sf_dir):
    """Ratings of teams that are named otherwise than in the rating table: by the last word of the name."""
    c = canon(spark, sf_dir)
    ratings = c.groupBy("league", F.col("home").alias("team"), "match_date").agg(F.max(F.coalesce("conf", F.lit(0.5))).alias("rating"))
    named = T.with_known_team(c.select("league", "match_date", "home", F.expr(_OTHER).alias("named")), ratings, "named", "team")
    named = named.withColumn("team", F.coalesce("team", "named"))  # unresolved names stay apart: no group of nulls
    return T.asof(named, ratings, ["league", "team"], ["league", "team"], "match_date", "rating", 0.5).select("league", "match_date", "home", "named", "rating")


@query("j20_latest_rating_top3", CANON + """, r AS (SELECT league, home AS team, arg_max(coalesce(conf, 0.5e0), concat(CAST(match_date AS VARCHAR), lpad(CAST(ok AS VARCHAR), 12, '0'), lpad(CAST(ln AS VARCHAR), 4, '0'), lpad(CAST(pk AS VARCHAR), 9, '0'), lpad(CAST(sk AS VARCHAR), 9, '0'))) AS rating FROM canon GROUP BY ALL)
 SELECT league, team, rating FROM (SELECT *, row_number() OVER (PARTITION BY league ORDER BY rating DESC, team) AS rn FROM r) WHERE rn <= 3""")
def j20(spark, sf_dir):
    last = canon(spark, sf_dir).groupBy("league", F.col("home").alias("team")).agg(F.max_by(F.coalesce("conf", F.lit(0.5)), F.struct("match_date", *M.TIE)).alias("rating"))
    w = Window.partitionBy("league").orderBy(F.desc("rating"), "team")
    return last.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").drop("rn")


@query("f25_decay", CANON + " SELECT league, home, away, round(sum(power(0.5e0, greatest(date_diff('day', match_date, DATE '2001-06-30'), 0) / 180e0) * coalesce(conf, 1e0)), 6) AS weight FROM canon GROUP BY ALL")
def f25(spark, sf_dir):
    """Time-decayed pair weights (the edge list of the match graph)."""
    days = F.datediff(F.lit("2001-06-30").cast("date"), "match_date")
    return canon(spark, sf_dir).groupBy("league", "home", "away").agg(F.round(F.sum(decay(days, 180.0) * F.coalesce("conf", F.lit(1.0))), 6).alias("weight"))


@query("j03_unresolved", ctes("contests") + " SELECT c.ok, c.ln, c.pk, c.sk FROM contests c WHERE NOT EXISTS (SELECT 1 FROM contests r WHERE r.source = 'closed_prediction' AND r.league = c.league AND r.home = c.home AND r.match_date BETWEEN c.match_date AND c.match_date + 2 AND r.match_date IS NOT NULL)")
def j03(spark, sf_dir):
    """Anti join on a window of three days: results are spread over the days they can serve, so the join stays equal-key."""
    c = contests(spark, sf_dir)
    done = c.filter("source = 'closed_prediction'").select("league", "home", F.explode(F.sequence(F.date_sub("match_date", 2), "match_date")).alias("match_date")).distinct()
    return c.join(done, ["league", "home", "match_date"], "left_anti").select(*M.TIE)
