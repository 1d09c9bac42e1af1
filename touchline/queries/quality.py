"""Canonical rows, duplicates, coverage and health reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.bindings import ctes, frame
from touchline.durable import Materialized, files_of
from touchline.functions.prob import implied, outcome, overround, price
from touchline.operators import matches as M
from touchline.operators import merge as G
from touchline.registry import query

COMPLETE = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in M.STATS)
PRIORITY = """CASE WHEN lower(coalesce(source, '')) = 'closed_prediction' THEN 100 WHEN lower(coalesce(source, '')) LIKE '%flashscore%' THEN 98
 WHEN lower(coalesce(source, '')) = 'historical_csv' THEN 90 WHEN lower(coalesce(source, '')) = 'openfootball_repo' THEN 84 ELSE 50 END"""
#: contests, canon (one row for each fixture) and sides (two rows for each match) as common table expressions.
CANON = ctes("contests") + f""", canon AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(league)), match_date, lower(trim(home)), lower(trim(away))
 ORDER BY {COMPLETE} DESC, coalesce(conf, 0e0) DESC, {PRIORITY} DESC, ok DESC, ln DESC, pk DESC, sk DESC) AS rn FROM contests) WHERE rn = 1)"""
SIDES = CANON + """, sides AS (SELECT league, match_date, team, opponent, at_home, gf, ga, xg, xga, ok, ln, pk, sk,
 CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS pts, CASE WHEN gf > ga THEN 'W' WHEN gf = ga THEN 'D' ELSE 'L' END AS res,
 concat(CAST(year(match_date) - CASE WHEN month(match_date) < 7 THEN 1 ELSE 0 END AS VARCHAR), '-', CAST(year(match_date) - CASE WHEN month(match_date) < 7 THEN 1 ELSE 0 END + 1 AS VARCHAR)) AS season
 FROM (SELECT league, match_date, home AS team, away AS opponent, 1 AS at_home, hg AS gf, ag AS ga, xg_h AS xg, xg_a AS xga, ok, ln, pk, sk FROM canon
 UNION ALL SELECT league, match_date, away, home, 0, ag, hg, xg_a, xg_h, ok, ln, pk, sk FROM canon))"""
FTR = "CASE WHEN hg > ag THEN 'H' WHEN hg = ag THEN 'D' WHEN hg < ag THEN 'A' END"


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "contests")


_written: dict[tuple[str, str], Materialized] = {}
#: The files behind each written table.
_files: dict[tuple[str, str], tuple] = {}


def canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows, written to the shared folder once for each application and state of the tables: new files under the same path
    are written anew.  Rows that a caller has put there are taken as they are."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _written or key in _files:
        files = files_of(spark, *(f"{sf_dir}/{t}.parquet" for t in ("lineitem", "region")))
        if _files.get(key) != files:
            if key in _written:
                _written.pop(key).drop()
            _written[key], _files[key] = Materialized(M.canonical(contests(spark, sf_dir))), files
    return _written[key].read()


def forget_canon() -> None:
    """Drop the written rows; the next query writes them again."""
    _files.clear()
    while _written:
        _written.popitem()[1].drop()


@query("w01_canonical", CANON + " SELECT league, match_date, home, away, hg, ag, conf, source, ok, ln, pk, sk FROM canon")
def w01(spark, sf_dir):
    return M.canonical(contests(spark, sf_dir)).select("league", "match_date", "home", "away", "hg", "ag", "conf", "source", *M.TIE)


@query("a03_duplicate_groups", ctes("contests") + """ SELECT league, match_date, lower(trim(home)) AS home_key, lower(trim(away)) AS away_key, CAST(count(*) AS BIGINT) AS duplicate_count,
 coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources FROM contests GROUP BY ALL HAVING count(*) > 1""")
def a03(spark, sf_dir):
    keys = ["league", "match_date", F.lower(F.trim("home")).alias("home_key"), F.lower(F.trim("away")).alias("away_key")]
    return contests(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("duplicate_count"), F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources")).filter("duplicate_count > 1")


@query("a02_health", ctes("contests") + """, g AS (SELECT league, match_date, lower(trim(home)) AS h, lower(trim(away)) AS a, count(*) AS n FROM contests GROUP BY ALL)
 SELECT league, CAST(sum(n) AS BIGINT) AS raw_rows, CAST(count(*) AS BIGINT) AS canonical_rows, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_groups,
 CAST(sum(n) - count(*) AS BIGINT) AS extra_rows, CAST(max(n) AS BIGINT) AS largest_group FROM g GROUP BY league""")
def a02(spark, sf_dir):
    groups = contests(spark, sf_dir).groupBy("league", "match_date", F.lower(F.trim("home")).alias("h"), F.lower(F.trim("away")).alias("a")).agg(F.count("*").alias("n"))
    return groups.groupBy("league").agg(F.sum("n").alias("raw_rows"), F.count("*").alias("canonical_rows"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), (F.sum("n") - F.count("*")).alias("extra_rows"), F.max("n").alias("largest_group"))


@query("a01_coverage", ctes("contests") + """ SELECT league, CAST(count(*) AS BIGINT) AS n, CAST(count(hc) AS BIGINT) AS with_corners, CAST(count(hy) AS BIGINT) AS with_cards, CAST(count(hs) AS BIGINT) AS with_shots,
 CAST(sum(CASE WHEN odds_h > 1.01e0 AND odds_a > 1.01e0 THEN 1 ELSE 0 END) AS BIGINT) AS with_odds FROM contests GROUP BY league""")
def a01(spark, sf_dir):
    return contests(spark, sf_dir).groupBy("league").agg(F.count("*").alias("n"), F.count("hc").alias("with_corners"), F.count("hy").alias("with_cards"), F.count("hs").alias("with_shots"), F.count_if((F.col("odds_h") > 1.01) & (F.col("odds_a") > 1.01)).alias("with_odds"))


@query("a04_top_sources", ctes("contests") + " SELECT coalesce(source, 'unknown') AS source, CAST(count(*) AS BIGINT) AS n FROM contests GROUP BY 1 ORDER BY n DESC, source LIMIT 20")
def a04(spark, sf_dir):
    return contests(spark, sf_dir).groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(20)


@query("a05_freshness", ctes("contests") + """ SELECT league, max(match_date) AS newest, CAST(date_diff('day', max(match_date), DATE '2001-11-10') AS INT) AS age_days, date_diff('day', max(match_date), DATE '2001-11-10') > 14 AS stale FROM contests GROUP BY league""")
def a05(spark, sf_dir):
    newest = contests(spark, sf_dir).groupBy("league").agg(F.max("match_date").alias("newest"))
    return newest.withColumn("age_days", F.datediff(F.lit("2001-11-10").cast("date"), "newest")).withColumn("stale", F.col("age_days") > 14)


@query("a06_referee_averages", ctes("contests") + """ SELECT referee, CAST(count(*) AS BIGINT) AS n, round(avg(coalesce(hy, 0) + coalesce(ay, 0)), 6) AS avg_yellow, round(avg(hr + ar), 6) AS avg_red, round(avg(hg + ag), 6) AS avg_goals
 FROM contests WHERE referee IS NOT NULL GROUP BY referee HAVING count(*) >= 3""")
def a06(spark, sf_dir):
    z = lambda c: F.coalesce(c, F.lit(0))
    per = contests(spark, sf_dir).filter("referee is not null").groupBy("referee")
    return per.agg(F.count("*").alias("n"), F.round(F.avg(z("hy") + z("ay")), 6).alias("avg_yellow"), F.round(F.avg(F.col("hr") + F.col("ar")), 6).alias("avg_red"), F.round(F.avg(F.col("hg") + F.col("ag")), 6).alias("avg_goals")).filter("n >= 3")


@query("a07_weighted_averages", ctes("contests") + """, r AS (SELECT referee, league, count(*) AS n, sum(coalesce(hy, 0) + coalesce(ay, 0)) AS y, sum(hr + ar) AS rd FROM contests WHERE referee IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
 SELECT league, CAST(sum(n) AS BIGINT) AS matches, round(sum(y) / sum(n), 6) AS avg_yellow, round(sum(rd) / sum(n), 6) AS avg_red, round((sum(y) + sum(rd)) / sum(n), 6) AS avg_cards FROM r GROUP BY league""")
def a07(spark, sf_dir):
    z = lambda c: F.coalesce(c, F.lit(0))
    per = contests(spark, sf_dir).filter("referee is not null").groupBy("referee", "league").agg(F.count("*").alias("n"), F.sum(z("hy") + z("ay")).alias("y"), F.sum(F.col("hr") + F.col("ar")).alias("r")).filter("n >= 3")
    total = per.groupBy("league").agg(F.sum("n").alias("matches"), F.sum("y").alias("y"), F.sum("r").alias("r"))
    return total.select("league", "matches", F.round(F.col("y") / F.col("matches"), 6).alias("avg_yellow"), F.round(F.col("r") / F.col("matches"), 6).alias("avg_red"), F.round((F.col("y") + F.col("r")) / F.col("matches"), 6).alias("avg_cards"))


@query("j05_modal_league", ctes("contests") + """, c AS (SELECT referee, league, count(*) AS n FROM contests WHERE referee IS NOT NULL GROUP BY ALL)
 SELECT referee, league AS league_primary, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY referee ORDER BY n DESC, league) AS rn FROM c) WHERE rn = 1""")
def j05(spark, sf_dir):
    counted = contests(spark, sf_dir).filter("referee is not null").groupBy("referee", "league").agg(F.count("*").alias("n"))
    w = Window.partitionBy("referee").orderBy(F.desc("n"), "league")
    return counted.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("referee", F.col("league").alias("league_primary"), "n")


@query("j21_referee_fallback", ctes("contests") + """, s AS (SELECT lower(referee) AS k, count(*) AS n, avg(coalesce(hy, 0) + coalesce(ay, 0)) AS a FROM contests WHERE referee IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
 l AS (SELECT league, avg(coalesce(hy, 0) + coalesce(ay, 0)) AS a FROM contests WHERE referee IS NOT NULL GROUP BY 1), g AS (SELECT avg(coalesce(hy, 0) + coalesce(ay, 0)) AS a FROM contests WHERE referee IS NOT NULL),
 w AS (SELECT DISTINCT league, CASE WHEN pk % 3 = 0 THEN concat('Unknown ', CAST(pk % 31 AS VARCHAR)) ELSE referee END AS asked FROM contests)
 SELECT w.league, w.asked, round(coalesce(s.a, l.a, g.a, 3.5), 6) AS yellow, CASE WHEN s.a IS NOT NULL THEN 'referee' WHEN l.a IS NOT NULL THEN 'league' WHEN g.a IS NOT NULL THEN 'global' ELSE 'constant' END AS level
 FROM w LEFT JOIN s ON lower(w.asked) = s.k LEFT JOIN l ON w.league = l.league CROSS JOIN g""")
def j21(spark, sf_dir):
    """Referee, else league, else global average; the lookups have a row for each referee or league, AQE sizes the joins."""
    c = contests(spark, sf_dir)
    known = c.filter("referee is not null").withColumn("y", F.coalesce("hy", F.lit(0)) + F.coalesce("ay", F.lit(0)))
    exact = known.groupBy(F.lower("referee").alias("k")).agg(F.count("*").alias("n"), F.avg("y").alias("ra")).filter("n >= 3")
    league = known.groupBy("league").agg(F.avg("y").alias("la"))
    overall = known.agg(F.avg("y").alias("ga"))
    asked = c.select("league", F.when(F.col("pk") % 3 == 0, F.concat(F.lit("Unknown "), (F.col("pk") % 31).cast("string"))).otherwise(F.col("referee")).alias("asked")).distinct()
    met = asked.join(exact, F.lower("asked") == F.col("k"), "left").join(league, "league", "left").join(F.broadcast(overall))  # one row
    level = F.when(F.col("ra").isNotNull(), "referee").when(F.col("la").isNotNull(), "league").when(F.col("ga").isNotNull(), "global").otherwise("constant")
    return met.select("league", "asked", F.round(F.coalesce("ra", "la", "ga", F.lit(3.5)), 6).alias("yellow"), level.alias("level"))


@query("a09_row_coverage", ctes("contests") + f""", r AS (SELECT league, round(({COMPLETE}) / {len(M.STATS)}.0e0, 4) AS rate FROM contests)
 SELECT league, round(avg(rate), 6) AS mean_rate, CAST(sum(CASE WHEN rate = 1.0e0 THEN 1 ELSE 0 END) AS BIGINT) AS full_rows FROM r GROUP BY league""")
def a09(spark, sf_dir):
    rows = contests(spark, sf_dir).select("league", F.round(M.completeness() / len(M.STATS), 4).alias("rate"))
    return rows.groupBy("league").agg(F.round(F.avg("rate"), 6).alias("mean_rate"), F.count_if(F.col("rate") == 1).alias("full_rows"))


@query("a31_odds_gate", ctes("contests") + """ SELECT league, year(match_date) AS yr, CAST(count(*) AS BIGINT) AS n, round(sum(CASE WHEN odds_h > 1.01e0 AND odds_a > 1.01e0 THEN 1 ELSE 0 END) / count(*), 6) AS covered,
 sum(CASE WHEN odds_h > 1.01e0 AND odds_a > 1.01e0 THEN 1 ELSE 0 END) / count(*) >= 0.9e0 AS skip FROM contests WHERE match_date BETWEEN DATE '1996-07-01' AND DATE '1999-06-30' GROUP BY 1, 2""")
def a31(spark, sf_dir):
    rows = contests(spark, sf_dir).filter(F.col("match_date").between("1996-07-01", "1999-06-30"))
    share = F.count_if((F.col("odds_h") > 1.01) & (F.col("odds_a") > 1.01)) / F.count("*")
    return rows.groupBy("league", F.year("match_date").alias("yr")).agg(F.count("*").alias("n"), F.round(share, 6).alias("covered"), (share >= 0.9).alias("skip"))


@query("p16_source_confidence", ctes("contests") + """ SELECT coalesce(source, 'mock') AS source, round(least(1.0e0, CASE coalesce(source, 'mock') WHEN 'browser' THEN 0.78e0 WHEN 'historical_csv' THEN 0.85e0 WHEN 'mock' THEN 0.2e0 ELSE 0.4e0 END + 0.05e0), 3) AS confidence,
 CAST(count(*) AS BIGINT) AS n FROM contests GROUP BY ALL""")
def p16(spark, sf_dir):
    src = F.coalesce("source", F.lit("mock"))
    base = F.when(src == "browser", 0.78).when(src == "historical_csv", 0.85).when(src == "mock", 0.2).otherwise(0.4)
    return contests(spark, sf_dir).groupBy(src.alias("source"), F.round(F.least(F.lit(1.0), base + 0.05), 3).alias("confidence")).agg(F.count("*").alias("n"))


@query("p09_adaptive_window", ctes("contests") + """, n AS (SELECT league, sum(CASE WHEN match_date >= DATE '2000-11-01' THEN 1 ELSE 0 END) AS y1, sum(CASE WHEN match_date >= DATE '1999-11-01' THEN 1 ELSE 0 END) AS y2,
 sum(CASE WHEN match_date >= DATE '1998-11-01' THEN 1 ELSE 0 END) AS y3 FROM contests GROUP BY league), f AS (SELECT league, CASE WHEN y1 >= 800 THEN DATE '2000-11-01' WHEN y2 >= 800 THEN DATE '1999-11-01' WHEN y3 >= 800 THEN DATE '1998-11-01' END AS since FROM n)
 SELECT c.league, f.since, CAST(count(*) AS BIGINT) AS n FROM contests c JOIN f ON c.league = f.league WHERE f.since IS NULL OR c.match_date >= f.since GROUP BY ALL""")
def p09(spark, sf_dir):
    c, starts = contests(spark, sf_dir), ["2000-11-01", "1999-11-01", "1998-11-01"]
    counts = c.groupBy("league").agg(*[F.count_if(F.col("match_date") >= F.lit(s).cast("date")).alias(f"y{i}") for i, s in enumerate(starts)])
    since = F.when(F.col("y0") >= 800, starts[0]).when(F.col("y1") >= 800, starts[1]).when(F.col("y2") >= 800, starts[2])
    chosen = counts.select("league", since.cast("date").alias("since"))
    return c.join(chosen, "league").filter(F.col("since").isNull() | (F.col("match_date") >= F.col("since"))).groupBy("league", "since").agg(F.count("*").alias("n"))


@query("p07_missing_stats", ctes("contests") + " SELECT league, CAST(sum(CASE WHEN hc IS NULL OR hy IS NULL OR hs IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS any_missing, CAST(sum(CASE WHEN hc IS NULL AND hy IS NULL AND hs IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS all_missing FROM contests GROUP BY league")
def p07(spark, sf_dir):
    gaps = [F.col(c).isNull() for c in ("hc", "hy", "hs")]
    return contests(spark, sf_dir).groupBy("league").agg(F.count_if(gaps[0] | gaps[1] | gaps[2]).alias("any_missing"), F.count_if(gaps[0] & gaps[1] & gaps[2]).alias("all_missing"))


@query("p06_source_like", ctes("contests") + " SELECT source, CAST(count(*) AS BIGINT) AS n FROM contests WHERE source ILIKE '%FLASH%' OR source ILIKE 'Closed%' GROUP BY source")
def p06(spark, sf_dir):
    return contests(spark, sf_dir).filter(F.col("source").ilike("%FLASH%") | F.col("source").ilike("Closed%")).groupBy("source").agg(F.count("*").alias("n"))


@query("p15_distinct_leagues", ctes("contests") + " SELECT DISTINCT league FROM contests")
def p15(spark, sf_dir):
    return contests(spark, sf_dir).select("league").distinct()


@query("u01_teams", ctes("contests") + " SELECT league, home AS team FROM contests UNION SELECT league, away FROM contests")
def u01(spark, sf_dir):
    c = contests(spark, sf_dir)
    return c.select("league", F.col("home").alias("team")).union(c.select("league", "away")).distinct()


@query("u04_only_away", ctes("contests") + " SELECT DISTINCT league, away AS team FROM contests WHERE hg > 3 EXCEPT SELECT league, home FROM contests WHERE hg > 3 AND ag > 2 AND match_date < DATE '1995-02-15'")
def u04(spark, sf_dir):
    c = contests(spark, sf_dir).filter("hg > 3")
    return c.select("league", F.col("away").alias("team")).distinct().join(c.filter("ag > 2 and match_date < date'1995-02-15'").select("league", F.col("home").alias("team")), ["league", "team"], "left_anti")


@query("t01_latest", CANON + " SELECT league, match_date, home, away, ok, ln FROM canon ORDER BY match_date DESC, ok DESC, ln DESC, pk DESC, sk DESC LIMIT 100")
def t01(spark, sf_dir):
    return canon(spark, sf_dir).orderBy(F.desc("match_date"), *[F.desc(c) for c in M.TIE]).limit(100).select("league", "match_date", "home", "away", "ok", "ln")


@query("t07_latest_by_league", CANON + " SELECT league, match_date, home, away, ok, ln FROM (SELECT *, row_number() OVER (PARTITION BY league ORDER BY match_date DESC, ok DESC, ln DESC, pk DESC, sk DESC) AS r2 FROM canon) WHERE r2 <= 300")
def t07(spark, sf_dir):
    w = Window.partitionBy("league").orderBy(F.desc("match_date"), *[F.desc(c) for c in M.TIE])
    return canon(spark, sf_dir).withColumn("r2", F.row_number().over(w)).filter("r2 <= 300").select("league", "match_date", "home", "away", "ok", "ln")


@query("f30_implied", ctes("contests") + """, v AS (SELECT ok, ln, pk, sk, CASE WHEN odds_h > 1.01e0 THEN 1 / odds_h ELSE 0 END AS h, CASE WHEN odds_d > 1.01e0 THEN 1 / odds_d ELSE 0 END AS d, CASE WHEN odds_a > 1.01e0 THEN 1 / odds_a ELSE 0 END AS a, odds_h, odds_d, odds_a FROM contests)
 SELECT ok, ln, pk, sk, round(h / nullif(h + d + a, 0), 9) AS p_h, round(d / nullif(h + d + a, 0), 9) AS p_d, round(a / nullif(h + d + a, 0), 9) AS p_a, round((1 / odds_h) / (1 / odds_h + 1 / odds_d + 1 / odds_a), 9) AS s_h, round(1 / odds_a, 9) AS r_a FROM v""")
def f30(spark, sf_dir):
    odds = [F.col("odds_h"), F.col("odds_d"), F.col("odds_a")]
    r = lambda x, n: F.round(x, 9).alias(n)
    p = implied(odds)
    return contests(spark, sf_dir).select(*M.TIE, r(p[0], "p_h"), r(p[1], "p_d"), r(p[2], "p_a"), r(implied(odds, "strict")[0], "s_h"), r(implied(odds, "raw")[2], "r_a"))


@query("f30_variants", ctes("contests") + """, v AS (SELECT ok, ln, pk, sk, odds_h, odds_d, odds_a, CASE WHEN odds_h > 1 THEN 1 / odds_h END AS h, CASE WHEN odds_d > 1 THEN 1 / odds_d END AS d, CASE WHEN odds_a > 1 THEN 1 / odds_a END AS a,
 CASE WHEN odds_h > 1.01e0 THEN 1 / odds_h ELSE 1e-6 END AS ch, CASE WHEN odds_d > 1.01e0 THEN 1 / odds_d ELSE 1e-6 END AS cd, CASE WHEN odds_a > 1.01e0 THEN 1 / odds_a ELSE 1e-6 END AS ca FROM contests)
 SELECT ok, ln, pk, sk, CAST(round(CAST(h / nullif(coalesce(h, 0) + coalesce(d, 0) + coalesce(a, 0), 0) AS DECIMAL(38, 17)), 4) AS DOUBLE) AS partial_h, CAST(round(CAST(a / nullif(coalesce(h, 0) + coalesce(d, 0) + coalesce(a, 0), 0) AS DECIMAL(38, 17)), 4) AS DOUBLE) AS partial_a, CASE WHEN odds_h > 1.01e0 OR odds_d > 1.01e0 OR odds_a > 1.01e0 THEN round(ch / (ch + cd + ca), 9) END AS clipped_h,
 CASE WHEN odds_h > 1.01e0 OR odds_d > 1.01e0 OR odds_a > 1.01e0 THEN round(ca / (ch + cd + ca), 9) END AS clipped_a, round(1 / odds_h + 1 / odds_d + 1 / odds_a, 9) AS overround, CASE WHEN odds_h IS NOT NULL THEN round(least(0.99e0, greatest(0.01e0, 1 / odds_h)), 9) END AS clamped_h FROM v""")
def f30_variants(spark, sf_dir):
    """The policies that ``f30_implied`` does not show."""
    odds = [F.col("odds_h"), F.col("odds_d"), F.col("odds_a")]
    r = lambda x, n: F.round(x, 9).alias(n)
    part, held = implied(odds, "partial"), implied(odds, "clipped")
    return contests(spark, sf_dir).select(*M.TIE, part[0].alias("partial_h"), part[2].alias("partial_a"), r(held[0], "clipped_h"), r(held[2], "clipped_a"), r(overround(odds), "overround"), r(price(odds[0]), "clamped_h"))


@query("w02_keep_last", ctes("contests") + " SELECT league, match_date, home, away, conf, ok, ln, pk, sk FROM (SELECT *, row_number() OVER (PARTITION BY league, match_date, home, away ORDER BY conf DESC NULLS LAST, ok DESC, ln DESC, pk DESC, sk DESC) AS r FROM contests) WHERE r = 1")
def w02(spark, sf_dir):
    """The last row of a fixture by confidence, an unknown one lowest; one partial aggregation, as structs sort nulls first."""
    rows = contests(spark, sf_dir).select("league", "match_date", "home", "away", "conf", *M.TIE)
    return G.last_write(rows, ["league", "match_date", "home", "away"], ["conf", *M.TIE])


@query("d17_outcomes", ctes("contests") + f" SELECT league, {FTR} AS ftr, CAST(count(*) AS BIGINT) AS n FROM contests GROUP BY ALL")
def d17(spark, sf_dir):
    return contests(spark, sf_dir).groupBy("league", outcome(F.col("hg"), F.col("ag")).alias("ftr")).agg(F.count("*").alias("n"))
