"""Probabilities, metrics, market rules, tickets and audit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.bindings import ctes, frame
from touchline.functions import prob as P
from touchline.operators import markets as K
from touchline.operators import matches as M
from touchline.queries.quality import CANON, FTR, canon, contests
from touchline.registry import query

ABOUT = """, q AS (SELECT *, 0.3e0 + (ok % 23) / 10e0 AS mh, 0.2e0 + (pk % 19) / 10e0 AS ma FROM canon)"""
#: a prediction with its outcome for each canonical match
PRED = CANON + """, pred AS (SELECT league, match_date, home, away, hg, ag, hc, ac, hy, ay, conf, ok, ln, pk, sk, 6e0 + pk % 9 AS exp_corners, 2e0 + sk % 5 AS exp_cards, (ok % 60 + 20) / 100e0 AS p_h, (pk % 50 + 15) / 100e0 AS p_a, (sk % 30 + 10) / 100e0 AS p_d, (ok % 45 + 40) / 100e0 AS p_o25,
 (pk % 40 + 40) / 100e0 AS p_btts, CASE pk % 7 WHEN 0 THEN 'Surgical' WHEN 1 THEN 'Blitz' WHEN 2 THEN 'Trap' WHEN 3 THEN 'Stagnant' WHEN 4 THEN 'High Tempo' WHEN 5 THEN 'Balanced' ELSE 'Defensive' END AS profile,
 (ok % 21 - 4) / 100e0 AS edge, CAST(pk % 90 + 5 AS DOUBLE) AS trust, (sk % 9) + 0.5e0 AS volatility, (ok % 5 - 2) / 100e0 AS cld FROM canon)"""
RULES = """CASE WHEN p_h > p_a * 1.6e0 AND p_h > 0.42e0 THEN 'Home Win' WHEN p_a > p_h * 1.8e0 AND p_a > 0.42e0 THEN 'Away Win' WHEN p_o25 >= 0.62e0 THEN 'Over 2.5' WHEN p_btts >= 0.62e0 AND p_o25 >= 0.55e0 THEN 'BTTS' WHEN profile = 'Defensive' THEN 'Under 2.5'
 WHEN p_d > 0.35e0 AND p_h >= p_a THEN '1X (Double Chance)' WHEN p_d > 0.35e0 THEN 'X2 (Double Chance)' WHEN p_h > p_a AND p_h > 0.38e0 THEN 'Home Win' WHEN p_a > p_h AND p_a > 0.38e0 THEN 'X2 (Double Chance)'
 WHEN profile = 'Surgical' THEN 'Home Win' WHEN profile = 'Blitz' THEN 'BTTS' WHEN profile = 'Trap' THEN 'X2 (Double Chance)' WHEN profile = 'Stagnant' THEN 'Under 2.5' WHEN profile = 'High Tempo' THEN 'Over 2.5' ELSE 'Over 1.5' END"""
HIT = f"""CASE WHEN market = 'Over 1.5' THEN hg + ag > 1 WHEN market = 'Over 2.5' THEN hg + ag > 2 WHEN market = 'Over 3.5' THEN hg + ag > 3 WHEN market = 'BTTS' THEN hg > 0 AND ag > 0 WHEN market = 'Home Win' THEN hg > ag WHEN market = 'Away Win' THEN hg < ag
 WHEN market LIKE '1X%' THEN hg >= ag WHEN market LIKE 'X2%' THEN hg <= ag WHEN market = 'Draw' THEN hg = ag ELSE FALSE END"""


def pred(spark, sf_dir) -> DataFrame:
    mod = lambda c, m, a, d: (F.col(c) % m + a) / float(d)
    names = ["Surgical", "Blitz", "Trap", "Stagnant", "High Tempo", "Balanced", "Defensive"]
    return canon(spark, sf_dir).select("league", "match_date", "home", "away", "hg", "ag", "hc", "ac", "hy", "ay", "conf", *M.TIE, (6.0 + F.col("pk") % 9).alias("exp_corners"), (2.0 + F.col("sk") % 5).alias("exp_cards"), mod("ok", 60, 20, 100).alias("p_h"), mod("pk", 50, 15, 100).alias("p_a"), mod("sk", 30, 10, 100).alias("p_d"),
        mod("ok", 45, 40, 100).alias("p_o25"), mod("pk", 40, 40, 100).alias("p_btts"), F.array(*[F.lit(n) for n in names])[(F.col("pk") % 7).cast("int")].alias("profile"), mod("ok", 21, -4, 100).alias("edge"),
        (F.col("pk") % 90 + 5).cast("double").alias("trust"), ((F.col("sk") % 9) + 0.5).alias("volatility"), mod("ok", 5, -2, 100).alias("cld"))


def r(x: Column, n: str, digits: int = 9) -> Column:
    return F.round(x, digits).alias(n)


_PMF = "(exp(-{m}) * power({m}, i) / factorial(CAST(i AS INT)))"


@query("f33_score_distribution", CANON + ABOUT + f""", g AS (SELECT a.i AS h, b.i AS a FROM range(11) a(i), range(11) b(i)), ids AS (SELECT DISTINCT mh, ma FROM q),
 c AS (SELECT mh, ma, h, a, exp(-mh) * power(mh, h) / factorial(CAST(h AS INT)) * exp(-ma) * power(ma, a) / factorial(CAST(a AS INT)) AS p FROM ids, g)
 SELECT round(mh, 2) AS mh, round(ma, 2) AS ma, round(sum(p) FILTER (h > a) / sum(p), 9) AS p_home, round(sum(p) FILTER (h = a) / sum(p), 9) AS p_draw, round(sum(p) FILTER (h < a) / sum(p), 9) AS p_away, round(sum(p) FILTER (h > 0 AND a > 0), 9) AS p_btts,
 round(coalesce(sum(p) FILTER (h + a > 1.5), 0), 9) AS p_over15, round(sum(p) FILTER (h + a > 2.5), 9) AS p_over25, round(sum(p) FILTER (h + a > 3.5), 9) AS p_over35 FROM c GROUP BY mh, ma""")
def f33(spark, sf_dir):
    q = canon(spark, sf_dir).select((0.3 + (F.col("ok") % 23) / 10.0).alias("mh"), (0.2 + (F.col("pk") % 19) / 10.0).alias("ma")).distinct()
    return q.select(r(F.col("mh"), "mh", 2), r(F.col("ma"), "ma", 2), *[r(x, n) for n, x in P.score_distribution(F.col("mh"), F.col("ma")).items()])


@query("f32_count_over", CANON + """, q AS (SELECT DISTINCT ok % 37 AS a, pk % 11 AS b FROM canon), v AS (SELECT a, b, 2e0 + a / 5e0 AS mu, CASE WHEN b < 3 THEN NULL ELSE 1.2e0 + b END AS rr FROM q),
 n AS (SELECT *, power(rr / (rr + mu), rr) AS p0, mu / (rr + mu) AS f FROM v) SELECT a, b, round(CASE WHEN rr IS NULL THEN 1 - exp(-mu) * (1 + mu + mu * mu / 2 + mu * mu * mu / 6) ELSE 1 - p0 * (1 + rr * f + rr * (rr + 1) / 2 * f * f + rr * (rr + 1) * (rr + 2) / 6 * f * f * f) END, 9) AS over35 FROM n""")
def f32(spark, sf_dir):
    q = canon(spark, sf_dir).select((F.col("ok") % 37).alias("a"), (F.col("pk") % 11).alias("b")).distinct()
    return q.select("a", "b", r(P.count_over(3.5, 2.0 + F.col("a") / 5.0, F.when(F.col("b") >= 3, 1.2 + F.col("b"))), "over35"))


@query("f36_entropy", PRED + """, n AS (SELECT ok, ln, pk, sk, p_h, p_d, p_a, p_h + p_d + p_a AS t FROM pred) SELECT ok, ln, pk, sk, round(-(p_h / t * ln(p_h / t) + p_d / t * ln(p_d / t) + p_a / t * ln(p_a / t)) / ln(3e0), 9) AS entropy,
 round(list_sort([p_h, p_d, p_a])[3] - list_sort([p_h, p_d, p_a])[2], 9) AS margin FROM n""".replace("* ln(", "* log_(").replace("/ ln(", "/ log_(").replace("log_(", "ln("))
def f36(spark, sf_dir):
    p = [F.col("p_h"), F.col("p_d"), F.col("p_a")]
    return pred(spark, sf_dir).select(*M.TIE, r(P.entropy(p), "entropy"), r(P.margin(p), "margin"))


@query("f38_edge_quality", PRED + """, s AS (SELECT *, CASE WHEN edge <= 0 THEN 0e0 ELSE edge * 100 * trust * greatest(0.1e0, 10 - volatility) * CASE WHEN cld > 0.01e0 THEN 1.2e0 WHEN cld < -0.01e0 THEN 0.8e0 ELSE 1e0 END / greatest(1e0, volatility * 2) END AS score FROM pred),
 t AS (SELECT *, CASE WHEN score > 120 THEN 'SHARP EDGE' WHEN score > 80 THEN 'PLAYABLE' WHEN score > 50 THEN 'WEAK EDGE' ELSE 'NO EDGE' END AS tier FROM s)
 SELECT ok, ln, pk, sk, round(score, 6) AS score, tier, round(CASE tier WHEN 'SHARP EDGE' THEN least(10e0, edge * trust) WHEN 'PLAYABLE' THEN least(5e0, edge * trust) WHEN 'WEAK EDGE' THEN least(2e0, edge * trust) ELSE 0e0 END, 6) AS stake FROM t""")
def f38(spark, sf_dir):
    score, tier = P.edge_quality(F.col("edge"), F.col("trust"), F.col("volatility"), F.col("cld"))
    return pred(spark, sf_dir).select(*M.TIE, r(score, "score", 6), tier.alias("tier"), r(P.stake(F.col("edge"), F.col("trust"), tier), "stake", 6))


@query("d06_market_rules", PRED + f" SELECT league, {RULES} AS market, CAST(count(*) AS BIGINT) AS n FROM pred GROUP BY ALL")
def d06(spark, sf_dir):
    return pred(spark, sf_dir).groupBy("league", K.market_rules().alias("market")).agg(F.count("*").alias("n"))


@query("a10_hit_rates", PRED + f", m AS (SELECT *, {RULES} AS market FROM pred), h AS (SELECT *, {HIT} AS hit FROM m) SELECT league, market, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END), 6) AS hit_rate FROM h GROUP BY ALL")
def a10(spark, sf_dir):
    hit = pred(spark, sf_dir).withColumn("market", K.market_rules()).withColumn("hit", K.market_hit())
    return hit.groupBy("league", "market").agg(F.count("*").alias("n"), r(F.avg(F.col("hit").cast("double")), "hit_rate", 6))


@query("d11_reason_tags", PRED + f""", m AS (SELECT *, {RULES} AS market FROM pred), h AS (SELECT *, {HIT} AS hit FROM m), x AS (SELECT league, list_filter([CASE WHEN hit THEN 'hit' END,
 CASE WHEN NOT hit AND (market LIKE 'Over %' OR market = 'BTTS') THEN 'goals_market_miss' END, CASE WHEN NOT hit AND hg = ag THEN 'missed_draw' END, CASE WHEN NOT hit AND hg < ag THEN 'away_upset_or_home_bias' END, CASE WHEN NOT hit AND hg > ag THEN 'home_win_underestimated' END,
 CASE WHEN NOT hit AND coalesce(conf, 0) < 0.8e0 THEN 'low_source_confidence' END, CASE WHEN NOT hit AND (hy IS NULL OR hc IS NULL) THEN 'missing_cards_corners' END,
 CASE WHEN NOT hit AND hy IS NOT NULL AND hc + coalesce(ac, 0) >= exp_corners + 3 THEN 'corners_underestimation' WHEN NOT hit AND hy IS NOT NULL AND hc + coalesce(ac, 0) <= exp_corners - 3 THEN 'corners_overestimation' END,
 CASE WHEN NOT hit AND hc IS NOT NULL AND hy + coalesce(ay, 0) >= exp_cards + 2 THEN 'card_spike_or_referee_distortion' WHEN NOT hit AND hc IS NOT NULL AND hy + coalesce(ay, 0) <= exp_cards - 2 THEN 'cards_overestimation' END, CASE WHEN NOT hit AND edge <= 0 THEN 'no_positive_edge' END, CASE WHEN NOT hit AND trust >= 70 THEN 'high_confidence_miss' END], lambda t: t IS NOT NULL) AS tags FROM h),
 y AS (SELECT league, unnest(CASE WHEN len(tags) = 0 THEN ['unclassified_miss'] ELSE tags END) AS tag FROM x) SELECT league, tag, CAST(count(*) AS BIGINT) AS n FROM y GROUP BY ALL""")
def d11(spark, sf_dir):
    hit = pred(spark, sf_dir).withColumn("market", K.market_rules()).withColumn("hit", K.market_hit())
    return hit.select("league", F.explode(K.reason_tags()).alias("tag")).groupBy("league", "tag").agg(F.count("*").alias("n"))


@query("t04_tickets", PRED + f""", c AS (SELECT *, {RULES} AS market, round(least(greatest(trust, 1e0), 100e0) * 0.45e0 + least(1e0, p_btts) * 35e0 + least(1e0, coalesce(conf, 0.5e0)) * 15e0 + least(0.5e0, greatest(edge, 0e0)) * 20e0, 2) AS score FROM pred),
 d AS (SELECT *, row_number() OVER (PARTITION BY league, match_date ORDER BY score DESC, ok, ln, pk, sk) AS i FROM c),
 g AS (SELECT league, match_date, list(struct_pack(i := i, h := home, a := away) ORDER BY i) AS xs FROM d GROUP BY ALL HAVING count(*) >= 2),
 t AS (SELECT league, match_date, list_reduce(xs, lambda acc, x: CASE WHEN len(acc) < 3 AND len(list_filter(acc, lambda y: y.h IN (x.h, x.a) OR y.a IN (x.h, x.a))) = 0 THEN list_append(acc, x) ELSE acc END, CAST([] AS STRUCT(i BIGINT, h VARCHAR, a VARCHAR)[])) AS legs FROM g)
 SELECT league, match_date, CAST(len(legs) AS INT) AS n_legs, array_to_string(list_transform(legs, lambda y: concat(y.h, '-', y.a)), ',') AS legs FROM t""")
def t04(spark, sf_dir):
    """Greedy legs of each league and day: best score first, no team twice, at most three."""
    score = F.round(F.least(F.greatest("trust", F.lit(1.0)), F.lit(100.0)) * 0.45 + F.least(F.lit(1.0), F.col("p_btts")) * 35.0 + F.least(F.lit(1.0), F.coalesce("conf", F.lit(0.5))) * 15.0 + F.least(F.lit(0.5), F.greatest("edge", F.lit(0.0))) * 20.0, 2)
    return K.tickets(pred(spark, sf_dir).withColumn("score", score), ["league", "match_date"], 3)


@query("a21_outcome_metrics", ctes("scored") + """, n AS (SELECT grp, ftr, p_h / (p_h + p_d + p_a) AS h, p_d / (p_h + p_d + p_a) AS d, p_a / (p_h + p_d + p_a) AS a FROM scored),
 m AS (SELECT *, CASE WHEN h >= d AND h >= a THEN 'H' WHEN d >= a THEN 'D' ELSE 'A' END AS pick, CASE ftr WHEN 'H' THEN h WHEN 'D' THEN d ELSE a END AS own FROM n)
 SELECT grp, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN pick = ftr THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(-avg(ln(greatest(own, 1e-6))), 6) AS log_loss,
 round(avg(power(h - CASE WHEN ftr = 'H' THEN 1 ELSE 0 END, 2) + power(d - CASE WHEN ftr = 'D' THEN 1 ELSE 0 END, 2) + power(a - CASE WHEN ftr = 'A' THEN 1 ELSE 0 END, 2)), 6) AS brier,
 round(coalesce(avg(CASE WHEN ftr = 'D' THEN CASE WHEN pick = 'D' THEN 1e0 ELSE 0e0 END END), 0e0), 6) AS draw_recall FROM m GROUP BY grp""")
def a21(spark, sf_dir):
    return K.outcome_metrics(frame(spark, sf_dir, "scored"), "grp")


@query("a22_calibration", ctes("scored") + """, c AS (SELECT grp, y, least(greatest(p, 1e-6), 1 - 1e-6) AS p FROM scored), b AS (SELECT grp, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS ap, avg(y) AS ay FROM c GROUP BY ALL),
 e AS (SELECT grp, sum(n * abs(ap - ay)) / sum(n) AS ece FROM b GROUP BY grp), l AS (SELECT grp, count(*) AS n, avg(power(p - y, 2)) AS brier, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS ll FROM c GROUP BY grp)
 SELECT l.grp, CAST(l.n AS BIGINT) AS n, round(brier, 6) AS brier, round(ll, 6) AS log_loss, round(ece, 6) AS ece, round(least(1e0, greatest(0e0, 0.65e0 * least(1e0, greatest(0e0, (0.3e0 - brier) / 0.16e0)) + 0.35e0 * least(1e0, greatest(0e0, 1 - ece / 0.16e0)))), 6) AS quality FROM l JOIN e ON l.grp = e.grp""")
def a22(spark, sf_dir):
    m = K.line_metrics(frame(spark, sf_dir, "scored"), "grp")
    return m.withColumn("quality", P.metric_quality(F.col("brier"), F.col("ece"))).select("grp", "n", *[r(F.col(c), c, 6) for c in ("brier", "log_loss", "ece", "quality")])


@query("a14_team_means", CANON + """, l AS (SELECT league, avg(hg) AS lh, avg(ag) AS la FROM canon GROUP BY 1), h AS (SELECT league, home AS team, avg(hg) AS hf, avg(ag) AS ha FROM canon GROUP BY ALL), a AS (SELECT league, away AS team, avg(ag) AS af, avg(hg) AS aa FROM canon GROUP BY ALL)
 SELECT coalesce(h.league, a.league) AS league, coalesce(h.team, a.team) AS team, round(coalesce(hf, lh), 6) AS home_for, round(coalesce(ha, la), 6) AS home_against, round(coalesce(af, la), 6) AS away_for, round(coalesce(aa, lh), 6) AS away_against
 FROM h FULL JOIN a ON h.league = a.league AND h.team = a.team JOIN l ON l.league = coalesce(h.league, a.league)""")
def a14(spark, sf_dir):
    return K.team_means(canon(spark, sf_dir)).select("league", "team", *[r(F.col(c), c, 6) for c in ("home_for", "home_against", "away_for", "away_against")])


@query("a16_dispersion", CANON + """, v AS (SELECT league, CAST(hc + ac AS DOUBLE) AS x FROM canon WHERE hc IS NOT NULL), s AS (SELECT league, count(*) AS n, avg(x) AS mu, var_samp(x) AS va FROM v GROUP BY 1)
 SELECT league, CAST(n AS BIGINT) AS n, round(mu, 6) AS mu, round(CASE WHEN n >= 30 AND mu > 0 AND va > mu THEN least(80e0, greatest(1.2e0, mu * mu / greatest(1e-6, va - mu))) END, 6) AS dispersion FROM s""")
def a16(spark, sf_dir):
    rows = canon(spark, sf_dir).filter("hc is not null").select("league", (F.col("hc") + F.col("ac")).cast("double").alias("x"))
    return K.dispersion(rows, "league", "x").select("league", "n", r(F.col("mu"), "mu", 6), r(F.col("dispersion"), "dispersion", 6))


@query("m04_count_model", CANON + """, l AS (SELECT league, avg(hg) AS lh, avg(ag) AS la FROM canon GROUP BY 1), h AS (SELECT league, home AS team, avg(hg) AS hf, avg(ag) AS ha FROM canon GROUP BY ALL), a AS (SELECT league, away AS team, avg(ag) AS af, avg(hg) AS aa FROM canon GROUP BY ALL),
 x AS (SELECT c.league, c.ok, c.ln, c.pk, c.sk, 0.5e0 * h.hf + 0.3e0 * a.aa + 0.2e0 * l.lh AS mh, 0.5e0 * a.af + 0.3e0 * h.ha + 0.2e0 * l.la AS ma FROM canon c JOIN l ON c.league = l.league JOIN h ON h.league = c.league AND h.team = c.home JOIN a ON a.league = c.league AND a.team = c.away)
 SELECT league, ok, ln, pk, sk, round(mh, 6) AS home_mu, round(ma, 6) AS away_mu, round(1 - exp(-(mh + ma)) * (1 + (mh + ma) + power(mh + ma, 2) / 2), 6) AS over25 FROM x""")
def m04(spark, sf_dir):
    """Expected goals from team and league means, and the over line of their sum."""
    c = canon(spark, sf_dir)
    out = K.expected_goals(c, K.team_means(c))
    return out.select("league", *M.TIE, r(F.col("home_mu"), "home_mu", 6), r(F.col("away_mu"), "away_mu", 6), r(P.poisson_over(2.5, F.col("home_mu") + F.col("away_mu")), "over25", 6))


@query("a24_count_metrics", CANON + """, e AS (SELECT league, CAST(hg + ag AS DOUBLE) AS y, avg(hg + ag) OVER (PARTITION BY league, home) AS p FROM canon) SELECT league, CAST(count(*) AS BIGINT) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg(power(p - y, 2))), 6) AS rmse FROM e GROUP BY league""")
def a24(spark, sf_dir):
    e = canon(spark, sf_dir).select("league", (F.col("hg") + F.col("ag")).cast("double").alias("y"), F.avg(F.col("hg") + F.col("ag")).over(Window.partitionBy("league", "home")).alias("p"))
    d = F.col("p") - F.col("y")
    return e.groupBy("league").agg(F.count("*").alias("n"), r(F.avg(F.abs(d)), "mae", 6), r(F.sqrt(F.avg(d * d)), "rmse", 6))


@query("a27_majority", ctes("contests") + f", f AS (SELECT league, {FTR} AS ftr, count(*) AS n FROM contests GROUP BY ALL) SELECT league, round(max(n) / sum(n), 9) AS baseline FROM f GROUP BY league")
def a27(spark, sf_dir):
    counted = contests(spark, sf_dir).groupBy("league", P.outcome(F.col("hg"), F.col("ag")).alias("ftr")).agg(F.count("*").alias("n"))
    return counted.groupBy("league").agg(r(F.max("n") / F.sum("n"), "baseline"))


@query("w12_odds_snapshots", ctes("odds_log") + """, s AS (SELECT match_key, arg_min(odd, ts) AS opening, arg_max(odd, ts) AS closing, count(*) AS n FROM odds_log GROUP BY match_key)
 SELECT match_key, CAST(n AS BIGINT) AS n, round(opening, 6) AS opening, round(closing, 6) AS closing, round(least(0.99e0, greatest(0.01e0, 1 / opening)) - least(0.99e0, greatest(0.01e0, 1 / closing)), 9) AS line_delta, round((match_key % 60 + 20) / 100e0 - least(0.99e0, greatest(0.01e0, 1 / closing)), 9) AS clv FROM s""")
def w12(spark, sf_dir):
    s = frame(spark, sf_dir, "odds_log").groupBy("match_key").agg(F.min_by("odd", "ts").alias("o"), F.max_by("odd", "ts").alias("c"), F.count("*").alias("n"))
    return s.select("match_key", "n", r(F.col("o"), "opening", 6), r(F.col("c"), "closing", 6), r(P.line_delta(F.col("o"), F.col("c")), "line_delta"), r(P.closing_value((F.col("match_key") % 60 + 20) / 100.0, F.col("c")), "clv"))


@query("a12_clv_summary", PRED + f""", m AS (SELECT *, {RULES} AS market FROM pred), h AS (SELECT *, {HIT} AS hit FROM m) SELECT market, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END), 6) AS hit_rate,
 round(avg(CASE WHEN cld > 0 THEN CASE WHEN hit THEN 1e0 ELSE 0e0 END END), 6) AS hit_rate_clv, round(sum(CASE WHEN hit THEN edge ELSE -edge END), 6) AS pnl FROM h GROUP BY market""")
def a12(spark, sf_dir):
    hit = pred(spark, sf_dir).withColumn("market", K.market_rules()).withColumn("hit", K.market_hit())
    one = F.col("hit").cast("double")
    return hit.groupBy("market").agg(F.count("*").alias("n"), r(F.avg(one), "hit_rate", 6), r(F.avg(F.when(F.col("cld") > 0, one)), "hit_rate_clv", 6), r(F.sum(F.when(F.col("hit"), F.col("edge")).otherwise(-F.col("edge"))), "pnl", 6))


@query("m02_temperature", ctes("scored") + """, g AS (SELECT 0.7e0 + i * 0.05e0 AS t FROM range(47) r(i)), x AS (SELECT grp, t, p_h, p_d, p_a, ftr FROM scored, g), y AS (SELECT grp, t, power(p_h, 1 / t) AS h, power(p_d, 1 / t) AS d, power(p_a, 1 / t) AS a, ftr FROM x),
 l AS (SELECT grp, t, round(-avg(ln(CASE ftr WHEN 'H' THEN h WHEN 'D' THEN d ELSE a END / (h + d + a))), 9) AS ll FROM y GROUP BY ALL) SELECT grp, round(t, 2) AS temperature, ll AS log_loss FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ll, t) AS r FROM l) WHERE r = 1""")
def m02(spark, sf_dir):
    """Grid search: the grid is 47 constants, exploded in the projection and aggregated at once."""
    grid = F.explode(F.array(*[F.lit(0.7 + i * 0.05) for i in range(47)]))
    x = frame(spark, sf_dir, "scored").select("grp", "ftr", "p_h", "p_d", "p_a", grid.alias("t"))
    h, d, a = (F.pow(c, 1 / F.col("t")) for c in ("p_h", "p_d", "p_a"))
    own = F.when(F.col("ftr") == "H", h).when(F.col("ftr") == "D", d).otherwise(a)
    loss = x.groupBy("grp", "t").agg(F.round(-F.avg(F.log(own / (h + d + a))), 9).alias("ll"))
    return loss.groupBy("grp").agg(F.min(F.struct("ll", "t")).alias("m")).select("grp", r(F.col("m.t"), "temperature", 2), F.col("m.ll").alias("log_loss"))
