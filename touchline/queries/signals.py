"""Blends, signals, labels and display reports over predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.bindings import ctes, frame
from touchline.functions import prob as P
from touchline.operators import matches as M
from touchline.queries.markets import PRED, RULES, pred, r
from touchline.queries.quality import CANON, SIDES, canon
from touchline.registry import query


@query("f40_market_drift", CANON + """, m AS (SELECT ok, ln, pk, sk, [1 / odds_h, 1 / odds_d, 1 / odds_a] AS b, [1 / (odds_h * (1 + (ok % 7 - 3) / 20e0)), 1 / odds_d, 1 / (odds_a * (1 + (pk % 7 - 3) / 20e0))] AS a FROM canon WHERE odds_h IS NOT NULL AND odds_d IS NOT NULL AND odds_a IS NOT NULL),
 d AS (SELECT *, (abs(a[1] - b[1]) + abs(a[2] - b[2]) + abs(a[3] - b[3])) / 3 AS drift, list_position(a, list_max(a)) AS f FROM m)
 SELECT ok, ln, pk, sk, round(drift, 9) AS drift, CASE WHEN drift > 0.05e0 THEN 'Volatile (Smart Money Move)' WHEN drift > 0.02e0 THEN 'Correcting' ELSE 'Stable' END AS status, CASE WHEN a[f] - b[f] > 0.01e0 THEN 'Follow' ELSE 'Fading' END AS signal FROM d""")
def f40(spark, sf_dir):
    """Opening odds against current ones (the opening ones moved by up to 15 %), where all three are known."""
    moved = lambda odd, key: F.col(odd) * (1 + (F.col(key) % 7 - 3) / 20.0)
    drift, status, signal = P.market_drift([F.col("odds_h"), F.col("odds_d"), F.col("odds_a")], [moved("odds_h", "ok"), F.col("odds_d"), moved("odds_a", "pk")])
    return canon(spark, sf_dir).dropna(subset=["odds_h", "odds_d", "odds_a"]).select(*M.TIE, r(drift, "drift"), status.alias("status"), signal.alias("signal"))


@query("f42_blend", PRED + """, t AS (SELECT ok, ln, pk, sk, 0.8e0 * p_h + 0.2e0 * p_o25 AS h, 0.8e0 * p_d + 0.2e0 * 0.25e0 AS d, 0.8e0 * p_a + 0.2e0 * p_btts AS a FROM pred),
 c AS (SELECT *, least(0.94e0, greatest(0.03e0, h)) AS ch, least(0.94e0, greatest(0.03e0, d)) AS cd, least(0.94e0, greatest(0.03e0, a)) AS ca FROM t) SELECT ok, ln, pk, sk, round(ch / (ch + cd + ca), 9) AS p_h, round(cd / (ch + cd + ca), 9) AS p_d, round(ca / (ch + cd + ca), 9) AS p_a FROM c""")
def f42(spark, sf_dir):
    """Weighted blend of two three-way distributions, clipped to [0.03, 0.94] and renormalised."""
    other = [F.col("p_o25"), F.lit(0.25), F.col("p_btts")]
    mixed = [P.clip(0.8 * F.col(c) + 0.2 * o, 0.03, 0.94) for c, o in zip(("p_h", "p_d", "p_a"), other, strict=True)]
    total = mixed[0] + mixed[1] + mixed[2]
    return pred(spark, sf_dir).select(*M.TIE, *[r(x / total, n) for x, n in zip(mixed, ("p_h", "p_d", "p_a"), strict=True)])


@query("m03_blend_weight", ctes("scored") + """, g AS (SELECT i * 0.01e0 AS w FROM range(36) t(i)), x AS (SELECT grp, w, ftr, (1 - w) * p_h / (p_h + p_d + p_a) + w / 3e0 AS h, (1 - w) * p_d / (p_h + p_d + p_a) + w / 3e0 AS d, (1 - w) * p_a / (p_h + p_d + p_a) + w / 3e0 AS a FROM scored, g),
 l AS (SELECT grp, w, round(-avg(ln(CASE ftr WHEN 'H' THEN h WHEN 'D' THEN d ELSE a END)), 9) AS ll FROM x GROUP BY ALL) SELECT grp, round(w, 2) AS weight, ll AS log_loss FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ll, w) AS k FROM l) WHERE k = 1""")
def m03(spark, sf_dir):
    x = frame(spark, sf_dir, "scored").withColumn("w", F.explode(F.array(*[F.lit(i * 0.01) for i in range(36)])))
    own = F.when(F.col("ftr") == "H", F.col("p_h")).when(F.col("ftr") == "D", F.col("p_d")).otherwise(F.col("p_a")) / (F.col("p_h") + F.col("p_d") + F.col("p_a"))
    loss = x.groupBy("grp", "w").agg(F.round(-F.avg(F.log((1 - F.col("w")) * own + F.col("w") / 3.0)), 9).alias("ll"))
    return loss.groupBy("grp").agg(F.min(F.struct("ll", "w")).alias("m")).select("grp", r(F.col("m.w"), "weight", 2), F.col("m.ll").alias("log_loss"))


@query("d07_router", PRED + f""", c AS (SELECT match_date, ok, ln, pk, sk, {RULES} AS primary_market, unnest([struct_pack(m := 'Home Win', p := p_h, s := 0.42e0), struct_pack(m := 'Away Win', p := p_a, s := 0.42e0), struct_pack(m := 'Over 2.5', p := p_o25, s := 0.62e0), struct_pack(m := 'BTTS', p := p_btts, s := 0.62e0)]) AS x FROM pred),
 e AS (SELECT ok, ln, pk, sk, primary_market, x.m AS market, round(x.p - x.s, 9) AS score, row_number() OVER (PARTITION BY match_date, ok, ln, pk, sk ORDER BY round(x.p - x.s, 9) DESC, x.m) AS k FROM c WHERE x.p >= x.s)
 SELECT ok, ln, pk, sk, market AS routed, score, CASE WHEN market = primary_market THEN 'keep' ELSE 'promote' END AS action FROM e WHERE k = 1""")
def d07(spark, sf_dir):
    """Candidate markets above their gates, ranked in the row itself: no shuffle."""
    from touchline.operators.markets import market_rules

    gates = {"Home Win": ("p_h", 0.42), "Away Win": ("p_a", 0.42), "Over 2.5": ("p_o25", 0.62), "BTTS": ("p_btts", 0.62)}
    items = [F.when(F.col(p) >= g, F.struct((-F.round(F.col(p) - g, 9)).alias("s"), F.lit(m).alias("m"))) for m, (p, g) in gates.items()]
    best = F.try_element_at(F.array_sort(F.array_compact(F.array(*items))), F.lit(1))
    routed = pred(spark, sf_dir).withColumn("b", best).filter("b is not null")
    return routed.select(*M.TIE, F.col("b.m").alias("routed"), (-F.col("b.s")).alias("score"), F.when(F.col("b.m") == market_rules(), "keep").otherwise("promote").alias("action"))


@query("d12_patterns", CANON + """, t AS (SELECT league, unnest(list_filter([CASE WHEN hg + ag >= 5 THEN 'goal_fest' END, CASE WHEN hg + ag = 0 THEN 'goalless' END, CASE WHEN abs(hg - ag) >= 3 THEN 'one_sided' END, CASE WHEN hc + ac >= 14 THEN 'corner_storm' END, CASE WHEN hy + ay >= 6 THEN 'card_spike' END,
 CASE WHEN hr + ar > 0 THEN 'red_card' END, CASE WHEN hg = ag AND hs > 2 * aws THEN 'wasted_dominance' END], lambda x: x IS NOT NULL)) AS tag FROM canon) SELECT league, tag, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY ALL""")
def d12(spark, sf_dir):
    g, c = F.col("hg") + F.col("ag"), F.col
    tags = F.array_compact(F.array(F.when(g >= 5, "goal_fest"), F.when(g == 0, "goalless"), F.when(F.abs(c("hg") - c("ag")) >= 3, "one_sided"), F.when(c("hc") + c("ac") >= 14, "corner_storm"), F.when(c("hy") + c("ay") >= 6, "card_spike"), F.when(c("hr") + c("ar") > 0, "red_card"), F.when((c("hg") == c("ag")) & (c("hs") > 2 * c("aws")), "wasted_dominance")))
    return canon(spark, sf_dir).select("league", F.explode(tags).alias("tag")).groupBy("league", "tag").agg(F.count("*").alias("n"))


@query("d18_labels", CANON + """, v AS (SELECT league, match_date, home AS team, 1 AS at_home, hc AS co, hy AS ca, ok, ln, pk, sk FROM canon UNION ALL SELECT league, match_date, away, 0, ac, ay, ok, ln, pk, sk FROM canon),
 f AS (SELECT match_date, ok, ln, pk, sk, at_home, avg(co) OVER w AS co5, avg(ca) OVER w AS ca5 FROM v WINDOW w AS (PARTITION BY league, team ORDER BY match_date, ok, ln, pk, sk, at_home ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
 SELECT c.ok, c.ln, c.pk, c.sk, CASE WHEN hg > ag THEN 0 WHEN hg = ag THEN 1 ELSE 2 END AS y_1x2, CAST(hg > 0 AND ag > 0 AS INT) AS y_btts, CAST(hg + ag > 1 AS INT) AS y_o15, CAST(hg + ag > 2 AS INT) AS y_o25, CAST(hg + ag > 3 AS INT) AS y_o35,
 round(coalesce(CAST(hc + ac AS DOUBLE), h.co5 + a.co5, -1e0), 6) AS y_corners, round(coalesce(CAST(hy + ay AS DOUBLE), h.ca5 + a.ca5, -1e0), 6) AS y_cards FROM canon c
 JOIN f h ON h.ok = c.ok AND h.ln = c.ln AND h.pk = c.pk AND h.sk = c.sk AND h.match_date = c.match_date AND h.at_home = 1 JOIN f a ON a.ok = c.ok AND a.ln = c.ln AND a.pk = c.pk AND a.sk = c.sk AND a.match_date = c.match_date AND a.at_home = 0""")
def d18(spark, sf_dir):
    """Training labels; missing counts fall back to the sum of both teams' five-match means, then to the mask -1."""
    return M.training_labels(canon(spark, sf_dir)).withColumns({"y_corners": F.round("y_corners", 6), "y_cards": F.round("y_cards", 6)})


@query("a33_league_page", PRED + """ SELECT league, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN trust >= 70 THEN 1 ELSE 0 END) AS BIGINT) AS trusted, CAST(sum(CASE WHEN cld > 0.01e0 THEN 1 ELSE 0 END) AS BIGINT) AS sharp, round(avg(trust), 6) AS mean_trust,
 CASE WHEN avg(trust) >= 70 THEN 'high' WHEN avg(trust) >= 45 THEN 'medium' ELSE 'low' END AS tier FROM pred GROUP BY league""")
def a33(spark, sf_dir):
    t = F.avg("trust")
    return pred(spark, sf_dir).groupBy("league").agg(F.count("*").alias("n"), F.count_if(F.col("trust") >= 70).alias("trusted"), F.count_if(F.col("cld") > 0.01).alias("sharp"), r(t, "mean_trust", 6), F.when(t >= 70, "high").when(t >= 45, "medium").otherwise("low").alias("tier"))


@query("t03_three_orderings", PRED + """, s AS (SELECT league, match_date, ok, ln, row_number() OVER (PARTITION BY league ORDER BY trust DESC, p_btts DESC, ok, ln, pk, sk) AS safety, row_number() OVER (PARTITION BY league ORDER BY p_btts DESC, trust DESC, ok, ln, pk, sk) AS balance,
 row_number() OVER (PARTITION BY league ORDER BY edge DESC, trust DESC, ok, ln, pk, sk) AS value FROM pred) SELECT * FROM s WHERE safety <= 5 OR balance <= 5 OR value <= 5""")
def t03(spark, sf_dir):
    w = lambda *c: F.row_number().over(Window.partitionBy("league").orderBy(*[F.desc(x) for x in c], *M.TIE))
    return pred(spark, sf_dir).select("league", "match_date", "ok", "ln", w("trust", "p_btts").alias("safety"), w("p_btts", "trust").alias("balance"), w("edge", "trust").alias("value")).filter("safety <= 5 or balance <= 5 or value <= 5")


#: The chosen market's probability; the test rows' closing moves and edges are widened, so that all signs occur.
_CHOSEN = "CASE market WHEN 'Home Win' THEN p_h WHEN 'Away Win' THEN p_a WHEN 'Over 2.5' THEN p_o25 WHEN 'BTTS' THEN p_btts + 0.2e0 WHEN 'X2 (Double Chance)' THEN p_d + p_a ELSE p_h END"
_SIGNS = PRED + f""", m AS (SELECT *, {RULES} AS market, cld * 2 AS move FROM pred), q AS (SELECT *, {_CHOSEN} AS p FROM m),
 z AS (SELECT *, CAST(least(100, greatest(1, floor(trust + 0.5e0))) AS INT) AS score, (p >= 0.82e0 AND move > 0.03e0) OR (trust >= 78 AND p >= 0.68e0 AND move > 0.02e0 AND edge > 0.04e0) AS singular FROM q)"""


def _signs(spark, sf_dir):
    from touchline.operators.markets import market_rules

    rows = pred(spark, sf_dir).withColumn("market", market_rules()).withColumns({"move": F.col("cld") * 2, "p": F.expr(_CHOSEN.replace("e0", "D"))})
    score = P.trust_score(F.col("trust"))
    return rows.withColumn("score", score).withColumn("singular", P.singularity(F.col("p"), F.col("move"), F.col("edge"), F.col("score")))


@query("d14_badges", _SIGNS + """ SELECT ok, ln, pk, sk, score, CASE WHEN score >= 70 THEN 'HIGH TRUST' WHEN score >= 45 THEN 'PLAYABLE TRUST' WHEN score >= 25 THEN 'LOW TRUST' ELSE 'WATCHLIST' END AS tier,
 CASE WHEN move > 0.01e0 THEN 'Sharp Backing' WHEN move < -0.01e0 THEN 'Market Drift' ELSE 'Neutral Sentiment' END AS badge, singular FROM z""")
def d14(spark, sf_dir):
    return _signs(spark, sf_dir).select(*M.TIE, "score", P.trust_tier(F.col("score")).alias("tier"), P.sentiment_badge(F.col("move")).alias("badge"), "singular")


@query("a32_header_counts", _SIGNS + " SELECT league, CAST(count(*) AS BIGINT) AS games, CAST(count(*) FILTER (WHERE singular) AS BIGINT) AS singularities, CAST(count(*) FILTER (WHERE score >= 70) AS BIGINT) AS sharps FROM z GROUP BY league")
def a32(spark, sf_dir):
    return _signs(spark, sf_dir).groupBy("league").agg(F.count("*").alias("games"), F.count_if("singular").alias("singularities"), F.count_if(F.col("score") >= 70).alias("sharps"))
