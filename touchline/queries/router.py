"""The full market router over all matches, with metrics of each league's markets."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import matches as M
from touchline.operators import router as R
from touchline.operators.markets import market_rules
from touchline.queries.markets import PRED, RULES, pred
from touchline.registry import query

#: Stand-ins where the test tables hold no probability, price or trait: columns derived from keys.
COLUMNS = {
    "p_o15": "least(0.97e0, p_o25 + 0.2e0)", "p_o35": "p_o25 * 0.6e0", "p_c85": "CASE WHEN hc IS NULL THEN NULL ELSE (pk % 60 + 35) / 100e0 END", "p_c95": "(pk % 50 + 30) / 100e0", "p_c105": "(pk % 45 + 20) / 100e0",
    "p_k35": "CASE WHEN hy IS NULL THEN NULL ELSE (sk % 60 + 35) / 100e0 END", "p_k45": "(sk % 50 + 25) / 100e0", "p_k55": "(sk % 40 + 10) / 100e0", "set_piece_weight": "(pk % 10) / 10e0", "directness": "CASE WHEN sk % 3 = 0 THEN NULL ELSE (sk % 10) / 10e0 END",
    "card_pressure": "(ok % 10) / 10e0", "tempo": "(pk % 7) / 7e0", "match_pressure": "(ok % 90) * 1e0", "odds_over_2_5": "CASE WHEN pk % 4 = 0 THEN NULL ELSE 1.0e0 + (pk % 13) / 10e0 END",
}
#: Metric, probability, and what came of it.
JUDGED = [("goals_over_1.5", "p_o15", "hg + ag > 1"), ("goals_over_2.5", "p_o25", "hg + ag > 2"), ("goals_over_3.5", "p_o35", "hg + ag > 3"), ("btts", "p_btts", "hg > 0 AND ag > 0"), ("corners_over_8.5", "p_c85", "hc + ac > 8"), ("corners_over_9.5", "p_c95", "hc + ac > 9"), ("cards_over_3.5", "p_k35", "hy + ay > 3"), ("cards_over_4.5", "p_k45", "hy + ay > 4")]


def _twin() -> str:
    base = f"b AS (SELECT *, {RULES} AS base_primary, 'Under 3.5' AS base_secondary, {', '.join(f'{x} AS {c}' for c, x in COLUMNS.items())} FROM pred)"
    metrics = " UNION ALL ".join(f"SELECT league, '{m}' AS metric, avg(power({p} - CASE WHEN {y} THEN 1 ELSE 0 END, 2)) * 0.8e0 AS brier, abs(avg({p}) - avg(CASE WHEN {y} THEN 1e0 ELSE 0e0 END)) / 2 AS ece FROM b WHERE {p} IS NOT NULL AND ({y}) IS NOT NULL GROUP BY league" for m, p, y in JUDGED)
    rows = ", ".join(f"({k}, '{label}', '{family}', '{key}', {least}e0)" for k, (label, family, key, least, _) in enumerate(R.MARKETS))
    chance = " ".join(f"WHEN {k} THEN {'1e0 - ' if s[0] == '-' else ''}coalesce({s.lstrip('-')}, 0e0)" for k, (*_, s) in enumerate(R.MARKETS))
    number = lambda v: v if "e" in v else f"{v}e0"
    held = lambda x, a, b: f"least({number(b)}, greatest({number(a)}, {x}))"
    part = lambda c: f"({held(c, '1e-9', '1')} / tot)"
    return (
        f"{PRED}, {base}, me AS ({metrics}), co AS (SELECT league, 'corners' AS family, avg(CASE WHEN hc IS NOT NULL THEN 1e0 ELSE 0e0 END) AS share FROM pred GROUP BY 1 UNION ALL SELECT league, 'cards', avg(CASE WHEN hy IS NOT NULL THEN 1e0 ELSE 0e0 END) FROM pred GROUP BY 1),"
        f" mk AS (SELECT * FROM (VALUES {rows}) v(place, market, family, metric, least_p)),"
        f" t AS (SELECT *, {held('p_h', '1e-9', '1')} + {held('p_d', '1e-9', '1')} + {held('p_a', '1e-9', '1')} AS tot, row_number() OVER () AS id FROM b),"
        f" o AS (SELECT *, -({part('p_h')} * ln({part('p_h')}) + {part('p_d')} * ln({part('p_d')}) + {part('p_a')} * ln({part('p_a')})) / ln(3e0) AS entropy, list_sort([p_h, p_d, p_a], 'DESC')[1] - list_sort([p_h, p_d, p_a], 'DESC')[2] AS margin FROM t),"
        " x AS (SELECT o.*, mk.place, mk.market, mk.family, mk.least_p, entropy >= 0.94e0 OR margin <= 0.085e0 AS is_open, CASE mk.place " + chance + " END AS raw, coalesce(me.brier, 0.25e0) AS brier, coalesce(me.ece, 0.12e0) AS ece, CASE WHEN mk.family = 'goals' THEN 1e0 ELSE coalesce(co.share, 0e0) END AS cov FROM o CROSS JOIN mk LEFT JOIN me ON me.league = o.league AND me.metric = mk.metric LEFT JOIN co ON co.league = o.league AND co.family = mk.family),"
        f" y AS (SELECT *, {held('raw', '0.01', '0.99')} AS p, {held('1 - ece / 0.16e0', '0', '1')} AS cal, CASE WHEN market = 'Over 2.5' AND odds_over_2_5 > 1.01e0 THEN odds_over_2_5 END AS odds FROM x WHERE raw > 0),"
        f" z AS (SELECT *, {held('0.65e0 * ' + held('(0.30e0 - brier) / 0.16e0', '0', '1') + ' + 0.35e0 * cal', '0', '1')} AS q, greatest(0e0, p - least_p) AS gap, {held('''CASE WHEN is_open THEN 0.08e0 ELSE 0e0 END + CASE family WHEN 'corners' THEN greatest(0e0, coalesce(set_piece_weight, 0.5e0) - 0.55e0) * 0.20e0 + greatest(0e0, coalesce(directness, 0.5e0) - 0.60e0) * 0.08e0 WHEN 'cards' THEN greatest(0e0, coalesce(card_pressure, 0.5e0) - 0.55e0) * 0.25e0 + least(0.06e0, coalesce(match_pressure, 0e0) / 1000e0) ELSE greatest(0e0, coalesce(tempo, 0.5e0) - 0.62e0) * 0.10e0 END''', '0', '0.16')} AS bonus FROM y),"
        f" c AS (SELECT *, round({held('100e0 * (p * 0.42e0 + q * 0.20e0 + cov * 0.14e0 + cal * 0.10e0 + least(0.25e0, gap * 1.6e0) * 0.08e0 + bonus)', '1', '92')}, 1) AS score, round(p, 4) AS prob, round(greatest(0e0, coalesce(p - 1 / odds, gap * q * cov * 0.75e0)), 4) AS edge_c, CASE WHEN odds IS NOT NULL THEN 'market_odds' ELSE 'model_without_market_odds' END AS basis, p >= least_p AND (family = 'goals' OR cov >= 0.45e0) AND q >= 0.22e0 AND ece <= 0.14e0 AND brier <= 0.285e0 AS fit FROM z),"
        " r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fit DESC, score DESC, prob DESC, place) AS k FROM c),"
        " f AS (SELECT *, fit AND score >= CASE WHEN is_open THEN 58e0 ELSE 74e0 END AS chosen FROM r WHERE k = 1), s AS (SELECT *, CASE WHEN chosen THEN market ELSE base_primary END AS selected FROM f),"
        " u AS (SELECT r.id, arg_min(r.market, r.k) FILTER (WHERE r.market <> s.selected) AS second, string_agg(r.market, '|' ORDER BY r.k) FILTER (WHERE r.k <= 5) AS top FROM r JOIN s ON r.id = s.id GROUP BY r.id),"
        " w AS (SELECT s.*, u.second, u.top, CASE WHEN chosen THEN CASE WHEN basis = 'market_odds' THEN score ELSE least(score, 72e0) END ELSE 0e0 END AS trust_s FROM s JOIN u ON u.id = s.id)"
        " SELECT league, match_date, home, away, ok, ln, pk, sk, round(entropy, 4) AS entropy, round(margin, 4) AS margin, CASE WHEN is_open THEN CASE WHEN chosen THEN 'promote_event_market' ELSE 'keep_base_no_event_edge' END WHEN chosen THEN 'promote_strong_event_market' ELSE 'keep_base' END AS action, selected AS selected_market,"
        " CASE WHEN chosen THEN prob END AS selected_probability, coalesce(second, base_secondary) AS secondary_market, chosen AND market <> base_primary AS promoted, round(trust_s, 1) AS trust_score, CASE WHEN chosen THEN edge_c ELSE 0e0 END AS edge_value, CASE WHEN chosen THEN basis ELSE 'base_market' END AS edge_basis,"
        f" CASE WHEN chosen AND edge_c > 0 THEN round({held('(trust_s - 55e0) / 18e0', '0', '2')}, 1) ELSE 0e0 END AS stake_hint, top AS top_candidates FROM w"
    )


@query("d07_market_router", _twin())
def d07(spark, sf_dir):
    """All twelve candidates of every match with gates, second choice and stake hint (``d07_router`` has four gates of its own)."""
    rows = pred(spark, sf_dir).select("*", market_rules().alias("base_primary"), F.lit("Under 3.5").alias("base_secondary")).withColumns({c: F.expr(x.replace("e0", "D")) for c, x in COLUMNS.items()})
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(p).alias("p"), F.expr(y).alias("y")) for m, p, y in JUDGED])
    y = F.col("y").cast("int").cast("double")
    judged = rows.select("league", F.explode(parts).alias("x")).select("league", "x.*").filter("p is not null and y is not null")
    metrics = judged.groupBy("league", "metric").agg((F.avg(F.pow(F.col("p") - y, 2)) * 0.8).alias("brier"), (F.abs(F.avg("p") - F.avg(y)) / 2).alias("ece"))
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    coverage = rows.groupBy("league").agg(share("hc").alias("corners"), share("hy").alias("cards")).select("league", F.explode(F.create_map(F.lit("corners"), "corners", F.lit("cards"), "cards")).alias("family", "share"))
    found = R.route(rows, R.league_report(metrics, coverage), "base_primary", "base_secondary")
    names = ["entropy", "margin", "action", "selected_market", "selected_probability", "secondary_market", "promoted", "trust_score", "edge_value", "edge_basis", "stake_hint"]
    return found.select("league", "match_date", "home", "away", *M.TIE, *names, F.array_join("top_candidates", "|").alias("top_candidates"))
