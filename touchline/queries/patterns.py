"""Post-match patterns, rationale drivers and league profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import patterns as P
from touchline.operators import matches as M
from touchline.queries.markets import PRED, pred
from touchline.queries.quality import CANON, canon
from touchline.registry import query

#: The test tables hold no shots on target, possession, big chances and fouls: columns derived from keys stand in.
_STATS = {
    "as": "aws", "hst": "greatest(0, hs - ok % 8)", "ast": "greatest(0, aws - pk % 8)", "hxg": "xg_h", "axg": "xg_a", "hbc": "CASE WHEN sk % 13 > 0 THEN pk % 4 END", "abc": "ok % 4",
    "hf": "CASE WHEN sk % 13 > 0 THEN pk % 15 + 5 END", "af": "ok % 15 + 5", "hposs": "CASE WHEN sk % 13 > 0 THEN 30 + pk % 41 END", "aposs": "70 - pk % 41",
}
_T = "(hst IS NULL)::INT * 1 + (hs IS NULL)::INT + (aws IS NULL)::INT + (ast IS NULL)::INT + (hc IS NULL)::INT + (ac IS NULL)::INT + (hy IS NULL)::INT + (ay IS NULL)::INT"


def _side(home: str, away: str) -> str:
    return f"CASE WHEN {home} > {away} THEN 'home' ELSE 'away' END"


_D12 = f"""SELECT league, 'low_event_data_quality' AS pattern, 0.55e0 AS confidence, NULL AS side FROM st WHERE {_T} >= 4
 UNION ALL SELECT league, 'red_card_distortion', 0.92e0, NULL FROM st WHERE hr + ar > 0 UNION ALL SELECT league, 'cards_spike', 0.82e0, NULL FROM st WHERE hy + ay + 2 * (hr + ar) >= 6
 UNION ALL SELECT league, 'discipline_imbalance', 0.72e0, {_side('hy', 'ay')} FROM st WHERE abs(hy - ay) >= 3 UNION ALL SELECT league, 'set_piece_pressure', 0.78e0, {_side('hc', 'ac')} FROM st WHERE abs(hc - ac) >= 4
 UNION ALL SELECT league, 'high_corner_environment', 0.7e0, NULL FROM st WHERE hc + ac >= 12 UNION ALL SELECT league, 'shot_on_target_dominance', 0.8e0, {_side('hst', 'ast')} FROM st WHERE abs(hst - ast) >= 3
 UNION ALL SELECT league, 'home_finishing_outperformed_pressure', 0.66e0, NULL FROM st WHERE hg > ag AND hst <= ast UNION ALL SELECT league, 'away_finishing_outperformed_pressure', 0.66e0, NULL FROM st WHERE ag > hg AND ast <= hst
 UNION ALL SELECT league, 'territory_shot_volume_dominance', 0.68e0, {_side('hs', 'aws')} FROM st WHERE abs(hs - aws) >= 7 UNION ALL SELECT league, 'low_shot_quality', 0.7e0, NULL FROM st WHERE hs + aws >= 22 AND hst + ast <= 6
 UNION ALL SELECT league, 'possession_control', 0.62e0, {_side('hposs', 'aposs')} FROM st WHERE abs(hposs - aposs) >= 18 UNION ALL SELECT league, 'home_finishing_variance', 0.76e0, NULL FROM st WHERE hg >= hxg + 1.2e0
 UNION ALL SELECT league, 'away_finishing_variance', 0.76e0, NULL FROM st WHERE ag >= axg + 1.2e0 UNION ALL SELECT league, 'home_xg_underperformance', 0.74e0, NULL FROM st WHERE hxg >= axg + 0.8e0 AND hg <= ag
 UNION ALL SELECT league, 'away_xg_underperformance', 0.74e0, NULL FROM st WHERE axg >= hxg + 0.8e0 AND ag <= hg UNION ALL SELECT league, 'big_chance_gap', 0.74e0, {_side('hbc', 'abc')} FROM st WHERE abs(hbc - abc) >= 2
 UNION ALL SELECT league, 'foul_pressure_imbalance', 0.6e0, {_side('hf', 'af')} FROM st WHERE abs(hf - af) >= 7"""


@query("d12_match_patterns", CANON + ", st AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in _STATS.items() if c != "as" and "greatest" not in e) + f""", CASE WHEN hs IS NOT NULL THEN {_STATS['hst']} END AS hst, CASE WHEN aws IS NOT NULL THEN {_STATS['ast']} END AS ast FROM canon),
 p AS ({_D12}) SELECT league, pattern, confidence, side, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL""")
def d12(spark, sf_dir):
    """Patterns of all matches, counted by league and side (the standard profile is covered by its own test)."""

    def stat(name: str):
        base = {"hst": "hs", "ast": "aws"}.get(name)
        found = F.expr(_STATS.get(name, name))
        return found if base is None else F.when(F.col(base).isNotNull(), found)

    tags = canon(spark, sf_dir).select("league", F.explode(P.match_patterns(stat)).alias("t")).select("league", "t.*").filter("pattern <> 'standard_match_profile'")
    return tags.groupBy("league", "pattern", "confidence", "side").agg(F.count("*").alias("n"))


_DRIVERS = PRED + """, dv AS (SELECT *, (80 + ok % 41) / 100e0 AS mh, (80 + pk % 41) / 100e0 AS ma, pk % 90 AS press FROM pred), fs AS (SELECT *, list_filter([CASE WHEN p_h > 0.65e0 THEN 'High Home Win Probability' WHEN p_h > 0.4e0 THEN 'Home Win Lean' END, CASE WHEN p_a > 0.65e0 THEN 'Strong Away Dominance' WHEN p_a > 0.4e0 THEN 'Away Win Lean' END,
 CASE WHEN p_d > 0.38e0 THEN 'Elevated Draw Probability' WHEN p_d > 0.25e0 THEN 'Tactical Stalemate Risk' END, CASE WHEN p_o25 > 0.68e0 THEN 'High Scoring Potential (O2.5)' WHEN p_o25 > 0.55e0 THEN 'Attacking Overload Expected' END, CASE WHEN p_btts > 0.6e0 THEN 'Both Teams Scoring Likelihood' END,
 CASE WHEN press > 65 THEN concat('Critical Motivation: ', CASE WHEN sk % 2 = 0 THEN profile ELSE 'High Pressure' END) WHEN press > 35 THEN 'Significant Match Pressure' END], lambda x: x IS NOT NULL) AS a FROM dv),
 al AS (SELECT league, ok, ln, pk, sk, greatest(p_h, p_d, p_a) AS top, list_concat(CASE WHEN len(a) = 0 THEN ['Standard Match Profile'] ELSE a END, list_filter([CASE WHEN mh >= 1.1e0 THEN 'Home_Momentum_Spike' END, CASE WHEN ma >= 1.1e0 THEN 'Away_Momentum_Spike' END, CASE WHEN abs(mh - ma) >= 0.15e0 THEN 'Significant Momentum Imbalance' END,
 CASE WHEN sk % 4 = 0 THEN 'Deep Set-Piece Signal' END], lambda x: x IS NOT NULL)) AS d FROM fs)"""


def drivers(spark, sf_dir):
    p = {k: F.col(f"p_{k}") for k in ("h", "d", "a", "o25", "btts")}
    momentum = (80 + F.col("ok") % 41) / 100.0, (80 + F.col("pk") % 41) / 100.0
    label = F.when(F.col("sk") % 2 == 0, F.col("profile"))
    return pred(spark, sf_dir).withColumn("d", P.rationale(p, F.col("pk") % 90, label, momentum, F.col("sk") % 4 == 0))


@query("d13_rationale", _DRIVERS + " SELECT ok, ln, pk, sk, array_to_string(d[1:4], '; ') AS top_drivers, d[1] AS primary_signal, CASE WHEN top > 0.6e0 THEN 'High' ELSE 'Medium' END AS confidence FROM al")
def d13(spark, sf_dir):
    sure = F.when(F.greatest("p_h", "p_d", "p_a") > 0.6, "High").otherwise("Medium")
    return drivers(spark, sf_dir).select(*M.TIE, F.array_join(F.slice("d", 1, 4), "; ").alias("top_drivers"), F.col("d")[0].alias("primary_signal"), sure.alias("confidence"))


@query("t05_top_drivers", _DRIVERS + ", u AS (SELECT league, unnest(d[1:4]) AS driver FROM al) SELECT league, driver, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY ALL")
def t05(spark, sf_dir):
    """How often each driver is among the first four."""
    return drivers(spark, sf_dir).select("league", F.explode(F.slice("d", 1, 4)).alias("driver")).groupBy("league", "driver").agg(F.count("*").alias("n"))


_NAMED = "CASE league WHEN 'EUROPE' THEN 'PremierLeague' WHEN 'ASIA' THEN 'SerieA' WHEN 'AMERICA' THEN 'LaLiga' ELSE league END"


@query("d15_league_profiles", CANON + f""", rp AS (SELECT {_NAMED} AS league, CAST(count(*) AS BIGINT) AS n FROM canon GROUP BY 1), pf(league, tempo, directness, pressing, set_piece_weight, card_pressure, goal_total_prior, corner_total_prior, card_total_prior, style_label) AS (VALUES
 ('PremierLeague', 0.7e0, 0.72e0, 0.66e0, 0.72e0, 0.54e0, 2.78e0, 10.1e0, 4.05e0, 'direct transition / set-piece heavy'), ('SerieA', 0.44e0, 0.42e0, 0.48e0, 0.56e0, 0.68e0, 2.48e0, 9.2e0, 4.65e0, 'structured / tactical control'), ('LaLiga', 0.46e0, 0.45e0, 0.58e0, 0.55e0, 0.72e0, 2.42e0, 9.15e0, 4.85e0, 'structured build-up / higher discipline variance'))
 SELECT rp.league, n, coalesce(tempo, 0.5e0) AS tempo, coalesce(directness, 0.5e0) AS directness, coalesce(pressing, 0.5e0) AS pressing, coalesce(set_piece_weight, 0.5e0) AS set_piece_weight, coalesce(card_pressure, 0.5e0) AS card_pressure, coalesce(goal_total_prior, 2.6e0) AS goal_total_prior, coalesce(corner_total_prior, 9.6e0) AS corner_total_prior, coalesce(card_total_prior, 4.2e0) AS card_total_prior, coalesce(style_label, 'balanced') AS style_label
 FROM rp LEFT JOIN pf ON pf.league = rp.league""")
def d15(spark, sf_dir):
    """A report by league with the leagues' profiles (J22); unknown leagues carry the default one."""
    report = canon(spark, sf_dir).groupBy(F.expr(_NAMED).alias("league")).agg(F.count("*").alias("n"))
    return P.with_profiles(report)
