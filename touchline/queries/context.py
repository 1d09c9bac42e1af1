"""The 36-column vector and the context multipliers of every match; ratings and reports are stand-ins derived from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import context as C
from touchline.operators import matches as M
from touchline.queries.quality import CANON, canon
from touchline.registry import query

RATING = {"hh": "(ok % 9 - 4) / 5e0", "ha": "(pk % 7 - 3) / 5e0", "ah": "(sk % 9 - 4) / 5e0", "aa": "(ok % 7 - 3) / 5e0"}
GAMES = "count(*) OVER (PARTITION BY league, {t} ORDER BY match_date RANGE BETWEEN INTERVAL 21 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"
KNOWN = {"mom_h": "conf", "sot_h": "hs / 2e0", "sot_a": "aws / 2e0", "corn_h": "hc", "corn_a": "ac", "ga_h": "xg_a", "ga_a": "xg_h"}


def _vector_twin() -> str:
    pm = lambda k, m: f"exp(-{m}) * power({m}, {k}) / {[1, 1, 2, 6, 24, 120, 720][k]}e0"
    ahead = lambda x, y: " + ".join(f"{pm(j, x)} * ({' + '.join(pm(k, y) for k in range(j))})" for j in range(1, 7))
    under = " + ".join(f"{pm(i, 'h')} * {pm(j, 'a')}" for i in range(3) for j in range(3) if i + j <= 2)
    known = lambda n, s: f"coalesce({KNOWN[f'{n}_{s}']}, {C.DEFAULTS[n]}e0)" if f"{n}_{s}" in KNOWN else f"{C.DEFAULTS[n]}e0"
    rating = ", ".join(f"{x} AS {n}" for n, x in RATING.items())
    base = f"b AS (SELECT *, {rating}, 1 / coalesce(odds_h, 2e0) AS ih, 1 / coalesce(odds_d, 3.2e0) AS id_, 1 / coalesce(odds_a, 3.5e0) AS ia FROM canon), c AS (SELECT *, greatest(0.1e0, (1.3e0 + (hh - aa)) * 1.08e0) AS h, greatest(0.1e0, 1.1e0 + (ah - ha)) AS a, ih / (ih + id_ + ia) AS imp_h, id_ / (ih + id_ + ia) AS imp_d, ia / (ih + id_ + ia) AS imp_a FROM b), d AS (SELECT *, {ahead('h', 'a')} AS p_h, {ahead('a', 'h')} AS p_a FROM c)"
    made = {"exp_h": "h", "exp_a": "a", "exp_total": "h + a", "exp_diff": "h - a", "pi_h": "hh", "pi_a": "ah", "pi_diff": "hh - ah", "imp_h": "imp_h", "imp_d": "imp_d", "imp_a": "imp_a", "edge_h": "p_h - imp_h", "edge_a": "p_a - imp_a", "p_h": "p_h", "p_d": "greatest(0e0, 1 - p_h - p_a)", "p_a": "p_a", "p_h_scores": "1 - exp(-h)", "p_a_scores": "1 - exp(-a)", "p_btts_model": "(1 - exp(-h)) * (1 - exp(-a))", "p_o25_model": f"1 - ({under})", "n_games_h": "15e0", "n_games_a": "15e0"}
    for n, pair in (("mom", "-"), ("sot", "-"), ("corn", "+"), ("cs", ""), ("ga", "-")):
        made |= {f"{n}_{s}": known(n, s) for s in "ha"}
        if pair:
            made[f"{n}_{'diff' if pair == '-' else 'total'}"] = f"{known(n, 'h')} {pair} {known(n, 'a')}"
    made["sot_ratio"] = f"{known('sot', 'h')} / greatest(0.1e0, {known('sot', 'a')})"
    return f"{CANON}, {base} SELECT ok, ln, pk, sk, {', '.join(f'round({made[n]}, 6) + 0e0 AS {n}' for n in C.VECTOR)} FROM d"


@query("d04_enhanced_vector", _vector_twin())
def d04(spark, sf_dir):
    spoken = lambda x: F.expr(x.replace("e0", "D"))
    v = C.enhanced_vector({n: spoken(x) for n, x in RATING.items()}, (F.lit(1.08), F.lit(1.0)), [F.col(c) for c in ("odds_h", "odds_d", "odds_a")], {n: spoken(x) for n, x in KNOWN.items()})
    return canon(spark, sf_dir).select(*M.TIE, *[(F.round(x, 6) + 0.0).alias(n) for n, x in v.items()])


_SIDE = {
    "severities": "CASE {k} % 4 WHEN 0 THEN array('low', 'high') WHEN 1 THEN array('season_ending', NULL, 'odd') WHEN 2 THEN array('medium') ELSE NULL END", "suspended": "CAST({k} % 3 AS INT)", "key_missing": "{k} % 5 = 0", "points": "CAST({k} % 16 AS INT)", "games": "CAST(CASE WHEN {k} % 11 = 0 THEN 0 ELSE 5 END AS INT)",
    "km": "CASE WHEN {k} % 6 = 0 THEN NULL ELSE CAST({k} % 900 AS DOUBLE) END", "new_manager": "{k} % 13 = 0", "ppda": "CASE WHEN {k} % 7 = 0 THEN NULL ELSE CAST({k} % 15 AS DOUBLE) END", "style": "CASE WHEN {k} % 9 = 0 THEN 'high_press' ELSE 'counter' END", "fatigue": "CASE WHEN {k} % 8 = 0 THEN NULL ELSE 1.0e0 + ({k} % 5) / 20.0e0 END",
    "tilt": "CASE WHEN {k} % 10 = 0 THEN NULL ELSE CAST({k} % 100 AS DOUBLE) END", "formation": "CASE {k} % 3 WHEN 0 THEN '4-3-3' WHEN 1 THEN '4-4-2' ELSE NULL END", "motive": "CASE {k} % 6 WHEN 0 THEN 'must_win' WHEN 1 THEN 'derby' WHEN 2 THEN 'relegation_fight' ELSE NULL END",
}
_KEY = {"h": "pk", "a": "(ok + 3)"}


def _context_twin() -> str:
    raw = ", ".join(f"{x.format(k=k).replace('array(', 'list_value(')} AS {s}_{n}" for s, k in _KEY.items() for n, x in _SIDE.items())
    level = "CASE coalesce(x, 'medium') WHEN 'low' THEN 0.02e0 WHEN 'high' THEN 0.10e0 WHEN 'season_ending' THEN 0.15e0 ELSE 0.05e0 END"
    part = ", ".join(
        f"greatest(0.5e0, 1 - (coalesce(list_sum(list_transform({s}_severities, lambda x: {level})), 0e0) + {s}_suspended * 0.05e0 + CASE WHEN {s}_key_missing THEN 0.15e0 ELSE 0e0 END)) AS {s}_hurt, CASE WHEN {s}_games = 0 THEN 1e0 ELSE 0.8e0 + ({s}_points / CAST({s}_games AS DOUBLE) / 3e0) * 0.4e0 END AS {s}_form,"
        f" CASE WHEN ({s}_ppda <> 0 AND {s}_ppda < 10) OR {s}_style = 'high_press' THEN 1.1e0 ELSE 1e0 END AS {s}_press, CASE WHEN {s}_new_manager THEN 1.05e0 ELSE 1e0 END AS {s}_bounce, CASE WHEN {s}_km > 500 THEN 1 - {s}_km / 5000e0 ELSE 1e0 END AS {s}_travel"
        for s in "ha"
    )
    side = lambda s, o, n: f"round(1.2e0 * {s}_hurt * {s}_form * {s}_press * {s}_bounce * {s}_travel, 6) AS {n}_att, round({o}_hurt * coalesce({o}_fatigue, 1e0) * CASE WHEN {o}_tilt > 60 THEN 1.1e0 ELSE 1e0 END, 6) AS {n}_def, CASE WHEN {s}_formation IN ('4-3-3', '3-4-3', '4-2-3-1') THEN 1.1e0 ELSE 1e0 END AS {n}_formation_att, CAST(coalesce({s}_motive IN ('must_win', 'relegation_fight'), false) AS INT) AS {n}_must_win, CAST(coalesce(len({s}_severities), 0) + {s}_suspended AS INT) AS {n}_injury_count"
    return f"{CANON}, r AS (SELECT *, {raw} FROM canon), p AS (SELECT *, {part} FROM r) SELECT ok, ln, pk, sk, {side('h', 'a', 'home')}, {side('a', 'h', 'away')}, CAST(coalesce(h_motive = 'derby', false) OR coalesce(a_motive = 'derby', false) AS INT) AS is_derby, round(coalesce(1 + (hy + ay - 3e0) * 0.05e0, 1e0), 6) AS referee_card_factor FROM p"


@query("f47_context_features", _context_twin())
def f47(spark, sf_dir):
    side = {s: {n: F.expr(x.format(k=k).replace("e0", "D")) for n, x in _SIDE.items()} for s, k in _KEY.items()}
    made = C.context_features(side, (F.col("hy") + F.col("ay")).cast("double"))
    return canon(spark, sf_dir).select(*M.TIE, *[F.round(x, 6).alias(n) if n.endswith(("_att", "_def", "_factor")) else x.cast("int").alias(n) for n, x in made.items()])
