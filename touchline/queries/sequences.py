"""Sequences of a team's last matches, and rolling means in both modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import matches as M
from touchline.operators import sequences as S
from touchline.queries.quality import CANON, canon
from touchline.registry import query

ORDER = ["match_date", *M.TIE, "was_home"]
_VIEW = """, tm AS (SELECT league, match_date, ok, ln, pk, sk, home AS team, 1e0 AS was_home, hg AS gf, ag AS ga, hs AS shots_for, aws AS shots_against, CAST(NULL AS INT) AS sot_for, CAST(NULL AS INT) AS sot_against, hc AS corners_for, hy AS cards_for, xg_h AS xg_for, xg_a AS xg_against FROM canon
 UNION ALL SELECT league, match_date, ok, ln, pk, sk, away, 0e0, ag, hg, aws, hs, NULL, NULL, ac, ay, xg_a, xg_h FROM canon)"""


def _known(c: str, scale: float, default: float) -> str:
    return f"CASE WHEN {c} IS NULL THEN {default}e0 ELSE least(1e0, greatest(0e0, {c} / {scale}e0)) END"


def _twin() -> str:
    gap = _known("(xg_for - xg_against + 3e0)", 6, 0.5)
    base = ["least(1e0, gf / 5e0)", "least(1e0, ga / 5e0)", "p / 3e0", *[_known(*s) for s in S.SCALED], gap, _known("xg_for", 2, 0.5), _known("xg_against", 2, 0.5), "0.5e0", "0.5e0", "3 / 7e0", "was_home", "20 / 52e0", "0e0", "0e0", "0.25e0"]
    pad = "[" + ", ".join(f"{v!r}::DOUBLE" for v in S.TRAINED_PAD) + "]"
    return CANON + _VIEW + f""", tp AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS p FROM tm),
 hh AS (SELECT league, team, match_date, was_home, ok, ln, pk, sk, list([{', '.join(base)}]) OVER w AS xs, list(p) OVER w AS ps FROM tp WINDOW w AS (PARTITION BY league, team ORDER BY match_date, ok, ln, pk, sk, was_home ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
 ii AS (SELECT *, coalesce(len(xs), 0) AS n FROM hh),
 jj AS (SELECT *, list_transform(range(n), lambda i: CASE WHEN i = 0 THEN 0.5e0 ELSE list_sum(ps[greatest(1, i - 4):i]) / 15e0 END) AS form,
  list_transform(range(n), lambda i: CASE WHEN i = 0 OR ps[i] = 1 THEN 0e0 ELSE (CASE WHEN ps[i] = 3 THEN 1 ELSE -1 END) * least(5, coalesce(list_min(list_filter(range(1, i + 1), lambda k: ps[i - k + 1] <> ps[i])) - 1, i)) / 5e0 END) AS streak FROM ii)
 SELECT league, team, match_date, was_home, ok, ln, pk, sk, CAST(n AS INT) AS steps, list_transform(range(1, 23), lambda c: round(CASE WHEN n = 0 THEN {pad}[c] WHEN c = 21 THEN streak[n] WHEN c = 22 THEN form[n] ELSE xs[n][c] END, 6)) AS newest,
  list_transform(range(1, 23), lambda c: round((20 - n) * {pad}[c] + coalesce(CASE WHEN c = 21 THEN list_sum(streak) WHEN c = 22 THEN list_sum(form) ELSE list_sum(list_transform(xs, lambda x: x[c])) END, 0e0), 6)) AS total FROM jj"""


@query("d05_sequences", _twin())
def d05(spark, sf_dir):
    """Every team's matches with the sequence before them: number of real steps, the newest step, and sums over all steps."""
    e = S.encode(S.team_matches(canon(spark, sf_dir), M.TIE), ORDER)
    total = F.aggregate("sequence", F.array_repeat(F.lit(0.0), S.WIDTH), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    # as the SQL rounds: a sum a hair below zero becomes the negative zero, which F.round loses
    out = lambda x: F.transform(x, lambda v: F.when((v < 0) & (F.round(v, 6) == 0), F.lit(-0.0)).otherwise(F.round(v, 6)))
    return e.select("league", "team", "match_date", "was_home", *M.TIE, F.aggregate("mask", F.lit(0), lambda s, v: s + v).alias("steps"), out(F.element_at("sequence", -1)).alias("newest"), out(total).alias("total"))


_AT = "PARTITION BY league, team, was_home ORDER BY match_date"


@query("w19_rolling_modes", CANON + _VIEW + f""", r AS (SELECT *, avg(gf) OVER b AS gf_b, avg(ga) OVER b AS ga_b, row_number() OVER ({_AT} DESC, ok DESC, ln DESC, pk DESC, sk DESC, was_home DESC) AS k FROM tm WINDOW b AS ({_AT}, ok, ln, pk, sk, was_home ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
 s AS (SELECT league, team, was_home, avg(gf) AS gf_s, avg(ga) AS ga_s FROM r WHERE k <= 5 GROUP BY ALL)
 SELECT r.league, r.team, r.match_date, r.was_home, ok, ln, pk, sk, round(coalesce(gf_b, 0e0), 6) AS before_gf, round(coalesce(ga_b, 0e0), 6) AS before_ga, round(gf_s, 6) AS static_gf, round(ga_s, 6) AS static_ga FROM r JOIN s ON r.league = s.league AND r.team = s.team AND r.was_home = s.was_home""")
def w19(spark, sf_dir):
    rows = S.team_matches(canon(spark, sf_dir), M.TIE)
    free = S.rolling_means(rows, ORDER, ["gf", "ga"], False).withColumnsRenamed({"mean_gf": "before_gf", "mean_ga": "before_ga"})
    both = S.rolling_means(free, ORDER, ["gf", "ga"], True)
    return both.select("league", "team", "match_date", "was_home", *M.TIE, *[F.round(c, 6).alias(c) for c in ("before_gf", "before_ga")], F.round("mean_gf", 6).alias("static_gf"), F.round("mean_ga", 6).alias("static_ga"))
