"""Ticket bundles of each day, over all leagues and of each league."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import bundles as B
from touchline.operators import matches as M
from touchline.queries.markets import PRED, pred
from touchline.registry import query

_SCORE = "round(least(greatest(trust, 1e0), 100e0) * 0.45e0 + least(1e0, p_btts) * 35e0 + least(1e0, coalesce(conf, 0.5e0)) * 15e0 + least(0.5e0, greatest(edge, 0e0)) * 20e0, 2)"


def candidates(spark, sf_dir):
    return pred(spark, sf_dir).select("league", "match_date", "home", "away", *M.TIE, "trust", "edge", F.col("p_btts").alias("market_p"), F.expr(_SCORE.replace("e0", "D")).alias("ticket_score"))


def _twin(scope: list[str]) -> str:
    sql = f"{PRED}, cd AS (SELECT league, match_date, home, away, ok, ln, pk, sk, trust, edge, p_btts AS market_p, {_SCORE} AS ticket_score FROM pred), mn AS (SELECT {', '.join(scope)}, min(league) <> max(league) AS many FROM cd GROUP BY ALL), c0 AS (SELECT * FROM cd JOIN mn USING ({', '.join(scope)}))"
    out = []
    for n, (kind, by) in enumerate(B.KINDS.items()):
        before = "c0"
        for leg in range(1, B.LEGS + 1):
            t = f"k{n}l{leg}"
            sql += f", {t} AS (SELECT * FROM {before} QUALIFY row_number() OVER (PARTITION BY {', '.join(scope)} ORDER BY {', '.join(f'{c} DESC' for c in by)}, ok, ln, pk, sk) = 1)"
            out.append(f"SELECT match_date, '{kind}' AS kind, {leg} AS leg, league, home, away, ok, ln, pk, sk FROM {t}")
            on = " AND ".join(f"x.{c} = b.{c}" for c in scope)
            sql += f", r{n}l{leg} AS (SELECT x.* FROM {before} x JOIN {t} b ON {on} WHERE x.home NOT IN (b.home, b.away) AND x.away NOT IN (b.home, b.away) AND NOT (x.many AND x.league = b.league))"
            before = f"r{n}l{leg}"
    return sql + " " + " UNION ALL ".join(out)


@query("t04_global_bundles", _twin(["match_date"]))
def t04_global(spark, sf_dir):
    """Each day's three tickets over all leagues: no team twice, every leg of another league where there are several."""
    return B.bundles(candidates(spark, sf_dir), ["match_date"])


@query("t04_league_bundles", _twin(["league", "match_date"]))
def t04_league(spark, sf_dir):
    return B.bundles(candidates(spark, sf_dir), ["league", "match_date"])


@query("k16_bundle_json", _twin(["match_date"]).replace(" SELECT match_date, 'TYPE_A", ", fin AS (SELECT match_date, 'TYPE_A", 1) + ") SELECT match_date, '{' || " + " || ',' || ".join(f"'\"{k}\":[' || coalesce(string_agg('{{\"league\":\"' || league || '\",\"home\":\"' || home || '\",\"away\":\"' || away || '\"}}', ',' ORDER BY leg) FILTER (kind = '{k}'), '') || ']'" for k in B.KINDS) + " || '}' AS bundle FROM fin GROUP BY match_date")
def k16(spark, sf_dir):
    """The same as one JSON object for each day."""
    return B.bundle_json(B.bundles(candidates(spark, sf_dir), ["match_date"]), ["match_date"], "bundle")
