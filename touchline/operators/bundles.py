"""Ticket bundles: for each scope three kinds of tickets, each a greedy choice of legs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.durable import materialize
from touchline.operators.matches import TIE

#: Kinds of tickets, and what each sorts its candidates by (greatest first).
KINDS = {"TYPE_A_ULTRA_SAFE": ["ticket_score", "trust", "market_p"], "TYPE_B_BALANCED": ["market_p", "trust", "ticket_score"], "TYPE_C_VALUE": ["edge", "ticket_score"]}
LEGS = 3


def greedy_legs(candidates: DataFrame, scope: list[str], by: list[str], legs: int = LEGS) -> DataFrame:
    """scope, leg (from 1), league, home, away and the order columns of up to ``legs`` candidates of each scope.

    The best one by ``by`` (greatest first, then the least key), then the best of those without a team, and, where the scope has more than one
    league, without a league that is taken.  Each leg is one partial aggregation and a join with one row for each scope, written
    before, so that no scope's candidates are ever a list or a task of their own."""
    columns = ["league", "home", "away", *by, *TIE]
    several = F.min("league") != F.max("league")
    left = candidates.select(*scope, *[c for c in columns if c not in scope])
    many = materialize(left.groupBy(*scope).agg(several.alias("_many")))
    left = left.join(many, scope)
    found = None
    for leg in range(1, legs + 1):
        order = F.struct(*[(-F.col(c)).alias(f"_{c}") for c in by], *TIE)
        rest = [c for c in columns if c not in scope]
        best = materialize(left.groupBy(*scope).agg(F.min_by(F.struct(*rest), order).alias("b")).select(*scope, F.lit(leg).alias("leg"), "b.*"))
        found = best if found is None else found.unionByName(best)
        if leg < legs:
            taken = best.select(*scope, F.col("league").alias("_l"), F.array("home", "away").alias("_t"))
            clash = F.array_contains("_t", F.col("home")) | F.array_contains("_t", F.col("away")) | (F.col("_many") & (F.col("league") == F.col("_l")))
            left = left.join(taken, scope).filter(~clash).drop("_l", "_t")
    return found


def bundles(candidates: DataFrame, scope: list[str], legs: int = LEGS) -> DataFrame:
    """The legs of all kinds: scope, kind, leg, league, home, away, and the key of the match."""
    out = None
    for kind, by in KINDS.items():
        some = greedy_legs(candidates, scope, by, legs).select(*scope, F.lit(kind).alias("kind"), "leg", *[c for c in ("league", "home", "away") if c not in scope], *TIE)
        out = some if out is None else out.unionByName(some)
    return out


def bundle_json(legs: DataFrame, scope: list[str], name: str) -> DataFrame:
    """scope and ``name``: one JSON object for each scope, a list of legs for each kind (empty if it has none).  A scope has a few legs."""
    items = {k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("leg", *[c for c in ("league", "home", "away") if c in legs.columns])))), lambda s: s.dropFields("leg")) for k in KINDS}
    return legs.groupBy(*scope).agg(*[v.alias(k) for k, v in items.items()]).select(*scope, F.to_json(F.struct(*KINDS)).alias(name))
