"""Reports, date windows, node features, count expectations and one-to-one matching."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.prob import clip
from touchline.operators.matches import TIE
from touchline.operators.matching import greedy_pairs  # noqa: F401


def date_window(rows: DataFrame, day: Column, reference: str, past: int, future: int, unknown_passes: bool) -> DataFrame:
    """Rows whose day lies from ``past`` days before the reference to ``future`` days after it."""
    away = F.datediff(day, F.lit(reference).cast("date"))
    return rows.filter(F.coalesce(away.between(-past, future), F.lit(unknown_passes)))


def only_leagues(rows: DataFrame, leagues: str | Iterable[str] | None = None) -> DataFrame:
    """Rows of one league or of several; all rows if none is named."""
    if leagues is None:
        return rows
    return rows.filter(F.col("league").isin([leagues] if isinstance(leagues, str) else list(leagues)))


def node_features(sides: DataFrame) -> DataFrame:
    """Eight features of each team of a league, held in [-3, 3]; wins are split by venue, games are logarithmic."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    home = F.col("at_home") == 1
    held = {
        "games": F.log1p(F.count("*")) / 4.0, "scored": F.avg("gf"), "conceded": F.avg("ga"), "points": F.sum("pts") / (F.count("*") * 3.0),
        "home_wins": share((F.col("res") == "W") & home), "away_wins": share((F.col("res") == "W") & ~home), "draws": share(F.col("res") == "D"), "margin": F.avg(F.col("gf") - F.col("ga")),
    }
    return sides.groupBy("league", "team").agg(*[clip(x, -3.0, 3.0).alias(n) for n, x in held.items()])


def multiclass_calibration(rows: DataFrame, group: str, bins: int = 10) -> DataFrame:
    """Calibration error of the most likely of three outcomes: one aggregation by bin, one by group."""
    p = [clip(F.coalesce(c, F.lit(0.0)), 1e-6, 1.0) for c in (F.col("p_h"), F.col("p_d"), F.col("p_a"))]
    total = p[0] + p[1] + p[2]
    h, d, a = (x / total for x in p)
    top = F.greatest(h, d, a)
    said = F.when(h == top, "H").when(d == top, "D").otherwise("A")
    judged = rows.filter("ftr is not null").select(group, top.alias("top"), (said == F.col("ftr")).cast("int").alias("hit"))
    by_bin = judged.groupBy(group, F.least(F.floor(F.col("top") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("top").alias("said"), F.avg("hit").alias("was"))
    return by_bin.groupBy(group).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("said") - F.col("was"))) / F.sum("n")).alias("ece"))


def expected_counts(matches: DataFrame, home: str, away: str, weights: tuple[float, float, float], prior: float, pull: float) -> DataFrame:
    """Expected counts of both sides: own mean, the opponent's mean against, the league's mean; the total is pulled to a
    prior by at most 15 %.  Matches without a count teach nothing, but are predicted."""
    own, against, base = weights
    known = matches.filter(F.col(home).isNotNull() & F.col(away).isNotNull())
    league = known.groupBy("league").agg(F.avg(home).alias("mean_h"), F.avg(away).alias("mean_a"))
    at_home = known.groupBy("league", "home").agg(F.avg(home).alias("h_for"), F.avg(away).alias("h_against"))
    on_tour = known.groupBy("league", "away").agg(F.avg(away).alias("a_for"), F.avg(home).alias("a_against"))
    met = matches.join(league, "league", "left").join(at_home, ["league", "home"], "left").join(on_tour, ["league", "away"], "left")
    h = own * F.coalesce("h_for", "mean_h") + against * F.coalesce("a_against", "mean_h") + base * F.col("mean_h")
    a = own * F.coalesce("a_for", "mean_a") + against * F.coalesce("h_against", "mean_a") + base * F.col("mean_a")
    factor = clip(1.0 + pull * (prior / F.greatest(F.lit(0.01), h + a) - 1.0), 0.85, 1.15)
    return met.select("league", *TIE, (h * factor).alias("home_mu"), (a * factor).alias("away_mu"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length, over letters, digits and spaces in lower case."""
    x, y = (F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", "")) for c in (a, b))
    return 1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
