"""Post-match patterns, rationale drivers and tactical league profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statistics whose absence speaks of poor event data.
CORE = ("hs", "as", "hst", "ast", "hc", "ac", "hy", "ay")
PROFILE = ("tempo", "directness", "pressing", "set_piece_weight", "card_pressure", "goal_total_prior", "corner_total_prior", "card_total_prior", "style_label")
#: The tactical profile of each known league, and of all others.
DEFAULT_PROFILE = (0.50, 0.50, 0.50, 0.50, 0.50, 2.60, 9.60, 4.20, "balanced")
LEAGUE_PROFILES = {
    "PremierLeague": (0.70, 0.72, 0.66, 0.72, 0.54, 2.78, 10.10, 4.05, "direct transition / set-piece heavy"),
    "Bundesliga": (0.76, 0.78, 0.78, 0.66, 0.50, 2.95, 10.00, 3.95, "vertical / high-intensity"),
    "SerieA": (0.44, 0.42, 0.48, 0.56, 0.68, 2.48, 9.20, 4.65, "structured / tactical control"),
    "LaLiga": (0.46, 0.45, 0.58, 0.55, 0.72, 2.42, 9.15, 4.85, "structured build-up / higher discipline variance"),
    "Ligue1": (0.63, 0.60, 0.70, 0.56, 0.58, 2.68, 9.55, 4.30, "pressing / transition trend"),
    "Championship": (0.68, 0.72, 0.57, 0.72, 0.58, 2.55, 10.20, 4.35, "direct / physical"),
}


def match_patterns(stat: Callable[[str], Column]) -> Column:
    """Array of (pattern, confidence, side) of a finished match; ``stat`` gives a statistic's column by its short name.

    A rule over an unknown statistic never holds (red cards and shots on target count 0 in sums); a match without any
    pattern gets the standard profile."""
    s = lambda name: stat(name).cast("double")
    known = lambda *names: [s(n) for n in names]
    (hg, ag), (hs, as_), (hst, ast), (hc, ac), (hy, ay) = known("hg", "ag"), known("hs", "as"), known("hst", "ast"), known("hc", "ac"), known("hy", "ay")
    (hxg, axg), (hbc, abc), (hf, af), (hp, ap) = known("hxg", "axg"), known("hbc", "abc"), known("hf", "af"), known("hposs", "aposs")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    reds = zero(s("hr")) + zero(s("ar"))
    missing = sum((s(n).isNull().cast("int") for n in CORE), F.lit(0))

    def tag(key: str, confidence: float, holds: Column, home: Column | None = None) -> Column:
        side = F.lit(None).cast("string") if home is None else F.when(home, "home").otherwise("away")
        return F.when(holds, F.struct(F.lit(key).alias("pattern"), F.lit(confidence).alias("confidence"), side.alias("side")))

    def gap(key: str, confidence: float, home: Column, away: Column, least: float) -> Column:
        return tag(key, confidence, F.abs(home - away) >= least, home > away)

    found = F.array_compact(
        F.array(
            tag("low_event_data_quality", 0.55, missing >= 4),
            tag("red_card_distortion", 0.92, reds > 0),
            tag("cards_spike", 0.82, hy + ay + 2 * reds >= 6),
            gap("discipline_imbalance", 0.72, hy, ay, 3),
            gap("set_piece_pressure", 0.78, hc, ac, 4),
            tag("high_corner_environment", 0.70, hc + ac >= 12),
            gap("shot_on_target_dominance", 0.80, hst, ast, 3),
            tag("home_finishing_outperformed_pressure", 0.66, (hg > ag) & (hst <= ast)),
            tag("away_finishing_outperformed_pressure", 0.66, (ag > hg) & (ast <= hst)),
            gap("territory_shot_volume_dominance", 0.68, hs, as_, 7),
            tag("low_shot_quality", 0.70, (hs + as_ >= 22) & (zero(hst) + zero(ast) <= 6)),
            gap("possession_control", 0.62, hp, ap, 18),
            tag("home_finishing_variance", 0.76, (hg >= hxg + 1.2) & ag.isNotNull() & axg.isNotNull()),
            tag("away_finishing_variance", 0.76, (ag >= axg + 1.2) & hg.isNotNull() & hxg.isNotNull()),
            tag("home_xg_underperformance", 0.74, (hxg >= axg + 0.8) & (hg <= ag)),
            tag("away_xg_underperformance", 0.74, (axg >= hxg + 0.8) & (ag <= hg)),
            gap("big_chance_gap", 0.74, hbc, abc, 2),
            gap("foul_pressure_imbalance", 0.60, hf, af, 7),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(tag("standard_match_profile", 0.35, F.lit(True))))


def rationale(p: dict[str, Column], pressure: Column, label: Column, momentum: tuple[Column, Column], corners: Column) -> Column:
    """All drivers behind a prediction in their order: probabilities (keys h, d, a, o25, btts), pressure, momentum, market.

    The standard profile stands where neither a probability nor the pressure speaks."""
    level = lambda x, high, name, low, other: F.when(x > high, name).when(x > low, other)
    first = F.array_compact(
        F.array(
            level(p["h"], 0.65, "High Home Win Probability", 0.40, "Home Win Lean"),
            level(p["a"], 0.65, "Strong Away Dominance", 0.40, "Away Win Lean"),
            level(p["d"], 0.38, "Elevated Draw Probability", 0.25, "Tactical Stalemate Risk"),
            level(p["o25"], 0.68, "High Scoring Potential (O2.5)", 0.55, "Attacking Overload Expected"),
            F.when(p["btts"] > 0.60, "Both Teams Scoring Likelihood"),
            F.when(pressure > 65, F.concat(F.lit("Critical Motivation: "), F.coalesce(label, F.lit("High Pressure")))).when(pressure > 35, "Significant Match Pressure"),
        )
    )
    h, a = (F.coalesce(m, F.lit(1.0)) for m in momentum)
    rest = F.array_compact(F.array(F.when(h >= 1.10, "Home_Momentum_Spike"), F.when(a >= 1.10, "Away_Momentum_Spike"), F.when(F.abs(h - a) >= 0.15, "Significant Momentum Imbalance"), F.when(corners, "Deep Set-Piece Signal")))
    return F.concat(F.when(F.size(first) > 0, first).otherwise(F.array(F.lit("Standard Match Profile"))), rest)


def with_profiles(rows: DataFrame, league: str = "league") -> DataFrame:
    """Left join of the tactical profiles (a fixed table of one row for each known league); other leagues get the default."""
    spark: SparkSession = rows.sparkSession
    kinds = ", ".join(f"{c} string" if c == "style_label" else f"{c} double" for c in PROFILE)
    known = spark.createDataFrame([(k, *v) for k, v in LEAGUE_PROFILES.items()], f"_league string, {kinds}")
    found = rows.join(F.broadcast(known), F.col(league) == F.col("_league"), "left")
    return found.select(*rows.columns, *[F.coalesce(c, F.lit(d)).alias(c) for c, d in zip(PROFILE, DEFAULT_PROFILE, strict=True)])
