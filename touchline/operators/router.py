"""Market router: candidates of a match with their gates, ranked in the row itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.durable import materialize
from touchline.functions.prob import clip

#: Market, family, metric that judges it, least probability, and the column of its probability (a minus: its complement).
MARKETS: list[tuple[str, str, str, float, str]] = [
    ("Over 1.5", "goals", "goals_over_1.5", 0.66, "p_o15"),
    ("Over 2.5", "goals", "goals_over_2.5", 0.60, "p_o25"),
    ("Over 3.5", "goals", "goals_over_3.5", 0.58, "p_o35"),
    ("Under 2.5", "goals", "goals_over_2.5", 0.60, "-p_o25"),
    ("Under 3.5", "goals", "goals_over_3.5", 0.64, "-p_o35"),
    ("BTTS", "goals", "btts", 0.60, "p_btts"),
    ("Corners Over 8.5", "corners", "corners_over_8.5", 0.61, "p_c85"),
    ("Corners Over 9.5", "corners", "corners_over_9.5", 0.60, "p_c95"),
    ("Corners Over 10.5", "corners", "corners_over_10.5", 0.58, "p_c105"),
    ("Cards Over 3.5", "cards", "cards_over_3.5", 0.59, "p_k35"),
    ("Cards Over 4.5", "cards", "cards_over_4.5", 0.58, "p_k45"),
    ("Cards Over 5.5", "cards", "cards_over_5.5", 0.55, "p_k55"),
]
#: What a missing metric or profile counts as, the gates, and the limits of the routing.
BRIER, ECE, TRAIT = 0.25, 0.12, 0.5
LEAST_COVERAGE, LEAST_QUALITY, MOST_ECE, MOST_BRIER = 0.45, 0.22, 0.14, 0.285
OPEN_ENTROPY, OPEN_MARGIN, OPEN_SCORE, STRONG_SCORE, TRUST_CAP = 0.94, 0.085, 58.0, 74.0, 72.0
TOP = 5


def league_report(metrics: DataFrame, coverage: DataFrame) -> DataFrame:
    """league, metrics (map of metric to brier and ece), coverage (map of family to share): one row for each league.

    metrics: league, metric, brier, ece; coverage: league, family, share.  A league has as many metrics as MARKETS name."""
    m = metrics.groupBy("league").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("brier", "ece")))).alias("metrics"))
    c = coverage.groupBy("league").agg(F.map_from_entries(F.collect_list(F.struct("family", "share"))).alias("coverage"))
    return m.join(c, "league", "full")


def _trait(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(TRAIT))


def _bonus(family: str, open_match: Column) -> Column:
    """What the context adds to a family's score."""
    above = lambda name, base, weight: F.greatest(F.lit(0.0), _trait(name) - base) * weight
    bonus = F.when(open_match, 0.08).otherwise(0.0)
    if family == "corners":
        bonus = bonus + above("set_piece_weight", 0.55, 0.20) + above("directness", 0.60, 0.08)
    elif family == "cards":
        bonus = bonus + above("card_pressure", 0.55, 0.25) + F.least(F.lit(0.06), F.coalesce("match_pressure", F.lit(0.0)) / 1000.0)
    else:
        bonus = bonus + above("tempo", 0.62, 0.10)
    return clip(bonus, 0.0, 0.16)


def _judged(market: tuple[str, str, str, float, str]) -> Column:
    """What a league's report says of a market: quality, calibration, coverage, and whether they pass its gates."""
    _, family, key, _, _ = market
    metric = F.try_element_at(F.col("metrics"), F.lit(key))
    brier, ece = F.coalesce(metric["brier"], F.lit(BRIER)), F.coalesce(metric["ece"], F.lit(ECE))
    coverage = F.lit(1.0) if family == "goals" else clip(F.coalesce(F.try_element_at(F.col("coverage"), F.lit(family)), F.lit(0.0)), 0.0, 1.0)
    calibration = clip(1.0 - ece / 0.16, 0.0, 1.0)
    quality = clip(clip((0.30 - brier) / 0.16, 0.0, 1.0) * 0.65 + calibration * 0.35, 0.0, 1.0)
    passed = (coverage >= (0.0 if family == "goals" else LEAST_COVERAGE)) & (quality >= LEAST_QUALITY) & (ece <= MOST_ECE) & (brier <= MOST_BRIER)
    return F.struct(quality.alias("quality"), calibration.alias("calibration"), coverage.alias("coverage"), passed.alias("passed"))


def _raw(source: str, columns: list[str]) -> Column:
    """The probability that MARKETS name; 0 (or its complement) if it is unknown."""
    name = source.lstrip("-")
    raw = F.coalesce(F.col(name).cast("double") if name in columns else F.lit(None).cast("double"), F.lit(0.0))
    return 1.0 - raw if source.startswith("-") else raw


def _candidate(place: int, market: tuple[str, str, str, float, str], columns: list[str]) -> Column:
    """A candidate as a struct whose first fields sort it: eligible first, then by score and probability, then in the table's order.

    What it is made of stands in columns of its own: inside a condition Spark works every use of an expression out anew."""
    label, family, _, least, _ = market
    p, league = F.col(f"_p{place}"), F.col(f"_league{place}")
    quality, coverage, calibration = league["quality"], league["coverage"], league["calibration"]
    gap = F.greatest(F.lit(0.0), p - least)
    odds_name = "odds_" + label.lower().replace(" ", "_").replace(".", "_")
    odds = F.when(F.col(odds_name) > 1.01, F.col(odds_name).cast("double")) if odds_name in columns else F.lit(None).cast("double")
    edge = F.coalesce(p - 1.0 / odds, gap * quality * coverage * 0.75)
    score = 100.0 * (p * 0.42 + quality * 0.20 + coverage * 0.14 + calibration * 0.10 + F.least(F.lit(0.25), gap * 1.6) * 0.08 + F.col(f"_bonus_{family}"))
    score, probability = F.round(clip(score, 1.0, 92.0), 1), F.round(p, 4)
    basis = F.when(odds.isNotNull(), "market_odds").otherwise("model_without_market_odds")
    fields = {"last": ~((p >= least) & league["passed"]), "s": -score, "p": -probability, "place": F.lit(place), "market": F.lit(label), "family": F.lit(family), "edge": F.round(F.greatest(F.lit(0.0), edge), 4), "edge_basis": basis, "odds": F.round(odds, 3), "quality": F.round(quality, 4)}
    return F.when(F.col(f"_raw{place}") > 0, F.struct(*[v.alias(k) for k, v in fields.items()]))


def route(matches: DataFrame, report: DataFrame, primary: str, secondary: str) -> DataFrame:
    """The rows with entropy, margin, action, selected_market, selected_probability, secondary_market, promoted, trust_score, edge,
    edge_basis, stake_hint and top_candidates (up to TOP markets).

    matches: league, p_h, p_d, p_a, the probabilities that MARKETS name, and, where there are any, prices ``odds_<market>`` and the traits of the
    context; primary and secondary name the columns of the base markets.  A match of even chances takes its strongest event
    market that passes all gates; another one only a market far above the usual score; else the base market stays.
    Leagues without a report have default metrics and no coverage of corners and cards.  No shuffle besides the join with
    one row for each league."""
    held = [c for c in ("set_piece_weight", "directness", "card_pressure", "tempo", "match_pressure") if c not in matches.columns]
    # a league's share of the scores is worked out in its one row, and again as defaults for leagues without one
    judged = materialize(report.select("league", *[_judged(m).alias(f"_league{k}") for k, m in enumerate(MARKETS)], F.lit(True).alias("_known")))
    rows = matches.withColumns({c: F.lit(None).cast("double") for c in held}).join(judged, "league", "left")
    none = {"metrics": F.lit(None).cast("map<string, struct<brier: double, ece: double>>"), "coverage": F.lit(None).cast("map<string, double>")}
    rows = rows.withColumns(none).withColumns({f"_league{k}": F.when(F.col("_known"), F.col(f"_league{k}")).otherwise(_judged(m)) for k, m in enumerate(MARKETS)}).drop("metrics", "coverage", "_known")
    chances = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("p_h", "p_d", "p_a")]
    held_chances = [clip(c, 1e-9, 1.0) for c in chances]
    total = held_chances[0] + held_chances[1] + held_chances[2]
    entropy = -sum((c / total) * F.log(c / total) for c in held_chances) / F.log(F.lit(3.0))
    ordered = F.sort_array(F.array(*chances), asc=False)
    rows = rows.withColumns({"_entropy": entropy, "_margin": ordered[0] - ordered[1]})
    rows = rows.withColumn("_open", (F.col("_entropy") >= OPEN_ENTROPY) | (F.col("_margin") <= OPEN_MARGIN))
    families = sorted({m[1] for m in MARKETS})
    rows = rows.withColumns({f"_bonus_{f}": _bonus(f, F.col("_open")) for f in families} | {f"_raw{k}": _raw(m[4], matches.columns) for k, m in enumerate(MARKETS)})
    rows = rows.withColumns({f"_p{k}": clip(F.col(f"_raw{k}"), 0.01, 0.99) for k in range(len(MARKETS))})
    ranked = F.array_sort(F.array_compact(F.array(*[_candidate(k, m, matches.columns) for k, m in enumerate(MARKETS)])))
    rows = rows.withColumn("_ranked", ranked).withColumn("_best", F.try_element_at("_ranked", F.lit(1)))
    fit = F.col("_best").isNotNull() & ~F.col("_best.last")
    chosen = fit & (-F.col("_best.s") >= F.when(F.col("_open"), OPEN_SCORE).otherwise(STRONG_SCORE))
    action = F.when(F.col("_open"), F.when(chosen, "promote_event_market").otherwise("keep_base_no_event_edge")).otherwise(F.when(chosen, "promote_strong_event_market").otherwise("keep_base"))
    rows = rows.withColumns({"action": action, "_chosen": F.coalesce(chosen, F.lit(False))})
    market = F.when(F.col("_chosen"), F.col("_best.market")).otherwise(F.col(primary))
    rows = rows.withColumn("selected_market", market)
    others = F.filter("_ranked", lambda c: ~c["market"].eqNullSafe(F.col("selected_market")))
    trust = F.when(F.col("_chosen"), F.when(F.col("_best.edge_basis") == "market_odds", -F.col("_best.s")).otherwise(F.least(-F.col("_best.s"), F.lit(TRUST_CAP)))).otherwise(0.0)
    edge = F.when(F.col("_chosen"), F.col("_best.edge")).otherwise(0.0)
    return rows.select(
        *matches.columns,
        F.round("_entropy", 4).alias("entropy"),
        F.round("_margin", 4).alias("margin"),
        "action",
        "selected_market",
        F.when(F.col("_chosen"), -F.col("_best.p")).alias("selected_probability"),
        F.coalesce(F.try_element_at(others, F.lit(1))["market"], F.col(secondary)).alias("secondary_market"),
        (F.col("_chosen") & (F.col("_best.market") != F.col(primary))).alias("promoted"),
        F.round(trust, 1).alias("trust_score"),
        edge.alias("edge_value"),
        F.when(F.col("_chosen"), F.col("_best.edge_basis")).otherwise("base_market").alias("edge_basis"),
        F.when(F.col("_chosen") & (edge > 0), F.round(clip((trust - 55.0) / 18.0, 0.0, 2.0), 1)).otherwise(0.0).alias("stake_hint"),
        F.transform(F.slice("_ranked", 1, TOP), lambda c: c["market"]).alias("top_candidates"),
    )
