"""Market rules, hit evaluation, tickets, metrics and count models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.prob import clip


def market_rules() -> Column:
    """Primary market of a prediction (p_h, p_d, p_a, p_o25, p_btts, profile): the first rule that fits."""
    h, d, a, o25, btts, profile = (F.col(c) for c in ("p_h", "p_d", "p_a", "p_o25", "p_btts", "profile"))
    by_profile = {"Surgical": "Home Win", "Blitz": "BTTS", "Trap": "X2 (Double Chance)", "Stagnant": "Under 2.5", "High Tempo": "Over 2.5"}
    rule = (
        F.when((h > a * 1.6) & (h > 0.42), "Home Win")
        .when((a > h * 1.8) & (a > 0.42), "Away Win")
        .when(o25 >= 0.62, "Over 2.5")
        .when((btts >= 0.62) & (o25 >= 0.55), "BTTS")
        .when(profile == "Defensive", "Under 2.5")
        .when((d > 0.35) & (h >= a), "1X (Double Chance)")
        .when(d > 0.35, "X2 (Double Chance)")
        .when((h > a) & (h > 0.38), "Home Win")
        .when((a > h) & (a > 0.38), "X2 (Double Chance)")
    )
    for name, market in by_profile.items():
        rule = rule.when(profile == name, market)
    return rule.otherwise("Over 1.5")


def market_hit() -> Column:
    """Whether the market came in."""
    m, h, a = F.col("market"), F.col("hg"), F.col("ag")
    return (
        F.when(m == "Over 1.5", h + a > 1).when(m == "Over 2.5", h + a > 2).when(m == "Over 3.5", h + a > 3).when(m == "Draw", h == a).when(m == "BTTS", (h > 0) & (a > 0)).when(m == "Home Win", h > a).when(m == "Away Win", h < a)
        .when(m.startswith("1X"), h >= a).when(m.startswith("X2"), h <= a).otherwise(F.lit(False))
    )


def reason_tags() -> Column:
    """Why a prediction missed (several tags), or ``hit``."""
    hit, m = F.col("hit"), F.col("market")
    miss = lambda cond, tag: F.when(~hit & cond, tag)
    counted = F.col("hy").isNotNull() & F.col("hc").isNotNull()
    corners, cards = F.col("hc") + F.coalesce("ac", F.lit(0)), F.col("hy") + F.coalesce("ay", F.lit(0))
    tags = F.array(
        F.when(hit, "hit"), miss(m.startswith("Over ") | (m == "BTTS"), "goals_market_miss"), miss(F.col("hg") == F.col("ag"), "missed_draw"), miss(F.col("hg") < F.col("ag"), "away_upset_or_home_bias"),
        miss(F.col("hg") > F.col("ag"), "home_win_underestimated"), miss(F.coalesce("conf", F.lit(0.0)) < 0.8, "low_source_confidence"), miss(F.col("hy").isNull() | F.col("hc").isNull(), "missing_cards_corners"),
        miss(counted & (corners >= F.col("exp_corners") + 3), "corners_underestimation"), miss(counted & (corners <= F.col("exp_corners") - 3), "corners_overestimation"),
        miss(counted & (cards >= F.col("exp_cards") + 2), "card_spike_or_referee_distortion"), miss(counted & (cards <= F.col("exp_cards") - 2), "cards_overestimation"),
        miss(F.col("edge") <= 0, "no_positive_edge"), miss(F.col("trust") >= 70, "high_confidence_miss"),
    )
    found = F.array_compact(tags)
    return F.when(F.size(found) == 0, F.array(F.lit("unclassified_miss"))).otherwise(found)


def tickets(candidates: DataFrame, keys: list[str], legs: int) -> DataFrame:
    """Greedy legs of each group with two candidates or more: by score, ties by the total order, no team twice.

    A group is one league's day, so its sorted list is small; the fold keeps at most ``legs`` legs."""
    item = F.struct((-F.col("score")).alias("s"), "ok", "ln", "pk", "sk", F.col("home").alias("h"), F.col("away").alias("a"))
    grouped = candidates.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("xs")).filter(F.size("xs") >= 2)
    none = F.array().cast("array<struct<h:string,a:string>>")
    free = lambda acc, x: ~F.exists(acc, lambda y: y["h"].isin(x["h"], x["a"]) | y["a"].isin(x["h"], x["a"]))
    fold = F.aggregate("xs", none, lambda acc, x: F.when((F.size(acc) < legs) & free(acc, x), F.concat(acc, F.array(F.struct(x["h"].alias("h"), x["a"].alias("a"))))).otherwise(acc))
    out = grouped.select(*keys, fold.alias("legs"))
    return out.select(*keys, F.size("legs").alias("n_legs"), F.array_join(F.transform("legs", lambda y: F.concat_ws("-", y["h"], y["a"])), ",").alias("legs"))


def outcome_metrics(rows: DataFrame, group: str) -> DataFrame:
    """Accuracy, log-loss, Brier and draw recall of three-way probabilities (ties go to H, then D)."""
    total = F.col("p_h") + F.col("p_d") + F.col("p_a")
    n = rows.select(group, "ftr", (F.col("p_h") / total).alias("h"), (F.col("p_d") / total).alias("d"), (F.col("p_a") / total).alias("a"))
    pick = F.when((F.col("h") >= F.col("d")) & (F.col("h") >= F.col("a")), "H").when(F.col("d") >= F.col("a"), "D").otherwise("A")
    own = F.when(F.col("ftr") == "H", F.col("h")).when(F.col("ftr") == "D", F.col("d")).otherwise(F.col("a"))
    brier = sum(F.pow(F.col(c) - (F.col("ftr") == k).cast("int"), F.lit(2.0)) for c, k in (("h", "H"), ("d", "D"), ("a", "A")))
    right = (pick == F.col("ftr")).cast("double")
    return n.groupBy(group).agg(
        F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(-F.avg(F.log(F.greatest(own, F.lit(1e-6)))), 6).alias("log_loss"), F.round(F.avg(brier), 6).alias("brier"),
        F.round(F.coalesce(F.avg(F.when(F.col("ftr") == "D", (pick == "D").cast("double"))), F.lit(0.0)), 6).alias("draw_recall"),
    )


def line_metrics(rows: DataFrame, group: str) -> DataFrame:
    """Brier, log-loss and ten-bin calibration error of binary probabilities p against y: one pass by bin, one by group."""
    p = rows.select(group, "y", clip(F.col("p"), 1e-6, 1 - 1e-6).alias("p"))
    loss = F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p"))
    bins = p.groupBy(group, F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("ap"), F.avg("y").alias("ay"), F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("b"), F.sum(loss).alias("l"))
    total = F.sum("n")
    return bins.groupBy(group).agg(total.alias("n"), (F.sum("b") / total).alias("brier"), (-F.sum("l") / total).alias("log_loss"), (F.sum(F.col("n") * F.abs(F.col("ap") - F.col("ay"))) / total).alias("ece"))


def dispersion(rows: DataFrame, group: str, x: str) -> DataFrame:
    """Negative binomial dispersion by moments; null below 30 values or without overdispersion."""
    m = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("mu"), F.var_samp(x).alias("va"))
    r = clip(F.col("mu") * F.col("mu") / F.greatest(F.lit(1e-6), F.col("va") - F.col("mu")), 1.2, 80.0)
    return m.withColumn("dispersion", F.when((F.col("n") >= 30) & (F.col("mu") > 0) & (F.col("va") > F.col("mu")), r)).drop("va")


def team_means(matches: DataFrame) -> DataFrame:
    """Goals for and against by team and venue, with the league's means where a team has no row of a venue."""
    home = F.struct(F.col("home").alias("team"), F.lit(True).alias("at_home"))
    away = F.struct(F.col("away").alias("team"), F.lit(False).alias("at_home"))
    rows = matches.select("league", "hg", "ag", F.explode(F.array(home, away)).alias("s")).select("league", "hg", "ag", "s.*")
    # one aggregation by team; the league's means follow from its home rows, a row for each team
    at = lambda flag, x: F.avg(F.when(F.col("at_home") == flag, F.col(x)))
    total = lambda x: F.sum(F.when(F.col("at_home"), F.col(x)))
    teams = rows.groupBy("league", "team").agg(
        at(True, "hg").alias("hf"), at(True, "ag").alias("ha"), at(False, "ag").alias("af"), at(False, "hg").alias("aa"), total("hg").alias("sh"), total("ag").alias("sa"), F.count_if(F.col("at_home")).alias("n")
    )
    whole = Window.partitionBy("league")
    teams = teams.withColumns({"league_home": F.sum("sh").over(whole) / F.sum("n").over(whole), "league_away": F.sum("sa").over(whole) / F.sum("n").over(whole)}).filter("hf is not null or af is not null")
    return teams.select(
        "league", "team", "league_home", "league_away", F.coalesce("hf", "league_home").alias("home_for"), F.coalesce("ha", "league_away").alias("home_against"), F.coalesce("af", "league_away").alias("away_for"), F.coalesce("aa", "league_home").alias("away_against")
    )


def expected_goals(matches: DataFrame, means: DataFrame) -> DataFrame:
    """Half own mean, three tenths the opponent's, two tenths the league's."""
    h = means.select("league", F.col("team").alias("home"), "home_for", "home_against", "league_home", "league_away")
    a = means.select("league", F.col("team").alias("away"), "away_for", "away_against")
    met = matches.join(h, ["league", "home"]).join(a, ["league", "away"])
    return met.withColumns({
        "home_mu": 0.5 * F.col("home_for") + 0.3 * F.col("away_against") + 0.2 * F.col("league_home"),
        "away_mu": 0.5 * F.col("away_for") + 0.3 * F.col("home_against") + 0.2 * F.col("league_away"),
    })
