"""The enhanced feature vector of a match, and multipliers of its context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.prob import poisson_pmf

#: Names and order of the 36 features.
VECTOR = (
    "exp_h exp_a exp_total exp_diff pi_h pi_a pi_diff mom_h mom_a mom_diff sot_h sot_a sot_diff sot_ratio corn_h corn_a corn_total cs_h cs_a ga_h ga_a ga_diff "
    "imp_h imp_d imp_a edge_h edge_a p_h p_d p_a p_h_scores p_a_scores p_btts_model p_o25_model n_games_h n_games_a"
).split()
#: What unknown inputs count as.
DEFAULTS = {"mom": 0.5, "sot": 4.0, "corn": 5.0, "cs": 0.2, "ga": 1.2, "games": 15.0}
ODDS = (2.0, 3.2, 3.5)
#: Severity of an injury, formations that attack, motives that must win.
SEVERITY = {"low": 0.02, "medium": 0.05, "high": 0.10, "season_ending": 0.15}
ATTACKING, MUST_WIN = ("4-3-3", "3-4-3", "4-2-3-1"), ("must_win", "relegation_fight")


def enhanced_vector(ratings: dict[str, Column], multipliers: tuple[Column, Column], odds: list[Column], known: dict[str, Column]) -> dict[str, Column]:
    """The features by name, in the order of VECTOR.

    ratings: hh, ha, ah, aa (home and away rating of the home, then of the away team); multipliers of both teams' expected goals; odds (null: a
    default); known: columns such as ``mom_h`` or ``games_a`` for the keys of DEFAULTS, each of which may be missing or null.  Raises ValueError if a
    feature of the schema is missing or too many are made."""
    value = lambda n, s: F.coalesce(known[f"{n}_{s}"].cast("double"), F.lit(DEFAULTS[n])) if f"{n}_{s}" in known else F.lit(DEFAULTS[n])
    h = F.greatest(F.lit(0.1), (1.3 + (ratings["hh"] - ratings["aa"])) * multipliers[0])
    a = F.greatest(F.lit(0.1), (1.1 + (ratings["ah"] - ratings["ha"])) * multipliers[1])
    inverse = [1.0 / F.coalesce(o, F.lit(d)) for o, d in zip(odds, ODDS, strict=True)]
    total = inverse[0] + inverse[1] + inverse[2]
    imp = [x / total for x in inverse]
    goals = {"h": [poisson_pmf(k, h) for k in range(7)], "a": [poisson_pmf(k, a) for k in range(7)]}
    ahead = lambda x, y: sum(x[j] * sum(y[1:j], y[0]) for j in range(1, 7))
    p_h, p_a = ahead(goals["h"], goals["a"]), ahead(goals["a"], goals["h"])
    p_d = F.greatest(F.lit(0.0), 1 - p_h - p_a)
    scores = {s: 1 - goals[s][0] for s in "ha"}
    under = sum(goals["h"][i] * goals["a"][j] for i in range(3) for j in range(3) if i + j <= 2)
    out = {"exp_h": h, "exp_a": a, "exp_total": h + a, "exp_diff": h - a, "pi_h": ratings["hh"], "pi_a": ratings["ah"], "pi_diff": ratings["hh"] - ratings["ah"]}
    for n, pair in (("mom", "diff"), ("sot", "diff"), ("corn", "total"), ("cs", None), ("ga", "diff")):
        x, y = value(n, "h"), value(n, "a")
        out |= {f"{n}_h": x, f"{n}_a": y}
        if pair:
            out[f"{n}_{pair}"] = x - y if pair == "diff" else x + y
        if n == "sot":
            out["sot_ratio"] = x / F.greatest(F.lit(0.1), y)
    out |= {"imp_h": imp[0], "imp_d": imp[1], "imp_a": imp[2], "edge_h": p_h - imp[0], "edge_a": p_a - imp[2], "p_h": p_h, "p_d": p_d, "p_a": p_a}
    out |= {"p_h_scores": scores["h"], "p_a_scores": scores["a"], "p_btts_model": scores["h"] * scores["a"], "p_o25_model": 1 - under, "n_games_h": value("games", "h"), "n_games_a": value("games", "a")}
    if list(out) != VECTOR:
        raise ValueError(f"features differ from the schema: {sorted(set(out) ^ set(VECTOR))}")
    return out


def injury_factor(severities: Column, suspended: Column, key_missing: Column) -> Column:
    """Share of its strength that a team has left, 0.5 at least.  severities: an array of levels (unknown ones are medium)."""
    level = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    hurt = F.aggregate(F.coalesce(severities, F.array().cast("array<string>")), F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(level, F.coalesce(x, F.lit("medium"))), F.lit(SEVERITY["medium"])))
    impact = hurt + F.coalesce(suspended, F.lit(0)) * 0.05 + F.when(F.coalesce(key_missing, F.lit(False)), 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.5), 1.0 - impact)


def form_factor(points: Column, games: Column) -> Column:
    """0.8 without a point a game to 1.2 with three; 1 without games."""
    return F.when(F.coalesce(games, F.lit(0)) == 0, 1.0).otherwise(0.8 + (points / games / 3.0) * 0.4)


def travel_factor(km: Column) -> Column:
    return F.when(km > 500, 1.0 - km / 5000.0).otherwise(1.0)


def press_factor(ppda: Column, style: Column) -> Column:
    """Few passes allowed for a defensive action (an unknown or zero number says nothing), or a style of high pressing."""
    return F.when(F.coalesce((ppda != 0) & (ppda < 10.0), F.lit(False)) | F.coalesce(style == "high_press", F.lit(False)), 1.1).otherwise(1.0)


def referee_factor(cards: Column) -> Column:
    return F.coalesce(1.0 + (cards - 3.0) * 0.05, F.lit(1.0))


def context_features(side: dict[str, dict[str, Column]], referee: Column) -> dict[str, Column]:
    """Strengths of both teams after injuries, form, pressing, a new manager, travel and fatigue, and their flags.

    side: for ``h`` and ``a`` the columns severities, suspended, key_missing, points, games, km, new_manager, ppda, style, fatigue, tilt, formation, motive."""
    hurt = {s: injury_factor(x["severities"], x["suspended"], x["key_missing"]) for s, x in side.items()}
    tilted = {s: F.when(F.coalesce(x["tilt"] > 60, F.lit(False)), 1.1).otherwise(1.0) for s, x in side.items()}
    tired = {s: F.coalesce(x["fatigue"], F.lit(1.0)) for s, x in side.items()}
    out = {}
    for s, other, name in (("h", "a", "home"), ("a", "h", "away")):
        x = side[s]
        bounce = F.when(F.coalesce(x["new_manager"], F.lit(False)), 1.05).otherwise(1.0)
        out[f"{name}_att"] = 1.2 * hurt[s] * form_factor(x["points"], x["games"]) * press_factor(x["ppda"], x["style"]) * bounce * travel_factor(x["km"])
        out[f"{name}_def"] = hurt[other] * tired[other] * tilted[other]
        out[f"{name}_formation_att"] = F.when(F.coalesce(x["formation"].isin(*ATTACKING), F.lit(False)), 1.1).otherwise(1.0)
        out[f"{name}_must_win"] = F.coalesce(x["motive"].isin(*MUST_WIN), F.lit(False)).cast("int")
        out[f"{name}_injury_count"] = F.coalesce(F.size(F.coalesce(x["severities"], F.array().cast("array<string>"))), F.lit(0)) + F.coalesce(x["suspended"], F.lit(0))
    out["is_derby"] = (F.coalesce(side["h"]["motive"] == "derby", F.lit(False)) | F.coalesce(side["a"]["motive"] == "derby", F.lit(False))).cast("int")
    out["referee_card_factor"] = referee_factor(referee)
    return out
