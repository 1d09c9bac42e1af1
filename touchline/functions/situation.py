"""Column builders that join a match's model, market and table situation."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.prob import clip

#: Markers of a market's name, in the order in which they are looked for, with the probability meant.
COUNT_MARKERS = ["corners over 8.5", "corners over 9.5", "corners over 10.5", "cards over 3.5", "cards over 4.5", "cards over 5.5", "under 1.5", "under 2.5", "under 3.5"]
LINE_MARKERS = ["btts", "over 2.5", "over 1.5", "over 3.5", "1x", "x2", "dnb"]


def _normalised(probs: list[Column], low: float, high: float) -> list[Column]:
    held = [clip(p, low, high) for p in probs]
    return [p / (held[0] + held[1] + held[2]) for p in held]


def situation_shift(probs: list[Column], pressure: list[Column], rank: list[Column], must_win: list[Column], most: float = 0.065) -> dict[str, Column]:
    """1X2 moved towards the side under more pressure, with the moves; inputs are (home, away) columns."""
    (ph, pd, pa), (h, a), (rh, ra), (mh, ma) = probs, pressure, rank, must_win
    yes = lambda c, x: F.when(c, x).otherwise(0.0)
    move = (h - a) * 0.045 + yes(mh & ~ma, 0.014) - yes(ma & ~mh, 0.014) + yes((h >= 0.65) & (ra - rh >= 0.30), 0.010) - yes((a >= 0.65) & (rh - ra >= 0.30), 0.010)
    move, draw = clip(move, -most, most), yes((h >= 0.45) & (a >= 0.45), 0.010)
    out = _normalised([ph + move, pd + draw, pa - move], 0.03, 0.94)
    return {"p_h": out[0], "p_d": out[1], "p_a": out[2], "applied": (F.abs(move) >= 0.001) | (draw > 0), "home_shift": out[0] - ph, "draw_shift": out[1] - pd, "away_shift": out[2] - pa}


def primary_edge(market: Column, probs: list[Column], implied: list[Column], o25: tuple[Column, Column], btts: tuple[Column, Column]) -> Column:
    """Model less market for the chosen market; o25 and btts are (probability, odds or null); 0 without a price."""
    (h, d, a), (ih, id_, ia) = probs, implied
    priced = lambda name, pair: (market == name) & (pair[1] > 0)
    return (
        F.when(market == "Home Win", h - ih)
        .when(market == "Away Win", a - ia)
        .when(market.startswith("1X"), (h + d) - (ih + id_))
        .when(market.startswith("X2"), (a + d) - (ia + id_))
        .when(priced("Over 2.5", o25), o25[0] - 1 / o25[1])
        .when(priced("BTTS", btts), btts[0] - 1 / btts[1])
        .otherwise(0.0)
    )


def from_double_chance(p_1x: Column, p_x2: Column, dnb: Column) -> list[Column]:
    """H, D, A from double chances; draw-no-bet repairs a side that has nothing left.  Null if a double chance is."""
    d = p_1x + p_x2 - 1.0
    h, a = p_1x - d, p_x2 - d
    repair = dnb.isNotNull() & ((h <= 0) | (a <= 0))
    decided = F.greatest(F.lit(0.01), 1.0 - F.greatest(F.lit(0.0), d))
    return _normalised([F.when(repair, decided * dnb).otherwise(h), d, F.when(repair, decided * (1.0 - dnb)).otherwise(a)], 1e-6, 1.0)


def rating_strength(rating: Column, scale: float = 3.0) -> Column:
    """A rating in [-scale, scale] as a strength in [0, 1]."""
    return clip((rating + scale) / (2.0 * scale), 0.0, 1.0)


def truncated_1x2(home_mu: Column, away_mu: Column, goals: int = 7, clamp: bool = True) -> list[Column]:
    """1X2 of two Poisson scores below ``goals`` each, not renormalised: the draw takes the rest, which ``clamp`` keeps at
    0 or more."""
    pmf = lambda mu, k: F.exp(-mu) * F.pow(mu, F.lit(float(k))) / float(factorial(k))
    h, a = ([pmf(mu, k) for k in range(goals)] for mu in (home_mu, away_mu))
    more = lambda x, y: sum((x[i] * y[j] for i in range(goals) for j in range(i)), F.lit(0.0))
    home, away = more(h, a), more(a, h)
    rest = 1.0 - home - away
    return [home, F.greatest(rest, F.lit(0.0)) if clamp else rest, away]


def market_probability(market: Column, known: dict[str, Column], selected: tuple[Column, Column] | None = None) -> Column:
    """Probability of a market by its name: the router's own value if it chose this market, else the first marker that
    the name contains; sides count 0.72 of their double chance, and unknown names the best common market."""
    name = F.lower(F.coalesce(market, F.lit("")))
    value = lambda m: F.coalesce(known[m], F.lit(0.0))
    best = F.greatest(*[value(m) for m in ("btts", "over 2.5", "over 1.5", "1x", "x2")])
    rules = [(name.contains(m), value(m)) for m in COUNT_MARKERS + LINE_MARKERS if m in known]
    if selected is not None:
        rules.insert(0, ((F.lower(selected[0]) == name) & (name != "") & (selected[1] > 0), selected[1]))
    rules += [(name.contains("home"), value("1x") * 0.72), (name.contains("away"), value("x2") * 0.72)]
    found = F.when(*rules[0])
    for rule in rules[1:]:
        found = found.when(*rule)
    return found.otherwise(best)


def situation_vector(expected: list[Column], form_diff: Column, probs: list[Column], rank: list[Column], pressure: list[Column], odds: list[Column], met: dict[str, Column]) -> dict[str, Column]:
    """28 features of a match.  Odds count only if all three are above 1.01; without them the model stands in for the
    market.  ``met`` holds home_rate, draw_rate, away_rate and goals of earlier meetings, null where there are none."""
    priced = F.coalesce((odds[0] > 1.01) & (odds[1] > 1.01) & (odds[2] > 1.01), F.lit(False))
    book = 1 / odds[0] + 1 / odds[1] + 1 / odds[2]
    over = F.when(priced, book).otherwise(1.0)
    market = [F.when(priced, (1 / o) / book).otherwise(p) for o, p in zip(odds, probs, strict=True)]
    ordered = F.sort_array(F.array(*market), asc=False)
    (xh, xa), (rh, ra), (h, a) = expected, rank, pressure
    out = {"exp_h": xh, "exp_a": xa, "exp_diff": xh - xa, "form_diff": form_diff, "rank_h": rh, "rank_a": ra, "press_h": h, "press_a": a, "p_gap": probs[0] - probs[2], "p_draw": probs[1],
           "press_diff": h - a, "press_max": F.greatest(h, a), "overround": F.least(over, F.lit(1.5)), "confidence": 1 / over, "favourite_gap": ordered[0] - ordered[1]}
    for n, m, p, o in zip("hda", market, probs, odds, strict=True):
        out |= {f"implied_{n}": m, f"value_{n}": p - m, f"odds_{n}": F.when(priced, o).otherwise(0.0)}
    third = F.lit(1 / 3)
    return out | {"met_home": F.coalesce(met["home_rate"], third), "met_draw": F.coalesce(met["draw_rate"], third), "met_away": F.coalesce(met["away_rate"], third), "met_goals": F.coalesce(met["goals"], xh + xa)}
