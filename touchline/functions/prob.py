"""Column builders for odds, probabilities and counts.  None of them runs a job."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """Into [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def outcome(home: Column, away: Column) -> Column:
    """H, D or A from goals; null if one is missing."""
    return F.when(home > away, "H").when(home == away, "D").when(home < away, "A")


def implied(odds: list[Column], policy: str = "open") -> list[Column]:
    """Probabilities from decimal odds.

    ``open``: odds of 1.01 or less count as no price, nulls if no price is left.  ``zero``: the same, zeros instead of
    nulls.  ``strict``: all odds must be above 0, else nulls.  ``raw``: 1/odds, not normalised.  ``partial``: odds above 1 share the
    total of those there are, rounded to four places, the others are null.  ``clipped``: as ``open``, then held in [1e-6, 1] and
    normalised again.  What odds sum to is ``overround``; one clamped price is ``price``.
    """
    if policy == "partial":
        known = [F.when(o > 1, 1 / o) for o in odds]
        total = sum((F.coalesce(k, F.lit(0.0)) for k in known[1:]), F.coalesce(known[0], F.lit(0.0)))
        return [F.round(k / F.when(total > 0, total), 4) for k in known]
    if policy == "clipped":
        held = [clip(p, 1e-6, 1.0) for p in (F.when(o > 1.01, 1 / o).otherwise(F.lit(0.0)) for o in odds)]
        some = sum((F.coalesce(o > 1.01, F.lit(False)).cast("int") for o in odds[1:]), F.coalesce(odds[0] > 1.01, F.lit(False)).cast("int")) > 0
        total = sum(held[1:], held[0])
        return [F.when(some, h / total) for h in held]
    if policy == "raw":
        return [F.when(o > 0, 1 / o) for o in odds]
    if policy == "strict":
        valid = F.lit(True)
        for o in odds:
            valid = valid & F.coalesce(o > 0, F.lit(False))
        total = sum((1 / o for o in odds[1:]), 1 / odds[0])
        return [F.when(valid, (1 / o) / total) for o in odds]
    priced = [F.when(o > 1.01, 1 / o).otherwise(F.lit(0.0)) for o in odds]
    total = sum(priced[1:], priced[0])
    none = F.lit(0.0) if policy == "zero" else F.lit(None).cast("double")
    return [F.when(total > 0, p / F.when(total > 0, total)).otherwise(none) for p in priced]


def overround(odds: list[Column], strict: bool = True) -> Column:
    """What the inverse odds sum to; null if one is missing, or, with ``strict``, not above 0."""
    total = sum((1 / o for o in odds[1:]), 1 / odds[0])
    if not strict:
        return total
    valid = F.lit(True)
    for o in odds:
        valid = valid & F.coalesce(o > 0, F.lit(False))
    return F.when(valid, total)


def poisson_pmf(k: int, mu: Column) -> Column:
    return F.exp(-mu) * F.pow(mu, F.lit(float(k))) / float(factorial(k))


def poisson_over(line: float, mu: Column) -> Column:
    """P(count > line)."""
    return 1 - sum((poisson_pmf(k, mu) for k in range(1, int(line) + 1)), poisson_pmf(0, mu))


def negative_binomial_over(line: float, mu: Column, r: Column) -> Column:
    """P(count > line) with real-valued dispersion r, by the recurrence of the mass function."""
    p = r / (r + mu)
    mass = total = F.pow(p, r)
    for i in range(int(line)):
        mass = mass * (r + i) / (i + 1.0) * (1 - p)
        total = total + mass
    return 1 - total


def count_over(line: float, mu: Column, r: Column) -> Column:
    """Negative binomial if a dispersion is known, else Poisson."""
    low = F.greatest(mu, F.lit(0.01))
    return F.when(r.isNull(), poisson_over(line, low)).otherwise(negative_binomial_over(line, low, F.greatest(r, F.lit(0.1))))


def score_distribution(home_mu: Column, away_mu: Column, most: int = 10) -> dict[str, Column]:
    """1X2 (renormalised), both-score and over lines of two independent Poisson scores up to ``most`` goals each."""
    h = [poisson_pmf(k, F.greatest(home_mu, F.lit(0.05))) for k in range(most + 1)]
    a = [poisson_pmf(k, F.greatest(away_mu, F.lit(0.05))) for k in range(most + 1)]
    add = lambda cells: sum(cells[1:], cells[0])
    below = lambda xs, k: add(xs[:k])
    home = add([h[i] * below(a, i) for i in range(1, most + 1)])
    draw = add([h[i] * a[i] for i in range(most + 1)])
    away = add([a[i] * below(h, i) for i in range(1, most + 1)])
    total = F.greatest(home + draw + away, F.lit(1e-9))
    everything = add(h) * add(a)
    out = {"p_home": home / total, "p_draw": draw / total, "p_away": away / total, "p_btts": add(h[1:]) * add(a[1:])}
    for line in (1, 2, 3):
        under = add([h[i] * a[j] for i in range(line + 1) for j in range(line + 1 - i)])
        out[f"p_over{line}5"] = everything - under
    return out


def entropy(probs: list[Column]) -> Column:
    """Entropy of clipped, renormalised probabilities over its maximum."""
    from math import log

    vals = [clip(F.coalesce(p, F.lit(0.0)), 1e-9, 1.0) for p in probs]
    total = sum(vals[1:], vals[0])
    return -sum(((v / total) * F.log(v / total) for v in vals[1:]), (vals[0] / total) * F.log(vals[0] / total)) / log(len(probs))


def margin(probs: list[Column]) -> Column:
    """The largest minus the second largest probability."""
    ordered = F.sort_array(F.array(*[F.coalesce(p, F.lit(0.0)) for p in probs]), asc=False)
    return ordered[0] - ordered[1]


def metric_quality(brier: Column, ece: Column) -> Column:
    return clip(0.65 * clip((0.30 - brier) / 0.16, 0.0, 1.0) + 0.35 * clip(1.0 - ece / 0.16, 0.0, 1.0), 0.0, 1.0)


def edge_quality(edge: Column, trust: Column, volatility: Column, drift: Column) -> tuple[Column, Column]:
    """Score and tier of a value edge."""
    factor = F.when(drift > 0.01, 1.2).when(drift < -0.01, 0.8).otherwise(1.0)
    raw = edge * 100 * trust * F.greatest(F.lit(0.1), 10 - volatility) * factor / F.greatest(F.lit(1.0), volatility * 2)
    score = F.when(edge > 0, raw).otherwise(F.lit(0.0))
    return score, F.when(score > 120, "SHARP EDGE").when(score > 80, "PLAYABLE").when(score > 50, "WEAK EDGE").otherwise("NO EDGE")


def stake(edge: Column, trust: Column, tier: Column) -> Column:
    base = F.greatest(F.lit(0.0), edge * 100 * trust / 100)
    return F.when(tier == "SHARP EDGE", F.least(base, F.lit(10.0))).when(tier == "PLAYABLE", F.least(base, F.lit(5.0))).when(tier == "WEAK EDGE", F.least(base, F.lit(2.0))).otherwise(F.lit(0.0))


def decay(days: Column, half_life: float) -> Column:
    """0.5 ** (days / half_life); future dates count as today, unknown ones as 1."""
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(days.cast("double"), F.lit(0.0)) / half_life), F.lit(1.0))


def price(odd: Column) -> Column:
    """Implied probability of one decimal price, in [0.01, 0.99]."""
    return clip(1 / odd, 0.01, 0.99)


def line_delta(opening: Column, current: Column) -> Column:
    """Implied probability at the opening less the current one."""
    return price(opening) - price(current)


def closing_value(model: Column, current: Column) -> Column:
    """The model's probability less the current implied one; positive is an edge."""
    return model - price(current)


def market_drift(opening: list[Column], current: list[Column]) -> tuple[Column, Column, Column]:
    """Mean absolute move of the raw implied probabilities, its status, and whether the current favourite's move is
    followed (above 0.01) or fading."""
    now, moves = F.array(*[1 / c for c in current]), F.array(*[1 / c - 1 / o for o, c in zip(opening, current, strict=True)])
    size = F.aggregate(moves, F.lit(0.0), lambda s, x: s + F.abs(x)) / len(opening)
    status = F.when(size > 0.05, "Volatile (Smart Money Move)").when(size > 0.02, "Correcting").otherwise("Stable")
    favourite = F.element_at(moves, F.array_position(now, F.array_max(now)).cast("int"))
    return size, status, F.when(favourite > 0.01, "Follow").otherwise("Fading")


#: Tiers of trust by their least score, and the move of the closing line beyond which a badge says so.
TRUST_TIERS = [(70, "HIGH TRUST"), (45, "PLAYABLE TRUST"), (25, "LOW TRUST")]
BADGE_MOVE = 0.01


def trust_score(raw: Column) -> Column:
    """A whole number from 1 to 100; 1 if it is unknown."""
    return F.coalesce(clip(F.floor(F.nanvl(raw.cast("double"), F.lit(None).cast("double")) + 0.5), 1, 100).cast("int"), F.lit(1))


def trust_tier(score: Column) -> Column:
    out = F.lit("WATCHLIST")
    for least, name in reversed(TRUST_TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def sentiment_badge(move: Column) -> Column:
    return F.when(move > BADGE_MOVE, "Sharp Backing").when(move < -BADGE_MOVE, "Market Drift").otherwise("Neutral Sentiment")


def singularity(p: Column, move: Column, edge: Column, trust: Column) -> Column:
    """A very sure choice that the closing line confirms, or four good signs at once; unknown values count as 0."""
    p, move, edge = (F.coalesce(x, F.lit(0.0)) for x in (p, move, edge))
    return ((p >= 0.82) & (move > 0.03)) | ((trust >= 78) & (p >= 0.68) & (move > 0.02) & (edge > 0.04))
