"""Order in which the models of a match are fused, and the family of blends that it is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.prob import clip
from touchline.functions.situation import situation_shift

THREE = ("h", "d", "a")
LINES = ("btts", "o25", "o15", "o35")
#: What a match without any model has, weights of the models, of news, of the bias, of the isotonic fit, and bounds.
NO_MODEL, NO_LINE = {"h": 0.33, "d": 0.34, "a": 0.33}, 0.5
TREE, GOALS_FITTED, GOALS_RAW, GOAL_LINES, NEWS, BIAS, ISOTONIC = 0.15, 0.22, 0.12, 0.35, 0.4, 0.5, 0.70
GRAPH_LEAST, GRAPH_MOST, GRAPH_BONUS, GRAPH_LIFT = 0.04, 0.20, 0.06, 8.0
LOW, HIGH, NEWS_LOW, NEWS_HIGH, LINE_LOW, LINE_HIGH = 0.01, 0.98, 0.05, 0.95, 0.01, 0.99


def normalised(probs: list[Column], low: float = LOW, high: float = HIGH) -> list[Column]:
    """Clipped, and made to sum to 1."""
    held = [clip(p, low, high) for p in probs]
    total = held[0] + held[1] + held[2]
    return [p / total for p in held]


def blend(base: list[Column], other: list[Column], weight: Column | float) -> list[Column]:
    """A weighted mean of two distributions, clipped and normalised; the base alone where the other or the weight is unknown."""
    w = weight if isinstance(weight, Column) else F.lit(weight)
    mixed = normalised([b * (1.0 - w) + o * w for b, o in zip(base, other, strict=True)])
    known = w.isNotNull()
    for o in other:
        known = known & o.isNotNull()
    return [F.when(known, m).otherwise(b) for m, b in zip(mixed, base, strict=True)]


def blend_line(base: Column, other: Column, weight: float = 0.30) -> Column:
    """A weighted mean of two probabilities in [0.01, 0.99]; the base if the other is unknown."""
    return F.coalesce(clip(base * (1.0 - weight) + other * weight, LINE_LOW, LINE_HIGH), base)


def graph_weight(recommended: Column, loss_lift: Column, accuracy_lift: Column) -> Column:
    """Weight of the graph model: what its validation recommends, 0.04 at least, and a bonus for its lifts, 0.20 at most."""
    up = lambda x: F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0)))
    return F.least(F.lit(GRAPH_MOST), F.greatest(F.lit(GRAPH_LEAST), up(recommended)) + F.least(F.lit(GRAPH_BONUS), up(loss_lift) * GRAPH_LIFT + up(accuracy_lift)))


def unbiased(probs: list[Column], factors: list[Column], alpha: float = BIAS) -> list[Column]:
    """Damped factors of a calibration report; an unknown one is 1."""
    return normalised([p * F.pow(F.coalesce(f, F.lit(1.0)), F.lit(alpha)) for p, f in zip(probs, factors, strict=True)])


def fuse(rows: DataFrame) -> DataFrame:
    """The rows with p_h, p_d, p_a, p_btts, p_o25, p_o15, p_o35 and graph_weight.

    In this order: the first model (``first_...``, moved by the news ``news_h`` and ``news_a``) or, without it, the second (``second_...``); the graph model
    (``graph_...``, weighted by ``graph_recommended`` and its lifts); trees (``tree_...``); the goal model (``goal_...``, heavier if ``goal_fitted``), with the lines; the
    table's situation (press, rank, must of both sides); the bias factors; the isotonic fit (``iso_...``).  Columns may be missing or null: a
    stage whose inputs are unknown changes nothing.  One projection for each stage and no shuffle."""
    have = set(rows.columns)
    get = lambda n: F.col(n) if n in have else F.lit(None).cast("double")
    three = lambda m: [get(f"{m}_{s}").cast("double") for s in THREE]
    now = lambda: [F.col(f"_p_{s}") for s in THREE]
    put = lambda df, probs: df.withColumns({f"_p_{s}": p for s, p in zip(THREE, probs, strict=True)})
    first = get("first_h").isNotNull() & get("first_d").isNotNull() & get("first_a").isNotNull()
    shift = (F.coalesce(get("news_h"), F.lit(0.0)) - F.coalesce(get("news_a"), F.lit(0.0))) * NEWS
    moved = [clip(get("first_h") + shift, NEWS_LOW, NEWS_HIGH), get("first_d"), clip(get("first_a") - shift, NEWS_LOW, NEWS_HIGH)]
    total = moved[0] + moved[1] + moved[2]
    second = [F.coalesce(get(f"second_{s}"), F.lit(NO_MODEL[s])) for s in THREE]
    out = put(rows, [F.when(first, m / total).otherwise(s) for m, s in zip(moved, second, strict=True)])
    lines = {x: F.when(first, F.coalesce(get(f"first_{x}"), F.lit(NO_LINE))).otherwise(F.coalesce(get(f"second_{x}"), F.lit(NO_LINE))) for x in LINES}
    out = out.withColumns({f"_p_{x}": v for x, v in lines.items()})
    graph = three("graph")
    known = graph[0].isNotNull() & graph[1].isNotNull() & graph[2].isNotNull()
    weight = F.when(known, graph_weight(get("graph_recommended"), get("graph_loss_lift"), get("graph_accuracy_lift")))
    out = put(out.withColumn("_graph", weight), blend(now(), graph, F.col("_graph")))
    out = put(out, blend(now(), three("tree"), TREE))
    fitted = F.coalesce(get("goal_fitted").cast("boolean"), F.lit(False))
    out = put(out, blend(now(), three("goal"), F.when(fitted, GOALS_FITTED).otherwise(GOALS_RAW)))
    out = out.withColumns({f"_p_{x}": blend_line(F.col(f"_p_{x}"), get(f"goal_{x}"), GOAL_LINES) for x in LINES})
    pair = lambda n: [get(f"{n}_h"), get(f"{n}_a")]
    place = pair("press")[0].isNotNull() & pair("press")[1].isNotNull()
    told = lambda n, default: [F.coalesce(c.cast("double"), F.lit(default)) for c in pair(n)]
    must = [F.coalesce(c.cast("boolean"), F.lit(False)) for c in pair("must")]
    situation = situation_shift(now(), told("press", 0.0), told("rank", 0.5), must)
    out = put(out, [F.when(place, situation[f"p_{s}"]).otherwise(p) for s, p in zip(THREE, now(), strict=True)])
    out = put(out, unbiased(now(), three("bias")))
    out = put(out, blend(now(), three("iso"), ISOTONIC))
    made = [f"p_{x}" for x in (*THREE, *LINES)]
    kept = [c for c in rows.columns if c not in (*made, "graph_weight")]
    return out.select(*kept, *[F.col(f"_{c}").alias(c) for c in made], F.coalesce("_graph", F.lit(0.0)).alias("graph_weight"))
