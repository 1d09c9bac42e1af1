"""Outcome models trained side by side: walk-forward folds, stacking on out-of-fold predictions, and a sweep.

Many multinomial models that differ in their rows, features, row weights or ridges are fitted together.  A Newton step of all of them
is one pass over the rows and one aggregation of gradients and Hessians, so the data are read once a step and not once a
model.  What comes to the driver in a step has a size of models times parameters squared, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from touchline.durable import materialize

CLASSES = 3
EPS = 1e-6
#: Fixed values of the gate: least folds, share of folds that must gain, least mean gain of log loss.
GATE_FOLDS, GATE_SHARE, GATE_GAIN = 3, 0.60, 0.0015
#: Temperatures and blend weights that are tried.
TEMPERATURES = [0.7 + i * 0.05 for i in range(47)]
WEIGHTS = [i * 0.01 for i in range(36)]


@dataclass(frozen=True)
class Spec:
    """A model: its ridge, the features it sees (by place; None: all), and the half-life of its rows' weights in days (None: all weigh 1)."""

    ridge: float = 1.0
    features: tuple[int, ...] | None = None
    half_life: float | None = None


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _table(columns: list[pa.Array]) -> np.ndarray:
    """Feature columns as a matrix with a column of ones; missing values are 0."""
    x = np.stack([np.nan_to_num(c.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float)) for c in columns], 1)
    return np.hstack([x, np.ones((len(x), 1))])


def _masks(specs: list[Spec], width: int) -> np.ndarray:
    """Which columns each model sees; the ones always."""
    out = np.ones((len(specs), width))
    for k, s in enumerate(specs):
        if s.features is not None:
            out[k, :-1] = 0.0
            out[k, list(s.features)] = 1.0
    return out


def fit_side_by_side(rows: DataFrame, features: list[str], specs: list[Spec], steps: int = 40, tolerance: float = 1e-9) -> np.ndarray:
    """Weights (model, feature and ones, class) of ridge multinomial models.

    rows: features, ``y`` (0 to CLASSES - 1), ``models`` (array of the places in ``specs`` that train on the row), and ``age`` in days
    (for half-lives; may be null).  Each model minimises the weighted cross-entropy plus half its ridge times the squared
    weights.  A step that makes a model's loss larger is halved.  Ends when every gradient's greatest entry is at most ``tolerance`` times
    the model's number of rows.  A model without rows has zero weights."""
    width = len(features) + 1
    size = width * CLASSES
    mask = _masks(specs, width)
    decay = np.array([0.0 if s.half_life is None else 1.0 / s.half_life for s in specs])
    ridges = np.array([s.ridge for s in specs])
    held = rows.select(*[F.col(c).cast("double") for c in features], F.col("y").cast("int"), F.array_join("models", ",").alias("models"), F.col("age").cast("double")).persist(StorageLevel.MEMORY_AND_DISK)
    # both halves of a Hessian are the same, in its features and in its classes
    left, right = np.triu_indices(width)
    one, other = np.triu_indices(CLASSES)
    products, pairs = len(left), len(one)
    same = (one == other).astype(float)
    count = 2 + size + products * pairs

    def totals(weights: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Rows, loss, gradient and Hessian of the models that are asked for.  Rows with the same list of models are worked on at once, and so are
        all models of a list: what differs between models are the chances alone, not the products of features."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(specs), count))
            for batch in batches:
                x = _table(batch.columns[: width - 1])
                y, age = batch.column(width - 1).to_numpy(zero_copy_only=False), batch.column(width + 1).fill_null(0.0).to_numpy(zero_copy_only=False)
                lists = batch.column(width).fill_null("").dictionary_encode()
                at = lists.indices.to_numpy()
                for i, text in enumerate(lists.dictionary.to_pylist()):
                    own = np.flatnonzero(at == i)
                    models, times = np.unique(np.array([int(k) for k in text.split(",") if k], int), return_counts=True)
                    models, times = models[asked[models]], times[asked[models]]
                    if not len(models):
                        continue
                    z, t = x[own], y[own].astype(int)
                    w = times * np.where(decay[models] > 0, 0.5 ** (age[own][:, None] * decay[models]), 1.0)
                    p = _softmax((z @ (weights[models] * mask[models][:, :, None]).transpose(1, 0, 2).reshape(width, -1)).reshape(-1, CLASSES)).reshape(len(own), len(models), CLASSES)
                    hit = p[np.arange(len(own)), :, t]
                    bent = np.empty((len(own), len(models), pairs))
                    for j in range(pairs):
                        bent[:, :, j] = w * p[:, :, one[j]] * (same[j] - p[:, :, other[j]])
                    p[np.arange(len(own)), :, t] -= 1.0
                    gradient = (z.T @ (p * w[:, :, None]).reshape(len(own), -1)).reshape(width, len(models), CLASSES)
                    hessian = ((z[:, left] * z[:, right]).T @ bent.reshape(len(own), -1)).reshape(products, len(models), pairs)
                    sums[models, 0] += len(own) * times
                    sums[models, 1] -= (w * np.log(np.maximum(hit, 1e-300))).sum(0)
                    sums[models, 2 : 2 + size] += gradient.transpose(1, 0, 2).reshape(len(models), -1)
                    sums[models, 2 + size :] += hessian.transpose(1, 0, 2).reshape(len(models), -1)
            for k in np.flatnonzero(sums[:, 0]).tolist():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(count, k, np.int32)), pa.array(np.arange(count, dtype=np.int32)), pa.array(sums[k])], ["model", "k", "v"])

        out = np.zeros((len(specs), count))
        for r in held.mapInArrow(run, "model int, k int, v double").groupBy("model", "k").agg(F.sum("v").alias("v")).collect():  # models x parameters squared
            out[r.model, r.k] = r.v
        return out

    product = np.zeros((width, width), int)
    product[left, right] = product[right, left] = np.arange(products)
    pair = np.zeros((CLASSES, CLASSES), int)
    pair[one, other] = pair[other, one] = np.arange(pairs)

    weights = np.zeros((len(specs), width, CLASSES))
    before, last = weights.copy(), np.full(len(specs), np.inf)
    done = np.zeros(len(specs), bool)
    try:
        for _ in range(steps):
            found = totals(weights, ~done)
            for k in np.flatnonzero(~done):
                n, w = found[k, 0], weights[k].ravel()
                loss = found[k, 1] + ridges[k] / 2 * w @ w
                if loss > last[k] + 1e-9 * max(1.0, abs(last[k])):
                    weights[k] = (weights[k] + before[k]) / 2
                    continue
                seen = np.repeat(mask[k] > 0, CLASSES)
                gradient = np.where(seen, found[k, 2 : 2 + size], 0.0) + ridges[k] * w
                if not n or np.abs(gradient).max() <= tolerance * n:
                    done[k] = True
                    continue
                blocks = found[k, 2 + size :].reshape(products, pairs)[product][:, :, pair].transpose(0, 2, 1, 3)
                hessian = np.where(np.outer(seen, seen), blocks.reshape(size, size), 0.0) + ridges[k] * np.eye(size)
                before[k], last[k] = weights[k], loss
                weights[k] = weights[k] - np.linalg.solve(hessian, gradient).reshape(width, CLASSES)
            if done.all():
                break
    finally:
        held.unpersist()
    return weights * mask[:, :, None]


def logits(weights: np.ndarray, features: list[str], model: Column, chances: bool = False) -> Column:
    """The logits (or probabilities, if ``chances``) of each row under the model whose place ``model`` gives; null without one."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def score(model: pa.Array, *columns: pa.Array) -> pa.Array:
        k = model.fill_null(-1).to_numpy(zero_copy_only=False).astype(int)
        z = np.einsum("nf,nfc->nc", _table(list(columns)), weights[np.maximum(k, 0)])
        z = _softmax(z) if chances and len(z) else z
        return pa.array([v if m >= 0 else None for m, v in zip(k.tolist(), z.tolist(), strict=True)], pa.list_(pa.float64()))

    return score(model, *[F.col(c).cast("double") for c in features])


def probabilities(z: Column, temperature: Column | None = None) -> Column:
    """Softmax of an array column."""
    t = F.lit(1.0) if temperature is None else temperature
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp((x - top) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def _pick(p: Column) -> Column:
    """The first of the most likely classes."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def _metrics(p: Column, y: Column) -> list[Column]:
    """Aggregates of probabilities (array) against classes: accuracy, log loss, Brier score."""
    squares = F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i == y, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda s, v: s + v)
    return [F.avg((_pick(p) == y).cast("double")).alias("accuracy"), _log_loss(F.element_at(p, (y + 1).cast("int"))).alias("log_loss"), F.avg(squares).alias("brier")]


def _softmax_columns(z: list[Column], temperature: Column) -> list[Column]:
    """``probabilities`` of single columns: the same sums in the same order, without a list in each row."""
    e = [F.exp((x - F.greatest(*z)) / temperature) for x in z]
    total = reduce(lambda a, b: a + b, e, F.lit(0.0))
    return [x / total for x in e]


def _own(p: list[Column], y: Column) -> Column:
    """The probability of the row's own class."""
    return reduce(lambda rest, k: F.when(y == k, p[k]).otherwise(rest), range(len(p)), F.lit(None).cast("double"))


def _log_loss(own: Column) -> Column:
    return -F.avg(F.log(F.greatest(F.least(own, F.lit(1.0)), F.lit(EPS))))


def _first_of_best(p: list[Column]) -> Column:
    """``_pick`` of single columns."""
    top = F.greatest(*p)
    return reduce(lambda rest, k: F.when(p[k] == top, k).otherwise(rest), reversed(range(len(p))), F.lit(None).cast("int"))


def history_features(sides: DataFrame, order: list[str]) -> DataFrame:
    """Mean goals for, goals against and points of each side's team over its earlier matches in the league (null for the first)."""
    w = Window.partitionBy("league", "team").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sides.select("*", *[F.avg(c).over(w).alias(f"past_{c}") for c in ("gf", "ga", "pts")])


def folds_of(rows: DataFrame, min_train: int, min_test: int) -> DataFrame:
    """league, year, fold, train, test: the years of each league that have enough rows before them and in them, numbered."""
    by = rows.filter("year is not null").groupBy("league", "year").agg(F.count("*").alias("test"))  # a row for each league and year
    train = F.coalesce(F.sum("test").over(Window.partitionBy("league").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fit = by.withColumn("train", train).filter((F.col("train") >= min_train) & (F.col("test") >= min_test))
    return fit.withColumn("fold", F.row_number().over(Window.orderBy("league", "year")) - 1).select("league", "year", "fold", "train", "test")


def walk_forward(rows: DataFrame, features: list[str], market: list[str], min_train: int = 500, min_test: int = 80, spec: Spec = Spec()) -> DataFrame:
    """One row for each fold: a model of all earlier years of the league, judged on one year, beside the market and blended with it.

    rows: league, year, y, features, three market probabilities (null or zero: none), age.  The temperature is fitted on the judged year, the
    blend weight as well, as the gate compares like with like.  All folds are fitted in the same passes."""
    folds = materialize(folds_of(rows, min_train, min_test))
    specs = [spec] * folds.count()
    lists = folds.groupBy("league").agg(F.collect_list(F.struct("year", "fold")).alias("_folds"))  # the years of a league
    seen = rows.filter("year is not null").join(lists, "league")
    models = F.transform(F.filter("_folds", lambda f: f["year"] > F.col("year")), lambda f: f["fold"])
    weights = fit_side_by_side(seen.withColumn("models", models), features, specs)
    judged = rows.join(folds.select("league", "year", "fold"), ["league", "year"])
    m = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in market])
    scored = materialize(judged.select("fold", "y", m.alias("m"), logits(weights, features, F.col("fold")).alias("z")))
    has = F.aggregate("m", F.lit(0.0), lambda s, v: s + v) > 0
    # rows times temperatures, and rows times weights: plain columns, so that Spark compiles these loops
    hot = scored.select("fold", "y", *[F.col("z")[k].alias(f"z{k}") for k in range(CLASSES)], F.explode(F.array(*[F.lit(t) for t in TEMPERATURES])).alias("t"))
    chances = hot.select("fold", "t", "y", *[c.alias(f"p{k}") for k, c in enumerate(_softmax_columns([F.col(f"z{k}") for k in range(CLASSES)], F.col("t")))])
    loss = chances.groupBy("fold", "t").agg(_log_loss(_own([F.col(f"p{k}") for k in range(CLASSES)], F.col("y"))).alias("l"))
    cooled = loss.groupBy("fold").agg(F.min(F.struct(F.round("l", 12).alias("l"), "t")).alias("b")).select("fold", F.col("b.t").alias("temperature"))
    said = materialize(scored.join(cooled, "fold").select("fold", "y", "m", has.alias("has"), "temperature", probabilities(F.col("z"), F.col("temperature")).alias("p")))
    own = said.groupBy("fold").agg(*[c.alias(f"model_{n}") for c, n in zip(_metrics(F.col("p"), F.col("y")), ("accuracy", "log_loss", "brier"), strict=True)], F.avg(F.col("has").cast("double")).alias("market_coverage"), F.first("temperature").alias("temperature"))
    priced = said.filter("has")
    market_side = priced.groupBy("fold").agg(*[c.alias(f"market_{n}") for c, n in zip(_metrics(F.col("m"), F.col("y")), ("accuracy", "log_loss", "brier"), strict=True)])
    mixed = priced.select("fold", "y", *[F.col(c)[k].alias(f"{c}{k}") for c in ("m", "p") for k in range(CLASSES)], F.explode(F.array(*[F.lit(w) for w in WEIGHTS])).alias("w"))
    mixed = mixed.select("fold", "y", "w", *[F.least(F.lit(1.0), F.greatest(F.lit(EPS), F.col(f"m{k}") * (1 - F.col("w")) + F.col(f"p{k}") * F.col("w"))).alias(f"b{k}") for k in range(CLASSES)])
    parts = [F.col(f"b{k}") for k in range(CLASSES)]
    total = reduce(lambda a, b: a + b, parts, F.lit(0.0))
    mixed = mixed.select("fold", "y", "w", *[(p / total).alias(f"b{k}") for k, p in enumerate(parts)])
    squares = reduce(lambda a, b: a + b, [F.pow(p - F.when(F.col("y") == k, 1.0).otherwise(0.0), 2) for k, p in enumerate(parts)], F.lit(0.0))
    blends = mixed.groupBy("fold", "w").agg(F.avg((_first_of_best(parts) == F.col("y")).cast("double")).alias("accuracy"), _log_loss(_own(parts, F.col("y"))).alias("log_loss"), F.avg(squares).alias("brier"))
    best = blends.groupBy("fold").agg(F.min(F.struct(F.round("log_loss", 12).alias("l"), (-F.col("accuracy")).alias("a"), "w", "brier")).alias("b"))
    best = best.select("fold", F.col("b.w").alias("blend_weight"), (-F.col("b.a")).alias("blend_accuracy"), F.col("b.l").alias("blend_log_loss"), F.col("b.brier").alias("blend_brier"))
    found = folds.join(own, "fold").join(market_side, "fold", "left").join(best, "fold", "left")
    nothing = {"blend_weight": F.lit(0.0)} | {f"blend_{n}": F.col(f"model_{n}") for n in ("accuracy", "log_loss", "brier")}
    found = found.withColumns({c: F.coalesce(c, v) for c, v in nothing.items()} | {f"market_{n}": F.coalesce(f"market_{n}", F.lit(0.0)) for n in ("accuracy", "log_loss", "brier")})
    found = found.withColumns({"blend_accuracy_lift": F.col("blend_accuracy") - F.col("market_accuracy"), "blend_log_loss_lift": F.col("market_log_loss") - F.col("blend_log_loss")})
    whole = ["league", "year", "train", "test"]
    return found.select(*whole, *[(F.round(c, 4) + 0.0).alias(c) for c in found.columns if c not in (*whole, "fold")])


def gate(folds: DataFrame, leagues: DataFrame) -> DataFrame:
    """One row for each league: folds, folds that gain, mean gains, and whether its model is let in.  Leagues without folds are not."""
    gains = lambda c: F.count_if(F.col(c) > 0)
    by = folds.groupBy("league").agg(F.count("*").alias("folds"), gains("blend_log_loss_lift").alias("positive_log_loss"), gains("blend_accuracy_lift").alias("positive_accuracy"), F.avg("blend_log_loss_lift").alias("log_loss_lift"), F.avg("blend_accuracy_lift").alias("accuracy_lift"))
    met = leagues.select("league").distinct().join(by, "league", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("folds", "positive_log_loss", "positive_accuracy", "log_loss_lift", "accuracy_lift")}
    met = met.withColumns(zero).withColumn("required", F.ceil(F.round(F.col("folds") * GATE_SHARE, 9)))
    let_in = (F.col("folds") >= GATE_FOLDS) & (F.col("positive_log_loss") >= F.col("required")) & (F.col("log_loss_lift") >= GATE_GAIN)
    return met.select("league", "folds", "positive_log_loss", "positive_accuracy", "required", F.round("log_loss_lift", 4).alias("log_loss_lift"), F.round("accuracy_lift", 4).alias("accuracy_lift"), let_in.alias("enabled"))


def out_of_fold(rows: DataFrame, key: list[str], features: list[str], specs: list[Spec], parts: int = 5) -> DataFrame:
    """The rows with ``part`` (by a hash of the key) and ``p0``, ``p1``, ...: each spec's probabilities by its model of the other parts.

    All specs and parts are fitted in the same passes.  Rows with equal keys are in one part."""
    part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
    dealt = rows.withColumn("part", part)
    every = [Spec(s.ridge, s.features, s.half_life) for s in specs for _ in range(parts)]
    models = F.array(*[F.lit(k) for k in range(len(every))])
    weights = fit_side_by_side(dealt.withColumn("models", F.filter(models, lambda k: k % parts != F.col("part"))), features, every)
    return dealt.select("*", *[logits(weights, features, F.col("part") + s * parts, True).alias(f"p{s}") for s in range(len(specs))])


def stacked(rows: DataFrame, key: list[str], features: list[str], specs: list[Spec], parts: int = 5, ridge: float = 1.0) -> DataFrame:
    """key, y, part, base probabilities ``p0``, ..., and ``stacked``: a second model on the out-of-fold probabilities of the first ones.

    The second model of part k learns from the other parts; a row of part j enters it with the probabilities of models that were fitted
    without j and without k.  So neither the models that score a row nor anything they learnt from has seen its result.
    All first models are fitted in the same passes, then all second ones."""
    pairs = [(a, b) for a in range(parts) for b in range(a, parts)]  # (k, k): fitted without part k alone
    place = {p: i for i, p in enumerate(pairs)}
    every = [s for s in specs for _ in pairs]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
    without = F.array(*[F.array(*[F.lit(s * len(pairs) + i) for s in range(len(specs)) for i, p in enumerate(pairs) if q not in p]) for q in range(parts)])
    weights = fit_side_by_side(dealt.withColumn("models", F.element_at(without, F.col("part") + 1)), features, every)
    at = F.array(*[F.array(*[F.lit(place[min(j, k), max(j, k)]) for k in range(parts)]) for j in range(parts)])
    several = dealt.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(parts)]))).withColumn("_at", F.element_at(F.element_at(at, F.col("part") + 1), F.col("k") + 1))
    said = [f"s{s}{c}" for s in range(len(specs)) for c in range(CLASSES)]
    scored = several.select(*key, "y", "age", "part", "k", *[logits(weights, features, F.col("_at") + s * len(pairs), True).alias(f"p{s}") for s in range(len(specs))])
    flat = materialize(scored.select("*", *[F.col(f"p{s}")[c].alias(f"s{s}{c}") for s in range(len(specs)) for c in range(CLASSES)]))
    second = fit_side_by_side(flat.filter("k <> part").withColumn("models", F.array("k")), said, [Spec(ridge)] * parts)
    return flat.filter("k = part").withColumn("stacked", logits(second, said, F.col("part"), True)).select(*key, "y", "part", *[f"p{s}" for s in range(len(specs))], "stacked")


def sweep(rows: DataFrame, key: list[str], features: list[str], specs: list[Spec], parts: int = 5) -> DataFrame:
    """candidate, accuracy, log_loss, brier, place: every spec judged on out-of-fold probabilities; the least log loss comes first."""
    judged = materialize(out_of_fold(rows, key, features, specs, parts).select("y", *[f"p{s}" for s in range(len(specs))]))
    long = judged.select("y", F.posexplode(F.array(*[f"p{s}" for s in range(len(specs))])).alias("candidate", "p"))
    by = long.groupBy("candidate").agg(*_metrics(F.col("p"), F.col("y")))
    return by.withColumn("place", F.row_number().over(Window.orderBy("log_loss", "candidate")))  # a row for each candidate


def importances(rows: DataFrame, features: list[str], spec: Spec = Spec()) -> DataFrame:
    """feature, class, weight, spread, importance, place: a model of all rows, and how much each feature moves each class's logit.

    The weight is centred over the classes (a model is the same with a constant added to all of them); importance is its size times
    the feature's standard deviation, missing values counting as 0 as in the model.  Places go by the importance of a class."""
    seen = rows.withColumn("models", F.array(F.lit(0)))
    weights = fit_side_by_side(seen, features, [spec])[0][:-1]
    centred = weights - weights.mean(1, keepdims=True)
    spread = rows.agg(*[F.coalesce(F.stddev_pop(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))), F.lit(0.0)).alias(f"s{k}") for k, c in enumerate(features)]).first()
    made = [(f, c, float(centred[k, c]), float(spread[k])) for k, f in enumerate(features) for c in range(CLASSES)]  # a row for each feature and class
    found = rows.sparkSession.createDataFrame(made, "feature string, class int, weight double, spread double").withColumn("importance", F.abs("weight") * F.col("spread"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("importance"), "feature")))
