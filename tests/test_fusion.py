"""Stages of the fusion by hand: what is unknown changes nothing, and the order counts."""

import pytest
from pyspark.sql import functions as F

from touchline.operators import fusion as U


def one(spark, **values):
    kinds = {k: "boolean" if isinstance(v, bool) else "double" for k, v in values.items()}
    df = spark.createDataFrame([(1, *values.values())], "id int" + "".join(f", {k} {t}" for k, t in kinds.items()))
    return U.fuse(df).first()


def test_without_any_model(spark):
    r = one(spark, other=5.0)
    assert (r.p_h, r.p_d, r.p_a, r.p_btts, r.graph_weight, r.other) == pytest.approx((0.33, 0.34, 0.33, 0.5, 0.0, 5.0))


def test_first_model_and_news(spark):
    r = one(spark, first_h=0.5, first_d=0.3, first_a=0.2, second_h=0.1, second_d=0.1, second_a=0.8, news_h=0.5, news_a=0.0)
    h, d, a = 0.7, 0.3, 0.05
    assert (r.p_h, r.p_d, r.p_a) == pytest.approx((h / 1.05, d / 1.05, a / 1.05))


def test_order_of_blends(spark):
    r = one(spark, second_h=0.6, second_d=0.2, second_a=0.2, graph_h=0.2, graph_d=0.2, graph_a=0.6, graph_recommended=0.1, graph_loss_lift=0.005, graph_accuracy_lift=0.5, tree_h=0.0, tree_d=0.0, tree_a=1.0, goal_h=0.3, goal_d=0.4, goal_a=0.3, goal_fitted=True, goal_o25=0.9, iso_h=0.5, iso_d=None, iso_a=0.5)
    w = 0.16
    p = [0.6 * (1 - w) + 0.2 * w, 0.2, 0.2 * (1 - w) + 0.6 * w]
    for other, v in (([0.0, 0.0, 1.0], 0.15), ([0.3, 0.4, 0.3], 0.22)):
        p = [x * (1 - v) + y * v for x, y in zip(p, other, strict=True)]
    assert r.graph_weight == pytest.approx(w) and (r.p_h, r.p_d, r.p_a) == pytest.approx(p)
    assert r.p_o25 == pytest.approx(0.5 * 0.65 + 0.9 * 0.35)


def test_weights_and_lines(spark):
    x = lambda v: F.lit(v).cast("double")
    r = spark.range(1).select(U.graph_weight(x(None), x(None), x(None)), U.graph_weight(x(0.5), x(1.0), x(0.0)), U.graph_weight(x(-1.0), x(0.0025), x(-2.0)), U.blend_line(x(0.4), x(None)), U.blend_line(x(0.99), x(1.5)), U.unbiased([x(0.5), x(0.3), x(0.2)], [x(4.0), x(None), x(1.0)])[0]).first()
    assert tuple(r) == pytest.approx((0.04, 0.20, 0.06, 0.4, 0.99, 0.98 / (0.98 + 0.3 + 0.2)))
