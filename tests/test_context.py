"""The schema of the vector, and multipliers worked by hand."""

import pytest
from pyspark.sql import functions as F

from touchline.functions import context as C


def test_the_vector_follows_its_schema(spark):
    one = F.lit(0.2)
    v = C.enhanced_vector(dict.fromkeys(("hh", "ha", "ah", "aa"), one), (F.lit(1.0), F.lit(1.0)), [F.lit(None).cast("double")] * 3, {"sot_h": F.lit(6), "sot_a": F.lit(0)})
    assert list(v) == C.VECTOR and len(C.VECTOR) == 36
    r = spark.range(1).select(*[x.alias(n) for n, x in v.items()]).first()
    total = 1 / 2 + 1 / 3.2 + 1 / 3.5
    assert (r.exp_h, r.exp_a, r.mom_h, r.corn_total, r.sot_ratio, r.n_games_a) == pytest.approx((1.3, 1.1, 0.5, 10.0, 60.0, 15.0))
    assert (r.imp_h, r.imp_h + r.imp_d + r.imp_a) == pytest.approx((0.5 / total, 1.0)) and r.p_h + r.p_d + r.p_a == pytest.approx(1.0)
    with pytest.raises(KeyError):
        C.enhanced_vector({"hh": one}, (one, one), [one] * 3, {})


def test_multipliers_by_hand(spark):
    rows = [(["low", "high", None, "odd"], 2, True, 9, 5, 1000.0, 9.0, None), (None, None, None, 0, 0, None, 0.0, "high_press"), (["season_ending"] * 9, 0, False, 15, 5, 500.0, None, "x")]
    df = spark.createDataFrame(rows, "s array<string>, n int, k boolean, p int, g int, km double, ppda double, style string")
    c = F.col
    got = df.select(C.injury_factor(c("s"), c("n"), c("k")), C.form_factor(c("p"), c("g")), C.travel_factor(c("km")), C.press_factor(c("ppda"), c("style")), C.referee_factor(c("p").cast("double"))).collect()
    want = [(1 - (0.02 + 0.10 + 0.05 + 0.05 + 0.10 + 0.15), 0.8 + 9 / 5 / 3 * 0.4, 0.8, 1.1, 1.3), (1.0, 1.0, 1.0, 1.1, 0.85), (0.5, 1.2, 1.0, 1.0, 1.6)]
    for a, b in zip(got, want, strict=True):
        assert tuple(a) == pytest.approx(b)
