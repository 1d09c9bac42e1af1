"""Post-match patterns, rationale drivers and league profiles by hand."""

import pytest
from pyspark.sql import functions as F

from touchline.functions import patterns as P

CALM = {"hs": 10, "as": 9, "hst": 4, "ast": 3, "hc": 5, "ac": 4, "hy": 1, "ay": 1}


def tags(spark, **stats):
    stat = lambda n: F.lit(stats.get(n)).cast("double")
    return [tuple(t) for t in spark.range(1).select(P.match_patterns(stat).alias("t")).first().t]


def test_patterns(spark):
    assert tags(spark, **CALM) == [("standard_match_profile", 0.35, None)]
    assert tags(spark) == [("low_event_data_quality", 0.55, None)]
    half = {"hs": 1, "as": 1, "hst": 1, "ast": 1}
    assert tags(spark, **half) == [("low_event_data_quality", 0.55, None)]
    assert tags(spark, **half, hc=1) == [("standard_match_profile", 0.35, None)]
    carded = tags(spark, **{**CALM, "hy": 4, "ay": 0, "ar": 1})
    assert carded == [("red_card_distortion", 0.92, None), ("cards_spike", 0.82, None), ("discipline_imbalance", 0.72, "home")]
    pressed = tags(spark, **{**CALM, "hg": 0, "ag": 1, "hs": 20, "as": 3, "hst": 4, "ast": 1, "hc": 2, "ac": 10, "hposs": 30, "aposs": 70})
    assert pressed == [
        ("set_piece_pressure", 0.78, "away"),
        ("high_corner_environment", 0.7, None),
        ("shot_on_target_dominance", 0.8, "home"),
        ("away_finishing_outperformed_pressure", 0.66, None),
        ("territory_shot_volume_dominance", 0.68, "home"),
        ("low_shot_quality", 0.7, None),
        ("possession_control", 0.62, "away"),
    ]
    late = tags(spark, **{**CALM, "hg": 3, "ag": 3, "hxg": 1.5, "axg": 2.5, "hbc": 1, "abc": 3, "hf": 15, "af": 8})
    assert late == [("home_finishing_variance", 0.76, None), ("away_xg_underperformance", 0.74, None), ("big_chance_gap", 0.74, "away"), ("foul_pressure_imbalance", 0.6, "home")]


@pytest.mark.parametrize(
    ("h", "d", "a", "o25", "btts", "pressure", "label", "mh", "ma", "corners", "found"),
    [
        (0.7, 0.2, 0.1, 0.5, 0.5, 10, None, 1.0, 1.0, False, ["High Home Win Probability"]),
        (0.3, 0.2, 0.3, 0.5, 0.5, 35, None, 1.1, 0.9, True, ["Standard Match Profile", "Home_Momentum_Spike", "Significant Momentum Imbalance", "Deep Set-Piece Signal"]),
        (0.3, 0.39, 0.41, 0.6, 0.61, 66, None, None, None, False, ["Away Win Lean", "Elevated Draw Probability", "Attacking Overload Expected", "Both Teams Scoring Likelihood", "Critical Motivation: High Pressure"]),
        (None, None, None, None, None, 50, "x", None, None, None, ["Significant Match Pressure"]),
    ],
)
def test_rationale(spark, h, d, a, o25, btts, pressure, label, mh, ma, corners, found):
    num = lambda x: F.lit(x).cast("double")
    p = {"h": num(h), "d": num(d), "a": num(a), "o25": num(o25), "btts": num(btts)}
    got = P.rationale(p, num(pressure), F.lit(label).cast("string"), (num(mh), num(ma)), F.lit(corners).cast("boolean"))
    assert spark.range(1).select(got.alias("d")).first().d == found


def test_profiles(spark):
    rows = spark.createDataFrame([("LaLiga", 1), ("Nowhere", 2), (None, 3)], "league string, id int")
    found = {r.id: (r.tempo, r.card_total_prior, r.style_label) for r in P.with_profiles(rows).collect()}
    assert found == {1: (0.46, 4.85, "structured build-up / higher discipline variance"), 2: (0.5, 4.2, "balanced"), 3: (0.5, 4.2, "balanced")}
    assert P.with_profiles(rows.limit(0)).collect() == []
