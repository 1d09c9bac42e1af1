"""Values worked out by hand for situation, market, window and matching rules."""

import math

import pytest
from pyspark.sql import functions as F

from touchline import catalog
from touchline.functions import situation as S
from touchline.functions import text as X
from touchline.operators import reports as R


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lits(*values):
    return [F.lit(v) for v in values]


def test_shift_is_held_and_renormalised(spark):
    # 1.0 * 0.045 + 0.014 + 0.010 = 0.069, held at 0.065; no draw shift, as the away side has no pressure
    got = S.situation_shift(lits(0.5, 0.3, 0.2), lits(1.0, 0.0), lits(0.1, 0.9), lits(True, False))
    p_h, p_d, p_a, applied = one(spark, got["p_h"], got["p_d"], got["p_a"], got["applied"])
    assert (p_h, p_d, p_a) == pytest.approx((0.565, 0.3, 0.135)) and applied
    calm = S.situation_shift(lits(0.5, 0.3, 0.2), lits(0.2, 0.2), lits(0.5, 0.5), lits(True, True))
    assert one(spark, calm["p_h"], calm["applied"]) == (pytest.approx(0.5), False)
    both = S.situation_shift(lits(0.5, 0.3, 0.2), lits(0.5, 0.5), lits(0.5, 0.5), lits(False, False))
    assert one(spark, both["p_d"], both["applied"]) == (pytest.approx(0.31 / 1.01), True)


@pytest.mark.parametrize(
    ("market", "edge"),
    [("Home Win", 0.1), ("Away Win", -0.05), ("1X (Double Chance)", 0.05), ("X2 (Double Chance)", -0.1), ("Over 2.5", 0.1), ("BTTS", 0.0), ("Draw", 0.0)],
)
def test_primary_edge(spark, market, edge):
    found = S.primary_edge(F.lit(market), lits(0.5, 0.25, 0.25), lits(0.4, 0.3, 0.3), tuple(lits(0.6, 2.0)), (F.lit(0.7), F.lit(None).cast("double")))
    assert one(spark, found)[0] == pytest.approx(edge)


def test_double_chance_repair(spark):
    assert one(spark, *S.from_double_chance(F.lit(0.8), F.lit(0.5), F.lit(None).cast("double"))) == pytest.approx((0.5, 0.3, 0.2))
    # the home side has nothing left: 0.6 of 1 - 0.5 is its share
    fixed = one(spark, *S.from_double_chance(F.lit(0.5), F.lit(1.0), F.lit(0.6)))
    assert fixed == pytest.approx((0.3, 0.5, 0.2))
    assert one(spark, *S.from_double_chance(F.lit(None).cast("double"), F.lit(0.5), F.lit(0.5)))[0] is None


def test_strength_and_truncated_scores(spark):
    assert one(spark, *[S.rating_strength(F.lit(x)) for x in (-9.0, -3.0, 0.0, 1.5, 9.0)]) == (0.0, 0.0, 0.5, 0.75, 1.0)
    pmf = lambda mu, k: math.exp(-mu) * mu**k / math.factorial(k)
    home = sum(pmf(1.4, i) * pmf(1.1, j) for i in range(7) for j in range(i))
    away = sum(pmf(1.1, i) * pmf(1.4, j) for i in range(7) for j in range(i))
    assert one(spark, *S.truncated_1x2(F.lit(1.4), F.lit(1.1))) == pytest.approx((home, 1 - home - away, away))


def test_market_probability(spark):
    known = {"corners over 9.5": F.lit(0.4), "btts": F.lit(0.5), "over 2.5": F.lit(0.6), "over 1.5": F.lit(0.7), "1x": F.lit(0.65), "x2": F.lit(None).cast("double")}
    ask = lambda name, chosen=None: one(spark, S.market_probability(F.lit(name), known, chosen))[0]
    assert [ask(n) for n in ("Corners Over 9.5", "BTTS", "Home Win", "Away Win", "X2", "?", None)] == pytest.approx([0.4, 0.5, 0.468, 0.0, 0.0, 0.7, 0.7])
    assert ask("Draw", (F.lit("draw"), F.lit(0.31))) == 0.31 and ask("Draw", (F.lit("draw"), F.lit(0.0))) == 0.7


def test_vector_without_odds_takes_the_model(spark):
    none = F.lit(None).cast("double")
    found = S.situation_vector(lits(1.5, 1.0), F.lit(0.2), lits(0.5, 0.3, 0.2), lits(0.8, 0.4), lits(0.1, 0.6), [F.lit(2.0), F.lit(3.0), none], {"home_rate": none, "draw_rate": none, "away_rate": none, "goals": none})
    assert len(found) == 28
    got = spark.range(1).select(*[c.alias(n) for n, c in found.items()]).first().asDict()
    assert (got["implied_h"], got["value_h"], got["odds_h"], got["overround"], got["confidence"], got["met_goals"]) == (0.5, 0.0, 0.0, 1.0, 1.0, 2.5)
    assert got["favourite_gap"] == pytest.approx(0.2) and got["press_max"] == 0.6 and got["met_home"] == pytest.approx(1 / 3)


def test_dates_and_seasons(spark):
    raws = ["2024-02-03", "2024/02/03", "03/02/2024", "03-02-2024", "2024-2-3", "soon", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, raw string")
    got = [r[0] for r in rows.select(X.parse_day_first(F.col("raw")), "i").orderBy("i").collect()]
    assert [str(d) if d else None for d in got] == ["2024-02-03"] * 4 + [None] * 4
    codes = spark.createDataFrame([(0, "2425"), (1, "0910"), (2, "none"), (3, None)], "i int, c string")
    first, last = X.season_years(F.col("c"))
    assert [tuple(r) for r in codes.orderBy("i").select(first, last).collect()] == [(2024, 2025), (1909, 1910), (2000, 2001), (2000, 2001)]
    dated = rows.select("i", X.parse_date(F.col("raw")).alias("d"))
    kept = lambda *a: sorted(r.i for r in R.date_window(dated, F.col("d"), *a).collect())
    unknown = sorted(r.i for r in dated.filter("d is null").collect())
    assert kept("2024-02-10", 6, 0, True) == unknown
    assert kept("2024-02-10", 7, 0, False) == sorted(set(range(8)) - set(unknown))


def test_leagues(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "league string")
    assert [R.only_leagues(rows, x).count() for x in (None, "a", ["a", "b"], [])] == [3, 1, 2, 0]


def test_calibration(spark):
    rows = spark.createDataFrame([("g", 0.6, 0.3, 0.1, "H"), ("g", 0.6, 0.3, 0.1, "A"), ("g", 0.1, 0.1, 0.8, "A"), ("g", 0.1, 0.1, 0.8, None)], "grp string, p_h double, p_d double, p_a double, ftr string")
    # |0.6 - 0.5| for two of three rows, |0.8 - 1.0| for one
    assert R.multiclass_calibration(rows, "grp").first().ece == pytest.approx((2 * 0.1 + 0.2) / 3)
    assert R.multiclass_calibration(rows.limit(0), "grp").count() == 0


def test_expected_counts_are_pulled(spark):
    rows = [("l", "a", "b", 2, 1, 1), ("l", "b", "a", 1, 1, 2), ("l", "c", "a", None, None, 3)]
    m = spark.createDataFrame([(x, h, a, g, c, k, 0, 0, 0) for x, h, a, g, c, k in rows], "league string, home string, away string, hg int, ag int, ok int, ln int, pk int, sk int")
    got = {r.ok: (r.home_mu, r.away_mu) for r in R.expected_counts(m, "hg", "ag", (0.5, 0.3, 0.2), 2.7, 0.08).collect()}
    h, a = 0.5 * 2 + 0.3 * 2 + 0.2 * 1.5, 1.0
    k = 1 + 0.08 * (2.7 / (h + a) - 1)
    assert got[1] == pytest.approx((h * k, a * k))
    h = 0.5 * 1.5 + 0.3 * 1.0 + 0.2 * 1.5  # c has no counted match at home: the league's mean stands in
    k = 1 + 0.08 * (2.7 / (h + 1.0) - 1)
    assert got[3] == pytest.approx((h * k, 1.0 * k))


def test_greedy_pairs_by_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = [(f"s{s}", f"t{t}", s, t, rnd.choice([0.5, 0.65, 0.7, 0.9])) for s in range(12) for t in range(9)]
    taken, want = set(), set()
    for s in range(12):
        best, at = 0.0, None
        for t in range(9):
            score = next(r[4] for r in rows if r[2] == s and r[3] == t)
            if t not in taken and score > best:
                best, at = score, t
        if at is not None and best >= 0.65:
            taken.add(at)
            want.add((f"s{s}", f"t{at}", best))
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    scored = spark.createDataFrame([("b", *r) for r in shuffled], "block string, src string, dst string, rank int, place int, score double")
    assert {tuple(r) for r in R.greedy_pairs(scored, ["block"]).collect()} == want
    assert R.greedy_pairs(scored.limit(0), ["block"]).count() == 0


def test_registered_matches_use_each_side_once(spark, sf_dir):
    rows = catalog.queries()["j11_one_to_one"](spark, sf_dir).collect()
    assert rows and len({r.src for r in rows}) == len({r.dst for r in rows}) == len(rows) and min(r.score for r in rows) >= 0.65
