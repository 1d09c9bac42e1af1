"""Models trained side by side against models trained alone, plain metrics, unseen rows, and isotonic fits against a plain one."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import calibration as K
from touchline.operators import validation as V
from touchline.queries import validation as Q

FEATURES = ["m0", "m1", "m2", "a", "b"]


def data(n=900, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    z = np.stack([0.8 * x[:, 0], 0.3 * x[:, 1], -0.5 * x[:, 0]], 1)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([r.choice(3, p=q) for q in p])
    m = 0.7 * p + 0.1
    rows = []
    for k in range(n):
        market = [float(v) for v in m[k]] if k % 11 else [None, None, None]
        rows.append(("l1" if k % 3 else "l2", 2000 + int(r.integers(0, 6)), k, float(r.integers(0, 2000)), int(y[k]), *market, float(x[k, 0]), float(x[k, 1]) if k % 7 else None))
    return rows


SCHEMA = "league string, year int, id long, age double, y int, m0 double, m1 double, m2 double, a double, b double"


def softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def matrix(rows, columns=range(5)):
    x = np.array([[r[5 + c] or 0.0 for c in columns] for r in rows], float)
    return np.hstack([x, np.ones((len(x), 1))])


def test_side_by_side_equals_alone_and_is_optimal(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    specs = [V.Spec(1.0), V.Spec(5.0, (0, 3)), V.Spec(0.5, None, 400.0), V.Spec()]
    many = df.withColumn("models", F.when(F.col("year") < 2003, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2))))
    w = V.fit_side_by_side(many, FEATURES, specs)
    assert not w[3].any() and not w[1][[1, 2, 4]].any()
    for k, s in enumerate(specs[:3]):
        own = [r for r in rows if (r[1] < 2003) == (k < 2)]
        alone = V.fit_side_by_side(df.filter("year < 2003" if k < 2 else "year >= 2003").withColumn("models", F.array(F.lit(0))), FEATURES, [s])
        assert np.allclose(w[k], alone[0], atol=1e-7)
        x, y = matrix(own), np.array([r[4] for r in own])
        weight = np.ones(len(y)) if s.half_life is None else 0.5 ** (np.array([r[3] for r in own]) / s.half_life)
        wrong = (softmax(x @ w[k]) - np.eye(3)[y]) * weight[:, None]
        slope = x.T @ wrong + s.ridge * w[k]
        seen = [*(range(5) if s.features is None else s.features), 5]
        assert np.abs(slope[seen]).max() < 1e-5


def plain_metrics(p, y):
    return (p.argmax(1) == y).mean(), -np.log(np.clip(p[np.arange(len(y)), y], 1e-6, 1)).mean(), ((p - np.eye(3)[y]) ** 2).sum(1).mean()


def test_walk_forward_by_plain_code(spark):
    rows = data(1500, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.league, r.year): r for r in V.walk_forward(df, FEATURES, FEATURES[:3], 150, 40).collect()}
    want = 0
    for league in ("l1", "l2"):
        for year in range(2000, 2006):
            train, test = [r for r in rows if r[0] == league and r[1] < year], [r for r in rows if r[0] == league and r[1] == year]
            if len(train) < 150 or len(test) < 40:
                assert (league, year) not in got
                continue
            want += 1
            r = got[league, year]
            w = V.fit_side_by_side(spark.createDataFrame(train, SCHEMA).withColumn("models", F.array(F.lit(0))), FEATURES, [V.Spec()])[0]
            z, y = matrix(test) @ w, np.array([x[4] for x in test])
            t = min(V.TEMPERATURES, key=lambda t: round(plain_metrics(softmax(z / t), y)[1], 12))
            p = softmax(z / t)
            priced = np.array([x[5] is not None for x in test])
            m = np.array([x[5:8] for x in test if x[5] is not None], float)
            own, said = plain_metrics(p, y), plain_metrics(m, y[priced])
            blends = []
            for v in V.WEIGHTS:
                b = np.clip(m * (1 - v) + p[priced] * v, 1e-6, 1)
                a = plain_metrics(b / b.sum(1, keepdims=True), y[priced])
                blends.append((round(a[1], 12), -a[0], v, a[2]))
            best = min(blends)
            expect = [*own, priced.mean(), t, *said, best[2], -best[1], best[0], best[3], -best[1] - said[0], said[1] - best[0]]
            names = ["model_accuracy", "model_log_loss", "model_brier", "market_coverage", "temperature", "market_accuracy", "market_log_loss", "market_brier", "blend_weight", "blend_accuracy", "blend_log_loss", "blend_brier", "blend_accuracy_lift", "blend_log_loss_lift"]
            assert (r.train, r.test) == (len(train), len(test))
            assert [r[n] for n in names] == pytest.approx(expect, abs=1.1e-4)
    assert want >= 6
    nothing = V.walk_forward(df.limit(0), FEATURES, FEATURES[:3])
    assert nothing.count() == 0


def test_gate(spark):
    folds = [("good", g, a) for g, a in ((0.01, 0.1), (0.002, -0.1), (-0.001, 0.0))] + [("few", 0.5, 0.5)] * 2 + [("bad", 0.0, 0.1), ("bad", 0.9, 0.1), ("bad", 0.0, 0.1)] + [("small", 0.001, 0.1)] * 3
    got = {r.league: r for r in V.gate(spark.createDataFrame(folds, "league string, blend_log_loss_lift double, blend_accuracy_lift double"), spark.createDataFrame([(x,) for x in ("good", "few", "bad", "small", "none")], "league string")).collect()}
    assert {k for k, r in got.items() if r.enabled} == {"good"} and got["none"].folds == 0
    assert (got["good"].positive_log_loss, got["good"].required, got["good"].positive_accuracy, got["good"].log_loss_lift) == (2, 2, 1, 0.0037)


def test_no_row_is_scored_by_a_model_that_saw_it(spark):
    """The result of one row is changed: nothing that is said of it may move, while other rows' probabilities do."""
    rows = data(300, 3)
    specs = [V.Spec(1.0, (0, 1, 2)), V.Spec(1.0, (3, 4))]
    said = []
    for change in (0, 1, 2):
        own = [(*r[:4], change, *r[5:]) if r[2] == 17 else r for r in rows]
        said.append({r.id: r for r in V.stacked(spark.createDataFrame(own, SCHEMA), ["id"], FEATURES, specs, 3).collect()})
    for later in said[1:]:
        for c in ("p0", "p1", "stacked"):
            assert later[17][c] == pytest.approx(said[0][17][c], abs=1e-7)
        assert max(abs(later[k].stacked[0] - said[0][k].stacked[0]) for k in later) > 1e-5
    assert len(said[0]) == 300 and all(sum(r.stacked) == pytest.approx(1.0) for r in said[0].values())


def test_sweep_judges_unseen_rows(spark):
    rows = data(400, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    specs = [V.Spec(1.0), V.Spec(1e6), V.Spec(1.0, (4,))]
    got = {r.candidate: r for r in V.sweep(df, ["id"], FEATURES, specs, 3).collect()}
    part = {r.id: r.part for r in V.out_of_fold(df, ["id"], FEATURES, specs, 3).collect()}
    for s, spec in enumerate(specs):
        p, y = [], []
        for q in range(3):
            train = spark.createDataFrame([r for r in rows if part[r[2]] != q], SCHEMA).withColumn("models", F.array(F.lit(0)))
            test = [r for r in rows if part[r[2]] == q]
            p.append(softmax(matrix(test) @ V.fit_side_by_side(train, FEATURES, [spec])[0]))
            y += [r[4] for r in test]
        assert (got[s].accuracy, got[s].log_loss, got[s].brier) == pytest.approx(plain_metrics(np.vstack(p), np.array(y)), abs=1e-6)
    assert sorted(got, key=lambda k: got[k].place) == sorted(got, key=lambda k: got[k].log_loss)


def plain_isotonic(points, x):
    """Weighted means by the minimax formula, then straight lines between the fitted places."""
    xs = sorted({a for a, _ in points})
    mean = {a: (sum(y for b, y in points if b == a), sum(1 for b, _ in points if b == a)) for a in xs}
    def avg(i, j):
        return sum(mean[a][0] for a in xs[i : j + 1]) / sum(mean[a][1] for a in xs[i : j + 1])
    fit = [max(min(avg(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))]
    return np.interp(x, xs, fit)


def test_isotonic_by_league(spark):
    r = np.random.default_rng(6)
    rows = []
    for league, n in (("big", 90), ("few", 12), ("old", 60)):
        for k in range(n):
            p = r.dirichlet([2, 2, 2]).round(2)
            rows.append((league, date(2020, 1, 1) + timedelta(days=k), k, 0, 0, 0, "HDA"[r.choice(3, p=p / p.sum())] if k % 9 else None, *map(float, p)))
    rows.append(("big", None, 900, 0, 0, 0, "H", None, 0.3, 0.3))
    rows.append(("big", None, 901, 0, 0, 0, None, 0.0, 1.0, 0.001))
    schema = "league string, match_date date, ok long, ln int, pk long, sk long, ftr string, p_h double, p_d double, p_a double"
    df = spark.createDataFrame(rows, schema)
    got = {(r.league, r.ok): r for r in K.calibrate(df, K.fit_isotonic(df, newest=50, least=20), ["league", "ok"]).collect()}
    assert len(got) == len(rows)
    for league, limit in (("big", 50), ("old", 50)):
        known = sorted((x for x in rows if x[0] == league and x[6] and x[7] is not None), key=lambda x: x[1], reverse=True)[:limit]
        for x in (x for x in rows if x[0] == league and x[7] is not None):
            fit = [plain_isotonic([(k[7 + c], float(k[6] == "HDA"[c])) for k in known], x[7 + c]) for c in range(3)]
            mixed = np.clip([0.3 * x[7 + c] + 0.7 * fit[c] for c in range(3)], 0.01, 0.98)
            g = got[league, x[2]]
            assert (g.cal_h, g.cal_d, g.cal_a) == pytest.approx(mixed / mixed.sum(), abs=1e-9)
    few = got["few", 3]
    assert (few.cal_h, few.cal_d, few.cal_a) == (few.p_h, few.p_d, few.p_a) and got["big", 900].cal_h is None and got["big", 900].cal_d == 0.3
    assert K.fit_isotonic(df.limit(0)).count() == 0


def test_queries(spark, sf_dir):
    rows = Q.outcome_rows(spark, sf_dir)
    folds = Q.m06(spark, sf_dir).collect()
    assert folds and all(f.train >= 500 and f.test >= 80 for f in folds)
    assert {r.league for r in Q.a28(spark, sf_dir).collect()} == {r.league for r in rows.select("league").distinct().collect()}
    one = rows.orderBy("league", "match_date", "ok").limit(300).collect()
    assert any(r.h_gf is None for r in one) and any(r.h_gf is not None for r in one)


def test_importances(spark):
    rows = data(500, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    w = V.fit_side_by_side(df.withColumn("models", F.array(F.lit(0))), FEATURES, [V.Spec()])[0]
    x = matrix(rows)
    centred = w - w.mean(1, keepdims=True)
    assert np.allclose(softmax(x @ w), softmax(x @ centred))
    got = {(r.feature, r["class"]): r for r in V.importances(df, FEATURES).collect()}
    for k, f in enumerate(FEATURES):
        for c in range(3):
            assert got[f, c].weight == pytest.approx(centred[k, c], abs=1e-9) and got[f, c].importance == pytest.approx(abs(centred[k, c]) * x[:, k].std(), abs=1e-9)
    assert sorted(r.place for r in got.values() if r["class"] == 1) == [1, 2, 3, 4, 5]
    assert got["a", 0].place == 1  # the first class was made of it


def test_outcome_rows_are_written_once(spark, sf_dir):
    # a model reads its rows in every step and once more to score them
    assert "Exchange" not in Q.outcome_rows(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_hidden_features_are_of_no_account(spark):
    rows = spark.createDataFrame(data(300, 3), SCHEMA).withColumn("b", F.lit(1e200)).withColumn("models", F.array(F.lit(0), F.lit(1)))
    w = V.fit_side_by_side(rows, FEATURES, [V.Spec(1.0, (0, 3)), V.Spec(1.0, (0, 3), 400.0)])
    alone = V.fit_side_by_side(rows.withColumn("b", F.lit(0.0)), FEATURES, [V.Spec(1.0, (0, 3)), V.Spec(1.0, (0, 3), 400.0)])
    assert np.isfinite(w).all() and np.allclose(w, alone, atol=1e-9)
