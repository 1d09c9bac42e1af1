"""Sequences against a plain encoder, in both sets of constants, and that no later match is seen."""

import datetime as dt
import random

import pytest

from touchline.operators import sequences as S

ORDER = ["match_date", "ok", "was_home"]
SCHEMA = "league string, match_date date, ok long, home string, away string, hg int, ag int, hs int, aws int, hc int, ac int, hy int, ay int, xg_h double, xg_a double"


def matches(seed=1, n=90):
    r, out, day = random.Random(seed), [], dt.date(2023, 8, 1)
    for k in range(n):
        home, away = r.sample("ABC", 2)
        day += dt.timedelta(days=r.choice([0, 2, 5, 9]))
        maybe = lambda v: v if r.random() < 0.8 else None
        out.append(("l", day, k, home, away, r.randrange(8), r.randrange(4), maybe(r.randrange(30)), maybe(9), maybe(r.randrange(20)), maybe(4), maybe(r.randrange(10)), maybe(1), maybe(r.random() * 3), maybe(r.random() * 3)))
    return out


def plain(history, served):
    """The steps of one sequence from its matches, oldest first: (day, home?, gf, ga, shots, against, corners, cards, xg, xga)."""
    held = lambda x, scale, default: default if x is None else max(0.0, min(1.0, x / scale))
    out, points = [list(S.SERVED_PAD if served else S.TRAINED_PAD) for _ in range(20 - len(history))], []
    for i, (day, home, gf, ga, sf, sa, co, ca, xf, xa) in enumerate(history):
        p = 3 if gf > ga else 1 if gf == ga else 0
        run = 0
        for q in reversed(points):
            d = (q == 3) - (q == 0)
            if d == 0 or (run and d * run < 0):
                break
            run += d
        form = sum(points[-5:]) / 15 if points else 0.5
        both = xf is not None and xa is not None
        gap = max(0.0, min(1.0, (xf - xa + 3) / 6)) if both else 0.5
        if served:
            rest = 0.43 if i == 0 else min(1.0, (day - history[i - 1][0]).days / 7)
            row = [min(1, gf / 5), min(1, ga / 5), p / 3, 0.45, 0.45, 0.4, 0.4, 0.35, 0.25, gap, min(1, xf / 2) if both else 0.5, min(1, xa / 2) if both else 0.5, 0.5, 0.5, rest, home, day.timetuple().tm_yday / 365, 0.0, 0.0, 0.25]
        else:
            row = [min(1, gf / 5), min(1, ga / 5), p / 3, held(sf, 25, 0.45), held(sa, 25, 0.45), 0.4, 0.4, held(co, 15, 0.35), held(ca, 8, 0.25), gap, held(xf, 2, 0.5), held(xa, 2, 0.5), 0.5, 0.5, 3 / 7, home, 20 / 52, 0.0, 0.0, 0.25]
        out.append([*row, max(-1, min(1, run / 5)), form])
        points.append(p)
    return out


@pytest.mark.parametrize("served", [False, True])
def test_sequences(spark, served):
    rows = matches()
    got = S.encode(S.team_matches(spark.createDataFrame(rows, SCHEMA), ["ok"]), ORDER, served).collect()
    assert len(got) == 2 * len(rows)
    for g in got:
        history = []
        for _, day, ok, home, away, hg, ag, hs, aws, hc, ac, hy, ay, xh, xa in rows:
            if ok < g.ok and g.team in (home, away):
                history.append((day, 1.0, hg, ag, hs, aws, hc, hy, xh, xa) if home == g.team else (day, 0.0, ag, hg, aws, hs, ac, ay, xa, xh))
        want = plain(history[-20:], served)
        assert g.mask == [0] * (20 - len(history[-20:])) + [1] * len(history[-20:])
        assert [len(x) for x in g.sequence] == [22] * 20
        for a, b in zip(g.sequence, want, strict=True):
            assert a == pytest.approx(b, abs=1e-12)


def test_a_later_match_changes_nothing(spark):
    rows = matches(2, 40)
    later = [*rows[:30], *[(*r[:5], 7, 0, *r[7:]) for r in rows[30:]]]
    said = []
    for table in (rows, later):
        m = S.team_matches(spark.createDataFrame(table, SCHEMA), ["ok"])
        free = S.rolling_means(m, ORDER, ["gf", "ga"], False)
        said.append({(r.ok, r.team): (r.sequence, r.mean_gf, r.mean_ga) for r in S.encode(free, ORDER).collect() if r.ok <= 30})
    assert said[0] == said[1]
    static = [{(r.ok, r.team): r.mean_gf for r in S.rolling_means(S.team_matches(spark.createDataFrame(t, SCHEMA), ["ok"]), ORDER, ["gf"], True).collect() if r.ok < 30} for t in (rows, later)]
    assert static[0] != static[1]  # the parity mode knows the future, and says so


def test_empty(spark):
    none = S.team_matches(spark.createDataFrame([], SCHEMA), ["ok"])
    assert S.encode(none, ORDER).count() == 0 and S.rolling_means(none, ORDER, ["gf"], True).count() == 0
