"""Hand-made frames: goldens, edge rows, and properties."""

import datetime as dt
import json
import math
import zipfile

from pyspark.sql import functions as F

from touchline.durable import Materialized
from touchline.functions import prob as P
from touchline.functions import text as X
from touchline.operators import graph as G
from touchline.operators import markets as K
from touchline.operators import matches as M
from touchline.operators import merge as U
from touchline.operators import temporal as T
from touchline.queries import quality
from touchline.queries import temporal as temporal_queries
from touchline.sources import files
from touchline.streaming import odds

SCHEMA = "league string, match_date date, home string, away string, hg int, ag int, odds_h double, odds_a double, hs int, aws int, hc int, ac int, hy int, ay int, referee string, conf double, source string, xg_h double, xg_a double, ok long, ln int, pk long, sk long"


def day(n):
    return dt.date(2023, 8, 1) + dt.timedelta(days=n)


def frame(spark, results):
    rows = [("L", day(d), h, a, hg, ag, 2.0, 3.0, 1, 1, 5, 4, 1, 2, "R", 0.5, "historical_csv", 1.0, 0.5, i, 1, 1, 1) for i, (d, h, a, hg, ag) in enumerate(results)]
    return spark.createDataFrame(rows, SCHEMA)


def test_standings_break_ties(spark):
    m = frame(spark, [(0, "a", "b", 2, 0), (1, "c", "d", 1, 0), (2, "b", "c", 1, 0), (3, "d", "a", 1, 0), (4, "e", "f", 1, 1), (5, "f", "e", 2, 2)])
    got = [(r.team, r.position, r.points) for r in M.standings(m).orderBy("position").collect()]
    assert got == [("a", 1, 3), ("c", 2, 3), ("d", 3, 3), ("b", 4, 3), ("e", 5, 2), ("f", 6, 2)]
    assert M.standings(m).agg(F.sum("gd")).first()[0] == 0
    pressed = M.table_pressure(M.standings(m), spark.createDataFrame([("L", 2, 1)], "league string, season_games int, slots int"))
    assert {r.team: r.label for r in pressed.collect()}["f"] == "Survival must-win"


def test_canonical_is_idempotent_and_prefers_complete_rows(spark):
    m = frame(spark, [(0, "a", "b", 2, 0), (0, " A", "B ", 2, 0)]).withColumn("hc", F.when(F.col("ok") == 0, None).otherwise(F.col("hc")))
    once = M.canonical(m)
    assert [r.ok for r in once.collect()] == [1] and M.canonical(once).count() == 1


def test_features_do_not_see_the_future(spark):
    results = [(d, *("ab" if d % 2 else "ba"), d % 4, (d * 7) % 3) for d in range(12)]
    early, late = M.sides(frame(spark, results[:8])), M.sides(frame(spark, results))
    pick = lambda s: sorted((r.ok, r.team, r.streak) for r in T.streaks(s).filter("ok < 8").collect())
    assert pick(early) == pick(late)
    table = lambda s: sorted((r.match_date, r.team, r.points_before or 0) for r in T.running_standings(s).filter(F.col("match_date") < day(8)).collect())
    assert table(early) == table(late)


def test_streak_after_a_draw_is_zero(spark):
    s = T.streaks(M.sides(frame(spark, [(0, "a", "b", 1, 0), (1, "a", "b", 1, 0), (2, "a", "b", 1, 1), (3, "a", "b", 0, 1), (4, "a", "b", 0, 1)])))
    assert [r.streak for r in s.filter("team = 'a'").orderBy("match_date").collect()] == [0, 1, 2, 0, -1]


def test_score_distribution_golden(spark):
    cols = P.score_distribution(F.lit(1.675), F.lit(1.225))
    row = spark.range(1).select(*[x.alias(n) for n, x in cols.items()], P.poisson_over(9.5, F.lit(9.6)).alias("corners")).first()
    assert abs(row.p_home - 0.4791) < 3e-4 and abs(row.p_btts - 0.574) < 3e-4 and abs(row.p_over25 - 0.5541) < 3e-4 and abs(row.corners - 0.4911) < 3e-4
    assert abs(row.p_home + row.p_draw + row.p_away - 1) < 1e-12


def test_implied_policies(spark):
    df = spark.createDataFrame([(2.0, 4.0, 4.0), (1.0, None, 1.01), (None, 3.0, 3.0)], "h double, d double, a double")
    o = [F.col(c) for c in "hda"]
    got = df.select(*[x.alias(f"o{i}") for i, x in enumerate(P.implied(o))], P.implied(o, "zero")[0].alias("z"), P.implied(o, "strict")[0].alias("s")).collect()
    assert tuple(got[0]) == (0.5, 0.25, 0.25, 0.5, 0.5)
    assert tuple(got[1]) == (None, None, None, 0.0, None)
    assert got[2].o0 == 0.0 and got[2].o1 == 0.5 and got[2].s is None


def test_keys_and_dates(spark):
    df = spark.createDataFrame([("  FC Köln & Co ", "31/12/2023"), ("Real", "2024-07-01"), ("", "x"), (None, None), ("A.C. Milan F.C.", "01/02/24")], "name string, raw string")
    got = df.select(X.team_key(F.col("name")).alias("k"), X.stripped_team_key(F.col("name")).alias("s"), X.season_key(X.parse_date(F.col("raw"))).alias("y")).collect()
    assert [tuple(r) for r in got] == [("fc koln and co", "koln and", "2023-2024"), ("real", "real", "2024-2025"), ("", "", "unknown"), (None, None, "unknown"), ("ac milan fc", "milan", "2023-2024")]


def test_upsert_precedence(spark):
    old = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 2, None)], "id int, core string, stat int, ref string")
    new = spark.createDataFrame([(2, None, None, "n"), (3, "c", 3, "n"), (1, "z", None, "n")], "id int, core string, stat int, ref string")
    assert sorted(map(tuple, U.upsert(old, new, ["id"], ["core"], ["stat"], ["ref"]).collect())) == [(1, "z", 1, "x"), (2, None, 2, "n"), (3, "c", 3, "n")]
    assert sorted(r.id for r in U.insert_ignore(old, new, ["id"], ["core"]).collect()) == [1, 2, 3]


def test_triangles_and_ratings(spark):
    e = spark.createDataFrame([("L", "a", "b", 1), ("L", "b", "c", 1), ("L", "c", "a", 1), ("L", "c", "b", 1)], "league string, src string, dst string, weight int")
    assert [tuple(r) for r in G.triangles(e).collect()] == [("L", "a", "b", "c")]
    assert abs(G.pagerank(e, 5).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    rated = G.replay_ratings(frame(spark, [(0, "a", "b", 3, 0), (1, "a", "b", 0, 0)])).orderBy("ok").collect()
    # by hand: error 3, step 0.105; then error 0 - (0.105 + 0.105) = -0.21, step -0.00735
    assert [(round(r.home_rating, 12), round(r.away_rating, 12)) for r in rated] == [(0, 0), (0.105, -0.105)]
    again = G.replay_ratings(frame(spark, [(0, "a", "b", 3, 0), (1, "a", "b", 0, 0), (2, "b", "a", 0, 0)])).orderBy("ok").collect()[2]
    assert abs(again.home_rating - -0.7 * (0.105 - 0.00735)) < 1e-12 and abs(again.away_rating - 0.7 * (0.105 - 0.00735)) < 1e-12


def test_labels_fall_back_to_means_of_counts(spark):
    rows = frame(spark, [(0, "a", "b", 2, 0), (1, "b", "a", 1, 3), (2, "a", "b", 0, 0), (3, "c", "d", 4, 1)])
    rows = rows.withColumn("hc", F.when(F.col("ok") < 2, F.col("hc"))).withColumn("hy", F.when(~F.col("ok").isin(0, 3), F.col("hy")))
    got = {r.ok: r for r in M.training_labels(rows).collect()}
    # a: 5 corners at home and 4 away, b: 4 and 5
    assert [(got[i].y_corners, got[i].y_cards) for i in range(4)] == [(9.0, -1.0), (9.0, 3.0), (9.0, 3.0), (-1.0, -1.0)]
    assert [(got[i].y_1x2, got[i].y_btts, got[i].y_o15, got[i].y_o25, got[i].y_o35) for i in range(4)] == [(0, 0, 1, 0, 0), (2, 1, 1, 1, 1), (1, 0, 0, 0, 0), (0, 1, 1, 1, 1)]


def test_drift_and_closing_values(spark):
    drift, status, signal = P.market_drift([F.lit(x) for x in (2.0, 3.2, 3.5)], [F.lit(x) for x in (1.9, 3.3, 3.8)])
    hard = P.market_drift([F.lit(x) for x in (2.0, 4.0, 4.0)], [F.lit(x) for x in (4.0, 4.0, 2.0)])
    r = spark.range(1).select(drift.alias("d"), status.alias("s"), signal.alias("f"), hard[0].alias("hd"), hard[1].alias("hs"), hard[2].alias("hf"), P.line_delta(F.lit(2.0), F.lit(4.0)).alias("l"), P.closing_value(F.lit(0.6), F.lit(2.0)).alias("v")).first()
    assert abs(r.d - (1 / 1.9 - 0.5 + 1 / 3.2 - 1 / 3.3 + 1 / 3.5 - 1 / 3.8) / 3) < 1e-12 and (r.s, r.f) == ("Stable", "Follow")
    assert (round(r.hd, 9), r.hs, r.hf) == (round(0.5 / 3, 9), "Volatile (Smart Money Move)", "Follow")
    assert r.l == 0.25 and abs(r.v - 0.1) < 1e-12


def test_a_miss_always_has_a_tag(spark):
    cols = "market string, hit boolean, hg int, ag int, hc int, ac int, hy int, ay int, conf double, edge double, trust double, exp_corners double, exp_cards double"
    rows = [("Under 2.5", False, None, None, 5, 5, 2, 2, 0.9, 0.1, 10.0, 10.0, 4.0), ("Home Win", False, 0, 1, 9, 5, 4, 3, 0.9, 0.1, 10.0, 10.0, 4.0), ("Home Win", False, 1, 1, None, 5, 0, 0, 0.5, 0.0, 80.0, 10.0, 4.0), ("Home Win", True, 1, 0, 1, 1, 1, 1, 0.1, 0.0, 90.0, 1.0, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, cols).select(K.reason_tags()).collect()]
    assert got == [["unclassified_miss"], ["away_upset_or_home_bias", "corners_underestimation", "card_spike_or_referee_distortion"], ["missed_draw", "low_source_confidence", "missing_cards_corners", "no_positive_edge", "high_confidence_miss"], ["hit"]]


def test_head_to_head_form_and_weights(spark, tmp_path):
    """Three queries by hand: wins of the team now at home, points of 15, unknown confidence of 0.9."""
    m = frame(spark, [(0, "a", "b", 2, 0), (1, "b", "a", 0, 1), (2, "a", "b", 0, 0)]).withColumn("conf", F.when(F.col("ok") > 0, F.col("conf")))
    m = m.withColumn("odds_d", F.lit(3.0))
    key = (spark.sparkContext.applicationId, str(tmp_path))
    quality._written[key] = Materialized(m)
    h = {r.match_date: r for r in temporal_queries.w09(spark, str(tmp_path)).collect()}
    assert [(h[day(i)].home_rate, h[day(i)].away_rate, h[day(i)].met) for i in range(3)] == [(0.333333, 0.333333, 0), (0.0, 1.0, 1), (1.0, 0.0, 2)]
    form = {(r.ok, r.team): r.form_last5 for r in temporal_queries.w07(spark, str(tmp_path)).collect()}
    assert (form[0, "a"], form[1, "a"], form[2, "a"], form[2, "b"]) == (0.5, 0.2, 0.4, 0.0)
    weight = {r.match_date: r.weight for r in temporal_queries.w17(spark, str(tmp_path)).collect()}
    assert weight[day(0)] == round(0.9 * math.exp(-2 / 730), 9) and weight[day(2)] == 0.5
    quality._written.pop(key).drop()


def test_pagerank_goes_on_until_ranks_stand_still(spark):
    """A one-way chain of 30 nodes needs 29 rounds; three leave its end far from the fixed point."""
    e = spark.createDataFrame([("L", f"n{i:02}", f"n{i + 1:02}", 1) for i in range(29)] + [("K", "a", "b", 2), ("K", "b", "a", 1), ("K", "b", "c", 3), ("K", "c", "a", 1)], "league string, src string, dst string, weight int")
    want = {("L", f"n{i:02}"): 0.15 / 30 * (1 - 0.85 ** (i + 1)) / 0.15 for i in range(30)}
    k = {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}
    for _ in range(300):
        k = {"a": 0.05 + 0.85 * (k["b"] / 4 + k["c"]), "b": 0.05 + 0.85 * k["a"], "c": 0.05 + 0.85 * k["b"] * 3 / 4}
    want |= {("K", n): r for n, r in k.items()}
    got = {(r.league, r.node): r.rank for r in G.pagerank_converged(e).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    assert G.pagerank_converged(e.limit(0)).count() == 0


def test_every_fixture_is_looked_up_and_every_row_a_rating(spark, sf_dir):
    from touchline import catalog
    from touchline.queries.quality import canon

    rows = canon(spark, sf_dir).collect()
    by = {}
    for r in rows:
        by.setdefault((r.league, r.match_date), []).append(r)
    tie = lambda r: (r.ok, r.ln, r.pk, r.sk)
    want = {}
    for q in rows:
        near = [c for d in range(-2, 3) for c in by.get((q.league, q.match_date + dt.timedelta(days=d)), []) if tie(c) != tie(q) and (q.home in c.home or c.home in q.home) and (q.away in c.away or c.away in q.away)]
        if near:
            last = max(near, key=lambda c: (c.match_date, *tie(c)))
            want[tie(q)] = (f"{last.hg}-{last.ag}", len(near))
    got = {tie(r): (r.score, r.n) for r in catalog.queries()["j12_substring_near_date"](spark, sf_dir).collect()}
    assert got == want and any(k[0] % 40 != 1 for k in got)
    ratings = {}
    for r in rows:
        day_of = ratings.setdefault((r.league, r.home), {})
        day_of[r.match_date] = max(day_of.get(r.match_date, 0.0), 0.5 if r.conf is None else r.conf)
    rated = []
    for c in rows:
        seen = {d: v for d, v in ratings.get((c.league, c.away), {}).items() if d <= c.match_date}
        rated.append((c.league, c.match_date, c.home, c.away, seen[max(seen)] if seen else 0.5))
    assert sorted(map(tuple, catalog.queries()["j07_asof_rating"](spark, sf_dir).collect())) == sorted(rated)


def test_asof_takes_the_last_known_value(spark):
    left = spark.createDataFrame([("x", 5), ("x", 1), ("y", 9)], "k string, t int")
    right = spark.createDataFrame([("x", 2, 0.2), ("x", 5, 0.5), ("x", 6, 0.6)], "k string, t int, v double")
    got = T.asof(left, right, ["k"], ["k"], "t", "v", 0.0)
    assert sorted(map(tuple, got.collect())) == [("x", 1, 0.0), ("x", 5, 0.5), ("y", 9, 0.0)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,B365H,PSH\n31/08/2023,A,B,2,1,H,1.0,2.5\nbad,A,B,1,1,D,2,2\n")
    (tmp_path / "b.csv").write_text("MatchDate,Home,Away,FTHome,FTAway\n2023-09-01,C,D,0,0\n")
    got = files.read_season_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).orderBy("home").collect()
    assert [(r.home, r.ftr, r.odds_h, str(r.match_date)) for r in got] == [("A", "H", 2.5, "2023-08-31"), ("C", "D", None, "2023-09-01")]
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "s.zip", "w") as z:
        z.write(tmp_path / "a.csv", "x/a.csv")
        z.writestr("readme.txt", "no")
    assert files.read_zipped_csv(spark, str(tmp_path / "z"), ["Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG"]).count() == 1
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "m.json").write_text(json.dumps({"matches": [{"date": "2023-08-31", "team1": "A", "team2": "B", "score": {"ft": [1, 0]}}, {"date": "2023-09-01", "team1": "A", "team2": "B"}]}))
    assert sorted((r.hg is None, r.hg) for r in files.read_football_json(spark, str(tmp_path / "j")).collect()) == [(False, 1), (True, None)]
    (tmp_path / "log.json").write_text(json.dumps([{"id": "1", "result": "PENDING"}, {"id": "2", "result": "H"}, {"id": "3"}]))
    assert sorted(r.id for r in files.read_prediction_log(spark, str(tmp_path / "log.json")).collect()) == ["1", "3"]
    files.write_league_json(frame(spark, [(0, "a", "b", 1, 0)]), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_stream_closes_windows_and_survives_restart(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * i), "odd", float(i)) for i in range(40)]
    src = tmp_path / "in"
    spark.createDataFrame(rows[:24], "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    for extra in (None, rows[24:]):
        if extra:
            spark.createDataFrame(extra, schema).coalesce(1).write.mode("append").parquet(str(src))
        odds.run_once(odds.windowed_odds(odds.read_events(spark, str(src), schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("starts").collect()
    assert [(r.n, r.opening, r.closing) for r in got] == [(8, 8.0 * d, 8.0 * d + 7) for d in range(4)]


def test_alias_sets_by_brute_force(spark):
    """Chains, loops, several canonicals of one alias, a name without links."""
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "z"), ("m", "n1"), ("m", "n2"), ("k", "n1"), ("l", "n2"), (None, "q"), ("q", None)]
    names = [*"abcdxyzmkl", "n1", "lonely", "a", None]
    got = {}
    for r in U.alias_sets(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(links * 2, "alias string, canonical string")).collect():
        assert r.other not in got.setdefault(r.name, set())
        got[r.name].add(r.other)
    known = [x for x in links if None not in x]
    want = {}
    for n in set(names) - {None}:
        near = {n} | {c for a, c in known if a == n} | {a for a, c in known if c == n}
        want[n] = near | {a for a, c in known if c in near - {n}}
    assert got == want


def test_keepers_and_versions(spark):
    rows = [("g", 3, 1), ("g", 1, 9), ("g", 1, 2), ("h", 5, 5), (None, 7, 7)]
    got = {(r.a, r.b): (r.keep_a, r.keep_b) for r in U.keepers(spark.createDataFrame(rows, "k string, a int, b int"), ["k"], ["a", "b"]).collect()}
    assert got == {(3, 1): (1, 2), (1, 9): (1, 2), (1, 2): (1, 2), (5, 5): (5, 5), (7, 7): (7, 7)}
    told = spark.createDataFrame([(1, "old", 1, "a", None), (1, "old", 2, "b", 5), (1, "new", 3, None, None), (1, "new", 2, "d", 9), (2, "none", 1, "e", 1), (3, "old", 1, "f", 2)], "id int, role string, v int, core string, stat int")
    out = U.upsert_versions(told, ["id"], F.col("role") == "old", F.col("role") == "new", F.col("v"), ["core"], ["stat"])
    assert sorted(map(tuple, out.collect())) == [(1, None, None), (3, "f", 2)]


def test_canonical_rows_follow_the_files(spark, tmp_path):
    import shutil

    for t in ("lineitem", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(40).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    first = quality.canon(spark, str(tmp_path)).count()
    assert quality.canon(spark, str(tmp_path)).count() == first
    shutil.rmtree(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(400).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert quality.canon(spark, str(tmp_path)).count() > first
    quality.forget_canon()


def test_canonical_rows_are_sorted_only_once_dealt(spark):
    """A sort of what each task reads grows with the files and spills; the rows of a fixture are ranked behind the exchange alone."""
    rows = spark.range(10).selectExpr("concat('l', id % 1) AS league", "date_add(date'2024-01-01', int(id % 1)) AS match_date", "concat('a', id % 1) AS home", "concat('b', id % 1) AS away", "1 AS hg", "0 AS ag", *[f"cast(null as double) AS {c}" for c in [*M.STATS, "conf"]], "cast(null as string) AS source", *[f"id AS {c}" for c in M.TIE])
    found = M.canonical(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.index("Sort [") < plan.index("Exchange hashpartitioning")
    assert [r.ok for r in found.collect()] == [9]
