"""Values worked out by hand for scraped text, gates, sweeps, lookups and motifs; nulls, empty texts and ties."""

import datetime

import pytest
from pyspark.sql import functions as F

from touchline.functions import scrape as S
from touchline.operators import merge, motifs, temporal

MATCH = "league string, match_date date, home string, away string, ok long, ln int, pk long, sk long"


def null(kind="void"):
    return F.lit(None).cast(kind)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def day(n):
    return datetime.date(2001, 1, n)


@pytest.mark.parametrize(
    ("raw", "name"),
    [("  Real\n Sociedad  Winner: x", "Real Sociedad"), ("A - After Penalties: 4-3 Winner: A", "A"), ("- | A-B | -", "A-B"), ("", ""), (None, ""), ("Winner: A", "")],
)
def test_scraped_team_name(spark, raw, name):
    assert one(spark, S.scraped_team_name(F.lit(raw).cast("string"))) == (name,)


@pytest.mark.parametrize(
    ("raw", "found"),
    [("x ```json\n[1]\n``` [2]", "[1]"), ("```\n[1, [2]] tail\n```", "[1, [2]]"), ("see [1] and [2]", "[1] and [2]"), ("none", None), ("", None), (None, None)],
)
def test_json_list_text(spark, raw, found):
    assert one(spark, S.json_list_text(F.lit(raw).cast("string"))) == (found,)


def test_marks(spark):
    form = F.array(F.lit("W"), F.lit("D"), F.lit("L"), null("string"))
    empty = F.array().cast("array<string>")
    assert one(spark, S.sparkline(form), S.sparkline(empty), S.sparkline(null("array<string>"))) == ("📈➖📉➖", "No Data", "No Data")
    levels = [S.momentum_mark(F.lit(v).cast("double")) for v in (1.1, 1.0, 0.95, 0.5, None)]
    assert one(spark, *levels) == ("🔥", "📈", "➖", "📉", "➖")


@pytest.mark.parametrize(("score", "goals"), [("2-1", (2, 1)), (" 3 - 0 ", (3, 0)), ("2-1-1", (0, 0)), ("4", (0, 0)), ("", (0, 0)), (None, (0, 0)), ("x-1", (0, 0))])
def test_split_score(spark, score, goals):
    assert one(spark, *S.split_score(F.lit(score).cast("string"))) == goals


def test_full_time_result(spark):
    assert one(spark, *[S.full_time_result(F.lit(x)) for x in ("W", "D", "L", "P")]) == ("H", "D", "A", "P")


@pytest.mark.parametrize(
    ("template", "when", "url"),
    [
        ("{date_compact}/{date_ddmmyyyy}/{league_slug}", "2024-03-09T12:00", "20240309/09032024/la-liga"),
        ("{date_slash}:{league}", "2024-03-09", "09/03/2024: La Liga!"),
        ("{date_ddmmyyyy}", "week-12", "week12"),
        ("{round}/{date}", "2024-03-09", "{round}/{date}"),
    ],
)
def test_render_template(spark, template, when, url):
    assert one(spark, S.render_template(F.lit(template), F.lit(when), F.lit(" La Liga!"))) == (url,)


@pytest.mark.parametrize(
    ("raw", "utc"),
    [
        ("2024-07-01T12:00:00.5", "2024-07-01 12:00:00"),
        ("2024-07-01 12:00:00", "2024-07-01 10:00:00"),  # summer time in Berlin
        ("2024-01-01 12:00:00", "2024-01-01 11:00:00"),
        ("2024-07-01T12:00:00-05:30", "2024-07-01 17:30:00"),
        ("2024-07-01T12:00:00+0200", "2024-07-01 10:00:00"),
        ("2024-07-01T12:00:00Z", "2024-07-01 12:00:00"),
        ("2024-07-01", "2024-07-01 00:00:00"),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_utc_timestamp(spark, raw, utc):
    assert one(spark, F.date_format(S.utc_timestamp(F.lit(raw).cast("string"), "Europe/Berlin"), "yyyy-MM-dd HH:mm:ss")) == (utc,)


def test_normalised_and_sentiment(spark):
    values = [S.normalised(F.lit(v).cast("double"), 10.0, 0.3) for v in (5.0, 20.0, -1.0, float("nan"), float("inf"), None)]
    assert one(spark, *values) == (0.5, 1.0, 0.0, 0.3, 0.3, 0.3)
    news = F.expr("array(named_struct('sentiment_score', 0.5D), named_struct('sentiment_score', CAST(NULL AS double)), named_struct('sentiment_score', -0.1D))")
    none = F.expr("CAST(NULL AS array<struct<sentiment_score: double>>)")
    found = one(spark, S.mean_sentiment(news, F.lit(9.0)), S.mean_sentiment(none, F.lit(0.4)), S.mean_sentiment(none, null()))
    assert found == pytest.approx((0.2, 0.4, 0.0))


def test_gates(spark):
    q = S.probability_quality(null("double"), F.lit(1.0), null("double"), F.lit(0.02))
    assert one(spark, q) == pytest.approx((1.0 + 0.35 * 0.7 + 0.03 * 0.08,))
    assert one(spark, S.probability_quality(null("double"), null("double"), F.lit(0.5), F.lit(0.5))) == (None,)
    gate = lambda c, b, ca, ba: S.promoted(*[F.lit(x).cast("double") for x in (c, b, ca, ba)])
    assert one(spark, gate(None, None, 0.4, 0.3), gate(1.0, 0.99, 0.4, 0.3), gate(1.0, 0.999, 0.4, 0.9), gate(1.0, None, 0.0, 0.1)) == (True, True, False, True)
    on = lambda *v: S.graph_model_enabled(*[F.lit(x).cast("double") for x in v])
    assert one(spark, on(30, 0.8, 0.1, 0.02, 0.0), on(29, 0.8, 0.1, 0.02, 0.0), on(30, 0.8, 0.0, 0.02, 0.0), on(30, 0.8, 0.1, 0.01, 0.002)) == (True, False, False, True)


def test_alias_sweep_merges_collisions(spark):
    rows = [("L", day(1), "Old", "B", 1, 1, 1, 1, 7, "r1"), ("L", day(1), "New", "B", 2, 1, 1, 1, None, None), ("L", day(2), "Old", "Old", 3, 1, 1, 1, None, None), ("M", day(1), "Old", "B", 4, 1, 1, 1, 5, None)]
    matches = spark.createDataFrame(rows, MATCH + ", hc int, referee string")
    aliases = spark.createDataFrame([("L", "Old", "New")], "league string, alias string, canonical string")
    found = {tuple(r) for r in merge.alias_sweep(matches, aliases, ["hc", "referee"]).collect()}
    assert found == {("2001-01-01_New_B", "L", 2, 2, 1, 1, 1, 7, "r1"), ("2001-01-02_New_New", "L", 1, 3, 1, 1, 1, None, None), ("2001-01-01_Old_B", "M", 1, 4, 1, 1, 1, 5, None)}
    assert merge.alias_sweep(matches.limit(0), aliases, ["hc"]).collect() == []


def test_intel_lookup(spark):
    fixtures = spark.createDataFrame([("A", "B", "2001-01-01"), ("", "B", "2001-01-01"), ("A", "C", "2001-01-01")], "home string, away string, day string")
    reports = spark.createDataFrame(
        [(" a", "B ", "2001-01-01T10:00", 0.1, 1, 1, 1, 1), ("A", "b", "2001-01-01", 0.2, 2, 1, 1, 1), ("", "B", "2001-01-01", 0.3, 3, 1, 1, 1), (None, "C", "2001-01-01", 0.4, 4, 1, 1, 1)],
        "home string, away string, day string, v double, ok long, ln int, pk long, sk long",
    )
    found = {(r.home, r.away): (r.v, r.intel_ok) for r in merge.intel_lookup(fixtures, reports, "v").collect()}
    assert found == {("A", "B"): (0.2, 2), ("", "B"): (None, None), ("A", "C"): (None, None)}


def test_without_mocks(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id int, is_mock int")
    assert {r.id for r in merge.without_mocks(rows).collect()} == {1, 3}
    assert merge.without_mocks(rows, allowed=True).count() == 3


def edges_of(spark, *pairs):
    return spark.createDataFrame([("L", a, b, float(w)) for a, b, w in pairs], "league string, src string, dst string, weight double")


def test_topology(spark):
    rows = [
        ("L", day(1), "A", "B", 1, 1, 1, 1, 3000.0),
        ("L", day(31), "B", "A", 2, 1, 1, 1, 1300.0),  # the latest match of the pair counts
        ("L", day(31), "C", "A", 3, 1, 1, 1, None),  # unknown: 1200, not above the floor
        ("L", None, "C", "D", 4, 1, 1, 1, 1250.0),  # undated: no decay
        ("L", datetime.date(2002, 1, 1), "A", "D", 5, 1, 1, 1, 2000.0),  # after the reference day
    ]
    matches = spark.createDataFrame(rows, MATCH + ", eqi double")
    found = {(r.src, r.dst): r.weight for r in motifs.topology(matches, F.col("eqi"), "2001-01-31").collect()}
    assert found == {("A", "B"): 1300.0, ("B", "A"): 1300.0, ("C", "D"): 1250.0, ("D", "C"): 1250.0}
    aged = {(r.src, r.dst): r.weight for r in motifs.topology(matches.filter("ok = 1"), F.col("eqi"), "2002-01-01", half_life=365).collect()}
    assert aged[("A", "B")] == pytest.approx(1500.0)


def test_triangles_kills_and_multipliers(spark):
    e = edges_of(spark, ("A", "B", 1400), ("B", "C", 1300), ("C", "A", 1220), ("A", "D", 1300), ("D", "E", 1260), ("D", "F", 1240), ("D", "G", 1270))
    three = motifs.bogey_triangles(e)
    assert [tuple(r) for r in three.collect()] == [("L", "A", "B", "C")]
    kills = motifs.giant_kills(e)
    assert {r.team: r.kills for r in kills.collect()} == {"A": 2.0, "B": 1.0, "D": 2.0}
    assert {r.team: r.kills for r in motifs.giant_kills(e, base=1210.0).collect()} == {"A": 2.0, "B": 1.0, "C": 0.5, "D": 2.5}
    fixtures = spark.createDataFrame([("L", "A", "B"), ("L", "A", "C"), ("L", "D", "A"), ("L", "E", "D"), ("L", "E", "F"), ("M", "A", "B")], "league string, home string, away string")
    found = {(r.league, r.home, r.away): (r.mult_h, r.mult_a) for r in motifs.multipliers(fixtures, e, kills, three).collect()}
    assert found == {
        ("L", "A", "B"): (1.15, 0.85),
        ("L", "A", "C"): (0.85, 1.15),
        ("L", "D", "A"): (1.08, 1.05),
        ("L", "E", "D"): (1.0, 1.05),
        ("L", "E", "F"): (1.0, 1.0),
        ("M", "A", "B"): (1.0, 1.0),
    }


def test_strength_change(spark):
    e = edges_of(spark, ("A", "B", 3), ("B", "A", 1), ("A", "C", 2)).withColumn("recent", F.col("dst") == "C")
    assert {r.team: r.change for r in motifs.strength_change(e).collect()} == {"A": pytest.approx(1 - 0.75), "B": pytest.approx(-0.25)}


def test_known_team_by_last_word(spark):
    known = spark.createDataFrame([("L", "AC Milan"), ("L", "Old Milan"), ("L", "Roma"), ("M", "Lazio"), ("L", "")], "league string, team string")
    rows = spark.createDataFrame([("L", "Roma", 1), ("L", " as  ROMA ", 2), ("L", "Milan", 3), ("L", "Lazio", 4), ("L", None, 5), ("L", " ", 6), ("L", "Roma", 7), (None, "Roma", 8)], "league string, name string, id int")
    found = {r.id: r.team for r in temporal.with_known_team(rows, known, "name", "team").collect()}
    assert found == {1: "Roma", 2: "Roma", 3: "AC Milan", 4: None, 5: None, 6: None, 7: "Roma", 8: None}
