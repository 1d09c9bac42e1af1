"""Matching blocks against the standard library's ratio, and fuzzy matching against plain loops."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from touchline import catalog
from touchline.functions.similarity import block_ratios, with_ratio
from touchline.operators import matching as B
from touchline.operators import matches as M
from touchline.queries.features import _asked
from touchline.queries.quality import canon


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def test_ratio_equals_the_standard_library():
    r, left, right = random.Random(1), [], []
    for _ in range(6000):
        k = r.choice([1, 2, 3, 6, 20])
        a = "".join(chr(97 + r.randrange(k)) for _ in range(r.randrange(0, 18)))
        b = "".join(chr(97 + r.randrange(k)) for _ in range(r.randrange(0, 18))) if r.random() < 0.5 else a[: r.randrange(len(a) + 1)] + "é" * r.randrange(3) + a[r.randrange(len(a) + 1) :]
        left.append(a)
        right.append(b)
    assert block_ratios(left, right).tolist() == [ratio(a, b) for a, b in zip(left, right, strict=True)]
    assert block_ratios([], []).tolist() == []


#: Worked by hand: letters in blocks, and whether the thresholds 0.60, 0.65 and 0.70 are reached.
PAIRS = [
    ("abcd", "bcde", 6 / 8, (True, True, True)),  # bcd
    ("abcdef", "abxdef", 10 / 12, (True, True, True)),  # def, then ab
    ("inter", "inter milan", 10 / 16, (True, False, False)),
    ("milan ac", "ac milan", 10 / 16, (True, False, False)),  # milan, and nothing beside it
    ("ajax", "psv", 0.0, (False, False, False)),
    ("real sociedad", "real madrid", 14 / 24, (False, False, False)),  # "real ", then ad to its right
    ("", "", 1.0, (True, True, True)),
    ("a", "", 0.0, (False, False, False)),
    ("leeds", "leeds utd", 10 / 14, (True, True, True)),
]


def test_hand_worked_pairs():
    got = block_ratios([p[0] for p in PAIRS], [p[1] for p in PAIRS])
    for (a, b, want, reached), g in zip(PAIRS, got, strict=True):
        assert g == pytest.approx(want) and g == ratio(a, b)
        assert tuple(g >= t for t in (0.60, 0.65, 0.70)) == reached


def test_with_ratio_keeps_every_row_of_a_pair(spark):
    rows = [("leeds", "leeds utd", k) for k in range(50)] + [("ajax", "psv", 99), (None, "x", 98), ("x", None, 97)]
    got = with_ratio(spark.createDataFrame(rows, "a string, b string, k int"), "a", "b", "score", 0.7)
    assert sorted(r.k for r in got.collect()) == list(range(50)) and got.columns == ["a", "b", "k", "score"]


def clean(x):
    return re.sub("[^a-z0-9 ]", "", x.lower()).strip()


def plain_best(rows, fixtures):
    """The contract of best_fixture by loops: block, id, home, away of each side."""
    out = []
    for block, i, home, away in rows:
        best, at = 0.0, None
        for fb, j, h, a in sorted(fixtures, key=lambda x: x[1]):
            if fb == block and h and clean(home) and ratio(clean(home), clean(h)) > best:
                best, at = ratio(clean(home), clean(h)), (j, next(x[3] for x in sorted(fixtures, key=lambda x: x[1]) if x[0] == block and clean(x[2]) == clean(h)))
        if at and best >= 0.70 and ratio(clean(away), clean(at[1])) >= 0.60:
            out.append((i, at[0], best, ratio(clean(away), clean(at[1]))))
    return sorted(out)


def teams(seed, n):
    r, stems = random.Random(seed), ["ajax", "leeds", "inter", "milan", "real", "porto", "lyon", "celta"]
    ends = ["", " fc", " utd", "s", " city", ".", " FC", " b"]
    return [(f"d{r.randrange(3)}", k, r.choice(stems) + r.choice(ends), r.choice(stems) + r.choice(ends)) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_best_fixture(spark, seed):
    rows, fixtures = teams(seed, 60), teams(seed + 10, 25) + [("d0", 90, "", "x")]
    asked = spark.createDataFrame(rows, "day string, id int, q_home string, q_away string")
    given = spark.createDataFrame(fixtures, "day string, id int, home string, away string")
    got = B.best_fixture(asked, given, ["day"], ["id"], ["id"])
    assert sorted(tuple(r) for r in got.collect()) == plain_best(rows, fixtures)
    assert B.best_fixture(asked.limit(0), given, ["day"], ["id"], ["id"]).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_one_to_one_of_scored_names(spark, seed):
    rows, fixtures = teams(seed, 40), teams(seed + 10, 30)
    asked = spark.createDataFrame([(d, k, k, h, a) for d, k, h, a in rows], "day string, src int, rank int, q_home string, q_away string")
    given = spark.createDataFrame([(d, k, k, h, a) for d, k, h, a in fixtures], "day string, dst int, place int, home string, away string")
    used, want = set(), set()
    for d, k, h, a in rows:
        best, at = 0.0, None
        for fd, j, fh, fa in fixtures:
            score = (ratio(h.lower(), fh.lower()) + ratio(a.lower(), fa.lower())) / 2
            if fd == d and j not in used and score > best:
                best, at = score, j
        if at is not None and best >= 0.65:
            used.add(at)
            want.add((k, at, best))
    got = B.greedy_pairs(B.scored_fixtures(asked, given, ["day"]), ["day"])
    assert {tuple(r) for r in got.collect()} == want and len(want) > 5


def test_query_equals_loops(spark, sf_dir):
    ids = lambda r: tuple(r[c] for c in M.TIE)
    days = {r.match_date for r in _asked(spark, sf_dir).select("match_date").distinct().orderBy(F.hash("match_date")).limit(25).collect()}
    rows = [((r.league, r.match_date), ids(r), r.q_home, r.q_away) for r in _asked(spark, sf_dir).collect() if r.match_date in days]
    fixtures = [((r.league, r.match_date), ids(r), r.home, r.away) for r in canon(spark, sf_dir).collect() if r.match_date in days]
    want = [(*i, *j, round(h, 9), round(a, 9)) for i, j, h, a in plain_best(rows, fixtures)]
    mine = {tuple(r[c] for c in M.TIE) for r in _asked(spark, sf_dir).collect() if r.match_date in days}
    got = [tuple(r) for r in catalog.queries()["j10_matching_blocks"](spark, sf_dir).collect() if tuple(r)[:4] in mine]
    assert sorted(got) == sorted(want) and want


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_one_to_one_without_pairs_equals_the_rounds(spark, seed):
    """Also with many rows of the same names, null and blank names, and blocks that only one side has."""
    rows, fixtures = teams(seed, 120), teams(seed + 10, 60)
    rows += [("d0", 200 + k, "ajax", "leeds") for k in range(40)] + [("d0", 300, None, "x"), ("d0", 301, " ", "x"), ("d7", 302, "ajax", "psv"), (None, 303, "ajax", "psv")]
    fixtures += [("d0", 200 + k, "ajax fc", "leeds utd") for k in range(9)] + [("d0", 300, None, "x"), ("d8", 301, "ajax", "psv"), (None, 302, "ajax", "psv")]
    asked = spark.createDataFrame([(d, k, k, h, a) for d, k, h, a in rows], "day string, src int, rank int, q_home string, q_away string")
    given = spark.createDataFrame([(d, k, k, h, a) for d, k, h, a in fixtures], "day string, dst int, place int, home string, away string")
    want = {tuple(r) for r in B.greedy_pairs(B.scored_fixtures(asked, given, ["day"]), ["day"]).collect()}
    got = [tuple(r) for r in B.one_to_one(asked, given, ["day"]).collect()]
    assert set(got) == want and len(got) == len(want) > 20


def test_names_meet_names_not_rows(spark):
    """A crowded block: its rows and fixtures are never paired one by one."""
    asked = spark.range(30000).selectExpr("id", "1 AS day", "concat('team ', id % 7, 's') AS q_home", "concat('side ', id % 5) AS q_away")
    given = spark.range(30000).selectExpr("id", "1 AS day", "concat('team ', id % 7) AS home", "concat('side ', id % 5) AS away")
    got = B.best_fixture(asked, given, ["day"], ["id"], ["id"])
    assert got.filter("m_id = id % 7 and home_score < 1").count() == 30000
    numbered = B.one_to_one(asked.withColumnsRenamed({"id": "src"}).withColumn("rank", F.col("src")), given.withColumnsRenamed({"id": "dst"}).withColumn("place", F.col("dst")), ["day"])
    assert numbered.filter("src = dst").count() == 30000
