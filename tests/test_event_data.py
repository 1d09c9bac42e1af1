"""Archives by member, both event formats from files, full statistics, and JSON merging."""

import json
import zipfile

from pyspark.sql import functions as F

from touchline.operators import match_events as E
from touchline.sources import archives, event_data, files


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return str(path)


def test_members(spark, tmp_path):
    zipped(tmp_path / "a.zip", {"one.csv": "x\n1\n", "two.CSV": "x\n2\n", "three.txt": "no", "sub/": ""})
    zipped(tmp_path / "empty.zip", {})
    (tmp_path / "broken.zip").write_bytes(b"no archive at all")
    (tmp_path / "deep").mkdir()
    zipped(tmp_path / "deep" / "b.zip", {"sub/four.csv": "x\n4\n"})
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(whole.replace(b"x\n1\n", b"x\n9\n"))  # a member whose checksum is wrong
    df = archives.read_members(spark, str(tmp_path), ".csv")
    rows = df.collect()
    assert df.rdd.getNumPartitions() == 6
    got = {(r.archive.rsplit("/", 1)[1], r.member): bytes(r.content).decode() if r.content is not None else None for r in rows}
    assert got == {("a.zip", "one.csv"): "x\n1\n", ("a.zip", "two.CSV"): "x\n2\n", ("b.zip", "sub/four.csv"): "x\n4\n", ("cut.zip", "one.csv"): None, ("cut.zip", "two.CSV"): "x\n2\n", ("broken.zip", None): None}
    assert all((r.error is None) == (r.content is not None) for r in rows)
    assert archives.read_members(spark, str(tmp_path / "empty.zip")).count() == 0
    assert archives.read_members(spark, str(tmp_path / "nowhere")).count() == 0
    assert archives.read_members(spark, f"file://{tmp_path}/a.zip", ".txt").collect()[0].member == "three.txt"


def test_zipped_seasons(spark, tmp_path):
    zipped(tmp_path / "s.zip", {"e0.csv": "Date,HomeTeam,AwayTeam,FTHG,FTAG\n01/02/2020,A,B,1,0\n", "e1.csv": "Date,HomeTeam,AwayTeam,FTHG,FTAG\n02/02/2020,C,D,1,1\n,E,F,0,0\n", "empty.csv": ""})
    got = files.read_zipped_csv(spark, str(tmp_path), ["Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG"])
    assert sorted((r.home, r.ftr) for r in got.collect()) == [("A", "H"), ("C", "D")]


def nested(tmp_path):
    root = tmp_path / "open"
    (root / "matches" / "2").mkdir(parents=True)
    (root / "matches" / "9").mkdir()
    (root / "events").mkdir()
    write = lambda p, x: (root / p).write_text(x if isinstance(x, str) else json.dumps(x))
    write("competitions.json", [{"competition_id": 2, "season_id": 27, "competition_name": "Premier League", "season_name": "15/16"}, {"competition_id": 9, "season_id": 1, "competition_name": "Some Cup", "season_name": "x"}])
    match = lambda i, h, a, **k: {"match_id": i, "match_date": "2016-01-02T10:00", "home_team": {"home_team_name": h}, "away_team": {"name": a}, "home_score": 2, "away_score": 1, **k}
    write("matches/2/27.json", [match(1, "Ajax ", "Leeds"), match(2, "P", "Q"), match(3, "R", "S"), match(4, "", "S"), match(5, "T", "U", match_date=None)])
    write("matches/9/1.json", [match(6, "V", "W")])
    t = lambda n: {"name": n}
    shot = lambda team, outcome, minute, **k: {"type": t("Shot"), "team": t(team), "possession_team": t("Ajax"), "minute": minute, "shot": {"outcome": t(outcome), **k}}
    write("events/1.json", [
        shot("Ajax", "Goal", 15, statsbomb_xg=0.25, one_on_one=True), shot("Ajax", "Saved to Post", 20, statsbomb_xg=0.1), shot("Leeds", "Off T", 80), shot("Leeds", "Goal", 76, statsbomb_xg=0.5),
        {"type": t("Pass"), "team": t("Leeds"), "possession_team": t("Leeds"), "pass": {"type": t("Corner")}}, {"type": t("Pass"), "team": t("Leeds"), "pass": {}},
        {"type": t("Foul Committed"), "team": t("Ajax"), "foul_committed": {"card": t("Second Yellow")}}, {"type": t("Bad Behaviour"), "team": t("Leeds"), "bad_behaviour": {"card": t("Red Card")}},
        {"type": t("Pressure"), "team": t("Ajax")}, {"type": t("Duel"), "team": t("Leeds")}, {"type": t("Interception"), "team": t("Ajax")}, {"type": t("Offside"), "team": t("Ajax")}, {"type": t("Shot"), "team": t("Unknown"), "shot": {"outcome": t("Goal")}}, {"index": 1},
    ])
    write("events/2.json", "[{broken")
    write("events/6.json", [shot("V", "Goal", 1)])
    return str(root)


def test_nested_events(spark, tmp_path):
    matches, events = event_data.read_nested_events(spark, nested(tmp_path))
    assert [tuple(r) for r in matches.select("match_id", "league", "match_date", "home", "away", "hg", "ag").collect()] == [(1, "PremierLeague", "2016-01-02", "Ajax", "Leeds", 2, 1)]
    (r,) = E.match_stats(events, ["match_id"]).collect()
    want = {"hs": 2, "as": 2, "hst": 2, "ast": 1, "hf": 1, "af": 0, "ho": 1, "ao": 0, "hc": 0, "ac": 1, "hy": 1, "ay": 0, "hr": 0, "ar": 1, "hposs": 80.0, "aposs": 20.0, "hxg": 0.35, "axg": 0.5, "hbc": 1, "abc": None,
            "total_events": 14, "home_press": 2, "away_press": 1, "home_press_share": 0.6667, "early_goal": True, "late_goal": True, "intense": False}
    assert {k: r[k] for k in want} == want and set(r.asDict()) == {*want, "match_id"}


def tagged(tmp_path):
    teams = tmp_path / "teams.json"
    teams.write_text(json.dumps([{"wyId": 10, "name": "Ajax"}, {"wyId": 20, "name": "", "officialName": "Leeds United"}, {"name": "nobody"}]))
    match = lambda i, sides, **k: {"wyId": i, "dateutc": "2018-05-01 18:00:00", "teamsData": sides, **k}
    good = {"10": {"side": "home", "score": 1}, "20": {"side": "Away", "score": 0}}
    m = [match(1, good), match(2, {"10": {"side": "home", "score": 1}, "77": {"side": "away"}}), match(3, good), match(4, {}), match(5, good, dateutc="", date=None)]
    tags = lambda *ids: [{"id": i} for i in ids]
    event = lambda team, name, sub="", *ids, sec=0.0, match=1: {"matchId": match, "teamId": team, "eventName": name, "subEventName": sub, "eventSec": sec, "tags": tags(*ids)}
    e = [event(10, "Shot", "Shot", 101, 1801, sec=899.9), event(10, "Shot", "Shot", 1802), event(20, "Shot", "Shot", 1801), event(20, "Free Kick", "Corner"), event(10, "Foul", "Foul", 1702), event(20, "Foul", "Foul", 1703), event(20, "Offside"), event(10, "Pass", "Simple", 1801), event(20, "Duel", "Air", 1801), event(99, "Shot", "Shot", 101), event(10, "Pass", match=2)]
    zipped(tmp_path / "matches.zip", {"matches_England.json": json.dumps(m), "matches_Nowhere.json": json.dumps(m), "matches_Spain.json": "[{broken"})
    zipped(tmp_path / "events.zip", {"events_England.json": json.dumps(e), "readme.txt": "x"})
    return [str(tmp_path / n) for n in ("matches.zip", "events.zip", "teams.json")]


def test_tagged_events(spark, tmp_path):
    matches, events = event_data.read_tagged_events(spark, *tagged(tmp_path))
    assert [tuple(r) for r in matches.collect()] == [(1, "PremierLeague", "2018-05-01", "Ajax", "Leeds United", 1, 0)]
    (r,) = E.match_stats(events, ["match_id"], E.INTENSE_TAGGED, False).collect()
    want = {"hs": 2, "as": 1, "hst": 1, "ast": 1, "hf": 1, "af": 1, "ho": 0, "ao": 1, "hc": 0, "ac": 1, "hy": 1, "ay": 0, "hr": 0, "ar": 1, "hposs": 44.44, "aposs": 55.56, "hxg": None, "axg": None, "hbc": None, "abc": None,
            "total_events": 10, "home_press": 1, "away_press": 1, "home_press_share": 0.5, "early_goal": True, "late_goal": False, "intense": False}
    assert {k: r[k] for k in want} == want and set(r.asDict()) == {*want, "match_id"}


def test_merging_keeps_types_and_other_members(spark):
    rows = [('{"a":1,"event_learning":{"x":"1","y":2.5,"t":[1,2]},"z":{"q":null}}', 3), ('{"event_learning":5}', 4), ("broken{", 5), ("[1]", 6), (None, 7), ("{}", None)]
    df = spark.createDataFrame(rows, "j string, n int")
    got = [json.loads(r[0]) for r in df.select(E.merge_features(F.col("j"), {"y": F.col("n"), "b": F.lit(True)})).collect()]
    assert got[0] == {"a": 1, "z": {"q": None}, "event_learning": {"x": "1", "y": 3, "t": [1, 2], "b": True}}
    assert got[1:] == [{"event_learning": {"y": n, "b": True}} for n in (4, 5, 6, 7, None)]
    known = df.select(E.known_json({"n": F.col("n"), "none": F.lit(None), "c": F.lit("x")}).alias("j"), E.known_map({"n": F.col("n"), "j": F.col("j")}).alias("m")).collect()
    assert json.loads(known[0].j) == {"n": 3, "c": "x"} and json.loads(known[5].j) == {"c": "x"} and known[5].m == {"j": "{}"}
