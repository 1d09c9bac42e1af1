"""Ticket bundles against a plain greedy choice."""

import json
import random

import pytest

from touchline.operators import bundles as B

SCHEMA = "day int, league string, home string, away string, ok long, ln int, pk long, sk long, trust double, edge double, market_p double, ticket_score double"


def rows(seed, leagues):
    r = random.Random(seed)
    return [(r.randrange(4), f"l{r.randrange(leagues)}", *r.sample("ABCDEFG", 2), k, 0, 0, 0, r.choice([10.0, 50.0]), r.choice([0.0, 0.1]), r.choice([0.4, 0.5]), r.choice([1.0, 2.0, 3.0])) for k in range(60)]


def plain(candidates, by):
    at = {"trust": 8, "edge": 9, "market_p": 10, "ticket_score": 11}
    unique, used, leagues, out = len({c[1] for c in candidates}) > 1, set(), set(), []
    for c in sorted(candidates, key=lambda c: (*[-c[at[b]] for b in by], c[4])):
        if len(out) == 3 or (unique and c[1] in leagues) or used & {c[2], c[3]}:
            continue
        out.append(c)
        used |= {c[2], c[3]}
        leagues.add(c[1])
    return out


@pytest.mark.parametrize("leagues", [1, 2, 5])
def test_bundles(spark, leagues):
    table = rows(leagues, leagues)
    df = spark.createDataFrame(table, SCHEMA)
    got = {(r.day, r.kind, r.leg): (r.league, r.home, r.away, r.ok) for r in B.bundles(df, ["day"]).collect()}
    want = {}
    for day in {c[0] for c in table}:
        for kind, by in B.KINDS.items():
            want |= {(day, kind, k + 1): c[1:5] for k, c in enumerate(plain([c for c in table if c[0] == day], by))}
    assert got == want and B.bundles(df.limit(0), ["day"]).count() == 0
    for r in B.bundle_json(B.bundles(df, ["day"]), ["day"], "j").collect():
        said = json.loads(r.j)
        assert list(said) == list(B.KINDS)
        assert all([x["home"] for x in said[k]] == [want[r.day, k, n + 1][1] for n in range(len(said[k]))] for k in said)
