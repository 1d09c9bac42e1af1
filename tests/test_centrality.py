"""Graph measures against plain algorithms on small graphs."""

import heapq
import random
from datetime import date
from fractions import Fraction

import numpy as np
import pytest

from touchline.operators import centrality as C
from touchline.queries import graph as Q


def brandes(edges):
    """Weighted betweenness of one league's directed graph, exactly."""
    out, nodes = {}, sorted({x for s, d, _ in edges for x in (s, d)})
    for s, d, w in edges:
        if s != d:
            out.setdefault(s, {})[d] = min(w, out.get(s, {}).get(d, w))
    total = dict.fromkeys(nodes, Fraction(0))
    for source in nodes:
        dist, count, before, order, queue = {}, {source: 1}, {n: [] for n in nodes}, [], [(0, source, source)]
        seen = {source: 0}
        while queue:
            d, _, v = heapq.heappop(queue)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for n, w in out.get(v, {}).items():
                if n in dist:
                    continue
                if d + w < seen.get(n, float("inf")):
                    seen[n], count[n], before[n] = d + w, 0, []
                    heapq.heappush(queue, (d + w, v, n))
                if d + w == seen[n]:
                    count[n] += count[v]
                    before[n].append(v)
        part = dict.fromkeys(nodes, Fraction(0))
        for v in reversed(order):
            for u in before[v]:
                part[u] += Fraction(count[u], count[v]) * (1 + part[v])
            if v != source:
                total[v] += part[v]
    n = len(nodes)
    return {v: float(x / ((n - 1) * (n - 2)) if n > 2 else x) for v, x in total.items()}


def graphs():
    """Ties, several parts, chains, a circle, a star, parallel edges, a loop."""
    r, out = random.Random(4), {}
    for g in range(4):
        n = r.randrange(4, 9)
        pairs = [(a, b) for a in range(n) for b in range(n) if a != b and r.random() < 0.45]
        out[f"random{g}"] = [(f"n{a}", f"n{b}", r.randrange(1, 4)) for a, b in pairs]
    out["chain"] = [(f"n{k}", f"n{k + 1}", 2) for k in range(6)]
    out["circle"] = [(f"n{k}", f"n{(k + 1) % 5}", 1) for k in range(5)]
    out["two parts"] = [("a", "b", 1), ("b", "c", 1), ("x", "y", 3), ("y", "z", 3), ("x", "z", 6)]
    out["parallel"] = [("a", "b", 5), ("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("c", "c", 1)]
    out["pair"] = [("a", "b", 7)]
    return out


def test_betweenness(spark):
    every = graphs()
    rows = [(g, s, d, w) for g, e in every.items() for s, d, w in e]
    got = {(r.league, r.node): r.betweenness for r in C.betweenness(spark.createDataFrame(rows, "league string, src string, dst string, weight int")).collect()}
    want = {(g, n): b for g, e in every.items() for n, b in brandes(e).items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert sum(v > 0 for v in want.values()) > 10


def test_betweenness_of_no_edges_and_of_no_distance(spark):
    none = spark.createDataFrame([], "league string, src string, dst string, weight int")
    assert C.betweenness(none).count() == 0
    with pytest.raises(ValueError):
        C.betweenness(spark.createDataFrame([("l", "a", "b", 0)], none.schema))


def leading(edges):
    nodes = sorted({x for s, d, _ in edges for x in (s, d)})
    at = {v: k for k, v in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for s, d, w in edges:
        m[at[s], at[d]] += w
    v = np.abs(np.linalg.eigh(m)[1][:, -1])
    return {n: v[at[n]] / v.max() for n in nodes}


def test_eigen_centrality(spark):
    r, every = random.Random(5), {}
    for g in range(3):
        pairs = [(a, b) for a in range(9) for b in range(a) if r.random() < 0.6]
        every[f"g{g}"] = [(f"n{a}", f"n{b}", r.random() + 0.1) for a, b in pairs]
    every["halves"] = [("a", "x", 1.0), ("b", "x", 2.0), ("b", "y", 1.5)]  # plus and minus of one eigenvalue
    every["parts"] = [("a", "b", 3.0), ("x", "y", 1.0), ("y", "z", 0.5)]
    every["alone"] = [("a", "a", 2.0)]
    both = {g: e + [(d, s, w) for s, d, w in e if s != d] for g, e in every.items()}
    rows = [(g, s, d, w) for g, e in both.items() for s, d, w in e]
    got = {(x.league, x.node): x.centrality for x in C.eigen_centrality(spark.createDataFrame(rows, "league string, src string, dst string, weight double")).collect()}
    want = {(g, n): c for g, e in both.items() for n, c in leading(e).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    assert {c for (g, _), c in ((k, x.centrality) for x in C.eigen_centrality(spark.createDataFrame(rows, "league string, src string, dst string, weight double"), 0.0, 1, 2).collect() for k in [(x.league, x.node)]) if g == "g0"} == {1.0}


def test_decayed_graph(spark):
    rows = [("l", date(2020, 1, 1), "a", "b", 80), ("l", date(2019, 10, 3), "b", "a", None), ("l", None, "a", "c", 50), ("l", date(2020, 1, 2), "a", "b", 90), ("l", date(2017, 1, 1), "a", "b", 90), ("l", date(2020, 1, 1), "d", "d", 100)]
    got = {(r.src, r.dst): r.weight for r in C.decayed_graph(spark.createDataFrame(rows, "league string, match_date date, home string, away string, q int"), __import__("pyspark.sql.functions", fromlist=["col"]).col("q"), "2020-01-01").collect()}
    assert got == {("a", "b"): pytest.approx(1.3), ("b", "a"): pytest.approx(1.3), ("a", "c"): 0.5, ("c", "a"): 0.5, ("d", "d"): 2.0}


def test_change(spark):
    schema = "league string, node string, centrality double"
    pairs = spark.createDataFrame([("l", "a", "b"), ("l", "a", "c"), ("l", "a", "b")], "league string, a string, b string")
    got = C.centrality_change(pairs, spark.createDataFrame([("l", "a", 1.0)], schema), spark.createDataFrame([("l", "a", 0.6), ("l", "c", 1.0)], schema))
    assert {(r.a, r.b): (r.recent, r.before) for r in got.collect()} == {("a", "b"): (0.75, pytest.approx(0.55)), ("a", "c"): (0.75, pytest.approx(0.8))}


def test_queries_equal_plain_algorithms(spark, sf_dir):
    edges, by = Q.edges(spark, sf_dir).collect(), {}
    for r in edges:
        by.setdefault(r.league, []).append((r.src, r.dst, r.weight))
    want = {(g, n): b for g, e in by.items() for n, b in brandes(e).items()}
    got = {(r.league, r.node): r.betweenness for r in Q.g07_betweenness(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    by = {}
    for r in Q.decayed(spark, sf_dir).collect():
        by.setdefault(r.league, []).append((r.src, r.dst, r.weight))
    want = {(g, n): c for g, e in by.items() for n, c in leading(e).items()}
    got = {(r.league, r.node): r.centrality for r in Q.g03(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)
