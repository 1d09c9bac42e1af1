"""Periodic runs against plain scans, and the suffix tree against sorted suffixes."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.fixtures import documents, empty
from touchline.llm import periodic_runs as P
from touchline.llm import queries as Q
from touchline.llm.common import table


def brute(w, least=6, power=4):
    """Every period, every stretch that keeps it; non-primitive periods are left out by trying smaller ones."""
    n, out = len(w), set()
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, power * q) and not any(all(w[k] == w[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(r, letters, n):
    w = []
    while len(w) < n:
        w += [r.randrange(letters) for _ in range(r.randrange(1, 7))] * (r.randrange(1, 7) if r.random() < 0.5 else 1)
    return w


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_equal_brute_force(letters):
    r = random.Random(letters)
    for _ in range(400):
        w = periodic_words(r, letters, r.randrange(0, 70))
        assert P.find_runs([b"%d" % x for x in w]) == brute(w)
        assert P.runs_of(w, 2, 2) == brute(w, 2, 2)


def test_every_short_word_of_two_letters():
    for n in range(13):
        for bits in range(1 << n):
            w = [bits >> k & 1 for k in range(n)]
            assert P.runs_of(w, 2, 2) == brute(w, 2, 2)


def test_tree_orders_suffixes_and_answers_extensions():
    r = random.Random(9)
    for _ in range(60):
        w = periodic_words(r, 3, r.randrange(1, 40))
        depths, place, rank = P.SuffixTree([*w, -1]).tour()
        ends = [[*w[k:], -1] for k in range(len(w) + 1)]
        assert np.argsort(rank).tolist() == sorted(range(len(ends)), key=lambda k: ends[k])
        pairs = [(i, j) for i in range(len(ends)) for j in range(len(ends)) if i != j]
        if not pairs:
            continue
        got = P.common_extension(depths, place, *np.array(pairs).T)
        for (i, j), n in zip(pairs, got, strict=True):
            assert ends[i][:n] == ends[j][:n] and ends[i][n] != ends[j][n]


def contract(number, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(number).encode())
    if number is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (number, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w[k] for k in range(n) if k not in gone)))


def key(r):
    return tuple((v is not None, v) for v in r)


def test_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("length(text) < 12000")
    got = P.periodic_runs(docs, damage=True, texts=False).collect()
    assert sorted(map(tuple, got), key=key) == sorted((contract(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert sum(r.n_runs > 0 for r in got) > 5
    whole = Q.op12_periodic_runs(spark, sf_dir)
    assert whole.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert whole.count() == table(spark, sf_dir, "documents").count()


def test_awkward_rows(spark):
    again = "so it goes on " * 9 + "\u00a0end \t\n" + "ha " * 30
    docs = documents(spark, [("en", 900 + i, again, "s", "k", "w") for i in range(40)] + [("en", 900, again, "s", "k", "w"), ("en", None, again, "s", "k", "w")])
    small = docs.filter("length(text) < 20000 or text is null")
    for damage in (False, True):
        got = P.periodic_runs(small, damage).collect()
        want = [contract(r.doc_id if damage else None, r.text) for r in small.collect()]
        assert sorted((tuple(r)[1:8] for r in got), key=key) == sorted((x[1:] for x in want), key=key)
        assert all(hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 for r in got)
    assert P.periodic_runs(docs).count() == docs.count()
    assert P.periodic_runs(empty(spark)).count() == 0
    one = [r for r in P.periodic_runs(docs).collect() if r.doc_id == 905]
    assert one[0].collapsed == "so it goes on \u00a0end ha"
