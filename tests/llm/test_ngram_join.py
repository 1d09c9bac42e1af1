"""The Jaccard join against brute force over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, empty, prose
from touchline.llm.common import table
from touchline.llm.components import connected_components
from touchline.llm.ngram_join import NgramJoin, head_length, jaccard_components, least_shared


def shingle_set(text, k=4):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, share=85, k=4):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for t in s:
            where.setdefault(t, []).append(i)
    for i, s in enumerate(sets):
        count = {}
        for t in s:
            for j in where[t]:
                if j < i:
                    count[j] = count.get(j, 0) + 1
        for j, c in count.items():
            if 100 * c >= share * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=lambda x: tuple((v is not None, v) for v in x))


def check(docs, share=85, k=4):
    got = sorted((tuple(r) for r in jaccard_components(docs, k, share).collect()), key=lambda x: tuple((v is not None, v) for v in x))
    assert got == brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], share, k)


def test_fixture(spark):
    check(documents(spark))
    assert jaccard_components(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies(spark, seed):
    """Groups of copies with some words changed, dropped or appended, and passages in common."""
    r, out = random.Random(seed), []
    for g in range(6):
        base = prose(100 * seed + g, r.choice([8, 40, 150, 300])).split()
        for _ in range(r.choice([2, 5, 60])):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = f"edit{r.randrange(9)}"
            if r.random() < 0.3:
                w += prose(r.randrange(10**6), r.randrange(1, 1 + len(w) // 8 + 1)).split()
            if r.random() < 0.2:
                w = w[: -r.randrange(1, 1 + len(w) // 9 + 1)]
            out.append(("en", len(out) + 1000, " ".join(w), "s", "k", "w"))
    passage = prose(999, 50)
    out += [("en", 5000 + i, prose(7000 + i, r.randrange(5, 200)) + " " + passage, "s", "k", "w") for i in range(40)]
    check(documents(spark, out).filter(F.coalesce(F.length("text"), F.lit(0)) < 20000))


def test_table(spark):
    check(table(spark, "/root/testdata/sf0.01", "documents"))
    check(table(spark, "/root/testdata/sf0.01", "documents"), 80, 5)


def test_repeated_rows(spark):
    """Sixty copies each of two near texts, under one id for each text, meet as two classes."""
    words = prose(77, 150).split()
    pair = [" ".join(words), " ".join([*words[:70], "other", *words[71:]])]
    docs = documents(spark, [("en", 900 + i, t, "s", "k", "w") for i, t in enumerate(pair) for _ in range(60)])
    check(docs)
    join = NgramJoin(docs)
    assert join.sets.read().count() == join.sets.read().select("cls").distinct().count()


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {(r.node, r.root) for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (103, 100)}


@pytest.mark.parametrize(("share", "k"), [(85, 4), (80, 5)])
def test_every_small_pair_of_sizes(spark, share, k):
    """All sizes up to 45 with the least overlap that links them, and with one less; each pair has words of its own."""
    out, want = [], {}
    for n in range(1, 46):
        for m in range(-(-share * n // 100), n + 1):
            least = -(-share * (n + m) // (100 + share))
            for o in {least, least - 1, m} - {0, m + 1}:
                tag, same = len(out), o + k - 1
                x = [f"w{tag}x{i}" for i in range(n + k - 1)]
                y = [*x[:same], *[f"v{tag}x{i}" for i in range(m - o)]]
                out += [("en", 10_000 + tag, " ".join(x), "s", "k", "w"), ("en", 10_001 + tag, " ".join(y), "s", "k", "w")]
                want[10_000 + tag], want[10_001 + tag] = 10_000 + tag, 10_000 + tag + (100 * o < share * (n + m - o))
    docs = documents(spark, out).filter("doc_id >= 10000")
    assert {r.doc_id: r.component_id for r in jaccard_components(docs, k, share).collect()} == want


@pytest.mark.parametrize("share", [80, 85])
def test_least_shared_by_placing_tokens(share):
    """The bound against the worst arrangement: own tokens of both sides stand first."""
    for n in range(1, 120):
        worst = n
        for m in range(-(-share * n // 100), 100 * n // share + 1):
            o = -(-share * (n + m) // (100 + share))
            a, b = [("a", i) for i in range(n - o)], [("b", i) for i in range(m - o)]
            common = [("c", i) for i in range(o)]
            heads = {*(a + common)[: head_length(n, share)]} & {*(b + common)[: head_length(m, share)]}
            worst = min(worst, len(heads))
        assert least_shared(n, share) <= worst


def test_ten_and_nine_words(spark):
    """Seven and six shingles, 6/7 >= 0.85; five and four, 4/5 >= 0.8."""
    ten, nine = prose(55, 10).split(), prose(56, 9).split()
    docs = documents(spark, [("en", 800, " ".join(ten), "s", "k", "w"), ("en", 801, " ".join(ten[:9]), "s", "k", "w"), ("en", 810, " ".join(nine), "s", "k", "w"), ("en", 811, " ".join(nine[:8]), "s", "k", "w")])
    of = lambda share, k: {r.doc_id: r.component_id for r in jaccard_components(docs, k, share).filter("doc_id >= 800").collect()}
    assert of(85, 4)[801] == 800 and of(80, 5)[811] == 810
    check(docs)
    check(docs, 80, 5)
