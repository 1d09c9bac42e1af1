"""Substring dedup, decontamination and the two learnt scorers."""

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, empty, prose
from touchline.llm import quality_cnn, toxicity
from touchline.llm import queries as Q
from touchline.llm.common import table
from touchline.llm.decontamination import find_items
from touchline.llm.substring_dedup import FingerprintIndex, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(texts, window=35):
    seen = Counter()
    split = [WORD.findall(t or "") for t in texts]
    for w in split:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check_removed(docs, **how):
    given = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *x) for r, x in zip(given, removed([r.text for r in given], how.get("window", 35)), strict=True))
    got = remove_repeats(docs, **how).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_substring_dedup(spark, sf_dir):
    period = [("en", 500, "a b " * 60, "s", "k", "w"), ("en", 501, "z " + "a b " * 40, "s", "k", "w"), ("en", 502, prose(3, 60) + " end", "s", "k", "w"), ("en", 503, "x " * 34, "s", "k", "w"), ("en", 504, "y " * 36, "s", "k", "w")]
    check_removed(documents(spark, period))
    check_removed(documents(spark, period), window=12, gram=4, batches=3)
    check_removed(table(spark, sf_dir, "documents"))
    assert remove_repeats(empty(spark)).count() == 0


def test_index_sees_history(spark):
    index, seen, total = FingerprintIndex(spark), Counter(), set()
    for k in range(5):
        batch = [(i * (k + 1)) % 23 for i in range(8)]
        found = {r.fp for r in index.add(spark.createDataFrame([(x,) for x in batch], "fp long")).collect()}
        seen.update(batch)
        assert found == {x for x in batch if seen[x] > 1}
        total |= found
    assert total == {x for x, n in seen.items() if n > 1} and len(index.runs) < 4
    index.close()


def contained(docs, items, k=5, share=80):
    def grams(text):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    own = [(i, grams(t)) for i, t in items]
    out = {}
    for d, t in docs:
        g = grams(t)
        for i, x in own:
            if x and 100 * len(x & g) >= share * len(x):
                out[d, i] = max(out.get((d, i), (0, 0)), (len(x), len(x & g)))
    return out


def test_decontamination(spark, sf_dir):
    item = prose(50, 20)
    words = item.split()
    rows = [("en", 600, prose(51, 400) + " " + item.upper() + "! " + prose(52, 300), "s", "k", "w"), ("en", 601, prose(53, 30) + " " + " ".join(words[:19]), "s", "k", "w"),
            ("en", 602, " ".join(words[:10]) + " other " + " ".join(words[11:]), "s", "k", "w"), ("en", None, item, "s", "k", "w"), ("en", 600, item, "s", "k", "w")]
    bench = spark.createDataFrame([(1, item, "x"), (2, item, "x"), (3, None, "x"), (4, "too short here", "x"), (5, prose(4, 90), "x"), (None, prose(2, 60), "x")], "item_id long, text string, doc_id string")
    for docs, items in ((documents(spark, rows), bench), (table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))):
        want = contained([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
        got = find_items(docs, items).collect()
        assert {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in got} == want and len(got) == len(want) > 0
    assert find_items(empty(spark), bench).count() == 0 and find_items(documents(spark), bench.limit(0)).count() == 0


def auc(score, mark):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = mark.sum()
    return (rank[mark == 1].sum() - n * (n + 1) / 2) / (n * (len(mark) - n))


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    scored = Q.op1_quality_classifier(spark, sf)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and scored.count() == table(spark, sf, "documents").count()
    held = scored.filter("held_out").join(table(spark, sf, "labels"), "doc_id").toPandas()
    assert auc(held.score.values, held.quality.values) > 0.9
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    for docs in (documents(spark), empty(spark)):
        for marks in (labels, labels.limit(0)):
            got = quality_cnn.score_quality(docs, quality_cnn.train_quality(docs, marks))
            assert got.count() == docs.count() and not got.filter("score is null or isnan(score) or score < 0 or score > 1").count()


def test_network_sees_the_whole_text():
    net = quality_cnn.Network()
    a, b = b"abc " * 500, b"abc " * 499 + b"##!!"
    one = [net.score(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in (a, b)]
    assert one[0] != one[1]
    both = net.score(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b)]))
    assert np.allclose(both, one, atol=1e-5)
    r, eps = np.random.default_rng(0), 1e-3
    data, offsets, y = r.integers(97, 110, 300, dtype=np.uint8), np.array([0, 120, 120, 300]), np.array([1.0, 0, 1])
    g = net.gradients(data, offsets, y)

    def loss():
        p = net.score(data, offsets)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, at in (("conv", (1, 5, 3)), ("embed", (100, 2)), ("out", (4,)), ("bias", (7,)), ("last", (0,))):
        old = net.w[k][at]
        net.w[k][at] = old + eps
        up = loss()
        net.w[k][at] = old - eps
        down = loss()
        net.w[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3


def plain_score(net, text):
    """The network byte by byte: every chunk of 48 bytes, every filter, the largest of each."""
    n = max(-(-len(text) // 16), 1) + 2
    data = text + bytes(16 * n - len(text))
    same = lambda i, lag: i > lag and data[i] == data[i - lag] and data[i - 1] == data[i - 1 - lag] and min(data[i], data[i - 1]) > 32
    again = [float(any(same(i, lag) for lag in range(3, 13))) for i in range(len(data))]
    best = np.full(32, -np.inf)
    for place in range(n - 2):
        total = np.zeros(32)
        for j in range(3):
            cells = [[*net.w["embed"][data[i]], again[i]] for i in range(16 * (place + j), 16 * (place + j + 1))]
            total += np.array(cells).ravel() @ net.w["conv"][j]
        best = np.maximum(best, total)
    return 1 / (1 + np.exp(-(np.tanh(best + net.w["bias"]) @ net.w["out"] + net.w["last"][0])))


def test_network_against_a_plain_scorer():
    net = quality_cnn.Network(3)
    for text in (b"", b"a", b"the the the road", prose(5, 40).encode(), ("é ü " * 30).encode()):
        data = np.frombuffer(text, np.uint8)
        assert np.allclose(net.score(data, np.array([0, len(text)])), plain_score(net, text), atol=1e-5)
        assert np.allclose(net.score(data, np.array([0, len(text)]), step=32), plain_score(net, text), atol=1e-5)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.train_toxicity(docs, labels)
    assert model.cuts == sorted(model.cuts)
    scored = toxicity.score_toxicity(docs, model).join(labels, "doc_id").withColumn("held_out", quality_cnn.in_fold(F.col("doc_id")))
    held = scored.filter("held_out").toPandas()
    assert auc(held.expected_severity.values, held.toxic.values) > 0.8
    assert ((scored.toPandas().expected_severity >= 0) & (scored.toPandas().expected_severity <= 3)).all()
    marks = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    for d in (documents(spark), empty(spark)):
        for m in (marks, marks.limit(0)):
            assert toxicity.score_toxicity(d, toxicity.train_toxicity(d, m)).count() == d.count()


def test_grades_follow_markers():
    counts = [Counter({"vile": n}) for n in (1, 2, 3, 4, 5, 6)] + [Counter({"fine": 1})] * 20
    marks = np.array([1] * 6 + [0] * 20)
    g = toxicity.grades(counts, marks)
    assert g[6:].max() == 0 and (np.diff(g[:6]) >= 0).all() and g[0] == 1 and g[5] == 3


def test_toxicity_scores_by_hand(spark):
    """Every row's expected grade and probability from the model's numbers by a plain sum over words and word beginnings."""
    import math

    sf = "/root/testdata/sf0.01"
    model = toxicity.train_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert model.weights and model.cuts == sorted(model.cuts)
    for docs in (documents(spark), table(spark, sf, "documents").filter("doc_id % 4 = 1")):
        want = Counter()
        for r in docs.collect():
            words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
            counts = Counter(words) + Counter("^" + w[:4] for w in words if len(w) > 4)
            z = sum(model.weights.get(w, 0.0) * math.log1p(n) for w, n in counts.items())
            above = [1 / (1 + math.exp(min(30, max(-30, c - z)))) for c in model.cuts]
            want[r.doc_id, round(sum(above), 8), round(above[0], 8), int(above[0] >= 0.3)] += 1
        got = toxicity.score_toxicity(docs, model).collect()
        assert Counter((r.doc_id, round(r.expected_severity, 8), round(r.score, 8), r.predicted) for r in got) == want
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
