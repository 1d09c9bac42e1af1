"""Each stage of the pipeline against brute force on its own input."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import documents, empty, prose
from tests.llm.test_ngram_join import brute
from tests.llm.test_text_operators import contained, removed
from touchline.llm.common import materialize, table
from touchline.llm.decontamination import find_items, without_items

SF = "/root/testdata/sf0.01"


def key(r):
    return tuple((v is not None, v) for v in r)


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "packing"]
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF))
        before, after = docs.collect(), out.collect()
        if name == "packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            assert sum(r.length for r in after) == sum({r.doc_id: r.doc_tokens for r in after}.values())
            continue
        assert out.columns == columns
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
            kept = {r.doc_id for r in after}
            hits = Counter((labels[r.doc_id], r.doc_id in kept) for r in before if r.doc_id in labels)
            assert hits[1, True] >= 0.95 * (hits[1, True] + hits[1, False]) and hits[0, False] >= 0.8 * (hits[0, True] + hits[0, False])
        elif name == "n-gram Jaccard join":
            want = {d for d, _, c in brute([(r.doc_id, r.text) for r in before], 80, 5) if c == d}
            assert {r.doc_id for r in after} == want and len(after) == len(want)
        elif name == "substring dedup":
            by = {r.doc_id: r for r in after}
            for r, (n, gone, _) in zip(before, removed([r.text for r in before]), strict=True):
                assert (r.doc_id in by) == (gone < n or n == 0)
                if r.doc_id in by:
                    assert len(re.findall(r"[^\x20\x09-\x0D]+", by[r.doc_id].text)) == n - gone
                    assert by[r.doc_id].text == r.text or gone
        elif name == "benchmark decontamination":
            hit = {d for d, _ in contained([(r.doc_id, r.text) for r in before], [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])}
            assert sorted(map(tuple, after), key=key) == sorted((tuple(r) for r in before if r.doc_id not in hit), key=key)
        docs = out


def test_stages_take_awkward_rows(spark):
    for docs in (documents(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = materialize(stage(spark, docs, SF))
            assert name == "packing" or (out.columns == docs.columns and out.count() <= docs.count())
    repeated = documents(spark, [("en", 0, prose(1, 120), "s", "k", "w")] * 3)
    kept = defaultdict(int)
    for r in corpus_pipeline.near_duplicates(spark, repeated, SF).collect():
        kept[r.doc_id, r.text] += 1
    assert kept[0, prose(1, 120)] == 1 and (1, prose(1, 120)) not in kept


def test_stages_take_clashing_names(spark):
    """Columns named like anything that a stage might add come through unchanged."""
    names = ["_id", "_t", "_t1", "_t2", "_i", "_text", "_sum", "_found", "_found_id", "_kept_id", "_kept_text", "_marks", "marks", "_starts", "_masks", "cls", "item", "k", "hash", "t1"]
    docs = documents(spark)
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert all(r[n] == n + ("?" if r.doc_id is None else str(r.doc_id)) for r in out.collect() for n in names), name


def test_leaks_go_row_by_row(spark):
    """A contaminated row takes no other row of its id with it, whether the id is known or null; short items count."""
    item = prose(50, 20)
    rows = [(None, "before " + item), (None, "clean text of no item at all"), (5, item + " after"), (5, "another clean text of words"), (6, "here are only four words in it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "Only four words, in")], "item_id long, text string")
    assert {r.text for r in without_items(docs, bench).collect()} == {rows[1][1], rows[3][1]}
    assert {(r.doc_id, r.item_id) for r in find_items(docs, bench).collect()} == {(None, 1), (5, 1), (6, 2)}


def test_quality_stage_takes_awkward_rows_and_names(spark):
    """Nulls, empties, repeated rows, an empty table and columns of any name: rows are kept whole or dropped whole."""
    names = ["_score", "score_", "_id", "_label", "_text", "batch", "quality", "_0"]
    docs = documents(spark, [("en", 0, prose(1, 120), "s", "k", "w")] * 3)
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    out = corpus_pipeline.quality(spark, docs, SF)
    assert out.columns == docs.columns
    before = Counter(map(str, docs.collect()))
    after = Counter(map(str, out.collect()))
    assert all(before[r] == n for r, n in after.items()) and 0 < sum(after.values()) <= sum(before.values())
    assert corpus_pipeline.quality(spark, docs.limit(0), SF).count() == 0


def test_packing_takes_clashing_names(spark):
    docs = documents(spark)
    want = sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in corpus_pipeline.packing(spark, docs, SF).collect()), key=key)
    for n in ("start", "length", "ids", "sequence_id", "offset", "total", "part", "_text"):
        docs = docs.withColumn(n, F.lit(n))
    got = sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in corpus_pipeline.packing(spark, docs, SF).collect()), key=key)
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((r[0], r[2], r[3]) for r in want)
