"""Operator 10: benchmark items inside documents, by a size-partitioned MinHash containment search.

Texts are lower-cased and split into words of letters and digits; their shingles are runs of five words.  An item is
contained in a document if at least 80 % of its distinct shingles are there.

An item of fewer than five words is one shingle, the run of all its words.

Items are partitioned by size (powers of two of their number of shingles).  An item's sketch is its bottom-k MinHash,
the k smallest hashes of its shingles, with one k for each partition: k is one more than the number of shingles that
a contained item of the partition's largest size may miss.  So a document that contains an item holds at least one of
its sketch hashes, and the search loses nothing.  Documents are not sketched: they are looked up by all their shingles,
so a short item is found inside a document of any length.  Candidates are verified on the shingles' own words.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import free_names, materialize
from touchline.llm.quality_rules import with_windows

K, SHARE = 5, 80
#: Up to so many sketch hashes the sketches are broadcast; beyond, both sides are shuffled.
BROADCAST_HASHES = 500_000


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_shingle_texts(df: DataFrame, k: int, name: str) -> DataFrame:
    """Add the distinct runs of k words of ``text``, as texts."""
    words = df.withColumn("_words", normal_words(F.col("text")))
    length = F.greatest(F.size("_words") - (k - 1), F.lit(0))
    sides = F.arrays_zip(*[F.slice("_words", j + 1, length).alias(f"w{j}") for j in range(k)])
    return words.withColumn(name, F.array_distinct(F.transform(sides, lambda x: F.concat_ws(" ", *[x[f"w{j}"] for j in range(k)])))).drop("_words")


def sketches(items: DataFrame, k: int = K, share: int = SHARE) -> DataFrame:
    """item, need (shared shingles that make it contained), hash: the bottom-k MinHash of each item."""
    shingles = with_windows(items, normal_words(F.col("text")), k).select("item", F.explode(F.array_distinct("windows")).alias("hash"))
    sized = shingles.groupBy("item").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.log2("n")).cast("int"))
    by_part = sized.groupBy("part").agg(F.max("n").alias("most")).withColumn("keep", F.col("most") - F.ceil(F.col("most") * share / 100) + 1)
    ranked = shingles.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("hash")))
    kept = ranked.join(sized, "item").join(by_part, "part").filter(F.col("rank") <= F.col("keep"))
    return kept.select("item", F.ceil(F.col("n") * share / 100).alias("need"), "hash")


def _search(texts: DataFrame, items: DataFrame, k: int, share: int) -> DataFrame:
    """doc_id, t1, t2, item, n_item_shingles, n_shared of texts that contain an item; items: item, text."""
    marks = materialize(sketches(items, k, share))
    small = marks.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES  # 24 bytes and a digest each
    looked = with_windows(texts, normal_words(F.col("text")), k).select("doc_id", "t1", "t2", F.explode_outer("windows").alias("hash"))  # explode would test the size first, and compute all twice
    met = looked.join(F.broadcast(marks) if small else marks, "hash").select("doc_id", "t1", "t2", "item").distinct()
    candidates = materialize(met).withColumnRenamed("doc_id", "_id")
    wanted = with_shingle_texts(items, k, "item_shingles").select("item", "item_shingles")
    # the text is fetched for rows with a candidate; ids may be null
    pairs = candidates.join(texts, F.col("_id").eqNullSafe(F.col("doc_id")) & (candidates["t1"] == texts["t1"]) & (candidates["t2"] == texts["t2"])).select("doc_id", texts["t1"], texts["t2"], "text", "item")
    shared = with_shingle_texts(pairs, k, "shingles").join(wanted, "item").select(
        "doc_id", "t1", "t2", "item", F.size("item_shingles").cast("long").alias("n_item_shingles"), F.size(F.array_intersect("shingles", "item_shingles")).cast("long").alias("n_shared")
    )
    return shared.filter(100 * F.col("n_shared") >= share * F.col("n_item_shingles"))


def _contained(docs: DataFrame, benchmark: DataFrame, k: int, share: int, id_col: str, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``_search`` over all items, and the items (item_id, text, item)."""
    # an item is its text: equal texts are searched once, and named by all their ids
    given = benchmark.select(F.col(item_col).alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    items = materialize(given.withColumns({"item": F.sha2("text", 256), "k": F.least(F.lit(k), F.size(normal_words(F.col("text"))))}))
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t1"), F.coalesce(F.crc32(text), F.lit(0)).alias("t2"), text.alias("text"))
    distinct = items.groupBy("item", "k").agg(F.first("text").alias("text"))
    found = None
    # an item of fewer than k words is one shingle of all its words; there are at most k lengths
    for m in sorted(r[0] for r in items.select("k").distinct().collect() if r[0]) or [k]:
        part = _search(texts, distinct.filter(F.col("k") == m).select("item", "text"), m, share)
        found = part if found is None else found.unionByName(part)
    return found, items


def find_items(docs: DataFrame, benchmark: DataFrame, k: int = K, share: int = SHARE, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment: one row for each contained item of each document.

    An item of fewer than k words is one shingle, the run of all its words.  Null texts and texts without words are
    part of no row.  Rows with equal ids count as one id: the best containment is given.  A null id is an id like
    others.  Long texts are searched whole.  Empty tables give no rows; other columns are ignored.
    """
    found, items = _contained(docs, benchmark, k, share, id_col, item_col, text_col)
    best = found.groupBy("doc_id", "item", "n_item_shingles").agg(F.max("n_shared").alias("n_shared"))
    named = best.join(items.select("item", "item_id").distinct(), "item")
    return named.select("doc_id", "item_id", "n_item_shingles", "n_shared", (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"))


def without_items(docs: DataFrame, benchmark: DataFrame, k: int = K, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text contains no item.

    Each row is judged by its own text, so rows that share an id, or have none, go or stay alone; repeated rows share
    their fate.  Null and empty texts stay.  Columns may have any names; an empty table gives an empty one.
    """
    i, t, c, j, u, d = free_names(docs, "id", "text", "sum", "found_id", "found_text", "found_sum")
    found, _ = _contained(docs, benchmark, k, share, id_col, "item_id", text_col)
    keys = materialize(found.select(F.col("doc_id").alias(j), F.col("t1").alias(u), F.col("t2").alias(d)).distinct())
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({i: F.col(id_col), t: F.xxhash64(text), c: F.coalesce(F.crc32(text), F.lit(0))})
    return keyed.join(keys, F.col(i).eqNullSafe(F.col(j)) & (F.col(t) == F.col(u)) & (F.col(c) == F.col(d)), "left_anti").drop(i, t, c)
