"""Operator 3: n-gram Jaccard join by filters under several global token orders.

A document is the set of its word shingles; equal sets are one class.  If two sets of Jaccard similarity t or more are
sorted by any one global order, their prefixes (n - ceil(t n) + 1 tokens) share a token.  Candidates must do so under
three orders, and all three are applied before sets are compared:

1. A hash order, over all classes.  Of the first FACTOR * (n - ceil(t n)) + 1 tokens of a class, other classes must
   have as many in the same place as the worst partner that its size allows would have (``least_shared``); two
   aggregations count them.  The classes that pass are few, and only their whole sets are built.
2. Rare tokens first: by the number of passing classes that have a token, counted over whole sets.  Passages that many
   documents share stand last, so that they make no candidates.  This order makes the pairs, with the size and
   position bounds of prefix filtering.
3. Another hash order.  A pair must share a prefix token under it and under the first one.

Connectivity does not need all pairs.  First each class meets the *leader* of each of its prefix tokens, the class
with the least position there; verified links are contracted to components.  Then only classes of different components
are paired.  For this a token is split further by the sizes of both partners: a class enters the bucket of a partner
size only where its position still allows the overlap that this size needs.  A bucket with one component is dropped,
so the members of a large group of near copies do not meet one another.

Very long texts are one set like others; memory in a task follows the largest single text, not the batch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import Materialized, Words, claim_worker, free_names, materialize, mix, ragged, release, shingles, text_chunks
from touchline.llm.components import connected_components

K, SHARE = 4, 85
#: Tokens that the first order looks at, in multiples of n - ceil(t n).
FACTOR = 2
_ORDER3 = np.uint64(0xD6E8FEB86659FD93)
#: Ratio of neighbouring size classes.
RATIO = 1.03


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, end row, sorted distinct shingle hashes of each text)."""
    for a, b, data, offsets in text_chunks(column):
        words = Words(data, offsets, lower=True)
        h = words.hashes()
        hashes, ranges = shingles(h, words.first, k)
        out = []
        for d in range(b - a):
            x, y = words.first[d], words.first[d + 1]
            if y - x >= k:
                out.append(np.unique(hashes[ranges[d] : ranges[d + 1]]))
            elif y > x:  # all words as one shingle; its length keeps it apart from others
                out.append(shingles(h[x:y], np.array([0, y - x]), int(y - x))[0] ^ np.uint64(y - x))
            else:
                out.append(np.zeros(0, np.uint64))
        yield a, b, out


def slack(n: int | np.ndarray, share: int) -> int | np.ndarray:
    """Tokens that a set of n tokens may lack in a similar one; its prefixes are one longer."""
    return n - -(-share * n // 100)


def head_length(n: int | np.ndarray, share: int) -> int | np.ndarray:
    """Tokens of a class that the first order looks at."""
    return FACTOR * slack(n, share) + 1


@lru_cache(maxsize=1 << 16)
def least_shared(n: int, share: int) -> int:
    """Head tokens that a class of n tokens has in common with the head of any similar class, at the least.

    Of the common tokens, in order, number c stands at place c + (n - overlap) of the one set and c + (m - overlap) of
    the other at the latest.  So both heads hold the first head_length(x) - (x - overlap) of them, whichever side is
    shorter; the partner with the smallest value counts, and for each m the least overlap that is still similar.
    """
    m = np.arange(-(-share * n // 100), 100 * n // share + 1)
    overlap = -(-share * (n + m) // (100 + share))
    own, other = head_length(n, share) - (n - overlap), head_length(m, share) - (m - overlap)
    return int(np.minimum(np.minimum(own, other), overlap).min())


def _lists(sets: list[np.ndarray]) -> pa.Array:
    return ragged(np.concatenate(sets).view(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int64())


def _name(tokens: np.ndarray) -> int | None:
    """64 bits that stand for a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) if len(tokens) else None


def _named(docs: DataFrame, k: int, share: int) -> DataFrame:
    """doc_id, t1, n, most_alone (head tokens that may be a class's own; see ``least_shared``), cls (null for empty sets) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("ngrams")
        for batch in batches:
            for a, b, sets in _sets(batch.column(2), k):
                n = pa.array(np.array([len(u) for u in sets], np.int64))
                alone = pa.array([head_length(len(u), share) - least_shared(len(u), share) if len(u) else 0 for u in sets], pa.int64())
                ids = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([*ids, n, alone, pa.array([_name(u) for u in sets], pa.int64())], ["doc_id", "t1", "n", "most_alone", "cls"])

    return docs.select("doc_id", "t1", "text").mapInArrow(run, "doc_id long, t1 long, n long, most_alone long, cls long")


def _heads(docs: DataFrame, k: int, share: int) -> DataFrame:
    """cls, head (the first tokens under the first order) of each row; texts are read again, so no token is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("ngrams")
        for batch in batches:
            for _, _, sets in _sets(batch.column(0), k):
                heads = _lists([u[: head_length(len(u), share)] for u in sets])
                yield pa.RecordBatch.from_arrays([pa.array([_name(u) for u in sets], pa.int64()), heads], ["cls", "head"])

    return docs.select("text").mapInArrow(run, "cls long, head array<long>")


def _whole_sets(texts: DataFrame, k: int, share: int) -> DataFrame:
    """cls, n, tokens (in the first order), third (prefix under the third order) of chosen texts (cls, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("ngrams")
        for batch in batches:
            for a, b, sets in _sets(batch.column(1), k):
                third = [u[np.argsort(mix(u ^ _ORDER3))][: slack(len(u), share) + 1] for u in sets]
                n = pa.array(np.array([len(u) for u in sets], np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, _lists(sets), _lists(third)], ["cls", "n", "tokens", "third"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, n long, tokens array<long>, third array<long>")


def _slack(n: Column, share: int) -> Column:
    return n - F.ceil(share * n / 100)


def _needed(n: Column, m: Column, share: int) -> Column:
    """Overlap that sets of these sizes need."""
    return F.ceil(share * (n + m) / (100 + share))


def _possible(n: Column, i: Column, m: Column, j: Column, share: int) -> Column:
    """Size bound, and position bound at the first common token of an order."""
    return (100 * F.least(n, m) >= share * F.greatest(n, m)) & (F.least(n - i, m - j) >= _needed(n, m, share))


class NgramJoin:
    """The steps of the join over one table; see the module's text."""

    def __init__(self, docs: DataFrame, k: int = K, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.k, self.share, self.spark = k, share, docs.sparkSession
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), text.alias("text"))
        self.rows = Materialized(_named(self.docs, k, share))
        self.sets = self._sets_of(self._passing_classes(self.rows.read()))

    def _passing_classes(self, rows: DataFrame) -> DataFrame:
        """cls and one row (doc_id, t1) of each class that the first order lets through."""
        tokens = _heads(self.docs, self.k, self.share).select("cls", F.explode("head").alias("tok"))
        held = tokens.groupBy("tok").agg(F.min("cls").alias("cls"), F.max("cls").alias("most"))
        alone = held.filter("cls = most").groupBy("cls").agg(F.count("*").alias("alone"))
        classes = rows.filter("cls is not null").groupBy("cls").agg(F.first("most_alone").alias("most_alone"), F.min(F.struct("doc_id", "t1")).alias("one"))
        passing = classes.join(alone, "cls", "left").filter(F.coalesce("alone", F.lit(0)) <= F.col("most_alone"))
        found = materialize(passing.select("cls", F.col("one.doc_id").alias("id"), F.col("one.t1").alias("t")))
        release(self.spark)
        return found

    def _sets_of(self, chosen: DataFrame) -> Materialized:
        """The whole sets of chosen classes, each once."""
        # a merge join at any size, so that small and large tables take the same way
        texts = self.docs.join(chosen.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t1") == F.col("t"))).groupBy("cls").agg(F.first("text").alias("text"))
        found = Materialized(_whole_sets(texts, self.k, self.share))
        release(self.spark)
        return found

    def tokens(self) -> Materialized:
        """tok, cls, n, i: prefix tokens under the second order that more than one class has, with their places."""
        every = self.sets.read().select("cls", "n", F.explode("tokens").alias("tok"))
        # written first, so that Spark can split a hot token of the other side
        common = Materialized(every.groupBy("tok").agg(F.count("*").alias("c")).filter("c > 1"))
        by_class = Window.partitionBy("cls")
        placed = every.join(common.read(), "tok").withColumns({"rank": F.row_number().over(by_class.orderBy("c", "tok")), "all": F.count("*").over(by_class)})
        # tokens of one class alone stand before the others
        placed = placed.withColumn("i", F.col("n") - F.col("all") + F.col("rank") - 1).filter(F.col("i") <= _slack(F.col("n"), self.share))
        found = Materialized(placed.select("tok", "cls", "n", "i"))
        common.drop()
        release(self.spark)
        return found

    def leader_pairs(self, tokens: DataFrame) -> DataFrame:
        leads = materialize(tokens.groupBy("tok").agg(F.min(F.struct("i", "n", "cls")).alias("lead"), F.count("*").alias("c")).filter("c > 1").select("tok", "lead"))
        met = tokens.join(leads, "tok").filter(F.col("cls") != F.col("lead.cls")).filter(_possible(F.col("n"), F.col("i"), F.col("lead.n"), F.col("lead.i"), self.share))
        return met.select(F.least("cls", "lead.cls").alias("a"), F.greatest("cls", "lead.cls").alias("b")).distinct()

    def other_pairs(self, tokens: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs of classes of different components that the second order lets through."""
        step = math.log(RATIO)
        size_class = lambda n: F.floor(F.log(n.cast("double")) / step + 1e-9).cast("int")
        placed = tokens.join(roots, F.col("cls") == F.col("node"), "left").select("tok", "cls", "n", "i", F.coalesce("root", "cls").alias("root"))
        several = placed.groupBy("tok").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("tok")
        placed = placed.join(materialize(several), "tok")  # written first, so that Spark can split a hot token
        low, high = F.ceil(F.col("n") * self.share / 100), F.floor(F.col("n") * 100 / self.share)
        sized = placed.withColumn("own", size_class(F.col("n"))).withColumn("other", F.explode(F.sequence(size_class(low), size_class(high))))
        least_partner = F.greatest(low, F.floor(F.pow(F.lit(RATIO), F.col("other"))))
        sized = sized.filter((F.col("n") - F.col("i")) >= _needed(F.col("n"), least_partner, self.share))
        sized = sized.select("tok", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "cls", "n", "i", "root")
        key = ["tok", "p", "q"]
        mixed = sized.groupBy(*key).agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select(*key)
        sized = materialize(sized.join(materialize(mixed), key))
        left, right = sized.alias("l"), sized.alias("r")
        cond = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in key]
        cond += [F.col("l.cls") < F.col("r.cls"), F.col("l.root") != F.col("r.root"), _possible(F.col("l.n"), F.col("l.i"), F.col("r.n"), F.col("r.i"), self.share)]
        return left.join(right, cond).select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b")).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b; each once) that also pass the first and third order and whose sets are similar enough."""
        sets = self.sets.read()
        side = lambda x: sets.select(F.col("cls").alias(x), F.slice("tokens", F.lit(1), (_slack(F.col("n"), self.share) + 1).cast("int")).alias(f"{x}1"), F.col("third").alias(f"{x}3"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.arrays_overlap("a1", "b1") & F.arrays_overlap("a3", "b3"))
        passing = materialize(met.select("a", "b"))
        whole = lambda x: sets.select(F.col("cls").alias(x), F.col("tokens").alias(f"{x}t"))
        both = passing.join(whole("a"), "a").join(whole("b"), "b")
        common = F.size(F.array_intersect("at", "bt"))
        found = materialize(both.filter(100 * common >= self.share * (F.size("at") + F.size("bt") - common)).select("a", "b"))
        release(self.spark)
        return found

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links between classes that connect all components, and the components' roots."""
        tokens = self.tokens()
        first = materialize(self.leader_pairs(tokens.read()))
        links = self.verified(first)
        roots = connected_components(links)
        rest = materialize(self.other_pairs(tokens.read(), roots).join(first, ["a", "b"], "left_anti"))
        tokens.drop()
        if rest.limit(1).count():
            more = self.verified(rest)
            if more.limit(1).count():
                links = links.unionByName(more)
                roots = connected_components(links)
        self.sets.drop()
        release(self.spark)
        return links, roots

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        _, roots = self.links()
        rows = self.rows.read()
        named = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least")).join(roots, F.col("cls") == F.col("node"), "left")
        named = named.select("cls", "least", F.coalesce("root", "cls").alias("root"))
        # written before each join: Spark splits a hot component or class only right above an exchange
        firsts = materialize(named.groupBy("root").agg(F.min("least").alias("component")))
        found = materialize(named.join(firsts, "root").select("cls", "component"))
        shape = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
        linked = rows.filter("cls is not null").join(found, "cls").withColumn("component_id", F.col("component")).select(*shape)
        return linked.unionByName(rows.filter("cls is null").withColumn("component_id", F.col("doc_id")).select(*shape))

    def keepers(self) -> DataFrame:
        """doc_id, t1 of one row of each component: the least id (null ids last), then the least text hash."""
        _, roots = self.links()
        rows = self.rows.read()
        placed = rows.filter("cls is not null").join(roots, F.col("cls") == F.col("node"), "left").select("doc_id", "t1", F.coalesce("root", "cls").alias("root"))
        one = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "t1")).alias("one")).select("one.doc_id", "one.t1")
        return one.unionByName(rows.filter("cls is null").select("doc_id", "t1").distinct())


def keep_one_of_each(docs: DataFrame, k: int = K, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that stay if one row of each component does.

    Rows without shingles (null, empty or blank texts) are no copies of anything and stay; of rows that repeat both id
    and text one stays.  Of a component the least id stays, null ids last.  Columns may have any names and are passed
    through; an empty table gives an empty one.
    """
    i, t, j, s = free_names(docs, "id", "text", "kept_id", "kept_text")
    kept = NgramJoin(docs, k, share, id_col, text_col).keepers().select(F.col("doc_id").alias(j), F.col("t1").alias(s))
    keyed = docs.withColumns({t: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), i: F.col(id_col).cast("long")})
    met = keyed.join(kept, F.col(i).eqNullSafe(F.col(j)) & (F.col(t) == F.col(s)), "left_semi")
    return met.dropDuplicates([i, t]).drop(i, t)


def jaccard_components(docs: DataFrame, k: int = K, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: components of documents linked by shingle Jaccard >= share/100.

    A-Z are lower-cased; words are runs of ink.  A text of fewer than k words is one shingle; null and blank texts have
    none and are linked with nothing.  component_id is the least id of the component, null ids aside; repeated rows are
    linked like copies.  An empty table gives no rows; other columns are ignored.  Shingles are compared by 64-bit hashes.
    """
    return NgramJoin(docs, k, share, id_col, text_col).components()
