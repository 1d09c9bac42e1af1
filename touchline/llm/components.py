"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import Materialized


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for each node of an edge a-b of long ids.

    Every step is a partial aggregation and an equi-join, written to the shared folder; steps end when the edges are
    stars around the least nodes.
    """
    held = Materialized(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        now = held.read()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # least partners are written before they are joined to the pairs: Spark splits a hot node only right above an exchange
        low = Materialized(_least(both).withColumn("m", F.least("u", "m")))
        large = Materialized(both.filter("v > u").join(low.read(), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low.drop()
        low = Materialized(_least(large.read()))
        small = large.read().join(low.read(), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        following = Materialized(small.select("e.*").filter("u <> v").distinct())
        held.drop()
        large.drop()
        low.drop()
        held, now = following, following.read()
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
