"""Both versions of a key come from one pass over the table and one shuffle of the columns that are asked for."""

from pyspark.sql import functions as F

from touchline import catalog
from touchline.operators import merge as G

ROWS = [
    (1, 1, "d", "x", 5, "old"), (1, 1, "d", "x", 6, "new"), (2, 1, "d", "y", None, "old"), (2, 1, "d", "x", 9, "new"), (3, 1, "d", "x", None, "new"), (4, 1, "d", "z", 7, "new"),
    (5, 1, None, "x", 3, "new"), (None, 1, "d", "x", 4, "old"), (None, 1, "d", "q", 2, "new"), (6, 1, "d", "y", None, "new"),
]


def _rows(spark):
    return spark.createDataFrame(ROWS, "ok int, ln int, day string, home string, hc int, role string")


def _args():
    return ["ok", "ln"], F.col("role") == "old", F.col("role") == "new", F.col("hc")


def _shuffled(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("lineitem.parquet")


def test_new_rows_enter_where_no_old_row_stands(spark):
    keys, old, new, _ = _args()
    found = G.insert_ignore_versions(_rows(spark), keys, old, new, F.lit(0), ["hc"], ["role", "hc"])
    want = [(1, 1, "old", 5), (2, 1, "old", None), (4, 1, "new", 7), (5, 1, "new", 3), (None, 1, "old", 4), (None, 1, "new", 2)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_values_come_by_id_and_else_by_key(spark):
    keys, old, new, _ = _args()
    found = G.id_or_key(_rows(spark), keys, old, new, F.lit(0), ["day", "home"], "hc")
    want = [(1, 1, 5, "id"), (2, 1, 5, "id"), (3, 1, 5, "key"), (4, 1, None, "none"), (5, 1, None, "none"), (None, 1, None, "none"), (6, 1, None, "key")]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_the_table_is_read_and_shuffled_once(spark, sf_dir):
    assert _shuffled(catalog.queries()["k03_insert_ignore"](spark, sf_dir)) == (1, 1)
    # the picked versions are a table of their own; what is left is the join of those without a value
    assert _shuffled(catalog.queries()["j13_id_or_key"](spark, sf_dir))[1] == 0
