"""The grids of the walk-forward folds in plain columns: the same numbers as the forms on lists, ties and odd values included."""

from pyspark.sql import functions as F

from touchline.operators import validation as V

ROWS = [(1.0, 2.0, 3.0, 0), (0.5, 0.5, 0.5, 1), (-3.0, 700.0, 699.0, 2), (2.0, 2.0, -1.0, 1), (float("nan"), 0.1, 0.2, 0)]


def test_plain_columns_equal_lists(spark):
    df = spark.createDataFrame(ROWS, "a double, b double, c double, y int")
    z, t = [F.col(c) for c in "abc"], F.lit(0.7)
    plain = V._softmax_columns(z, t)
    held = df.withColumns({"l": V.probabilities(F.array(*z), t), "p0": plain[0], "p1": plain[1], "p2": plain[2]})
    p = [F.col(f"p{k}") for k in range(3)]
    for r in held.select("l", "p0", "p1", "p2", V._pick(F.array(*z)).alias("want"), V._first_of_best(z).alias("got"), F.element_at("l", F.col("y") + 1).alias("own"), V._own(p, F.col("y")).alias("mine")).collect():
        assert repr(r.l) == repr([r.p0, r.p1, r.p2]) and r.want == r.got and repr(r.own) == repr(r.mine)
