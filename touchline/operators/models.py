"""Models on pyspark.ml: calibration and a multinomial outcome model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.prob import outcome


def isotonic(rows: DataFrame, p: str, y: str) -> DataFrame:
    """Add ``calibrated``: 0.7 of the isotonic fit of y on p and 0.3 of p itself."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    ready = VectorAssembler(inputCols=[p], outputCol="_x").transform(rows.withColumn("_y", F.col(y).cast("double")))
    fitted = IsotonicRegression(featuresCol="_x", labelCol="_y", predictionCol="_f").fit(ready)
    return fitted.transform(ready).withColumn("calibrated", 0.7 * F.col("_f") + 0.3 * F.col(p)).drop("_x", "_y", "_f")


def outcome_model(rows: DataFrame, features: list[str]) -> DataFrame:
    """Multinomial logistic regression of H/D/A, fitted on the first 80 % of the days; probabilities of all rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ftr = outcome(F.col("hg"), F.col("ag"))
    ready = rows.withColumn("label", F.when(ftr == "H", 0.0).when(ftr == "D", 1.0).otherwise(2.0))
    day = ready.agg(F.percentile_approx(F.unix_date("match_date"), 0.8)).first()[0]
    steps = [VectorAssembler(inputCols=features, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True), LogisticRegression(featuresCol="_s", labelCol="label", family="multinomial", regParam=0.01, maxIter=30)]
    fitted = Pipeline(stages=steps).fit(ready.filter(F.unix_date("match_date") <= F.lit(day)))
    p = vector_to_array("probability")
    return fitted.transform(ready).select("league", "match_date", "ok", "ln", "pk", "sk", (F.unix_date("match_date") > F.lit(day)).alias("held_out"), p[0].alias("model_h"), p[1].alias("model_d"), p[2].alias("model_a"))
