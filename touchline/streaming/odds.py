"""Structured Streaming forms of the odds operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_odds(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Count, mean, first and last value of each kind of event by tumbling window; late rows beyond the delay go."""
    per = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    out = per.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min_by("value", "ts").alias("opening"), F.max_by("value", "ts").alias("closing"))
    return out.select(F.col("w.start").alias("starts"), "event_type", "n", F.round("mean", 6).alias("mean"), "opening", "closing")


def first_reports(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first report of each key within the delay (state is dropped behind the watermark)."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def closed_fixtures(fixtures: DataFrame, results: DataFrame, wait: str = "14 days") -> DataFrame:
    """Fixtures with their results, as results arrive; a fixture without one after ``wait`` comes out with nulls.

    Both sides have key and ts; results also value."""
    f = fixtures.withWatermark("ts", "1 hour").alias("f")
    r = results.withWatermark("ts", "1 hour").alias("r")
    near = (F.col("f.key") == F.col("r.key")) & (F.col("r.ts") >= F.col("f.ts")) & (F.col("r.ts") <= F.col("f.ts") + F.expr(f"interval {wait}"))
    return f.join(r, near, "left").select("f.key", F.col("f.ts").alias("ts"), F.col("r.ts").alias("closed_at"), "r.value")


def run_once(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] = ()) -> StreamingQuery:
    """Process what is there and stop; the checkpoint makes the Parquet sink exactly-once over restarts."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
