"""Keyed state of streams: restarts in the middle, late rows, expiry, and the same ends as the batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from touchline.streaming import states as S

DAY = dt.datetime(2024, 1, 1)
QUOTES = "match_key string, ts timestamp, odd double"
TICKETS = "id string, kind string, ts timestamp, result string"


def put(spark, folder, k, rows, schema):
    """One file of the stream, for one micro-batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, schema, made, mode):
    """Process what is there, from the checkpoint on, one file for each batch; the rows of this run."""
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = made(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
    query.awaitTermination()
    return out


def quotes(r, days, n=25):
    return [(f"m{r.randrange(6)}", DAY + dt.timedelta(days=r.choice(days), hours=r.randrange(24)), round(1 + r.random() * 4, 2)) for _ in range(n)]


def test_prices_over_a_restart(spark, tmp_path):
    r, folder = random.Random(1), str(tmp_path)
    made = lambda q: S.price_states(q, "3 days", 30)
    first, second = quotes(r, [0, 1, 2]), quotes(r, [1, 2, 3])
    put(spark, folder, 0, first + [(None, DAY, 2.0), ("m0", None, 2.0)], QUOTES)
    out = run(spark, folder, QUOTES, made, "update")
    put(spark, folder, 1, second, QUOTES)
    out += run(spark, folder, QUOTES, made, "update")
    last = {x.match_key: tuple(x)[:6] for x in out}
    want = {x.match_key: tuple(x) for x in S.prices_of(spark.createDataFrame(first + second, QUOTES)).collect()}
    assert last == want and not any(x.closed for x in out)
    # time goes on: a late quote is left out, then every match is closed with what was known of it
    put(spark, folder, 2, [("new", DAY + dt.timedelta(days=60), 9.0)], QUOTES)
    out = run(spark, folder, QUOTES, made, "update")
    put(spark, folder, 3, [("m0", DAY, 99.0), ("new", DAY + dt.timedelta(days=61), 8.0)], QUOTES)
    out += run(spark, folder, QUOTES, made, "update")
    closed = {x.match_key: tuple(x)[:6] for x in out if x.closed}
    assert closed == want and [x.n for x in out if x.match_key == "new"] == [1, 2]
    assert len([x for x in out if x.closed]) == len(closed)


def tickets(r, n):
    rows = []
    for k in range(n):
        at = DAY + dt.timedelta(days=r.randrange(5), hours=r.randrange(24))
        rows += [(f"t{k}", "prediction", at, None)] * r.choice([1, 1, 2])
        if r.random() < 0.6:
            rows.append((f"t{k}", "result", at + dt.timedelta(days=r.choice([1, 3, 14, 15, 20])), r.choice(["WIN", "LOSS"])))
    rows += [("orphan", "result", DAY, "WIN"), ("x", "other", DAY, None), (None, "prediction", DAY, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_predictions_end_once(spark, tmp_path, seed):
    r, folder = random.Random(seed), str(tmp_path)
    made = lambda q: S.prediction_ends(q, "2 days")
    rows = sorted(tickets(r, 30), key=lambda x: x[2])
    out, parts = [], [rows[: len(rows) // 3], rows[len(rows) // 3 : len(rows) // 2], rows[len(rows) // 2 :]]
    for k, part in enumerate(parts):
        mixed = part[:]
        r.shuffle(mixed)
        put(spark, folder, k, mixed, TICKETS)
        out += run(spark, folder, TICKETS, made, "append")
    end = DAY + dt.timedelta(days=90)
    for k in (3, 4):  # the watermark passes everything, then the timers fire
        put(spark, folder, k, [(f"late{k}", "prediction", end + dt.timedelta(days=k), None)], TICKETS)
        out += run(spark, folder, TICKETS, made, "append")
    got = {x.id: tuple(x)[1:] for x in out}
    assert len(got) == len(out)
    want = {x.id: tuple(x)[1:] for x in S.ends_of(spark.createDataFrame(rows, TICKETS), str(end)).collect()}
    assert got == want and {s for s, _, _ in got.values()} == {"CLOSED", "VOID"}


def test_a_result_may_come_before_its_prediction(spark, tmp_path):
    folder, made = str(tmp_path), lambda q: S.prediction_ends(q, "5 days")
    put(spark, folder, 0, [("a", "result", DAY + dt.timedelta(days=3), "WIN")], TICKETS)
    assert run(spark, folder, TICKETS, made, "append") == []
    put(spark, folder, 1, [("a", "prediction", DAY, None), ("a", "result", DAY + dt.timedelta(days=4), "LOSS")], TICKETS)
    (one,) = run(spark, folder, TICKETS, made, "append")
    assert tuple(one) == ("a", "CLOSED", "WIN", DAY + dt.timedelta(days=3))


def test_batch_forms_of_nothing(spark):
    assert S.prices_of(spark.createDataFrame([], QUOTES)).count() == 0 and S.ends_of(spark.createDataFrame([], TICKETS), "2024-01-01").count() == 0
    pending = S.ends_of(spark.createDataFrame([("p", "prediction", DAY, None)], TICKETS), "2024-01-10").withColumn("d", F.lit(1)).collect()
    assert (pending[0].status, pending[0].ended_at) == ("PENDING", None)
