"""Keyed state over streams of prices and predictions: opening and current price of a match, and predictions that end by result or by time.

Both processors hold one small value for each open key and clear it by an event-time timer, so state follows the open keys and not
the stream.  What comes out doesn't depend on the order of rows within the watermark, so it equals the batch queries.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: days after which a pending prediction is void.
VOID_AFTER = 14
#: Times travel as milliseconds, so that no time zone of a Python worker matters.
PRICES = "match_key string, n long, opening double, opened_at long, current double, current_at long, closed boolean"
ENDED = "id string, status string, result string, ended_at long"


def with_state_store(spark: SparkSession) -> None:
    """Keyed state of many columns and timers needs the store that keeps state outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Prices(StatefulProcessor):
    """Per match: number of quotes, the earliest and the latest price.  A row for each batch that brings quotes, and a closed one when none
    came for ``days`` of event time; a quote after that opens the match anew."""

    def __init__(self, days: int) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.price = handle.getValueState("price", "n long, opening double, opened long, current double, updated long")

    def _row(self, key: tuple, state: tuple, closed: bool) -> Row:
        n, opening, opened, current, updated = state
        return Row(match_key=key[0], n=n, opening=opening, opened_at=opened, current=current, current_at=updated, closed=closed)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        n, opening, opened, current, updated = self.price.get() if self.price.exists() else (0, None, None, None, None)
        before = updated
        for r in rows:
            at, n = r.at, n + 1
            # of quotes at one time the least opens and the greatest is current
            if opened is None or (at, r.odd) < (opened, opening):
                opened, opening = at, r.odd
            if updated is None or (at, r.odd) > (updated, current):
                updated, current = at, r.odd
        if before != updated:
            if before is not None:
                self.handle.deleteTimer(before + self.days * 86_400_000)
            self.handle.registerTimer(updated + self.days * 86_400_000)
        state = (n, opening, opened, current, updated)
        self.price.update(state)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        state = tuple(self.price.get())
        self.price.clear()
        yield self._row(key, state, True)

    def close(self) -> None:
        pass


class Predictions(StatefulProcessor):
    """Per prediction: PENDING until its result comes (CLOSED) or ``days`` of event time have passed (VOID), whichever is first by event time.

    A result before its prediction waits as long.  A second prediction or result of an id that is held changes nothing; after an end
    the id is forgotten when its time is up, so that repeated rows can't end it twice."""

    def __init__(self, days: int) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "made long, result string, known long, done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        held = tuple(self.held.get()) if self.held.exists() else None
        made, result, known, done = held or (None, None, None, False)
        for r in sorted(rows, key=lambda r: (r.at, r.kind, r.result or "")):
            at = r.at
            if r.kind == "prediction":
                made = at if made is None else min(made, at) if not done else made
            elif known is None or (not done and (at, r.result or "") < (known, result or "")):
                known, result = at, r.result
        if held is None:
            self.handle.registerTimer((made if made is not None else known) + self.days * 86_400_000)
        if not done and made is not None and known is not None and known <= made + self.days * 86_400_000:
            done = True
            yield Row(id=key[0], status="CLOSED", result=result, ended_at=known)
        self.held.update((made, result, known, done))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        made, _, _, done = tuple(self.held.get())
        if made is not None and not done:
            due = made + self.days * 86_400_000
            if due > expiredTimerInfo.getExpiryTimeInMs():  # its result came first and set the time
                self.handle.registerTimer(due)
                return
            yield Row(id=key[0], status="VOID", result=None, ended_at=due)
        self.held.clear()

    def close(self) -> None:
        pass


def price_states(quotes: DataFrame, delay: str = "1 day", days: int = 30) -> DataFrame:
    """Prices of each match from a stream of match_key, ts, odd; rows later than ``delay`` go.  The last row of a match says what is known of it."""
    with_state_store(quotes.sparkSession)
    seen = quotes.filter("match_key is not null and ts is not null and odd is not null").withWatermark("ts", delay)
    told = seen.withColumn("at", F.unix_millis("ts")).groupBy("match_key").transformWithState(Prices(days), PRICES, "Update", "EventTime")
    return told.withColumns({c: F.timestamp_millis(c) for c in ("opened_at", "current_at")})


def prediction_ends(stream: DataFrame, delay: str = "1 day", days: int = VOID_AFTER) -> DataFrame:
    """CLOSED and VOID predictions from a stream of id, kind ('prediction' or 'result'), ts, result; rows later than ``delay`` go."""
    with_state_store(stream.sparkSession)
    seen = stream.filter("id is not null and ts is not null and kind in ('prediction', 'result')").withWatermark("ts", delay)
    told = seen.withColumn("at", F.unix_millis("ts")).groupBy("id").transformWithState(Predictions(days), ENDED, "Append", "EventTime")
    return told.withColumn("ended_at", F.timestamp_millis("ended_at"))


def prices_of(quotes: DataFrame) -> DataFrame:
    """What ``price_states`` ends with, as a batch: match_key, n, opening, opened_at, current, current_at."""
    known = quotes.filter("match_key is not null and ts is not null and odd is not null")
    both = known.groupBy("match_key").agg(F.count("*").alias("n"), F.min(F.struct("ts", "odd")).alias("a"), F.max(F.struct("ts", "odd")).alias("b"))
    return both.select("match_key", "n", F.col("a.odd").alias("opening"), F.col("a.ts").alias("opened_at"), F.col("b.odd").alias("current"), F.col("b.ts").alias("current_at"))


def ends_of(rows: DataFrame, today: str, days: int = VOID_AFTER) -> DataFrame:
    """What ``prediction_ends`` says once event time has passed ``today``, as a batch."""
    known = rows.filter("id is not null and ts is not null and kind in ('prediction', 'result')")
    made, result = F.min(F.when(F.col("kind") == "prediction", F.col("ts"))), F.min(F.when(F.col("kind") == "result", F.struct("ts", "result")))
    by = known.groupBy("id").agg(made.alias("made"), result.alias("r")).filter("made is not null")
    due = F.col("made") + F.make_dt_interval(F.lit(days))
    in_time = F.col("r.ts") <= due
    over = due < F.lit(today).cast("timestamp")
    status = F.when(in_time, "CLOSED").when(over, "VOID").otherwise("PENDING")
    return by.select("id", status.alias("status"), F.when(in_time, F.col("r.result")).alias("result"), F.when(in_time, F.col("r.ts")).when(over, due).alias("ended_at"))

