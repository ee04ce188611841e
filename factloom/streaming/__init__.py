"""Structured Streaming: daily trends, publishing, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, name: str = "*") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(path)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, event_type, n: tumbling days; a day is final once the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def publish(requests: DataFrame, path: str, checkpoint: str, valid) -> StreamingQuery:
    """Append the valid requests of each batch to a table and the others beside it; a batch that runs again replaces its own files."""

    def store(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("_ok", F.coalesce(valid, F.lit(False)))
        marked.where("_ok").drop("_ok").write.mode("overwrite").parquet(f"{path}/accepted/batch={number}")
        marked.where("NOT _ok").drop("_ok").write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")

    return requests.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fanned_out(events: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append the events of each batch to a directory for each value of `key` (a project's subscribers read theirs alone), in one job whatever
    the number of values. A batch is a directory by its number, and one that runs again after a failure replaces its own, so a restart from
    the checkpoint gives each event once."""

    def send(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(key).parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def received(spark: SparkSession, path: str, schema, key: str, value=None) -> DataFrame:
    """The events that were sent, all or those of one value of `key`, which are read from its directories alone. schema: that of the events."""
    rows = spark.read.schema(schema).parquet(path)
    return (rows if value is None else rows.where(F.col(key) == value)).select(*schema.fieldNames())


class _Bucket(StatefulProcessor):
    """A key's bucket: tokens, and the second of its last refill. A timer at the time when the bucket is full again forgets it."""

    def __init__(self, key: str, capacity: int, refill: int, period: int) -> None:
        self.key, self.capacity, self.refill, self.period = key, capacity, refill, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens long, filled long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tokens, filled = self.bucket.get() if self.bucket.exists() else (self.capacity, None)
        requests = pd.concat(list(rows)).sort_values("ts", kind="stable")
        allowed = []
        for ts in requests["ts"]:
            now = int(ts.timestamp())
            filled = now if filled is None else filled
            if (periods := max(0, (now - filled) // self.period)) > 0:
                tokens, filled = min(self.capacity, tokens + periods * self.refill), now
            allowed.append(tokens > 0)
            tokens -= tokens > 0
        self.bucket.update((tokens, filled))
        full = filled + self.period * -(-(self.capacity - tokens) // self.refill)
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = max(1000 * full, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(at)
        self.timer.update((at,))
        yield pd.DataFrame({self.key: [key[0]] * len(requests), "ts": requests["ts"], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, key: str, capacity: int, refill: int, period: int = 60, late: str = "1 minute") -> DataFrame:
    """key, ts, allowed: a token bucket a key that gets `refill` tokens for each whole period of seconds since its last refill; requests (key, ts)
    of a batch count in time order, those that are later than the watermark not at all.

    A bucket that has had no request until it is full again is dropped once the watermark is past that time. A full bucket and none
    behave alike, so nothing is forgotten that matters and the state has the keys of the last capacity / refill periods alone. Timers need
    the state store that is set here."""
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = requests.schema[key].dataType.simpleString()
    timed = requests.select(key, F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy(key).transformWithStateInPandas(_Bucket(key, capacity, refill, period), f"{key} {kind}, ts timestamp, allowed boolean", "Append", "EventTime")


def requests_per_minute(requests: DataFrame, key: str, capacity: int) -> DataFrame:
    """The batch proxy of a limit: requests of each key and minute, and how many are over the capacity."""
    n = F.count("*")
    return requests.groupBy(key, F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(n.alias("n"), F.greatest(n - capacity, F.lit(0)).alias("over"))
