"""Streams of stored events: replay, running best, heartbeats, exact dedup."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, name: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    """A table folder or file as a stream of at most ``files`` files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def replay(events: DataFrame, after: int) -> DataFrame:
    """Events past an id, as a client that reconnects asks for."""
    return events.where(F.col("event_id") > after)


def best_so_far(events: DataFrame) -> DataFrame:
    """Lowest and highest value of each type; state is one row a type."""
    return events.groupBy("event_type").agg(F.min("value").alias("lowest"), F.max("value").alias("highest"))


def last_seen(events: DataFrame) -> DataFrame:
    """Last heartbeat of each user; state is one row a user."""
    return events.groupBy("user_id").agg(F.max("ts").alias("last_ts"))


def stale(seen: DataFrame, now, seconds: int = 60) -> DataFrame:
    """Users whose last heartbeat is older than ``seconds``."""
    return seen.where(F.unix_timestamp(now) - F.unix_timestamp("last_ts") > seconds)


class Silence(StatefulProcessor):
    """State of one key: its last event and a timer; when the timer runs out the key is reported once and forgotten."""

    def __init__(self, seconds: int):
        self.millis = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(r.micros for r in rows)
        if self.last.exists():
            newest = max(newest, self.last.get()[0])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((newest,))
        self.handle.registerTimer(newest // 1000 + self.millis)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        found = self.last.get()[0]
        self.last.clear()
        yield Row(user_id=key[0], micros=found)

    def close(self) -> None:
        pass


def silent(events: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """user_id and last_ts of each user without an event for ``seconds`` of event time, once per silence.

    State is one row a user that was heard of lately: a reported user is
    forgotten until the next event. Who is back in the very batch that would
    report the silence is not reported. Events that come later than ``late`` behind
    the newest are dropped.
    """
    rows = events.where("user_id is not null and ts is not null").withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("micros"))
    found = rows.groupBy("user_id").transformWithState(statefulProcessor=Silence(seconds), outputStructType="user_id long, micros long", outputMode="append", timeMode="EventTime")
    return found.select("user_id", F.timestamp_micros("micros").alias("last_ts"))


def unique_recent(events: DataFrame, keys: list[str], within: str) -> DataFrame:
    """First event of each key; a key is forgotten once the newest event is ``within`` past it, so state does not grow for ever."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that stateful processors need, for the streams started inside the block."""
    key, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def unique_payloads(events: DataFrame) -> DataFrame:
    """First event of each payload, across batches; state keeps every payload, so it is for payloads of a bounded number (see :func:`unique_recent`)."""
    return events.dropDuplicates(["event_type", "props"])


def drained(df: DataFrame, mode: str, folder: str, label: str) -> DataFrame:
    """Run a stream over all that is there and return its last result as a table of the shared folder.

    A batch that runs again after a failure overwrites what it wrote before.
    """
    path = f"{folder}/{label}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out").select(df.columns)
