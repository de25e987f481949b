"""Incremental registry: a stream of run records upserts the registry table, micro-batch by micro-batch; and each run's status, with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tessera.operators import registry


def latest(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key in a batch, with the batch's first time as first_seen; pre-aggregated."""
    rest = [c for c in batch.columns if c not in (*keys, "first_seen")]
    g = batch.groupBy(*keys).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("_last"), F.min(order).alias("first_seen"))
    return g.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest), "first_seen")


def watch_runs(
    spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, keys: list[str], order: str = "refreshed", run: str | None = None, once: bool = True,
) -> StreamingQuery:
    """Reads JSON run records that arrive below `source` and upserts them into the versioned table, by key or, if a batch always holds
    all records of a run, by `run`. `order` (event time) decides which record is the later one, in a batch and between batches: a record that
    arrives late never replaces a newer one. A batch that is repeated after a failure changes nothing, since upserts are idempotent; a
    registry that cannot be read fails the batch and stays as it is."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        current = latest(batch, keys, order)
        registry.update_table(batch.sparkSession, table, lambda old: current if old is None else registry.upsert(old, current, keys, run, order=order))

    stream = spark.readStream.schema(schema).json(source)
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


STATUS = "run string, status string, first long, last long"


class RunStatus(StatefulProcessor):
    """Keeps of each run the time (ms) of its first and last record and whether the last one, by event time, is complete; a timer makes it stale."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, last long, complete boolean")

    def _row(self, key, status: str, first: int, last: int) -> pd.DataFrame:
        return pd.DataFrame({"run": [key[0]], "status": [status], "first": [first], "last": [last]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, complete = self.seen.get() if self.seen.exists() else (None, None, False)
        for part in rows:
            at = int(part["ms"].max())
            if last is None or at >= last:
                complete = bool(part.loc[part["ms"] == at, "complete"].any()) or (complete and at == last)
                last = at
            first = min(int(part["ms"].min()), at if first is None else first)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not complete:
            self.handle.registerTimer(last + self.limit_ms)
        self.seen.update((first, last, complete))
        yield self._row(key, "completed" if complete else "running", first, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, _ = self.seen.get()
        yield self._row(key, "stale", first, last)

    def close(self) -> None:
        pass


def run_status(records: DataFrame, limit_ms: int, late: str = "10 minutes") -> DataFrame:
    """The status of each run of a stream of records (run, ts, complete) whenever it changes: running, completed, and stale `limit_ms` of event time after
    the last record of a run that is not complete. Records may come in any order up to `late`; event time decides."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in records.sparkSession.conf.get(provider, ""):
        raise ValueError(f"{provider} must be the RocksDB provider, which holds timers")
    rows = records.filter("run IS NOT NULL AND ts IS NOT NULL").select("run", "ts", F.coalesce("complete", F.lit(False)).alias("complete"), F.unix_millis("ts").alias("ms"))
    found = rows.withWatermark("ts", late).groupBy("run").transformWithStateInPandas(RunStatus(limit_ms), STATUS, "Append", "EventTime")
    return found.select("run", "status", F.timestamp_millis("first").alias("first_seen"), F.timestamp_millis("last").alias("refreshed"))


def watch_status(records: DataFrame, table: str, checkpoint: str, limit_ms: int, late: str = "10 minutes", once: bool = True) -> StreamingQuery:
    """Keeps the status of all runs in the versioned table."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        current = latest(batch.drop("first_seen"), ["run"], "refreshed").drop("first_seen")
        current = current.join(batch.groupBy("run").agg(F.min("first_seen").alias("first_seen")), "run")
        registry.update_table(batch.sparkSession, table, lambda old: current if old is None else registry.upsert(old, current, ["run"], order="refreshed"))

    writer = run_status(records, limit_ms, late).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def event_counts(spark: SparkSession, source: str, schema: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and mean values by window and event type, with a watermark for late rows."""
    stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
