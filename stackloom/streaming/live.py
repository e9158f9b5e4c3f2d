"""Continuous forms of the aggregations, on Structured Streaming."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from stackloom.operators import profile
from stackloom.plans import schemas

_LOG = logging.getLogger(__name__)


def stream_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Events of a folder into which writers move finished JSON-lines files."""
    reader = spark.readStream.schema(schemas.EVENT_READ).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder).filter("_corrupt_record IS NULL").drop("_corrupt_record")


def live_functions(events: DataFrame) -> DataFrame:
    """The function rollup over everything seen; its state is one row a function."""
    return profile.function_rollup(profile.stack_samples(events))


def live_windows(events: DataFrame, width: str = "10 seconds", late: str | None = None) -> DataFrame:
    """Events per type in tumbling windows of their own time; with ``late``, windows that much behind are closed."""
    timed = events.withColumn("at", F.timestamp_micros(profile.event_time_us(F.col("time")))).filter("at IS NOT NULL")
    if late:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", width)["start"].alias("window_start"), "type").agg(F.count("*").alias("n"))


def publish(df: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, mode: str = "complete", interval: str | None = None) -> StreamingQuery:
    """Give each micro-batch to several sinks; one that fails is logged and does not stop the others. Empty batches are skipped.

    Without an interval the query ends when all present input is read.
    """

    def tee(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            for sink in sinks:
                try:
                    sink(batch, number)
                except Exception:
                    _LOG.exception("a sink failed on batch %d", number)
        finally:
            batch.unpersist()

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(tee)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def snapshot_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Replace a stored snapshot by each batch."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(path)


def append_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Append each batch as JSON lines, under its number, so that a repeated batch is written once."""
    return lambda batch, number: batch.write.mode("overwrite").json(f"{path}/batch={number}")


def ring_sink(path: str, keep: int = 1000, order: str = "time") -> Callable[[DataFrame, int], None]:
    """Keep the last ``keep`` rows by arrival: batch number, then ``order``."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("__batch", F.lit(number))
        try:
            old = spark.read.schema(rows.schema).parquet(f"{path}/{number - 1}") if number else None
        except Exception:
            old = None
        both = rows if old is None else rows.unionByName(old)
        both.orderBy(F.desc("__batch"), F.desc(order)).limit(keep).write.mode("overwrite").parquet(f"{path}/{number}")

    return sink


def last_lines(rows: DataFrame, keep: int, order: list[str]) -> DataFrame:
    """The last rows by a total order, oldest first."""
    last = rows.orderBy(*[F.desc(c) for c in order]).limit(keep)
    return last.withColumn("place", F.row_number().over(W.orderBy(*order)))


def stop_all(spark: SparkSession) -> None:
    for query in spark.streams.active:
        query.stop()


class Progress(StreamingQueryListener):
    """Calls back with (event, query, batch, rows) at the start, after each micro-batch and at the end of every query."""

    def __init__(self, report: Callable[[str, str, int, int], None]) -> None:
        self.report = report

    def onQueryStarted(self, event) -> None:
        self.report("started", event.name or str(event.id), -1, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.report("progress", p.name or str(p.id), p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report("failed" if event.exception else "ended", str(event.id), -1, 0)
