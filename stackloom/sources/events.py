"""Event logs: JSON lines of stack samples, profiles and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stackloom.functions.scalar import percent_to_double, size_to_bytes
from stackloom.plans import schemas


def read_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of one or more logs. A line with a field of the wrong type is dropped whole, as is one that is no JSON."""
    rows = spark.read.schema(schemas.EVENT_READ).option("mode", "PERMISSIVE").json(path)
    return rows.filter("_corrupt_record IS NULL").drop("_corrupt_record")


def parse_events(df: DataFrame, column: str = "value") -> DataFrame:
    """The same from a column of JSON texts; other columns stay."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rows = df.filter(F.length(F.trim(column)) > 0).withColumn("__e", F.from_json(column, schemas.EVENT_READ, options))
    return rows.filter("__e IS NOT NULL AND __e._corrupt_record IS NULL").select(*[c for c in df.columns if c != column], "__e.*").drop("_corrupt_record")


def unwrap_envelope(df: DataFrame, column: str = "value", event: str = "event", kind: str = "broadcast") -> DataFrame:
    """Payloads of relayed messages ``{"type": kind, "event": ..., "payload": {...}}`` as JSON text in ``value``; others are dropped."""
    parts = df.select(F.from_json(column, "type string, event string, payload string").alias("m"))
    return parts.filter((F.col("m.type") == kind) & (F.col("m.event") == event) & F.col("m.payload").isNotNull()).select(F.col("m.payload").alias("value"))


def log_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modified of the logs below a folder, newest first; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).filter(F.col("path").rlike(r"\.(log|jsonl)$")).orderBy(F.desc("modified"), "path")


def log_metadata(events: DataFrame, log: str = "log_id", order: str = "line_no") -> DataFrame:
    """Of each log the first event, where that is its metadata."""
    rest = [c for c in events.columns if c not in (log, order)]
    first = events.groupBy(log).agg(F.min_by(F.struct(*rest), order).alias("e"))
    return first.select(log, "e.*").filter(F.col("type") == schemas.METADATA_TYPE)


def parse_container_stats(df: DataFrame, column: str = "value") -> DataFrame:
    """cpu_pct, mem_pct, mem_mb, net_rx, net_tx, block_read, block_write from JSON lines of container statistics."""
    s = df.filter(F.length(F.trim(column)) > 0).withColumn("__s", F.from_json(column, "CPUPerc string, MemPerc string, MemUsage string, NetIO string, BlockIO string"))
    half = lambda field, i: size_to_bytes(F.coalesce(F.get(F.split(F.col(f"__s.{field}"), "/"), F.lit(i)), F.lit("")))
    return s.filter("__s IS NOT NULL").select(
        *[c for c in df.columns if c != column],
        F.coalesce(percent_to_double(F.col("__s.CPUPerc")), F.lit(0.0)).alias("cpu_pct"),
        F.coalesce(percent_to_double(F.col("__s.MemPerc")), F.lit(0.0)).alias("mem_pct"),
        (half("MemUsage", 0) / (1024 * 1024)).alias("mem_mb"),
        half("NetIO", 0).alias("net_rx"), half("NetIO", 1).alias("net_tx"), half("BlockIO", 0).alias("block_read"), half("BlockIO", 1).alias("block_write"),
    )


#: Rules an event line must meet, each with the condition that breaks it.
def event_violations(events: DataFrame) -> DataFrame:
    """The events with ``violations``: the names of the rules each breaks."""
    known = [*schemas.TRACE_TYPES, *schemas.PROFILE_TYPES, schemas.CALL_TYPE, schemas.METADATA_TYPE]
    trace, profile, call = F.col("type").isin(schemas.TRACE_TYPES), F.col("type").isin(schemas.PROFILE_TYPES), F.col("type") == schemas.CALL_TYPE
    broken = {
        "type": F.col("type").isNull() | ~F.col("type").isin(known),
        "time": F.col("time").isNull(),
        "period_ns": (trace | profile) & ~F.coalesce(F.col("period_ns") > 0, F.lit(False)),
        "count": trace & ~F.coalesce(F.col("count") > 0, F.lit(False)),
        "frames": trace & ~F.coalesce(F.size("frames") > 0, F.lit(False)),
        "samples": profile & F.col("samples").isNull(),
        "qualname": call & (F.coalesce(F.col("qualname"), F.lit("")) == ""),
        "duration_ns": call & ~F.coalesce(F.col("duration_ns") > 0, F.lit(False)),
        "status": call & ~F.coalesce(F.col("status").isin("ok", "error"), F.lit(False)),
    }
    return events.withColumn("violations", F.array_compact(F.array(*[F.when(c, n) for n, c in broken.items()])))
