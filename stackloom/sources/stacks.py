"""Stacks in text formats: folded lines and speedscope files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def parse_folded(lines: DataFrame, column: str = "value") -> DataFrame:
    """stack, count of lines ``root;...;leaf N``; lines without a count are dropped."""
    text = F.trim(column)
    parts = lines.select(F.regexp_extract(text, r"^(.*) (\S+)$", 1).alias("stack"), F.regexp_extract(text, r"^(.*) (\S+)$", 2).alias("n"), text.alias("t"))
    good = parts.filter("t LIKE '% %'").withColumn("count", F.when(F.col("n").rlike(r"^\+?[0-9]+$"), F.col("n").try_cast("bigint")))
    return good.filter("count IS NOT NULL").select("stack", "count")


def read_folded(spark: SparkSession, path: str) -> DataFrame:
    return parse_folded(spark.read.text(path))


_SPEEDSCOPE = "shared struct<frames: array<struct<name: string>>>, profiles array<struct<type: string, samples: array<array<int>>, weights: array<double>>>"


def read_speedscope(spark: SparkSession, path: str) -> DataFrame:
    """stack, count of the first profile of each file, if it is a sampled one.

    A sample without weight counts 1; indices outside the frame table are
    dropped from the stack, empty stacks are dropped, equal stacks summed.
    """
    doc = spark.read.schema(_SPEEDSCOPE).option("multiLine", True).json(path)
    first = doc.select("shared.frames", F.get("profiles", F.lit(0)).alias("p")).filter("p.type = 'sampled'")
    each = first.select("frames", "p.weights", F.posexplode("p.samples").alias("i", "s"))
    names = F.expr("array_join(transform(filter(s, x -> x >= 0 AND x < size(frames)), x -> frames[x].name), ';')")
    stacks = each.select(names.alias("stack"), F.coalesce(F.get("weights", F.col("i")), F.lit(1.0)).cast("bigint").alias("count")).filter("stack <> ''")
    return stacks.groupBy("stack").agg(F.sum("count").alias("count"))


def read_stacks(spark: SparkSession, path: str) -> DataFrame:
    """Speedscope for ``.json`` files, folded lines for all others."""
    return read_speedscope(spark, path) if path.lower().endswith(".json") else read_folded(spark, path)


def fold(samples: DataFrame) -> DataFrame:
    """Folded stacks (root first) of stack samples, equal ones summed by ticks."""
    return samples.groupBy(F.array_join(F.reverse(F.col("frames.name")), ";").alias("stack")).agg(F.sum("ticks").alias("count"))
