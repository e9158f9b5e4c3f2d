"""Filling fixed-capacity containers with items: bounded-space online best-fit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Open containers a task keeps, and items a task packs.
OPEN_BINS, TASK_ITEMS = 256, 500_000


class BestFit:
    """Online best-fit with a bounded number of open bins.

    Bit f of ``mask`` is set while some open bin has f units free, so the best
    fit for an item of s units is the lowest set bit from s on. When no open bin
    fits and ``limit`` are open, the fullest one closes.
    """

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.mask, self.free, self.open, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _pop(self, room: int) -> int:
        number = self.free[room].pop()
        if not self.free[room]:
            self.mask &= ~(1 << room)
        self.open -= 1
        return number

    def place(self, size: int) -> int:
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            number = self._pop(room)
        else:
            if self.open >= self.limit:
                self._pop((self.mask & -self.mask).bit_length() - 1)
            room, number = self.capacity, self.made
            self.made += 1
        left = room - size
        if left:  # a full bin is closed
            self.free[left].append(number)
            self.mask |= 1 << left
            self.open += 1
        return number


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens", open_bins: int = OPEN_BINS, task_items: int = TASK_ITEMS) -> DataFrame:
    """item_id, piece, pieces, first_unit, size, container_id: where each item, or piece of one, goes.

    Only items above ``capacity`` are split, into full pieces and one remainder.
    A full piece fills a container of its own, so it is only numbered; what is
    packed is one size an item, its remainder. Items are spread by a hash of their
    id, so tasks are even whatever the ids and sizes, and packed in the order of
    that hash, which makes a repeated task give the same containers. Each task
    leaves at most ``open_bins`` containers partly filled. Items of size zero, or
    null, get piece 0 of size 0 and no container; rows with a null id are packed
    like any other; an empty table gives no rows.
    """
    kind = dict(sizes.dtypes)[id_col]
    room = F.lit(capacity).cast("bigint")
    items = sizes.select(F.col(id_col).alias("item_id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    items = items.select("item_id", "n", F.expr(f"n div {capacity}").alias("whole"), F.pmod("n", room).alias("rest"), F.xxhash64("item_id", "n").alias("__order"))
    tasks = max(1, -(-sizes.count() // task_items))
    spread = items.repartition(tasks, "__order").sortWithinPartitions("__order", "item_id", "n")
    schema = f"item_id {kind}, n bigint, whole bigint, rest bigint, task int, first_whole bigint, bin bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        bins, filled = BestFit(capacity, open_bins), 0
        for pdf in batches:
            upto = filled + pdf["whole"].cumsum()
            pdf["task"], pdf["first_whole"] = task, upto - pdf["whole"]
            filled = int(upto.iloc[-1]) if len(pdf) else filled
            pdf["bin"] = pd.array([bins.place(s) if s > 0 else None for s in pdf["rest"].tolist()], dtype="Int64")
            yield pdf.drop(columns="__order")

    placed = spread.mapInPandas(run, schema)
    pieces = F.greatest(F.col("whole") + (F.col("rest") > 0).cast("bigint"), F.lit(1))
    placed = placed.withColumn("pieces", pieces.cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    full = F.col("piece") < F.col("whole")
    return placed.select(
        "item_id", "piece", "pieces", (F.col("piece") * room).alias("first_unit"), F.when(full, room).otherwise(F.col("rest")).alias("size"),
        F.when(full, F.concat_ws("-", F.col("task").cast("string"), F.concat(F.lit("f"), (F.col("first_whole") + F.col("piece")).cast("string")))).when(F.col("rest") > 0, F.concat_ws("-", F.col("task").cast("string"), F.col("bin").cast("string"))).alias("container_id"),
    )


def split_items(packed: DataFrame) -> DataFrame:
    """item_id of the items whose pieces lie in several containers."""
    held = packed.filter("container_id IS NOT NULL").groupBy("item_id").agg(F.min("container_id").alias("a"), F.max("container_id").alias("b"))
    return held.filter("a <> b").select("item_id")


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """container_id, items, used, unused: what each container holds."""
    return packed.filter("container_id IS NOT NULL").groupBy("container_id").agg(F.count("*").alias("items"), F.sum("size").alias("used")).withColumn("unused", F.lit(capacity) - F.col("used"))
