"""Joins and groupings that survive a key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key is heavy from this share of all rows on, so at most 1 / HEAVY_SHARE keys are.
HEAVY_SHARE = 1 / 1024
#: A key of fewer rows than this is not worth spreading, whatever its share.
HEAVY_ROWS = 10_000


def _named(keys: list[str]) -> Column:
    return F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))


def heavy_light_join(fact: DataFrame, dim: DataFrame, keys: list[str], rows_col: str, total_rows: int) -> DataFrame:
    """Inner equi-join of ``fact`` with one-row-per-key ``dim``, whose rows are of bounded size.

    ``dim[rows_col]`` is the number of fact rows of the key. Keys with at least
    ``HEAVY_SHARE`` of ``total_rows`` are at most 1,024 by counting, whatever
    the data, so they are broadcast; all other keys meet in a shuffle in which
    none is large. ``rows_col`` is dropped. Null keys match nothing.
    """
    floor = max(1, int(total_rows * HEAVY_SHARE))
    dim = dim.filter(_named(keys))
    heavy = F.broadcast(dim.filter(F.col(rows_col) >= floor).drop(rows_col))
    light = dim.filter(F.col(rows_col) < floor).drop(rows_col)
    rest = fact.join(heavy.select(*keys), keys, "left_anti")
    return fact.join(heavy, keys).unionByName(rest.join(light, keys))


def heavy_copies(counts: DataFrame, keys: list[str], rows_col: str, total_rows: int, least: int = HEAVY_ROWS) -> DataFrame | None:
    """Of keys with at least ``HEAVY_SHARE`` of all rows and ``least`` rows: keys and __copies, one for every such share; None where no key is heavy.

    These are 1,024 keys at most by counting, so their names may come to the driver.
    """
    floor = max(least, int(total_rows * HEAVY_SHARE))
    named = counts.filter(_named(keys)).filter(F.col(rows_col) >= floor).select(*keys, F.expr(f"cast({rows_col} div {floor} + 1 as int)").alias("__copies"))
    found = named.collect()
    return counts.sparkSession.createDataFrame(found, named.schema) if found else None


def salted_join(fact: DataFrame, dim: DataFrame, keys: list[str], heavy: DataFrame | None, spread: list[str]) -> DataFrame:
    """Inner equi-join of ``fact`` with one-row-per-key ``dim`` of any size; nothing is broadcast but the heavy keys' names.

    ``heavy`` is what ``heavy_copies`` gives for the fact rows. A heavy key's row in
    ``dim`` is copied, which makes 2,048 copies at most together, and its fact rows
    are spread over the copies by a hash of the columns ``spread``. Null keys match
    nothing.
    """
    dim = dim.filter(_named(keys))
    if heavy is None:
        return fact.join(dim.hint("merge"), keys)
    names = F.broadcast(heavy)
    sides = dim.join(names, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1))).drop("__copies")
    salted = fact.join(names, keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__copies")).cast("int"), F.lit(0))).drop("__copies")
    return salted.join(sides.hint("merge"), [*keys, "__salt"]).drop("__salt")
