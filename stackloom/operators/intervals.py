"""Continuous periods and gaps of overlapping intervals per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stackloom.session import materialize

#: An entity with more rows than this is cut into pieces of about so many along its start times.
SPLIT_ROWS = 500_000
#: Heavy entities up to this number are named in a broadcast; more meet in a shuffle.
BROADCAST_ENTITIES = 10_000


def _cuts(rows: DataFrame, keys: list[str], split_rows: int) -> tuple[DataFrame, bool] | None:
    """Of each entity with more than ``split_rows`` rows the start times at which it is cut: keys, bounds array<bigint>; and whether these are few.

    Start times of heavy entities are first counted in cells (at most 64 cells a
    piece, of equal width between the entity's ends); a cell that itself holds
    several pieces is counted again in smaller cells, until a cell is one start
    time or small. Bounds are placed where the running count passes a multiple of
    ``split_rows``.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__from").alias("__lo"), F.max("__from").alias("__hi"))
    heavy = materialize(sizes.filter(F.col("__n") > split_rows), "heavy")
    count = heavy.count()
    if not count:
        return None
    few = count <= BROADCAST_ENTITIES
    cell = [*keys, "__lo"]
    open_ = heavy.withColumn("__width", F.greatest(F.expr(f"(__hi - __lo) div (64 * (__n div {split_rows} + 1))"), F.lit(1)))
    open_ = materialize(open_.select(*keys, "__lo", "__hi", "__width"), "cells")
    done: list[DataFrame] = []
    while True:
        side = open_.select(*keys, F.col("__lo").alias("__cell_lo"), F.col("__hi").alias("__cell_hi"), "__width")
        named = _null_safe(rows, F.broadcast(side) if few else side, keys).filter("__from BETWEEN __cell_lo AND __cell_hi")
        at = F.expr("__cell_lo + ((__from - __cell_lo) div __width) * __width")
        cells = materialize(named.groupBy(*keys, at.alias("__lo"), "__width").agg(F.count("*").alias("__n"), F.max("__from").alias("__hi")), "cells")
        again = cells.filter((F.col("__n") > split_rows) & (F.col("__hi") > F.col("__lo")) & (F.col("__width") > 1))
        done.append(cells.join(again.select(*[F.col(k).alias(f"__a_{k}") for k in keys], F.col("__lo").alias("__a_lo")), _same(cells, keys) & (F.col("__lo") == F.col("__a_lo")), "left_anti"))
        open_ = materialize(again.select(*cell, "__hi", F.greatest(F.expr(f"__width div (64 * (__n div {split_rows} + 1))"), F.lit(1)).alias("__width")), "cells")
        if open_.isEmpty():
            break
        few = few and open_.count() <= BROADCAST_ENTITIES
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    upto = F.sum("__n").over(W.partitionBy(*keys).orderBy("__lo").rowsBetween(W.unboundedPreceding, 0))  # some hundred rows a piece at most
    marks = whole.withColumn("__upto", upto).filter(F.expr(f"__upto div {split_rows} > (__upto - __n) div {split_rows}"))
    bounds = marks.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col("__lo"))).alias("__bounds"))
    return materialize(bounds, "bounds"), count <= BROADCAST_ENTITIES


def _same(left: DataFrame, keys: list[str]) -> Column:
    out: Column = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(F.col(f"__a_{k}"))
    return out


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    right = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond: Column = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"__r_{k}"])
    return left.join(right, cond, how).drop(*[f"__r_{k}" for k in keys])


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Periods and gaps: keys, kind ('period' | 'gap'), from_us, to_us.

    A period is a maximal run of intervals that overlap, nest or touch; a gap
    reaches from one period's end to the next one's start. Bounds are integers
    (microseconds) with absolute value under 2^61.

    How: ``session_window`` with the row's own duration merges the intervals.
    Bounds are doubled first and half a unit is added to each end, so that an
    interval of length zero is kept and intervals that touch fall into one
    session, with integers throughout. Gaps come from ``lead``.

    An entity with over ``split_rows`` rows is cut along its start times into
    pieces of about that size, however many that takes; each piece merges by
    itself and the pieces are joined through one summary row per piece, so no task
    sees a whole heavy entity. Rows with one start time stay together.

    Defined cases: rows with a null bound or an end before the start are no
    intervals; repeated rows change nothing; a null key value is a key of its
    own; an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(*keys, F.col(start).cast("bigint").alias("__from"), F.col(end).cast("bigint").alias("__to")).filter("__from IS NOT NULL AND __to IS NOT NULL AND __to >= __from")
    found = _cuts(rows, keys, split_rows)
    piece = [*keys, "__piece"]
    if found is None:
        piece = keys
    else:
        cuts, few = found
        rows = _null_safe(rows, F.broadcast(cuts) if few else cuts, keys, "left")
        rows = rows.withColumn("__piece", F.expr("coalesce(size(filter(__bounds, b -> b <= __from)), 0)")).drop("__bounds")
    span = F.session_window(F.timestamp_micros(F.col("__from") * 2), F.expr("make_interval(0, 0, 0, 0, 0, 0, cast((2 * (__to - __from) + 1) as decimal(24, 0)) / 1000000)"))
    merged = rows.groupBy(*piece, span).agg(F.min("__from").alias("from_us"), F.max("__to").alias("to_us")).drop("session_window")
    if found is None:
        periods = merged.withColumn("__next", F.lead("from_us").over(W.partitionBy(*keys).orderBy("from_us")))
        return _with_gaps(periods, keys)
    return _with_gaps(_across(merged, keys, piece), keys)


def _across(merged: DataFrame, keys: list[str], piece: list[str]) -> DataFrame:
    """Join the periods of an entity's pieces; every window here covers one piece, or one row a piece."""
    whole = merged.groupBy(*piece).agg(F.max("to_us").alias("__end"))
    earlier = W.partitionBy(*keys).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    carry = whole.withColumn("__carry", F.max("__end").over(earlier)).select(*piece, "__carry")
    marked = _null_safe(merged, carry, piece).withColumn("__new", F.col("__carry").isNull() | (F.col("from_us") > F.col("__carry")))
    # of each piece: where its first new period starts, and how far what came before it reaches
    heads = marked.groupBy(*piece).agg(
        F.min(F.when(F.col("__new"), F.col("from_us"))).alias("__first"),
        F.greatest(F.max("__carry"), F.max(F.when(~F.col("__new"), F.col("to_us")))).alias("__reach"),
    )
    # from the piece onwards: the next piece with a new period, and the reach before it
    later = W.partitionBy(*keys).orderBy("__piece").rowsBetween(1, W.unboundedFollowing)
    ends = heads.select(
        *piece,
        F.min("__first").over(later).alias("__next_first"),
        F.min(F.when(F.col("__first").isNotNull(), F.struct("__piece", "__reach"))).over(later)["__reach"].alias("__next_reach"),
        F.max("__reach").over(later).alias("__last_reach"),
    )
    in_piece = W.partitionBy(*piece).orderBy("from_us")
    own = marked.filter("__new").withColumn("__own_next", F.lead("from_us").over(in_piece))
    joined = _null_safe(own, ends, piece)
    last = F.col("__own_next").isNull()
    return joined.select(
        *keys,
        "from_us",
        F.when(~last, F.col("to_us")).otherwise(F.greatest("to_us", F.when(F.col("__next_first").isNotNull(), F.col("__next_reach")).otherwise(F.col("__last_reach")))).alias("to_us"),
        F.coalesce("__own_next", "__next_first").alias("__next"),
    )


def _with_gaps(periods: DataFrame, keys: list[str]) -> DataFrame:
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("from_us"), F.col("to_us")),
        F.when(F.col("__next").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("to_us").alias("from_us"), F.col("__next").alias("to_us"))),
    )
    return periods.select(*keys, F.explode(F.filter(both, lambda x: x.isNotNull())).alias("__x")).select(*keys, "__x.*")
