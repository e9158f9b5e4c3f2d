"""The most frequent values of a column by exact prefix refinement.

Values are counted by a prefix of their hash; only prefixes that can still hold a
wanted value are kept and lengthened, until full values remain. A round holds at
most 2^ROUND_BITS counters for the first prefix and bounded refinements of the
survivors after it, whatever the number of distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stackloom.session import materialize

#: Bits by which a round lengthens the prefixes, and those of a whole hash.
ROUND_BITS, HASH_BITS = 20, 64
#: Survivors up to this number are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_PREFIXES = 200_000


def _prefix(bits: int) -> Column:
    return F.col("__hash") if bits >= HASH_BITS else F.call_function("shiftrightunsigned", F.col("__hash"), F.lit(HASH_BITS - bits))


def _keep(rows: DataFrame, survivors: DataFrame, bits: int) -> DataFrame:
    few = survivors.count() <= BROADCAST_PREFIXES
    return rows.withColumn("__prefix", _prefix(bits)).join(F.broadcast(survivors) if few else survivors, "__prefix", "left_semi").drop("__prefix")


def _count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("value").agg(F.sum("weight").alias("weight"))


def frequent(rows: DataFrame, k: int | None = None, share: float | None = None, bits: int = ROUND_BITS) -> DataFrame:
    """value, weight of the ``k`` heaviest values, or of all with at least ``share`` of the total; weights are exact.

    ``rows`` has value and weight; it is read once a round, so it should be a
    stored table. Ties at the k-th place are decided by the smaller value.
    Null values and weights that are null or not positive are left out; an empty
    table gives no rows.
    """
    rows = rows.filter("value IS NOT NULL AND weight > 0").select("value", "weight", F.xxhash64("value").alias("__hash"))
    total = rows.agg(F.sum("weight")).first()[0]
    if total is None:
        return rows.select("value", F.col("weight").cast("bigint").alias("weight")).limit(0)
    kept, floor, left = rows, 0 if share is None else share * total, None
    for done in range(bits, HASH_BITS + bits, bits):
        done = min(done, HASH_BITS)
        counts = materialize(kept.groupBy(_prefix(done).alias("__prefix")).agg(F.sum("weight").alias("w")), "prefixes")
        if share is None:
            floor = max(floor, _kth_bound(kept, counts, k, done))
        survivors = materialize(counts.filter(F.col("w") >= floor).select("__prefix"), "survivors")
        before, left = left, survivors.count()
        kept = _keep(kept, survivors, done)
        if left == before or done == HASH_BITS:
            break  # longer prefixes split nothing any more
    full = _count(kept).filter(F.col("weight") >= floor)
    result = full if k is None else full.orderBy(F.desc("weight"), "value").limit(k)
    return result.select("value", F.col("weight").cast("bigint").alias("weight"))


def _kth_bound(rows: DataFrame, counts: DataFrame, k: int, bits: int) -> int:
    """A lower bound of the k-th heaviest value: the k-th of the values counted fully under the 2 k heaviest prefixes."""
    heads = counts.orderBy(F.desc("w"), "__prefix").limit(2 * k).select("__prefix")
    named = _count(rows.withColumn("__prefix", _prefix(bits)).join(F.broadcast(heads), "__prefix", "left_semi"))
    top = named.orderBy(F.desc("weight")).limit(k).agg(F.count("*").alias("n"), F.min("weight").alias("w")).first()
    return int(top["w"]) if top["n"] == k else 0
