"""Interval joins and the scored join of sampled with static nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stackloom.functions.scalar import basename
from stackloom.session import materialize

def containing(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, end: str, point_id: str, order: list[str], strict: bool = False) -> DataFrame:
    """points LEFT JOIN the narrowest range that holds them: all columns of points, then those of the range with ``r_`` before.

    An equi-join on (by, level, block) with the bounds as a residual condition. A
    range's level is the power of four from its width on; blocks of a level are as
    wide, so a range stands in two blocks at most however long it is, and in a
    block a point meets only ranges of about the block's width. Both ends count.
    Among equally narrow ranges the first by ``order`` wins. With ``strict`` the
    range must be wider than the point's own range (``start``/``end`` in points as
    well). Null offsets match nothing.
    """
    r = ranges.select(*[F.col(c).alias(f"r_{c}") for c in ranges.columns]).filter(F.col(f"r_{end}") >= F.col(f"r_{start}"))
    low, high = F.col(f"r_{start}").cast("bigint"), F.col(f"r_{end}").cast("bigint")
    r = r.withColumn("__l", (F.ceil(F.log2((high - low + 1).cast("double")) / 2) * 2).cast("int"))
    levels = sorted(x[0] for x in r.select("__l").distinct().collect())  # 32 at most
    r = r.withColumn("__b", F.explode(F.array_distinct(F.array(F.expr(f"shiftright(cast(r_{start} as bigint), __l)"), F.expr(f"shiftright(cast(r_{end} as bigint), __l)")))))
    p = points.withColumn("__l", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("__b", F.expr(f"shiftright(cast({at} as bigint), __l)"))
    cond = (p["__l"] == r["__l"]) & (p["__b"] == r["__b"]) & (p[at] >= r[f"r_{start}"]) & (p[at] <= r[f"r_{end}"])
    for c in by:
        cond = cond & (p[c] == r[f"r_{c}"])
    if strict:
        cond = cond & (p[end] <= r[f"r_{end}"]) & ((p[end] - p[start]) < (r[f"r_{end}"] - r[f"r_{start}"]))
    rest = [c for c in r.columns if c not in ("__b", "__l")]
    found = p.join(r, cond).select(point_id, *rest)
    width = F.col(f"r_{end}") - F.col(f"r_{start}")
    best = found.groupBy(point_id).agg(F.min(F.struct(width.alias("__w"), *[F.col(f"r_{c}").alias(f"__o{i}") for i, c in enumerate(order)], *rest)).alias("__m"))
    best = best.select(F.col(point_id).alias("__id"), *[F.col(f"__m.{c}").alias(c) for c in rest])
    return points.join(best, points[point_id] == best["__id"], "left").drop("__id")


# Confidence of each way in which a sampled node matches a static one; the first that holds counts.
TIERS = [
    (0.95, "same file + same qualified_name"),
    (0.85, "same basename + same qualified_name"),
    (0.85, "same file + same class + same name"),
    (0.7, "same file + same name"),
    (0.65, "same basename + same class + same name"),
    (0.5, "same basename + same name"),
]
MIN_CONFIDENCE, ALTERNATIVES = 0.5, 3


_TIER_KEYS = [["file", "qualified_name"], ["base", "qualified_name"], ["file", "parent_class"], ["file"], ["base", "parent_class"], ["base"]]


def fuzzy_join(sampled: DataFrame, static: DataFrame) -> DataFrame:
    """node_id, rank (1 best, then up to three alternatives), static_node_id, confidence, reason.

    Both sides have node_id, name, file, qualified_name, parent_class. An equal id
    gives confidence 1 and no alternatives; other nodes are compared with the
    static nodes of the same name only. A node without a match has one row with
    nulls. Ties are ranked by static id. Null and empty fields match nothing.

    Each tier is an equi-join on the name and the tier's fields. Four results are
    wanted at most, so of the static nodes that share a tier's key only the four
    smallest ids take part: however many nodes share a name, no list of pairs
    forms.
    """
    ids = static.select("node_id").distinct()
    exact = sampled.join(ids, "node_id", "left_semi").select("node_id", F.lit(1).alias("rank"), F.col("node_id").alias("static_node_id"), F.lit(1.0).alias("confidence"), F.lit("exact node_id match").alias("reason")).distinct()
    rest = sampled.join(ids, "node_id", "left_anti").withColumn("base", basename(F.col("file"))).select("node_id", "name", "file", "base", "qualified_name", "parent_class")
    side = static.withColumn("base", basename(F.col("file"))).select(F.col("node_id").alias("t_id"), "name", "file", "base", "qualified_name", "parent_class")
    wanted = 1 + ALTERNATIVES
    pairs: DataFrame | None = None
    for (score, why), fields in zip(TIERS, _TIER_KEYS):
        key = ["name", *fields]
        full = F.expr(" AND ".join(f"{c} <> ''" for c in key))
        few = side.filter(full).select(*key, "t_id").distinct().withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy("t_id"))).filter(F.col("__n") <= wanted).drop("__n")
        part = rest.filter(full).join(few, key).select("node_id", "t_id", F.lit(score).alias("score"), F.lit(why).alias("why"))
        pairs = part if pairs is None else pairs.unionByName(part)
    # a pair counts by its first tier; a node has at most four pairs a tier
    one = pairs.groupBy("node_id", "t_id").agg(F.max("score").alias("score"), F.max_by("why", F.struct("score", F.expr("why = 'same basename + same qualified_name'"))).alias("why"))
    best = one.groupBy("node_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "t_id", "why"))), 1, wanted).alias("c"))
    ranked = best.select("node_id", F.posexplode("c").alias("i", "m")).select("node_id", (F.col("i") + 1).alias("rank"), F.col("m.t_id").alias("static_node_id"), (-F.col("m.s")).alias("confidence"), F.col("m.why").alias("reason"))
    none = rest.join(best, "node_id", "left_anti").select("node_id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("static_node_id"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("reason")).distinct()
    return exact.unionByName(ranked).unionByName(none)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def last_delivery(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, where a key has few rows: the one with the largest ``order`` (null the smallest), ties by a hash of the rest.

    The rows are moved once, by key, and ranked there; nothing is combined before,
    as there is next to nothing to combine. For keys with very many rows use
    ``latest_per_key``.
    """
    rest = [c for c in df.columns if c not in keys]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.xxhash64(*rest)))
    return df.repartition(*keys).withColumn("__n", place).filter("__n = 1").drop("__n")


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` of each key, reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("__r")).select(*keys, "__r.*")


def previous_value(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the value of the row before, the row's own where there is none.

    Rows are range-partitioned by key and order, so a key with very many rows is
    spread over tasks; the first row of a key in a partition takes its value from
    the last one before it, found among one row per key and partition.
    """
    spread = materialize(df.repartitionByRange(*keys, order).withColumn("__p", F.spark_partition_id()), "ordered")
    here = spread.withColumn("__n", F.row_number().over(W.partitionBy("__p", *keys).orderBy(order))).withColumn("__v", F.lag(F.struct(value)).over(W.partitionBy("__p", *keys).orderBy(order)))
    ends = spread.groupBy("__p", *keys).agg(F.max_by(F.struct(value), order).alias("__e"))
    ends = ends.withColumn("__before", F.lag("__e").over(W.partitionBy(*keys).orderBy("__p"))).filter("__before IS NOT NULL").select(F.lit(1).alias("__n"), "__p", *keys, "__before")
    joined = here.join(ends, ["__n", "__p", *keys], "left")
    return joined.withColumn(name, F.coalesce(F.col("__v")[value], F.col("__before")[value], F.col(value))).select(*df.columns, name)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Base rows replaced by the last change of their key, and new keys added."""
    rows = base.withColumn("__v", F.lit(0)).withColumn("__o", F.lit(None).cast(dict(changes.dtypes)[order])).unionByName(
        changes.withColumn("__v", F.lit(1)).withColumn("__o", F.col(order)), allowMissingColumns=True
    )
    rest = [c for c in base.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__v", "__o", *rest)).alias("__r")).select(*keys, "__r.*")


def patch(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows with the non-null values of ``changes`` (one row a key) written over theirs."""
    given = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in given])
    return base.join(new, keys, "left").select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in given else F.col(c) for c in base.columns])


def verdict(current: Column, baseline: Column) -> Column:
    """``regression`` where the value exceeds the baseline by over a tenth, else ``ok``."""
    return F.when(current > F.floor(baseline * F.lit(1.1) + 0.5), "regression").otherwise("ok")


def gate(mode: Column, regressions: Column, issues: Column) -> Column:
    """Whether a check fails: never, on a regression, or on any issue."""
    return F.when(mode == "regression", regressions > 0).when(mode == "any", issues > 0).otherwise(F.lit(False))
