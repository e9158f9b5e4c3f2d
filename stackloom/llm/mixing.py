"""Mixing sources to target weights: certain whole copies, then Pareto order samples of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stackloom.operators.skew import heavy_light_join
from stackloom.session import materialize

#: Cells into which the sampling order is cut to find where a sample ends.
CELLS = 65_536
#: Classes of document sizes an octave; a sample has a fixed number of documents of each.
STEPS = 4
#: Strata up to this number of rows are broadcast.
BROADCAST_STRATA = 100_000


def same_source(source: Column) -> Column:
    """Source names compared without regard to case, surrounding blanks and ``-`` against ``_``."""
    return F.replace(F.lower(F.trim(F.regexp_replace(source, r"^\s+|\s+$", ""))), F.lit("-"), F.lit("_"))


def _uniform(seed: int, *of: str) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _allocate(classes: DataFrame, plans: DataFrame, total: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """How each size class of a plan's source is drawn: whole copies, certain or not, and the number of documents to sample.

    The inclusion odds of a document's further copy are proportional to its size,
    ``least(1, c * n_tokens)``, with ``c`` so that the expected tokens are what the
    whole copies leave open. Going down from the largest class, classes are
    certain until the remaining ones have odds below one. Expected numbers of
    documents become whole ones by systematic rounding with a random start, so
    each class keeps its expectation.
    """
    by_source = classes.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.sum("docs").alias("docs"), F.max("largest").alias("largest_tokens"))
    stats = plans.join(by_source, "source", "left").fillna(0, ["available_tokens", "docs", "largest_tokens"]).withColumn("target_tokens", F.col("target_share") * F.lit(float(total)))
    most = F.col("max_repeats").cast("double")
    rate = F.when(F.col("available_tokens") > 0, F.least(F.coalesce(F.col("target_tokens"), F.lit(0.0)) / F.col("available_tokens"), most)).otherwise(most)
    stats = stats.withColumn("rate", F.greatest(rate, F.lit(0.0))).withColumn("whole", F.floor("rate").cast("int"))
    stats = stats.withColumn("rest", (F.col("rate") - F.col("whole")) * F.col("available_tokens")).drop("rate")
    each = stats.select("plan_id", "source", "whole", "rest").join(classes.select("source", "class", F.col("tokens").alias("x"), F.col("docs").alias("rows"), "squares", "smallest"), "source")
    where = W.partitionBy("plan_id", "source")  # one row a size class
    down = where.orderBy(F.desc("class"))
    above = F.coalesce(F.sum("x").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("c", F.try_divide(F.col("rest") - above, F.sum("squares").over(down.rowsBetween(0, W.unboundedFollowing))))
    # the first class from above whose smallest document has odds below one ends the certain ones
    each = each.withColumn("open_from", F.max(F.when(F.col("c") * F.col("smallest") < 1, F.col("class"))).over(where))
    each = each.withColumn("factor", F.max(F.when(F.col("class") == F.col("open_from"), F.col("c"))).over(where))
    each = each.withColumn("certain", (F.col("rest") > 0) & (F.col("class") >= 0) & (F.col("open_from").isNull() | (F.col("class") > F.col("open_from"))))
    each = each.withColumn("expected", F.when(F.col("certain") | (F.col("factor") <= 0), 0.0).otherwise(F.coalesce(F.least(F.col("factor") * F.col("x"), F.col("rows").cast("double")), F.lit(0.0))))
    upto = F.sum("expected").over(where.orderBy("class").rowsBetween(W.unboundedPreceding, 0)) + _uniform(seed, "plan_id", "source")
    each = each.withColumn("upto", upto).withColumn("size", (F.floor("upto") - F.floor(F.col("upto") - F.col("expected"))).cast("bigint"))
    return stats, each.select("plan_id", "source", "class", "whole", "certain", "size", "x", "rows")


def mix(sizes: DataFrame, plans: DataFrame, seed: int = 20_240_601) -> tuple[DataFrame, DataFrame]:
    """Draw documents for each plan so that token shares meet the plan's.

    ``sizes``: doc_id, source, n_tokens. ``plans``: plan_id, source,
    target_share, max_repeats. The size of a mixture is that of all documents.
    Returns

    * copies: plan_id, source, doc_id, n_tokens, copies (> 0)
    * report: plan_id, source, target_share, target_tokens, available_tokens,
      largest_tokens, docs, whole_copies, sample_size, reached_tokens,
      reached_share, most_copies, short

    A source whose target is r times its tokens gives floor(r) whole copies of
    every document, and a further copy of some, drawn with odds in proportion to
    their sizes. Documents that are certain so are taken; of the others a sample
    of fixed size is drawn by Pareto order: rank by random odds over inclusion
    odds, u / (1 - u) over p / (1 - p), the smallest ranks first. The size is
    fixed for each of STEPS classes an octave, which keeps the tokens within about
    one document (the largest that is not certain) of the target. ``short`` says that the draw holds every document of the
    source max_repeats times and still less than the target.

    The random number of a document depends on plan, id and seed only, so a
    repeated task draws the same. Where a sample ends is found from counts in
    CELLS equal cells of the order; only the one cell on the boundary is sorted.
    A source may hold any share of the rows.

    Defined cases: a null source is in no plan; null sizes count as zero; a
    document of size zero gets whole copies only; a source without documents
    reaches zero; a null or non-positive max_repeats allows no copy; an empty
    table of documents gives no copies and a report of zeros; repeated rows of an
    id are documents of their own.
    """
    n = F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint")
    docs = sizes.select("doc_id", same_source(F.col("source")).alias("source"), n.alias("n_tokens"))
    docs = docs.withColumn("class", F.when(F.col("n_tokens") > 0, F.floor(F.log2(F.greatest("n_tokens", F.lit(1)).cast("double")) * STEPS).cast("int")).otherwise(-1))
    plan = plans.filter("plan_id IS NOT NULL AND source IS NOT NULL").select(
        "plan_id", same_source(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("int").alias("max_repeats")
    )
    x = F.col("n_tokens").cast("double")
    classes = docs.groupBy("source", "class").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"), F.sum(x * x).alias("squares"), F.min("n_tokens").alias("smallest"), F.max("n_tokens").alias("largest"))
    classes = materialize(classes, "classes")
    whole_corpus = classes.agg(F.sum("tokens")).first()[0] or 0  # every document counts, also one without a source
    stats, allocated = _allocate(classes, plan, whole_corpus, seed)
    allocated = materialize(allocated, "allocated")
    drawing = F.struct("plan_id", "whole", "certain", "size", "x")
    dim = allocated.filter("whole > 0 OR certain OR size > 0").groupBy("source", "class").agg(F.collect_list(drawing).alias("draws"), F.max("rows").alias("rows"))  # one entry a plan
    few = allocated.count() <= BROADCAST_STRATA
    if few:
        met = docs.join(F.broadcast(dim.drop("rows")), ["source", "class"])
    else:
        met = heavy_light_join(docs, dim, ["source", "class"], "rows", classes.agg(F.sum("docs")).first()[0] or 0)
    drawn = met.select("source", "class", "doc_id", "n_tokens", F.explode("draws").alias("d")).select("d.plan_id", "source", "class", "doc_id", "n_tokens", "d.whole", "d.certain", "d.size", "d.x")
    odds = F.least(F.col("size") * F.col("n_tokens") / F.col("x"), F.lit(1 - 1e-9))
    random = _uniform(seed, "plan_id", "doc_id")
    drawn = drawn.withColumn("rank", F.when((F.col("size") > 0) & (F.col("n_tokens") > 0), (random / (1 - random)) / (odds / (1 - odds))))
    drawn = drawn.withColumn("cell", F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS).cast("int"))
    where = ["plan_id", "source", "class"]
    cells = drawn.filter("cell IS NOT NULL").groupBy(*where, "cell").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    cells = cells.withColumn("upto", F.sum("n").over(W.partitionBy(*where).orderBy("cell").rowsBetween(W.unboundedPreceding, 0)))
    edge = cells.filter("upto >= size").groupBy(*where).agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("n")).alias("before")), "cell").alias("e"))
    edge = materialize(edge.select(*where, F.col("e.cell").alias("edge"), F.col("e.before").alias("before")), "edges")
    drawn = drawn.join(F.broadcast(edge) if few else edge, where, "left")  # a row of allocated has one edge at most
    taken = F.coalesce(F.col("cell") < F.col("edge"), F.lit(False)) | (F.col("cell").isNotNull() & F.col("edge").isNull())
    sure = drawn.filter("cell IS NULL OR edge IS NULL OR cell <> edge").withColumn("extra", (F.col("certain") | taken).cast("int"))
    place = F.row_number().over(W.partitionBy(*where).orderBy("rank", "doc_id", "n_tokens"))
    last = drawn.filter("cell = edge").withColumn("extra", (F.col("before") + place <= F.col("size")).cast("int"))
    copies = sure.unionByName(last).withColumn("copies", F.col("whole") + F.col("extra")).filter("copies > 0").select("plan_id", "source", "doc_id", "n_tokens", "copies")
    stratum = ["plan_id", "source"]
    reached = copies.groupBy(*stratum).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.max("copies").alias("most_copies"), F.sum("copies").alias("all_copies"))
    sampled = allocated.groupBy(*stratum).agg(F.sum("size").alias("sample_size"))
    report = stats.join(reached, stratum, "left").join(sampled, stratum, "left").fillna(0, ["reached_tokens", "most_copies", "all_copies", "sample_size"])
    plan_tokens = F.sum("reached_tokens").over(W.partitionBy("plan_id"))  # a plan has one row a source
    report = report.withColumn("reached_share", F.when(plan_tokens > 0, F.col("reached_tokens") / plan_tokens).otherwise(0.0))
    short = (F.col("all_copies") == F.col("docs") * F.col("max_repeats")) & (F.col("reached_tokens") < F.col("target_tokens"))
    return copies, report.select(
        *stratum, "target_share", "target_tokens", "available_tokens", "largest_tokens", "docs", F.col("whole").alias("whole_copies"), "sample_size", F.col("reached_tokens").cast("bigint").alias("reached_tokens"), "reached_share",
        F.col("most_copies").cast("int").alias("most_copies"), F.coalesce(short, F.lit(False)).alias("short"),
    )
