"""Queries of the general data-processing problems over the whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stackloom.operators import evolution, hierarchy, intervals, joins, shred
from stackloom.session import materialize


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda table, kind: _read(spark, sf_dir, table).select(F.lit(kind).alias("kind"), "file_id", "written_at", "content")
    return part("stored_scans", "stored_scan").unionByName(part("saved_suggestions", "saved_suggestion"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, changes = evolution.resolve(_stored_files(spark, sf_dir), _read(spark, sf_dir, "schema_fields"))
    return changes.select(F.col("kind").alias("record_kind"), "file_id", "field_path", "change_kind")


def _unified(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    files, fields = _stored_files(spark, sf_dir).filter(F.col("kind") == kind), _read(spark, sf_dir, "schema_fields")
    cells, _ = evolution.resolve(files, fields)
    return evolution.unify(files, cells, fields, kind)


def p1_stored_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unified(spark, sf_dir, "stored_scan")


def p1_saved_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unified(spark, sf_dir, "saved_suggestion")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(_read(spark, sf_dir, "call_records"), ["log_id", "qualname"], "start_us", "end_us")


#: The arrays of a stored scan, by their listed names.
_SCAN_ENTITIES = (
    shred.Entity("tree_node", (("report", "entries"),), recursive="children"),
    shred.Entity("finding", (("findings",),), "tree_node"),
    shred.Entity("picker_root", (("pickerRoots",),)),
    shred.Entity("picker_caller", (("callers",),), "picker_root"),
)


def _placed_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, content, places: the last readable delivery of each scan, and where field resolution finds its two arrays."""
    scans = _stored_files(spark, sf_dir).filter("kind = 'stored_scan'")
    outer = [".".join(e.path[0]) for e in _SCAN_ENTITIES if e.parent is None]
    cells, _ = evolution.resolve(scans, _read(spark, sf_dir, "schema_fields"), outer)
    places = evolution.field_places(cells, "stored_scan", outer).withColumnRenamed("places", "beside")
    return evolution.last_readable(scans, places).select("file_id", "content", F.col("beside").alias("places"))


#: Of the samples only the leaves from which rows are rebuilt; the scan reads no other column.
_SAMPLE_LEAVES = "log_id string, line_no bigint, received_at timestamp_ntz, samples array<struct<count: bigint, frames: array<struct<line: int>>>>"


def _events(spark: SparkSession, sf_dir: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(f"{sf_dir}/raw_events.parquet").filter("samples IS NOT NULL").select("log_id", "line_no", "received_at", "samples")
    one = joins.last_delivery(rows, ["log_id", "line_no"], "received_at")
    return one.select(F.concat_ws("#", "log_id", F.col("line_no").cast("string")).alias("record_id"), "samples")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = shred.shred_files(_placed_scans(spark, sf_dir), "file_id", "content", _SCAN_ENTITIES, "places", cells=False)
    samples = shred.shred_lists(_events(spark, sf_dir, _SAMPLE_LEAVES), "record_id", "samples", "frames", "sample", "frame", cells=False)
    return files.unionByName(samples).select("record_id", "entity", "row_path")


def p5_scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a stored scan in one, each row with its parent's path and its own values, pooled strings written out."""
    texts = _placed_scans(spark, sf_dir).withColumn("content", F.udf(shred.expand_report, "string", useArrow=True)("content"))
    return shred.shred_files(texts, "file_id", "content", _SCAN_ENTITIES, "places")


def p5_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and frames with their parent's path and their own values, as text in the order of the names."""
    rows = shred.shred_lists(_events(spark, sf_dir), "record_id", "samples", "frames", "sample", "frame")
    entries = F.transform(F.array_sort(F.map_entries("cells")), lambda c: F.concat_ws("=", c["key"], c["value"]))
    return rows.withColumn("cells", F.array_join(entries, ","))


def _calls_tree(spark: SparkSession, sf_dir: str, **more: object) -> DataFrame:
    return hierarchy.hierarchy(_read(spark, sf_dir, "call_records"), "call_id", "parent_call_id", near=["log_id", "start_us"], agreed=True, **more)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _calls_tree(spark, sf_dir, keep=["depth"])
    wrong = (F.col("state") == "rooted") & F.col("kept_depth").isNotNull() & (F.col("kept_depth") != F.col("depth"))
    fault = F.when(F.col("state") != "rooted", F.col("state")).when(wrong, "wrong_depth")
    return tree.select(F.col("node_id").alias("call_id"), fault.alias("fault"), F.col("top_id").alias("top_call_id")).filter("fault IS NOT NULL")


def _calls_below(spark: SparkSession, sf_dir: str, tree: DataFrame) -> DataFrame:
    """Descendants of every call; below a cycle from its member that the call hangs on."""
    under = hierarchy.cycle_trees(tree, _read(spark, sf_dir, "call_records"), "call_id", "parent_call_id", ["log_id", "start_us"], agreed=True)
    return hierarchy.descendants(tree.select("node_id", "path").unionByName(under.select("node_id", "path")))


def p6_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call's root, depth, path and number of descendants."""
    tree = materialize(_calls_tree(spark, sf_dir, paths=True), "tree")
    below = _calls_below(spark, sf_dir, tree).groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("n_descendants"))
    return tree.join(below, "node_id", "left").select(
        F.col("node_id").alias("call_id"), "top_id", "depth", "state", F.array_join("path", "/").alias("path"), F.coalesce("n_descendants", F.lit(0)).cast("bigint").alias("n_descendants")
    )


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls_below(spark, sf_dir, materialize(_calls_tree(spark, sf_dir, paths=True), "tree"))


QUERIES = {
    f.__name__: f for f in (p1_found, p1_stored_scans, p1_saved_suggestions, p2_found, p5_found, p5_scan_rows, p5_sample_rows, p6_found, p6_hierarchy, p6_descendants)
}
