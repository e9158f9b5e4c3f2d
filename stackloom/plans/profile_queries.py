"""Queries of the profile, graph, finding and portal operators over the whole test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stackloom.functions import predicates as P, scalar as S
from stackloom.lint import sqlrules
from stackloom.operators import findings as fd, graph, joins, profile, reports
from stackloom.plans import schemas
from stackloom.session import materialize
from stackloom.sources import events as ev

FOCUS = "feed.planner.MediaCodec.fetch_page"
FILTER = "src !file:planner name:_"
EXCLUDED = ["/planner.py", "/views.py"]
#: Paths of the profiler itself, which are no user code either.
OWN_PATHS = ["/codec.py"]
#: Roots of the largest reach, and symbols of the largest fan-out, whose call trees are asked for.
TREE_ROOTS, TREE_HUBS = 20, 20


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, columns: list[str], frame: list[str] | None = None) -> DataFrame:
    """Log lines with some columns only, repeated ones once; the scan reads no other column and no other field of a frame."""
    layout = schemas.pruned(columns, frame or schemas.FRAME_FIELDS, "log_id string, line_no bigint, received_at timestamp_ntz, ")
    return joins.last_delivery(spark.read.schema(layout).parquet(f"{sf_dir}/raw_events.parquet"), ["log_id", "line_no"], "received_at")


#: What stack samples are made of, besides the fields of the frames.
_SAMPLED = ["type", "period_ns", "duration_ns", "cpu", "count", "frames", "samples", "qualname", "file", "line"]


def _samples(spark: SparkSession, sf_dir: str, frame: list[str]) -> DataFrame:
    return profile.stack_samples(_events(spark, sf_dir, _SAMPLED, frame), frame=frame)


def function_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = profile.function_rollup(_samples(spark, sf_dir, ["name", "file", "line"]))
    return got.select("qualname", "ncalls", "total_us", "cumulative_us", F.round("cpu_avg", 6).alias("cpu_avg"), "file", "line", F.round("percall_us", 6).alias("percall_us"))


def statistics_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _events(spark, sf_dir, ["type", "status", "qualname"]).filter("type = 'function_call' AND status = 'error' AND qualname <> ''").groupBy("qualname").agg(F.count("*").alias("errors"))
    return profile.statistics_cards(profile.function_rollup(_samples(spark, sf_dir, ["name", "file", "line"])), calls)


def call_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = profile.call_tree(_samples(spark, sf_dir, schemas.FRAME_FIELDS))
    return got.select(F.array_join("path", ";").alias("path"), "name", "depth", "value", "self_value", "ncalls", "qualname", "module", "node_id")


def callers_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = profile.call_tree(_samples(spark, sf_dir, schemas.FRAME_FIELDS))
    return profile.neighbours(tree, FOCUS.rsplit(".", 1)[1])


def focus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.focus_totals(profile.call_tree(_samples(spark, sf_dir, schemas.FRAME_FIELDS)), FOCUS.rsplit(".", 1)[1])


def frame_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = profile.function_rollup(_samples(spark, sf_dir, ["name", "file", "line"]))
    return got.filter(P.frame_filter(FILTER, F.col("qualname"), F.col("file"))).select("qualname", "cumulative_us")


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stackloom.sources.stacks import fold

    got = profile.hotspots(fold(_samples(spark, sf_dir, ["name"])), 50)
    return got.select("rank", "function", "category", "severity", F.round("self_pct", 6).alias("self_pct"), F.round("total_pct", 6).alias("total_pct"), "samples", "example_stack")


def sample_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, weight and ticks by length of the stack."""
    return _samples(spark, sf_dir, ["line"]).groupBy(F.size("frames").alias("depth")).agg(F.count("*").alias("samples"), F.sum("weight_us").alias("weight_us"), F.sum("ticks").alias("ticks"))


def leaf_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, ["frames"], ["file"]).filter("frames IS NOT NULL")
    return rows.filter(~P.leaf_excluded(F.col("frames"), EXCLUDED)).groupBy("log_id").agg(F.count("*").alias("kept"))


def system_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _samples(spark, sf_dir, ["file"]).select(F.explode("frames").alias("f")).select("f.*")
    return frames.groupBy(P.is_system_path(F.col("file"), OWN_PATHS).alias("system"), P.is_test_path(F.coalesce("file", F.lit(""))).alias("test")).agg(F.count("*").alias("frames"))


def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _samples(spark, sf_dir, ["name", "file", "qualified_name"]).select(F.explode("frames").alias("f")).select("f.*")
    q = F.col("qualified_name")
    return f.select(S.node_id(F.col("file"), F.col("name"), q).alias("node_id"), S.symbol_kind(q).alias("kind"), S.parent_class(q).alias("owner"), S.basename(F.col("file")).alias("base")).distinct()


def window_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = profile.window_metadata(_events(spark, sf_dir, ["time", "service", "pod"]), ["log_id"])
    return got.select("log_id", "events", "from_us", "to_us", "duration_us", F.array_join("services", ",").alias("services"), F.array_join("pods", ",").alias("pods"))


def event_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ev.event_violations(_events(spark, sf_dir, ["type", "time", "period_ns", "duration_ns", "count", "frames", "samples", "qualname", "status"], ["line"]))
    return got.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("events"))


def log_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata at the head of each stretch of eight lines, as a log that is rotated so often would have it."""
    lines = _events(spark, sf_dir, ["type", "time", "service", "pod"]).withColumn("log_id", F.concat_ws("/", "log_id", F.expr("line_no div 8").cast("string")))
    return ev.log_metadata(lines).select("log_id", "time", "service", "pod")


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = profile.window_counts(_read(spark, sf_dir, "events"), "ts", "10 minutes", ["event_type"])
    return got.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def trace_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces as one profile a window: number of distinct stacks and ticks of each."""
    rows = _events(spark, sf_dir, ["type", "time", "period_ns", "count", "frames"]).filter("type IN ('wall_trace', 'cpu_trace') AND count > 0 AND period_ns > 0 AND size(frames) > 0")
    rows = rows.withColumn("at", F.timestamp_micros(S.event_time_us(F.col("time")))).filter("at IS NOT NULL")
    got = profile.bundle(rows, "at", "1 minute")
    return got.select(F.unix_micros("window_start").alias("window_us"), "type", "period_ns", F.size("samples").alias("stacks"), F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, s: a + s["count"]).alias("ticks"))


def window_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.window_counts(_read(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"]).withColumnRenamed("event_type", "name")
    got = profile.backfill_windows(rows, 30)
    return got.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "name", "n")


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest_per_key(_read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"), ["o_custkey"], "o_orderkey")


def previous_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.previous_value(_read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice", "baseline")
    return rows.withColumn("verdict", joins.verdict(F.col("o_totalprice"), F.col("baseline")))


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.conditional_counts(_read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


def three_level_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, nations and regions with the orders below them."""
    orders = _read(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    customers = reports.totals_over(_read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", orders, "o_custkey", {"cents": "cents"})
    nations = reports.totals_over(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey", customers.withColumnRenamed("children", "orders"), "c_nationkey", {"orders": "orders", "cents": "cents"})
    regions = reports.totals_over(_read(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey", nations.withColumnRenamed("children", "customers"), "n_regionkey", {"customers": "customers", "orders": "orders", "cents": "cents"})
    return regions.select("r_name", F.col("children").alias("nations"), "customers", "orders", "cents")


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers overwritten by all customers, whose keys are moved on by half the suppliers: some rows stay, some are updated, some are new."""
    base = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    half = F.expr("n div 2")
    moved = base.agg(F.count("*").alias("n")).select(half).scalar()
    new = _read(spark, sf_dir, "customer").select((F.col("c_custkey") + moved).alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return joins.upsert(base, new, ["k"], "k")


def language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reports.language_share(_read(spark, sf_dir, "documents"), "lang", "n_chars")
    return got.select("language", "files", "bytes", F.round("percent", 6).alias("percent"))


def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts by flag and status, early against late shipments."""
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", (F.col("l_shipdate") >= F.lit("1995-06-17").cast("timestamp_ntz")).alias("late")).agg(F.count("*").alias("n"))
    return reports.diff_maps(rows.filter("NOT late"), rows.filter("late"), ["l_returnflag", "l_linestatus"], "n")


def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    cut = F.lit("1995-06-17").cast("timestamp_ntz")
    side = lambda c: rows.filter(c).select("l_partkey", "l_suppkey")
    return reports.diff_sets(side(F.col("l_shipdate") < cut), side(F.col("l_shipdate") >= cut))


def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the narrowest hour-aligned range of its user's activity around it."""
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    wide = rows.groupBy("user_id", (F.floor(F.col("at") / 86400)).alias("d")).agg(F.min("at").alias("s"), F.max("at").alias("e"), F.min("event_id").alias("range_id"))
    whole = rows.groupBy("user_id").agg(F.min("at").alias("s"), F.max("at").alias("e"), (F.min("event_id") + 1_000_000_000).alias("range_id"))
    ranges = wide.drop("d").unionByName(whole)
    got = joins.containing(rows, ranges, ["user_id"], "at", "s", "e", "event_id", ["range_id"])
    return got.select("event_id", "r_range_id", "r_s", "r_e")


def fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = _read(spark, sf_dir, "supplier").select(
        F.concat_ws("::", F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), F.concat(F.lit("n"), (F.col("s_suppkey") % 40).cast("string")).alias("name"),
        F.concat(F.lit("/app/f"), (F.col("s_nationkey")).cast("string")).alias("file"), F.concat(F.lit("q"), (F.col("s_suppkey") % 80).cast("string")).alias("qualified_name"), F.concat(F.lit("c"), (F.col("s_suppkey") % 3).cast("string")).alias("parent_class"),
    )
    static = _read(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 50 == 0, F.concat_ws("::", F.lit("s"), F.col("c_custkey").cast("string"))).otherwise(F.concat_ws("::", F.lit("c"), F.col("c_custkey").cast("string"))).alias("node_id"),
        F.concat(F.lit("n"), (F.col("c_custkey") % 40).cast("string")).alias("name"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "/app/f").otherwise("src/f"), F.col("c_nationkey").cast("string")).alias("file"),
        F.concat(F.lit("q"), (F.col("c_custkey") % 80).cast("string")).alias("qualified_name"), F.concat(F.lit("c"), (F.col("c_custkey") % 3).cast("string")).alias("parent_class"),
    )
    return joins.fuzzy_join(sampled, static)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A directed graph over customers from all orders: the buyer calls a customer of the lower half, so that the upper half has no callers."""
    customers = _read(spark, sf_dir, "customer")
    half = customers.count() // 2
    edges = _read(spark, sf_dir, "orders")
    edges = edges.select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 31 + 7) % half + 1).alias("dst"), F.col("o_orderkey").alias("ord")).filter("src <> dst").groupBy("src", "dst").agg(F.min("ord").alias("ord"))
    text = lambda c: F.lpad(F.col(c).cast("string"), 9, "0").alias(c)
    return customers.select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id")), edges.select(text("src"), text("dst"), "ord")


def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_in_out(*_graph(spark, sf_dir))


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until the L1 change is below the tolerance."""
    v, e = _graph(spark, sf_dir)
    e = e.join(v.select(F.col("id").alias("src")), "src").join(v.select(F.col("id").alias("dst")), "dst")
    return graph.pagerank(v, e).select("id", F.round("rank", 9).alias("rank"))


def reach_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = _graph(spark, sf_dir)
    return graph.reach_counts(v, e)


def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(_graph(spark, sf_dir)[1])


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as symbols: names, files and metrics follow from the key."""
    k = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(
        F.lpad(k.cast("string"), 9, "0").alias("id"), F.concat(F.when(k % 11 == 0, "get").when(k % 13 == 0, "_").when(k % 17 == 0, "<").otherwise("f"), F.lit("N"), (k % 500).cast("string")).alias("name"),
        F.when(k % 19 == 0, "class").otherwise("function").alias("kind"), F.concat(F.when(k % 7 == 0, "tests/").otherwise("src/"), (k % 23).cast("string"), F.lit(".py")).alias("file"), (k % 900).cast("int").alias("line"),
        (k % 200).cast("int").alias("loc"), (k % 20).cast("int").alias("complexity"), (k % 7).cast("int").alias("nesting_depth"), (k % 4 == 0).alias("is_async"),
    )


def discover_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.discover_roots(_symbols(spark, sf_dir), _graph(spark, sf_dir)[1])


def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    return graph.dead_code(s, _graph(spark, sf_dir)[1], s.filter("line < 50")).select("id", "name", "file", "line")


def call_site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _read(spark, sf_dir, "orders").select(F.concat(F.lit("fN"), (F.col("o_orderkey") % 500).cast("string")).alias("name"))
    return graph.call_site_counts(refs, _symbols(spark, sf_dir))


def floor_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.floor_percentile(_read(spark, sf_dir, "events"), "value", 0.9)


def _externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cats = F.array(*[F.lit(c) for c in ("db", "network", "io", "cache", "queue", "log")])
    tiers = F.array(*[F.lit(c) for c in ("imported_module", "receiver_pattern", "method_signature")])
    return _read(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("src"), F.concat(F.when(k % 5 == 0, "C").otherwise("c"), (k % 9).cast("string")).alias("name"), F.get(cats, (k % 6).cast("int")).alias("category"),
        F.get(tiers, (k % 3).cast("int")).alias("tier"), (k % 700).cast("int").alias("line"), (k % 4 == 0).alias("in_loop"), (k % 3 == 0).alias("in_await"),
    )


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    k = F.col("id").cast("bigint")
    metrics = s.select("id", (k % 1000).cast("double").alias("rank"), (k % 25).alias("call_sites"), (k % 37 == 0).alias("is_recursive"))
    return fd.detect(s, _externals(spark, sf_dir), metrics)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("id", "kind", "severity", "effort", "confidence", "line", F.array_join("evidence", ",").alias("evidence"))


def findings_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.counts_by(_findings(spark, sf_dir), "category")


def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _findings(spark, sf_dir).join(_symbols(spark, sf_dir).select("id", "file"), "id")
    return fd.top_findings(rows).select("id", "kind", "severity", "file", "line")


def refactor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.refactor_candidates(_findings(spark, sf_dir), _symbols(spark, sf_dir)).select("id", "findings", F.array_join("kinds", ",").alias("kinds"), "worst_severity", "max_effort")


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, (v, e) = _symbols(spark, sf_dir), _graph(spark, sf_dir)
    e = materialize(e, "edges")
    hubs = graph.top_by(graph.fan_in_out(v, e), "fan_out", ["id"], TREE_HUBS).select("id")
    roots = materialize(graph.discover_roots(s, e, TREE_ROOTS).select("id").union(hubs).distinct(), "roots")
    return graph.expand_trees(roots, e, shares=True)


def call_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of the roots of largest reach and of the symbols that call the most others; in a dense graph each is as large as the graph."""
    return _trees(spark, sf_dir).select("root", "parent_ord", "node_ord", "id", "depth", "truncated", "subtree_size", "percent_total", "percent_parent")


# Statements of one kind each, by the remainder of the part's key.
_STATEMENTS = [
    "SELECT * FROM part_{k}",
    "DELETE FROM part_{k}",
    "UPDATE part_{k} SET a = 1",
    "INSERT INTO part_{k} VALUES (1, 2)",
    "SELECT a FROM part_{k} WHERE b LIKE '%x'",
    "SELECT a FROM part_{k} ORDER BY random()",
    "SELECT a FROM part_{k} WHERE b = 1 OR b = 2 OR b = 3",
    "SELECT a FROM part_{k} WHERE lower(b) = 'x'",
    "SELECT a FROM part_{k}, other",
    "SELECT a FROM part_{k} WHERE b NOT IN (SELECT c FROM d)",
    "SELECT a FROM part_{k} UNION SELECT b FROM c",
    "SELECT DISTINCT a FROM part_{k}",
    "SELECT a FROM part_{k} ORDER BY a LIMIT 5 OFFSET 4000",
    "SELECT row_number() OVER (ORDER BY a) FROM part_{k}",
    "SELECT (SELECT max(x) FROM y) FROM part_{k}",
    "SELECT a FROM part_{k} GROUP BY a HAVING a > 1",
    "SELECT a, count(*) FROM part_{k}",
    "SELECT a, count(*) FROM part_{k} GROUP BY 1",
    "SELECT a FROM part_{k} ORDER BY 1",
    "SELECT a FROM part_{k} WHERE b NOT IN (1, NULL)",
    "SELECT a FROM part_{k} WHERE b ->> 'x' = '1'",
    "CREATE INDEX i ON part_{k} (a)",
    "DROP TABLE part_{k}",
    "ALTER TABLE part_{k} DROP COLUMN a",
    "ALTER TABLE part_{k} ALTER COLUMN a TYPE bigint",
    "ALTER TABLE part_{k} ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES b (c)",
    "ALTER TABLE part_{k} ADD COLUMN a int NOT NULL",
    "SELECT a FROM part_{k} WHERE b = 1",
    "not a statement {k}",
    "SELECT a FROM part_{k} a JOIN b ON a.x = b.x JOIN c ON 1 = 1 JOIN d ON 1 = 1 JOIN e ON 1 = 1 JOIN f ON 1 = 1",
    "SELECT a FROM part_{k} WHERE x = (SELECT 1 FROM u WHERE y = (SELECT 1 FROM v WHERE z = (SELECT 1 FROM w WHERE q IN (SELECT 1 FROM p))))",
    "SELECT a FROM part_{k} WHERE " + " OR ".join(f"c{i} = 1" for i in range(7)),
    "SELECT a FROM part_{k} WHERE b IN (" + ", ".join(map(str, range(100))) + ")",
]


def sql_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    template = F.get(F.array(*[F.lit(s) for s in _STATEMENTS]), (k % len(_STATEMENTS)).cast("int"))
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.replace(template, F.lit("{k}"), k.cast("string")).alias("sql"))
    got = sqlrules.apply_rules(sqlrules.statement_features(rows))
    return got.select("p_partkey", "rule_id", F.col("finding_kind"), "severity", "effort", "confidence")


_CODE = """from django.db import models
def view_{k}(ids):
    rows = Part.objects.filter(size={k})
    for row in rows:
        row.save()
        Log.objects.create(part=row)
    return len(rows)
"""


QUERIES = {
    f.__name__: f
    for f in (
        function_rollup, statistics_cards, call_tree, callers_callees, focus_totals, frame_filter, hotspots, sample_conservation, leaf_exclude, system_frames, node_ids, window_metadata, event_violations, log_metadata,
        window_counts, trace_bundle, window_backfill, latest_per_key, previous_baseline, status_pivot, three_level_totals, upsert, language_share, report_diff, set_diff, interval_containment, fuzzy_join, fan_in_out, pagerank,
        reach_counts, strong_components, discover_roots, dead_code, call_site_counts, floor_percentile, findings, findings_by_category, top_findings, refactor_candidates, call_trees, sql_lint,
    )
}
