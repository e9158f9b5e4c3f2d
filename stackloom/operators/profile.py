"""Aggregations of stack samples: function rollup, call tree, neighbours, hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stackloom.functions.predicates import contains_any
from stackloom.functions.scalar import event_time_us, node_id
from stackloom.plans import schemas


def stack_samples(events: DataFrame, keep: list[str] | None = None, frame: list[str] | None = None) -> DataFrame:
    """One row a stack sample: frames (leaf first), weight_us, ticks, cpu and the columns of ``keep``.

    Traces and profile samples need a positive period and count and at least one
    frame; a call needs a positive duration and a name and becomes a stack of one
    frame. Their weight in microseconds is cut to an integer per sample, before
    anything is added up. Everything else is left out. The product of count and
    period saturates. ``frame`` names the fields of the frames, if the events were
    read with some of them only.
    """
    keep = keep or []
    fields = {"name": F.col("qualname"), "file": F.col("file"), "line": F.col("line"), "qualified_name": F.col("qualname"), "module": F.lit(None).cast("string"), "is_system": F.lit(None).cast("boolean")}
    one = F.struct(*[fields[f].alias(f) for f in frame or schemas.FRAME_FIELDS])
    stack = lambda n, f: F.struct(n.alias("n"), f.alias("frames"))
    kinds = (
        F.when(F.col("type").isin(schemas.TRACE_TYPES), F.array(stack(F.col("count"), F.col("frames"))))
        .when(F.col("type").isin(schemas.PROFILE_TYPES), F.transform("samples", lambda s: F.struct(s["count"].alias("n"), s["frames"].alias("frames"))))
        .when((F.col("type") == schemas.CALL_TYPE) & (F.col("duration_ns") > 0) & (F.col("qualname") != ""), F.array(stack(F.lit(1).cast("bigint"), F.array(one))))
    )
    rows = events.withColumn("__s", F.explode(kinds)).filter("__s.n > 0 AND size(__s.frames) > 0")
    call = F.col("type") == schemas.CALL_TYPE
    rows = rows.filter(call | (F.col("period_ns") > 0))
    us = F.when(call, F.expr("duration_ns div 1000")).otherwise(F.expr("coalesce(try_multiply(__s.n, period_ns), 9223372036854775807) div 1000"))
    return rows.select(*keep, us.alias("weight_us"), F.col("__s.n").alias("ticks"), "cpu", F.col("__s.frames").alias("frames"))


def function_rollup(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per frame name: self and inclusive time, ticks, mean cpu, first file and line.

    Inclusive time counts once a sample however often the name recurs in it; self
    time, ticks and cpu come from the leaf. File and line are the smallest
    non-null ones (any order of arrival gives the same).
    """
    by = by or []
    # one pass: an array of (name, is leaf) without repeats per sample, so no sample id and no second grouping is needed
    leaf = F.get(F.col("frames"), F.lit(0))
    first = F.expr(
        "transform(array_distinct(frames.name), n -> named_struct('name', n, 'place', "
        "get(filter(frames, f -> f.name <=> n AND f.file IS NOT NULL), 0)))"
    )
    rows = samples.select(*by, "weight_us", "ticks", "cpu", leaf["name"].alias("leaf"), F.explode(first).alias("f"))
    is_leaf = F.col("f.name").eqNullSafe(F.col("leaf"))
    out = rows.groupBy(*by, F.col("f.name").alias("qualname")).agg(
        F.coalesce(F.sum(F.when(is_leaf, F.col("ticks"))), F.lit(0)).alias("ncalls"),
        F.coalesce(F.sum(F.when(is_leaf, F.col("weight_us"))), F.lit(0)).alias("total_us"),
        F.sum("weight_us").alias("cumulative_us"),
        F.avg(F.when(is_leaf, F.col("cpu"))).alias("cpu_avg"),
        F.min("f.place.file").alias("file"),
        F.min(F.when(F.col("f.place.file").isNotNull(), F.struct(F.col("f.place.file"), F.col("f.place.line"))))["line"].alias("line"),
    )
    return out.withColumn("percall_us", F.when(F.col("ncalls") > 0, F.col("total_us") / F.col("ncalls")).otherwise(0.0))


def ordered_functions(rollup: DataFrame) -> DataFrame:
    return rollup.orderBy(F.desc("cumulative_us"), F.desc("ncalls"), "qualname")


def statistics_cards(rollup: DataFrame, errors: DataFrame | None = None, top: int = 5) -> DataFrame:
    """card, place, qualname, value: the leading functions by inclusive time, self time, ticks and errors."""
    if errors is not None:
        rollup = rollup.join(errors, "qualname", "left")
    cards = {"cumulative": "cumulative_us", "self": "total_us", "calls": "ncalls", **({"errors": "errors"} if errors is not None else {})}
    parts = []
    for card, column in cards.items():
        head = rollup.orderBy(F.desc_nulls_last(column), "qualname").limit(top)
        if card == "errors":
            head = head.filter(F.col(column) > 0)
        parts.append(head.select(F.lit(card).alias("card"), F.row_number().over(W.orderBy(F.desc(column), "qualname")).alias("place"), "qualname", F.col(column).cast("bigint").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def call_tree(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a node of the prefix tree over root-first stacks.

    path (names from the root), parent_path, name, depth (1 at the top), value
    and self_value in microseconds, ncalls (samples that end here) and the
    smallest non-null file, line, qualname, module and is_system. Recursion is
    not merged: every depth is a node. Equal stacks are added up before their
    prefixes are made.
    """
    by = by or []
    stacks = samples.groupBy(*by, "frames").agg(F.sum("weight_us").alias("w"), F.count("*").alias("n"))
    node = F.expr(
        "transform(sequence(1, size(frames)), i -> named_struct('path', slice(reverse(frames.name), 1, i), 'f', element_at(reverse(frames), i), 'last', i = size(frames)))"
    )
    rows = stacks.select(*by, "w", "n", F.explode(node).alias("x"))
    last = F.col("x.last")
    text = lambda c: F.min(F.when(F.col(c) != "", F.col(c)))
    out = rows.groupBy(*by, F.col("x.path").alias("path")).agg(
        F.sum("w").alias("value"),
        F.coalesce(F.sum(F.when(last, F.col("w"))), F.lit(0)).alias("self_value"),
        F.coalesce(F.sum(F.when(last, F.col("n"))), F.lit(0)).alias("ncalls"),
        F.min("x.f.file").alias("file"),
        F.min("x.f.line").alias("line"),
        text("x.f.qualified_name").alias("qualname"),
        text("x.f.module").alias("module"),
        F.min("x.f.is_system").alias("is_system"),
    )
    out = out.withColumns({"name": F.element_at("path", -1), "depth": F.size("path"), "parent_path": F.expr("slice(path, 1, size(path) - 1)")})
    return out.withColumn("node_id", node_id(F.col("file"), F.col("name"), F.col("qualname")))


def focus_totals(tree: DataFrame, name: str) -> DataFrame:
    return tree.filter(F.col("name") == name).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ncalls", "value", "self_value")], F.count("*").alias("occurrences"))


def neighbours(tree: DataFrame, name: str) -> DataFrame:
    """side ('caller' | 'callee'), name, occurrences, value: the nodes directly above and below each occurrence, in one pass; top-level occurrences have no caller."""
    above = F.element_at("parent_path", -1)
    caller = F.when(F.col("name") == name, F.struct(F.lit("caller").alias("side"), above.alias("name")))
    callee = F.when(above == name, F.struct(F.lit("callee").alias("side"), F.col("name").alias("name")))
    rows = tree.filter("depth > 1").select("value", F.explode(F.array_compact(F.array(caller, callee))).alias("x"))
    return rows.groupBy("x.side", "x.name").agg(F.count("*").alias("occurrences"), F.sum("value").alias("value"))


def callers(tree: DataFrame, name: str) -> DataFrame:
    """name, occurrences, value of the callers, largest first."""
    return neighbours(tree, name).filter("side = 'caller'").drop("side").orderBy(F.desc("value"), "name")


def callees(tree: DataFrame, name: str) -> DataFrame:
    return neighbours(tree, name).filter("side = 'callee'").drop("side").orderBy(F.desc("value"), "name")


def tree_children(tree: DataFrame, path: list[str]) -> DataFrame:
    """The nodes directly below a path, the heaviest first, then by name."""
    here = F.array(*[F.lit(p) for p in path]).cast("array<string>")
    return tree.filter((F.col("depth") == len(path) + 1) & (F.col("parent_path") == here)).orderBy(F.desc("value"), "name")


def best_match(tree: DataFrame, predicate: Column) -> DataFrame:
    """The path of the heaviest node that meets a predicate; ties go to the smaller path."""
    return tree.filter(predicate).orderBy(F.desc("value"), "path").limit(1).select("path", "value")


# Words in a lower-cased frame name that tell a hotspot's category; the first that fits counts.
HOTSPOT_WORDS = {
    "database": ["psycopg", "sqlalchemy", "pymongo", "redis", "asyncpg", "mysql", "sqlite", "execute_query", "select * from", "jdbc", "hibernate"],
    "network": ["aiohttp", "httpx", "requests.api", "urllib", "socket.recv", "socket.send", "tcp_", "okhttp", "reqwest"],
    "lock": ["lock", "mutex", "rwlock", "synchron", "semaphore", "condvar"],
    "gc": ["gc.", "garbage", "mark_sweep", "g1_", "young_gen", "old_gen"],
    "serde": ["json", "serde", "pickle", "msgpack", "protobuf", "marshal"],
    "filesystem": ["read", "write", "fsync", "open(", "fs::", "fileio"],
    "cpu": ["loop", "compute", "encode", "decode", "hash", "regex"],
}
# Least self and total percentages of a severity.
HOTSPOT_LADDER = [("critical", 20.0, 60.0), ("high", 10.0, 35.0), ("medium", 3.0, 15.0)]


def hotspot_category(frame: Column) -> Column:
    out = F.lit("unknown")
    for category, words in reversed(HOTSPOT_WORDS.items()):
        out = F.when(contains_any(F.lower(frame), words), category).otherwise(out)
    return out


def hotspot_severity(self_pct: Column, total_pct: Column) -> Column:
    out = F.lit("low")
    for severity, own, whole in reversed(HOTSPOT_LADDER):
        out = F.when((self_pct >= own) | (total_pct >= whole), severity).otherwise(out)
    return out


def hotspots(stacks: DataFrame, top: int = 10) -> DataFrame:
    """The frames with most self samples of folded stacks (stack, count): rank, function, category, severity, percentages, example.

    Total samples count a frame once a stack. Ties are ranked by name; the
    example is the smallest stack that ends in the frame. The share is taken of
    all samples.
    """
    names = F.split("stack", ";", -1)
    # all samples are one more group of the same aggregation, so that the input is read once
    parts = F.concat(F.transform(F.array_distinct(names), lambda n: F.struct(F.lit(False).alias("all"), n.alias("function"))), F.array(F.struct(F.lit(True).alias("all"), F.lit("").alias("function"))))
    rows = stacks.select("stack", "count", F.element_at(names, -1).alias("leaf"), F.explode(parts).alias("p")).select("stack", "count", "leaf", "p.*")
    own = F.col("function") == F.col("leaf")
    frames = rows.groupBy("all", "function").agg(
        F.coalesce(F.sum(F.when(own, F.col("count"))), F.lit(0)).alias("samples"), F.sum("count").alias("total"), F.min(F.when(own, F.col("stack"))).alias("example_stack")
    )
    head = frames.orderBy(F.desc("all"), F.desc("samples"), "function").limit(top + 1)
    head = head.withColumn("whole", F.max(F.when(F.col("all"), F.col("total"))).over(W.partitionBy())).filter("NOT all AND whole > 0")  # top + 1 rows
    head = head.withColumns({"self_pct": F.col("samples") / F.col("whole") * 100, "total_pct": F.col("total") / F.col("whole") * 100})
    return head.select(
        F.row_number().over(W.orderBy(F.desc("samples"), "function")).alias("rank"), "function", hotspot_category(F.col("function")).alias("category"),
        hotspot_severity(F.col("self_pct"), F.col("total_pct")).alias("severity"), "self_pct", "total_pct", "samples", "example_stack",
    )


def window_metadata(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of events, first and last time, duration, distinct services and pods (sorted, non-empty)."""
    by = by or []
    at = event_time_us(F.col("time"))
    distinct = lambda c: F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    out = events.withColumn("__t", at).groupBy(*by).agg(
        F.count("*").alias("events"), F.min("__t").alias("from_us"), F.max("__t").alias("to_us"), distinct("service").alias("services"), distinct("pod").alias("pods")
    )
    return out.withColumn("duration_us", F.coalesce(F.col("to_us") - F.col("from_us"), F.lit(0)))


def window_counts(events: DataFrame, time: str, width: str = "10 seconds", by: list[str] | None = None) -> DataFrame:
    """Events in tumbling windows: window_start, columns of ``by``, n."""
    return events.groupBy(F.window(time, width)["start"].alias("window_start"), *(by or [])).agg(F.count("*").alias("n"))


def backfill_windows(counts: DataFrame, expected: int, by: list[str] | None = None) -> DataFrame:
    """Adds to each window whose ticks fall short of ``expected`` a row named ``unknown`` with the missing ones.

    ``counts`` has window_start, columns of ``by``, name, n.
    """
    by = by or []
    short = counts.groupBy("window_start", *by).agg((F.lit(expected) - F.sum("n")).alias("n")).filter("n > 0").withColumn("name", F.lit("unknown"))
    return counts.unionByName(short.select(*counts.columns))


def bundle(traces: DataFrame, time: str, width: str = "10 seconds") -> DataFrame:
    """Traces of a window as one profile: window_start, type, samples (count, value_ns, frames), in a fixed order.

    Equal stacks are counted first; a bundle then holds one element a distinct
    stack of its window.
    """
    each = traces.groupBy(F.window(time, width)["start"].alias("window_start"), "type", "period_ns", "frames").agg(F.sum("count").alias("n"))
    sample = F.struct(F.col("n").alias("count"), (F.col("n") * F.col("period_ns")).alias("value_ns"), F.col("frames").alias("frames"))
    return each.groupBy("window_start", "type", "period_ns").agg(F.sort_array(F.collect_list(sample), False).alias("samples"))


def to_static_report(tree: DataFrame) -> DataFrame:
    """A sampled tree in the layout of static reports: times in nanoseconds, kind and owner from the qualified name."""
    from stackloom.functions.scalar import parent_class, symbol_kind

    q = F.col("qualname")
    return tree.select(
        F.col("node_id").alias("id"), "name", symbol_kind(q).alias("kind"), parent_class(q).alias("parent_class"), "file", "line", (F.col("depth") - 1).alias("depth"),
        (F.col("value") * 1000).alias("value_ns"), (F.col("self_value") * 1000).alias("self_ns"), "ncalls", F.array_join("path", ";").alias("path"),
    )


def report_summary(tree: DataFrame) -> DataFrame:
    return tree.agg(F.countDistinct(F.when(F.col("file") != "", F.col("file"))).alias("files"), F.count("*").alias("symbols"))
