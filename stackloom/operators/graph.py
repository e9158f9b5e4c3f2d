"""Call graphs as (vertices, edges) DataFrames: resolution, ranks, components, reach, trees."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stackloom.functions import predicates as P
from stackloom.operators.joins import containing, first_per_key
from stackloom.operators.skew import HEAVY_SHARE
from stackloom.session import materialize, release

ALPHA, TOLERANCE, MAX_ITERATIONS = 0.85, 1e-6, 100
MAX_DEPTH, MAX_ROOTS, MIN_REACH = 12, 200, 2


def enclosing_symbols(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with ``in_symbol``: the name of the narrowest symbol around them; ties go to the first definition."""
    sides = symbols.select("file", "name", "byte_start", "byte_end", "def_id")
    got = containing(references.drop("in_symbol"), sides, ["file"], "byte_offset", "byte_start", "byte_end", "ref_ord", ["def_id"])
    return got.withColumn("in_symbol", F.col("r_name")).drop(*[f"r_{c}" for c in sides.columns])


def parent_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols with ``parent``: the name of the narrowest symbol strictly around them; synthetic ones are no parents."""
    sides = symbols.filter(~P.is_synthetic(F.col("name"))).select("file", "name", "byte_start", "byte_end", "def_id")
    got = containing(symbols.drop("parent"), sides, ["file"], "byte_start", "byte_start", "byte_end", "def_id", ["def_id"], strict=True)
    return got.withColumn("parent", F.col("r_name")).drop(*[f"r_{c}" for c in sides.columns])


def symbol_id(file: Column, parent: Column, name: Column) -> Column:
    return F.concat_ws("::", file, F.coalesce(parent, F.lit("")), name)


def source_ids(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with ``src``: the id of the symbol they stand in, the first of that name whose range holds them; others are dropped."""
    s = symbols.select(F.col("file").alias("s_file"), F.col("name").alias("s_name"), F.col("id").alias("src"), "byte_start", "byte_end", "def_id", "is_async", "loop_ranges", "await_ranges")
    hit = references.join(s, (F.col("file") == F.col("s_file")) & (F.col("in_symbol") == F.col("s_name")) & F.col("byte_offset").between(F.col("byte_start"), F.col("byte_end")))
    one = first_per_key(hit, ["ref_ord"], [F.col("def_id")])
    one = one.withColumns({"in_loop": P.in_ranges(F.col("loop_ranges"), F.col("byte_offset")), "in_await": P.in_ranges(F.col("await_ranges"), F.col("byte_offset"))})
    return one.drop("s_file", "s_name", "byte_start", "byte_end", "def_id", "loop_ranges", "await_ranges")


def resolve_edges(sourced: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, dst, ord of calls to symbols of the called name: distinct, without self-recursion; ord is the first reference."""
    names = symbols.select("name", F.col("id").alias("dst")).distinct()
    once = sourced.groupBy("src", "name").agg(F.min("ref_ord").alias("ref_ord"))  # a caller repeats its calls
    return once.join(names, "name").filter("src <> dst").groupBy("src", "dst").agg(F.min("ref_ord").alias("ord"))


def external_calls(sourced: DataFrame, symbols: DataFrame, imports: DataFrame, modules: DataFrame, receivers: DataFrame, methods: DataFrame) -> DataFrame:
    """References that resolve to no other symbol, with their category and the tier of evidence; unclassified ones are dropped."""
    names = symbols.select("name", F.col("id").alias("dst")).distinct()
    outside = sourced.join(names, (sourced["name"] == names["name"]) & (sourced["src"] != names["dst"]), "left_anti")
    return classify_calls(outside, imports, modules, receivers, methods).filter("category IS NOT NULL")


def classify_modules(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports with the category of the longest catalogued module that is the path or a prefix of it at a separator.

    Every prefix of a path that ends at ``.``, ``/`` or ``::`` becomes a join key,
    so this is an equi-join and not a comparison of all pairs.
    """
    pieces = F.expr("regexp_extract_all(module_path, '([^./:]+|[.]|/|::|:)', 1)")
    cut = imports.withColumn("__p", pieces)
    prefixes = F.expr("array_union(array(module_path), transform(filter(sequence(1, greatest(size(__p), 1)), i -> i < size(__p) AND __p[i] IN ('.', '/', '::')), i -> array_join(slice(__p, 1, i), '')))")
    rows = cut.withColumn("module", F.explode(prefixes)).drop("__p")
    hit = rows.join(modules.select("module", F.col("category").alias("m_category")), "module")
    best = hit.groupBy(*imports.columns).agg(F.max_by("m_category", F.struct(F.length("module"), "m_category")).alias("category"))
    return best


def classify_calls(calls: DataFrame, imports: DataFrame, modules: DataFrame, receivers: DataFrame, methods: DataFrame) -> DataFrame:
    """Adds category and tier: by the imported module of the receiver, else by its name, else by an unambiguous method name."""
    known = classify_modules(imports, modules)
    root = F.regexp_extract("module_path", r"([^./:]+)", 1)
    # the name an import binds counts before the first part of its path
    bound = F.explode(F.array(F.struct("local_name", F.lit(False).alias("part")), F.struct(root.alias("local_name"), F.lit(True).alias("part"))))
    keys = known.select("file", "category", bound.alias("b")).groupBy("file", F.col("b.local_name").alias("receiver")).agg(F.min_by("category", F.struct("b.part", "category")).alias("by_module"))
    out = calls.join(keys, ["file", "receiver"], "left")
    out = out.join(receivers.select(F.lower("name").alias("__r"), F.col("category").alias("by_receiver")).dropDuplicates(["__r"]), F.lower("receiver") == F.col("__r"), "left")
    out = out.join(methods.select(F.col("name").alias("__m"), F.col("category").alias("by_method")).dropDuplicates(["__m"]), F.col("name") == F.col("__m"), "left")
    tier = F.when(F.col("by_module").isNotNull(), "imported_module").when(F.col("by_receiver").isNotNull(), "receiver_pattern").when(F.col("by_method").isNotNull(), "method_signature")
    return out.withColumns({"category": F.coalesce("by_module", "by_receiver", "by_method"), "tier": tier}).drop("by_module", "by_receiver", "by_method", "__r", "__m")


# Which category of several a function takes for its own; computing is none.
CATEGORY_ORDER = ["db", "network", "io", "cache", "queue", "log"]


def self_category(externals: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), F.col("category"))
    return externals.filter(order > 0).groupBy("src").agg(F.min_by("category", order).alias("category_self"))


def fan_in_out(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out from distinct edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    sums = ends.groupBy("x.id").agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))
    return vertices.select("id").join(sums, "id", "left").fillna(0, ["fan_in", "fan_out"])


def call_site_counts(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, call_sites: references by name, self-calls included, once for each definition of the id."""
    by_name = references.groupBy("name").agg(F.count("*").alias("n"))
    return symbols.select("id", "name").join(by_name, "name", "left").groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("call_sites"))


def pagerank(vertices: DataFrame, edges: DataFrame, iterations: int = MAX_ITERATIONS, tolerance: float | None = TOLERANCE, alpha: float = ALPHA) -> DataFrame:
    """id, rank: teleport (1 - alpha) / N, the mass of vertices without edges spread evenly, until the L1 change is below the tolerance.

    Each round joins the ranks with the edges and adds up by target (combined
    before the shuffle). A source with over 1/1,024 of the edges is spread: its rank
    is copied, once for each such share, and its edges go to the copies by their
    target. The round's result is written to the shared folder, so lineage stays
    short, and the one before is dropped. Only two numbers a round reach the
    driver. ``tolerance`` None runs all iterations.
    """
    ids = vertices.select("id").distinct()
    out_degree = edges.groupBy("src").agg(F.count("*").alias("deg"))
    links = materialize(edges.join(out_degree, "src").select("src", "dst", "deg"), "links")
    floor = max(1, int(links.count() * HEAVY_SHARE))
    copies = F.expr(f"cast(deg div {floor} + 1 as int)")
    links = links.withColumn("salt", F.pmod(F.xxhash64("dst"), copies).cast("int"))
    ids = materialize(ids.join(out_degree, ids["id"] == out_degree["src"], "left").select("id", "deg"), "vertices")
    n = ids.count()
    if n == 0:
        return ids.select("id", F.lit(0.0).alias("rank"))
    ranks, last = ids.withColumn("rank", F.lit(1.0 / n)), None
    lost = ids.filter("deg IS NULL").count() / n
    for _ in range(iterations):
        share = ranks.filter("deg IS NOT NULL").select(F.col("id").alias("src"), (F.col("rank") / F.col("deg")).alias("part"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
        given = links.join(share, ["src", "salt"]).groupBy("dst").agg(F.sum("part").alias("got"))
        base = (1 - alpha) / n + alpha * lost / n
        nxt = ranks.join(given, ranks["id"] == given["dst"], "left").select("id", "deg", F.col("rank").alias("old"), (F.lit(base) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"))
        nxt = materialize(nxt, "ranks")
        if last is not None:
            release(last)
        ranks, last = nxt.select("id", "deg", "rank"), nxt
        moved, lost = nxt.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("deg").isNull(), F.col("rank"))), F.lit(0.0))).first()
        if tolerance is not None and moved < tolerance:
            break
    return ranks.select("id", "rank")


def _min_labels(edges: DataFrame, labels: DataFrame, forward: bool) -> DataFrame:
    """Fixed point of: each vertex takes the smallest label among its own and those of the vertices with an edge to it."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    last = None
    while True:
        sent = edges.select(F.col(a).alias("id"), F.col(b).alias("to")).join(labels, "id").groupBy("to").agg(F.min("label").alias("got"))
        nxt = materialize(labels.join(sent, labels["id"] == sent["to"], "left").select("id", F.least("label", F.coalesce("got", "label")).alias("label"), (F.col("got") < F.col("label")).alias("moved")), "labels")
        moved = not nxt.filter("moved").isEmpty()
        if last is not None:
            release(last)
        labels, last = nxt.select("id", "label"), nxt
        if not moved:
            return labels


def _trim(left: DataFrame) -> DataFrame:
    """The edges among vertices that have edges both in and out, taken away until nothing changes."""
    while True:
        before = left.count()
        left = materialize(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "edges")
        if left.count() == before:
            return left


def _flooded(edges: DataFrame, seed: DataFrame, forward: bool, max_depth: int | None = None) -> DataFrame:
    """id of everything that a set of vertices reaches (or is reached from) within so many steps: one shuffle a step, the front only."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    found = front = materialize(seed.select("id").distinct(), "flood")
    steps = 0
    while max_depth is None or steps < max_depth:
        steps += 1
        nxt = front.join(edges, front["id"] == edges[a]).select(F.col(b).alias("id")).distinct().join(found, "id", "left_anti")
        front = materialize(nxt, "flood")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of the vertices in strongly connected components of more than one vertex.

    Vertices without an edge in or out are trimmed. Then the vertex of most edges
    is taken for a pivot: what it reaches and is reached from is its component, by
    two floods whose steps are as many as the longest shortest path from it; in
    most graphs that is the one large component. The rest is coloured: each vertex
    takes the smallest id that reaches it; those from which their colour's own
    vertex is reached form its component; what is left goes another round.
    """
    left = _trim(materialize(edges.filter("src <> dst").select("src", "dst").distinct(), "edges"))
    found: list[DataFrame] = []
    if not left.isEmpty():
        ends = left.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(left.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        pivot = ends.groupBy("id").agg((F.sum("o") * F.sum("i")).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")
        pivot = materialize(pivot, "pivot")
        both = materialize(_flooded(left, pivot, True).join(_flooded(left, pivot, False), "id"), "component")
        members = materialize(both.select("id").withColumn("component", F.lit(both.agg(F.min("id")).first()[0])), "components")
        found.append(members)
        left = _without(left, members)
    while True:
        left = _trim(left)
        if left.isEmpty():
            break
        ids = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()
        colour = _min_labels(left, ids.withColumn("label", F.col("id")), True)
        inner = left.join(colour.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").filter("a = b").select("src", "dst")
        inner = materialize(inner, "edges")
        seeds = colour.withColumn("label", F.when(F.col("id") == F.col("label"), F.lit("0")).otherwise(F.lit("1")))
        reach = _min_labels(inner, seeds, False).filter("label = '0'").select("id")
        members = materialize(colour.join(reach, "id").select("id", F.col("label").alias("component")), "components")
        found.append(members)
        left = materialize(_without(left, members), "edges")
    if not found:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    big = out.groupBy("component").count().filter("count > 1").select("component")
    return out.join(big, "component").select("id", "component")


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges that touch none of some vertices."""
    return edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")


def reachable(sources: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, id, hops of everything each source (column id) reaches, itself included.

    A round extends only the pairs found last and drops those known already, so
    cycles end. The result has as many rows as the reaches add up to.
    """
    step = materialize(edges.select("src", "dst").distinct(), "steps")
    found = front = materialize(sources.select(F.col("id").alias("root"), "id", F.lit(0).alias("hops")).distinct(), "reach")
    hops = 0
    while max_depth is None or hops < max_depth:
        hops += 1
        nxt = front.join(step, front["id"] == step["src"]).select("root", F.col("dst").alias("id")).distinct().join(found, ["root", "id"], "left_anti")
        front = materialize(nxt.withColumn("hops", F.lit(hops)), "reach")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def reach_counts(sources: DataFrame, edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """id, reach: how many vertices each source reaches, itself included.

    Strongly connected components are counted as one vertex of their size. The
    largest of them, the hub, with all it reaches is flooded once: what reaches the
    hub reaches all of that, so for such sources only the vertices outside are
    counted source by source, and for the others those that they reach without it.
    ``components`` are the edges' ``strong_components`` where these are known already.
    """
    step = materialize(edges.filter("src <> dst").select("src", "dst").distinct(), "steps")
    parts = materialize(strong_components(step), "components") if components is None else components
    sizes = materialize(parts.groupBy(F.col("component").alias("id")).agg(F.count("*").alias("size")), "sizes")
    label = lambda df, c: df.join(parts.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part")), c, "left").withColumn(f"{c}_part", F.coalesce(f"{c}_part", c))
    between = materialize(label(label(step, "src"), "dst").select(F.col("src_part").alias("src"), F.col("dst_part").alias("dst")).filter("src <> dst").distinct(), "between")
    starts = materialize(label(sources.select("id").distinct(), "id"), "starts")
    roots = starts.select(F.col("id_part").alias("id")).distinct()
    one = F.coalesce("size", F.lit(1))
    hub = materialize(sizes.orderBy(F.desc("size"), "id").limit(1).select("id"), "hub")
    below = _flooded(between, hub, True)
    above = _flooded(between, hub, False)
    under = below.join(sizes, "id", "left").agg(F.coalesce(F.sum(one), F.lit(0))).first()[0]
    outside = materialize(_without(between, below), "between")
    through = reachable(roots.join(above, "id", "left_semi").join(below, "id", "left_anti"), outside).join(sizes, "id", "left").groupBy("root").agg((F.sum(one) + under).alias("reach"))
    itself = roots.join(hub, "id", "left_semi").select(F.col("id").alias("root"), F.lit(under).cast("bigint").alias("reach"))
    past = reachable(roots.join(above, "id", "left_anti"), between).join(sizes, "id", "left").groupBy("root").agg(F.sum(one).alias("reach"))
    sums = through.unionByName(itself).unionByName(past).withColumnRenamed("root", "id_part")
    return starts.join(sums, "id_part").select("id", "reach")


def discover_roots(symbols: DataFrame, edges: DataFrame, limit: int = MAX_ROOTS, min_reach: int = MIN_REACH, skip_tests: bool = True, components: DataFrame | None = None) -> DataFrame:
    """id, name, reach of callable symbols that no real symbol calls; module-level code is no caller. Ties are ordered by name, then id."""
    synthetic = symbols.filter(P.is_synthetic(F.col("name"))).select(F.col("id").alias("src")).distinct()
    called = edges.join(synthetic, "src", "left_anti").select(F.col("dst").alias("id")).distinct()
    keep = (F.lower("kind") != "class") & ~P.is_accessor(F.col("name")) & ~P.is_private(F.col("name"))
    if skip_tests:
        keep = keep & ~P.is_test_path(F.col("file"))
    roots = symbols.filter(keep).join(called, "id", "left_anti").select("id", "name").dropDuplicates(["id"])
    return roots.join(reach_counts(roots, edges, components), "id").filter(F.col("reach") >= min_reach).orderBy(F.desc("reach"), "name", "id").limit(limit)


def dead_code(symbols: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Callable symbols without callers that are no entry, by file and line."""
    called = edges.select(F.col("dst").alias("id")).distinct()
    rows = symbols.filter((F.lower("kind") != "class") & ~P.is_synthetic(F.col("name")))
    return rows.join(called, "id", "left_anti").join(entries.select("id").distinct(), "id", "left_anti").orderBy("file", "line")


def recursive_symbols(edges: DataFrame, sourced: DataFrame, symbols: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """id of the symbols that call themselves: in a component of several, or by their own name where they stand."""
    own = sourced.join(symbols.select(F.col("id").alias("src"), "name").distinct(), ["src", "name"], "left_semi").select(F.col("src").alias("id"))
    return (strong_components(edges) if components is None else components).select("id").unionByName(own).distinct()


def find_entry(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of exactly that name, else those whose name contains it."""
    exact = symbols.filter(F.col("name") == name)
    return exact if not exact.isEmpty() else symbols.filter(F.contains("name", F.lit(name)))


def _numbered(ids: DataFrame) -> DataFrame:
    """id, no: places from 0 on in the order of the ids, which are distinct and not null; sorted by ranges, never in one task."""
    ranges = materialize(ids.select("id").repartitionByRange("id").sortWithinPartitions("id").withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}), "ordered")
    parts = ranges.groupBy("__p").agg(F.min("__i").alias("__first"), F.count("*").alias("__n"))  # a row a partition
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return ranges.join(F.broadcast(parts), "__p").select("id", (F.col("__before") + F.col("__i") - F.col("__first")).cast("int").alias("no"))


#: Rows of a tree that leave a task at once.
TREE_BATCH = 50_000


def expand_trees(roots: DataFrame, edges: DataFrame, accessors: DataFrame | None = None, max_depth: int = MAX_DEPTH, shares: bool = False) -> DataFrame:
    """Call trees in preorder: root, node_ord, parent_ord, id, depth, truncated ('cycle', 'max-depth' or null), subtree_size.

    A depth-first walk over callees in the order of their first reference. What was
    visited anywhere in the tree becomes a leaf stub 'cycle' when met again. The
    walk depends on its own history, so a tree is one unit of work. ``accessors``
    (ids) are skipped; ``shares`` adds what ``tree_percentages`` does.

    What any root reaches within ``max_depth`` is found by one flood from all of
    them, not root by root. Its vertices are numbered, and each of as many tasks as
    there are cores gets that part of the graph once, four bytes a call, and walks
    its share of the roots over it, one after the other.
    """
    if accessors is not None:
        edges = edges.join(accessors.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti")
    steps = materialize(edges.select("src", "dst", "ord"), "steps")
    starts = materialize(roots.select("id").filter("id IS NOT NULL").distinct(), "starts")
    groups = max(1, min(starts.count(), roots.sparkSession.sparkContext.defaultParallelism))
    near = materialize(_numbered(_flooded(steps, starts, True, max_depth)), "near")
    end = lambda c: near.select(F.col("id").alias(c), F.col("no").alias(f"{c}_no"))
    calls = steps.join(end("src"), "src").join(end("dst"), "dst").groupBy(F.col("src_no").alias("no"))
    calls = calls.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("ord", F.lit(2**63 - 1)).alias("ord"), "dst_no"))), lambda x: x["dst_no"]).alias("targets"))
    nodes = near.join(calls, "no", "left").join(_numbered(starts).withColumnRenamed("no", "place"), "id", "left")
    copies = nodes.withColumn("__g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("__g", "no", "id", F.coalesce(F.col("place") % groups == F.col("__g"), F.lit(False)).alias("mine"), "targets")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        names, lists = table["id"].cast("large_string").combine_chunks(), table["targets"]
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        start = memoryview(np.concatenate([[0], np.cumsum(length, dtype="int64")]))
        targets = memoryview(np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks]).astype("int32"))
        mine = np.flatnonzero(table["mine"].to_numpy())
        reasons = pa.array(["cycle", "max-depth"])
        for root in mine.tolist():
            name = names[root].as_py()
            at, depth, parent, cut, size = array("i"), array("i"), array("q"), array("b"), array("q")
            seen = bytearray(len(length))
            path = [(iter([root]), -1)]  # callees still to be walked, and the node that calls them
            while path:
                rest, above = path[-1]
                for x in rest:
                    number, level = len(at), len(path) - 1
                    again = seen[x]
                    seen[x] = 1
                    at.append(x)
                    depth.append(level)
                    parent.append(above)
                    size.append(1)
                    cut.append(0 if again else 1 if level >= max_depth else -1)
                    if cut[number] < 0:
                        path.append((iter(targets[start[x] : start[x + 1]]), number))
                        break
                else:
                    path.pop()
                    if above >= 0:
                        size[above] = len(at) - above
            sizes, parents, cuts, whole = np.frombuffer(size, "int64"), np.frombuffer(parent, "int64"), np.frombuffer(cut, "int8"), len(at)
            for i in range(0, whole, TREE_BATCH):
                j = min(i + TREE_BATCH, whole)
                own, up = sizes[i:j], parents[i:j]
                columns = [
                    pa.repeat(name, j - i), pa.array(np.arange(i, j)), pa.array(up, mask=up < 0), names.take(pa.array(np.frombuffer(at, "int32")[i:j])).cast("string"), pa.array(np.frombuffer(depth, "int32")[i:j]),
                    reasons.take(pa.array(cuts[i:j], mask=cuts[i:j] < 0)), pa.array(own), pa.array(own / whole * 100), pa.array(own / np.where(up < 0, whole, sizes[up]) * 100),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["root", "node_ord", "parent_ord", "id", "depth", "truncated", "subtree_size", "percent_total", "percent_parent"])

    # a partition holds one group's copy, by number
    trees = copies.repartitionById(groups, F.col("__g")).sortWithinPartitions("no").drop("__g", "no")
    trees = trees.mapInArrow(walk, "root string, node_ord bigint, parent_ord bigint, id string, depth int, truncated string, subtree_size bigint, percent_total double, percent_parent double")
    return trees if shares else trees.drop("percent_total", "percent_parent")


def tree_percentages(trees: DataFrame) -> DataFrame:
    """Adds percent_total and percent_parent of subtree sizes."""
    size = trees.select("root", F.col("node_ord").alias("parent_ord"), F.col("subtree_size").alias("p_size"))
    whole = trees.filter("node_ord = 0").select("root", F.col("subtree_size").alias("t_size"))
    got = trees.join(size, ["root", "parent_ord"], "left").join(whole, "root")
    return got.withColumns({"percent_total": F.col("subtree_size") / F.col("t_size") * 100, "percent_parent": F.col("subtree_size") / F.coalesce("p_size", "t_size") * 100}).drop("p_size", "t_size")


def categories_reached(trees: DataFrame, externals: DataFrame) -> DataFrame:
    """root, node_ord, category, n: what a node and everything below it calls outside; its own category counts once more.

    Stubs count themselves only. Counts of a node are added to each ancestor in its
    tree, of which there are at most the tree's depth.
    """
    own = self_category(externals).select(F.col("src").alias("id"), F.col("category_self").alias("category"))
    each = externals.select(F.col("src").alias("id"), "category").unionByName(own).groupBy("id", "category").agg(F.count("*").alias("n"))
    rows = trees.select("root", "node_ord", "parent_ord", "id").join(each, "id").select("root", F.col("node_ord").alias("at"), "category", "n")
    up = trees.select("root", F.col("node_ord").alias("at"), "parent_ord")
    out, cur = rows, rows
    for _ in range((trees.agg(F.max("depth")).first()[0] or 0)):
        cur = cur.join(up, ["root", "at"]).filter("parent_ord IS NOT NULL").select("root", F.col("parent_ord").alias("at"), "category", "n").groupBy("root", "at", "category").agg(F.sum("n").alias("n"))
        out = out.unionByName(cur)
    return out.groupBy("root", F.col("at").alias("node_ord"), "category").agg(F.sum("n").alias("n"))


def hot_paths(trees: DataFrame, externals: DataFrame, names: DataFrame, top: int = 10) -> DataFrame:
    """The deepest chains from a root to a node with outside calls: root, path, depth, category."""
    cats = externals.select(F.col("src").alias("id"), "category").distinct()
    cur = trees.join(cats, "id").join(names, "id").select("root", "parent_ord", "depth", "category", F.array("name").alias("path"))
    up = trees.join(names, "id").select("root", F.col("node_ord").alias("parent_ord"), F.col("parent_ord").alias("next"), "name")
    for _ in range((trees.agg(F.max("depth")).first()[0] or 0)):
        cur = cur.join(up, ["root", "parent_ord"], "left").select("root", F.col("next").alias("parent_ord"), "depth", "category", F.when(F.col("name").isNotNull(), F.concat(F.array("name"), "path")).otherwise(F.col("path")).alias("path"))
    return cur.select("root", "path", "depth", "category").distinct().orderBy(F.desc("depth"), "category", "path").limit(top)


def render_tree(trees: DataFrame, names: DataFrame) -> DataFrame:
    """root, node_ord, line: one indented line a node, in preorder."""
    return trees.join(names, "id").select("root", "node_ord", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("name"), F.when(F.col("truncated").isNotNull(), F.concat(F.lit(" ["), "truncated", F.lit("]"))).otherwise("")).alias("line"))


def top_by(df: DataFrame, column: str, order: list[str], top: int = 10, positive: bool = True) -> DataFrame:
    """The leading rows by one column, ties by the others (callers, callees, ranks)."""
    return (df.filter(F.col(column) > 0) if positive else df).orderBy(F.desc(column), *order).limit(top)


def floor_percentile(df: DataFrame, value: str, q: float = 0.9) -> DataFrame:
    """The value at zero-based position min(floor(q n), n - 1) of the sorted values; nulls are left out.

    Found from counts of distinct values, so nothing is sorted in one task beyond
    these.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    ranges = counts.repartitionByRange(value).sortWithinPartitions(value).withColumn("__p", F.spark_partition_id())
    ranges = materialize(ranges, "sorted")
    parts = ranges.groupBy("__p").agg(F.sum("n").alias("s"))  # a row a partition
    upto = W.orderBy("__p").rowsBetween(W.unboundedPreceding, 0)
    parts = parts.withColumn("before", F.sum("s").over(upto) - F.col("s")).withColumn("total", F.sum("s").over(W.partitionBy()))
    at = F.least(F.floor(F.lit(q) * F.col("total")).cast("bigint"), F.col("total") - 1)
    hit = ranges.join(F.broadcast(parts.withColumn("at", at).filter("before <= at AND before + s > at")), "__p")  # one row
    run = F.col("before") + F.sum("n").over(W.partitionBy("__p").orderBy(value))
    return hit.withColumn("upto", run).filter("upto > at").agg(F.min(value).alias(value))
