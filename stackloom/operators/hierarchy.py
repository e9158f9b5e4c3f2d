"""Full hierarchies from parent-child rows: root, depth, path, descendants, cycles.

The forest is contracted in place: rows are range-partitioned so that a child
mostly lies beside its parent, and each partition resolves its chains as far as
they stay inside. What is left are the few chain tops whose parent lies in
another partition. Those form a smaller forest of the same kind, which is solved
by the same step until it fits into one partition; the result is then joined
back. Where a contraction shrinks too little (links without any locality) the
smaller forest is placed by its links instead: a coin is thrown for each node, a
tail goes to where its parent is if that is a head, and is contracted into it. A
quarter of all links go so in each round, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from stackloom.operators.skew import heavy_copies, salted_join
from stackloom.session import materialize

#: Rows that one contraction task holds at once.
TASK_ROWS = 500_000
#: After a contraction that keeps more than this share of its rows the next one places rows by their links.
MIN_SHRINK = 0.6


def _jump(parent: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointer jumping: last node of each chain and the weight of the links to it.

    ``parent`` is -1 at the end of a chain. For nodes that lead into a cycle the
    last node returned is one on that cycle (and every node of a cycle is the
    last node of some node of it).
    """
    n = len(parent)
    at = np.where(parent < 0, np.arange(n), parent)
    dist = np.where(parent < 0, 0, weight)
    ends = parent < 0
    steps = 1
    while not ends[at].all() and steps <= 2 * n:
        dist = dist + dist[at]
        at = at[at]
        steps *= 2
    return at, dist


def _cycles(parent: np.ndarray, at: np.ndarray, cyclic: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Among nodes that lead into a cycle: which lie on it, and the index of its smallest id."""
    n = len(parent)
    on = np.zeros(n, bool)
    least = np.full(n, -1)
    for first in np.unique(at[cyclic]):
        if on[first]:
            continue
        ring = [int(first)]
        while (nxt := int(parent[ring[-1]])) != ring[0]:
            ring.append(nxt)
        on[ring] = True
        texts = ids.take(pa.array(ring)).to_pylist()
        least[ring] = ring[min(range(len(ring)), key=lambda i: texts[i].encode())]
    least[cyclic] = least[at[cyclic]]
    return on, least


def _unique_rows(table: pa.Table) -> pa.Table:
    """One row an id: the one with the smallest parent, an absent parent last."""
    codes = pc.dictionary_encode(table["id"].combine_chunks()).indices.to_numpy()
    if len(codes) == 0 or len(np.unique(codes)) == len(codes):
        return table
    parents = table["parent"].combine_chunks()
    order = pc.rank(parents, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
    first = np.lexsort((np.arange(len(codes)), order, codes))
    keep = np.sort(first[np.r_[True, np.diff(codes[first]) != 0]])
    return table.take(pa.array(keep))


def _contract(names: list[str], paths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = _unique_rows(pa.Table.from_batches(got).combine_chunks())
        ids, parents = table["id"].combine_chunks(), table["parent"].combine_chunks()
        parent = pc.fill_null(pc.index_in(parents, value_set=ids), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        parent[parents.is_null().to_numpy(zero_copy_only=False)] = -1
        at, dist = _jump(parent, table["w"].to_numpy())
        cyclic = parent[at] >= 0
        on = np.zeros(len(parent), bool)
        top = at.copy()
        if cyclic.any():
            on, least = _cycles(parent, at, cyclic, ids)
            top[cyclic] = least[cyclic]
            dist[cyclic] = 0
        last = parents.take(pa.array(top))  # of the chain's end: the parent it names, in no row of this partition
        state = np.where(cyclic, np.where(on, "o", "c"), np.where(last.is_null().to_numpy(zero_copy_only=False), "r", "x"))
        leaves = pc.if_else(pa.array(cyclic), pa.scalar(None, pa.string()), last)
        out = {
            **{c: table[c] for c in names},
            "top": ids.take(pa.array(top)),
            "out_parent": leaves,
            "dist": pa.array(dist.astype(np.int64)),
            "state": pa.array(state, pa.string()),
        }
        if paths:
            out["trail"] = _trails(table["seg"].to_pylist(), parent, cyclic)
        result = pa.table(out)
        yield from result.to_batches(max_chunksize=20_000)

    return run


def _trails(segs: list[list[str]], parent: np.ndarray, cyclic: np.ndarray) -> pa.Array:
    """The segments from the chain's local end down to each node; null where the chain has no end."""
    trails: list[list[str] | None] = [None] * len(segs)
    for i in range(len(segs)):
        if cyclic[i] or trails[i] is not None:
            continue
        chain, j = [], i
        while j >= 0 and trails[j] is None:
            chain.append(j)
            j = int(parent[j])
        above = trails[j] if j >= 0 else []
        for j in reversed(chain):
            above = trails[j] = above + segs[j]
    return pa.array(trails, pa.list_(pa.string()))


def _run_contract(rows: DataFrame, parts: int, near: list[str], names: list[str], paths: bool, coin: int | None = None) -> DataFrame:
    fields = [f for f in rows.schema.fields if f.name in names]
    schema = T.StructType(
        [*fields, T.StructField("top", T.StringType()), T.StructField("out_parent", T.StringType()), T.StructField("dist", T.LongType()), T.StructField("state", T.StringType())]
        + [T.StructField("trail", T.ArrayType(T.StringType()))] * paths
    )
    if parts == 1:
        spread = rows.repartition(1)
    elif coin is None:
        spread = rows.repartitionByRange(parts, *near, "id")
    else:
        head = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(coin)), F.lit(2)) == 0
        spread = rows.repartition(parts, F.when(head("parent") & ~head("id"), F.xxhash64("parent")).otherwise(F.xxhash64("id")))
    order = [f.name for f in fields]
    return spread.mapInArrow(_contract(order, paths), schema)


def _solve(rows: DataFrame, count: int, near: list[str], paths: bool, task_rows: int, carry: tuple[str, ...] = (), coin: int | None = None) -> tuple[DataFrame, bool]:
    """id, top, dist, state ('r' | 'orphan' | 'o' | 'c'), trail of every row of a forest (id, parent, w[, seg], near).

    State 'cyclic' is given to rows that lead into a cycle spanning several
    partitions, and the second result says whether there are any; the caller
    resolves those on the unweighted rows. Joins whose
    sides grow with the data are sort-merge joins.
    """
    names = ["id", "parent", "w", *near, *carry]
    parts = max(1, -(-count // task_rows))
    local = _run_contract(rows, parts, near, names, paths, coin)
    keep = ["id", "top", "dist", "state", *["trail"] * paths, *carry]
    if parts == 1:
        return materialize(local, "fragments").withColumn("state", F.when(F.col("state") == "x", "orphan").otherwise(F.col("state"))).select(*keep), False
    local = materialize(local.withColumn("open", F.col("state") == "x"), "fragments", ["open"])  # rows that are done are not read again until the end
    rest = local.filter("open")
    tops = rest.filter("id = top").select("id", "out_parent", "w", *near)
    left = tops.count()
    if left == 0:
        return local.select(*keep), False
    place = local.select(
        F.col("id").alias("out_parent"), F.col("top").alias("p_top"), F.col("dist").alias("p_dist"), F.col("state").alias("p_state"), *[F.col("trail").alias("p_trail")] * paths
    )
    # an absent parent can be named by many orphans, and then matches nothing: no hot group forms on the node side
    links = materialize(_lookup(tops, place, left).withColumn("p_dist", F.col("p_dist") + F.col("w")).drop("w"), "links")
    forest = links.select(
        "id", F.when(F.col("p_state") == "x", F.col("p_top")).alias("parent"), F.coalesce("p_dist", F.lit(0)).cast("bigint").alias("w"),
        *([F.coalesce("p_trail", F.array().cast("array<string>")).alias("seg")] * paths), *near,
    )
    if links.filter("p_state = 'x'").isEmpty():
        solved = forest.select("id", F.col("id").alias("q_top"), F.lit(0).cast("bigint").alias("q_dist"), F.lit("r").alias("q_state"), *([F.col("seg").alias("q_trail")] * paths))
    else:
        again = coin + 1 if coin is not None else 0 if left > MIN_SHRINK * count else None
        got, _ = _solve(forest, left, near, paths, task_rows, coin=again)
        solved = got.select("id", F.col("top").alias("q_top"), F.col("dist").alias("q_dist"), F.col("state").alias("q_state"), *([F.col("trail").alias("q_trail")] * paths))
    # what the end of the quotient chain resolved to
    ends = links.select(F.col("id").alias("q_top"), F.col("p_top").alias("e_top"), F.col("p_dist").alias("e_dist"), F.col("p_state").alias("e_state"))
    final = solved.join(ends.hint("merge"), "q_top", "left").select(
        F.col("id").alias("top"),
        F.when(F.col("q_state").isin("o", "c", "cyclic"), F.lit(None)).when(F.col("e_state").isNull(), F.col("q_top")).otherwise(F.col("e_top")).alias("f_top"),
        (F.col("q_dist") + F.coalesce("e_dist", F.lit(0))).alias("f_dist"),
        F.when(F.col("q_state").isin("o", "c", "cyclic"), "cyclic").when(F.col("e_state").isNull(), "orphan").when(F.col("e_state") == "o", "c").otherwise(F.col("e_state")).alias("f_state"),
        *([F.col("q_trail").alias("f_trail")] * paths),
    )
    final = materialize(final, "tops")
    sizes = materialize(rest.groupBy("top").agg(F.count("*").alias("rows")), "sizes")
    heavy = heavy_copies(sizes, ["top"], "rows", sizes.agg(F.sum("rows")).first()[0] or 0)
    joined = salted_join(rest.drop("open"), final, ["top"], heavy, ["id"]).select(
        "id", F.col("f_top").alias("top"), (F.col("dist") + F.col("f_dist")).alias("dist"), F.col("f_state").alias("state"),
        *([F.concat("f_trail", "trail").alias("trail")] * paths), *carry,
    )
    return local.filter("NOT open").select(*keep).unionByName(joined), not final.filter("f_state = 'cyclic'").isEmpty()


def _lookup(tops: DataFrame, place: DataFrame, left: int) -> DataFrame:
    """tops LEFT JOIN place on out_parent, safe where many tops name one parent."""
    named = materialize(tops.groupBy("out_parent").agg(F.count("*").alias("rows")), "named")
    found = place.join(named.hint("merge"), "out_parent", "left_semi")  # one row a node that is named
    hit = materialize(salted_join(tops, found, ["out_parent"], heavy_copies(named, ["out_parent"], "rows", left), ["id"]), "links")
    miss = tops.join(hit.select("id").hint("merge"), "id", "left_anti")
    return hit.unionByName(miss, allowMissingColumns=True)


def _ring_doubling(rows: DataFrame) -> DataFrame:
    """Cycles of any length among rows (id, parent) that all lead into one: id, top (smallest id of the cycle), state."""
    count = rows.count()
    cur = materialize(rows.select("id", F.col("parent").alias("at"), F.least("id", "parent").alias("least")), "rings")
    steps = 1
    while steps < count:
        nxt = cur.select(F.col("id").alias("n_id"), F.col("at").alias("n_at"), F.col("least").alias("n_least"))
        cur = materialize(cur.join(nxt.hint("merge"), F.col("at") == F.col("n_id")).select("id", F.col("n_at").alias("at"), F.least("least", "n_least").alias("least")), "rings")
        steps *= 2
    on = cur.select(F.col("at").alias("o_id")).distinct()
    ring = cur.select(F.col("id").alias("r_id"), F.col("least").alias("r_least"))
    marked = cur.join(on.hint("merge"), cur["id"] == on["o_id"], "left").join(ring.hint("merge"), cur["at"] == ring["r_id"])
    return marked.select("id", F.col("r_least").alias("top"), F.when(F.col("o_id").isNotNull(), "o").otherwise("c").alias("state"))


def hierarchy(df: DataFrame, node: str, parent: str, near: list[str] | None = None, paths: bool = False, keep: list[str] | None = None, task_rows: int = TASK_ROWS, agreed: bool = False) -> DataFrame:
    """One row a node: node_id, top_id, depth, state[, path][, kept_<column> for each column of ``keep``].

    ``state`` is ``rooted`` (top_id is the root), ``orphan`` (the chain ends at
    top_id, whose parent is named but has no row), ``on_cycle`` or
    ``below_cycle`` (top_id is the cycle's smallest id in byte order). ``depth``
    is the number of links to top_id, null for the last two; ``path`` (on
    request) lists the ids from top_id to the node.

    ``near`` names columns in which parents and children are close; without any,
    rows are placed by id. ``agreed`` says that all deliveries of a node agree in
    these: then they meet in one partition anyway, and the reduction by id, which
    moves every row once more, is left out.

    Defined cases: a null or empty parent is none; rows with a null id are left
    out; repeated rows of an id count once (with differing parents the smallest
    one counts; ``near`` and ``keep`` are then of one of that parent's rows, the
    smallest); a node that names itself is a cycle of one; an empty table gives no
    rows.
    """
    near = near or []
    keep = keep or []
    side = [f"__near{i}" for i in range(len(near))]
    carry = [f"__keep{i}" for i in range(len(keep))]
    rows = df.filter(F.col(node).isNotNull()).select(
        F.col(node).cast("string").alias("id"),
        F.when(F.col(parent).cast("string") != "", F.col(parent).cast("string")).alias("parent"),
        F.lit(1).cast("bigint").alias("w"),
        *([F.array(F.col(node).cast("string")).alias("seg")] * paths),
        *[F.col(c).alias(s) for c, s in zip([*near, *keep], [*side, *carry])],
    )
    if not agreed:
        rest = [c for c in rows.columns if c not in ("id", "parent")]
        first = F.min(F.struct(F.col("parent").isNull().alias("none"), "parent", *rest)).alias("r")
        rows = materialize(rows.groupBy("id").agg(first).select("id", "r.parent", *[f"r.{c}" for c in rest]), "nodes")
    count = rows.count()
    solved, stray = _solve(rows, count, side, paths, task_rows, carry=tuple(carry))
    if stray:
        spanning = solved.filter("state = 'cyclic'")
        links = rows.groupBy("id").agg(F.min("parent").alias("parent"))
        members = materialize(spanning.select("id", *carry).join(links.hint("merge"), "id"), "cyclic")
        if members.count() <= task_rows:
            ring = _run_contract(members.select("id", "parent", F.lit(1).cast("bigint").alias("w")), 1, [], ["id"], False).select("id", "top", "state")
        else:
            ring = _ring_doubling(members)
        none = F.lit(None)
        ring = ring.join(members.select("id", *carry).hint("merge"), "id").select("id", "top", none.cast("bigint").alias("dist"), "state", *([none.cast("array<string>").alias("trail")] * paths), *carry)
        solved = solved.filter("state <> 'cyclic'").unionByName(ring)
    named = F.create_map(*[F.lit(x) for x in ("r", "rooted", "orphan", "orphan", "o", "on_cycle", "c", "below_cycle")])
    cyclic = F.col("state").isin("o", "c")
    return solved.select(
        F.col("id").alias("node_id"), F.col("top").alias("top_id"), F.when(~cyclic, F.col("dist")).alias("depth"), named[F.col("state")].alias("state"),
        *([F.when(~cyclic, F.col("trail")).alias("path")] * paths), *[F.col(c).alias(f"kept_{k}") for c, k in zip(carry, keep)],
    )


def cycle_trees(tree: DataFrame, df: DataFrame, node: str, parent: str, near: list[str] | None = None, task_rows: int = TASK_ROWS, agreed: bool = False) -> DataFrame:
    """The finite trees under cycles: node_id, top_id, depth, path from the cycle's member that each node hangs on.

    ``tree`` is ``hierarchy`` of the other arguments. Members of a cycle have no
    order and are no descendants of one another here: each is the root of what
    hangs on it, itself at depth 0.
    """
    cyclic = tree.filter("state IN ('on_cycle', 'below_cycle')").select(F.col("node_id").alias("__cyclic"), (F.col("state") == "on_cycle").alias("__member"))
    cyclic = materialize(cyclic, "cyclic")
    rows = df.join(cyclic.hint("merge"), df[node].cast("string") == F.col("__cyclic")).withColumn(parent, F.when(~F.col("__member"), F.col(parent)))
    return hierarchy(rows, node, parent, near, True, task_rows=task_rows, agreed=agreed).select("node_id", "top_id", "depth", "path")


def descendants(tree: DataFrame) -> DataFrame:
    """ancestor_id, node_id, distance: every node below every other, from ``hierarchy(..., paths=True)``.

    The rows are as many as the depths add up to. Nodes on or below a cycle have
    no path in the tree; ``cycle_trees`` has theirs.
    """
    up = tree.filter("path IS NOT NULL AND size(path) > 1").select("node_id", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("at", "ancestor_id"), F.size("path").alias("n"))
    return up.select("ancestor_id", "node_id", (F.col("n") - 1 - F.col("at")).cast("bigint").alias("distance"))


def descendant_counts(tree: DataFrame) -> DataFrame:
    """ancestor_id, n_descendants, counted before anything is shuffled."""
    return descendants(tree).groupBy("ancestor_id").agg(F.count("*").alias("n_descendants"))
