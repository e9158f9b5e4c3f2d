import random

import pytest
from pyspark.sql import functions as F

from stackloom.operators import hierarchy as H


def brute(parents):
    out = {}
    for x in parents:
        path, y = [x], x
        while True:
            p = parents[y]
            if p is None or p not in parents:
                out[x] = (y, len(path) - 1, "rooted" if p is None else "orphan", path[::-1])
                break
            if p in path:
                ring = path[path.index(p) :]
                out[x] = (min(ring, key=str.encode), None, "on_cycle" if x in ring else "below_cycle", None)
                break
            path.append(p)
            y = p
    return out


def forest(seed, n=250, far=6):
    rnd = random.Random(seed)
    ids = [f"n{i:05d}" for i in rnd.sample(range(10**5), n)]
    parents = {}
    for i, x in enumerate(ids):
        r = rnd.random()
        parents[x] = None if i == 0 or r < 0.08 else f"ghost{i % 3}" if r < 0.12 else ids[min(n - 1, i + rnd.randint(0, 20))] if r < 0.15 else ids[max(0, i - rnd.randint(1, far))]
    rows = [(x, p if p else rnd.choice(["", None]), i) for i, (x, p) in enumerate(parents.items())]
    rows += rnd.sample(rows, 15) + [(None, "q", 3)]
    rnd.shuffle(rows)
    return parents, rows


@pytest.mark.parametrize("task_rows,near,far", [(10_000, ["t"], 6), (40, ["t"], 6), (12, ["t"], 6), (40, None, 200)])
def test_matches_brute_force_at_every_contraction_size(spark, task_rows, near, far):
    parents, rows = forest(task_rows + far, far=far)
    df = spark.createDataFrame(rows, "c string, p string, t int").withColumn("id", F.lit("clash")).withColumn("parent", F.lit(1)).withColumn("w", F.lit("x"))
    got = {r["node_id"]: (r["top_id"], r["depth"], r["state"], r["path"]) for r in H.hierarchy(df, "c", "p", near, True, ["t"], task_rows).collect()}
    assert got == brute(parents)


def test_long_chain_and_large_cycle(spark):
    n = 400
    rows = [(f"c{i:04d}", f"c{i - 1:04d}" if i else None, i) for i in range(n)] + [(f"r{i:04d}", f"r{(i + 1) % n:04d}", 1000 + i) for i in range(n)] + [("tail", "r0007", 2000)]
    df = spark.createDataFrame(rows, "c string, p string, t int")
    got = {r["node_id"]: tuple(r)[1:4] for r in H.hierarchy(df, "c", "p", ["t"], task_rows=50).collect()}
    assert got["c0399"] == ("c0000", 399, "rooted")
    assert got["r0123"] == ("r0000", None, "on_cycle") and got["tail"] == ("r0000", None, "below_cycle")
    assert len(got) == len(rows)


def test_cycles_too_large_for_a_task(spark):
    ring = spark.createDataFrame([(f"r{i}", f"r{(i + 1) % 6}") for i in range(6)] + [("a", "r2"), ("b", "a")], "id string, parent string")
    got = {r["id"]: (r["top"], r["state"]) for r in H._ring_doubling(ring).collect()}
    assert got == {**{f"r{i}": ("r0", "o") for i in range(6)}, "a": ("r0", "c"), "b": ("r0", "c")}


def test_self_parent_differing_parents_and_empty(spark):
    rows = [("a", "a"), ("b", "z"), ("b", "a"), ("c", None), ("c", "b")]
    got = {r["node_id"]: tuple(r)[1:] for r in H.hierarchy(spark.createDataFrame(rows, "c string, p string"), "c", "p").collect()}
    assert got == {"a": ("a", None, "on_cycle"), "b": ("a", None, "below_cycle"), "c": ("a", None, "below_cycle")}
    assert H.hierarchy(spark.createDataFrame([], "c string, p string"), "c", "p", paths=True).collect() == []


def test_descendants(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "a")]
    tree = H.hierarchy(spark.createDataFrame(rows, "c string, p string"), "c", "p", paths=True)
    assert {tuple(r) for r in H.descendants(tree).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}
    assert {tuple(r) for r in H.descendant_counts(tree).collect()} == {("a", 3), ("b", 1)}


@pytest.mark.parametrize("task_rows", [10_000, 20])
def test_descendants_below_cycles(spark, task_rows):
    parents, rows = forest(3, far=12)
    want = set()
    on = {x for x, (_, _, state, _) in brute(parents).items() if state == "on_cycle"}
    for x in parents:
        y, d = x, 0
        while y not in on and parents[y] in parents:
            y, d = parents[y], d + 1
            want.add((y, x, d))
    assert on and any(a in on for a, _, _ in want)
    df = spark.createDataFrame(rows, "c string, p string, t int")
    tree = H.hierarchy(df, "c", "p", ["t"], True, task_rows=task_rows)
    under = H.cycle_trees(tree, df, "c", "p", ["t"], task_rows)
    got = H.descendants(tree.select("node_id", "path").unionByName(under.select("node_id", "path")))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_deliveries_that_differ_in_place_count_once(spark):
    rows = [(f"n{i}", f"n{i // 2}" if i else None, i) for i in range(40)] + [("n7", "n3", 900), ("n9", "n4", 1000)]
    df = spark.createDataFrame(rows, "c string, p string, t int")
    got = H.hierarchy(df, "c", "p", ["t"], True, task_rows=11).collect()
    assert len(got) == 40 and {r["node_id"]: (r["top_id"], r["depth"], r["state"], r["path"]) for r in got} == brute({c: p for c, p, _ in rows})


def test_rounds_without_locality_go_on_contracting(spark):
    """Children lie far from their parents in the order of placement, so only the placement by links shrinks the forest."""
    rnd = random.Random(1)
    ids = [f"n{i:04d}" for i in range(600)]
    parents = {x: None if i < 3 else ids[rnd.randrange(max(0, i - 40), i)] for i, x in enumerate(ids)}
    parents["n0599"], parents["n0100"] = "n0100", "n0599" if rnd.random() < 2 else None
    df = spark.createDataFrame([(x, p, rnd.random()) for x, p in parents.items()], "c string, p string, t double")
    got = {r["node_id"]: (r["top_id"], r["depth"], r["state"], r["path"]) for r in H.hierarchy(df, "c", "p", ["t"], True, task_rows=100).collect()}
    assert got == brute(parents)
