"""The graph queries over all orders against brute force on the smallest tables."""

import os
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
from stackloom.operators import graph as G
from stackloom.plans import profile_queries as Q
from tests.test_graph import graph, random_edges, reach_model, tree_model

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


def whole():
    """Vertices and first references (src, dst) in order, from every order."""
    ids = [k for (k,) in duckdb.sql(f"SELECT c_custkey FROM '{DATA}/customer.parquet'").fetchall()]
    first = {}
    for s, k in duckdb.sql(f"SELECT o_custkey, o_orderkey FROM '{DATA}/orders.parquet' ORDER BY o_orderkey").fetchall():
        if s != (d := (k * 31 + 7) % (len(ids) // 2) + 1):
            first.setdefault((f"{s:09d}", f"{d:09d}"), k)
    return [f"{k:09d}" for k in ids], sorted(first, key=first.get)


def rows(spark, name):
    return entry.queries()[name](spark, DATA).collect()


def reaches(edges):
    out, got = defaultdict(list), {}
    for a, b in edges:
        out[a].append(b)
    for x in list(out):
        got[x], todo = {x}, [x]
        while todo:
            fresh = set(out[todo.pop()]) - got[x]
            got[x] |= fresh
            todo += fresh
    return got


def test_roots_dead_code_and_trees(spark):
    ids, edges = whole()
    symbols = {r["id"]: r for r in Q._symbols(spark, DATA).collect()}
    by_real = {b for a, b in edges if not symbols[a]["name"].startswith("<")}
    reach = reaches(edges)
    found = {r["id"]: r["reach"] for r in rows(spark, "discover_roots")}
    assert found and all(found[x] == len(reach[x]) and x not in by_real for x in found)
    top = sorted(found, key=lambda x: (-found[x], symbols[x]["name"], x))[: Q.TREE_ROOTS]
    trees = rows(spark, "call_trees")
    fan = sorted(ids, key=lambda x: (-sum(a == x for a, _ in edges), x))[: Q.TREE_HUBS]
    assert {r["root"] for r in trees} == set(fan) | set(top)
    for root in fan[:3]:
        mine = sorted((r for r in trees if r["root"] == root), key=lambda r: r["node_ord"])
        assert [(r["id"], r["depth"], r["truncated"]) for r in mine] == tree_model(edges, root, G.MAX_DEPTH)


@pytest.mark.parametrize("m", [12, 24, 60])
def test_reach_counts_with_and_without_components(spark, m):
    edges = random_edges(m, 20, m)
    v, e = graph(spark, sorted({x for p in edges for x in p} | {"alone"}), edges)
    assert {tuple(r) for r in G.reach_counts(v, e).collect()} == {(x, len(reach_model(edges, x))) for x in {y for p in edges for y in p} | {"alone"}}


def test_pagerank_runs_to_convergence(spark):
    ids, edges = whole()
    deg = Counter(a for a, _ in edges)
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(300):
        base = 0.15 / len(ids) + 0.85 * sum(rank[x] for x in ids if not deg[x]) / len(ids)
        nxt = dict.fromkeys(ids, base)
        for a, b in edges:
            nxt[b] += 0.85 * rank[a] / deg[a]
        rank = nxt
    got = {r["id"]: r["rank"] for r in rows(spark, "pagerank")}
    assert got.keys() == rank.keys()
    # the last change is under 1e-6, what is left of it at most 0.85 / 0.15 times that; nine decimals are kept
    assert sum(abs(got[x] - rank[x]) for x in ids) < 1e-6 * 0.85 / 0.15 + len(ids) * 1e-9
