import random

import pytest
from pyspark.sql import functions as F

from stackloom.operators import findings as D, graph as G, reports as R


def graph(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "src string, dst string, ord bigint")


def ranks(spark, nodes, edges, **kw):
    return {r["id"]: r["rank"] for r in G.pagerank(*graph(spark, nodes, edges), **kw).collect()}


def test_pagerank_closed_forms(spark):
    assert ranks(spark, [], []) == {}
    assert ranks(spark, ["a"], []) == {"a": pytest.approx(1.0)}
    assert ranks(spark, ["a", "b"], [("a", "b"), ("b", "a")]) == {"a": pytest.approx(0.5), "b": pytest.approx(0.5)}
    got = ranks(spark, "abcd", [("a", "d"), ("b", "d"), ("c", "d")], tolerance=1e-4)
    assert sum(got.values()) == pytest.approx(1.0) and got["d"] > 2 * got["a"]
    assert got["d"] == pytest.approx(0.15 / 4 + 0.85 * (got["a"] + got["b"] + got["c"]) + 0.85 * got["d"] / 4, abs=1e-3)


def reach_model(edges, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def hops_model(edges, start, most):
    hops, front = {start: 0}, [start]
    for d in range(1, most + 1):
        front = [b for a, b in edges if a in front and b not in hops]
        hops.update(dict.fromkeys(front, d))
    return hops


def random_edges(seed, n=18, m=34):
    rnd = random.Random(seed)
    return sorted({(a, b) for a, b in ((f"v{rnd.randrange(n):02d}", f"v{rnd.randrange(n):02d}") for _ in range(m)) if a != b})


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_reach_match_a_model(spark, seed):
    edges = random_edges(seed)
    nodes = sorted({x for e in edges for x in e})
    v, e = graph(spark, nodes, edges)
    reach = {x: reach_model(edges, x) for x in nodes}
    want = {(x, min(y for y in reach[x] if x in reach[y])) for x in nodes if sum(x in reach[y] for y in reach[x]) > 1}
    assert {tuple(r) for r in G.strong_components(e).collect()} == want
    pairs = {(x, y) for x in nodes for y in reach[x]}
    assert {(r["root"], r["id"]) for r in G.reachable(v, e).collect()} == pairs
    near = {(r["root"], r["id"]): r["hops"] for r in G.reachable(v, e, 2).collect()}
    assert near == {(x, y): h for x in nodes for y, h in hops_model(edges, x, 2).items()}


def tree_model(edges, root, depth):
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    seen, rows = set(), []

    def walk(x, d):
        again = x in seen
        seen.add(x)
        rows.append((x, d, "cycle" if again else "max-depth" if d >= depth else None))
        if rows[-1][2] is None:
            for y in out.get(x, []):
                walk(y, d + 1)

    walk(root, 0)
    return rows


@pytest.mark.parametrize("depth", [2, 12])
def test_tree_expansion_matches_a_model(spark, depth):
    edges = random_edges(7)
    v, e = graph(spark, sorted({x for p in edges for x in p}), edges)
    trees = G.tree_percentages(G.expand_trees(v, e, max_depth=depth)).collect()
    for root in {r["root"] for r in trees}:
        rows = sorted((r for r in trees if r["root"] == root), key=lambda r: r["node_ord"])
        assert [(r["id"], r["depth"], r["truncated"]) for r in rows] == tree_model(edges, root, depth)
        assert rows[0]["subtree_size"] == len(rows) and rows[0]["percent_total"] == 100.0


def test_resolution_classification_and_containment(spark):
    symbols = spark.createDataFrame([(1, "a.py::::outer", "outer", "Function", "a.py", 0, 100, False, [(10, 40)], []), (2, "a.py::::inner", "inner", "Function", "a.py", 20, 60, True, [], [(30, 35)]), (3, "b.py::::go", "go", "Function", "b.py", 0, 50, False, [], [])],
                                    "def_id bigint, id string, name string, kind string, file string, byte_start bigint, byte_end bigint, is_async boolean, loop_ranges array<struct<s: bigint, e: bigint>>, await_ranges array<struct<s: bigint, e: bigint>>")
    refs = spark.createDataFrame([("a.py", 1, "go", None, 1, 30, None), ("a.py", 2, "outer", None, 2, 5, None), ("a.py", 3, "get", "requests", 3, 15, None), ("a.py", 4, "inner", None, 4, 12, None)], "file string, ref_ord bigint, name string, receiver string, line int, byte_offset bigint, in_symbol string")
    placed = G.enclosing_symbols(refs, symbols)
    assert {r["ref_ord"]: r["in_symbol"] for r in placed.collect()} == {1: "inner", 2: "outer", 3: "outer", 4: "outer"}
    sourced = G.source_ids(placed, symbols)
    assert {(r["src"], r["dst"]) for r in G.resolve_edges(sourced, symbols).collect()} == {("a.py::::inner", "b.py::::go"), ("a.py::::outer", "a.py::::inner")}
    imports = spark.createDataFrame([("a.py", "requests", "requests.api", None, 1)], "file string, local_name string, module_path string, imported_name string, line int")
    modules = spark.createDataFrame([("requests", "network"), ("req", "db")], "module string, category string")
    named = spark.createDataFrame([("cursor", "db")], "name string, category string")
    ext = G.external_calls(sourced, symbols, imports, modules, named, named).collect()
    assert [(r["name"], r["category"], r["tier"], r["in_loop"]) for r in ext] == [("get", "network", "imported_module", True)]
    parents = G.parent_symbols(symbols.withColumn("parent", F.lit(None).cast("string")))
    assert {r["name"]: r["parent"] for r in parents.collect()} == {"outer": None, "inner": "outer", "go": None}


def test_percentile_position_and_quota(spark):
    df = spark.createDataFrame([(float(i % 37),) for i in range(100)] + [(None,)], "v double")
    assert G.floor_percentile(df, "v").first()[0] == sorted(float(i % 37) for i in range(100))[90]
    assert G.floor_percentile(df.limit(0), "v").first()[0] is None
    rows = spark.createDataFrame([(i, "k" if i < 30 else f"o{i}") for i in range(40)], "i int, kind string")
    got = [r["i"] for r in D.quota(rows, "kind", [F.col("i")], 20).collect()]
    assert got == [0, 1, 2, 3, 4, *range(30, 40)]


def test_dedup_and_bump(spark):
    f = spark.createDataFrame([("a", "k", "low", 1, ["x"], 2), ("a", "k", "high", 1, ["x"], 1), ("a", "k", "low", 2, [], 3)], "id string, kind string, severity string, line int, evidence array<string>, ord int")
    once = D.drop_duplicates(f, ["ord"])
    assert sorted((r["line"], r["severity"]) for r in once.collect()) == [(1, "high"), (2, "low")]
    assert sorted(map(tuple, D.drop_duplicates(once, ["ord"]).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    bump = lambda pct, rank, sites, p90=0.5: [r["severity"] for r in D.bump_severity(once.orderBy("line"), F.lit(pct), F.lit(rank), F.lit(sites), p90).orderBy("line").collect()]
    assert bump(25, 0.9, 12) == ["high", "high"] and bump(25, 0.9, 1) == ["high", "medium"] and bump(25, 0.1, 1) == ["high", "low"] and bump(99, 1.0, 99, 0.0) == ["high", "low"]


def test_entry_lookup_reads_names_only(spark):
    s = spark.createDataFrame([("src/views.py::::load", "load"), ("src/a.py::::view_one", "view_one"), ("src/a.py::::view", "view"), ("b.py::::preview", "preview")], "id string, name string")
    assert [r["name"] for r in G.find_entry(s, "view").collect()] == ["view"]
    assert sorted(r["name"] for r in G.find_entry(s, "vie").collect()) == ["preview", "view", "view_one"]
    assert G.find_entry(s, "views").collect() == []


def test_a_hub_of_edges_is_spread(spark):
    nodes = [f"n{i}" for i in range(60)]
    edges = [("n0", n) for n in nodes[1:]] + [(n, "n0") for n in nodes[1:30]]
    got = ranks(spark, nodes, edges, tolerance=1e-4)
    plain = dict.fromkeys(nodes, 1 / 60)
    deg = {a: sum(x == a for x, _ in edges) for a, _ in edges}
    for _ in range(200):
        base = 0.15 / 60 + 0.85 * sum(plain[x] for x in nodes if x not in deg) / 60
        nxt = dict.fromkeys(nodes, base)
        for a, b in edges:
            nxt[b] += 0.85 * plain[a] / deg[a]
        plain = nxt
    assert all(abs(got[x] - plain[x]) < 1e-3 for x in nodes)


def test_containment_of_long_nested_and_negative_ranges(spark):
    from stackloom.operators import joins as J

    rnd = random.Random(2)
    ranges = [(i, s, s + rnd.choice([0, 1, 7, 100, 5000, 10**6])) for i, s in enumerate(rnd.randint(-5000, 5000) for _ in range(120))]
    points = [(i, rnd.randint(-6000, 12000)) for i in range(300)] + [(300, None)]
    got = J.containing(spark.createDataFrame([("k", *p) for p in points], "k string, p int, at bigint"), spark.createDataFrame([("k", *r) for r in ranges], "k string, r int, s bigint, e bigint"), ["k"], "at", "s", "e", "p", ["r"])
    want = {p: min(((e - s, r) for r, s, e in ranges if a is not None and s <= a <= e), default=(None, None))[1] for p, a in points}
    assert {r["p"]: r["r_r"] for r in got.collect()} == want


def test_heavy_keys_are_salted(spark):
    from stackloom.operators import skew

    fact = spark.createDataFrame([("hot" if i % 3 else f"k{i % 9}", i) for i in range(300)] + [(None, 1000)], "k string, i int")
    dim = spark.createDataFrame([("hot", "H"), ("k0", "a"), ("k3", "b"), ("none", "c"), (None, "d")], "k string, v string")
    counts = fact.groupBy("k").agg(F.count("*").alias("rows"))
    want = sorted(map(tuple, fact.join(dim, "k").collect()))
    assert skew.heavy_copies(counts, ["k"], "rows", 300) is None
    heavy = skew.heavy_copies(counts, ["k"], "rows", 300, least=50)
    assert {r["k"]: r["__copies"] for r in heavy.collect()} == {"hot": 5}
    for h in (None, heavy):
        assert sorted(map(tuple, skew.salted_join(fact, dim, ["k"], h, ["i"]).collect())) == want


def test_diff(spark):
    side = lambda n, cx, smells: {"entries": spark.createDataFrame([("A::f", cx)], "entry string, complexity bigint"), "categories": spark.createDataFrame([("A::f", "db", n), ("A::f", "io", 2)], "entry string, category string, n bigint"), "smells": spark.createDataFrame(smells, "entry string, node string, smell string")}
    a, b = side(1, 5, [("A::f", "x", "recursive")]), side(4, 7, [("A::f", "y", "n_plus_one")])
    got = {(r["kind"], r["delta"], r["verdict"]) for r in R.diff_reports(a, b).collect()}
    assert got == {("category_db", 3, "regression"), ("smell", 1, "regression"), ("smell", -1, "improvement"), ("complexity", 2, "regression")}
    assert R.diff_reports(a, a).collect() == []


def test_many_trees_share_one_copy_of_the_graph(spark, monkeypatch):
    """The walk gets no list of (root, vertex) pairs, which is roots times the graph; ties, repeats, odd roots and shares are as in the plain walk."""
    monkeypatch.setattr(G, "reachable", lambda *_: pytest.fail("pairs of roots and vertices"))
    monkeypatch.setattr(G, "TREE_BATCH", 7)
    edges = random_edges(11, 40, 120) + [("v00", "v01"), ("v00", "v01"), ("é", "v02")]
    rows = [(a, b, i // 2 if i < 20 else i) for i, (a, b) in enumerate(edges)]  # two calls each of the first twenty at one place
    e = spark.createDataFrame([*rows, ("v03", "v04", None), ("v03", None, 5), (None, "v05", 6)], "src string, dst string, ord bigint")
    roots = [f"v{i:02d}" for i in range(40)] + ["é", "alone", "v07"]
    v = spark.createDataFrame([(r,) for r in roots], "id string")
    ordered = [(a, b) for a, b, _ in sorted(rows, key=lambda r: (r[2], r[1]))] + [("v03", "v04")]
    for depth in (1, 5):
        got = G.expand_trees(v, e, max_depth=depth, shares=True)
        assert sorted(map(tuple, G.tree_percentages(got.drop("percent_total", "percent_parent")).select(got.columns).collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
        trees = got.collect()
        assert {r["root"] for r in trees} == set(roots)
        for root in set(roots):
            mine = sorted((r for r in trees if r["root"] == root), key=lambda r: r["node_ord"])
            assert [(r["id"], r["depth"], r["truncated"]) for r in mine] == tree_model(ordered, root, depth)
            assert [r["node_ord"] for r in mine] == list(range(len(mine))) and mine[0]["parent_ord"] is None
    skipped = G.expand_trees(v, e, accessors=spark.createDataFrame([("v01",)], "id string")).collect()
    assert {r["root"] for r in skipped if r["id"] == "v01"} == {"v01"}
    assert G.expand_trees(v.limit(0), e).collect() == []
