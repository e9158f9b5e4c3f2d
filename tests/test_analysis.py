"""Operators over trees, stores, views and scans that have no SQL, on hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from stackloom.functions import predicates as P, scalar as S
from stackloom.lint import chainrules as C, sqlrules
from stackloom.operators import analysis as A, findings as D, graph as G, profile as R, reports as T, shred
from stackloom.sources import code, manifests
from stackloom.streaming import live


@pytest.fixture(scope="module")
def trees(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "d", 3), ("c", "d", 4)], "src string, dst string, ord bigint")
    return G.tree_percentages(G.expand_trees(spark.createDataFrame([("a",)], "id string"), edges)).cache()


NAMES = [("a", "main"), ("b", "left"), ("c", "right"), ("d", "query")]


def test_categories_hot_paths_and_text(spark, trees):
    names = spark.createDataFrame(NAMES, "id string, name string")
    external = spark.createDataFrame([("d", "db", "execute"), ("d", "db", "commit"), ("b", "log", "info")], "src string, category string, name string")
    got = {(r["node_ord"], r["category"]): r["n"] for r in G.categories_reached(trees, external).collect()}
    # a(0) b(1) d(2) c(3) d(4, a stub, which counts itself only); a node's own category counts once more
    assert got == {(2, "db"): 3, (4, "db"): 3, (1, "db"): 3, (3, "db"): 3, (0, "db"): 6, (1, "log"): 2, (0, "log"): 2}
    totals = {r["category"]: r["n"] for r in A.category_totals(trees, external).collect()}
    assert totals == {"db": 6, "log": 2, "network": 0, "io": 0, "cache": 0, "queue": 0, "compute": 0}
    paths = [(r["path"], r["depth"], r["category"]) for r in G.hot_paths(trees, external, names).collect()]
    assert paths == [(["main", "left", "query"], 2, "db"), (["main", "right", "query"], 2, "db"), (["main", "left"], 1, "log")]
    text = [r["line"] for r in G.render_tree(trees, names).orderBy("node_ord").collect()]
    assert text == ["main", "  left", "    query", "  right", "    query [cycle]"]
    symbols = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4), ("d", 5)], "id string, complexity int")
    found = spark.createDataFrame([("d", "n_plus_one"), ("d", "n_plus_one"), ("d", "recursive"), ("b", "noisy_log")], "id string, kind string")
    assert [tuple(r) for r in A.root_sums(trees, symbols, found).collect()] == [("a", 14, 2)]


def test_scan_of_a_small_project_with_read_catalog(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"entries": [{"module": "store", "category": "db"}, {"module": "store.fast", "category": "cache"}]}))
    (tmp_path / "r.json").write_text(json.dumps({"patterns": [{"name": "bus", "category": "queue"}]}))
    (tmp_path / "u.json").write_text(json.dumps({"methods": [{"name": "slurp", "category": "io"}]}))
    catalog = A.read_catalog(spark, str(tmp_path / "m.json"), str(tmp_path / "r.json"), str(tmp_path / "u.json"))
    text = "import store\nfrom store.fast import pool\ndef a(xs):\n    for x in xs:\n        store.get(x)\n    pool.put(1)\n    bus.send(2)\n    slurp(3)\n    unknown(4)\n    return b(xs)\n\ndef b(xs):\n    return b(xs[1:])\n"
    got = A.analyze(spark.createDataFrame([("p/x.py", text)], "path string, content string"), catalog)
    calls = {(r["name"], r["category"], r["tier"]) for r in got["externals"].collect()}
    assert calls == {("get", "db", "imported_module"), ("put", "cache", "imported_module"), ("send", "queue", "receiver_pattern"), ("slurp", "io", "method_signature")}
    assert {(r["id"].split("::")[-1], r["kind"], r["severity"]) for r in got["findings"].collect()} == {("a", "n_plus_one", "high"), ("b", "recursive", "high")}
    assert [(r["name"], r["reach"]) for r in got["roots"].collect()] == [("a", 2)]
    assert A.analyze(spark.createDataFrame([], "path string, content string"), catalog)["findings"].collect() == []


def test_findings_are_placed_in_files_and_roots_without_a_holder(spark):
    nodes = [("r1", 0, 0, "a.py", 1, 5, 5, False), ("r1", 1, 1, "a.py", 3, 1, 5, False), ("r0", 0, 0, "b.py", 10, 3, 3, False)]
    n = spark.createDataFrame(nodes, "root string, node_ord bigint, depth int, file string, line int, loc int, root_loc int, root_is_module boolean")
    f = spark.createDataFrame([("a.py", 3, "X"), ("a.py", 900, "X"), ("c/d.py", 1, "X"), ("b.py", 11, "X")], "file string, line int, rule_id string")
    got = {(r["file"], r["line"]): (r["root"], r["node_ord"]) for r in C.attach_findings(f, n).collect()}
    assert got == {("a.py", 3): ("r1", 1), ("a.py", 900): ("r1", 0), ("b.py", 11): ("r0", 0), ("c/d.py", 1): ("c/d.py::<orm_file>::d.py", 0)}


def test_reports_are_written_read_and_listed(spark, tmp_path):
    rows = [("s1", 0, 1, None, "main", "a.py", 3, "Function", None), ("s1", 0, 2, 1, "C.run", "a.py", 9, "Method", "C"), ("s1", 1, 1, None, "main", "a.py", 3, "Function", None), ("s2", 0, 1, None, "x", None, None, "Function", None)]
    nodes = spark.createDataFrame(rows, "report_id string, entry int, node_ord int, parent_ord int, name string, file string, line int, kind string, parent_class string")
    texts = {r["report_id"]: r["content"] for r in T.compact_reports(nodes).collect()}
    doc = json.loads(texts["s1"])["report"]
    assert doc["schema_version"] == "1.1" and doc["string_table"] == ["main", "a.py", "Function", "C.run", "C", "Method"] and len(doc["frames"]) == 2
    assert doc["entries"] == [{"frame": 0, "children": [{"frame": 1, "children": []}]}, {"frame": 0, "children": []}]
    assert json.loads(shred.expand_report(texts["s1"]))["report"]["entries"][0]["children"][0]["name"] == "C.run"
    assert T.compact_reports(nodes.limit(0)).collect() == []
    (tmp_path / "r.json").write_text(json.dumps(doc))
    frames = T.read_report_frames(spark, str(tmp_path / "r.json")).collect()
    assert {(r["name"], r["file"], r["line"], r["parent_class"]) for r in frames} == {("main", "a.py", 3, None), ("C.run", "a.py", 9, "C")}

    store = str(tmp_path / "store")
    trees = spark.createDataFrame([("s1", 0, "a"), ("s1", 0, "b"), ("s1", 1, "c"), ("s2", 0, "d")], "scan_id string, entry_index int, name string")
    T.store_entries(trees, store)
    assert {tuple(r) for r in T.scan_summaries(spark.read.parquet(store)).collect()} == {("s1", 2, 3), ("s2", 1, 1)}
    T.delete_scan(spark, store, "s1")
    T.delete_scan(spark, store, "never")
    assert [tuple(r) for r in T.scan_summaries(spark.read.parquet(store)).collect()] == [("s2", 1, 1)]
    index = str(tmp_path / "index")
    T.write_scan_index(spark.createDataFrame([("a", 1), ("b", 2)], "path string, written_at int"), index)
    assert [r["path"] for r in spark.read.json(index).collect()] == ["b", "a"]


def test_diff_as_text(spark):
    diff = spark.createDataFrame([("A::f", "category_db", "db", 3, "regression"), ("A::f", "smell", "recursive x", -1, "improvement"), ("A::f", "complexity", "", 2, "regression")], "entry string, kind string, subject string, delta bigint, verdict string")
    assert [r["line"] for r in T.diff_text(diff).collect()] == ["worse category_db: db +3", "worse complexity: +2", "better smell: recursive x -1"]
    text = T.diff_markdown(diff, 2).first()["text"].split("\n")
    assert len(text) == 4 and text[2] == "| regression | A::f | category_db | db | 3 |"
    assert T.diff_markdown(diff.limit(0)).first()["text"] == "No changes."


def test_views_of_entries_and_languages(spark):
    matched = spark.createDataFrame([("dockerfile_cmd", "x"), ("dockerfile_entrypoint", None), ("compose_command", "x")], "kind string, symbol_id string")
    n = lambda which: T.by_entry_source(matched, which).count()
    assert [n(w) for w in ("all", "matched", "unmatched", "dockerfile", "compose_command", "none")] == [3, 2, 1, 2, 1, 0]
    assert {tuple(r) for r in T.entry_source_counts(matched).collect()} == {("dockerfile", "dockerfile_cmd", 1, 1), ("dockerfile", "dockerfile_entrypoint", 1, 0), ("compose", "compose_command", 1, 1)}
    files = spark.createDataFrame([("go", 5), ("rust", 5), ("python", 1), (None, 9)], "language string, size int")
    share = T.language_share(files)
    assert T.dominant_language(share).first()[0] == "go" and T.dominant_language(share.limit(0)).collect() == []
    assert T.language_share(files.limit(0)).collect() == []
    roots = spark.createDataFrame([("a", 3), ("b", 1)], "id string, size bigint")
    assert [r["id"] for r in G.top_by(roots, "size", ["id"], 1).collect()] == ["a"]
    assert [r["n"] for r in D.counts_by(spark.createDataFrame([("n_plus_one",), ("recursive",)], "kind string"), "kind").collect()] == [1, 1]


def test_tree_lookups_and_functions(spark):
    rows = [(["r"], [], "r", 1, 10, 2, 1), (["r", "x"], ["r"], "x", 2, 5, 5, 1), (["r", "y"], ["r"], "y", 2, 5, 5, 1), (["q"], [], "q", 1, 7, 7, 3)]
    tree = spark.createDataFrame(rows, "path array<string>, parent_path array<string>, name string, depth int, value bigint, self_value bigint, ncalls bigint").withColumns({"file": F.lit("a.py"), "line": F.lit(1), "qualname": F.lit("m.C.f"), "node_id": F.col("name")})
    assert [r["name"] for r in R.tree_children(tree, []).collect()] == ["r", "q"] and [r["name"] for r in R.tree_children(tree, ["r"]).collect()] == ["x", "y"]
    assert R.best_match(tree, F.col("depth") == 2).first()["path"] == ["r", "x"]
    assert R.report_summary(tree).first()["symbols"] == 4 and R.to_static_report(tree).first()["kind"] == "Method"
    rollup = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 9, 1)], "qualname string, ncalls bigint, cumulative_us bigint")
    assert [r["qualname"] for r in R.ordered_functions(rollup).collect()] == ["b", "a", "c"]
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(S.ns_to_iso(F.lit(1_500_000_000_000_000_000))) == "2017-07-14T02:40:00.000000Z"
    assert [one(S.human_count(F.lit(x))) for x in (950, 1234, 3_400_000)] == ["950", "1.2k", "3.4M"] and one(S.js_round(F.lit(2.5))) == 3
    assert one(P.is_internal_thread(F.lit("prof-1"), "prof-")) and not one(P.is_internal_thread(F.lit(None).cast("string"), "prof-"))
    assert one(sqlrules.infer_dialect(F.lit("postgresql"), F.lit("a.sql"), F.lit(None).cast("string"), F.lit(None).cast("string"))) in ("postgres", "postgresql")
    sql = spark.createDataFrame([("select", "full", True, False, 5, None)], "op string, projection string, has_where boolean, ordered boolean, row_limit bigint, row_offset bigint")
    assert sql.select(C.render_sql().alias("t")).first()["t"] == "SELECT * WHERE <condition> LIMIT 5" and sql.select(C.render_sql(10).alias("t")).first()["t"] == "SELECT * …"


def test_ignore_files(spark, tmp_path):
    lines = {".gitignore": "*.gen.py\n/top.py\nbuilt/\n!keep.gen.py\n# no.py\nlogs/**/x.py\n[ab]z.py\n", "sub/.gitignore": "only.py\n!top.gen.py\n"}
    for p in [*lines, "a.py", "a.gen.py", "keep.gen.py", "top.py", "sub/top.py", "built/x.py", "no.py", "logs/1/2/x.py", "logs/x.py", "az.py", "cz.py", "only.py", "sub/only.py", "sub/top.gen.py", "sub/q/only.py"]:
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(lines.get(p, "x = 1\n"))
    got = {r["path"] for r in code.read_tree(spark, str(tmp_path)).collect()}
    assert {p for p in got if p.endswith(".py")} == {"a.py", "keep.gen.py", "sub/top.py", "no.py", "cz.py", "only.py", "sub/top.gen.py"}
    (tmp_path / "q.sql").write_text("SELECT 1;")
    assert [r["content"] for r in code.read_sql_files(spark, str(tmp_path)).collect()] == ["SELECT 1;"]


def test_entries_start_symbols(spark):
    files = spark.createDataFrame([("Dockerfile", 'FROM x\nCMD ["python", "app/main.py"]\n'), ("package.json", '{"scripts": {"start": "node server.js"}}')], "path string, content string")
    symbols = spark.createDataFrame([("app/main.py::::main", "main", "Function", "app/main.py", 1)], "id string, name string, kind string, file string, line int")
    matched = manifests.match_entries(manifests.entry_declarations(files), symbols)
    assert {(r["kind"], r["symbol_id"], r["confidence"]) for r in matched.collect()} == {("dockerfile_cmd", "app/main.py::::main", "exact"), ("package_json_script", None, None)}
    roots = spark.createDataFrame([("app/main.py::::main",), ("other",)], "id string")
    assert {r["id"]: r["entry_labels"] for r in manifests.label_roots(roots, matched).collect()} == {"app/main.py::::main": ['dockerfile_cmd: ["python", "app/main.py"]'], "other": None}


def test_stream_sinks_and_progress(spark, tmp_path):
    lines = tmp_path / "in"
    lines.mkdir()
    (lines / "a.jsonl").write_text('{"type": "wall_trace", "time": "2026-01-01T00:00:01Z", "period_ns": 1000000, "count": 2, "frames": [{"name": "f"}]}\n')
    seen = []
    watch = live.Progress(lambda *e: seen.append(e))
    spark.streams.addListener(watch)
    try:
        events = live.stream_events(spark, str(lines))
        query = live.publish(live.live_functions(events), [live.snapshot_sink(str(tmp_path / "snap")), live.append_sink(str(tmp_path / "log"))], str(tmp_path / "ck"))
        assert query.awaitTermination(120)
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(watch)
    assert spark.read.parquet(str(tmp_path / "snap")).first()["qualname"] == "f"
    assert [r["ncalls"] for r in spark.read.json(str(tmp_path / "log")).collect()] == [2]
    assert {e[0] for e in seen} >= {"started", "progress"} and sum(e[3] for e in seen) == 1


def test_files_of_one_split_are_parsed_on_all_cores(spark, monkeypatch):
    """A compressed table of many small files is one split or two; parsing all of them there is what takes longest."""
    parts, plain = [], code.extract
    monkeypatch.setattr(code, "extract", lambda files: parts.append(files.rdd.glom().map(len).collect()) or plain(files))
    text = "def load_{k}(ids):\n    return ids\n\ndef handle_{k}(ids):\n    return load_{k}(ids)\n"
    files = spark.createDataFrame([(f"src/p{k}.py", text.replace("{k}", str(k))) for k in range(40)], "path string, content string").coalesce(1)
    got = A.analyze(files)
    assert len(parts) == 1 and sum(parts[0]) == 40 and max(parts[0]) < 40
    assert {(r["src"], r["dst"]) for r in got["edges"].collect()} == {(f"src/p{k}.py::::handle_{k}", f"src/p{k}.py::::load_{k}") for k in range(40)}
    assert got["roots"].count() == 40 and got["trees"].count() == 80


def test_code_analysis_of_a_one_split_table_is_spread_and_whole(spark, tmp_path, monkeypatch):
    import duckdb

    import __spark_entry__ as entry

    parts, plain = [], code.extract
    monkeypatch.setattr(code, "extract", lambda files: parts.append(files.rdd.glom().map(len).collect()) or plain(files))
    duckdb.sql(f"COPY (SELECT i * 7 AS p_partkey FROM range(32) r(i)) TO '{tmp_path}/part.parquet'")
    got = sorted(map(tuple, entry.queries()["code_analysis"](spark, str(tmp_path)).collect()))
    assert len(parts) == 1 and sum(parts[0]) == 32 and max(parts[0]) < 32
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet'")
    assert got == sorted(sql.sql(entry.oracle_sql()["code_analysis"]).fetchall())


def test_a_scan_looks_for_components_once_and_detects_in_a_small_plan(spark, monkeypatch):
    """Plans and jobs are held by the driver: none of them may be made once for each detector."""
    from stackloom.operators import findings as FD, graph

    found, plans, components, detect = [], [], graph.strong_components, FD.detect
    monkeypatch.setattr(graph, "strong_components", lambda edges: found.append(1) or components(edges))

    def watched(*args):
        got = detect(*args)
        plans.append(got._jdf.queryExecution().executedPlan().toString())
        return got

    monkeypatch.setattr(FD, "detect", watched)
    text = "import logging\nlog = logging.getLogger('a')\n\ndef load_{k}(ids):\n    for i in ids:\n        session.execute(i)\n        log.info(i)\n    return load_{k}(ids)\n"
    files = spark.createDataFrame([(f"src/p{k}.py", text.replace("{k}", str(k))) for k in range(3)], "path string, content string")
    got = A.analyze(files)["findings"].select("file", "kind", "line", "evidence").collect()
    each = [("n_plus_one", 6, ["execute"]), ("noisy_log", 7, ["info"]), ("recursive", 4, [])]
    assert sorted((r["file"], r["kind"], r["line"], r["evidence"]) for r in got) == [(f"src/p{k}.py", *x) for k in range(3) for x in each]
    assert len(found) == 1 and len(plans) == 1 and plans[0].count("Exchange ") < 20
