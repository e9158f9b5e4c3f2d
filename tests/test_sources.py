import json
import time

import pytest
from pyspark.sql import functions as F

from stackloom.operators import graph, reports
from stackloom.sources import code, events as E, manifests as M
from stackloom.streaming import live


def test_event_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"x","time":1767225600000000000,"count":2}\n\nnot json\n{"type":"y","time":"2026-01-01T00:00:00Z","count":1.5}\n{"type":"z"}\n')
    (tmp_path / "b.txt").write_text("no log")
    got = E.read_events(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r["type"], r["time"]) for r in got] == [("x", "1767225600000000000"), ("z", None)]
    assert [r["path"].rsplit("/", 1)[1] for r in E.log_catalog(spark, str(tmp_path)).collect()] == ["a.jsonl"]


def test_metadata_and_violations(spark):
    rows = spark.createDataFrame([("l", 2, "profile_metadata"), ("l", 1, "profile_metadata"), ("m", 1, "wall_trace"), ("m", 2, "profile_metadata")], "log_id string, line_no int, type string")
    assert [r["log_id"] for r in E.log_metadata(rows).collect()] == ["l"]
    log = E.parse_events(spark.createDataFrame([(json.dumps({"type": "wall_trace", "time": "t", "count": 0}),), (json.dumps({"type": "function_call", "time": "t", "qualname": "q", "duration_ns": 1, "status": "ok"}),)], "value string"))
    assert sorted(r["violations"] for r in E.event_violations(log).collect()) == [[], ["period_ns", "count", "frames"]]


def test_source_tree_to_graph(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "static").mkdir()
    (tmp_path / "src" / "app.py").write_text("import requests\ndef main():\n    for i in range(3):\n        load(i)\n\ndef load(i):\n    return requests.get(i)\n")
    (tmp_path / "src" / "big.js").write_text("x" * 300_000)
    for d in ("node_modules", "static"):
        (tmp_path / d / "x.py").write_text("def f():\n    pass\n")
    files = code.read_tree(spark, str(tmp_path))
    assert {r["path"] for r in files.collect()} == {"src/app.py"}
    records = code.extract(files).cache()
    symbols = graph.parent_symbols(code.symbols(records)).withColumn("id", graph.symbol_id(F.col("file"), F.col("parent"), F.col("name")))
    sourced = graph.source_ids(graph.enclosing_symbols(code.references(records), symbols), symbols)
    edges = graph.resolve_edges(sourced, symbols)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("src/app.py::::main", "src/app.py::::load")}
    assert [(r["name"], r["reach"]) for r in graph.discover_roots(symbols, edges).collect()] == [("main", 2)]
    share = reports.language_share(files).first()
    assert (share["language"], share["percent"]) == ("python", 100.0)


FILES = [
    ("Dockerfile", 'FROM x\nWORKDIR /app\n# c\nCMD ["python", "-m", \\\n  "pkg.app"]\nENTRYPOINT run.sh --fast "a b"\n'),
    ("docker-compose.yml", "services:\n  web:\n    image: x\n    command: python src/main.py\n  job:\n    entrypoint:\n      - node\n      - ./cli.js\nvolumes:\n  command: no\n"),
    ("package.json", json.dumps({"main": "./cli.js", "bin": {"go": "bin/go.js"}, "scripts": {"start": "node cli.js"}})),
    ("deno.jsonc", '{ // c\n "tasks": {"dev": "deno run // x", /* y */ }, }'),
    ("pyproject.toml", '[project.scripts]\nrun = "pkg.app:serve"\n'), ("Cargo.toml", '[[bin]]\nname = "tool"\n'), ("bad/package.json", "{"), ("README.md", "CMD x"),
]


def test_entry_declarations(spark):
    got = M.entry_declarations(spark.createDataFrame(FILES, "path string, content string"))
    rows = {(r["kind"], r["service"]): (r["argv"], r["workdir"]) for r in got.collect()}
    assert rows == {
        ("dockerfile_cmd", None): (["python", "-m", "pkg.app"], "/app"), ("dockerfile_entrypoint", None): (["run.sh", "--fast", "a b"], "/app"), ("compose_command", "web"): (["python", "src/main.py"], None),
        ("compose_entrypoint", "job"): (["node", "./cli.js"], None), ("package_json_main", None): (["./cli.js"], None), ("package_json_bin", "go"): (["bin/go.js"], None), ("package_json_script", "start"): (["node", "cli.js"], None),
        ("deno_task", "dev"): (["deno", "run", "//", "x"], None), ("pyproject_script", "run"): (["pkg.app:serve"], None), ("cargo_bin", "tool"): (["src/bin/tool.rs"], None),
    }
    symbols = spark.createDataFrame([("1", "main", "Function", "web/src/main.py", 5), ("2", "zz", "Function", "web/src/main.py", 1), ("3", "serve", "Function", "lib/pkg/app.py", 9), ("4", "app", "Function", "lib/pkg/app.py", 3), ("5", "x", "Function", "cli.js", 1)], "id string, name string, kind string, file string, line int")
    matched = M.match_entries(got, symbols)
    assert {(r["kind"], r["symbol_name"], r["confidence"]) for r in matched.filter("symbol_id IS NOT NULL").collect()} == {
        ("compose_command", "main", "exact"), ("dockerfile_cmd", "app", "likely"), ("pyproject_script", "serve", "exact"), ("compose_entrypoint", "x", "exact"), ("package_json_main", "x", "exact"), ("package_json_script", "x", "exact"),
    }
    assert matched.count() == got.count()
    labels = {r["id"]: r["entry_labels"] for r in M.label_roots(symbols.select("id"), matched).collect()}
    assert labels["3"] == ["pyproject_script: pkg.app:serve"] and labels["2"] is None


def test_stored_entries_and_compact_frames(spark, tmp_path):
    trees = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("t", 0, "c")], "scan_id string, entry_index int, id string")
    path = str(tmp_path / "store")
    reports.store_entries(trees, path)
    reports.store_entries(spark.createDataFrame([("s", 1, "new")], "scan_id string, entry_index int, id string"), path)
    assert [r["id"] for r in reports.load_entry(spark, path, "s", 1).collect()] == ["new"] and [r["id"] for r in reports.load_entry(spark, path, "t", 0).collect()] == ["c"]
    (tmp_path / "r.json").write_text(json.dumps({"schema_version": "1.1", "string_table": ["", "run", "a.py"], "frames": [{"name": 1, "file": 2, "line": 3, "parent_class": 0, "kind": 9}]}))
    row = reports.read_report_frames(spark, str(tmp_path / "r.json")).first()
    assert (row["name"], row["file"], row["parent_class"], row["kind"]) == ("run", "a.py", "", None)


def test_streams_equal_batches(spark, tmp_path):
    lines = [json.dumps({"type": "wall_trace", "time": f"2026-01-01T00:00:{i:02d}Z", "period_ns": 10_000_000, "count": 1 + i % 3, "frames": [{"name": f"f{i % 4}", "file": "a", "line": 1}, {"name": "main"}]}) for i in range(40)]
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(4):
        (folder / f"{n}.jsonl").write_text("\n".join(lines[n * 10 : n * 10 + 10]))
    events = live.stream_events(spark, str(folder), 1)
    seen = []

    def broken(batch, number):
        seen.append(number)
        raise ValueError("a failing sink")

    live.publish(live.live_functions(events), [broken, live.snapshot_sink(str(tmp_path / "out"))], str(tmp_path / "c1")).awaitTermination(120)
    batch = live.live_functions(E.read_events(spark, str(folder)))
    key = lambda df: sorted((r["qualname"], r["ncalls"], r["total_us"], r["cumulative_us"]) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch) and len(seen) >= 4
    live.publish(live.live_windows(events), [live.snapshot_sink(str(tmp_path / "win"))], str(tmp_path / "c2")).awaitTermination(120)
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "win")).collect()) == [10, 10, 10, 10]
    live.publish(events.select("time", "type"), [live.ring_sink(str(tmp_path / "ring"), 12)], str(tmp_path / "c3"), "append").awaitTermination(120)
    last = max((int(p.name) for p in (tmp_path / "ring").iterdir()))
    assert spark.read.parquet(str(tmp_path / "ring" / str(last))).count() == 12
    live.stop_all(spark)
    assert time.time() and [r["place"] for r in live.last_lines(batch, 2, ["qualname"]).collect()] == [1, 2]


def test_empty_inputs(spark):
    assert code.extract(spark.createDataFrame([], "path string, content string")).collect() == []
    with pytest.raises(Exception):
        E.read_events(spark, "/nowhere/at/all").collect()
