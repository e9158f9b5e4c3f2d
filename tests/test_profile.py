import json

import pytest
from pyspark.sql import functions as F

from stackloom.functions import predicates as P, scalar as S
from stackloom.operators import joins as J, profile as R
from stackloom.sources import events as E, stacks as K


def frame(name, file="a.py", line=1, **more):
    return {"name": name, "file": file, "line": line, **more}


def log(spark, *events):
    return E.parse_events(spark.createDataFrame([(e if isinstance(e, str) else json.dumps(e),) for e in events], "value string"))


def trace(count, *frames, kind="wall_trace", period=10_000_000, **more):
    return {"type": kind, "period_ns": period, "count": count, "frames": list(frames), **more}


def functions(spark, *events):
    return {r["qualname"]: r for r in R.function_rollup(R.stack_samples(log(spark, *events))).collect()}


def test_leaf_and_caller(spark):
    got = functions(spark, trace(5, frame("leaf"), frame("caller"), cpu=0.5))
    assert (got["leaf"]["total_us"], got["leaf"]["cumulative_us"], got["leaf"]["ncalls"], got["leaf"]["percall_us"], got["leaf"]["cpu_avg"]) == (50_000, 50_000, 5, 10_000.0, 0.5)
    assert (got["caller"]["total_us"], got["caller"]["cumulative_us"], got["caller"]["cpu_avg"]) == (0, 50_000, None)


def test_recursion_counts_inclusive_time_once_but_the_tree_each_depth(spark):
    stack = trace(7, frame("f"), frame("f"))
    got = functions(spark, stack)["f"]
    assert (got["cumulative_us"], got["total_us"]) == (70_000, 70_000)
    tree = {tuple(r["path"]): r for r in R.call_tree(R.stack_samples(log(spark, stack))).collect()}
    assert {k: (v["value"], v["self_value"], v["ncalls"]) for k, v in tree.items()} == {("f",): (70_000, 0, 0), ("f", "f"): (70_000, 70_000, 1)}


def test_weights_are_cut_per_sample_and_bad_lines_dropped(spark):
    got = functions(spark, trace(1, frame("f"), period=1999), trace(1, frame("f"), period=1999), "no json", "", {"type": "odd"}, trace(0, frame("g")), trace(3), {**trace(1, frame("h")), "count": "x"}, trace(2**60, frame("big"), period=2**40))
    assert got["f"]["total_us"] == 2 and set(got) == {"f", "big"} and got["big"]["total_us"] == (2**63 - 1) // 1000


def test_bundles_calls_and_shared_nodes(spark):
    bundle = {"type": "cpu_profile", "period_ns": 10_000_000, "samples": [{"count": 2, "frames": [frame("x")]}, {"count": -1, "frames": [frame("y")]}, {"count": 3, "frames": []}]}
    call = {"type": "function_call", "qualname": "m.C.go", "duration_ns": 12_345, "file": None, "line": 4}
    got = functions(spark, bundle, call, trace(1, frame("x")))
    assert got["x"]["total_us"] == 30_000 and got["m.C.go"]["total_us"] == 12 and set(got) == {"x", "m.C.go"}
    assert len(R.call_tree(R.stack_samples(log(spark, bundle, trace(1, frame("x"))))).collect()) == 1


def test_first_file_and_metadata(spark):
    got = functions(spark, trace(1, frame("f", None, None)), trace(1, frame("f", "b.py", 9)))
    assert (got["f"]["file"], got["f"]["line"]) == ("b.py", 9)
    meta = R.window_metadata(log(spark, {"type": "x", "time": "2026-01-01T00:00:01Z", "service": "b"}, {"type": "x", "time": 1_767_225_600_000_000_999, "service": "a", "pod": ""}, {"time": "bad", "service": "a"})).first()
    assert (meta["events"], meta["duration_us"], meta["services"], meta["pods"]) == (3, 1_000_000, ["a", "b"], [])


def test_empty_log(spark):
    assert functions(spark) == {} and R.call_tree(R.stack_samples(log(spark))).collect() == []


@pytest.mark.parametrize("own,whole,grade", [(20, 0, "critical"), (0, 60, "critical"), (19.9, 59.9, "high"), (10, 0, "high"), (0, 35, "high"), (3, 0, "medium"), (0, 15, "medium"), (2.9, 14.9, "low")])
def test_hotspot_ladder(spark, own, whole, grade):
    assert spark.range(1).select(R.hotspot_severity(F.lit(float(own)), F.lit(float(whole)))).first()[0] == grade


def test_hotspots_of_folded_lines(spark):
    lines = spark.createDataFrame([("main;db;psycopg.execute 6",), ("main;json.loads 3",), ("main;main;idle 1",), ("broken",), ("main x",), ("",)], "value string")
    got = R.hotspots(K.parse_folded(lines)).collect()
    assert [(r["rank"], r["function"], r["category"], r["severity"]) for r in got[:2]] == [(1, "psycopg.execute", "database", "critical"), (2, "json.loads", "serde", "critical")]
    assert {r["function"]: r["total_pct"] for r in got}["main"] == 100.0
    assert R.hotspots(K.parse_folded(lines.limit(0))).collect() == []


def test_speedscope(spark, tmp_path):
    doc = {"shared": {"frames": [{"name": "a"}, {"name": "b"}]}, "profiles": [{"type": "sampled", "samples": [[0, 1], [0, 9], [7], [0, 1]], "weights": [2, 3]}, {"type": "sampled", "samples": [[1]]}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    assert {tuple(r) for r in K.read_stacks(spark, str(tmp_path / "p.json")).collect()} == {("a;b", 3), ("a", 3)}


@pytest.mark.parametrize("text,passed", [("", True), ("load", True), ("name:load", True), ("file:load", False), ("file:.py", True), ("!load", False), ("!file:x.js load", True), ("! name:", True), ("LOAD", False), ("a:b", False)])
def test_frame_filter(spark, text, passed):
    row = spark.createDataFrame([("mod.load", "src/a.py")], "n string, f string")
    assert row.select(P.frame_filter(text, F.col("n"), F.col("f"))).first()[0] is passed


@pytest.mark.parametrize("file,name,qual,want", [("a.py", "m", "C.m", "a.py::C::m"), ("a.py", "m", "x.C.m", "a.py::x.C::m"), ("a.py", "i", "o.<locals>.i", "a.py::i"), (None, "m", None, "::m"), ("a.py", "m", "m", "a.py::m"), ("a.py", "m", "", "a.py::m")])
def test_node_ids(spark, file, name, qual, want):
    row = spark.createDataFrame([(file, name, qual)], "f string, n string, q string")
    assert row.select(S.node_id(F.col("f"), F.col("n"), F.col("q"))).first()[0] == want


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.size_to_bytes(F.lit("1.5MB"))) == 1_500_000 and one(S.size_to_bytes(F.lit("2KiB"))) == 2048 and one(S.size_to_bytes(F.lit("0B"))) == 0 and one(S.size_to_bytes(F.lit("x"))) == 0
    assert one(S.percent_to_double(F.lit("12.5%"))) == 12.5 and one(S.rightmost_identifier(F.lit("self.repo.session()"))) == "session"
    assert one(S.event_time_us(F.lit("-1500"))) == -2 and one(S.event_time_us(F.lit("junk"))) is None
    assert one(S.us_to_iso(F.lit(1_500_000))) == "1970-01-01T00:00:01.500000Z" and one(S.line_of_offset(F.lit("a\nb\nc"), F.lit(4))) == 3
    assert [one(P.is_test_path(F.lit(p))) for p in ("tests/a.py", "src/test_a.py", "src/UserTest.java", "src/contest.py", "src/latest/a.py", "a/UserSpecs/b.kt")] == [True, True, True, False, False, True]


def test_container_stats_and_envelopes(spark):
    line = json.dumps({"CPUPerc": "1.5%", "MemPerc": "2%", "MemUsage": "150MiB / 2GiB", "NetIO": "1kB / 2kB", "BlockIO": "bad"})
    got = E.parse_container_stats(spark.createDataFrame([(line,), ("",)], "value string")).collect()
    assert len(got) == 1 and (got[0]["cpu_pct"], got[0]["mem_mb"], got[0]["net_tx"], got[0]["block_read"], got[0]["block_write"]) == (1.5, 150.0, 2000, 0, 0)
    wire = spark.createDataFrame([(json.dumps({"type": "broadcast", "event": "event", "payload": {"a": 1}}),), (json.dumps({"type": "ping"}),)], "value string")
    assert [json.loads(r[0]) for r in E.unwrap_envelope(wire).collect()] == [{"a": 1}]


def test_fuzzy_tiers(spark):
    cols = "node_id string, name string, file string, qualified_name string, parent_class string"
    static = spark.createDataFrame([("exact", "e", "x", None, None), ("t95", "a", "f/a.py", "C.a", "C"), ("t85", "b", "z/b.py", "C.b", "C"), ("t85c", "c", "f/c.py", None, "C"), ("t70", "d", "f/d.py", None, None), ("t65", "g", "q/g.py", None, "G"), ("t50", "h", "q/h.py", None, None), ("no", "k", "other.py", None, None)], cols)
    sampled = spark.createDataFrame([("exact", "zz", "", None, None), ("1", "a", "f/a.py", "C.a", None), ("2", "b", "f/b.py", "C.b", None), ("3", "c", "f/c.py", "", "C"), ("4", "d", "f/d.py", None, "X"), ("5", "g", "f/g.py", None, "G"), ("6", "h", "f/h.py", None, None), ("7", "k", "f/k.py", None, None)], cols)
    got = {r["node_id"]: (r["static_node_id"], r["confidence"]) for r in J.fuzzy_join(sampled, static).collect()}
    assert got == {"exact": ("exact", 1.0), "1": ("t95", 0.95), "2": ("t85", 0.85), "3": ("t85c", 0.85), "4": ("t70", 0.7), "5": ("t65", 0.65), "6": ("t50", 0.5), "7": (None, None)}


def test_backfill_and_patch(spark):
    counts = spark.createDataFrame([(1, "a", 3), (1, "b", 4), (2, "a", 10)], "window_start int, name string, n bigint")
    assert {tuple(r) for r in R.backfill_windows(counts, 10).collect()} == {(1, "a", 3), (1, "b", 4), (2, "a", 10), (1, "unknown", 3)}
    base = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, a string, b int")
    assert {tuple(r) for r in J.patch(base, spark.createDataFrame([(1, None, 9)], "k int, a string, b int"), ["k"]).collect()} == {(1, "x", 9), (2, "y", 6)}
