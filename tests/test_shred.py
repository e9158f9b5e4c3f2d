import json
import random

from stackloom.operators import shred as S


def test_list_levels_rebuild_all_rows(spark):
    rnd = random.Random(1)
    inner = lambda: rnd.choice([None, [], [{"a": 1, "b": "x"}], [{"a": 2, "b": None}, None, {"a": 3, "b": "z"}]])
    rows = [(str(i), rnd.choice([None, [], [{"n": 1, "fs": inner()} if rnd.random() < 0.9 else None for _ in range(rnd.randint(1, 5))]])) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, s array<struct<n:int,fs:array<struct<a:int,b:string>>>>")
    want = set()
    for i, s in rows:
        for j, x in enumerate(s or []):
            if x is not None:
                want.add((i, "s", str(j), None, (("n", str(x["n"])),)))
                for k, f in enumerate(x["fs"] or []):
                    if f is not None:
                        want.add((i, "f", f"{j}.{k}", str(j), tuple(sorted((a, str(b)) for a, b in f.items() if b is not None))))
    got = S.shred_lists(df, "id", "s", "fs", "s", "f").collect()
    assert {(r[0], r[1], r[2], r[3], tuple(sorted(r[4].items()))) for r in got} == want and len(got) == len(want)
    assert S.shred_lists(df.limit(0), "id", "s", "fs", "s", "f").collect() == []


ENTITIES = (S.Entity("node", (("es",), ("entries",)), recursive="kids"), S.Entity("find", (("f",),), "node"))


def walk(tree, at, out):
    for j, x in enumerate(tree or []):
        if isinstance(x, dict):
            here = [*at, str(j)]
            out.add(("node", ".".join(here)))
            out |= {("find", ".".join([*here, str(k)])) for k, f in enumerate(x.get("f") or []) if isinstance(f, dict)}
            walk(x.get("kids"), here, out)


def test_recursive_json_rebuilds_all_rows(spark):
    rnd = random.Random(2)

    def tree(d):
        return [{"n": d, "kids": rnd.choice([None, [], tree(d + 1)]) if d < 4 else [], "f": rnd.choice([[], [{"k": 1}, 7, {"k": 2}], None])} if rnd.random() < 0.9 else None for _ in range(rnd.randint(1, 3))]

    docs = [{rnd.choice(["es", "entries"]): tree(0)} for _ in range(150)]
    rows = [(str(i), json.dumps(d)) for i, d in enumerate(docs)] + [("bad", '{"es":['), ("none", None), ("list", "[1]")]
    got = S.shred_files(spark.createDataFrame(rows, "id string, t string"), "id", "t", ENTITIES).collect()
    want = set()
    for i, d in enumerate(docs):
        out: set = set()
        walk(next(iter(d.values())), [], out)
        want |= {(str(i), *x) for x in out}
    assert {(r["record_id"], r["entity"], r["row_path"]) for r in got} == want and len(got) == len(want)


def test_deep_tree_needs_no_recursion():
    doc = node = {}
    for _ in range(400):
        node["es"] = [{}]
        node = node["es"][0]
    rows = list(S.reassemble(S.shred_json(doc, (S.Entity("n", (("es",),), recursive="es"),))))
    assert len(rows) == 400 and max(rows, key=lambda r: len(r[1]))[1] == ".".join(["0"] * 400)


def test_pooled_report_is_written_out():
    doc = {"report": {"string_table": ["", "run", "a.py", "slow"], "frames": [{"name": 1, "file": 2, "line": 5}], "entries": [{"frame": 0, "findings": [{"kind": 3}], "children": [{"frame": 9}]}]}}
    got = json.loads(S.expand_report(json.dumps(doc)))["report"]["entries"][0]
    assert (got["name"], got["file"], got["line"], got["findings"][0]["kind"], got["children"]) == ("run", "a.py", 5, "slow", [{}])
    assert S.expand_report("{") == "{"
