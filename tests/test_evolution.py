import itertools
import json
from datetime import datetime

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stackloom.operators import evolution as E

FIELDS = [("k", "name", "string", False), ("k", "size", "integer", False), ("k", "at", "string", False), ("k", "box", "object", False), ("k", "box.width", "number", False), ("k", "box.note", "string", True)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("abcd"), st.sampled_from("wxyz")), st.floats(0.1, 1.0), max_size=10))
def test_assignment_is_optimal(weights):
    got = E.best_assignment([(k, f, s) for (k, f), s in weights.items()])
    assert len({k for k, _ in got}) == len(got) == len({f for _, f in got})
    best = max(sum(weights.get(p, 0) for p in zip("abcd", perm)) for perm in itertools.permutations("wxyz"))
    assert abs(sum(weights[p] for p in got) - best) < 1e-6


def files(spark, docs):
    rows = [("k", i, datetime(2025, 1, 1), d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "kind string, file_id bigint, written_at timestamp, content string")


def base(i):
    return {"name": f"item_{'abcdefgh'[i % 8]}x", "size": 1000 + i, "at": f"2025-03-{1 + i % 28:02d}T10:00:00Z", "box": {"width": i + 0.5}}


def test_renames_removals_additions_and_types(spark):
    docs = [base(i) for i in range(30)]
    docs[1]["label"] = docs[1].pop("name")
    docs[2]["carton"] = docs[2].pop("box")
    docs[3]["when"] = docs[3].pop("at")
    docs[4]["size"] = "1004"
    docs[5].pop("size")
    docs[6]["extra"] = {"deep": 1}
    docs[7]["box"]["w"] = docs[7]["box"].pop("width")
    docs[8]["name"] = None
    docs[9]["box"] = [1]
    docs[10].pop("box")
    docs += ['{"name": "cut', None, "[1]", ""]
    fields = spark.createDataFrame(FIELDS, "record_kind string, field_path string, json_type string, is_optional boolean")
    cells, changes = E.resolve(files(spark, docs), fields)
    got = {(r["file_id"], r["field_path"], r["change_kind"]) for r in changes.collect()}
    assert got == {
        (1, "name", "renamed"), (2, "box", "renamed"), (3, "at", "renamed"), (4, "size", "retyped"), (5, "size", "removed"), (6, "extra", "added"), (7, "box.width", "renamed"), (9, "box", "retyped"),
        (10, "box", "removed"), (10, "box.width", "removed"),
    }
    table = {r["file_id"]: r for r in E.unify(files(spark, docs), cells, fields, "k").collect()}
    assert table[1]["name"] == docs[1]["label"] and table[2]["box_width"] == docs[2]["carton"]["width"] and table[4]["size"] == 1004
    assert json.loads(table[6]["other"]["extra"]) == {"deep": 1} and table[9]["box"] is None and json.loads(table[9]["other"]["box"]) == [1]
    assert len(table) == 30
    places = {r["file_id"]: r["places"] for r in E.field_places(cells, "k", ["name"]).collect()}
    assert places[1] == {"name": "label"} and places[2] == {"name": "name"}


def test_last_readable_delivery_counts(spark):
    rows = [("k", 1, datetime(2025, 1, 2), json.dumps({**base(1), "odd": 1})), ("k", 1, datetime(2025, 1, 1), json.dumps(base(1))), ("k", 1, datetime(2025, 1, 3), "{")]
    df = spark.createDataFrame(rows, "kind string, file_id bigint, written_at timestamp, content string")
    fields = spark.createDataFrame(FIELDS, "record_kind string, field_path string, json_type string, is_optional boolean")
    _, changes = E.resolve(df.withColumn("key", F.lit(1)), fields)
    assert [tuple(r) for r in changes.collect()] == [("k", 1, "odd", "added")]
    _, none = E.resolve(df.limit(0), fields)
    assert none.collect() == []


def test_old_and_new_key_side_by_side(spark):
    fields = spark.createDataFrame([*FIELDS, ("k", "savedAt", "string", False)], "record_kind string, field_path string, json_type string, is_optional boolean")
    for new in (0, 60):
        docs = [{**base(i), "savedAt": f"2024-05-{1 + i % 28:02d}T09:00:00Z"} for i in range(100 + new)]
        for i in range(100):
            docs[i]["saved_at"] = docs[i]["savedAt"] if i < 10 else docs[i].pop("savedAt")
        cells, changes = E.resolve(files(spark, docs), fields)
        got = {(r["file_id"], r["field_path"], r["change_kind"]) for r in changes.collect()}
        assert got == {(i, "saved_at", "added") for i in range(10)} | {(i, "savedAt", "renamed") for i in range(10, 100)}
        places = {r["file_id"]: r["places"]["savedAt"] for r in E.field_places(cells, "k", ["savedAt"]).collect()}
        assert all(places[i] == ("saved_at" if 10 <= i < 100 else "savedAt") for i in range(100 + new))


def test_an_added_key_beside_a_field_is_no_rename(spark):
    docs = [{**base(i), "remark": f"note {i}"} for i in range(60)]
    for i in range(5):
        docs[i].pop("name")
    fields = spark.createDataFrame(FIELDS, "record_kind string, field_path string, json_type string, is_optional boolean")
    _, changes = E.resolve(files(spark, docs), fields)
    assert {r["field_path"] for r in changes.collect() if r["change_kind"] == "renamed"} == set()


def test_values_that_differ_only_late_are_told_apart(spark):
    """Two text fields with one opening of 300 characters, renamed to names that say nothing: only what follows tells which is which."""
    opening = "the worker reads the table again and again " * 8
    tails = {"one": "copper zinc nickel", "two": "oak birch maple"}
    listed = [*FIELDS, ("k", "one", "string", False), ("k", "two", "string", False)]
    docs = [{**base(i), **{f: f"{opening} {i} " + " ".join([t] * 30) for f, t in tails.items()}} for i in range(60)]
    for i in range(20):
        docs[i] = {{"one": "x17", "two": "x18"}.get(k, k): v for k, v in docs[i].items()}
    fields = spark.createDataFrame(listed, "record_kind string, field_path string, json_type string, is_optional boolean")
    cells, changes = E.resolve(files(spark, docs), fields)
    assert {(r["file_id"], r["field_path"], r["change_kind"]) for r in changes.collect()} == {(i, f, "renamed") for i in range(20) for f in tails}
    places = E.field_places(cells, "k", ["one", "two"]).filter("file_id = 3").first()["places"]
    assert places == {"one": "x17", "two": "x18"}
    a, b = E._sketch([1, 2, 3, {"tail": 1}]), E._sketch([1, 2, 3, {"other": 1}])
    assert a != b and len(E._sketch(" ".join(map(str, range(100_000))))) <= E.SKETCH_WIDTH


def test_one_rule_for_the_delivery_that_counts(spark):
    day = lambda d: datetime(2025, 1, d)
    rows = [("k", 1, day(1), '{"name": "a"}'), ("k", 1, day(2), "[1,2]"), ("k", 2, day(1), '{"name": "b"}'), ("k", 2, day(1), '{"name": "c"}'), ("k", 3, None, '{"name": "d"}'), ("k", 3, day(3), "{"), ("k", None, day(3), "{}")]
    df = spark.createDataFrame(rows, "kind string, file_id bigint, written_at timestamp, content string")
    fields = spark.createDataFrame(FIELDS[:1], "record_kind string, field_path string, json_type string, is_optional boolean")
    cells, _ = E.resolve(df, fields)
    table = {r["file_id"]: r["name"] for r in E.unify(df, cells, fields, "k").collect()}
    last = {r["file_id"]: json.loads(r["content"])["name"] for r in E.last_readable(df).collect()}
    assert table == last and table[1] == "a" and table[2] in ("b", "c") and table[3] == "d"


def test_conversions_keep_what_they_cannot_give_back():
    assert E._convert(["a\nb", "c"], "string") == (None, False) and E._convert(["a", "b"], "string") == ("a\nb", True)
    assert E._convert({"k": "x"}, "string") == ('{"k": "x"}', True)
    assert E._convert("5%", "number") == E._convert("1,5", "number") == E._convert("v3", "integer") == E._convert("05", "integer") == E._convert(True, "integer") == (None, False)
    assert E._convert("5", "number") == (5.0, True) and E._convert("5.5", "number") == (5.5, True) and E._convert("-7", "integer") == (-7, True) and E._convert(5, "number") == (5.0, True)
    assert E._convert(2**63, "integer") == E._convert(2**60 + 1, "number") == E._convert(5.5, "integer") == E._convert("nan", "number") == (None, False)
    assert E._convert("a,b", "array") == ('["a", "b"]', True) and E._convert([1], "object") == (None, False) and E._convert(None, "string") == (None, True)


def test_json_deeper_than_the_call_stack(spark):
    from stackloom.functions import json_text as J

    deep = '{"name": "deep", "size": 1, "at": "x", "box": {"width": 1.5}, "odd": ' + "[" * 60_000 + "]" * 60_000 + "}"
    assert J.dump(J.load(deep)) == deep.replace('"odd": ', '"odd": ')
    for text in ('{"a": [1, {"b": null}, "x\\"y"], "c": {}}', "[]", "3", '"s"', "[1, [2, [3]]]", "true"):
        assert J._load_deep(text) == json.loads(text)
    for bad in ("", "{", "[1,]", '{"a"}', '{"a":}', "[1 2]", "[}", '{"a": 1]', "1 2", '{,}'):
        try:
            J._load_deep(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    docs = [base(i) for i in range(20)] + [deep]
    fields = spark.createDataFrame(FIELDS, "record_kind string, field_path string, json_type string, is_optional boolean")
    cells, changes = E.resolve(files(spark, docs), fields)
    assert [tuple(r) for r in changes.collect()] == [("k", 20, "odd", "added")]
    assert len(E.unify(files(spark, docs), cells, fields, "k").filter("file_id = 20").first()["other"]["odd"]) == 120_000
