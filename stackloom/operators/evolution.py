"""Files whose JSON fields change: find renames, unify the files, report each deviation.

Every file is profiled object by object (keys, JSON types, hashed value
features). Per parent path the keys that are not listed are scored against the
listed fields by value sketch, type, name similarity and by how surprising it is
that the key stands where the field is missing and not beside it. For each version of an object, that is
each set of keys found, a maximum-weight bipartite matching between its unlisted
keys and the listed fields it lacks decides which keys are renamed fields.
Parents are resolved before their children, so fields beneath a renamed object
are compared under their listed paths.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stackloom.functions import json_text
from stackloom.session import materialize

#: Width of the hashed value sketch of a key.
SKETCH_WIDTH = 4096
#: Pairs of a key and a listed field from this score on may be matched.
MIN_SCORE = 0.6
#: Weights of value sketch, JSON type, name and exclusion in a pair's score.
WEIGHTS = (0.35, 0.15, 0.2, 0.3)

_NUMBER = re.compile(r"^[vV]?-?[0-9][0-9,]*(\.[0-9]+)?%?$")
#: Weight of one feature; the words of a text and the elements of an array share a fixed number of these.
UNIT, WORD_UNITS, ELEMENT_UNITS = 1000, 4, 5
_OBJS = "array<struct<parent: string, cells: array<struct<key: string, type: string, feats: array<struct<slot: int, weight: bigint>>>>>>"


def _json_type(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "number"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def _shared_out(counts: Counter, units: int) -> dict[str, int]:
    """Features that share ``units``, each by how often it occurs; none is left out."""
    n = max(sum(counts.values()), 1)
    return {f: max(1, units * UNIT * c // n) for f, c in counts.items()}


def _features(v: object) -> dict[str, int]:
    """What a whole value looks like, whether or not it is quoted: features with their weights."""
    if v is None:
        return {}
    if isinstance(v, bool):
        return {"b": UNIT}
    if isinstance(v, (int, float)):
        size = int(abs(v)).bit_length() if abs(v) < 1e300 else 1000
        return {f"n{'-' if v < 0 else ''}{size}": UNIT} | ({"frac": UNIT} if isinstance(v, float) and v != int(v or 0) else {})
    if isinstance(v, str):
        if len(v) <= 24 and _NUMBER.match(v):
            try:
                text = v.strip("vV%").replace(",", "")
                return _features(float(text) if "." in text else int(text)) | {f"v{v}": UNIT}
            except ValueError:
                pass
        shape = re.sub(r"\s+", " ", re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", v)))
        if len(shape) > 24 or shape.count(" ") > 3:
            words = Counter(v.lower().split())
            return {"text": 2 * UNIT, f"l{len(v).bit_length()}": UNIT} | {f"w{w}": n for w, n in _shared_out(words, WORD_UNITS).items()}
        start = re.sub(r"\W+", "-", shape)[:5]
        return {f"p{shape}": UNIT, f"q{start}": 2 * UNIT} | ({} if "9" in shape else {f"v{v}": UNIT})
    if isinstance(v, list):
        if not v:
            return {"empty": UNIT}
        inner, todo = Counter(), list(v)
        while todo:  # arrays in arrays of any depth
            x = todo.pop()
            if isinstance(x, list):
                todo += x
            inner.update(f"e{_json_type(x)}:{f}" for f in (x if isinstance(x, dict) else ["-"] if isinstance(x, list) else _features(x)))
        return {"list": UNIT} | _shared_out(inner, ELEMENT_UNITS)
    return {f"k{k}": UNIT for k in v} or {"empty": UNIT}


def _sketch(v: object) -> Counter:
    """Weights by slot: at most SKETCH_WIDTH entries, however long the value is."""
    out: Counter = Counter()
    for f, n in _features(v).items():
        out[zlib.crc32(f.encode("utf-8", "replace")) % SKETCH_WIDTH] += n
    return out


def _objects(value: dict, parent: str = "") -> Iterator[tuple[str, dict]]:
    """Every object that is reached without entering an array, with its path."""
    todo = [(parent, value)]
    while todo:
        path, obj = todo.pop()
        yield path, obj
        todo += [(f"{path}.{k}" if path else k, v) for k, v in obj.items() if isinstance(v, dict)]


def _load(text: str | None) -> dict | None:
    try:
        got = json_text.load(text) if text else None
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def _deliveries(files: DataFrame) -> DataFrame:
    """kind, file_id, written_at, tie, content: of two deliveries the later one counts, of equally late ones that with the larger hash."""
    at = F.coalesce(F.col("written_at").cast("timestamp"), F.timestamp_micros(F.lit(-(2**60))))
    return files.filter("content IS NOT NULL").select("kind", "file_id", at.alias("written_at"), F.xxhash64("content").alias("tie"), "content")


def last_readable(files: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """kind, file_id, content[, beside] of the last delivery of each file that is a JSON object: the rule of all that reads files here.

    Contents are moved once, to their file's other deliveries. ``beside`` (kind,
    file_id, beside; one row a file) is moved with them instead of being joined
    afterwards; a file without such a row has null.
    """
    more = beside is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: tuple | None = None
        held: tuple = (None, None)
        for pdf in batches:
            keep, own = [], []
            for kind, file_id, text, value in zip(pdf["kind"], pdf["file_id"], pdf["content"], pdf["beside"] if more else pdf["kind"]):
                key = (kind, file_id)
                if text is None:  # stands before the deliveries of its file
                    held = (key, value)
                good = key != done and _load(text) is not None
                done = key if good else done
                keep.append(good)
                own.append(held[1] if held[0] == key else None)
            if more:
                pdf = pdf.assign(beside=pd.Series(own, index=pdf.index, dtype=object))
            yield pdf[keep]

    rows = _deliveries(files).withColumn("file_id", F.col("file_id").cast("bigint"))
    columns, schema = ["kind", "file_id", "content"], "kind string, file_id bigint, content string"
    if more:
        shape = beside.schema["beside"].dataType
        rows = rows.withColumn("beside", F.lit(None).cast(shape)).unionByName(beside.select("kind", "file_id", "beside"), allowMissingColumns=True)
        columns, schema = [*columns, "beside"], f"{schema}, beside {shape.simpleString()}"
    rows = rows.filter("kind IS NOT NULL AND file_id IS NOT NULL")
    # an explicit number keeps the partitions apart: they are small in bytes, but parsing them takes long
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    order = ["kind", "file_id", F.col("content").isNotNull(), F.desc("written_at"), F.desc("tie")]
    return rows.repartition(parts, "kind", "file_id").sortWithinPartitions(*order).select(*columns).mapInPandas(run, schema)


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.array(sizes, np.int64))], pa.int32()), values)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nested result is put together from flat lists and their lengths."""
    for batch in batches:
        kept, objects, cells, feats = [], [], [], []
        parents, keys, types, slots, weights = [], [], [], [], []
        for row, text in enumerate(batch.column("content").to_pylist()):
            value = _load(text)
            if value is None:
                continue
            kept.append(row)
            n = 0
            for n, (path, obj) in enumerate(_objects(value), 1):
                parents.append(path)
                cells.append(len(obj) + 1)
                keys.append("")  # stands once in every object and so counts them
                types.append("")
                feats.append(0)
                for k, v in obj.items():
                    sketch = _sketch(v)
                    keys.append(k)
                    types.append(_json_type(v))
                    feats.append(len(sketch))
                    slots += sketch.keys()
                    weights += sketch.values()
            objects.append(n)
        if not kept:
            continue
        features = _lists(feats, pa.StructArray.from_arrays([pa.array(slots, pa.int32()), pa.array(weights, pa.int64())], ["slot", "weight"]))
        clean = [k.encode("utf-8", "replace").decode() for k in keys]
        inner = _lists(cells, pa.StructArray.from_arrays([pa.array(clean, pa.string()), pa.array(types, pa.string()), features], ["key", "type", "feats"]))
        paths = pa.array([p.encode("utf-8", "replace").decode() for p in parents], pa.string())
        objs = _lists(objects, pa.StructArray.from_arrays([paths, inner], ["parent", "cells"]))
        rest = batch.select(["kind", "file_id", "written_at", "tie"]).take(pa.array(kept))
        yield pa.RecordBatch.from_arrays([*rest.columns, objs], names=["kind", "file_id", "written_at", "tie", "objs"])


def profile_files(files: DataFrame) -> DataFrame:
    """kind, file_id, objs: of each readable file the keys of its objects; one row a file.

    ``files`` has kind, file_id, written_at, content. Only the compact profile is
    shuffled to find the last delivery of a file, not its content; it is the one
    that ``last_readable`` takes. Files that are not a JSON object, or null, are
    left out.
    """
    made = _deliveries(files).mapInArrow(_profile, f"kind string, file_id bigint, written_at timestamp, tie bigint, objs {_OBJS}")
    return made.filter("kind IS NOT NULL AND file_id IS NOT NULL").groupBy("kind", "file_id").agg(F.max_by("objs", F.struct("written_at", "tie")).alias("objs"))


def _name_similarity(a: str, b: str) -> float:
    ta, tb = ([t.lower() for t in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", x)] for x in (a, b))
    ja, jb = "".join(ta), "".join(tb)
    if ja == jb:
        return 1.0
    both = set(ta) & set(tb)
    overlap = len(both) / max(len(set(ta) | set(tb)), 1)
    short, long_ = sorted((ja, jb), key=len)
    it = iter(long_)
    abbreviated = bool(short) and short[0] == long_[0] and all(c in it for c in short)
    return max(overlap, 0.7 if abbreviated else 0.0, SequenceMatcher(None, ja, jb).ratio() * 0.8)


@F.pandas_udf(T.StructType([T.StructField("sketch", T.DoubleType()), T.StructField("name", T.DoubleType())]))
def _likeness(key: pd.Series, leaf: pd.Series, sketch: pd.Series, own: pd.Series) -> pd.DataFrame:
    def shared(p: list | None, q: list | None) -> float:
        if p is None or q is None or not len(p) or not len(q):
            return 0.0
        left, right = Counter(), Counter()
        for counts, entries in ((left, p), (right, q)):
            for x in entries:  # a feature stands once for each type it occurred in
                counts[x["slot"]] += x["weight"]
        n, m = sum(left.values()), sum(right.values())
        return sum(min(v / n, right[f] / m) for f, v in left.items() if f in right)

    return pd.DataFrame({"sketch": [shared(p, q) for p, q in zip(sketch, own)], "name": [_name_similarity(x, y) for x, y in zip(key, leaf)]}, dtype="float64")


def best_assignment(pairs: list[tuple[str, str, float]]) -> list[tuple[str, str]]:
    """Maximum-weight bipartite matching of (key, field, score > 0) pairs, by successive best augmenting paths."""
    keys = sorted({p[0] for p in pairs})
    fields = sorted({p[1] for p in pairs})
    n, m = len(keys), len(fields)
    size = max(n, m)
    cost = [[0.0] * (size + 1) for _ in range(size + 1)]
    for k, f, s in pairs:
        cost[keys.index(k) + 1][fields.index(f) + 1] = -s
    u, v, match = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1)
    for row in range(1, size + 1):
        match[0], col = row, 0
        slack, back, seen = [float("inf")] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        while True:
            seen[col] = True
            at, delta, nxt = match[col], float("inf"), 0
            for j in range(1, size + 1):
                if not seen[j]:
                    reduced = cost[at][j] - u[at] - v[j]
                    if reduced < slack[j]:
                        slack[j], back[j] = reduced, col
                    if slack[j] < delta:
                        delta, nxt = slack[j], j
            for j in range(size + 1):
                if seen[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    slack[j] -= delta
            col = nxt
            if match[col] == 0:
                break
        while col:
            match[col] = match[back[col]]
            col = back[col]
    return [(keys[match[j] - 1], fields[j - 1]) for j in range(1, m + 1) if match[j] <= n and cost[match[j]][j] < 0]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("leaf", T.StringType())])))
def _assign(pairs: pd.Series) -> pd.Series:
    return pd.Series([[{"key": k, "leaf": f} for k, f in best_assignment([(p["key"], p["leaf"], p["score"]) for p in ps])] for ps in pairs])


def _listed(fields: DataFrame) -> DataFrame:
    split = fields.filter("record_kind IS NOT NULL AND field_path IS NOT NULL").dropDuplicates(["record_kind", "field_path"]).select(
        F.col("record_kind").alias("kind"),
        F.when(F.instr("field_path", ".") > 0, F.regexp_replace("field_path", r"\.[^.]*$", "")).otherwise("").alias("canon"),
        F.substring_index("field_path", ".", -1).alias("leaf"),
        "field_path",
        "json_type",
        F.coalesce("is_optional", F.lit(False)).alias("is_optional"),
    )
    inner = split.select("kind", F.col("canon").alias("field_path"), F.lit(True).alias("has_fields")).distinct()
    return split.join(inner, ["kind", "field_path"], "left").fillna(False, ["has_fields"])


def _pair_scores(objs: DataFrame, listed: DataFrame) -> DataFrame:
    """kind, canon, key, leaf, score of the pairs that may be matched.

    A key's profile is one row: its objects, usual type and value sketch, which has
    at most SKETCH_WIDTH entries. The pseudo key '' stands once in every object and
    so counts them.
    """
    here = ["kind", "canon"]
    cells = objs.select(*here, F.explode("cells").alias("c")).select(*here, "c.*")
    one = F.array(F.struct(F.lit(-1).alias("slot"), F.lit(1).cast("bigint").alias("weight")))
    feats = cells.select(*here, "key", "type", F.explode(F.concat("feats", one)).alias("f")).groupBy(*here, "key", "type", F.col("f.slot").alias("slot")).agg(F.sum("f.weight").alias("weight"))
    # slot -1 is given once a cell: its weight is the number of cells
    marked = F.col("slot") == -1
    profiles = feats.groupBy(*here, "key").agg(
        F.sum(F.when(marked, F.col("weight"))).alias("n"),
        F.max_by("type", F.when(marked, F.struct("weight", "type"))).alias("type"),
        F.collect_list(F.when(~marked, F.struct("slot", "weight"))).alias("sketch"),
    )
    profiles = materialize(profiles, "profiles")
    leaves = listed.select(*here, "leaf", "json_type")
    own = profiles.select(*here, F.col("key").alias("leaf"), F.col("n").alias("own_n"), F.col("sketch").alias("own_sketch"))
    fields = leaves.join(own, [*here, "leaf"], "left").join(profiles.filter("key = ''").select(*here, F.col("n").alias("objects")), here)
    together = objs.select(*here, F.explode("unlisted").alias("key"), "present")
    together = together.select(*here, "key", F.explode("present").alias("leaf")).groupBy(*here, "key", "leaf").agg(F.count("*").alias("together"))
    unlisted = profiles.filter("key <> ''").join(leaves.select(*here, F.col("leaf").alias("key")), [*here, "key"], "left_anti")
    pairs = unlisted.join(fields, here).join(together, [*here, "key", "leaf"], "left").fillna(0, ["own_n", "together"]).filter("together < n")  # else no version lacks the field
    same = (F.col("type") == F.col("json_type")) | ((F.col("type") == "integer") & (F.col("json_type") == "number"))
    a, b, c, d = WEIGHTS
    # writers may give the old and the new key side by side for a while: that lowers the exclusion by how much the key is as usual beside the field as without it
    beside, without = F.col("together") / F.greatest("own_n", F.lit(1)), (F.col("n") - F.col("together")) / F.greatest(F.col("objects") - F.col("own_n"), F.lit(1))
    apart = (1 - F.pow(F.lit(1.0) - F.col("own_n") / F.col("objects"), F.col("n"))) * F.greatest(F.lit(0.0), 1 - beside / without)
    got = pairs.withColumn("like", _likeness("key", "leaf", "sketch", "own_sketch"))
    seen = a * F.col("like.sketch") + b * same.cast("double") + c * F.col("like.name") + d * apart
    unseen = 0.3 * same.cast("double") + 0.7 * F.col("like.name")  # nothing to compare values with
    scored = got.withColumn("score", F.when(F.col("own_n") > 0, seen).otherwise(unseen))
    return scored.filter(F.col("score") >= MIN_SCORE).select(*here, "key", "leaf", "score")


def resolve(files: DataFrame, fields: DataFrame, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Which key of which file carries which listed field, and every deviation; with ``only``, of the objects on the way to these fields.

    ``files``: kind, file_id, written_at, content. ``fields``: record_kind,
    field_path, json_type, is_optional. Returns

    * cells: kind, file_id, raw_path, field_path (null for an added key), type
    * changes: kind, file_id, field_path, change_kind ('renamed', 'removed',
      'added', 'retyped')

    Defined cases: unreadable files give nothing; of repeated deliveries the last
    counts; a null value is never retyped; what lies inside arrays, added keys,
    retyped values and listed objects without listed fields is not compared; the
    fields beneath a removed object are removed as well; an empty table of files
    gives no rows. Other columns are ignored.
    """
    objs = profile_files(files).select("kind", "file_id", F.explode("objs").alias("o")).select("kind", "file_id", F.col("o.parent").alias("raw"), F.col("o.cells").alias("cells"))
    objs = materialize(objs, "objects")
    listed = _listed(fields)
    if only:
        above = {".".join(p.split(".")[:i]) for p in only for i in range(p.count(".") + 1)}
        listed = listed.filter(F.col("canon").isin(sorted(above)))
    listed = materialize(listed, "listed")
    here, who = ["kind", "canon"], ["kind", "file_id"]
    arrays = listed.groupBy(*here).agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))  # as long as the schema
    level = objs.filter("raw = ''").withColumn("canon", F.lit(""))
    depth = (listed.agg(F.max(F.size(F.split("field_path", r"\.")))).first()[0] or 0)
    all_cells: list[DataFrame] = []
    for _ in range(depth):
        cur = level.join(arrays, here).withColumn("keys", F.expr("filter(transform(cells, c -> c.key), k -> k <> '')"))
        cur = cur.withColumns(
            {
                "unlisted": F.sort_array(F.array_except("keys", "leaves")),
                "present": F.array_intersect("leaves", "keys"),
                "missing": F.sort_array(F.array_except("leaves", "keys")),
            }
        )
        cur = materialize(cur, "level")
        scores = materialize(_pair_scores(cur, listed), "scores")
        version = [*here, "unlisted", "missing"]
        versions = cur.filter("size(unlisted) > 0 AND size(missing) > 0").select(*version).distinct()
        options = versions.withColumn("key", F.explode("unlisted")).join(scores, [*here, "key"]).filter("array_contains(missing, leaf)")
        chosen = options.groupBy(*version).agg(F.sort_array(F.collect_list(F.struct("key", "leaf", "score"))).alias("pairs"))
        renames = chosen.select(*version, _assign("pairs").alias("renames"))
        done = cur.join(renames, version, "left").withColumn("renames", F.coalesce("renames", F.expr("cast(array() as array<struct<key: string, leaf: string>>)")))
        done = done.withColumn("to", F.map_from_entries("renames"))
        path = lambda parent, leaf: F.when(F.col(parent) == "", leaf).otherwise(F.concat(F.col(parent), F.lit("."), leaf))
        present = done.select(*who, "canon", "raw", "leaves", "to", F.explode(F.expr("filter(cells, c -> c.key <> '' OR c.type <> '')")).alias("c")).select(
            *who,
            path("raw", F.col("c.key")).alias("raw_path"),
            path("canon", F.when(F.array_contains("leaves", F.col("c.key")), F.col("c.key")).otherwise(F.col("to")[F.col("c.key")])).alias("field_path"),
            F.col("c.type").alias("type"),
            (~F.array_contains("leaves", F.col("c.key"))).alias("other_key"),
        )
        gone = done.select(*who, "canon", F.explode(F.array_except("missing", F.map_values("to"))).alias("leaf")).select(
            *who, F.lit(None).cast("string").alias("raw_path"), path("canon", F.col("leaf")).alias("field_path"), F.lit(None).cast("string").alias("type"), F.lit(False).alias("other_key")
        )
        cells = materialize(present.unionByName(gone), "cells")
        all_cells.append(cells)
        inner = cells.filter("type = 'object' AND field_path IS NOT NULL").join(listed.filter("has_fields").select("kind", "field_path"), ["kind", "field_path"])
        level = objs.join(inner.select(*who, F.col("raw_path").alias("raw"), F.col("field_path").alias("canon")), [*who, "raw"])
    spark = files.sparkSession
    none = spark.createDataFrame([], "kind string, file_id bigint, raw_path string, field_path string, type string, other_key boolean")
    cells = none
    for part in all_cells:
        cells = cells.unionByName(part)
    facts = listed.select("kind", "field_path", "json_type", "is_optional", "has_fields")
    known = cells.filter("field_path IS NOT NULL").join(facts, ["kind", "field_path"])
    fits = (F.col("type") == F.col("json_type")) | ((F.col("type") == "integer") & (F.col("json_type") == "number")) | (F.col("type") == "null")
    label = F.filter(
        F.array(
            F.when(F.col("type").isNotNull() & F.col("other_key"), "renamed"),
            F.when(F.col("type").isNotNull() & ~fits, "retyped"),
            F.when(F.col("type").isNull() & ~F.col("is_optional"), "removed"),
        ),
        lambda x: x.isNotNull(),
    )
    changes = known.select(*who, "field_path", F.explode(label).alias("change_kind"))
    missing = known.filter("type IS NULL AND has_fields").select(*who, F.col("field_path").alias("above"))
    below = missing.join(facts.filter("NOT is_optional").select("kind", "field_path"), "kind").filter("startswith(field_path, above || '.')")
    added = cells.filter("field_path IS NULL").select(*who, F.col("raw_path").alias("field_path"), F.lit("added").alias("change_kind"))
    changes = changes.unionByName(added).unionByName(below.select(*who, "field_path", F.lit("removed").alias("change_kind")))
    return cells.filter("raw_path IS NOT NULL").drop("other_key"), changes


def field_places(cells: DataFrame, kind: str, paths: list[str]) -> DataFrame:
    """kind, file_id, places: a map from each of the listed paths to the path under which it stands in the file."""
    mine = cells.filter((F.col("kind") == kind) & F.col("field_path").isin(paths))
    one = mine.groupBy("kind", "file_id", "field_path").agg(F.min("raw_path").alias("raw_path"))
    return one.groupBy("kind", "file_id").agg(F.map_from_entries(F.collect_list(F.struct("field_path", "raw_path"))).alias("places"))  # as long as the list of paths


def _convert(value: object, json_type: str) -> tuple[object, bool]:
    """The value in the listed type, and whether it can be had back from that: what cannot is null."""
    lost = (None, False)
    if value is None:
        return None, True
    if json_type in ("array", "object"):
        if isinstance(value, list if json_type == "array" else dict):
            return json_text.dump(value), True
        return (json_text.dump(value.split(",")), True) if json_type == "array" and isinstance(value, str) else lost
    if json_type == "string":
        if isinstance(value, str):
            return value, True
        if isinstance(value, list) and value and all(isinstance(x, str) for x in value):
            text = "\n".join(value)
            return (text, True) if text.split("\n") == value else lost
        return json_text.dump(value), True
    if json_type == "boolean":
        return (value, True) if isinstance(value, bool) else lost
    if isinstance(value, bool) or not isinstance(value, (str, int, float)):
        return lost
    try:
        number = float(value) if json_type == "number" else int(value)
    except (ValueError, OverflowError):
        return lost
    if json_type == "number":
        back = {repr(number), repr(int(number)) if number.is_integer() else ""} if np.isfinite(number) else set()
        return (number, True) if (number == value if not isinstance(value, str) else value in back) else lost
    same = str(number) == value if isinstance(value, str) else number == value
    return (number, True) if same and -(2**63) <= number < 2**63 else lost


def unify(files: DataFrame, cells: DataFrame, fields: DataFrame, kind: str) -> DataFrame:
    """One row a file: file_id, one column per listed field of ``kind`` (dots become underscores), other.

    Columns have the listed type (arrays and objects as JSON text). A retyped
    value is converted where the conversion gives the same text back; else the
    column is null and the value stays, like the added keys, in the map ``other``
    from path to JSON text. The files and deliveries are those of ``resolve``.
    """
    spec = sorted((r["field_path"], r["json_type"]) for r in fields.filter(F.col("record_kind") == kind).select("field_path", "json_type").distinct().collect())  # one row a column of the result
    sql = {"integer": "bigint", "number": "double", "boolean": "boolean"}
    schema = "file_id bigint, " + ", ".join(f"`{p.replace('.', '_')}` {sql.get(t, 'string')}" for p, t in spec) + ", other map<string,string>"
    types = dict(spec)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, text, places in zip(pdf["file_id"], pdf["content"], pdf["beside"]):
                value, row, other = _load(text) or {}, {"file_id": file_id}, {}
                for place in places if places is not None else ():
                    got: object = value
                    for step in place["steps"]:
                        got = got.get(step) if isinstance(got, dict) else None
                    path = place["field_path"]
                    if path is None:
                        other[place["raw_path"]] = json_text.dump(got)
                        continue
                    made, whole = _convert(got, types[path])
                    row[path.replace(".", "_")] = made
                    if not whole:
                        other[place["raw_path"]] = json_text.dump(got)
                rows.append((*(row.get(c) for c in ["file_id", *(p.replace(".", "_") for p, _ in spec)]), other))
            yield pd.DataFrame(rows, columns=["file_id", *(p.replace(".", "_") for p, _ in spec), "other"], dtype=object)

    mine = cells.filter(F.col("kind") == kind)
    places = mine.groupBy("kind", "file_id").agg(F.collect_list(F.struct("field_path", "raw_path", F.split("raw_path", r"\.").alias("steps"))).alias("beside"))
    return last_readable(files.filter(F.col("kind") == kind), places).mapInPandas(build, schema)
