"""Nested records to related flat tables by columnar shredding.

Each leaf path of a record is written as one column of (value, repetition level,
definition level), as Parquet does. A table of any repeated ancestor is then
rebuilt from the level sequence of one of its leaves: a repetition level of r
starts a new element of the r-th array on the path, and a definition level tells
how far down the path is present. Row numbers along the path come from counting
those starts, so every row keeps its own position and that of each ancestor.

Two front ends feed the same reassembly: Arrow list columns, whose offsets and
validity give the levels without touching a value, and JSON text, whose trees
may nest to any depth (a recursive field is unrolled, one leaf column a level).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from stackloom.functions import json_text


@dataclass
class Column:
    """A shredded leaf: levels and values in record order. ``value`` holds an entry where ``definition`` is full."""

    repetition: list[int] = field(default_factory=list)
    definition: list[int] = field(default_factory=list)
    value: list = field(default_factory=list)


def positions(repetition: np.ndarray, definition: np.ndarray, depth: int, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the ``depth``-th repeated ancestor from the levels of one leaf.

    ``need`` is the definition level at which an element of that ancestor exists.
    Returns the entries that start such a row, the record number of each, and the
    zero-based positions (one column for each array, outermost first).
    """
    n = len(repetition)
    starts = np.flatnonzero((repetition <= depth) & (definition >= need))
    record = np.cumsum(repetition == 0) - 1
    index = np.empty((len(starts), depth), dtype=np.int64)
    at = np.arange(n)
    for level in range(1, depth + 1):
        # the array of this level begins anew where an outer one moves on
        begins = repetition < level
        last_begin = np.maximum.accumulate(np.where(begins, at, 0)) if n else at
        moves = np.cumsum(repetition == level)
        index[:, level - 1] = (moves - moves[last_begin])[starts]
    return starts, record[starts], index


def list_levels(column: pa.Array, path: list[str]) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Levels of an Arrow column of lists of structs, following ``path`` through inner lists.

    ``path`` names the struct fields that hold the next list. Definition levels
    count, from the outside: list not null, element present (non-empty), element
    not null; and so on inwards. Also returns the struct arrays of each depth.
    """
    n = len(column)
    rep = np.zeros(n, np.int64)
    structs: list[pa.Array] = []
    offsets, values = column.offsets.to_numpy(), column.values
    lens = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    definition = column.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
    here = np.arange(n)  # entries that may hold a list of this depth
    for depth in range(1, len(path) + 2):
        counts = np.maximum(lens, 1)
        full = np.ones(len(rep), np.int64)
        full[here] = counts
        source = np.repeat(np.arange(len(rep)), full)
        first = np.r_[True, source[1:] != source[:-1]] if len(source) else np.zeros(0, bool)
        new_rep = np.where(first, rep[source], depth)
        new_def = definition[source]
        has = np.zeros(len(rep), bool)
        has[here] = lens > 0
        element = has[source]
        # positions of the elements in the values array, in order
        start = offsets[:-1][lens > 0]
        size = lens[lens > 0]
        take = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
        items = values.take(pa.array(take))
        alive = items.is_valid().to_numpy(zero_copy_only=False)
        new_def[element] += 1 + alive
        structs.append(items)
        rep, definition = new_rep, new_def
        if depth > len(path):
            break
        inner = pc.struct_field(items, path[depth - 1])
        valid = inner.is_valid().to_numpy(zero_copy_only=False) & alive
        definition[np.flatnonzero(element)] += valid
        here = np.flatnonzero(element)
        offsets, values = inner.offsets.to_numpy(), inner.values
        lens = np.where(valid, np.diff(offsets), 0)
    return rep, definition, structs


def _row_paths(index: np.ndarray) -> pa.Array:
    parts = [pc.cast(pa.array(index[:, i]), pa.string()) for i in range(index.shape[1])]
    return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, ".")


def shred_lists(df: DataFrame, key: str, column: str, inner: str, entity: str, inner_entity: str, cells: bool = True) -> DataFrame:
    """record_id, entity, row_path, parent_path[, cells]: rows of a column array<struct<..., inner array<struct<...>>>>.

    ``cells`` maps the scalar fields of the element to their text. ``df`` must
    hold one row a record. Null and empty arrays, and null elements, give no rows
    (a later element keeps its position); an empty table gives none.
    """
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in ("record_id", "entity", "row_path", "parent_path")] + [T.StructField("cells", T.MapType(T.StringType(), T.StringType()))] * cells
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lists = batch.column(0), batch.column(1)
            rep, definition, structs = list_levels(lists, [inner])
            # definition: 1 list, 2 element, 3 not null, 4 inner list, 5 inner element, 6 not null
            for name, depth, need in ((entity, 1, 3), (inner_entity, 2, 6)):
                starts, record, index = positions(rep, definition, depth, need)
                if not len(starts):
                    continue
                paths = _row_paths(index)
                above = _row_paths(index[:, :-1]) if depth > 1 else pa.nulls(len(starts), pa.string())
                out = {
                    "record_id": ids.take(pa.array(record)),
                    "entity": pa.array([name], pa.string()).take(pa.array(np.zeros(len(starts), np.int64))),
                    "row_path": paths,
                    "parent_path": above,
                }
                if cells:
                    items = structs[depth - 1].filter(structs[depth - 1].is_valid())
                    out["cells"] = _cells(items, [f.name for f in items.type if not pa.types.is_list(f.type)])
                for b in pa.table(out).to_batches(max_chunksize=50_000):
                    yield b

    return df.select(F.col(key).cast("string").alias("id"), F.col(column).alias("c")).filter("id IS NOT NULL AND c IS NOT NULL").mapInArrow(run, schema)


def _cells(items: pa.Array, names: list[str]) -> pa.Array:
    """The scalar fields of structs as maps; fields that are null are absent."""
    n, k = len(items), len(names)
    if not k:
        return pa.MapArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()), pa.array([], pa.string()))
    texts = [pc.cast(pc.struct_field(items, c), pa.string()) for c in names]
    flat = pa.concat_arrays(texts)
    order = (np.arange(n)[:, None] + np.arange(k)[None, :] * n).ravel()  # row by row
    values = flat.take(pa.array(order))
    keys = pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(k), n)))
    there = values.is_valid().to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(there.reshape(n, k).sum(axis=1))].astype(np.int32)
    keep = pa.array(there)
    return pa.MapArray.from_arrays(pa.array(ends), keys.filter(keep), values.filter(keep))


@dataclass(frozen=True)
class Entity:
    """A repeated object of a JSON file.

    ``path``: from the parent (or the file) to the array, as alternative key
    sequences of which the first present one counts. ``recursive``: the key of
    the objects that holds more of the same entity.
    """

    name: str
    path: tuple[tuple[str, ...], ...]
    parent: str | None = None
    recursive: str | None = None


def _at(value: object, ways: tuple[tuple[str, ...], ...]) -> object:
    for way in ways:
        got, found = value, True
        for step in way:
            if not isinstance(got, dict) or step not in got:
                found = False
                break
            got = got[step]
        if found:
            return got
    return None


def shred_json(value: object, entities: tuple[Entity, ...]) -> dict[tuple[str, int], Column]:
    """One column per (entity, number of arrays on the path), for one record.

    The leaf of an element is the JSON of its scalar fields. Definition levels
    count as in ``list_levels``. A recursive entity has one column for each depth
    that occurs; every column has entries for every ancestor that has nothing
    below, as shredding demands.
    """
    kids = {e.name: [c for c in entities if c.parent == e.name] + ([Entity(e.name, ((e.recursive,),), e.name, e.recursive)] if e.recursive else []) for e in entities}
    roots = [(e, _at(value, e.path), 1) for e in entities if e.parent is None][::-1]
    # how deep arrays go: an absent array must be noted in the columns of everything that could stand in it
    deepest, look = 0, list(roots)
    while look:
        entity, items, depth = look.pop()
        if isinstance(items, list) and items:
            deepest = max(deepest, depth)
            look += [(kid, _at(item, kid.path), depth + 1) for item in items if isinstance(item, dict) for kid in kids[entity.name]]
    columns: dict[tuple[str, int], Column] = {}
    # Arrays are walked with an explicit stack: trees may be deeper than Python's recursion limit.
    stack: list[tuple[Entity, object, int, int, int]] = [(*r, 0, 0) for r in roots]
    while stack:
        entity, items, depth, rep, definition = stack.pop()
        if depth > deepest:
            continue
        col = columns.setdefault((entity.name, depth), Column())
        below: list[tuple[Entity, object, int, int, int]] = []
        if not isinstance(items, list) or not items:
            col.repetition.append(rep)
            col.definition.append(definition + isinstance(items, list))
            col.value.append(None)
            below = [(kid, None, depth + 1, rep, definition + isinstance(items, list)) for kid in kids[entity.name]]
        else:
            for i, item in enumerate(items):
                r = rep if i == 0 else depth
                alive = isinstance(item, dict)
                col.repetition.append(r)
                col.definition.append(definition + 2 + alive)
                col.value.append(item if alive else None)
                below += [(kid, _at(item, kid.path) if alive else None, depth + 1, r, definition + 2 + alive) for kid in kids[entity.name]]
        stack += below[::-1]
    return columns


def reassemble(columns: dict[tuple[str, int], Column]) -> Iterator[tuple[str, str, str | None, dict]]:
    """entity, row_path, parent_path, element of every row, from the levels alone."""
    for (name, depth), col in sorted(columns.items()):
        need = 3 * depth
        starts, _, index = positions(np.asarray(col.repetition), np.asarray(col.definition), depth, need)
        for s, place in zip(starts, index.tolist()):
            path = [str(x) for x in place]
            yield name, ".".join(path), ".".join(path[:-1]) or None, col.value[s]


def _standing(entities: tuple[Entity, ...], places: dict[str, str] | None) -> tuple[Entity, ...]:
    """The entities with outermost paths replaced by those under which a record has them."""
    if not places:
        return entities
    own = lambda way: tuple(places[".".join(way)].split(".")) if places.get(".".join(way)) else way
    return tuple(replace(e, path=tuple(own(w) for w in e.path)) if e.parent is None else e for e in entities)


def shred_files(df: DataFrame, key: str, column: str, entities: tuple[Entity, ...], places: str | None = None, cells: bool = True) -> DataFrame:
    """record_id, entity, row_path, parent_path[, cells] of every repeated object in a column of JSON texts.

    ``df`` must hold one row a record. Text that is not valid JSON gives nothing,
    nor does null; an element that is not an object is no row, but counts in the
    positions. ``cells`` has the element's scalar fields as JSON text. ``places``
    names a column with a map from paths of outermost arrays (dotted) to where they
    stand in the record; a null map, or an absent path, leaves them as given.
    """
    columns = ["record_id", "entity", "row_path", "parent_path", *["cells"] * cells]
    schema = "record_id string, entity string, row_path string, parent_path string" + ", cells map<string,string>" * cells

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for record, text, own in zip(pdf["id"], pdf["c"], pdf["p"]):
                try:
                    value = json_text.load(text)
                except ValueError:
                    continue
                for name, path, above, item in reassemble(shred_json(value, _standing(entities, dict(own) if own is not None else None))):
                    row = (record, name, path, above)
                    rows.append((*row, {k: v if isinstance(v, str) else json.dumps(v) for k, v in item.items() if v is not None and not isinstance(v, (list, dict))}) if cells else row)
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    place = F.col(places) if places else F.lit(None).cast("map<string,string>")
    return df.select(F.col(key).cast("string").alias("id"), F.col(column).alias("c"), place.alias("p")).filter("id IS NOT NULL AND c IS NOT NULL").mapInPandas(run, schema)


def expand_report(text: str) -> str:
    """A stored report with its string table written out: pooled names, files and kinds become text again.

    Reports without a string table, and texts that are no JSON, are returned as
    they are; an index outside the table becomes null.
    """
    try:
        value = json_text.load(text)
    except (ValueError, TypeError):
        return text
    for report in value.values() if isinstance(value, dict) else ():
        if not isinstance(report, dict) or not isinstance(pool := report.get("string_table"), list):
            continue
        word = lambda i: pool[i] if isinstance(i, int) and 0 <= i < len(pool) else None
        frames = [{**f, **{k: word(f.get(k)) for k in ("name", "file", "kind", "parent_class") if k in f}} for f in report.get("frames") or [] if isinstance(f, dict)]
        todo = list(report.get("entries") or [])
        while todo:
            node = todo.pop()
            if not isinstance(node, dict):
                continue
            at = node.pop("frame", None)
            if isinstance(at, int) and 0 <= at < len(frames):
                node.update({k: v for k, v in frames[at].items() if k not in node})
            for finding in node.get("findings") or []:
                if isinstance(finding, dict) and isinstance(finding.get("kind"), int):
                    finding["kind"] = word(finding["kind"])
            todo += node.get("children") or []
    return json_text.dump(value)
