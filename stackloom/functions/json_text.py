"""JSON texts of any depth: Python's parser and writer, and iterative ones for what is nested deeper than these go."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*")|([^\s{}\[\],:"]+))', re.S)
_END = re.compile(r"[ \t\n\r]*\Z")


def load(text: str) -> object:
    """The value of a JSON text; ValueError if it is none."""
    try:
        return json.loads(text)
    except RecursionError:
        return _load_deep(text)


def _load_deep(text: str) -> object:
    """One token at a time; open arrays and objects stand on a list instead of the call stack."""
    root: list = []
    frames: list[list] = [[root, None]]  # of each open array or object itself and the key read last
    at, want = 0, "value"

    def put(value: object) -> None:
        box, key = frames[-1]
        if isinstance(box, list):
            box.append(value)
        else:
            box[key] = value

    while want != "next" or len(frames) > 1:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("not a JSON text")
        at = m.end()
        mark, quoted, plain = m.groups()
        box = frames[-1][0]
        if want == "next" and mark == ",":
            want = "key" if isinstance(box, dict) else "value"
        elif mark in ("]", "}") and (want == "next" or want.endswith("or end")) and isinstance(box, dict) == (mark == "}"):
            frames.pop()
            want = "next"
        elif want.startswith("key") and quoted:
            frames[-1][1], want = json.loads(quoted), "colon"
        elif want == "colon" and mark == ":":
            want = "value"
        elif want.startswith("value") and mark in ("[", "{"):
            inner: list | dict = [] if mark == "[" else {}
            put(inner)
            frames.append([inner, None])
            want = "value or end" if mark == "[" else "key or end"
        elif want.startswith("value") and mark is None:
            put(json.loads(quoted or plain))
            want = "next"
        else:
            raise ValueError("not a JSON text")
    if not _END.match(text, at):
        raise ValueError("not a JSON text")
    return root[0]


def dump(value: object) -> str:
    """The JSON text of a value, as ``json.dumps`` writes it without escapes."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]
    while todo:
        done, v = todo.pop()
        if done:
            out.append(v)
        elif isinstance(v, (list, dict)):
            parts: list[tuple[bool, object]] = [(True, "[" if isinstance(v, list) else "{")]
            for i, x in enumerate(v):
                parts.append((True, ", " * (i > 0) + ("" if isinstance(v, list) else json.dumps(x, ensure_ascii=False) + ": ")))
                parts.append((False, x if isinstance(v, list) else v[x]))
            parts.append((True, "]" if isinstance(v, list) else "}"))
            todo += parts[::-1]
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)
