"""Entry declarations in container files and package manifests, and the symbols they start."""

from __future__ import annotations

import json
import re
import shlex
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SCHEMA = "file string, line int, kind string, raw string, argv array<string>, service string, workdir string"
# Names under which a file's entry is looked for, in this order.
PREFERRED = ["main", "bootstrap", "app", "start", "run", "serve", "listen", "create_app"]


def strip_comments(text: str) -> str:
    """JSON with comments to plain JSON; strings are left alone, trailing commas dropped."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m.group(1) or "", plain)


def _words(command: str) -> list[str]:
    try:
        return shlex.split(command)
    except ValueError:
        return command.split()


def _command(text: str) -> list[str]:
    """Words of a command in list form or shell form."""
    if text.lstrip().startswith("["):
        try:
            return [str(x) for x in json.loads(text)]
        except ValueError:
            return [x.strip().strip("\"'") for x in text.strip()[1:-1].split(",") if x.strip()]
    return _words(text)


def dockerfile(text: str) -> list[dict]:
    out, workdir = [], None
    logical, start = "", 1
    for n, line in enumerate(text.splitlines(), 1):
        if not logical:
            start = n
        if line.lstrip().startswith("#"):
            continue
        logical += line.rstrip().removesuffix("\\") + " "
        if line.rstrip().endswith("\\"):
            continue
        m = re.match(r"\s*(CMD|ENTRYPOINT|WORKDIR)\s+(.*)", logical, re.I | re.S)
        if m and m[1].upper() == "WORKDIR":
            workdir = m[2].strip()
        elif m:
            out.append({"line": start, "kind": f"dockerfile_{m[1].lower()}", "raw": m[2].strip(), "argv": _command(m[2].strip()), "workdir": workdir})
        logical = ""
    return out


def compose(text: str) -> list[dict]:
    """Commands of a compose file; its indented layout is read line by line."""
    out, inside, service, level, pending = [], False, None, None, None
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if pending and body.startswith("- ") and indent >= pending["indent"]:
            pending["argv"].append(body[2:].strip().strip("\"'"))
            continue
        pending = None
        if indent == 0:
            inside, level = body.startswith("services:"), None
            continue
        if not inside:
            continue
        level = indent if level is None else level
        if indent == level and body.endswith(":"):
            service = body[:-1].strip("\"'")
        m = re.match(r"(command|entrypoint):\s*(.*)", body)
        if m and indent > level:
            entry = {"line": n, "kind": f"compose_{m[1]}", "raw": m[2], "argv": _command(m[2].strip("\"'") if not m[2].startswith("[") else m[2]), "service": service}
            out.append(entry)
            if not m[2]:
                pending = entry | {"indent": indent}
                pending["argv"] = entry["argv"]
    return [{**e, "raw": e["raw"] or " ".join(e["argv"])} for e in out]


def package_json(text: str) -> list[dict]:
    doc = json.loads(text)
    one = lambda kind, raw, service=None, argv=None: {"line": 1, "kind": kind, "raw": raw, "argv": argv or [raw], "service": service}
    out = [one(f"package_json_{k}", doc[k]) for k in ("main", "module") if isinstance(doc.get(k), str)]
    bins = doc.get("bin")
    out += [one("package_json_bin", v, k) for k, v in (bins.items() if isinstance(bins, dict) else [(None, bins)]) if isinstance(v, str)]
    return out + [one("package_json_script", v, k, _words(v)) for k, v in (doc.get("scripts") or {}).items() if isinstance(v, str)]


def deno_json(text: str) -> list[dict]:
    tasks = json.loads(strip_comments(text)).get("tasks") or {}
    return [{"line": 1, "kind": "deno_task", "raw": v, "argv": _words(v), "service": k} for k, v in tasks.items() if isinstance(v, str)]


def pyproject(text: str) -> list[dict]:
    doc = tomllib.loads(text)
    tables = [doc.get("project", {}).get("scripts", {}), doc.get("tool", {}).get("poetry", {}).get("scripts", {})]
    return [{"line": 1, "kind": "pyproject_script", "raw": v, "argv": [v], "service": k} for t in tables for k, v in t.items() if isinstance(v, str)]


def cargo(text: str) -> list[dict]:
    out = []
    for b in tomllib.loads(text).get("bin", []):
        name, path = b.get("name"), b.get("path", "")
        if name or path:
            out.append({"line": 1, "kind": "cargo_bin", "raw": f"{name} ({path})" if name and path else name or path, "argv": [path or f"src/bin/{name}.rs"], "service": name})
    return out


PARSERS = [
    (r"(^|/)([\w.-]+\.)?Dockerfile(\.[\w.-]+)?$", dockerfile), (r"(^|/)(docker-)?compose(\.[\w-]+)?\.ya?ml$", compose), (r"(^|/)package\.json$", package_json), (r"(^|/)deno\.jsonc?$", deno_json),
    (r"(^|/)pyproject\.toml$", pyproject), (r"(^|/)Cargo\.toml$", cargo),
]


def entry_declarations(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Declarations of all container files and manifests; other files are dropped unread, unreadable ones give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "line", "kind", "raw", "argv", "service", "workdir"]
        for pdf in batches:
            rows = []
            for p, t in zip(pdf["p"], pdf["t"]):
                parse = next((f for pattern, f in PARSERS if re.search(pattern, p)), None)
                try:
                    rows += [[{"file": p, **d}.get(c) for c in names] for d in parse(t)]
                except (ValueError, AttributeError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=names)

    wanted = F.col("p").rlike("|".join(p for p, _ in PARSERS))
    return files.select(F.col(path).alias("p"), F.col(content).alias("t")).filter(wanted & F.col("t").isNotNull()).mapInPandas(run, SCHEMA)


def match_entries(entries: DataFrame, symbols: DataFrame) -> DataFrame:
    """Entries with id, name and confidence ('exact', 'likely') of the symbol they start; unmatched ones have nulls.

    A word of the command that is the end of a file's path (at a separator), a
    module given to ``python -m``, or ``package.module:function``. Path ends become
    join keys. Of several files the one with most symbols counts, then the
    smallest path; in a file the preferred names, then the first callable.
    """
    files = symbols.filter(F.lower("kind") != "class")
    order = F.array_position(F.array(*[F.lit(p) for p in PREFERRED]), F.lower("name"))
    pick = files.groupBy("file").agg(F.count("*").alias("n"), F.min_by(F.struct("id", "name"), F.struct(F.when(order > 0, order).otherwise(99), "line")).alias("s"))
    ends = pick.withColumn("parts", F.split("file", "/")).withColumn("end", F.explode(F.expr("transform(sequence(1, size(parts)), i -> array_join(slice(parts, i, size(parts)), '/'))")))
    best = ends.groupBy("end").agg(F.max_by(F.struct("file", "s"), F.struct("n", F.expr("-length(file)"))).alias("b"))
    keyed = entries.withColumn("__e", F.xxhash64("file", "line", "kind", "raw", "service"))
    words = keyed.select("__e", F.posexplode("argv").alias("at", "word")).filter(F.col("word").rlike("[./]"))
    words = words.select("__e", "at", F.regexp_replace("word", r"^(\./)+", "").alias("end"), F.lit("exact").alias("confidence"), F.lit(None).cast("string").alias("function"))
    flag = F.array_position("argv", F.lit("-m")).cast("int")
    target = F.when(F.get("argv", F.lit(0)).rlike("python3?$") & (flag > 0), F.concat(F.try_element_at("argv", flag + 1), F.lit(":")))
    target = F.coalesce(target, F.when((F.size("argv") == 1) & F.contains(F.get("argv", F.lit(0)), F.lit(":")), F.get("argv", F.lit(0))))
    modules = keyed.withColumn("__t", target).filter("__t IS NOT NULL")
    module = F.replace(F.substring_index("__t", ":", 1), F.lit("."), F.lit("/"))
    forms = F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__main__.py")), F.concat(module, F.lit("/__init__.py")), F.concat(F.element_at(F.split(module, "/"), -1), F.lit(".py")))
    modules = modules.select("__e", F.posexplode(forms).alias("at", "end"), F.lit("likely").alias("confidence"), F.nullif(F.substring_index("__t", ":", -1), F.lit("")).alias("function"))
    found = words.unionByName(modules.withColumn("at", F.col("at") + 1000)).join(best, "end")
    named = files.select(F.col("file").alias("f_file"), F.col("name").alias("f_name"), F.col("id").alias("f_id"))
    found = found.join(named, (F.col("b.file") == F.col("f_file")) & (F.col("function") == F.col("f_name")), "left")
    one = found.groupBy("__e").agg(F.min_by(F.struct(
        F.coalesce("f_id", F.col("b.s.id")).alias("symbol_id"), F.coalesce("f_name", F.col("b.s.name")).alias("symbol_name"), F.col("b.file").alias("symbol_file"),
        F.when(F.col("f_id").isNotNull(), "exact").otherwise(F.col("confidence")).alias("confidence"),
    ), F.struct("at", "end")).alias("m"))
    return keyed.join(one, "__e", "left").select(*entries.columns, "m.*")


def label_roots(roots: DataFrame, matched: DataFrame) -> DataFrame:
    """Roots with the labels of the entries that start them, distinct and sorted."""
    labels = matched.filter("symbol_id IS NOT NULL").groupBy(F.col("symbol_id").alias("id")).agg(F.sort_array(F.collect_set(F.concat_ws(": ", "kind", "raw"))).alias("entry_labels"))
    return roots.join(labels, "id", "left")
