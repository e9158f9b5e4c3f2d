"""SQL statement rules: 25 on queries and changes, 6 on migrations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stackloom.functions.scalar import squeezed_hash
from stackloom.lint.sqlparse import SqlError, parse, split_statements

# Fixed values.
RANDOM_FUNCTIONS = {"RANDOM", "RAND", "NEWID"}
WINDOW_FUNCTIONS = {"ROW_NUMBER", "RANK", "DENSE_RANK", "PERCENT_RANK", "CUME_DIST", "NTILE", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE", "NTH_VALUE"}
AGGREGATES = {
    "COUNT", "SUM", "AVG", "MIN", "MAX", "ARRAY_AGG", "STRING_AGG", "JSON_AGG", "JSONB_AGG", "JSON_OBJECT_AGG", "BOOL_AND", "BOOL_OR", "EVERY",
    "STDDEV", "STDDEV_POP", "STDDEV_SAMP", "VAR_POP", "VAR_SAMP", "VARIANCE", "GROUP_CONCAT", "LISTAGG", "PERCENTILE_CONT", "PERCENTILE_DISC",
}
COMPARISONS = {"=", "<>", "!=", "<", ">", "<=", ">="}

_COUNTS = ["max_relations", "subquery_depth", "or_chain", "or_same_column", "in_list", "offset_value", "from_items"]
_FLAGS = [
    "has_star", "has_where", "insert_values", "insert_columns", "like_wildcard", "order_random", "function_compare", "any_join", "where_equality", "not_in_subquery", "union_distinct",
    "distinct", "has_order", "window_no_partition", "scalar_subquery", "having_no_aggregate", "mixed_aggregate", "group_ordinal", "order_constant", "not_in_null", "json_path",
    "concurrently", "drop_column", "alter_type", "add_fk", "add_not_null",
]
FEATURES = "kind string, " + ", ".join(f"{c} int" for c in _COUNTS) + ", " + ", ".join(f"{c} boolean" for c in _FLAGS)


def _selects(body: tuple) -> Iterator[dict]:
    """The selects of a set expression, operands included, derived tables excluded."""
    if body[0] == "select":
        yield body[1]
    elif body[0] == "query":
        yield from _selects(body[1]["body"])
    elif body[0] == "set":
        yield from _selects(body[3])
        yield from _selects(body[4])


def _relations(select: dict) -> Iterator[tuple]:
    for relation, joins in select["from"]:
        yield relation
        for target, _ in joins:
            yield target


def _conditions(query: dict) -> Iterator[tuple]:
    """Every expression of the WHERE and ON conditions, those of subqueries among them included."""
    for select in _selects(query["body"]):
        if select["where"] is not None:
            yield from _walk(select["where"])
        for relation, joins in select["from"]:
            for source, on in [(relation, None), *joins]:
                if source[0] == "derived":
                    yield from _conditions(source[1])
                if on is not None:
                    yield from _walk(on)


def _walk(e: tuple) -> Iterator[tuple]:
    yield e
    kind = e[0]
    if kind == "bin":
        yield from _walk(e[2])
        yield from _walk(e[3])
    elif kind in ("un", "isnull"):
        yield from _walk(e[2])
    elif kind == "nest":
        yield from _walk(e[1])
    elif kind == "like":
        yield from _walk(e[2])
        yield from _walk(e[3])
    elif kind == "inlist":
        yield from _walk(e[2])
        for x in e[3]:
            yield from _walk(x)
    elif kind == "insub":
        yield from _walk(e[2])
        yield from _conditions(e[3])
    elif kind in ("sub", "exists"):
        yield from _conditions(e[1])


def _depth(query: dict, depth: int = 0) -> int:
    """Nesting of queries through FROM and WHERE."""

    def inside(e: tuple) -> int:
        if e[0] in ("sub", "exists"):
            return _depth(e[1], depth + 1)
        if e[0] == "insub":
            return _depth(e[3], depth + 1)
        if e[0] == "bin":
            return max(inside(e[2]), inside(e[3]))
        return inside(e[1]) if e[0] == "nest" else inside(e[2]) if e[0] == "un" else depth

    def body(b: tuple) -> int:
        if b[0] == "query":
            return _depth(b[1], depth + 1)
        if b[0] == "set":
            return max(body(b[3]), body(b[4]))
        if b[0] != "select":
            return depth
        found = [depth] + [_depth(r[1], depth + 1) for r in _relations(b[1]) if r[0] == "derived"]
        return max([*found, inside(b[1]["where"])] if b[1]["where"] is not None else found)

    return body(query["body"])


def _relation_count(query: dict) -> int:
    return max([max([sum(1 + len(j) for _, j in s["from"]), *(_relation_count(r[1]) for r in _relations(s) if r[0] == "derived")]) for s in _selects(query["body"])], default=0)


def _or_leaves(e: tuple) -> list[tuple]:
    return _or_leaves(e[2]) + _or_leaves(e[3]) if e[0] == "bin" and e[1] == "OR" else [e]


def _same_column(e: tuple) -> int:
    names: dict[str, int] = {}
    for leaf in _or_leaves(e):
        if leaf[0] == "bin" and leaf[1] == "=":
            col = next((x[1][-1].lower() for x in leaf[2:4] if x[0] == "col"), None)
            if col:
                names[col] = names.get(col, 0) + 1
    return max(names.values(), default=0)


def _aggregate(e: tuple) -> bool:
    if e[0] == "fn":
        return e[1] in AGGREGATES or any(_aggregate(a) for a in e[2])
    if e[0] == "bin":
        return _aggregate(e[2]) or _aggregate(e[3])
    return _aggregate(e[2]) if e[0] == "un" else _aggregate(e[1]) if e[0] in ("nest", "cast") else False


def _constant(e: tuple) -> bool:
    if e[0] == "bin":
        return _constant(e[2]) and _constant(e[3])
    return e[0] == "lit" or (e[0] == "nest" and _constant(e[1])) or (e[0] == "un" and _constant(e[2]))


def _equality(e: tuple) -> bool:
    if e[0] == "bin":
        return e[1] == "=" or (e[1] in ("AND", "OR") and (_equality(e[2]) or _equality(e[3])))
    return _equality(e[1]) if e[0] == "nest" else _equality(e[2]) if e[0] == "un" else False


def _number(e: tuple | None) -> int | None:
    while e is not None and e[0] == "nest":
        e = e[1]
    return int(e[2]) if e is not None and e[0] == "lit" and e[1] == "num" and e[2].isdigit() else None


def _calls_random(e: tuple) -> bool:
    return (e[0] == "fn" and e[1] in RANDOM_FUNCTIONS) or (e[0] == "nest" and _calls_random(e[1]))


def _on_column(e: tuple) -> bool:
    return e[0] == "fn" and bool(e[2]) and e[2][0][0] == "col"


def features(text: str) -> dict | None:
    """Structural features of one statement; None where it cannot be parsed."""
    try:
        stmt = parse(text)
    except (SqlError, IndexError, RecursionError):
        return None
    out: dict = {"kind": stmt["kind"], **dict.fromkeys(_COUNTS, 0), **dict.fromkeys(_FLAGS, False)}
    out["has_where"] = stmt.get("where") is not None
    if stmt["kind"] == "insert":
        out["insert_values"], out["insert_columns"] = stmt["values"], stmt["columns"]
    elif stmt["kind"] == "create_index":
        out["concurrently"] = stmt["concurrently"]
    elif stmt["kind"] == "alter_table":
        for op in stmt["ops"]:
            out[op] = True
    elif stmt["kind"] == "query":
        _query_features(stmt["query"], out)
    return out


def _query_features(query: dict, out: dict) -> None:
    where = list(_conditions(query))
    out["max_relations"], out["subquery_depth"] = _relation_count(query), _depth(query)
    out["or_chain"] = max((len(_or_leaves(e)) for e in where), default=0)
    out["or_same_column"] = max((_same_column(e) for e in where), default=0)
    out["in_list"] = max((len(e[3]) for e in where if e[0] == "inlist"), default=0)
    out["like_wildcard"] = any(e[0] == "like" and e[3][0] == "lit" and e[3][2].lstrip("eEnN")[1:2] in ("%", "_") for e in where)
    out["function_compare"] = any(e[0] == "bin" and e[1] in COMPARISONS and (_on_column(e[2]) or _on_column(e[3])) for e in where)
    out["not_in_subquery"] = any(e[0] == "insub" and e[1] for e in where)
    out["not_in_null"] = any(e[0] == "inlist" and e[1] and any(x[0] == "lit" and x[1] == "null" for x in e[3]) for e in where)
    out["json_path"] = any(e[0] == "bin" and e[1] in ("->", "->>", "#>", "#>>") for e in where)
    out["has_order"] = bool(query["order"])
    out["order_random"] = any(_calls_random(e) for e in query["order"])
    out["order_constant"] = bool(query["order"]) and all(_constant(e) for e in query["order"])
    out["offset_value"] = min(_number(query["offset"]) or 0, 2**31 - 1)
    out["union_distinct"] = _plain_union(query["body"])
    if query["body"][0] != "select":
        return
    top = query["body"][1]
    items = top["items"]
    out["has_star"] = any(e[0] == "star" for e in items)
    out["distinct"] = top["distinct"]
    out["from_items"], out["any_join"] = len(top["from"]), any(j for _, j in top["from"])
    out["where_equality"] = top["where"] is not None and _equality(top["where"])
    out["window_no_partition"] = any(e[0] == "fn" and e[3] and e[1] in WINDOW_FUNCTIONS and e[3]["order"] and not e[3]["partition"] for e in items)
    out["scalar_subquery"] = any(e[0] == "sub" for e in items)
    out["having_no_aggregate"] = top["having"] is not None and not _aggregate(top["having"])
    aggregated = [_aggregate(e) for e in items]
    out["mixed_aggregate"] = not top["group"] and any(aggregated) and any(e[0] == "col" for e, a in zip(items, aggregated) if not a)
    out["group_ordinal"] = any(e[0] == "lit" and _number(e) is not None for e in top["group"])


def _plain_union(body: tuple) -> bool:
    return body[0] == "set" and ((body[1] == "UNION" and not body[2]) or _plain_union(body[3]) or _plain_union(body[4]))


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    effort: str
    when: str  # a predicate over the features
    confidence: float = 0.90


# Ids, severities and efforts of the rules, with thresholds in the predicates.
RULES = [
    Rule("SQL001", "low", "trivial", "has_star"),
    Rule("SQL002", "high", "trivial", "kind = 'delete' AND NOT has_where"),
    Rule("SQL003", "high", "trivial", "kind = 'update' AND NOT has_where"),
    Rule("SQL004", "low", "trivial", "kind = 'insert' AND insert_values AND NOT insert_columns"),
    Rule("SQL005", "medium", "small", "like_wildcard"),
    Rule("SQL006", "medium", "small", "order_random"),
    Rule("SQL007", "low", "trivial", "or_same_column >= 3"),
    Rule("SQL009", "medium", "small", "function_compare"),
    Rule("SQL010", "high", "small", "from_items >= 2 AND NOT any_join AND NOT where_equality"),
    Rule("SQL011", "medium", "small", "not_in_subquery"),
    Rule("SQL015", "low", "trivial", "union_distinct"),
    Rule("SQL_COMPLEX_JOINS", "medium", "medium", "max_relations >= 6"),
    Rule("SQL_COMPLEX_SUBQUERY_DEPTH", "medium", "medium", "subquery_depth >= 4"),
    Rule("SQL_COMPLEX_OR_CHAIN", "low", "trivial", "or_chain >= 7"),
    Rule("SQL_LARGE_IN_LIST", "medium", "small", "in_list >= 100"),
    Rule("SQL_DISTINCT_NO_ORDER_BY", "low", "trivial", "distinct AND NOT has_order"),
    Rule("SQL_OFFSET_DEEP_PAGINATION", "medium", "medium", "offset_value >= 1000"),
    Rule("SQL_WIN_NO_PARTITION", "medium", "small", "window_no_partition"),
    Rule("SQL_SUB_SCALAR_IN_PROJECTION", "high", "medium", "scalar_subquery"),
    Rule("SQL014_HAVING_NO_AGGREGATE", "low", "trivial", "having_no_aggregate"),
    Rule("SQL017_AMBIGUOUS_GROUP", "high", "small", "mixed_aggregate"),
    Rule("SQL021_GROUP_BY_ORDINAL", "low", "trivial", "group_ordinal"),
    Rule("SQL022_ORDER_BY_CONSTANT", "low", "trivial", "order_constant"),
    Rule("SQL023_NOT_IN_WITH_NULL", "high", "trivial", "not_in_null"),
    Rule("SQL025_JSON_PATH_IN_WHERE", "medium", "small", "json_path"),
    Rule("MIG_CREATE_INDEX_NOT_CONCURRENT", "high", "trivial", "kind = 'create_index' AND NOT concurrently"),
    Rule("MIG_DROP_TABLE", "high", "medium", "kind = 'drop_table'"),
    Rule("MIG_DROP_COLUMN", "high", "medium", "drop_column"),
    Rule("MIG_ALTER_COLUMN_TYPE", "high", "medium", "alter_type"),
    Rule("MIG_ADD_FK_NOT_VALID", "high", "small", "add_fk"),
    Rule("MIG_ADD_COLUMN_NOT_NULL_NO_DEFAULT", "high", "small", "add_not_null"),
]


def statement_features(statements: DataFrame, text: str = "sql") -> DataFrame:
    """The statements with their features (struct ``f``, null where unparsable); each distinct text is parsed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"fp": pdf["fp"], "__sql": pdf["__sql"], "f": [features(s) for s in pdf["__sql"]]})

    keyed = statements.filter(F.col(text).isNotNull()).withColumn("fp", squeezed_hash(F.col(text)))
    distinct = keyed.groupBy("fp", F.col(text).alias("__sql")).agg(F.lit(1).alias("__one")).drop("__one")
    kinds = ", ".join(x.replace(" ", ": ", 1) for x in FEATURES.split(", "))
    parsed = distinct.mapInPandas(run, f"fp bigint, __sql string, f struct<{kinds}>")
    return keyed.join(parsed.withColumnRenamed("fp", "__fp"), (keyed["fp"] == F.col("__fp")) & (keyed[text] == F.col("__sql")), "left").drop("__fp", "__sql")


def apply_rules(featured: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row a statement and rule that fires: rule_id, kind, severity, effort, confidence beside the statement's columns."""
    rules = RULES if rules is None else rules
    flat = featured.filter("f IS NOT NULL")
    cases = [F.when(_over_features(r.when), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.effort).alias("effort"), F.lit(r.confidence).alias("confidence"))) for r in rules]
    fired = flat.withColumn("__r", F.explode(F.array_compact(F.array(*cases))))
    kind = F.when(F.startswith("__r.rule_id", F.lit("MIG_")), "migration_safety").otherwise("sql_antipattern")
    return fired.withColumn("finding_kind", kind).select(*[c for c in featured.columns if c != "f"], "finding_kind", "__r.*")


def _over_features(predicate: str) -> Column:
    words = [w if w not in {*_COUNTS, *_FLAGS, "kind"} else f"f.{w}" for w in predicate.replace("(", "( ").split(" ")]
    return F.expr(" ".join(words))


def is_template(text: Column) -> Column:
    """Templated SQL of build tools, which is not linted."""
    return F.contains(text, F.lit("{{")) | F.contains(text, F.lit("{%"))


def split_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, line, sql of each statement of each file; client commands (lines with a leading backslash) are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for pdf in batches:
            rows = [(p, line, s) for p, t in zip(pdf["p"], pdf["t"]) for line, s in split_statements(re.sub(r"(?m)^\\.*$", "", t))]
            yield pd.DataFrame(rows, columns=["path", "line", "sql"])

    return files.select(F.col(path).alias("p"), F.col(content).alias("t")).filter(F.col("t").isNotNull() & ~is_template(F.col("t"))).mapInPandas(run, "path string, line int, sql string")


def lint_files(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """path, line, rule_id, ... of the statements of SQL files; a file of which nothing parses gets one row SQL_UNPARSABLE."""
    featured = statement_features(split_files(files))
    found = apply_rules(featured, rules).select("path", "line", "finding_kind", "rule_id", "severity", "effort", "confidence")
    dead = featured.groupBy("path").agg(F.count("f").alias("n")).filter("n = 0")
    marker = dead.select("path", F.lit(1).alias("line"), F.lit("sql_antipattern").alias("finding_kind"), F.lit("SQL_UNPARSABLE").alias("rule_id"), F.lit("low").alias("severity"), F.lit("trivial").alias("effort"), F.lit(1.0).alias("confidence"))
    return found.unionByName(marker)


# What tells the dialect, in the order in which sources are asked.
PROVIDERS = {"postgresql": "postgres", "postgres": "postgres", "mysql": "mysql", "sqlite": "sqlite", "sqlserver": "mssql", "cockroachdb": "postgres"}
PATH_WORDS = {"postgres": "postgres", "postgresql": "postgres", "mysql": "mysql", "mariadb": "mysql", "sqlite": "sqlite", "mssql": "mssql", "sqlserver": "mssql", "snowflake": "snowflake", "bigquery": "bigquery"}
DRIVER_WORDS = {"psycopg": "postgres", "asyncpg": "postgres", "tokio-postgres": "postgres", "lib/pq": "postgres", "pgx": "postgres", "\"pg\"": "postgres", "mysql": "mysql", "sqlite": "sqlite", "mssql": "mssql", "snowflake": "snowflake", "bigquery": "bigquery"}


def infer_dialect(provider: Column, path: Column, manifest: Column, url: Column) -> Column:
    """Schema provider, else a word in the path, else a driver in the manifest, else the connection URL's scheme, else generic."""
    table = lambda words: F.create_map(*[F.lit(x) for p in words.items() for x in p])

    def scan(text: Column, words: dict[str, str]) -> Column:
        out: Column = F.lit(None).cast("string")
        for w, d in reversed(words.items()):
            out = F.when(F.contains(F.lower(text), F.lit(w)), d).otherwise(out)
        return out

    scheme = F.regexp_extract(F.lower(url), r"^([a-z]+)", 1)
    return F.coalesce(F.try_element_at(table(PROVIDERS), F.lower(provider)), scan(path, PATH_WORDS), scan(manifest, DRIVER_WORDS), F.try_element_at(table(PROVIDERS), scheme), F.lit("generic"))
