"""Findings over symbols, outside calls and graph metrics: detectors, severity, duplicates, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stackloom.functions import predicates as P
from stackloom.functions.scalar import effort_rank, severity_rank

# Category of each kind of finding.
KIND_CATEGORY = {
    "orm": ["django_antipattern", "sqlalchemy_antipattern", "alembic_migration", "sql_ir_antipattern", "prisma_antipattern", "drizzle_antipattern",
            "typeorm_antipattern", "sequelize_antipattern", "mongoose_antipattern", "jpa_antipattern", "gorm_antipattern", "sqlx_antipattern"],
    "sql": ["sql_antipattern", "migration_safety"],
    "performance": ["n_plus_one", "expensive_compute", "memory_explosion", "hot_zone", "missing_caching", "smelly_loop"],
    "security": ["auth_crypto_antipattern"],
    "reliability": ["recursive", "blocking_in_async"],
    "observability": ["noisy_log", "log_amplification"],
    "ai": ["llm_antipattern"],
    "maintenance": ["outdated_package"],
}
# Confidence by the tier of evidence.
TIER_CONFIDENCE = {"imported_module": 0.95, "receiver_pattern": 0.80, "method_signature": 0.65}
BLOCKING = ["db", "network", "io"]
IMPURE = ["db", "network", "io", "queue"]

_COLUMNS = ["id", "kind", "severity", "effort", "confidence", "line", "evidence"]


def kind_category(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for c, kinds in KIND_CATEGORY.items() for k in kinds for x in (k, c)])[kind]


def orm_family(kind: Column) -> Column:
    """Name of the data layer a finding is about; null for kinds of none, and for those across layers."""
    return F.when((kind_category(kind) == "orm") & (kind != "sql_ir_antipattern"), F.regexp_replace(kind, "_(antipattern|migration)$", ""))


def detect(symbols: DataFrame, externals: DataFrame, metrics: DataFrame, bound: Column | None = None) -> DataFrame:
    """id, kind, severity, effort, confidence, line, evidence of all detectors that look at one symbol.

    ``symbols``: id, name, line, loc, complexity, nesting_depth, is_async (one row
    an id). ``externals``: src, name, category, tier, line, in_loop, in_await.
    ``metrics``: id, rank, call_sites, is_recursive (one row an id). Synthetic
    symbols are skipped. ``evidence`` lists the calls in question, sorted. ``bound``
    is the rank from which on code is hot, ``rank_bound`` of the metrics if not given.

    The calls are summed up once a symbol for all detectors and each symbol's
    findings are made from one row, so the plan does not grow with their number.
    """
    real = symbols.filter(~P.is_synthetic(F.col("name"))).select("id", "name", "line", "loc", "complexity", "nesting_depth", "is_async")
    call, category = F.col("name"), F.col("category")
    tier = F.create_map(*[F.lit(x) for p in TIER_CONFIDENCE.items() for x in p])[F.col("tier")]
    method = P.is_method_call(call)
    groups = {
        "looped": F.col("in_loop") & method & category.isin("db", "cache"), "waited": ~F.col("in_await") & method & category.isin(BLOCKING),
        "loop_logs": F.col("in_loop") & (category == "log"), "logs": category == "log",
    }
    gather = lambda cond: F.struct(F.min(F.when(cond, F.col("line"))).alias("line"), F.max(F.when(cond, tier)).alias("sure"), F.sort_array(F.collect_set(F.when(cond, call))).alias("evidence"), F.count_if(cond).alias("n"))
    calls = externals.groupBy(F.col("src").alias("id")).agg(*[gather(cond).alias(name) for name, cond in groups.items()], F.bool_or(category.isin(IMPURE)).alias("impure"))
    p90 = rank_bound(metrics) if bound is None else bound
    hot = metrics.select("id", ((F.col("rank") >= p90) & (p90 > 0)).alias("hot"), "call_sites", "is_recursive")
    rows = real.join(hot, "id", "left").join(calls, "id", "left")
    high, medium, trivial, small = F.lit("high"), F.lit("medium"), F.lit("trivial"), F.lit("small")
    cx, loc, deep = F.col("complexity"), F.col("loc"), F.col("nesting_depth")
    grade = F.when((cx >= 15) | (loc >= 150), "high").when((cx >= 10) | (loc >= 80), "medium").otherwise("low")
    work = F.when((loc >= 150) | (deep >= 5), "large").when((loc >= 80) | (cx >= 15), "medium").otherwise("small")
    of = lambda name: (F.col(f"{name}.n") > 0, F.col(f"{name}.line"), F.col(f"{name}.evidence"))
    (looped, *looped_at), (waited, *waited_at), (loop_logs, *loop_logs_at), (_, *logs_at) = map(of, groups)
    plain_at = [F.col("line"), F.array().cast("array<string>")]
    cachable = (F.col("call_sites") >= 5) & ((cx >= 5) | (loc >= 20)) & ~F.col("is_recursive") & P.is_method_call(F.col("name")) & ~F.coalesce("impure", F.lit(False))
    kinds = [
        (looped, "n_plus_one", high, small, F.col("looped.sure"), looped_at),
        (F.col("is_async") & waited, "blocking_in_async", high, trivial, F.col("waited.sure"), waited_at),
        (loop_logs, "noisy_log", F.when(F.col("hot"), "high").otherwise("medium"), trivial, F.lit(0.85), loop_logs_at),
        ((cx >= 10) | (loc >= 80) | (deep >= 4), "expensive_compute", grade, work, F.lit(0.70), plain_at),
        (F.col("is_recursive"), "recursive", medium, medium, F.lit(1.0), plain_at),
        (cachable, "missing_caching", medium, small, F.lit(0.55), plain_at),
        ((F.col("logs.n") >= 3) & (F.col("hot") | (F.col("call_sites") >= 10)), "log_amplification", medium, trivial, F.lit(0.80), logs_at),
    ]
    each = [F.when(cond, F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), effort.alias("effort"), confidence.cast("double").alias("confidence"), line.alias("line"), evidence.alias("evidence"))) for cond, kind, severity, effort, confidence, (line, evidence) in kinds]
    return rows.select("id", F.explode(F.array_compact(F.array(*each))).alias("__f")).select("id", "__f.*").select(*_COLUMNS)


def rank_bound(metrics: DataFrame) -> Column:
    """The rank at the 90th percentile, zero without any: a scalar subquery."""
    from stackloom.operators.graph import floor_percentile

    return F.coalesce(floor_percentile(metrics, "rank", 0.9).scalar(), F.lit(0.0))


def bump_severity(findings: DataFrame, percent: Column, rank: Column, call_sites: Column, p90: float | Column) -> DataFrame:
    """Raise severities of findings on hot code, before duplicates are dropped.

    Boosts: a fifth of the total or more, a rank at the 90th percentile or above,
    ten call sites or more. Low needs two for medium and three for high, medium
    needs two. Without a positive percentile nothing changes.
    """
    p90 = p90 if isinstance(p90, Column) else F.lit(float(p90))
    boosts = F.when(p90 > 0, F.coalesce((percent >= 20).cast("int"), F.lit(0)) + F.coalesce((rank >= p90).cast("int"), F.lit(0)) + F.coalesce((call_sites >= 10).cast("int"), F.lit(0))).otherwise(0)
    s = F.col("severity")
    return findings.withColumn("severity", F.when((s == "low") & (boosts == 3), "high").when((s == "low") & (boosts == 2), "medium").when((s == "medium") & (boosts >= 2), "high").otherwise(s))


def drop_duplicates(findings: DataFrame, order: list[str]) -> DataFrame:
    """The first finding, by ``order``, of each node, kind, first evidence and line."""
    first = F.coalesce(F.get("evidence", F.lit(0)), F.lit(""))
    rest = findings.columns
    got = findings.groupBy("id", "kind", first.alias("__e"), F.col("line").alias("__l")).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__r"))
    return got.select(*[F.col(f"__r.{c}").alias(c) for c in rest])


def counts_by(findings: DataFrame, what: str) -> DataFrame:
    """Findings by kind, severity, category or family."""
    column = {"category": kind_category(F.col("kind")), "family": orm_family(F.col("kind"))}.get(what, F.col(what))
    return findings.groupBy(column.alias(what)).agg(F.count("*").alias("n"))


def quota(df: DataFrame, kind: str, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows by ``order`` when no kind may hold more than max(3, cap / 4) of them."""
    most = max(3, cap // 4)
    # a kind's surplus is dropped by its own rank; the window is filtered, so Spark keeps only ``most`` rows a kind and task
    ranked = df.withColumn("__n", F.row_number().over(W.partitionBy(kind).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")
    return ranked.orderBy(*order).limit(cap)


def top_findings(findings: DataFrame, cap: int = 50) -> DataFrame:
    return quota(findings, "kind", [severity_rank(F.col("severity")).desc(), F.col("file"), F.col("line"), F.col("id"), F.col("kind")], cap)


def immediate_fixes(findings: DataFrame, cap: int = 50) -> DataFrame:
    """Findings above low severity that take little effort."""
    rows = findings.filter((F.col("severity") != "low") & F.col("effort").isin("trivial", "small"))
    return quota(rows, "kind", [severity_rank(F.col("severity")).desc(), effort_rank(F.col("effort")), F.col("file"), F.col("line"), F.col("id"), F.col("kind")], cap)


def refactor_candidates(findings: DataFrame, symbols: DataFrame, cap: int = 30) -> DataFrame:
    """Symbols with several findings, one that takes large effort, or a hundred lines and one finding."""
    each = findings.groupBy("id").agg(
        F.count("*").alias("findings"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.max_by("severity", severity_rank(F.col("severity"))).alias("worst_severity"),
        F.max_by("effort", effort_rank(F.col("effort"))).alias("max_effort"), F.bool_or(F.col("effort") == "large").alias("large"),
    )
    rows = each.join(symbols.select("id", "name", "file", "line", "loc", "complexity"), "id").filter("findings >= 2 OR large OR loc >= 100")
    return rows.orderBy(F.desc("findings"), F.desc(F.col("loc") + F.col("complexity")), "file", "id").limit(cap)


def category_top(findings: DataFrame, cap: int = 50) -> DataFrame:
    """The leading findings of each category by severity times confidence."""
    score = severity_rank(F.col("severity")) * F.col("confidence")
    rows = findings.withColumns({"category": kind_category(F.col("kind")), "score": score})
    place = F.row_number().over(W.partitionBy("category").orderBy(F.desc("score"), "id", "kind", "line"))
    return rows.withColumn("place", place).filter(F.col("place") <= cap)


def merge_lanes(lanes: list[DataFrame], keys: list[str], order: list[str], cap: int = 24) -> DataFrame:
    """Several ranked lists one after the other, the first occurrence of each key counting."""
    rows = lanes[0].withColumn("__lane", F.lit(0))
    for i, lane in enumerate(lanes[1:], 1):
        rows = rows.unionByName(lane.withColumn("__lane", F.lit(i)))
    rest = [c for c in rows.columns if c not in ("__lane", *order)]
    one = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct("__lane", *order, *rest)).alias("__r"))
    return one.select("__r.*").orderBy("__lane", *order).limit(cap).drop("__lane")


def roots_overview(roots: DataFrame, findings: DataFrame, edges: DataFrame, names: DataFrame, first: int = 5) -> DataFrame:
    """Per root: size and its share of all, findings by severity, callers, the first callees by name. Largest first.

    ``roots``: id, size. ``findings``: root, severity. Shares are of the roots' sizes
    together.
    """
    total = F.coalesce(roots.agg(F.sum("size")).scalar(), F.lit(0))
    by = findings.groupBy("root", "severity").count().groupBy("root").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "count")))).alias("severities"))
    up = edges.groupBy("dst").agg(F.count("*").alias("callers"))
    called = edges.join(roots.select(F.col("id").alias("src")), "src").join(names.select(F.col("id").alias("dst"), "name"), "dst")
    down = called.withColumn("__n", F.row_number().over(W.partitionBy("src").orderBy("ord", "dst"))).filter(F.col("__n") <= first).groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", "name"))), lambda x: x["name"]).alias("callees"))
    got = roots.join(by, roots["id"] == by["root"], "left").join(up, roots["id"] == up["dst"], "left").join(down, roots["id"] == down["src"], "left")
    share = F.coalesce(F.try_divide(F.col("size"), total) * 100, F.lit(0.0))
    return got.select("id", "size", share.alias("percent"), "severities", F.coalesce("callers", F.lit(0)).alias("callers"), "callees").orderBy(F.desc("size"), "id")
