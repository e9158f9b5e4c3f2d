"""Queries of source analysis, findings views, portal lists, stores and text formats over the whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stackloom.functions import scalar as S
from stackloom.lint import chainrules
from stackloom.operators import analysis, findings as fd, graph, joins, portal, profile, reports, shred
from stackloom.plans import profile_queries as base
from stackloom.session import materialize
from stackloom.sources import code, events as ev, stacks

_read = base._read

# A source file of each language with what its chain rules look for; {k} is the part's key.
CHAIN_FILES = {
    "py": base._CODE,
    "java": """import javax.persistence.Entity;
public class S{k} {
  @OneToMany(fetch = FetchType.EAGER)
  private List<A> as;
  public void run(List<Long> ids) {
    for (Long id : ids) {
      userRepository.findById(id);
      userRepository.save(id);
    }
  }
}
""",
    "js": """import { Sequelize } from 'sequelize';
async function run{k}(ids) {
  for (const id of ids) {
    await User.findByPk(id);
    await user.save();
  }
  await sequelize.query(`select ${ids}`);
}
""",
    "ts": """import { PrismaClient } from '@prisma/client';
export async function run{k}(ids: number[]) {
  for (const id of ids) {
    await db.user.findUnique({ where: { id } });
  }
  await db.user.findMany({ skip: 5000, orderBy: { id: 1 } });
  await db.$queryRawUnsafe(`select ${ids}`);
}
""",
    "go": """package a
import (
  "gorm.io/gorm"
)
func Load{k}(ids []int) error {
  for _, id := range ids {
    db.Where("id = ?", id).First(&u)
    db.Create(&u)
  }
  db.AutoMigrate(&U{})
  return nil
}
""",
    "rs": """use sqlx::PgPool;
async fn load_{k}(pool: &PgPool, ids: Vec<i32>) {
    for id in ids {
        sqlx::query("select a from t where id = $1").bind(id).fetch_one(pool).await;
    }
    sqlx::query(&format!("select {}", 1)).fetch_all(pool).await;
}
""",
    "scala": """import org.hibernate.Session
class S{k} {
  def run(ids: List[Long]): Unit = {
    for (id <- ids) {
      userRepository.findById(id)
    }
  }
}
""",
    "kt": """import org.springframework.data.jpa.repository.JpaRepository
class S{k} {
  fun run(ids: List<Long>) {
    for (id in ids) {
      userRepository.save(id)
    }
  }
}
""",
}
# A source file of each language in which one function calls another, and that one a database in a loop.
CALL_FILES = {
    "py": """import logging
from sqlalchemy import text
log = logging.getLogger("a")


def load_{k}(ids):
    out = []
    for i in ids:
        out.append(session.execute(i))
    return out


def handle_{k}(ids):
    log.info("start")
    return load_{k}(ids)
""",
    "java": """import java.sql.Connection;
public class S{k} {
  public void load_{k}(List<Long> ids) {
    for (Long id : ids) {
      connection.prepareStatement(id);
    }
  }
  public void handle_{k}(List<Long> ids) {
    load_{k}(ids);
  }
}
""",
    "js": """const pg = require('pg');
function load_{k}(ids) {
  for (const id of ids) {
    pool.query(id);
  }
}
function handle_{k}(ids) {
  load_{k}(ids);
}
""",
    "ts": """import { Client } from 'pg';
function load_{k}(ids: number[]): void {
  for (const id of ids) {
    db.query(id);
  }
}
function handle_{k}(ids: number[]): void {
  load_{k}(ids);
}
""",
    "go": """package a
import (
  "database/sql"
)
func load_{k}(ids []int) {
  for _, id := range ids {
    db.QueryRow(id)
  }
}
func handle_{k}(ids []int) {
  load_{k}(ids)
}
""",
    "rs": """use sqlx::PgPool;
fn load_{k}(ids: Vec<i32>) {
    for id in ids {
        pool.fetch_one(id);
    }
}
fn handle_{k}(ids: Vec<i32>) {
    load_{k}(ids);
}
""",
    "scala": """import slick.jdbc.JdbcBackend
object S{k} {
  def load_{k}(ids: List[Long]): Unit = {
    for (id <- ids) {
      db.execute(id)
    }
  }
  def handle_{k}(ids: List[Long]): Unit = {
    load_{k}(ids)
  }
}
""",
    "kt": """import org.jetbrains.exposed.sql.Database
fun load_{k}(ids: List<Long>) {
  for (id in ids) {
    connection.executeQuery(id)
  }
}
fun handle_{k}(ids: List<Long>) {
  load_{k}(ids)
}
""",
}


def _sources(spark: SparkSession, sf_dir: str, texts: dict[str, str]) -> DataFrame:
    """A source file for each part, the languages in turn."""
    n = F.col("p_partkey")
    turn = (n % len(texts)).cast("int")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), turn)
    return _read(spark, sf_dir, "part").select(
        F.concat(F.lit("src/p"), n.cast("string"), F.lit("."), pick(texts)).alias("path"), F.replace(pick(texts.values()), F.lit("{k}"), n.cast("string")).alias("content")
    )


def code_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain rules, predictions and their fusion over files of eight languages."""
    return chainrules.scan_files(_sources(spark, sf_dir, CHAIN_FILES)).select("file", "line", "rule_id", "severity", F.round("confidence", 6).alias("confidence"), F.array_join("fused", ",").alias("fused"))


def code_rule_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chainrules.rule_histogram(code_scan(spark, sf_dir))


def code_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole scan of files of eight languages: its edges, roots, classified calls and findings, told apart by ``what``."""
    got = analysis.analyze(_sources(spark, sf_dir, CALL_FILES))
    rows = lambda what, df, a, b: df.select(F.lit(what).alias("what"), a.alias("subject"), b.alias("detail"))
    c = F.col
    parts = [
        rows("edge", got["edges"], c("src"), c("dst")), rows("external", got["externals"], c("src"), F.concat_ws(" ", "category", "name", c("in_loop").cast("string"))),
        rows("finding", got["findings"], c("id"), F.concat_ws(" ", "kind", "severity", c("line").cast("string"))), rows("language", reports.language_share(got["languages"]), c("language"), c("files").cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def code_root_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the roots of largest reach: complexity and smells below, and what is called outside by category."""
    got = analysis.analyze(_sources(spark, sf_dir, CALL_FILES))
    totals = analysis.category_totals(got["trees"], got["externals"]).groupBy("root").pivot("category", analysis.CATEGORIES).agg(F.first("n"))
    return analysis.root_sums(got["trees"], got["symbols"], got["findings"]).join(totals, "root")


# -- findings


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base._findings(spark, sf_dir).join(base._symbols(spark, sf_dir).select("id", "file"), "id")


def immediate_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.immediate_fixes(_placed(spark, sf_dir)).select("id", "kind", "severity", "effort", "file", "line")


def category_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.category_top(_placed(spark, sf_dir)).select("category", "place", "id", "kind", F.round("score", 6).alias("score"))


def findings_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of data layers by family: here kinds are made from the order's key."""
    kinds = [k for group in fd.KIND_CATEGORY.values() for k in group]
    rows = _read(spark, sf_dir, "orders").select(F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("o_orderkey") % len(kinds)).cast("int")).alias("kind"))
    return fd.counts_by(rows, "family")


def finding_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities raised on hot code; percentages, ranks and call sites follow from the key."""
    k = F.col("id").cast("bigint")
    metrics = base._symbols(spark, sf_dir).select("id", (k % 1000).cast("double").alias("rank"))
    rows = base._findings(spark, sf_dir)
    got = fd.bump_severity(rows, (k % 100).cast("double"), (k % 1000).cast("double"), k % 25, fd.rank_bound(metrics))
    return got.groupBy("kind", "severity").agg(F.count("*").alias("n"))


def finding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding twice, the second time of low severity: the first one stays."""
    rows = base._findings(spark, sf_dir)
    twice = rows.withColumn("ord", F.lit(1)).unionByName(rows.withColumns({"ord": F.lit(2), "severity": F.lit("low")}))
    return fd.drop_duplicates(twice, ["ord"]).groupBy("kind", "severity", "ord").agg(F.count("*").alias("n"))


def suggestion_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Immediate fixes, then the top findings, the first of each file, line and kind."""
    from pyspark.sql import Window as W

    order = [S.severity_rank(F.col("severity")).desc(), "file", "line", "id", "kind"]
    lane = lambda df: df.select("id", "kind", "severity", "file", "line").withColumn("place", F.row_number().over(W.orderBy(*order)))  # noqa: E731  # lanes hold 50 rows at most
    rows = materialize(_placed(spark, sf_dir), "findings")
    return fd.merge_lanes([lane(fd.immediate_fixes(rows)), lane(fd.top_findings(rows))], ["file", "line", "kind"], ["place"]).select("id", "kind", "file", "line")


def findings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = base._symbols(spark, sf_dir).filter("is_async")
    return reports.view(_placed(spark, sf_dir), ["n_plus_one", "blocking_in_async"], ["high"], entries).select("id", "kind", "file", "line")


def roots_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols as roots, sized by their lines."""
    s, (_, e) = base._symbols(spark, sf_dir), base._graph(spark, sf_dir)
    got = fd.roots_overview(s.select("id", F.col("loc").alias("size")), base._findings(spark, sf_dir).withColumnRenamed("id", "root"), e, s.select("id", "name"))
    count = lambda w: F.coalesce(got["severities"][w], F.lit(0)).alias(w)
    return got.select("id", "size", F.round("percent", 9).alias("percent"), count("high"), count("medium"), count("low"), "callers", F.coalesce(F.array_join("callees", ","), F.lit("")).alias("callees"))


def report_diff_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries are customers, categories the statuses and smells the priorities of their orders, before May 1998 against later ones."""
    o = _read(spark, sf_dir, "orders").withColumn("entry", F.col("o_custkey").cast("string"))
    cut = F.lit("1998-05-01").cast("timestamp_ntz")

    def side(rows: DataFrame) -> dict[str, DataFrame]:
        return {
            "entries": rows.groupBy("entry").agg(F.count("*").alias("complexity")), "categories": rows.groupBy("entry", F.col("o_orderstatus").alias("category")).agg(F.count("*").alias("n")),
            "smells": rows.select("entry", F.col("o_orderstatus").alias("node"), F.col("o_orderpriority").alias("smell")).distinct(),
        }

    return reports.diff_reports(side(o.filter(F.col("o_orderdate") < cut)), side(o.filter(F.col("o_orderdate") >= cut)))


# -- trees


def tree_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes below the root, the heaviest first."""
    tree = profile.call_tree(base._samples(spark, sf_dir, ["name", "file", "line", "qualified_name", "module", "is_system"]))
    return profile.tree_children(tree, []).select("name", "value", "self_value")


def sampled_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = profile.to_static_report(profile.call_tree(base._samples(spark, sf_dir, ["name", "file", "line", "qualified_name", "module", "is_system"])))
    return tree.groupBy("kind", "depth").agg(F.count("*").alias("nodes"), F.sum("value_ns").alias("value_ns"), F.sum("self_ns").alias("self_ns"), F.sum("ncalls").alias("ncalls"))


def sampled_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.report_summary(profile.call_tree(base._samples(spark, sf_dir, ["name", "file", "line", "qualified_name", "module", "is_system"])))


# -- portal


def _portal(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as changes, nations as repositories, regions as departments, orders as scans, order lines as their issues."""
    o = _read(spark, sf_dir, "orders")
    return {
        "changes": _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("change_id"), F.col("c_nationkey").alias("repo_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("status"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("value")),
        "repos": _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("repo_id"), F.col("n_name").alias("repo"), F.col("n_regionkey").alias("department_id")),
        "departments": _read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("department_id"), F.col("r_name").alias("department")),
        "scans": o.select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("change_id"), F.col("o_orderstatus").alias("verdict"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("p95"), F.col("o_orderdate").alias("profiled_at")),
        "issues": _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("severity"), F.col("l_partkey").alias("rule")),
    }


def portal_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _portal(spark, sf_dir)
    return portal.change_list(t["changes"], t["repos"], t["departments"], t["scans"]).select("change_id", "title", "status", "repo", "department", "verdict", "p95")


def portal_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _portal(spark, sf_dir)
    return portal.change_list(t["changes"], t["repos"], t["departments"], t["scans"], status="BUILDING", repo=None, department=["ASIA", "EUROPE"]).select("change_id", "repo", "department", "verdict")


def portal_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _portal(spark, sf_dir)
    rows = portal.change_list(t["changes"], t["repos"], t["departments"], t["scans"])
    return portal.with_level_totals(rows, t["changes"], t["repos"], "value").select("change_id", "value", "repo_total", "department_total", "total")


def portal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portal.split_totals(_portal(spark, sf_dir)["changes"], "status", {"done": ["BUILDING", "MACHINERY"], "open": ["AUTOMOBILE"]}, ["value"])


def portal_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _portal(spark, sf_dir)
    return portal.recent_scans(t["scans"], t["changes"], t["repos"], "profiled_at").select("scan_id", "change_id", "repo", "p95")


def portal_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _portal(spark, sf_dir)
    got = portal.scan_details(t["scans"], {"issues": (t["issues"], ["line", "severity", "rule"])})
    return got.select("scan_id", F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["line"].cast("string"), x["severity"], x["rule"].cast("string"))), ",").alias("issues"))


def portal_issue_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = portal.capped(_portal(spark, sf_dir)["issues"], ["scan_id"], [F.col("line"), F.col("rule")], {"R": 1, "A": 2}, "severity", 3)
    return got.groupBy("scan_id", "severity").agg(F.count("*").alias("n"))


# -- stores and formats


def scan_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_catalog(_read(spark, sf_dir, "stored_scans"))


def suggestion_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "saved_suggestions").select("scan_id", "path", "written_at", "file_id")
    return reports.suggestion_history(rows, ["scan_id"], "written_at").select("scan_id", "versions", "file_id")


def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the nation and name of the customer of their key, where these are given."""
    left = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), "s_acctbal")
    new = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"), F.when(F.col("c_acctbal") <= 0, F.col("c_nationkey")).alias("nation"))
    return joins.patch(left, new, ["k"]).select("k", "name", "nation")


def log_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each profiling session with the number and times of its lines; sessions without lines have none."""
    logs = joins.last_delivery(_read(spark, sf_dir, "event_logs"), ["log_id"], "started_at")
    meta = profile.window_metadata(base._events(spark, sf_dir, ["time", "service", "pod"]), ["log_id"]).select("log_id", "events", "duration_us")
    return logs.join(meta, "log_id", "left").select("log_id", "path", "service", "agent_version", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("duration_us", F.lit(0)).alias("duration_us"))


def folded_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as folded lines and read again."""
    lines = stacks.fold(base._samples(spark, sf_dir, ["name"])).select(F.concat_ws(" ", "stack", F.col("count").cast("string")).alias("value"))
    return stacks.parse_folded(lines).groupBy(F.size(F.split("stack", ";", -1)).alias("depth")).agg(F.count("*").alias("stacks"), F.sum("count").alias("ticks"))


def container_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of container statistics made from the orders, read and summed."""
    k = F.col("o_orderkey")
    text = F.to_json(F.struct(
        F.concat((k % 1000 / 10).cast("decimal(8,1)").cast("string"), F.lit("%")).alias("CPUPerc"), F.concat((k % 500).cast("string"), F.lit("MiB / 2GiB")).alias("MemUsage"),
        F.concat((k % 70).cast("string"), F.lit("kB / "), (k % 30).cast("string"), F.lit("MB")).alias("NetIO"), F.when(k % 5 > 0, F.concat((k % 9).cast("string"), F.lit("KiB / 1.5kB"))).alias("BlockIO"),
    ))
    got = ev.parse_container_stats(_read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("s"), text.alias("value")))
    return got.groupBy("s").agg(
        F.count("*").alias("n"), F.round(F.sum("cpu_pct"), 3).alias("cpu"), F.sum("mem_mb").cast("bigint").alias("mem_mb"), F.sum("net_rx").alias("rx"), F.sum("net_tx").alias("tx"), F.sum("block_read").alias("block_read"), F.sum("block_write").alias("block_write")
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as relayed messages, unwrapped, parsed and counted by type."""
    fields = ["type", "time", "service", "period_ns", "count", "qualname", "duration_ns", "status"]
    rows = base._events(spark, sf_dir, fields)
    relayed = rows.select(F.to_json(F.struct(F.lit("broadcast").alias("type"), F.when(F.col("status").isNull(), "event").otherwise("other").alias("event"), F.to_json(F.struct(*fields)).alias("payload"))).alias("value"))
    got = ev.parse_events(ev.unwrap_envelope(relayed))
    return got.groupBy("type").agg(F.count("*").alias("events"), F.sum("count").alias("ticks"))


def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled call tree of each log written as a compact report, read and shredded again: nodes by depth."""
    samples = profile.stack_samples(base._events(spark, sf_dir, base._SAMPLED), ["log_id"])
    tree = profile.call_tree(samples, ["log_id"]).withColumn("key", F.array_join("path", "\x01")).withColumn("up", F.when(F.col("depth") > 1, F.array_join("parent_path", "\x01")))
    nodes = tree.select(
        F.col("log_id").alias("report_id"), F.lit(0).alias("entry"), "name", "file", "line", S.symbol_kind(F.col("qualname")).alias("kind"), S.parent_class(F.col("qualname")).alias("parent_class"),
        # names stand in depth-first order when their paths are sorted as arrays of names
        F.struct("path").alias("order"), "key", "up",
    )
    from pyspark.sql import Window as W

    placed = nodes.withColumn("node_ord", F.row_number().over(W.partitionBy("report_id").orderBy("order")))  # one report is one document
    above = placed.select("report_id", F.col("key").alias("up"), F.col("node_ord").alias("parent_ord"))
    texts = reports.compact_reports(placed.join(above, ["report_id", "up"], "left"))
    texts = texts.withColumn("content", F.udf(shred.expand_report, "string", useArrow=True)("content"))
    rows = shred.shred_files(texts, "report_id", "content", (shred.Entity("node", (("report", "entries"),), recursive="children"),))
    return rows.groupBy(F.size(F.split("row_path", r"\.")).alias("depth"), F.col("cells")["name"].alias("name")).agg(F.count("*").alias("nodes"))




QUERIES = {
    f.__name__: f
    for f in (
        code_scan, code_rule_histogram, code_analysis, code_root_sums, immediate_fixes, category_top, findings_by_family, finding_bump, finding_dedup, suggestion_queue, findings_view, roots_overview, report_diff_full,
        tree_top, sampled_report, sampled_summary, portal_changes, portal_filtered, portal_totals, portal_split, portal_recent, portal_details, portal_issue_caps, scan_catalog, suggestion_history, patch, log_sessions,
        folded_round_trip, container_stats, event_lines, report_round_trip,
    )
}
