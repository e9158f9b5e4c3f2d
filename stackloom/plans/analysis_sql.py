"""DuckDB counterparts of the analysis queries, over the whole tables."""

from stackloom.plans.profile_sql import _CATEGORY, _EDGES, _EFFORT, _EVENTS, _FINDINGS, _RANK, _SAMPLES, _TIME, _TREE

_ORDER = f"{_RANK} DESC, file, line, id"
_PLACED = _FINDINGS + f""", o AS (SELECT f.*, s.file, {_RANK} AS r, {_EFFORT} AS e FROM found f JOIN sym s ON s.id = f.id
), fx AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY r DESC, e, file, line, id) AS n FROM o WHERE severity <> 'low' AND effort IN ('trivial', 'small')
), fixes AS (SELECT * FROM fx WHERE n <= 12 ORDER BY r DESC, e, file, line, id, kind LIMIT 50
), tx AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY r DESC, file, line, id) AS n FROM o
), tops AS (SELECT * FROM tx WHERE n <= 12 ORDER BY r DESC, file, line, id, kind LIMIT 50
)"""
_KINDS = """django_antipattern sqlalchemy_antipattern alembic_migration sql_ir_antipattern prisma_antipattern drizzle_antipattern typeorm_antipattern sequelize_antipattern mongoose_antipattern jpa_antipattern gorm_antipattern
sqlx_antipattern sql_antipattern migration_safety n_plus_one expensive_compute memory_explosion hot_zone missing_caching smelly_loop auth_crypto_antipattern recursive blocking_in_async noisy_log log_amplification llm_antipattern outdated_package"""
_FAMILIES = ["django", "sqlalchemy", "alembic", None, "prisma", "drizzle", "typeorm", "sequelize", "mongoose", "jpa", "gorm", "sqlx"] + [None] * 15
_PORTAL = """
WITH last AS (SELECT o_custkey AS change_id, max(o_orderkey) AS scan_id FROM orders GROUP BY 1
), ch AS (
  SELECT c_custkey AS change_id, c_name AS title, c_mktsegment AS status, n_name AS repo, n_nationkey AS repo_id, r_name AS department, r_regionkey AS department_id, o_orderstatus AS verdict,
    CAST(round(o_totalprice * 100) AS BIGINT) AS p95, l.scan_id, o_orderdate AS profiled_at, CAST(round(c_acctbal * 100) AS BIGINT) AS value
  FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN last l ON l.change_id = c_custkey LEFT JOIN orders ON o_orderkey = l.scan_id
)"""
_LOG_SAMPLES = (
    _SAMPLES.replace("SELECT type, cpu, period_ns", "SELECT log_id, type, cpu, period_ns").replace("SELECT n * period_ns", "SELECT log_id, n * period_ns").replace("SELECT duration_ns // 1000", "SELECT log_id, duration_ns // 1000")
)
_HEAD = "left(content, 8192)"


def _grab(key: str) -> str:
    return f"nullif(regexp_extract({_HEAD}, '\"{key}\"\\s*:\\s*\"((?:[^\"\\\\]|\\\\.)*)\"', 1), '') AS {key}"


# What fires in each file of the chain-rule query, by the file's number: line, rule, severity, confidence, rules fused in. Worked out by hand:
# a rule's own confidence, with the predicted statements of the same code merged by 1 - (1 - a)(1 - b)...
_CHAINS = """
0 5 DJ-PERF-006 high 0.85
0 5 DJ-PERF-008 low 0.65
0 6 DJ-PERF-007 high 0.968 SQLIR-012
0 7 DJ-N1-003 medium 0.95
1 3 JPA-EAGER-003 medium 0.85
1 7 JPA-N1-001 high 0.9
1 8 JPA-SAVE-004 high 0.9
2 4 SEQ-N1-001 high 0.9425 SQLIR-012
2 5 SEQ-SAVE-003 high 0.85
2 7 SEQ-RAW-002 high 0.95
3 4 PRI-N1-002 high 0.98976 SQLIR-001,SQLIR-005
3 6 PRI-PAG-004 high 0.996339 SQLIR-001,SQLIR-012,SQLIR-013
3 7 PRI-RAW-003 high 0.95
4 7 GORM-N1-001 high 0.9425 SQLIR-012
4 8 GORM-SAVE-004 high 0.9
4 10 GORM-AUTO-003 high 0.95
5 4 SQLX-N1-002 high 0.85
5 6 SQLX-FETCH-003 medium 0.75
5 6 SQLX-RAW-001 high 0.95
6 5 JPA-N1-001 high 0.9
7 5 JPA-SAVE-004 high 0.9
"""
_CHAIN_ROWS = ", ".join("({}, {}, '{}', '{}', CAST({} AS DOUBLE), '{}')".format(*(row.split() + [""])[:6]) for row in _CHAINS.strip().splitlines())
# Of each file of the analysis query: extension, language, class around the functions, line of the call in the loop, its name, and whether the name is a constructor's, which is no finding.
_FILES = """
0 py python - 9 execute false
1 java java S 5 prepareStatement false
2 js javascript - 4 query false
3 ts typescript - 4 query false
4 go go - 7 QueryRow true
5 rs rust - 4 fetch_one false
6 scala scala S 5 execute false
7 kt kotlin - 4 executeQuery false
"""
_FILE_ROWS = ", ".join("({}, '{}', '{}', '{}', {}, '{}', {})".format(*row.replace(" - ", "  ").split(" ")) for row in _FILES.strip().splitlines())
_SOURCES = f"""
WITH f(i, ext, language, owner, line, call, constructor) AS (VALUES {_FILE_ROWS}
), s AS (SELECT p_partkey AS k, f.*, 'src/p' || p_partkey || '.' || ext AS file, 'src/p' || p_partkey || '.' || ext || '::' || CASE WHEN owner <> '' THEN owner || p_partkey ELSE '' END || '::' AS pre FROM part JOIN f ON f.i = p_partkey % 8
)"""

SQL = {
    "code_scan": f"""{_SOURCES}, c(i, line, rule_id, severity, confidence, fused) AS (VALUES {_CHAIN_ROWS}) SELECT file, c.line, rule_id, severity, confidence, fused FROM s JOIN c ON c.i = s.i""",
    "code_rule_histogram": f"""{_SOURCES}, c(i, line, rule_id, severity, confidence, fused) AS (VALUES {_CHAIN_ROWS}) SELECT rule_id, count(*) AS n FROM s JOIN c ON c.i = s.i GROUP BY rule_id""",
    "code_analysis": _SOURCES + """
SELECT 'edge' AS what, pre || 'handle_' || k AS subject, pre || 'load_' || k AS detail FROM s
UNION ALL SELECT 'external', pre || 'load_' || k, 'db ' || call || ' true' FROM s UNION ALL SELECT 'external', pre || 'handle_' || k, 'log info false' FROM s WHERE ext = 'py' UNION ALL SELECT 'external', pre || '<module>', 'log getLogger false' FROM s WHERE ext = 'py'
UNION ALL SELECT 'finding', pre || 'load_' || k, 'n_plus_one high ' || line FROM s WHERE NOT constructor UNION ALL SELECT 'language', language, CAST(count(*) AS VARCHAR) FROM s GROUP BY language""",
    "code_root_sums": _SOURCES + """
SELECT pre || 'handle_' || k AS root, CAST(3 AS BIGINT) AS complexity, CAST(CASE WHEN constructor THEN 0 ELSE 1 END AS BIGINT) AS smells, 2 AS db, 0 AS network, 0 AS io, 0 AS cache, 0 AS queue, CASE WHEN ext = 'py' THEN 2 ELSE 0 END AS log, 0 AS compute
FROM s ORDER BY 'handle_' || k, pre LIMIT 200""",
    "immediate_fixes": _PLACED + " SELECT id, kind, severity, effort, file, line FROM fixes",
    "category_top": _PLACED + f""", c AS (SELECT *, {_CATEGORY} AS category, r * confidence AS score FROM o), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, id, kind, line) AS INT) AS place FROM c)
SELECT category, place, id, kind, round(score, 6) AS score FROM n WHERE place <= 50""",
    "findings_by_family": f"""WITH k AS (SELECT i - 1 AS i, f FROM (SELECT unnest([{', '.join(repr(f) if f else 'NULL' for f in _FAMILIES)}]) AS f, generate_subscripts([{', '.join('1' for _ in _FAMILIES)}], 1) AS i))
SELECT f AS family, count(*) AS n FROM orders JOIN k ON k.i = o_orderkey % {len(_KINDS.split())} GROUP BY f""",
    "finding_bump": _FINDINGS + """, b AS (SELECT kind, severity, CAST(id AS BIGINT) AS k FROM found
), c AS (SELECT kind, severity, CASE WHEN (SELECT v FROM p90) > 0 THEN (k % 100 >= 20)::INT + (k % 1000 >= (SELECT v FROM p90))::INT + (k % 25 >= 10)::INT ELSE 0 END AS n FROM b)
SELECT kind, CASE WHEN severity = 'low' AND n = 3 THEN 'high' WHEN severity = 'low' AND n = 2 THEN 'medium' WHEN severity = 'medium' AND n >= 2 THEN 'high' ELSE severity END AS severity, count(*) AS n FROM c GROUP BY 1, 2""",
    "finding_dedup": _FINDINGS + " SELECT kind, severity, 1 AS ord, count(*) AS n FROM found GROUP BY 1, 2",
    "suggestion_queue": _PLACED + """, l AS (
  SELECT 0 AS lane, row_number() OVER (ORDER BY r DESC, file, line, id, kind) AS place, id, kind, file, line FROM fixes UNION ALL SELECT 1, row_number() OVER (ORDER BY r DESC, file, line, id, kind), id, kind, file, line FROM tops
), q AS (SELECT *, row_number() OVER (PARTITION BY file, line, kind ORDER BY lane, place) AS n FROM l)
SELECT id, kind, file, line FROM q WHERE n = 1 ORDER BY lane, place LIMIT 24""",
    "findings_view": _PLACED + " SELECT o.id, o.kind, o.file, o.line FROM o JOIN sym USING (id) WHERE o.kind IN ('n_plus_one', 'blocking_in_async') AND o.severity = 'high' AND sym.is_async",
    "roots_overview": _FINDINGS + f""", g AS ({_EDGES}), f AS (SELECT id, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium, count_if(severity = 'low') AS low FROM found GROUP BY id
), up AS (SELECT dst AS id, count(*) AS callers FROM g GROUP BY dst
), d AS (SELECT g.src AS id, s.name, row_number() OVER (PARTITION BY g.src ORDER BY g.ord, g.dst) AS n FROM g JOIN sym s ON s.id = g.dst
), down AS (SELECT id, string_agg(name, ',' ORDER BY n) AS callees FROM d WHERE n <= 5 GROUP BY id)
SELECT s.id, s.loc AS size, round(s.loc / (SELECT sum(loc) FROM sym) * 100, 9) AS percent, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(callers, 0) AS callers, coalesce(callees, '') AS callees
FROM sym s LEFT JOIN f USING (id) LEFT JOIN up USING (id) LEFT JOIN down USING (id)""",
    "report_diff_full": """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS entry, o_orderstatus AS st, o_orderpriority AS pr, o_orderdate >= TIMESTAMP '1998-05-01' AS late FROM orders
), twice AS (SELECT entry FROM o GROUP BY entry HAVING bool_or(late) AND bool_or(NOT late)), m AS (SELECT * FROM o WHERE entry IN (SELECT entry FROM twice)
), c AS (SELECT entry, 'category_' || st AS kind, st AS subject, count_if(late) - count_if(NOT late) AS delta FROM m GROUP BY entry, st
), s AS (SELECT entry, 'smell' AS kind, pr || ' ' || st AS subject, CAST(CASE WHEN bool_and(late) THEN 1 WHEN bool_and(NOT late) THEN -1 ELSE 0 END AS BIGINT) AS delta FROM m GROUP BY entry, pr, st
), x AS (SELECT entry, 'complexity' AS kind, '' AS subject, count_if(late) - count_if(NOT late) AS delta FROM m GROUP BY entry
), u AS (SELECT * FROM c WHERE delta <> 0 UNION ALL SELECT * FROM s WHERE delta <> 0 UNION ALL SELECT * FROM x WHERE delta > 0)
SELECT entry, kind, subject, CAST(delta AS BIGINT) AS delta, CASE WHEN delta > 0 THEN 'regression' ELSE 'improvement' END AS verdict FROM u""",
    "tree_top": _TREE + " SELECT name, value, self_value FROM tree WHERE depth = 1",
    "sampled_report": _TREE + """ SELECT CASE WHEN contains(qualname, '.') AND NOT contains(qualname, '<locals>') THEN 'Method' ELSE 'Function' END AS kind, CAST(depth - 1 AS INT) AS depth, count(*) AS nodes,
  CAST(sum(value) * 1000 AS BIGINT) AS value_ns, CAST(sum(self_value) * 1000 AS BIGINT) AS self_ns, CAST(sum(ncalls) AS BIGINT) AS ncalls FROM tree GROUP BY 1, 2""",
    "sampled_summary": _TREE + " SELECT count(DISTINCT CASE WHEN file <> '' THEN file END) AS files, count(*) AS symbols FROM tree",
    "portal_changes": _PORTAL + " SELECT change_id, title, status, repo, department, verdict, p95 FROM ch",
    "portal_filtered": _PORTAL + " SELECT change_id, repo, department, verdict FROM ch WHERE status = 'BUILDING' AND department IN ('ASIA', 'EUROPE')",
    "portal_totals": _PORTAL + """ SELECT change_id, value, CAST(sum(value) OVER (PARTITION BY repo_id) AS BIGINT) AS repo_total, CAST(sum(value) OVER (PARTITION BY department_id) AS BIGINT) AS department_total,
  (SELECT CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) FROM customer) AS total FROM ch""",
    "portal_split": """SELECT count_if(c_mktsegment IN ('BUILDING', 'MACHINERY')) AS done_n, CAST(coalesce(sum(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN CAST(round(c_acctbal * 100) AS BIGINT) END), 0) AS BIGINT) AS done_value,
  count_if(c_mktsegment = 'AUTOMOBILE') AS open_n, CAST(coalesce(sum(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN CAST(round(c_acctbal * 100) AS BIGINT) END), 0) AS BIGINT) AS open_value FROM customer""",
    "portal_recent": _PORTAL + " SELECT scan_id, change_id, repo, p95 FROM ch WHERE scan_id IS NOT NULL ORDER BY profiled_at DESC, scan_id DESC LIMIT 6",
    "portal_details": """WITH i AS (SELECT l_orderkey AS scan_id, string_agg(l_linenumber || ':' || l_returnflag || ':' || l_partkey, ',' ORDER BY l_linenumber, l_returnflag, l_partkey) AS issues FROM lineitem GROUP BY 1)
SELECT o_orderkey AS scan_id, coalesce(issues, '') AS issues FROM orders LEFT JOIN i ON i.scan_id = o_orderkey""",
    "portal_issue_caps": "SELECT l_orderkey AS scan_id, l_returnflag AS severity, least(count(*), CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) AS n FROM lineitem GROUP BY 1, 2",
    "scan_catalog": f"SELECT file_id, path, CAST(length(content) AS INT) AS size, {_grab('schema_version')}, {_grab('mode')}, {_grab('source_root')} FROM stored_scans",
    "suggestion_history": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY written_at DESC NULLS LAST, path DESC NULLS LAST, file_id DESC NULLS LAST) AS n, count(*) OVER (PARTITION BY scan_id) AS versions FROM saved_suggestions)
SELECT scan_id, versions, file_id FROM r WHERE n = 1""",
    "patch": """SELECT s_suppkey AS k, CASE WHEN c_acctbal > 0 THEN c_name ELSE s_name END AS name, CASE WHEN c_acctbal <= 0 THEN c_nationkey ELSE s_nationkey END AS nation FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey""",
    "log_sessions": f"""WITH {_EVENTS}, t AS (SELECT log_id, count(*) AS events, coalesce(max({_TIME}) - min({_TIME}), 0) AS duration_us FROM ev GROUP BY log_id
), l AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY started_at DESC NULLS LAST) AS n FROM event_logs)
SELECT l.log_id, path, service, agent_version, coalesce(events, 0) AS events, coalesce(duration_us, 0) AS duration_us FROM l LEFT JOIN t ON t.log_id = l.log_id WHERE n = 1""",
    "folded_round_trip": _SAMPLES + """, st AS (SELECT array_to_string(list_reverse(list_transform(frames, lambda x: x.name)), ';') AS stack, sum(ticks) AS n FROM samples GROUP BY 1)
SELECT CAST(len(string_split(stack, ';')) AS INT) AS depth, count(*) AS stacks, CAST(sum(n) AS BIGINT) AS ticks FROM st GROUP BY 1""",
    "container_stats": """SELECT o_orderstatus AS s, count(*) AS n, round(sum(CAST(k % 1000 AS DOUBLE) / 10), 3) AS cpu, CAST(sum(k % 500) AS BIGINT) AS mem_mb, CAST(sum(k % 70) * 1000 AS BIGINT) AS rx, CAST(sum(k % 30) * 1000000 AS BIGINT) AS tx,
  CAST(sum(CASE WHEN k % 5 > 0 THEN k % 9 ELSE 0 END) * 1024 AS BIGINT) AS block_read, CAST(count_if(k % 5 > 0) * 1500 AS BIGINT) AS block_write FROM (SELECT o_orderstatus, o_orderkey AS k FROM orders) GROUP BY 1""",
    "event_lines": f"WITH {_EVENTS} SELECT type, count(*) AS events, CAST(sum(count) AS BIGINT) AS ticks FROM ev WHERE status IS NULL GROUP BY type",
    "report_round_trip": _LOG_SAMPLES + """, ns AS (SELECT DISTINCT log_id, list_reverse(list_transform(frames, lambda x: x.name)) AS names FROM samples
), p AS (SELECT DISTINCT log_id, names[1:i] AS path FROM (SELECT log_id, names, unnest(range(1, len(names) + 1)) AS i FROM ns))
SELECT CAST(len(path) AS INT) AS depth, path[-1] AS name, count(*) AS nodes FROM p GROUP BY 1, 2""",
}
