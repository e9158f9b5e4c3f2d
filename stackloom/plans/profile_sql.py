"""DuckDB counterparts of the profile queries, over the whole tables."""

from stackloom.plans.profile_queries import EXCLUDED, FOCUS

_EVENTS = """
ev AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id, line_no ORDER BY received_at DESC) AS rn FROM raw_events) WHERE rn = 1
)"""
_SAMPLES = f"""
WITH {_EVENTS}, raw AS (
  SELECT type, cpu, period_ns, count AS n, frames, duration_ns, qualname, file, line FROM ev WHERE type IN ('wall_trace', 'cpu_trace')
  UNION ALL
  SELECT type, cpu, period_ns, s.count, s.frames, duration_ns, qualname, file, line FROM (SELECT *, unnest(samples) AS s FROM ev WHERE type IN ('wall_profile', 'cpu_profile'))
), samples AS (
  SELECT row_number() OVER () AS sid, * FROM (
    SELECT n * period_ns // 1000 AS weight_us, n AS ticks, cpu, frames FROM raw WHERE n > 0 AND period_ns > 0 AND len(frames) > 0
    UNION ALL
    SELECT duration_ns // 1000, 1, cpu, [{{'name': qualname, 'file': file, 'line': line, 'qualified_name': qualname, 'module': CAST(NULL AS VARCHAR), 'is_system': CAST(NULL AS BOOLEAN)}}]
    FROM ev WHERE type = 'function_call' AND duration_ns > 0 AND qualname <> ''
  )
), fr AS (
  SELECT sid, weight_us, ticks, cpu, len(frames) AS depth, unnest(frames) AS f, generate_subscripts(frames, 1) AS pos FROM samples
)"""
_ROLLUP = (
    _SAMPLES
    + """, one AS (
  SELECT sid, f.name AS name, any_value(weight_us) AS weight_us, any_value(ticks) AS ticks, any_value(cpu) AS cpu, min(pos) AS pos FROM fr GROUP BY sid, f.name
), sums AS (
  SELECT name AS qualname, CAST(coalesce(sum(CASE WHEN pos = 1 THEN ticks END), 0) AS BIGINT) AS ncalls, CAST(coalesce(sum(CASE WHEN pos = 1 THEN weight_us END), 0) AS BIGINT) AS total_us,
    CAST(sum(weight_us) AS BIGINT) AS cumulative_us, avg(CASE WHEN pos = 1 THEN cpu END) AS cpu_avg FROM one GROUP BY name
), placed AS (
  SELECT sid, f.name AS name, f.file AS file, f.line AS line FROM fr WHERE f.file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sid, f.name ORDER BY pos) = 1
), files AS (
  SELECT name, min(file) AS file FROM placed GROUP BY name
), lines AS (
  SELECT p.name, CASE WHEN bool_or(p.line IS NULL) THEN NULL ELSE min(p.line) END AS line FROM placed p JOIN files f ON f.name = p.name AND f.file = p.file GROUP BY p.name
), functions AS (
  SELECT s.*, f.file, l.line FROM sums s LEFT JOIN files f ON f.name = s.qualname LEFT JOIN lines l ON l.name = s.qualname
)"""
)
_TREE = (
    _SAMPLES
    + """, steps AS (
  SELECT sid, weight_us, depth - pos + 1 AS d, pos, f FROM fr
), names AS (
  SELECT sid, list_reverse(list_transform(frames, lambda x: x.name)) AS names FROM samples
), nodes AS (
  SELECT array_to_string(n.names[1:s.d], ';') AS path, any_value(s.f.name) AS name, any_value(s.d) AS depth, CAST(sum(s.weight_us) AS BIGINT) AS value,
    CAST(coalesce(sum(CASE WHEN s.pos = 1 THEN s.weight_us END), 0) AS BIGINT) AS self_value, count(CASE WHEN s.pos = 1 THEN 1 END) AS ncalls,
    min(CASE WHEN s.f.qualified_name <> '' THEN s.f.qualified_name END) AS qualname, min(CASE WHEN s.f.module <> '' THEN s.f.module END) AS module, min(s.f.file) AS file
  FROM steps s JOIN names n ON n.sid = s.sid GROUP BY array_to_string(n.names[1:s.d], ';')
), tree AS (
  SELECT *, CASE WHEN depth > 1 THEN left(path, length(path) - length(name) - 1) END AS parent FROM nodes
)"""
)


def _node_id(file: str, name: str, q: str) -> str:
    return (
        f"CASE WHEN {q} <> '' AND NOT contains({q}, '<locals>') AND regexp_extract({q}, '^(.+)[.]([^.]+)$', 1) <> '' AND regexp_extract({q}, '^(.+)[.]([^.]+)$', 2) <> '' "
        f"THEN coalesce({file}, '') || '::' || regexp_extract({q}, '^(.+)[.]([^.]+)$', 1) || '::' || regexp_extract({q}, '^(.+)[.]([^.]+)$', 2) ELSE concat_ws('::', coalesce({file}, ''), {name}) END"
    )


def _words(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _hotspot_category(column: str) -> str:
    from stackloom.operators.profile import HOTSPOT_WORDS

    return "CASE " + " ".join(f"WHEN {_words(f'lower({column})', w)} THEN '{c}'" for c, w in HOTSPOT_WORDS.items()) + " ELSE 'unknown' END"


_NAME = FOCUS.rsplit(".", 1)[1]
_EDGES = """
  SELECT lpad(CAST(s AS VARCHAR), 9, '0') AS src, lpad(CAST(d AS VARCHAR), 9, '0') AS dst, min(o) AS ord FROM (
    SELECT o_custkey AS s, (o_orderkey * 31 + 7) % (SELECT count(*) // 2 FROM customer) + 1 AS d, o_orderkey AS o FROM orders
  ) WHERE s <> d GROUP BY s, d"""
_GRAPH = f"""
WITH RECURSIVE v AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id FROM customer), g AS MATERIALIZED ({_EDGES}
), reach AS (
  SELECT id AS root, id FROM v UNION SELECT r.root, g.dst FROM reach r JOIN g ON g.src = r.id
)"""
_SYMBOLS = """
sym AS (
  SELECT lpad(CAST(k AS VARCHAR), 9, '0') AS id, (CASE WHEN k % 11 = 0 THEN 'get' WHEN k % 13 = 0 THEN '_' WHEN k % 17 = 0 THEN '<' ELSE 'f' END) || 'N' || (k % 500) AS name,
    CASE WHEN k % 19 = 0 THEN 'class' ELSE 'function' END AS kind, (CASE WHEN k % 7 = 0 THEN 'tests/' ELSE 'src/' END) || (k % 23) || '.py' AS file, CAST(k % 900 AS INT) AS line, CAST(k % 200 AS INT) AS loc,
    CAST(k % 20 AS INT) AS complexity, CAST(k % 7 AS INT) AS nesting_depth, k % 4 = 0 AS is_async, CAST(k % 1000 AS DOUBLE) AS rank, k % 25 AS call_sites, k % 37 = 0 AS is_recursive
  FROM (SELECT c_custkey AS k FROM customer)
)"""
_FINDINGS = f"""
WITH {_SYMBOLS}, ext AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS src, (CASE WHEN k % 5 = 0 THEN 'C' ELSE 'c' END) || (k % 9) AS call, ['db', 'network', 'io', 'cache', 'queue', 'log'][k % 6 + 1] AS category,
    [0.95, 0.80, 0.65][k % 3 + 1] AS sure, CAST(k % 700 AS INT) AS call_line, k % 4 = 0 AS in_loop, k % 3 = 0 AS in_await FROM (SELECT o_orderkey AS k, o_custkey FROM orders)
), p90 AS (
  SELECT rank AS v FROM (SELECT rank, row_number() OVER (ORDER BY rank) - 1 AS i, count(*) OVER () AS n FROM sym) WHERE i = least(CAST(floor(0.9 * n) AS BIGINT), n - 1)
), hot AS (
  SELECT id, rank >= (SELECT v FROM p90) AND (SELECT v FROM p90) > 0 AS hot, call_sites, is_recursive FROM sym
), calls AS (
  SELECT s.id, s.is_async, e.*, NOT regexp_matches(call, '^[A-Z]') AS method FROM ext e JOIN sym s ON s.id = e.src WHERE NOT starts_with(s.name, '<')
), groups AS (
  SELECT 'n_plus_one' AS kind, id, call, call_line, sure FROM calls WHERE in_loop AND method AND category IN ('db', 'cache')
  UNION ALL SELECT 'blocking_in_async', id, call, call_line, sure FROM calls WHERE is_async AND NOT in_await AND method AND category IN ('db', 'network', 'io')
  UNION ALL SELECT 'noisy_log', id, call, call_line, sure FROM calls WHERE in_loop AND category = 'log'
  UNION ALL SELECT 'log_amplification', id, call, call_line, sure FROM calls WHERE category = 'log'
), agg AS (
  SELECT kind, id, min(call_line) AS line, max(sure) AS sure, count(*) AS n, array_to_string(list_sort(list(DISTINCT call)), ',') AS evidence FROM groups GROUP BY kind, id
), found AS (
  SELECT a.id, a.kind, CASE WHEN a.kind = 'log_amplification' THEN 'medium' WHEN a.kind = 'noisy_log' THEN CASE WHEN h.hot THEN 'high' ELSE 'medium' END ELSE 'high' END AS severity,
    CASE WHEN a.kind = 'n_plus_one' THEN 'small' ELSE 'trivial' END AS effort, CAST(CASE a.kind WHEN 'noisy_log' THEN 0.85 WHEN 'log_amplification' THEN 0.80 ELSE a.sure END AS DOUBLE) AS confidence, a.line, a.evidence
  FROM agg a JOIN hot h ON h.id = a.id WHERE a.kind <> 'log_amplification' OR (a.n >= 3 AND (h.hot OR h.call_sites >= 10))
  UNION ALL
  SELECT id, 'expensive_compute', CASE WHEN complexity >= 15 OR loc >= 150 THEN 'high' WHEN complexity >= 10 OR loc >= 80 THEN 'medium' ELSE 'low' END,
    CASE WHEN loc >= 150 OR nesting_depth >= 5 THEN 'large' WHEN loc >= 80 OR complexity >= 15 THEN 'medium' ELSE 'small' END, 0.70, line, ''
  FROM sym WHERE NOT starts_with(name, '<') AND (complexity >= 10 OR loc >= 80 OR nesting_depth >= 4)
  UNION ALL SELECT id, 'recursive', 'medium', 'medium', 1.0, line, '' FROM sym WHERE NOT starts_with(name, '<') AND is_recursive
  UNION ALL SELECT id, 'missing_caching', 'medium', 'small', 0.55, line, '' FROM sym WHERE NOT starts_with(name, '<') AND call_sites >= 5 AND (complexity >= 5 OR loc >= 20) AND NOT is_recursive
    AND NOT regexp_matches(name, '^[A-Z]') AND id NOT IN (SELECT src FROM ext WHERE category IN ('db', 'network', 'io', 'queue'))
)"""
_CATEGORY = "CASE WHEN kind IN ('n_plus_one', 'expensive_compute', 'missing_caching') THEN 'performance' WHEN kind IN ('recursive', 'blocking_in_async') THEN 'reliability' ELSE 'observability' END"
_RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_EFFORT = "CASE effort WHEN 'trivial' THEN 1 WHEN 'small' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END"

# What fires on each statement of the lint query, by the statement's number: rule, severity, effort. Written down by hand.
_LINT = """
0 SQL001 low trivial
1 SQL002 high trivial
2 SQL003 high trivial
3 SQL004 low trivial
4 SQL005 medium small
5 SQL006 medium small
6 SQL007 low trivial
7 SQL009 medium small
8 SQL010 high small
9 SQL011 medium small
10 SQL015 low trivial
11 SQL_DISTINCT_NO_ORDER_BY low trivial
12 SQL_OFFSET_DEEP_PAGINATION medium medium
13 SQL_WIN_NO_PARTITION medium small
14 SQL_SUB_SCALAR_IN_PROJECTION high medium
15 SQL014_HAVING_NO_AGGREGATE low trivial
16 SQL017_AMBIGUOUS_GROUP high small
17 SQL021_GROUP_BY_ORDINAL low trivial
18 SQL022_ORDER_BY_CONSTANT low trivial
19 SQL023_NOT_IN_WITH_NULL high trivial
20 SQL025_JSON_PATH_IN_WHERE medium small
21 MIG_CREATE_INDEX_NOT_CONCURRENT high trivial
22 MIG_DROP_TABLE high medium
23 MIG_DROP_COLUMN high medium
24 MIG_ALTER_COLUMN_TYPE high medium
25 MIG_ADD_FK_NOT_VALID high small
26 MIG_ADD_COLUMN_NOT_NULL_NO_DEFAULT high small
29 SQL_COMPLEX_JOINS medium medium
30 SQL_COMPLEX_SUBQUERY_DEPTH medium medium
31 SQL_COMPLEX_OR_CHAIN low trivial
32 SQL_LARGE_IN_LIST medium small
"""
_RULE_ROWS = ", ".join(
    f"({i}, '{rule}', '{'migration_safety' if rule.startswith('MIG_') else 'sql_antipattern'}', '{severity}', '{effort}', CAST(0.9 AS DOUBLE))" for i, rule, severity, effort in map(str.split, _LINT.strip().splitlines())
)
_TIME = "CASE WHEN regexp_matches(time, '^-?[0-9]+$') THEN CAST(floor(TRY_CAST(time AS BIGINT) / 1000) AS BIGINT) ELSE epoch_us(TRY_CAST(time AS TIMESTAMPTZ)) END"

_ROUNDS = 40
_PR = f"WITH v AS MATERIALIZED (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id FROM customer), e AS MATERIALIZED ({_EDGES}" + """
), deg AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY src), n AS MATERIALIZED (SELECT count(*) AS n FROM v), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank, 1.0::DOUBLE AS moved FROM v, n)""" + "".join(
    f""", r{i} AS MATERIALIZED (
  SELECT id, rank, sum(abs(rank - old)) OVER () AS moved FROM (
    SELECT v.id, o.rank AS old, 0.15::DOUBLE / n.n + 0.85::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM deg)) / n.n + 0.85::DOUBLE * coalesce(x.got, 0) AS rank
    FROM v CROSS JOIN n JOIN r{i - 1} o ON o.id = v.id LEFT JOIN (SELECT e.dst, sum(r.rank / d.deg) AS got FROM e JOIN deg d ON d.src = e.src JOIN r{i - 1} r ON r.id = e.src GROUP BY e.dst) x ON x.dst = v.id))"""
    for i in range(1, _ROUNDS + 1)
) + ", every AS (" + " UNION ALL ".join(f"SELECT {i} AS i, * FROM r{i}" for i in range(1, _ROUNDS + 1)) + ")"

_FUZZY = """
WITH s AS (
  SELECT 's::' || s_suppkey AS node_id, 'n' || (s_suppkey % 40) AS name, '/app/f' || s_nationkey AS file, 'q' || (s_suppkey % 80) AS q, 'c' || (s_suppkey % 3) AS c FROM supplier
), t AS (
  SELECT (CASE WHEN c_custkey % 50 = 0 THEN 's::' ELSE 'c::' END) || c_custkey AS node_id, 'n' || (c_custkey % 40) AS name, (CASE WHEN c_custkey % 2 = 0 THEN '/app/f' ELSE 'src/f' END) || c_nationkey AS file,
    'q' || (c_custkey % 80) AS q, 'c' || (c_custkey % 3) AS c FROM customer
), exact AS (SELECT node_id FROM s WHERE node_id IN (SELECT node_id FROM t)
), pairs AS (
  SELECT s.node_id, t.node_id AS t_id, s.file = t.file AS sf, split_part(s.file, '/', -1) = split_part(t.file, '/', -1) AS sb, s.q = t.q AS sq, s.c = t.c AS sc
  FROM s JOIN t ON t.name = s.name WHERE s.node_id NOT IN (SELECT node_id FROM exact)
), scored AS (
  SELECT node_id, t_id, CASE WHEN sf AND sq THEN 0.95 WHEN sb AND sq THEN 0.85 WHEN sf AND sc THEN 0.85 WHEN sf THEN 0.7 WHEN sb AND sc THEN 0.65 WHEN sb THEN 0.5 END AS score,
    CASE WHEN sf AND sq THEN 'same file + same qualified_name' WHEN sb AND sq THEN 'same basename + same qualified_name' WHEN sf AND sc THEN 'same file + same class + same name' WHEN sf THEN 'same file + same name'
      WHEN sb AND sc THEN 'same basename + same class + same name' WHEN sb THEN 'same basename + same name' END AS why FROM pairs
), best AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY node_id ORDER BY score DESC, t_id) AS INT) AS rank FROM scored WHERE score IS NOT NULL
)
SELECT node_id, 1 AS rank, node_id AS static_node_id, CAST(1.0 AS DOUBLE) AS confidence, 'exact node_id match' AS reason FROM exact
UNION ALL SELECT node_id, rank, t_id, CAST(score AS DOUBLE), why FROM best WHERE rank <= 4
UNION ALL SELECT node_id, NULL, NULL, NULL, NULL FROM s WHERE node_id NOT IN (SELECT node_id FROM exact) AND node_id NOT IN (SELECT node_id FROM best)
"""

SQL = {
    "function_rollup": _ROLLUP + """
SELECT qualname, ncalls, total_us, cumulative_us, round(cpu_avg, 6) AS cpu_avg, file, line, round(CASE WHEN ncalls > 0 THEN total_us / ncalls ELSE 0 END, 6) AS percall_us FROM functions""",
    "statistics_cards": _ROLLUP + """, er AS (SELECT qualname, count(*) AS errors FROM ev WHERE type = 'function_call' AND status = 'error' AND qualname <> '' GROUP BY qualname
), u AS (
  SELECT 'cumulative' AS card, qualname, cumulative_us AS value FROM functions UNION ALL SELECT 'self', qualname, total_us FROM functions UNION ALL SELECT 'calls', qualname, ncalls FROM functions
  UNION ALL SELECT 'errors', f.qualname, e.errors FROM functions f JOIN er e ON e.qualname = f.qualname
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY card ORDER BY value DESC, qualname) AS INT) AS place FROM u)
SELECT card, place, qualname, value FROM r WHERE place <= 5""",
    "call_tree": _TREE + f"SELECT path, name, depth, value, self_value, ncalls, qualname, module, {_node_id('file', 'name', 'qualname')} AS node_id FROM tree",
    "callers_callees": _TREE + f"""
SELECT p.name, count(*) AS occurrences, CAST(sum(t.value) AS BIGINT) AS value, 'caller' AS side FROM tree t JOIN tree p ON p.path = t.parent WHERE t.name = '{_NAME}' GROUP BY p.name
UNION ALL SELECT t.name, count(*), CAST(sum(t.value) AS BIGINT), 'callee' FROM tree t JOIN tree p ON p.path = t.parent WHERE p.name = '{_NAME}' GROUP BY t.name""",
    "focus_totals": _TREE + f"SELECT CAST(coalesce(sum(ncalls), 0) AS BIGINT) AS ncalls, CAST(coalesce(sum(value), 0) AS BIGINT) AS value, CAST(coalesce(sum(self_value), 0) AS BIGINT) AS self_value, count(*) AS occurrences FROM tree WHERE name = '{_NAME}'",
    "frame_filter": _ROLLUP + "SELECT qualname, cumulative_us FROM functions WHERE (contains(qualname, 'src') OR contains(coalesce(file, ''), 'src')) AND contains(qualname, '_') AND NOT contains(coalesce(file, ''), 'planner')",
    "hotspots": _SAMPLES + f""", st AS (
  SELECT array_to_string(list_reverse(list_transform(frames, lambda x: x.name)), ';') AS stack, CAST(sum(ticks) AS BIGINT) AS n FROM samples GROUP BY 1
), parts AS (SELECT stack, n, split_part(stack, ';', -1) AS leaf, unnest(list_distinct(string_split(stack, ';'))) AS function FROM st
), f AS (
  SELECT function, CAST(coalesce(sum(CASE WHEN function = leaf THEN n END), 0) AS BIGINT) AS samples, sum(n) AS total, min(CASE WHEN function = leaf THEN stack END) AS example_stack FROM parts GROUP BY function
), p AS (SELECT *, samples / (SELECT sum(n) FROM st) * 100 AS self_pct, total / (SELECT sum(n) FROM st) * 100 AS total_pct, CAST(row_number() OVER (ORDER BY samples DESC, function) AS INT) AS rank FROM f)
SELECT rank, function, {_hotspot_category('function')} AS category,
  CASE WHEN self_pct >= 20 OR total_pct >= 60 THEN 'critical' WHEN self_pct >= 10 OR total_pct >= 35 THEN 'high' WHEN self_pct >= 3 OR total_pct >= 15 THEN 'medium' ELSE 'low' END AS severity,
  round(self_pct, 6) AS self_pct, round(total_pct, 6) AS total_pct, samples, example_stack FROM p WHERE rank <= 50""",
    "sample_conservation": _SAMPLES + "SELECT CAST(len(frames) AS INT) AS depth, count(*) AS samples, CAST(sum(weight_us) AS BIGINT) AS weight_us, CAST(sum(ticks) AS BIGINT) AS ticks FROM samples GROUP BY 1",
    "leaf_exclude": f"WITH {_EVENTS} SELECT log_id, count(*) AS kept FROM ev WHERE frames IS NOT NULL AND NOT coalesce({_words('frames[1].file', EXCLUDED)}, false) GROUP BY log_id",
    "system_frames": _SAMPLES + """
SELECT coalesce(contains(file, '/_profiler.cpython') OR contains(file, '/_profiler.abi3') OR contains(file, '_profiler.so') OR contains(file, '<frozen ') OR contains(file, '<built-in') OR contains(file, '/lib/python3.') OR contains(file, '/site-packages/') OR contains(file, '/codec.py'), false) AS system,
  regexp_matches(coalesce(file, ''), '(^|/)[Tt]est[A-Z]|(^|/|[a-z0-9])(Tests?|Specs?|Mocks?)(/|[.][^./]*$|$)|(^|[^A-Za-z0-9])([Tt][Ee][Ss][Tt][Ss]?|[Ss][Pp][Ee][Cc][Ss]?|[Mm][Oo][Cc][Kk][Ss]?|[Tt]estdata)([^A-Za-z0-9]|$)') AS test, count(*) AS frames
FROM (SELECT f.file AS file FROM fr) GROUP BY 1, 2""",
    "node_ids": _SAMPLES + f"""
SELECT DISTINCT {_node_id('f.file', 'f.name', 'f.qualified_name')} AS node_id, CASE WHEN contains(f.qualified_name, '.') AND NOT contains(f.qualified_name, '<locals>') THEN 'Method' ELSE 'Function' END AS kind,
  CASE WHEN NOT contains(f.qualified_name, '<locals>') AND regexp_extract(f.qualified_name, '^(.+)[.][^.]*$', 1) <> '' THEN regexp_extract(f.qualified_name, '^(.+)[.][^.]*$', 1) END AS owner, split_part(f.file, '/', -1) AS base FROM fr""",
    "window_metadata": f"""WITH {_EVENTS}, t AS (SELECT *, {_TIME} AS us FROM ev)
SELECT log_id, count(*) AS events, min(us) AS from_us, max(us) AS to_us, coalesce(max(us) - min(us), 0) AS duration_us, coalesce(array_to_string(list_sort(list(DISTINCT service) FILTER (service <> '')), ','), '') AS services,
  coalesce(array_to_string(list_sort(list(DISTINCT pod) FILTER (pod <> '')), ','), '') AS pods FROM t GROUP BY log_id""",
    "event_violations": f"""WITH {_EVENTS}, k AS (SELECT *, type IN ('wall_trace', 'cpu_trace') AS tr, type IN ('wall_profile', 'cpu_profile') AS pr, type = 'function_call' AS ca FROM ev), x AS (
  SELECT 'type' AS rule FROM k WHERE type IS NULL OR type NOT IN ('wall_trace', 'cpu_trace', 'wall_profile', 'cpu_profile', 'function_call', 'profile_metadata')
  UNION ALL SELECT 'time' FROM k WHERE time IS NULL UNION ALL SELECT 'period_ns' FROM k WHERE (tr OR pr) AND NOT coalesce(period_ns > 0, false) UNION ALL SELECT 'count' FROM k WHERE tr AND NOT coalesce(count > 0, false)
  UNION ALL SELECT 'frames' FROM k WHERE tr AND NOT coalesce(len(frames) > 0, false) UNION ALL SELECT 'samples' FROM k WHERE pr AND samples IS NULL UNION ALL SELECT 'qualname' FROM k WHERE ca AND coalesce(qualname, '') = ''
  UNION ALL SELECT 'duration_ns' FROM k WHERE ca AND NOT coalesce(duration_ns > 0, false) UNION ALL SELECT 'status' FROM k WHERE ca AND NOT coalesce(status IN ('ok', 'error'), false)
) SELECT rule, count(*) AS events FROM x GROUP BY rule""",
    "log_metadata": f"""WITH {_EVENTS}, p AS (SELECT *, log_id || '/' || (line_no // 8) AS part FROM ev)
SELECT part AS log_id, time, service, pod FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY line_no) AS n FROM p) WHERE n = 1 AND type = 'profile_metadata'""",
    "window_counts": "SELECT time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "trace_bundle": f"""WITH {_EVENTS}, t AS (SELECT *, {_TIME} AS us FROM ev WHERE type IN ('wall_trace', 'cpu_trace') AND count > 0 AND period_ns > 0 AND len(frames) > 0)
SELECT us // 60000000 * 60000000 AS window_us, type, period_ns, CAST(count(DISTINCT frames) AS INT) AS stacks, CAST(sum(count) AS BIGINT) AS ticks FROM t WHERE us IS NOT NULL GROUP BY 1, 2, 3""",
    "window_backfill": """WITH w AS (SELECT date_trunc('hour', ts) AS window_start, event_type AS name, count(*) AS n FROM events GROUP BY 1, 2)
SELECT * FROM w UNION ALL SELECT window_start, 'unknown', CAST(30 - sum(n) AS BIGINT) FROM w GROUP BY 1 HAVING sum(n) < 30""",
    "latest_per_key": "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
    "previous_baseline": """WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, coalesce(lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), o_totalprice) AS baseline FROM orders)
SELECT *, CASE WHEN o_totalprice > floor(baseline * CAST(1.1 AS DOUBLE) + CAST(0.5 AS DOUBLE)) THEN 'regression' ELSE 'ok' END AS verdict FROM b""",
    "status_pivot": "SELECT o_orderpriority, count(*) AS total, count_if(o_orderstatus = 'F') AS n_f, count_if(o_orderstatus = 'O') AS n_o, count_if(o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "three_level_totals": """
SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS cents
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name""",
    "upsert": """WITH c AS (SELECT c_custkey + (SELECT count(*) // 2 FROM supplier) AS k, c_name, c_nationkey FROM customer)
SELECT coalesce(c.k, s_suppkey) AS k, CASE WHEN c.k IS NOT NULL THEN c_name ELSE s_name END AS name, CASE WHEN c.k IS NOT NULL THEN c_nationkey ELSE s_nationkey END AS nation FROM supplier FULL JOIN c ON c.k = s_suppkey""",
    "language_share": """WITH l AS (SELECT lang AS language, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents WHERE lang IS NOT NULL GROUP BY 1)
SELECT language, files, bytes, round(bytes / (SELECT sum(bytes) FROM l) * 100, 6) AS percent FROM l""",
    "report_diff": """WITH x AS (SELECT l_returnflag, l_linestatus, l_shipdate >= TIMESTAMP '1995-06-17' AS late, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT l_returnflag, l_linestatus, coalesce(c.n, 0) - coalesce(b.n, 0) AS delta FROM (SELECT * FROM x WHERE NOT late) b FULL JOIN (SELECT * FROM x WHERE late) c USING (l_returnflag, l_linestatus) WHERE coalesce(c.n, 0) <> coalesce(b.n, 0)""",
    "set_diff": """WITH b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-17'), c AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-17')
SELECT *, 'added' AS change FROM (SELECT * FROM c EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM c)""",
    "interval_containment": """WITH r AS (SELECT event_id, user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec FROM events), w AS (
  SELECT user_id, min(sec) AS s, max(sec) AS e, min(event_id) AS range_id FROM r GROUP BY user_id, sec // 86400 UNION ALL SELECT user_id, min(sec), max(sec), min(event_id) + 1000000000 FROM r GROUP BY user_id
), m AS (SELECT r.event_id, w.range_id, w.s, w.e, row_number() OVER (PARTITION BY r.event_id ORDER BY w.e - w.s, w.range_id) AS n FROM r JOIN w ON w.user_id = r.user_id AND r.sec BETWEEN w.s AND w.e)
SELECT event_id, range_id AS r_range_id, s AS r_s, e AS r_e FROM m WHERE n = 1""",
    "fuzzy_join": _FUZZY,
    "fan_in_out": _GRAPH + """
SELECT v.id, (SELECT count(*) FROM g WHERE g.dst = v.id) AS fan_in, (SELECT count(*) FROM g WHERE g.src = v.id) AS fan_out FROM v""",
    "pagerank": _PR + " SELECT id, round(rank, 9) AS rank FROM every WHERE i = (SELECT min(i) FROM every WHERE moved < 1e-6)",
    "reach_counts": _GRAPH + " SELECT root AS id, count(*) AS reach FROM reach GROUP BY root",
    "strong_components": _GRAPH + """, mutual AS (SELECT a.root AS id, a.id AS other FROM reach a JOIN reach b ON b.root = a.id AND b.id = a.root)
SELECT id, min(other) AS component FROM mutual GROUP BY id HAVING count(*) > 1""",
    "discover_roots": _GRAPH.replace("WITH RECURSIVE v", f"WITH RECURSIVE {_SYMBOLS.strip()}, v") + """, rc AS (SELECT root, count(*) AS reach FROM reach GROUP BY root)
SELECT s.id, s.name, r.reach FROM sym s JOIN rc r ON r.root = s.id WHERE s.kind <> 'class' AND NOT (regexp_matches(s.name, '^(get|set|is)[A-Z]') AND length(s.name) >= 4) AND NOT starts_with(s.name, '_') AND NOT starts_with(s.file, 'tests/')
  AND s.id NOT IN (SELECT g.dst FROM g WHERE g.src NOT IN (SELECT id FROM sym WHERE starts_with(name, '<'))) AND r.reach >= 2 ORDER BY r.reach DESC, s.name, s.id LIMIT 200""",
    "dead_code": _GRAPH.replace("WITH RECURSIVE v", f"WITH RECURSIVE {_SYMBOLS.strip()}, v") + """
SELECT id, name, file, line FROM sym WHERE kind <> 'class' AND NOT starts_with(name, '<') AND id NOT IN (SELECT dst FROM g) AND line >= 50""",
    "call_site_counts": f"WITH {_SYMBOLS}, r AS (SELECT 'fN' || (o_orderkey % 500) AS name, count(*) AS n FROM orders GROUP BY 1) SELECT id, CAST(coalesce(sum(n), 0) AS BIGINT) AS call_sites FROM sym LEFT JOIN r USING (name) GROUP BY id",
    "floor_percentile": "SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) WHERE i = least(CAST(floor(0.9 * n) AS BIGINT), n - 1)",
    "findings": _FINDINGS + " SELECT id, kind, severity, effort, confidence, line, evidence FROM found",
    "findings_by_category": _FINDINGS + f" SELECT {_CATEGORY} AS category, count(*) AS n FROM found GROUP BY 1",
    "top_findings": _FINDINGS + f""", o AS (SELECT f.id, f.kind, f.severity, s.file, f.line, {_RANK} AS r FROM found f JOIN sym s ON s.id = f.id
), q AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY r DESC, file, line, id) AS n FROM o)
SELECT id, kind, severity, file, line FROM q WHERE n <= 12 ORDER BY r DESC, file, line, id, kind LIMIT 50""",
    "refactor_candidates": _FINDINGS + f""", e AS (
  SELECT id, count(*) AS findings, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, max({_RANK}) AS s, max({_EFFORT}) AS f FROM found GROUP BY id
) SELECT e.id, findings, kinds, ['low', 'medium', 'high'][s] AS worst_severity, ['trivial', 'small', 'medium', 'large'][f] AS max_effort FROM e JOIN sym ON sym.id = e.id
WHERE findings >= 2 OR f = 4 OR loc >= 100 ORDER BY findings DESC, loc + complexity DESC, file, e.id LIMIT 30""",
    "sql_lint": f"SELECT p_partkey, rule_id, finding_kind, severity, effort, confidence FROM part JOIN (VALUES {_RULE_ROWS}) AS r(i, rule_id, finding_kind, severity, effort, confidence) ON r.i = p_partkey % 33",
}
