"""DuckDB counterparts of the problem queries, over the whole tables."""

P2_FOUND = """
WITH iv AS (
  SELECT log_id, qualname, start_us AS f, end_us AS t FROM call_records
  WHERE start_us IS NOT NULL AND end_us IS NOT NULL AND end_us >= start_us
), m AS (
  SELECT *, max(t) OVER (PARTITION BY log_id, qualname ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv
), g AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR f > reach THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, qualname ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS n FROM m
), p AS (
  SELECT log_id, qualname, min(f) AS f, max(t) AS t FROM g GROUP BY log_id, qualname, n
), l AS (
  SELECT *, lead(f) OVER (PARTITION BY log_id, qualname ORDER BY f) AS nxt FROM p
)
SELECT log_id, qualname, 'period' AS kind, f AS from_us, t AS to_us FROM p
UNION ALL
SELECT log_id, qualname, 'gap' AS kind, t AS from_us, nxt AS to_us FROM l WHERE nxt IS NOT NULL
"""

P5_SAMPLES = """
WITH e AS (
  SELECT log_id || '#' || line_no AS record_id, any_value(samples) AS samples FROM raw_events WHERE samples IS NOT NULL GROUP BY log_id, line_no
), s AS (
  SELECT record_id, unnest(samples) AS s, generate_subscripts(samples, 1) - 1 AS i FROM e
), f AS (
  SELECT record_id, i, unnest(s.frames) AS f, generate_subscripts(s.frames, 1) - 1 AS j FROM s WHERE s IS NOT NULL
)
SELECT record_id, 'sample' AS entity, CAST(i AS VARCHAR) AS row_path, CAST(NULL AS VARCHAR) AS parent_path, concat_ws(',', 'count=' || s.count, 'value_ns=' || s.value_ns) AS cells FROM s WHERE s IS NOT NULL
UNION ALL SELECT record_id, 'frame', i || '.' || j, CAST(i AS VARCHAR), concat_ws(',', 'file=' || f.file, 'is_system=' || f.is_system, 'line=' || f.line, 'module=' || f.module, 'name=' || f.name, 'qualified_name=' || f.qualified_name)
FROM f WHERE f IS NOT NULL
"""

P6_LINKS = """
WITH RECURSIVE n AS MATERIALIZED (
  SELECT call_id AS id, min(nullif(parent_call_id, '')) AS parent, any_value(depth) AS depth FROM call_records WHERE call_id IS NOT NULL GROUP BY call_id
), down AS (
  SELECT id, id AS top, CAST(0 AS BIGINT) AS d, id AS path, CASE WHEN parent IS NULL THEN 'rooted' ELSE 'orphan' END AS state FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)
  UNION ALL SELECT n.id, down.top, down.d + 1, down.path || '/' || n.id, down.state FROM down JOIN n ON n.parent = down.id
), loose AS MATERIALIZED (
  SELECT id, parent FROM n WHERE id NOT IN (SELECT id FROM down)
), walk AS (
  SELECT id, parent AS via FROM loose UNION SELECT walk.id, l.parent FROM walk JOIN loose l ON l.id = walk.via
), ring AS MATERIALIZED (
  SELECT id FROM walk WHERE via = id
), marked AS MATERIALIZED (
  SELECT id, top, d, path, state FROM down
  UNION ALL SELECT w.id, min(w.via), NULL, NULL, CASE WHEN w.id IN (SELECT id FROM ring) THEN 'on_cycle' ELSE 'below_cycle' END FROM walk w WHERE w.via IN (SELECT id FROM ring) GROUP BY w.id
)"""
_BELOW = """, pairs AS (
  SELECT n.parent AS up, n.id, CAST(1 AS BIGINT) AS d FROM n JOIN n AS p ON p.id = n.parent WHERE n.id NOT IN (SELECT id FROM ring)
  UNION ALL SELECT n.parent, pairs.id, pairs.d + 1 FROM pairs JOIN n ON n.id = pairs.up JOIN n AS p ON p.id = n.parent WHERE pairs.up NOT IN (SELECT id FROM ring)
)"""

P6_FOUND = P6_LINKS + """
SELECT m.id AS call_id, CASE WHEN m.state <> 'rooted' THEN m.state ELSE 'wrong_depth' END AS fault, m.top AS top_call_id
FROM marked m JOIN n ON n.id = m.id WHERE m.state <> 'rooted' OR (n.depth IS NOT NULL AND n.depth <> m.d)
"""
P6_DESCENDANTS = P6_LINKS + _BELOW + " SELECT up AS ancestor_id, id AS node_id, d AS distance FROM pairs"
P6_HIERARCHY = P6_LINKS + _BELOW + """, counts AS (SELECT up AS id, count(*) AS n FROM pairs GROUP BY up)
SELECT m.id AS call_id, m.top AS top_id, m.d AS depth, m.state, m.path, CAST(coalesce(c.n, 0) AS BIGINT) AS n_descendants FROM marked m LEFT JOIN counts c ON c.id = m.id
"""

SQL = {"p2_found": P2_FOUND, "p5_sample_rows": P5_SAMPLES, "p6_found": P6_FOUND, "p6_hierarchy": P6_HIERARCHY, "p6_descendants": P6_DESCENDANTS}
