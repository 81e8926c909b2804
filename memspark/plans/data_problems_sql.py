"""The queries of data_problems in SQL, for comparison in DuckDB."""

_COVERED = """
spans AS (SELECT scope, epoch_us(time_start) AS s, epoch_us(time_end) AS e FROM temporal_fragments WHERE time_end > time_start),
marked AS (SELECT *, max(e) OVER (PARTITION BY scope ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans)
"""

_TREES = """
places AS (SELECT id, min(CASE WHEN regexp_full_match(parent_id, '\\s*') THEN NULL ELSE parent_id END) AS parent_id FROM locations WHERE id IS NOT NULL GROUP BY id),
links AS (SELECT c.id, p.id AS parent FROM places c LEFT JOIN places p ON c.parent_id = p.id),
tree(id, root_id, depth, path) AS (
  SELECT id, id, 0::BIGINT, id FROM links WHERE parent IS NULL
  UNION ALL SELECT l.id, t.root_id, t.depth + 1, t.path || '/' || l.id FROM links l JOIN tree t ON l.parent = t.id),
pairs(id, descendant_id) AS (
  SELECT parent, id FROM links WHERE parent IN (SELECT id FROM tree)
  UNION ALL SELECT l.parent, p.descendant_id FROM pairs p JOIN links l ON l.id = p.id WHERE l.parent IS NOT NULL)
"""

_VERSIONS = """
updates AS (
  SELECT scope, subject_id, predicate, valid_from, valid_to, CASE WHEN regexp_matches(object_id, '\\S') THEN object_id ELSE regexp_replace(object_value, '^\\s+|\\s+$', '', 'g') END AS value, 1 AS first, id
  FROM triples WHERE starts_with(scope, 'project:') AND relation_type IN ('project_state', 'task_status', 'config')
  UNION ALL
  SELECT scope, subject_id, predicate, valid_from, NULL, CASE WHEN regexp_matches(object_id, '\\S') THEN object_id ELSE regexp_replace(object_value, '^\\s+|\\s+$', '', 'g') END AS value, 0, coalesce(value, '')
  FROM project_current_state),
one AS (SELECT *, lead(valid_from) OVER k AS next_from FROM (
  SELECT * FROM updates WHERE valid_from IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY scope, subject_id, predicate, valid_from ORDER BY first DESC, id DESC) = 1)
  WINDOW k AS (PARTITION BY scope, subject_id, predicate ORDER BY valid_from)),
ended AS (SELECT *, CASE WHEN valid_to > valid_from AND (next_from IS NULL OR valid_to < next_from) THEN valid_to ELSE next_from END AS until FROM one),
begun AS (SELECT *, CASE WHEN lag(until) OVER k = valid_from AND lag(value) OVER k IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS new FROM ended
  WINDOW k AS (PARTITION BY scope, subject_id, predicate ORDER BY valid_from)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY scope, subject_id, predicate ORDER BY valid_from) AS n FROM begun),
versions AS (SELECT scope, subject_id, predicate, any_value(value) AS value, epoch_us(min(valid_from)) AS from_us, CASE WHEN bool_or(until IS NULL) THEN -1 ELSE epoch_us(max(until)) END AS to_us
  FROM numbered GROUP BY scope, subject_id, predicate, n)
"""


def _key(column: str) -> str:
    return f"nullif(lower(regexp_replace({column}, '^\\s+|\\s+$', '', 'g')), '')"


_CHECKED = f"""
refs AS (
  SELECT 'vector_links' AS table_name, 'fragment_id' AS column_name, id AS row_id, 'f' AS target, {_key("fragment_id")} AS k, created_at AS row_time FROM vector_links
  UNION ALL SELECT 'temporal_fragments', 'location_id', id, 'l', {_key("location_id")}, time_start FROM temporal_fragments
  UNION ALL SELECT 'triples', 'subject_id', id, 'e', {_key("subject_id")}, valid_from FROM triples
  UNION ALL SELECT 'triples', 'object_id', id, 'e', {_key("object_id")}, valid_from FROM triples),
parents AS (SELECT target, k, min(coalesce(b, '-infinity')) AS b, max(coalesce(e, 'infinity')) AS e FROM (
  SELECT 'f' AS target, {_key("id")} AS k, NULL::TIMESTAMP AS b, NULL::TIMESTAMP AS e FROM temporal_fragments
  UNION ALL SELECT 'l', {_key("id")}, valid_from, valid_to FROM locations
  UNION ALL SELECT 'e', {_key("id")}, valid_from, valid_to FROM entities) GROUP BY target, k),
checked AS (SELECT table_name, column_name, row_id, row_time, CASE WHEN p.k IS NULL THEN 'missing' WHEN e <= row_time THEN 'closed' WHEN b > row_time THEN 'late' ELSE 'ok' END AS status
  FROM refs r LEFT JOIN parents p USING (target, k) WHERE r.k IS NOT NULL)
"""

SQL = {
    "p1_found": f"WITH {_COVERED} SELECT scope, before AS gap_start_us, s AS gap_end_us FROM marked WHERE s > before",
    "p1_periods": f"""WITH {_COVERED}, runs AS (SELECT *, count(*) FILTER (before IS NULL OR s > before) OVER (PARTITION BY scope ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM marked)
SELECT scope, min(s) AS period_start_us, max(e) AS period_end_us FROM runs GROUP BY scope, n""",
    "p2_found": f"WITH RECURSIVE {_TREES} SELECT l.id, coalesce(t.root_id, 'cycle') AS root_id, coalesce(t.depth, -1) AS depth FROM links l LEFT JOIN tree t USING (id)",
    "p2_paths": f"""WITH RECURSIVE {_TREES}, sizes AS (SELECT id, count(*) AS n FROM pairs GROUP BY id)
SELECT l.id, coalesce(t.root_id, 'cycle') AS root_id, coalesce(t.depth, -1) AS depth, t.path, CASE WHEN t.id IS NOT NULL THEN coalesce(s.n, 0) END AS n_descendants FROM links l LEFT JOIN tree t USING (id) LEFT JOIN sizes s USING (id)""",
    "p2_descendants": f"WITH RECURSIVE {_TREES} SELECT id, descendant_id FROM pairs",
    "p6_found": f"WITH {_VERSIONS} SELECT scope, subject_id, predicate, from_us, to_us FROM versions",
    "p6_versions": f"WITH {_VERSIONS} SELECT scope, subject_id, predicate, value, from_us, to_us FROM versions",
    "p7_found": f"WITH {_CHECKED} SELECT DISTINCT table_name, column_name, row_id FROM checked WHERE status IN ('missing', 'closed')",
    "p7_report": f"""WITH {_CHECKED} SELECT table_name, column_name, status, strftime(row_time, '%Y-%m') AS month, count(*) AS n_rows
FROM (SELECT DISTINCT table_name, column_name, row_id, status, row_time FROM checked WHERE status <> 'ok') GROUP BY ALL""",
}
