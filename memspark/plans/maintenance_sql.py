"""The queries of maintenance in SQL, for comparison in DuckDB."""

from memspark.functions.text import TECHNOLOGIES
from memspark.plans.maintenance import SOURCE, TARGET

_ONE = "QUALIFY row_number() OVER (PARTITION BY id) = 1"
_F = f"f AS (SELECT * FROM temporal_fragments {_ONE})"
_T = f"t AS (SELECT * FROM triples {_ONE})"
_NOW = "TIMESTAMP '2026-06-01'"
_SCORE = f"coalesce(importance, 0) * pow(0.5::DOUBLE, greatest(epoch_us({_NOW}) - greatest(epoch_us(updated_at), epoch_us(last_accessed_at)), 0) / 86400e6 / 30.0) * least(3.0, 1 + log10(1 + coalesce(access_count, 0)))"
_COLD_F = f"(coalesce(time_end < {_NOW} - INTERVAL 180 DAY, false) OR coalesce(updated_at < {_NOW} - INTERVAL 180 DAY AND importance <= 0.3, false))"
_COLD_T = f"coalesce(valid_to < {_NOW} - INTERVAL 365 DAY, false)"
_STATE = "('project_state', 'task_status', 'config')"
_GROUPS = """rows AS (SELECT *, list_sort(coalesce(entities, [])) AS names FROM f WHERE layer = 'L1'),
each AS (SELECT scope, names, count(*) AS members, max(importance) AS importance, min(time_start) AS a, max(time_end) AS b, sum(access_count) AS access_count, string_agg(substr(content, 1, 50), '; ' ORDER BY id) AS body, list(id) AS ids FROM rows GROUP BY scope, names HAVING count(*) >= 2)"""
_VALUES = "coalesce(CASE WHEN object_id <> '' THEN object_id END, object_value)"
_PAIRS = f"""now AS (SELECT id, scope, subject_id, predicate, {_VALUES} AS v, relation_type, TRY_CAST(nullif(regexp_extract({_VALUES}, '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS x FROM t WHERE valid_to IS NULL),
pairs AS (SELECT a.id, a.relation_type = 'causal' AND b.relation_type = 'causal' AS causal, a.x, b.x AS y, a.relation_type IN {_STATE} OR b.relation_type IN {_STATE} OR a.predicate IN ('color', 'status', 'state', 'priority', 'category', '颜色', '状态', '类别', '优先级') AS single
  FROM now a JOIN now b ON a.scope = b.scope AND a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.id <> b.id AND a.v <> b.v)"""
_KEYED = f"""shared AS (SELECT * REPLACE (regexp_replace(entity_id, '(-\\d+)+$', '') AS entity_id) FROM entities), names AS (SELECT id, min(entity_id) AS entity_id FROM shared GROUP BY id),
keyed AS (SELECT t.*, concat_ws('|', coalesce(s.entity_id, subject_id), predicate, CASE WHEN length(object_id) > 0 THEN coalesce(o.entity_id, object_id) ELSE 'value:' || lower(regexp_replace(regexp_replace(object_value, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) END) AS pattern
  FROM t LEFT JOIN names s ON s.id = subject_id LEFT JOIN names o ON o.id = object_id),
found AS (SELECT pattern, count(DISTINCT scope) AS projects, count(*) AS support, arg_min(id, {{'c': -coalesce(confidence, 0), 'id': id}}) AS representative FROM keyed
  WHERE starts_with(scope, 'project:') AND valid_to IS NULL AND relation_type NOT IN {_STATE} GROUP BY pattern HAVING count(DISTINCT scope) >= 2)"""
_PARTS = "sha256('global|' || pattern) AS id, representative AS source, split_part(pattern, '|', 1) AS subject_key, split_part(pattern, '|', 2) AS predicate, array_to_string(string_split(pattern, '|')[3:], '|') AS object_key"
_PROMOTED = f"promoted AS (SELECT {_PARTS} FROM found WHERE pattern NOT IN (SELECT pattern FROM keyed WHERE scope = 'global' AND pattern IS NOT NULL))"
_SCOPED = "regexp_matches(scope, '^(global|project:.+|tenant:.+)$')"
_NEW = f"sha256('{TARGET}|' || %s)"
_CLONE = f"""e AS (SELECT * FROM entities WHERE scope = '{SOURCE}' AND valid_to IS NULL {_ONE}), firsts AS (SELECT entity_id, min(id) AS first FROM e GROUP BY entity_id), have AS (SELECT entity_id, min(id) AS have FROM entities WHERE scope = '{TARGET}' GROUP BY entity_id),
ids AS (SELECT e.id, coalesce(have, {_NEW % 'first'}) AS new_id, first, have, entity_id FROM e JOIN firsts USING (entity_id) LEFT JOIN have USING (entity_id))"""
_TECH = ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])({'|'.join(a.replace('.', chr(92) + '.') for a in aliases)})([^a-z0-9]|$)') THEN '{name}' END" for name, aliases in TECHNOLOGIES.items())
_FOLD = "substr(regexp_replace(lower(regexp_replace(regexp_replace(coalesce({0}, ''), '^[\\s\\x0b\\x85\\pZ]+|[\\s\\x0b\\x85\\pZ]+$', '', 'g'), '[\\s\\x0b\\x85\\pZ]+', ' ', 'g')), '\\p{{Nd}}+', '#', 'g'), 1, 200)"
_CUT = "CASE WHEN length({0}) <= 120 THEN {0} ELSE coalesce(nullif(regexp_extract(substr({0}, 1, 120), '(?s)^.+[。！？!?]'), ''), substr({0}, 1, 120)) || '…(原文共 ' || length({0}) || ' 字)' END"
_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i::BIGINT, 2)))"
_COMPACT = "regexp_replace(lower(coalesce({0}, '')), '[^0-9a-z一-鿿]+', '', 'g')"
_HEADINGS = "regexp_extract_all(text, '(?m)^#{1,3}[ \\t]+(.+?)\\s*#*\\s*$', 1)"


def _near(which: str) -> str:
    """The fragments that hold, with g, the least id of their group of near-duplicates, by all pairs."""
    return f"""r AS (SELECT * FROM (SELECT *, {_COMPACT.format('content')} AS norm FROM temporal_fragments WHERE {which} {_ONE}) WHERE length(norm) >= 12),
c AS (SELECT scope, layer, norm, min(id) AS rep, {_GRAMS.format('norm')} AS grams FROM r GROUP BY scope, layer, norm),
links AS (SELECT x.rep AS a, y.rep AS b FROM c x JOIN c y ON x.scope IS NOT DISTINCT FROM y.scope AND x.layer IS NOT DISTINCT FROM y.layer AND len(x.grams) >= 0.7 * len(y.grams) AND len(y.grams) >= 0.7 * len(x.grams)
  AND len(list_intersect(x.grams, y.grams)) >= 0.7 * (len(x.grams) + len(y.grams) - len(list_intersect(x.grams, y.grams)))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT t.a, l.b FROM reach t JOIN links l ON t.b = l.a), root AS (SELECT a, min(b) AS g FROM reach GROUP BY a),
grouped AS (SELECT r.*, g FROM r JOIN c ON c.scope IS NOT DISTINCT FROM r.scope AND c.layer IS NOT DISTINCT FROM r.layer AND c.norm = r.norm JOIN root ON root.a = c.rep)"""


def _check(table: str, tests: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{table}.{n}' AS \"check\", count(*) FILTER (NOT coalesce({t}, false)) AS n FROM {table}" for n, t in tests.items())


_README = f"""WITH d AS (SELECT scope, text FROM documents WHERE lower(trim(source)) = 'readme')
SELECT DISTINCT scope AS subject, 'uses_tech' AS predicate, unnest(list_filter([{_TECH}], lambda x: x IS NOT NULL)) AS object, 'tech:' || lower(object) AS object_key FROM d
UNION SELECT scope, 'has_section', o, CASE WHEN k <> '' THEN 'concept:' || k END FROM (SELECT scope, o, regexp_replace(regexp_replace(lower(o), '[^\\pL\\pN_]+', '-', 'g'), '^-+|-+$', '', 'g') AS k FROM (SELECT scope, unnest({_HEADINGS}[:20]) AS o FROM d))"""
_SEEDED = f"""readme AS ({_README}), seeds AS (SELECT subject AS scope, 'concept:' || subject AS subject_key, predicate, object_key, object FROM readme WHERE subject IS NOT NULL AND object_key IS NOT NULL),
wanted AS (SELECT scope, entity_id, min(name) AS name FROM (SELECT scope, subject_key AS entity_id, subject_key AS name FROM seeds UNION ALL SELECT scope, object_key, object FROM seeds) GROUP BY scope, entity_id),
e AS (SELECT scope, regexp_replace(entity_id, '(-\\d+)+$', '') AS entity_id, min(id) AS id FROM entities GROUP BY 1, 2),
made AS (SELECT w.*, coalesce(o.id, g.id) AS known, coalesce(o.id, g.id, sha256('seed|' || w.scope || '|' || w.entity_id)) AS id FROM wanted w LEFT JOIN e o ON o.scope = w.scope AND o.entity_id = w.entity_id LEFT JOIN e g ON g.scope = 'global' AND g.entity_id = w.entity_id)"""

SQL = {
    "consolidate_groups": f"WITH {_F}, {_GROUPS} SELECT scope, array_to_string(names, ',') AS entities, '【聚合】' || CASE WHEN len(names) > 0 THEN array_to_string(names, ',') ELSE scope END || ':' || members || ' 条记忆聚合 — ' || body AS content, importance, epoch_us(a) AS start_us, epoch_us(b) AS end_us, access_count::BIGINT AS access_count, members FROM each",
    "consolidate_survivors": f"WITH {_F}, {_GROUPS} SELECT layer, count(*) AS n FROM f WHERE id NOT IN (SELECT unnest(ids) FROM each) GROUP BY layer",
    "forget_scores": f"WITH {_F} SELECT id, round({_SCORE}, 6) AS score, CASE WHEN importance >= 0.9 THEN 'protected' WHEN time_end < {_NOW} THEN 'expired' WHEN {_SCORE} < 0.1 THEN 'decayed' ELSE 'kept' END AS verdict FROM f",
    "capacity_prune": f"WITH {_F}, s AS (SELECT scope, id, importance, {_SCORE} AS score, count(*) OVER (PARTITION BY scope) - 50 AS excess FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score, id) AS place FROM s WHERE coalesce(importance < 0.9, true)) SELECT scope, id FROM o WHERE place <= excess",
    "top_fragments": f"WITH {_F} SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY importance DESC NULLS LAST, id)::INT AS place, id FROM f QUALIFY place <= 5",
    "archive_split": f"WITH {_F}, {_T} SELECT id, 'temporal_fragments' AS table_name, CASE WHEN {_COLD_F} THEN 'cold' ELSE 'hot' END AS tier FROM f UNION ALL SELECT id, 'triples', CASE WHEN {_COLD_T} THEN 'cold' ELSE 'hot' END FROM t",
    "archive_find_cold": f"WITH {_F}, {_T} SELECT (SELECT count(*) FROM f WHERE {_COLD_F}) AS fragments, (SELECT count(*) FROM t WHERE {_COLD_T}) AS triples",
    "archive_query": f"""WITH {_F}, {_T}, gone AS (SELECT id, 'temporal_fragments' AS found_in, content AS x, time_start AS row_time FROM f WHERE {_COLD_F} UNION ALL SELECT id, 'triples', concat_ws(' ', subject_id, predicate, coalesce({_VALUES}, '?')), valid_from FROM t WHERE {_COLD_T})
SELECT id, found_in FROM gone WHERE translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%scope filter%' ORDER BY row_time DESC NULLS LAST, id LIMIT 50""",
    "restore_roundtrip": f"WITH {_T} SELECT id, CASE WHEN {_COLD_T} AND scope IS DISTINCT FROM '{SOURCE}' THEN 'cold' ELSE 'hot' END AS tier FROM t",
    "predicate_codes": "SELECT predicate, row_number() OVER (ORDER BY predicate)::INT AS code FROM (SELECT DISTINCT predicate FROM triples WHERE predicate IS NOT NULL)",
    "contradiction_kinds": f"""WITH {_T}, {_PAIRS} SELECT DISTINCT id, CASE WHEN causal THEN 'causal' WHEN x IS NOT NULL AND y IS NOT NULL THEN 'numeric' ELSE 'value' END AS kind FROM pairs
WHERE causal OR (x IS NOT NULL AND y IS NOT NULL AND x <> y AND abs(x - y) / greatest(abs(x), abs(y)) > 0.1) OR ((x IS NULL OR y IS NULL) AND single)""",
    "contradiction_temporal": f"""WITH {_T}, r AS (SELECT id, scope, subject_id, predicate, {_VALUES} AS v, valid_from AS a, coalesce(valid_to, 'infinity') AS b, valid_to IS NOT NULL AS closed FROM t WHERE valid_from < coalesce(valid_to, 'infinity'))
SELECT DISTINCT x.id FROM r x JOIN r y ON x.scope = y.scope AND x.subject_id = y.subject_id AND x.predicate = y.predicate AND x.v <> y.v AND x.a < y.b AND y.a < x.b WHERE x.closed OR y.closed""",
    "causal_inverse": """WITH x AS (SELECT id, scope, predicate, subject_id, object_id, valid_to FROM triples UNION ALL SELECT id || '-', scope, predicate, object_id, subject_id, valid_to FROM triples WHERE predicate = 'causes' AND confidence >= 0.5 AND object_id IS NOT NULL),
c AS (SELECT scope, predicate, subject_id AS s, object_id AS o, min(id) AS id FROM x WHERE predicate IN ('导致', 'causes', 'leads_to') AND valid_to IS NULL AND object_id IS NOT NULL GROUP BY ALL)
SELECT x.id AS a, y.id AS b FROM c x JOIN c y ON x.scope = y.scope AND x.predicate = y.predicate AND x.s = y.o AND x.o = y.s AND x.id < y.id""",
    "cross_project_patterns": f"WITH {_T}, {_KEYED} SELECT pattern, projects, support, representative FROM found",
    "promote_missing": f"WITH {_T}, {_KEYED}, {_PROMOTED} SELECT * FROM promoted",
    "promote_entities": f"""WITH {_T}, {_KEYED}, {_PROMOTED} SELECT sha256('global|entity|' || entity_id) AS id, entity_id, arg_min(entity_type, id) AS entity_type, arg_min(name, id) AS name, min(id) AS source_closet FROM shared
WHERE starts_with(scope, 'project:') AND entity_id IN (SELECT subject_key FROM promoted UNION SELECT object_key FROM promoted) AND entity_id NOT IN (SELECT entity_id FROM shared WHERE scope = 'global' AND entity_id IS NOT NULL) GROUP BY entity_id""",
    "promote_by_hand": f"""WITH {_T}, {_KEYED}, wanted AS (SELECT pattern, min(id) AS representative FROM keyed WHERE confidence >= 0.95 AND relation_type = 'semantic' AND pattern NOT IN (SELECT pattern FROM keyed WHERE scope = 'global' AND pattern IS NOT NULL) GROUP BY pattern)
SELECT {_PARTS} FROM wanted""",
    "contradiction_new": f"""WITH {_T}, x AS (SELECT id, scope, subject_id, predicate, coalesce({_VALUES}, '') AS v, relation_type, object_id, valid_from AS a, coalesce(valid_to, 'infinity') AS b, valid_to IS NULL AS o, TRY_CAST(nullif(regexp_extract({_VALUES}, '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS n FROM t),
p AS (SELECT y.id || '+' AS new_id, x.id AS old_id, CASE WHEN y.relation_type = 'causal' AND x.relation_type = 'causal' AND y.o AND x.o THEN 'causal' WHEN NOT (y.o AND x.o) AND y.a < x.b AND x.a < y.b THEN 'temporal'
  WHEN y.o AND x.o AND y.n IS NOT NULL AND x.n IS NOT NULL THEN CASE WHEN y.n <> x.n AND abs(y.n - x.n) / greatest(abs(y.n), abs(x.n)) > 0.1 THEN 'numeric' END
  WHEN y.o AND x.o AND (y.relation_type IN {_STATE} OR x.relation_type IN {_STATE} OR y.predicate IN ('color', 'status', 'state', 'priority', 'category', '颜色', '状态', '类别', '优先级')) THEN 'value' END AS kind
  FROM x y JOIN x ON y.scope IS NOT DISTINCT FROM x.scope AND y.subject_id IS NOT DISTINCT FROM x.subject_id AND y.predicate IS NOT DISTINCT FROM x.predicate AND y.v <> x.v WHERE y.scope = '{SOURCE}'
  UNION ALL SELECT y.id || '+', x.id, 'inverse' FROM x y JOIN x ON y.scope = x.scope AND y.predicate = x.predicate AND y.v = x.subject_id AND y.subject_id = x.object_id
  WHERE y.scope = '{SOURCE}' AND y.relation_type = 'causal' AND y.predicate IN ('导致', 'causes', 'leads_to') AND x.relation_type = 'causal' AND x.o)
SELECT new_id, kind, count(*) AS n, min(old_id) AS existing FROM p WHERE kind IS NOT NULL GROUP BY ALL""",
    "sink_triples": """WITH k AS (SELECT DISTINCT scope, subject_id, predicate, object_id, object_value, valid_from, coalesce(confidence >= 0.5, false) AS late FROM triples)
SELECT DISTINCT scope, subject_id, predicate, object_id, object_value, epoch_us(valid_from) AS from_us FROM k a WHERE late AND NOT EXISTS (SELECT 1 FROM k b WHERE NOT b.late AND a.scope IS NOT DISTINCT FROM b.scope AND a.subject_id IS NOT DISTINCT FROM b.subject_id AND a.predicate IS NOT DISTINCT FROM b.predicate AND a.object_id IS NOT DISTINCT FROM b.object_id AND a.object_value IS NOT DISTINCT FROM b.object_value AND a.valid_from IS NOT DISTINCT FROM b.valid_from)""",
    "sink_entities": """WITH s AS (SELECT scope, regexp_replace(entity_id, '(-\\d+)+$', '') AS entity_id, valid_to FROM entities) SELECT DISTINCT scope, entity_id FROM s a WHERE valid_to IS NULL AND NOT EXISTS (SELECT 1 FROM s b WHERE b.valid_to IS NOT NULL AND a.scope IS NOT DISTINCT FROM b.scope AND a.entity_id IS NOT DISTINCT FROM b.entity_id)""",
    "sink_locations": "SELECT DISTINCT scope, location_id FROM locations a WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM locations b WHERE b.parent_id IS NULL AND a.scope IS NOT DISTINCT FROM b.scope AND a.location_id IS NOT DISTINCT FROM b.location_id)",
    "vectors_deleted": "WITH g AS (SELECT id FROM temporal_fragments WHERE epoch_us(time_end) < 1740000000000000) SELECT DISTINCT id FROM vector_links WHERE NOT coalesce(entity_id IN (SELECT id FROM g), false) AND NOT coalesce(triple_id IN (SELECT id FROM g), false) AND NOT coalesce(fragment_id IN (SELECT id FROM g), false)",
    "version_conflicts": f"""WITH {_T}, w AS (SELECT concat_ws('|', scope, subject_id, predicate) AS r, count(*) AS n, arg_max(predicate, id) AS other FROM t WHERE starts_with(scope, 'project:') AND relation_type IN {_STATE} GROUP BY 1),
i AS (SELECT DISTINCT concat_ws('|', scope, subject_id, predicate) AS r, CASE WHEN confidence > 0.8 THEN 2 END AS e FROM project_current_state),
k AS (SELECT i.r, e, coalesce(n, 0) AS v, other, CASE WHEN e IS NOT NULL AND e <> coalesce(n, 0) THEN 'version_stale' WHEN n > 1 THEN 'write_write' END AS kind FROM i LEFT JOIN w USING (r))
SELECT r AS resource_id, 'chain' AS chain_id, kind, CASE kind WHEN 'version_stale' THEN 'auto_merge' ELSE 'auto_last' END AS strategy, v AS current_version, other AS other_chain_id FROM k WHERE kind IS NOT NULL""",
    "read_write_conflicts": """WITH w AS (SELECT props, max({'at': ts, 'c': user_id::VARCHAR}) AS w FROM events WHERE event_type = 'error' GROUP BY props)
SELECT props AS resource_id, user_id::VARCHAR AS chain_id, epoch_us(ts) AS read_us, 'read_write' AS kind, 'auto_last' AS strategy, w.c AS other_chain_id FROM events JOIN w USING (props) WHERE event_type = 'view' AND w.c <> user_id::VARCHAR AND epoch_us(w.at) - epoch_us(ts) BETWEEN 1 AND 86400000000""",
    "expired_fingerprints": f"WITH p AS (SELECT substr(sha256('global|error|' || {_FOLD.format('props')}), 1, 16) AS fingerprint, max(ts) AS last FROM events WHERE event_type = 'error' GROUP BY 1) SELECT fingerprint FROM p WHERE last < TIMESTAMP '2024-06-01' - INTERVAL 90 DAY",
    "consolidate_members": f"WITH {_F}, {_GROUPS} SELECT row_number() OVER (PARTITION BY r.scope, r.names ORDER BY r.id) - 1 AS position, r.id, substr(content, 1, 50) AS text FROM rows r JOIN each e ON e.scope = r.scope AND e.names = r.names",
    "dq_constraints": " UNION ALL ".join([
        _check("entities", {"entity_type": "entity_type IN ('person', 'location', 'object', 'concept', 'event')", "scope": _SCOPED}),
        _check("triples", {"relation_type": "relation_type IN ('semantic', 'causal', 'spatial', 'temporal', 'project_state', 'task_status', 'config')", "certainty": "certainty IN ('exact', 'high', 'medium', 'low', 'unknown')", "confidence": "confidence IS NULL OR confidence BETWEEN 0 AND 1", "causal_level": "causal_level >= 0", "object": "object_id IS NOT NULL OR object_value IS NOT NULL", "scope": _SCOPED}),
        _check("temporal_fragments", {"layer": "layer IN ('L0', 'L1', 'L2', 'L3')", "importance": "importance IS NULL OR importance BETWEEN 0 AND 1", "scope": _SCOPED}),
        _check("locations", {"latitude": "coordinates IS NULL OR coordinates.lat BETWEEN -90 AND 90", "longitude": "coordinates IS NULL OR coordinates.lng BETWEEN -180 AND 180"}),
        _check("vector_links", {"owner": "coalesce(entity_id, triple_id, fragment_id) IS NOT NULL", "dimension": "embedding IS NULL OR len(embedding) = dimension"}),
    ]),
    "stats_by_layer": "SELECT scope, layer, count(DISTINCT id) AS n FROM temporal_fragments GROUP BY ALL UNION ALL SELECT scope, NULL, count(DISTINCT id) FROM triples WHERE valid_to IS NULL GROUP BY scope",
    "community_edges": f"""WITH {_T}, k AS (SELECT id, min(scope) AS home FROM entities GROUP BY id),
own AS (SELECT scope AS universe, least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b, count(*) AS weight FROM t JOIN k s ON s.id = subject_id JOIN k o ON o.id = object_id
  WHERE valid_to IS NULL AND subject_id <> object_id AND s.home IN ('global', t.scope) AND o.home IN ('global', t.scope) GROUP BY ALL),
ends AS (SELECT universe, a AS node FROM own WHERE universe <> 'global' UNION SELECT universe, b FROM own WHERE universe <> 'global')
SELECT universe, a, b, sum(weight)::BIGINT AS weight FROM (FROM own UNION ALL SELECT x.universe, o.a, o.b, o.weight FROM own o JOIN ends x ON x.node = o.a JOIN ends y ON y.node = o.b AND y.universe = x.universe WHERE o.universe = 'global') GROUP BY ALL""",
    "clone_entities": f"WITH {_CLONE} SELECT {_NEW % 'id'} AS id, id AS source_id, entity_id FROM ids WHERE have IS NULL AND id = first",
    "clone_triples": f"""WITH {_CLONE}, src AS (SELECT * FROM triples WHERE scope = '{SOURCE}' AND valid_to IS NULL {_ONE}),
m AS (SELECT src.id, s.new_id AS s, o.new_id AS o, predicate, coalesce(object_value, '') AS v, predecessor_id FROM src JOIN ids s ON s.id = subject_id LEFT JOIN ids o ON o.id = object_id WHERE object_id IS NULL OR o.id IS NOT NULL),
kept AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM triples x WHERE x.scope = '{TARGET}' AND x.subject_id = s AND x.predicate IS NOT DISTINCT FROM m.predicate AND coalesce(x.object_id, '') = coalesce(o, '') AND coalesce(x.object_value, '') = v) QUALIFY row_number() OVER (PARTITION BY s, predicate, o, v ORDER BY id) = 1)
SELECT {_NEW % 'k.id'} AS id, k.id AS source_id, k.s AS subject_id, k.o AS object_id, CASE WHEN p.id IS NOT NULL THEN {_NEW % 'p.id'} END AS predecessor_id FROM kept k LEFT JOIN kept p ON p.id = k.predecessor_id""",
    "fingerprints": f"""SELECT substr(sha256('global|error|' || {_FOLD.format('props')}), 1, 16) AS fingerprint, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events WHERE event_type = 'error' GROUP BY 1""",
    "rule_summaries": f"SELECT doc_id, {_CUT.format('text')} AS summary FROM documents",
    "summarize_rule": f"""WITH {_F}, s AS (SELECT fragment_id || ':summary' AS fid, arg_min(content, id) AS c, min(id) AS id FROM f WHERE layer = 'L1' AND length(content) > 500 AND fragment_id || ':summary' NOT IN (SELECT fragment_id FROM f WHERE fragment_id IS NOT NULL) GROUP BY 1)
SELECT fid AS fragment_id, '【摘要】' || {_CUT.format('c')} AS content, f.scope, f.layer, s.id AS source_id FROM s JOIN f ON f.id = s.id""",
    "readme_seeds": _README,
    "jaccard_to_predecessor": f"""WITH s AS (SELECT DISTINCT scope, subject_id, predicate, id, coalesce(object_id, object_value) AS v FROM triples WHERE starts_with(scope, 'project:') AND relation_type IN {_STATE}),
p AS (SELECT id, v, lag(id) OVER k AS before, lag(v) OVER k AS w FROM s WINDOW k AS (PARTITION BY scope, subject_id, predicate ORDER BY id)),
c AS (SELECT id, {_COMPACT.format('v')} AS a, {_COMPACT.format('w')} AS b FROM p WHERE before IS NOT NULL AND v IS DISTINCT FROM w),
g AS (SELECT id, CASE WHEN length(a) = 1 THEN [a] ELSE {_GRAMS.format('a')} END AS x, CASE WHEN length(b) = 1 THEN [b] ELSE {_GRAMS.format('b')} END AS y FROM c)
SELECT id, round(CASE WHEN len(x) + len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 9) AS jaccard FROM g""",
    "mask_plain": r"""SELECT DISTINCT id, regexp_replace(regexp_replace(content, '(?:sk-ant-|sk-proj-|sk-)[A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|Bearer[\s]+[A-Za-z0-9._-]{20,}', '[API_KEY]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS content FROM temporal_fragments""",
    "quantize_error": "SELECT DISTINCT vector_id, true AS within_half_step, CASE WHEN list_min(embedding) = list_max(embedding) THEN 0 ELSE 255 END AS top_code, 0 AS low_code FROM vector_links WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))",
    "quantize_codes": """WITH v AS (SELECT DISTINCT vector_id, embedding AS e, list_min(embedding) AS low, list_max(embedding) AS high FROM vector_links WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))))
SELECT vector_id, array_to_string(list_transform(e, lambda x: CASE WHEN low = high THEN 0 ELSE round_even(((x - low)::FLOAT * (255::FLOAT / (high - low)::FLOAT)::FLOAT)::DOUBLE, 0)::INT END), ',') AS codes, low, high FROM v""",
    "hash_embed": """WITH h AS (SELECT doc_id, list_transform(range(8), lambda b: sha256(text || chr(0) || b)) AS hs FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, list_transform(range(64), lambda i: ((('0x' || substr(hs[i // 8 + 1], 8 * (i % 8) + 7, 2) || substr(hs[i // 8 + 1], 8 * (i % 8) + 5, 2) || substr(hs[i // 8 + 1], 8 * (i % 8) + 3, 2) || substr(hs[i // 8 + 1], 8 * (i % 8) + 1, 2))::BIGINT)::DOUBLE / 4294967296 * 2 - 1)::FLOAT) AS v FROM h),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM w)
SELECT doc_id, array_to_string(list_transform(v, lambda x: floor((x::DOUBLE / n)::FLOAT::DOUBLE * 1000 + 0.5)::BIGINT), ',') AS thousandths FROM n""",
    "clone_fragments": f"""WITH {_CLONE}, p AS (SELECT * FROM locations WHERE scope = '{SOURCE}' AND valid_to IS NULL {_ONE}),
places AS (SELECT p.id, coalesce(h.have, sha256('{TARGET}|' || f.first)) AS new_id FROM p JOIN (SELECT location_id, min(id) AS first FROM p GROUP BY location_id) f USING (location_id) LEFT JOIN (SELECT location_id, min(id) AS have FROM locations WHERE scope = '{TARGET}' GROUP BY location_id) h USING (location_id)),
f AS (SELECT * FROM temporal_fragments WHERE scope = '{SOURCE}' AND layer <> 'L3' {_ONE}), fresh AS (SELECT * FROM f WHERE fragment_id IS NOT NULL AND fragment_id NOT IN (SELECT fragment_id FROM temporal_fragments WHERE scope = '{TARGET}' AND fragment_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY fragment_id ORDER BY id) = 1),
named AS (SELECT x.id, string_agg(new_id, ',' ORDER BY pos) AS entities FROM (SELECT fresh.id, unnest(range(len(entities))) AS pos, unnest(entities) AS entity FROM fresh) x JOIN ids ON ids.id = x.entity GROUP BY x.id)
SELECT {_NEW % 'fresh.id'} AS id, fresh.id AS source_id, coalesce(named.entities, '') AS entities, places.new_id AS location_id FROM fresh LEFT JOIN named ON named.id = fresh.id LEFT JOIN places ON places.id = fresh.location_id""",
    "dedup_classes": f'WITH RECURSIVE {_near("true")} SELECT id, g AS "group" FROM grouped',
    "dedup_groups": f"""WITH RECURSIVE {_near("coalesce(importance < 0.9, true)")}, named AS (SELECT g, string_agg(DISTINCT x, ',' ORDER BY x) AS entities FROM (SELECT g, unnest(entities) AS x FROM grouped) GROUP BY g)
SELECT arg_min(id, {{'c': coalesce(epoch_us(created_at), 4611686018427387904), 'id': id}}) AS survivor, count(*) AS members, sum(access_count)::BIGINT AS access_count, max(importance) AS importance, coalesce(any_value(named.entities), '') AS entities FROM grouped LEFT JOIN named USING (g) GROUP BY g HAVING count(*) > 1""",
    "content_lookup": f"""WITH ids AS (SELECT DISTINCT coalesce(entity_id, triple_id, fragment_id) AS id FROM vector_links), x AS (
SELECT id, 0 AS i, content, 'temporal_fragments' AS found_in FROM temporal_fragments UNION ALL SELECT id, 1, name || ' (' || entity_type || ')', 'entities' FROM entities
UNION ALL SELECT id, 2, concat_ws(' ', subject_id, predicate, coalesce(CASE WHEN length(object_id) > 0 THEN object_id END, CASE WHEN length(object_value) > 0 THEN object_value END, '?')), 'triples' FROM triples)
SELECT id, content, found_in FROM x WHERE id IN (SELECT id FROM ids) QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC, content DESC NULLS LAST) = 1""",
    "sink_new_fragments": "SELECT DISTINCT scope, fragment_id FROM temporal_fragments a WHERE layer = 'L1' AND NOT EXISTS (SELECT 1 FROM temporal_fragments b WHERE b.layer <> 'L1' AND a.scope IS NOT DISTINCT FROM b.scope AND a.fragment_id IS NOT DISTINCT FROM b.fragment_id)",
    "text_functions": f"""WITH c AS (SELECT doc_id, text, regexp_replace(lower(text), '[^0-9a-z一-鿿]+', '', 'g') AS k FROM documents)
SELECT doc_id, md5(k) AS compact, CASE WHEN k IS NULL THEN 0 WHEN length(k) >= 2 THEN len(list_distinct(list_transform(range(1, length(k)), lambda i: substr(k, i::BIGINT, 2)))) ELSE length(k) END::INT AS bigrams, sha256(text) AS digest, 'text:' || substr(sha256(text), 1, 16) AS text_key,
TRY_CAST(nullif(regexp_extract(text, '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS first_number, concat_ws(',', {_TECH}) AS technologies, {_FOLD.format('text')} AS error_text FROM c""",
    "bootstrap_entities": f"WITH {_SEEDED} SELECT id, entity_id, name, scope FROM made WHERE known IS NULL",
    "bootstrap_triples": f"""WITH {_SEEDED}, rows AS (SELECT DISTINCT w.scope, s.id AS subject_id, predicate, o.id AS object_id FROM seeds w JOIN made s ON s.scope = w.scope AND s.entity_id = w.subject_key JOIN made o ON o.scope = w.scope AND o.entity_id = w.object_key)
SELECT sha256(concat_ws('|', 'seed', scope, subject_id, predicate, object_id)) AS id, * FROM rows r WHERE NOT EXISTS (SELECT 1 FROM triples t WHERE t.scope = r.scope AND t.subject_id = r.subject_id AND t.predicate = r.predicate AND t.object_id = r.object_id)""",
    "bootstrap_gaps": """SELECT scope, predicate FROM (SELECT DISTINCT scope FROM triples WHERE starts_with(scope, 'project:')), (SELECT unnest(['owner', 'status', 'build_version', 'deadline']) AS predicate)
EXCEPT SELECT scope, predicate FROM triples WHERE valid_to IS NULL""",
}
