"""The queries of retrieval in SQL, for comparison in DuckDB."""

from memspark.plans.retrieval import LAT, LNG, PROJECT, RADIUS_M

_ONE = "QUALIFY row_number() OVER (PARTITION BY id) = 1"
_AT = "valid_from <= TIMESTAMP '2025-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2025-06-01')"
_IN = "valid_from <= TIMESTAMP '2025-04-01' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '2025-03-01')"
_MINE = f"scope IN ('project:{PROJECT}', 'global')"
_STATE = "starts_with(scope, 'project:') AND relation_type IN ('project_state', 'task_status', 'config')"
_EDGES = "edges AS (SELECT DISTINCT subject_id AS src, object_id AS dst, id AS triple, relation_type, valid_from FROM triples WHERE valid_to IS NULL AND object_id IS NOT NULL AND subject_id IS NOT NULL)"
_PEOPLE = "SELECT DISTINCT id FROM entities WHERE entity_type = 'person' AND valid_to IS NULL"
_F = f"f AS (SELECT * FROM temporal_fragments {_ONE})"
_VECTORS = "v AS (SELECT DISTINCT vector_id, embedding, entity_id, triple_id, fragment_id FROM vector_links WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x)))), q AS (SELECT arg_min(embedding, vector_id) AS q FROM vector_links WHERE len(embedding) = 64)"
_DISTANCE = "list_distance(embedding::DOUBLE[], q::DOUBLE[])"
_OWNED = f"""{_VECTORS}, owners AS (SELECT id, min(scope) AS scope FROM (SELECT id, scope FROM entities UNION ALL SELECT id, scope FROM triples UNION ALL SELECT id, scope FROM temporal_fragments) GROUP BY id),
owned AS (SELECT vector_id, embedding, scope FROM v LEFT JOIN owners ON owners.id = coalesce(entity_id, triple_id, fragment_id))"""


def _bm25(terms: list[str], where: str, top: int) -> str:
    n = range(len(terms))
    tf = ", ".join(f"((length(low) - length(replace(low, '{t}', ''))) / {len(t)})::BIGINT AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in n)
    score = " ".join(f"- (CASE WHEN n - df{i} + 0.5 <= df{i} + 0.5 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in n)
    return f"""{_F}, low AS (SELECT id, scope, lower(content) AS low FROM f),
tf AS (SELECT id, scope, greatest(length(low) - 2, 0) AS len, {tf} FROM low), df AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM tf),
bm AS (SELECT id, 0.0 {score} AS score FROM tf, df WHERE ({" OR ".join(f"tf{i} > 0" for i in n)}) AND {where} ORDER BY score, id LIMIT {top})"""


_RANKED = f"""{_bm25(["vector", "index", "stale"], "true", 40)},
fq AS (SELECT arg_min(embedding, id) AS q FROM f WHERE len(embedding) = 64),
near AS (SELECT id, {_DISTANCE} AS d FROM f, fq WHERE len(embedding) = 64 ORDER BY d, id LIMIT 40),
ranks AS (SELECT id AS key, row_number() OVER (ORDER BY d, id) AS rank, 'vector' AS ranking FROM near UNION ALL SELECT id, row_number() OVER (ORDER BY round(score, 9), id), 'words' FROM bm)"""
_FUSED = "SELECT key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(ranking, ',' ORDER BY ranking) AS found_in FROM ranks GROUP BY key"
_CHAIN = """links AS (SELECT DISTINCT id, predecessor_id AS prior FROM triples WHERE predecessor_id IS NOT NULL AND predecessor_id IN (SELECT id FROM triples)),
back(id, depth) AS (SELECT max(id), 0 FROM triples WHERE predecessor_id IS NOT NULL UNION SELECT l.prior, b.depth + 1 FROM back b JOIN links l ON l.id = b.id WHERE b.depth < 20)"""
_FORWARD = """first AS (SELECT DISTINCT id FROM triples WHERE id = (SELECT min(predecessor_id) FROM triples)),
links AS (SELECT DISTINCT id, predecessor_id AS prior FROM triples WHERE predecessor_id IS NOT NULL AND predecessor_id IN (SELECT id FROM triples)),
back(id, depth) AS (SELECT id, 0 FROM first UNION SELECT l.prior, b.depth + 1 FROM back b JOIN links l ON l.id = b.id WHERE b.depth < 20),
forth(id, depth) AS (SELECT id, 0 FROM first UNION SELECT l.id, b.depth + 1 FROM forth b JOIN links l ON l.prior = b.id WHERE b.depth < 20)"""

_THING = "coalesce(CASE WHEN length(object_id) > 0 THEN object_id END, CASE WHEN length(object_value) > 0 THEN object_value END, '?')"
_COLD_F = "(coalesce(time_end < TIMESTAMP '2026-06-01' - INTERVAL 180 DAY, false) OR coalesce(updated_at < TIMESTAMP '2026-06-01' - INTERVAL 180 DAY AND importance <= 0.3, false))"
_COLD_T = "coalesce(valid_to < TIMESTAMP '2026-06-01' - INTERVAL 365 DAY, false)"
_HYBRID = f"""t AS (SELECT * FROM triples {_ONE}), {_EDGES}, {_CHAIN},
forth(id, depth) AS (SELECT max(id), 0 FROM triples WHERE predecessor_id IS NOT NULL UNION SELECT l.id, b.depth + 1 FROM forth b JOIN links l ON l.prior = b.id WHERE b.depth < 20),
start AS (SELECT min(src) AS s FROM edges), hood AS (SELECT s AS node FROM start UNION SELECT dst FROM edges, start WHERE src = s UNION SELECT b.dst FROM edges a JOIN edges b ON b.src = a.dst, start WHERE a.src = s),
by_time AS (SELECT id, row_number() OVER (ORDER BY valid_from, id) AS rank FROM t WHERE {_IN} QUALIFY rank <= 20),
by_graph AS (SELECT id, row_number() OVER (ORDER BY valid_from DESC, id) AS rank FROM t WHERE valid_to IS NULL AND (subject_id IN (SELECT node FROM hood) OR object_id IN (SELECT node FROM hood)) QUALIFY rank <= 20),
by_cause AS (SELECT id, row_number() OVER (ORDER BY way, d, id) AS rank FROM (SELECT 'backward' AS way, id, min(depth) AS d FROM back GROUP BY id UNION ALL SELECT 'forward', id, min(depth) FROM forth GROUP BY id HAVING min(depth) > 0) QUALIFY rank <= 20),
ways AS (SELECT id AS key, rank, 'time' AS ranking, 0 AS i FROM by_time UNION ALL SELECT id, rank, 'graph', 1 FROM by_graph UNION ALL SELECT id, rank, 'cause', 2 FROM by_cause),
hybrid AS (SELECT key, sum(1.0::DOUBLE / (60 + rank)) AS s, min({{'i': i, 'rank': rank}}) AS seen, string_agg(ranking, ',' ORDER BY ranking) AS found_in FROM ways GROUP BY key ORDER BY round(s, 12) DESC, seen LIMIT 10)"""
_CONTEXT = f"""{_HYBRID}, {_bm25(["vector", "index", "stale"], "true", 20)},
fq AS (SELECT arg_min(embedding, id) AS q FROM f WHERE len(embedding) = 64),
near AS (SELECT id, {_DISTANCE} AS d FROM f, fq WHERE len(embedding) = 64 ORDER BY d, id LIMIT 10),
ranks AS (SELECT id AS key, row_number() OVER (ORDER BY d, id) AS rank, 'vector' AS ranking, 0 AS i FROM near UNION ALL SELECT id, row_number() OVER (ORDER BY score, id), 'words', 1 FROM bm),
fused AS (SELECT key, sum(1.0::DOUBLE / (60 + rank)) AS s, min({{'i': i, 'rank': rank}}) AS seen, list(ranking) AS found FROM ranks GROUP BY key ORDER BY round(s, 12) DESC, seen LIMIT 10),
channels AS (SELECT count(DISTINCT r) AS n FROM (SELECT unnest(found) AS r FROM fused)),
items AS (SELECT * FROM (SELECT 0 AS layer, id AS key, coalesce(importance, 0) AS score, content AS text FROM f WHERE layer = 'L0' AND content IS NOT NULL ORDER BY importance DESC NULLS LAST, updated_at DESC NULLS LAST, id LIMIT 10)
  UNION ALL SELECT 1, key, s * 61 / n, content FROM fused JOIN f ON f.id = key, channels UNION ALL SELECT 2, key, s, concat_ws(' ', subject_id, predicate, {_THING}) FROM hybrid JOIN t ON t.id = key),
context AS (SELECT *, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 4)) END::INT AS tokens FROM items QUALIFY row_number() OVER (PARTITION BY key ORDER BY layer) = 1)"""
_FILL = """ordered AS (SELECT *, row_number() OVER (ORDER BY layer, score DESC, key) AS place FROM context),
fill(place, used, taken) AS (SELECT 0::BIGINT, 0::BIGINT, false UNION ALL SELECT o.place, CASE WHEN used + tokens <= 420 THEN used + tokens ELSE used END, used + tokens <= 420 FROM fill l JOIN ordered o ON o.place = l.place + 1)"""

SQL = {
    "temporal_as_of": f"SELECT DISTINCT id, scope, epoch_us(valid_from) AS valid_from_us, epoch_us(valid_to) AS valid_to_us FROM triples WHERE {_AT} AND {_MINE}",
    "temporal_as_of_entities": f"SELECT DISTINCT id, entity_id, epoch_us(valid_from) AS valid_from_us FROM entities WHERE {_AT}",
    "temporal_range": f"SELECT DISTINCT id, epoch_us(valid_from) AS valid_from_us, epoch_us(valid_to) AS valid_to_us FROM triples WHERE {_IN} AND (starts_with(scope, 'project:') OR scope = 'global')",
    "entity_timeline": """WITH people AS (SELECT DISTINCT id FROM entities WHERE entity_type = 'person')
SELECT DISTINCT p.id AS entity, 'subject' AS role, t.id, epoch_us(valid_from) AS valid_from_us FROM triples t JOIN people p ON subject_id = p.id
UNION ALL SELECT DISTINCT p.id, 'object', t.id, epoch_us(valid_from) FROM triples t JOIN people p ON object_id = p.id""",
    "scope_counts": f"""WITH e AS (SELECT * FROM entities {_ONE}) SELECT count(*) FILTER (scope IN ('project:{PROJECT}', 'global')) AS project, count(*) FILTER (scope = 'project:{PROJECT}') AS project_only,
count(*) FILTER (starts_with(scope, 'project:')) AS projects, count(*) FILTER (scope = 'global') AS "global", count(*) FILTER (scope IN ('tenant:t1', 'global')) AS tenant FROM e""",
    "scope_kinds": f"""WITH e AS (SELECT * FROM entities {_ONE}), k AS (SELECT CASE WHEN scope = 'global' THEN 'global' WHEN regexp_matches(scope, '^(project|tenant):.') THEN split_part(scope, ':', 1) END AS kind, scope FROM e)
SELECT kind, count(*) AS n, count(DISTINCT CASE WHEN kind IN ('project', 'tenant') THEN substr(scope, length(kind) + 2) END) AS names FROM k GROUP BY kind""",
    "current_state_lww": f"SELECT scope, subject_id, predicate, id, object_id, object_value, epoch_us(valid_from) AS valid_from_us FROM triples WHERE {_STATE} QUALIFY row_number() OVER (PARTITION BY scope, subject_id, predicate ORDER BY id DESC) = 1",
    "current_state_event_time": f"SELECT scope, subject_id, predicate, id FROM triples WHERE {_STATE} QUALIFY row_number() OVER (PARTITION BY scope, subject_id, predicate ORDER BY valid_from DESC, id DESC) = 1",
    "superseded_chain": f"""WITH s AS (SELECT DISTINCT scope, subject_id, predicate, id, valid_from, coalesce(object_id, object_value) AS value FROM triples WHERE {_STATE})
SELECT id, epoch_us(valid_from) AS valid_from_us, epoch_us(lead(valid_from) OVER k) AS closed_us, CASE WHEN lag(id) OVER k IS NOT NULL AND lag(value) OVER k IS DISTINCT FROM value THEN lag(id) OVER k END AS predecessor FROM s WINDOW k AS (PARTITION BY scope, subject_id, predicate ORDER BY id)""",
    "write_conflicts": """WITH new AS (SELECT DISTINCT scope, subject_id, predicate, coalesce(object_id, object_value) AS value FROM project_current_state)
SELECT n.scope, n.subject_id, n.predicate, value, min(t.id) AS existing FROM new n JOIN triples t ON t.scope = n.scope AND t.subject_id = n.subject_id AND t.predicate = n.predicate
WHERE t.valid_to IS NULL AND value IS DISTINCT FROM coalesce(t.object_id, t.object_value) GROUP BY ALL""",
    "spatial_radius": f"""WITH l AS (SELECT id, coordinates.lng AS x, coordinates.lat AS y FROM locations {_ONE}),
d AS (SELECT id, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(y - {LAT}) / 2), 2) + cos(radians({LAT})) * cos(radians(y)) * pow(sin(radians(x - {LNG}) / 2), 2)))) AS m FROM l
WHERE x BETWEEN greatest({LNG} - {RADIUS_M} / (111000.0 * cos(radians({LAT}))), -180.0) AND least({LNG} + {RADIUS_M} / (111000.0 * cos(radians({LAT}))), 180.0) AND y BETWEEN {LAT} - {RADIUS_M} / 111000.0 AND {LAT} + {RADIUS_M} / 111000.0)
SELECT id, round(m, 3) AS distance_m FROM d WHERE m <= {RADIUS_M}""",
    "spatial_hierarchy": """WITH least AS (SELECT min(path) AS p FROM locations WHERE len(string_split(path, '.')) = 3), top AS (SELECT array_to_string(string_split(p, '.')[:2], '.') AS p FROM least)
SELECT DISTINCT id, path FROM locations, top WHERE path = p OR starts_with(path, p || '.')""",
    "graph_n_degree": f"""WITH {_EDGES}, steps AS (SELECT p.id AS start, dst AS node, 1 AS depth FROM ({_PEOPLE}) p JOIN edges ON src = p.id
UNION SELECT p.id, b.dst, 2 FROM ({_PEOPLE}) p JOIN edges a ON a.src = p.id JOIN edges b ON b.src = a.dst)
SELECT start, node, min(depth)::INT AS depth FROM steps WHERE start <> node GROUP BY start, node""",
    "graph_n_degree_named": f"""WITH {_EDGES} SELECT DISTINCT p.id AS start, dst AS node, 1 AS depth, coalesce(n.name, dst) AS name FROM ({_PEOPLE}) p JOIN edges ON src = p.id
LEFT JOIN (SELECT id, min(name) AS name FROM entities GROUP BY id) n ON n.id = dst WHERE relation_type = 'semantic' AND dst <> p.id""",
    "graph_edges": f"WITH {_EDGES} SELECT src, count(DISTINCT triple) AS n, count(DISTINCT dst) AS targets FROM edges WHERE relation_type IN ('semantic', 'causal') GROUP BY src",
    "graph_path": f"""WITH {_EDGES}, two AS (SELECT min({{'s': a.src, 't': b.dst}}) AS x FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src <> b.dst AND a.src <> a.dst AND a.dst <> b.dst),
direct AS (SELECT min(triple) AS triple FROM edges, two WHERE src = x.s AND dst = x.t), first AS (SELECT dst AS node, min(triple) AS triple FROM edges, two WHERE src = x.s AND dst <> x.s GROUP BY dst),
last AS (SELECT min({{'prior': e.src, 'triple': e.triple}}) AS way FROM edges e JOIN first ON first.node = e.src, two WHERE e.dst = x.t)
SELECT 0 AS position, x.s AS node, NULL::VARCHAR AS triple FROM two UNION ALL SELECT 1, x.t, triple FROM two, direct WHERE triple IS NOT NULL
UNION ALL SELECT 1, first.node, first.triple FROM last, first, direct WHERE first.node = way.prior AND direct.triple IS NULL UNION ALL SELECT 2, x.t, way.triple FROM two, last, direct WHERE direct.triple IS NULL""",
    "causal_backward": f"WITH RECURSIVE {_CHAIN} SELECT 'backward' AS direction, id, min(depth)::INT AS depth FROM back GROUP BY id",
    "causal_forward": f"WITH RECURSIVE {_FORWARD} SELECT 'backward' AS direction, id, min(depth)::INT AS depth FROM back GROUP BY id UNION ALL SELECT 'forward', id, min(depth)::INT FROM forth GROUP BY id HAVING min(depth) > 0",
    "causal_chains": """WITH RECURSIVE one AS (SELECT id, min(predecessor_id) AS p FROM triples GROUP BY id), links AS (SELECT a.id, b.id AS parent FROM one a LEFT JOIN one b ON a.p = b.id),
tree(id, root_id, depth) AS (SELECT id, id, 0::BIGINT FROM links WHERE parent IS NULL UNION ALL SELECT l.id, t.root_id, t.depth + 1 FROM links l JOIN tree t ON l.parent = t.id)
SELECT l.id, coalesce(root_id, 'cycle') AS root_id, coalesce(depth, -1) AS depth FROM links l LEFT JOIN tree USING (id)""",
    "knn_l2": f"WITH {_VECTORS} SELECT vector_id, round({_DISTANCE}, 4) AS distance FROM v, q ORDER BY {_DISTANCE}, vector_id LIMIT 20",
    "knn_scoped_exact": f"WITH {_OWNED} SELECT vector_id, round({_DISTANCE}, 4) AS distance FROM owned, q WHERE scope = 'project:{PROJECT}' ORDER BY {_DISTANCE}, vector_id LIMIT 10",
    "knn_scoped_oversample": f"WITH {_OWNED}, top AS (SELECT vector_id, scope, {_DISTANCE} AS d FROM owned, q ORDER BY d, vector_id LIMIT 50) SELECT vector_id, round(d, 4) AS distance FROM top WHERE scope = 'project:{PROJECT}' ORDER BY d, vector_id LIMIT 10",
    "bm25_fragments": f"WITH {_bm25(['vector', 'index', 'rebuilt', '归档搬运'], 'true', 25)} SELECT id, round(score, 6) AS score FROM bm",
    "bm25_postings": f"WITH {_bm25(['vector', 'index', 'rebuilt', '归档搬运'], 'true', 25)} SELECT id, round(score, 6) AS score FROM bm",
    "panel_phrase": f"WITH {_bm25(['lock manager'], 'true', 30)} SELECT id, round(score, 6) AS score FROM bm",
    "bm25_scoped": f"WITH {_bm25(['session', 'cache', 'stale'], _MINE, 15)} SELECT id, round(score, 6) AS score FROM bm",
    "keyword_like": "SELECT DISTINCT id FROM temporal_fragments WHERE translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%shared_lock%twice%'",
    "panel_search": f"WITH {_F} SELECT id FROM f WHERE content LIKE '%锁管%' ORDER BY updated_at DESC NULLS LAST, id LIMIT 30",
    "keyword_overlap": f"""WITH t AS (SELECT id, lower(concat_ws(' ', predicate, object_value)) AS x FROM triples {_ONE}),
s AS (SELECT id, contains(x, 'token')::INT + contains(x, 'budget')::INT + contains(x, '1000')::INT + contains(x, 'review')::INT + contains(x, 'status')::INT AS score FROM t) SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 40""",
    "rrf_fusion": f"WITH {_RANKED} {_FUSED}",
    "hybrid_search": f"WITH RECURSIVE {_HYBRID} SELECT key, round(s, 9) AS score, found_in FROM hybrid",
    "context_candidates": f"WITH RECURSIVE {_CONTEXT} SELECT layer, key, round(score, 9) AS score, text, tokens FROM context",
    "context_fill": f"WITH RECURSIVE {_CONTEXT}, {_FILL} SELECT count(*) FILTER (taken)::INT AS n, max(used) AS used, bool_or(NOT taken AND place > 0) AS truncated FROM fill",
    "recall_context": f"""WITH RECURSIVE {_CONTEXT}, {_FILL}, cold AS (SELECT id, content AS text, time_start AS row_time FROM f WHERE {_COLD_F} UNION ALL SELECT id, concat_ws(' ', subject_id, predicate, {_THING}), valid_from FROM t WHERE {_COLD_T}),
kept AS (SELECT * FROM cold WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%vector index stale%' ORDER BY row_time DESC NULLS LAST, id LIMIT 10)
SELECT 'L' || layer AS layer, key, round(greatest(0, least(1, score)), 9) AS score, substr(text, 1, 120) AS snippet, tokens FROM ordered JOIN fill USING (place) WHERE taken
UNION ALL SELECT 'L2', id, 0, substr(text, 1, 120), greatest(1, floor(length('[归档] ' || text) / 4))::INT FROM kept""",
    "recall_accesses": f"""WITH RECURSIVE {_CONTEXT}, {_FILL}, hit AS (SELECT DISTINCT key FROM ordered JOIN fill USING (place) WHERE taken)
SELECT id, (coalesce(access_count, 0) + CASE WHEN key IS NULL THEN 0 ELSE 1 END)::BIGINT AS access_count, epoch_us(CASE WHEN key IS NULL THEN last_accessed_at ELSE greatest(last_accessed_at, TIMESTAMP '2026-06-01') END) AS last_us FROM f LEFT JOIN hit ON key = id""",
    "layered_dedup": f"WITH {_F} SELECT id, layer FROM f QUALIFY row_number() OVER (PARTITION BY scope, content ORDER BY layer, importance DESC NULLS LAST, id) = 1",
    "rerank_scaled": f"""WITH {_F}, s AS (SELECT id, layer, coalesce(importance, 0) AS score FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY score DESC, id) AS place FROM s),
q AS (SELECT *, min(score) FILTER (place <= 50) OVER (PARTITION BY layer) AS lo, max(score) FILTER (place <= 50) OVER (PARTITION BY layer) AS hi FROM p)
SELECT id, layer, round(CASE WHEN place > 50 THEN least(score, 0.0) WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 9) AS scaled FROM q""",
    "memory_browse": f"""WITH m AS (SELECT id, 'fragment' AS kind, layer, scope, content AS text, updated_at AS row_time FROM (SELECT * FROM temporal_fragments {_ONE})
UNION ALL SELECT id, 'triple', 'L2', scope, concat_ws(' ', subject_id, predicate, coalesce(CASE WHEN length(object_id) > 0 THEN object_id END, object_value, '?')), valid_from FROM (SELECT * FROM triples {_ONE})
UNION ALL SELECT id, 'entity', 'L1', scope, name, valid_from FROM (SELECT * FROM entities {_ONE}))
SELECT id, kind, layer, text FROM m WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%index%' AND {_MINE} ORDER BY row_time DESC NULLS LAST, id LIMIT 100""",
    "hit_rates": f"""WITH {_F}, gold AS (SELECT DISTINCT scope AS q, location_id AS k, layer FROM f WHERE location_id IS NOT NULL AND importance > 0.9),
found AS (SELECT scope AS q, location_id AS k, row_number() OVER (PARTITION BY scope ORDER BY importance DESC NULLS LAST, id) AS rank FROM f WHERE location_id IS NOT NULL),
each AS (SELECT q, layer, max(CASE WHEN (q, k) IN (SELECT (q, k) FROM found WHERE rank <= 5) THEN 1 ELSE 0 END) AS hit FROM gold GROUP BY q, layer)
SELECT * FROM (SELECT layer, count(*) AS n, sum(hit)::BIGINT AS hits, avg(hit) AS rate FROM each GROUP BY layer) JOIN (SELECT layer, quantile_disc(importance, 0.5) AS p50, quantile_disc(importance, 0.99) AS p99 FROM f GROUP BY layer) USING (layer)""",
    "hit_cutoffs": f"""WITH {_F}, gold AS (SELECT DISTINCT scope AS q, location_id AS k, layer FROM f WHERE location_id IS NOT NULL AND importance > 0.9),
best AS (SELECT q, k, min(rank) AS rank FROM (SELECT scope AS q, location_id AS k, row_number() OVER (PARTITION BY scope ORDER BY importance DESC NULLS LAST, id) AS rank FROM f WHERE location_id IS NOT NULL) GROUP BY q, k),
each AS (SELECT gold.q, layer, min(rank) AS rank FROM gold LEFT JOIN best ON best.q = gold.q AND best.k = gold.k GROUP BY gold.q, layer)
SELECT layer, count(*) AS n, {", ".join(f"avg(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) AS hit_{k}" for k in (1, 3, 20))} FROM each GROUP BY layer""",
}
