"""The queries that SQL can express, for comparison in DuckDB."""

_GROUPS = """
records AS (
  SELECT id, any_value(scope) AS scope, any_value(layer) AS layer, any_value(importance) AS importance, any_value(created_at) AS created_at, any_value(time_start) AS time_start, any_value(entities) AS entities,
    any_value((time_start IS NOT NULL)::INT + (time_end IS NOT NULL)::INT + coalesce(regexp_matches(location_id, '\\S'), false)::INT + coalesce(len(entities) > 0, false)::INT) AS filled,
    any_value(nullif(lower(regexp_replace(fragment_id, '^\\s+|\\s+$', '', 'g')), '')) AS f, any_value(nullif(replace(regexp_replace(lower(content), '[^\\p{L}\\p{N}]+', '', 'g'), 'ß', 'ss'), '')) AS c
  FROM temporal_fragments WHERE id IS NOT NULL GROUP BY id),
links AS (
  SELECT a.id AS a, b.id AS b FROM records a JOIN records b ON a.scope IS NOT DISTINCT FROM b.scope AND a.layer IS NOT DISTINCT FROM b.layer AND a.f = b.f
  UNION SELECT a.id, b.id FROM records a JOIN records b ON a.scope IS NOT DISTINCT FROM b.scope AND a.layer IS NOT DISTINCT FROM b.layer AND a.c = b.c),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
groups AS (SELECT r.*, g FROM records r JOIN (SELECT a AS id, min(b) AS g, count(*) AS n FROM reach GROUP BY a) USING (id) WHERE n > 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY filled DESC, importance DESC NULLS LAST, created_at DESC NULLS LAST, id) AS place FROM groups)
"""

_KEY = "nullif(lower(regexp_replace(source, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), '')"
_MIX = f"""d AS (SELECT doc_id, n_chars AS size, {_KEY} AS source FROM documents WHERE doc_id IS NOT NULL), total AS (SELECT coalesce(sum(size), 0) AS total FROM d),
usable AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('9|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d WHERE size > 0 AND source IS NOT NULL),
given AS (SELECT source, sum(size) AS available FROM usable GROUP BY source),
t AS (SELECT mix_name AS mix, {_KEY} AS source, sum(CASE WHEN target_weight > 0 AND target_weight < 'Infinity' THEN target_weight ELSE 0 END) AS weight, max(greatest(coalesce(max_repeats, 1), 0)) AS top, max(size_ratio) AS ratio FROM mix_targets GROUP BY 1, 2),
m AS (SELECT mix, sum(weight) AS weights, max(ratio) AS ratio FROM t GROUP BY mix),
p AS (SELECT t.mix, t.source, top, coalesce(available, 0) AS available, coalesce(weight / nullif(weights, 0), 0) AS share, share * greatest(coalesce(m.ratio, 0), 0) * total AS target, least(target, top * coalesce(available, 0)) AS reach, coalesce(floor(reach / nullif(available, 0)), 0)::BIGINT AS whole, reach - whole * coalesce(available, 0) AS rest
  FROM t JOIN m USING (mix) LEFT JOIN given ON given.source = t.source, total),
chosen AS (SELECT mix, doc_id, u.source, size AS n_chars, whole + (rest > 0 AND before + size / 2 <= rest)::BIGINT AS copies FROM usable u JOIN p ON p.source = u.source WHERE copies > 0)"""

SQL = {
    "p9_mix_by_length": f"WITH {_MIX} SELECT * FROM chosen",
    "p9_shares_by_length": f"""WITH {_MIX}, g AS (SELECT mix, source, count(*) AS n_docs, max(copies) AS most_copies, sum(n_chars * copies)::BIGINT AS reached FROM chosen GROUP BY mix, source), s AS (SELECT mix, sum(reached) AS size FROM g GROUP BY mix)
SELECT p.mix, p.source, round(share, 9) AS target_share, available::BIGINT AS available, coalesce(n_docs, 0) AS n_docs, coalesce(most_copies, 0) AS most_copies, coalesce(reached, 0)::BIGINT AS reached_size, round(coalesce(reached / nullif(size, 0), 0), 9) AS reached_share FROM p LEFT JOIN g ON g.mix = p.mix AND g.source = p.source LEFT JOIN s ON s.mix = p.mix""",
    "p5_found": f"WITH RECURSIVE {_GROUPS} SELECT id FROM ranked WHERE place = 1",
    "p5_golden": f"""WITH RECURSIVE {_GROUPS} SELECT arg_min(id, place) AS id, epoch_us(max(created_at)) AS created_us, max(importance) AS importance,
  epoch_us(arg_min(time_start, place) FILTER (time_start IS NOT NULL)) AS start_us, array_to_string(arg_min(entities, place) FILTER (len(entities) > 0), ',') AS entities FROM ranked GROUP BY g""",
}
