"""SQL for DuckDB that gives the rows of the registered queries, where SQL can express them.

The others learn models, follow links or merge bytes, and are tested against
plain Python over small tables.
"""

from __future__ import annotations

_LINES = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM parts),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM numbered
),
frequent AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, coalesce(doc_id <> last, false) AS dropped FROM keyed LEFT JOIN frequent USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WINDOWS = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM item_words, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0
),
doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
),
grams AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM doc_words, (SELECT DISTINCT size FROM windows) AS s, unnest(range(1, len(w) - size + 2)) AS t(i)
),
hits AS (SELECT doc_id, i, grams.size, item FROM grams JOIN windows ON grams.size = windows.size AND grams.gram = windows.gram),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + size)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_CUTS = r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
numbers AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM drawn
),
cut AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
),
parts AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def _lloyd(rounds: int, k: int, dims: int, scale: int, seed: str) -> str:
    """Rounds of plain Lloyd, each two tables: the nearest centroid of each vector, and the floors of means."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS p
  FROM embeddings WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x) AND abs(CAST(x AS DOUBLE)) < 524288]) = {dims}
)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY d, p) - 1 AS INTEGER) AS cluster, p FROM (SELECT p, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS d FROM kept ORDER BY d, p LIMIT {k})
)""",
    ]
    for i in range(rounds + 1):
        apart = f"list_sum([(v.p[i] - c.p[i]) * (v.p[i] - c.p[i]) FOR i IN range(1, {dims + 1})])"
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, min(d) AS distance, arg_min(cluster, (d, cluster)) AS cluster
  FROM (SELECT v.r, v.vec_id, c.cluster, CAST({apart} AS BIGINT) AS d FROM kept AS v CROSS JOIN c{i} AS c) GROUP BY r
)""")
        if i < rounds:
            # integer division cuts towards zero, so the remainder is taken away first
            steps.append(f"""m{i} AS MATERIALIZED (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS p
  FROM (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM (SELECT a.cluster, unnest(v.p) AS x, unnest(range(1, {dims + 1})) AS pos FROM a{i} AS a JOIN kept AS v USING (r)) GROUP BY cluster, pos)
  GROUP BY cluster
),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.p, c.p) AS p FROM c{i} AS c LEFT JOIN m{i} AS m USING (cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.p, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c USING (cluster)
"""


ORACLES = {"op8_line_dedup": _LINES, "op6_decontaminate": _WINDOWS, "op11_lloyd": _lloyd(5, 40, 64, 256, "2"), "op12_fill_middle": _CUTS}
