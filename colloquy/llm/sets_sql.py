"""DuckDB SQL of the queries that link documents by their sets of word runs."""


def linked(threshold: int, kept: str = "") -> str:
    """Components of documents whose sets reach the threshold, in per cent."""
    return f"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM split
), keyed AS (
  SELECT r, doc_id, s, len(s) AS n, md5(array_to_string(s, chr(10))) AS node FROM sets
), nodes AS (
  SELECT node, any_value(s) AS s, any_value(n) AS n FROM keyed WHERE n > 0 GROUP BY node
), tokens AS (
  SELECT node, n, unnest(s) AS token FROM nodes
), links AS (
  SELECT a.node AS a, b.node AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {threshold} * (a.n + b.n - count(*))
), reached AS (
  SELECT node AS a, node AS b FROM nodes
  UNION
  SELECT reached.a, x.b FROM reached JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) x ON reached.b = x.a
), least AS (
  SELECT reached.a AS node, min(keyed.doc_id) AS component_id FROM reached JOIN keyed ON keyed.node = reached.b AND keyed.n > 0 GROUP BY reached.a
)
SELECT k.doc_id, k.n AS n_shingles, CASE WHEN k.n > 0 THEN l.component_id ELSE k.doc_id END AS component_id{kept}
FROM keyed k LEFT JOIN least l ON l.node = k.node AND k.n > 0
"""


OP5 = linked(75, ", k.doc_id IS NOT DISTINCT FROM (CASE WHEN k.n > 0 THEN l.component_id ELSE k.doc_id END) AS kept")
OP12 = linked(80)
