"""DuckDB twin of ``op10_mixing``: plain windows over whole leaves."""


def _share(name: str, parent: str, own: list[str], weight: str) -> str:
    on = f"USING ({', '.join(own[:-1])})" if own[:-1] else "ON true"
    by = f"PARTITION BY {', '.join(own[:-1])}" if own[:-1] else ""
    return f"""
{name}_c AS (SELECT {', '.join(own)}, sum(tokens) * 2 AS capacity, {weight} AS weight FROM leaves GROUP BY ALL HAVING sum(tokens) > 0),
{name}_r AS (
  SELECT c.*, p.budget, capacity / weight AS ratio,
    (p.budget - coalesce(sum(capacity) OVER ({by} ORDER BY capacity / weight, {', '.join(own)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER ({by} ORDER BY capacity / weight, {', '.join(own)} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM {name}_c c JOIN {parent} p {on}),
{name} AS (
  SELECT {', '.join(own)}, coalesce(least(capacity::DOUBLE, weight * max(CASE WHEN rate < ratio THEN rate END) OVER ({by})), capacity::DOUBLE) AS budget
  FROM {name}_r)"""


OP10 = rf"""
WITH base AS (
  SELECT doc_id, substr(md5(coalesce(source, 'unknown')), 1, 1) AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM base GROUP BY ALL),
root AS (SELECT floor(coalesce(sum(tokens), 0) * 0.5)::DOUBLE AS budget FROM leaves),
{_share('d', 'root', ['domain'], '1.0::DOUBLE')},
{_share('l', 'd', ['domain', 'lang'], "(CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END)::DOUBLE")},
{_share('s', 'l', ['domain', 'lang', 'source'], "(CASE source WHEN 'src0' THEN 0.5 ELSE 1.0 END)::DOUBLE")},
plan AS (
  SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS epochs, quota - CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END * tokens AS rest
  FROM (SELECT leaves.*, floor(coalesce(budget, 0.0) + 0.001)::BIGINT AS quota FROM leaves LEFT JOIN s USING (domain, lang, source))),
keyed AS (SELECT base.*, epochs, rest, md5('17:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS k FROM base JOIN plan USING (domain, lang, source)),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, e::INTEGER AS epoch, n_tokens,
  CASE WHEN e = epochs AND upto > rest THEN rest - (upto - n_tokens) ELSE n_tokens END::BIGINT AS taken_tokens
FROM placed, LATERAL (SELECT unnest(range(0, epochs + 1)) AS e)
WHERE e < epochs OR (rest > 0 AND upto - n_tokens < rest)
"""
