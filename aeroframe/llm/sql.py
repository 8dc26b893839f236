"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_q = lambda text: text.replace("'", "''")

# Written for this twin alone, so that a wrong pattern of the operator shows.
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_CLIENT = r"""\b(?:[cC]lient_?[iI]d|[uU]ser(?:_?[nN]ame)?|[lL]ogin|[aA]ccount_?[iI]d)["']?\x20*[:=]\x20*["']?[0-9A-Za-z._@-]{3,}"""
_PLACE = r"""\b(?:http|https|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[0-9A-Za-z:/@._~-]+"""


def _find(name: str, pattern: str, rank: int, group: int = 0) -> str:
    return f"""
  {name}_m AS (SELECT rid, regexp_extract_all(text, '{_q(pattern)}') AS m,
    regexp_extract_all(text, '{_q(pattern)}', {group}) AS v, regexp_split_to_array(text, '{_q(pattern)}') AS b FROM docs),
  {name} AS (SELECT rid, {rank} AS rank,
    list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start,
    length(m[i]) AS len, length(v[i]) AS value FROM {name}_m, unnest(range(1, len(m) + 1)) AS t(i) WHERE len(m) > 0)"""


SECRETS = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{_find("f_assign", _ASSIGN, 0, 2)},
{_find("f_access", "AKIA[A-Z0-9]+", 1)},
{_find("f_hex", "[0-9a-f]+", 2)},
{_find("f_id", _CLIENT, 4)},
{_find("f_end", _PLACE, 5)},
parts AS (
  SELECT rid, rank, start, start + len AS stop FROM f_assign WHERE value >= 12
  UNION ALL SELECT rid, 3, start, start + len FROM f_assign WHERE value BETWEEN 6 AND 11
  UNION ALL SELECT rid, rank, start, start + len FROM f_access WHERE len >= 18
  UNION ALL SELECT rid, rank, start, start + len FROM f_hex WHERE len >= 16
  UNION ALL SELECT rid, rank, start, start + len FROM f_id
  UNION ALL SELECT rid, rank, start, start + len FROM f_end),
told AS (SELECT * FROM parts p WHERE rank < 3 OR EXISTS (SELECT 1 FROM parts o WHERE o.rid = p.rid AND abs(o.start - p.start) <= 400
  AND (CASE WHEN p.rank = 3 THEN o.rank IN (1, 4, 5) ELSE o.rank IN (0, 2, 3) END))),
named AS (SELECT *, (['assign', 'access', 'hex', 'weak_secret', 'weak_id', 'endpoint'])[rank + 1] || ':' || start || ':' || stop AS said FROM told),
per AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(said, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base, string_agg(said, ',' ORDER BY start, rank, stop) AS spans FROM named GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (rid)
"""

_ESC = "replace(replace({0}, '\\', '\\\\'), '<|', '<\\|')"
CHAT = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
sized AS (SELECT *, ceil(strlen(text) / 4)::BIGINT + 4 AS tokens,
  length('<|im_start|>') + length(replace({_ESC.format('role')}, chr(10), '<\\n')) + 1 + length({_ESC.format('text')}) + length('<|im_end|>') + 1 AS shown,
  row_number() OVER w AS rn, first(role) OVER w = 'system' AS has_system FROM said
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
summed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  first(shown) OVER (PARTITION BY conv_id ORDER BY rn) AS system_shown FROM sized),
near AS (SELECT *, (before // 384) * 2 + (tokens > 384)::INT AS win,
  coalesce(sum(CASE WHEN has_system AND rn = 1 THEN 0 ELSE shown END)
    OVER (PARTITION BY conv_id ORDER BY before RANGE BETWEEN 256 PRECEDING AND 1 PRECEDING), 0) AS history FROM summed),
opened AS (SELECT *, coalesce(lag(win) OVER (PARTITION BY conv_id ORDER BY rn) <> win, true) AS opens FROM near)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(shown + CASE WHEN opens THEN history + CASE WHEN has_system AND rn > 1 THEN system_shown ELSE 0 END ELSE 0 END)::BIGINT AS formatted_chars
FROM opened GROUP BY conv_id
"""
