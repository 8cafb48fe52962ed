"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import decontaminate, mixing, near_dedup, secret_scan, url_filter
from ._native import WORD

_BACK = "chr(92)"


def _escaped(column: str, marks: tuple[str, ...]) -> str:
    out = f"replace({column}, {_BACK}, {_BACK} || {_BACK})"
    for mark in marks:
        out = f"replace({out}, '{mark}', '{mark[0]}' || {_BACK} || '{mark[1:]}')"
    return out


CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, {_escaped("text", ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"))} AS body FROM t
), c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(length(body) + CASE role WHEN 'user' THEN 19 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END) AS formatted
  FROM e GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM c
"""

RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) > 2),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines
  FROM w LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 4 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines) AS kept
FROM c
"""

_ORDER = "key, doc_id, size"
MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT source, source_size, {mixing.REPEATS} * source_size AS cap, [{", ".join(map(str, mixing.WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1 AS INTEGER)] AS weight FROM s),
o AS (SELECT *, row_number() OVER w AS i, sum(cap) OVER w - cap AS capped, sum(weight) OVER () - (sum(weight) OVER w - weight) AS rest, sum(source_size) OVER () AS whole
  FROM k WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lev AS (SELECT CAST((CAST({mixing.BUDGET} AS DOUBLE) * CAST(whole AS DOUBLE) - CAST(capped AS DOUBLE)) / CAST(rest AS DOUBLE) AS DOUBLE) AS level, cap, weight, i FROM o),
pick AS (SELECT level FROM lev WHERE level * weight <= cap ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM pick) * weight) AS target FROM k),
lined AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS through FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT CAST(through + lap * source_size AS DOUBLE) / target AS time, source, key, doc_id, size FROM lined, range({mixing.REPEATS}) AS laps(lap) WHERE size > 0 AND target > 0),
run AS (SELECT time, sum(size) OVER (ORDER BY time, source NULLS LAST, {_ORDER} ROWS UNBOUNDED PRECEDING) AS total FROM copies WHERE time <= 1.0 + 1e-9),
cut AS (SELECT max(time) AS cut FROM run WHERE total <= CAST({mixing.BUDGET} AS DOUBLE) * (SELECT CAST(sum(size) AS DOUBLE) FROM d))
SELECT doc_id, size, source_size, target,
  CAST(size * ({" + ".join(f"CASE WHEN target > 0 AND CAST(through + {lap} * source_size AS DOUBLE) / target <= (SELECT cut FROM cut) THEN 1 ELSE 0 END" for lap in range(mixing.REPEATS))}) AS BIGINT) AS taken FROM lined
"""


def _matches(kind: int, pattern: str, group: int, least: int, table: str = "d") -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, {kind} AS kind, start, start + length(found[i]) AS stop FROM (
      SELECT r, found, own, i, CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (
        SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
          SELECT r, regexp_extract_all(t, '{quoted}', 0) AS found, regexp_extract_all(t, '{quoted}', {group}) AS own, string_split_regex(t, '{quoted}') AS pieces FROM {table}))) WHERE length(own[i]) >= {least}"""


_NEED = "CASE " + " ".join(f"WHEN regexp_matches(c, '{p}') THEN {bits}" for _, p, bits in secret_scan.CLASSES) + " END"
_FREE = " AND ".join([f"NOT regexp_matches(c, '{p}')" for p in secret_scan.ALLOW] + [f"NOT regexp_matches(regexp_extract(c, '{secret_scan.VALUE}', 0), '{p}')" for p in secret_scan.ALLOW_VALUE])
_W = secret_scan.WINDOW
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_matches(k, *x[1:]) for k, x in enumerate(secret_scan.BASE))}),
new AS (SELECT *, CASE WHEN start < max(stop) OVER (PARTITION BY r ORDER BY start, stop, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM base),
isle AS (SELECT r, min(start) AS a, max(stop) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY start, stop, kind ROWS UNBOUNDED PRECEDING) AS g FROM new) GROUP BY r, g),
sea AS (SELECT isle.*, t, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS past FROM isle JOIN d USING (r)),
blank AS (SELECT r, string_agg(substr(t, CAST(past + 1 AS INTEGER), CAST(a - past AS INTEGER)) || repeat(' ', b - a), '' ORDER BY a) || substr(any_value(t), CAST(max(b) + 1 AS INTEGER)) AS rest FROM sea GROUP BY r),
e AS (SELECT r, coalesce(rest, t) AS t FROM d LEFT JOIN blank USING (r)),
cand AS (SELECT c0.*, substr(t, CAST(start + 1 AS INTEGER), CAST(stop - start AS INTEGER)) AS c FROM ({_matches(len(secret_scan.BASE), f"({secret_scan.CANDIDATE})", 1, 20, "e")}) AS c0 JOIN e USING (r)),
high AS (SELECT r, kind, start, stop FROM cand WHERE {_FREE}
  AND list_max(list_transform(range(1, length(c) - {_W - 2}), lambda i: list_entropy(string_split(substr(c, CAST(i AS INTEGER), {_W}), '')))) > {_NEED}),
said AS (SELECT r, kind, start, (['assign', 'access', 'hex', 'entropy'])[kind + 1] || ':' || start || ':' || stop AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM high)),
agg AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS b, string_agg(s, ',' ORDER BY start, kind) AS a FROM said GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN agg USING (r)
"""


def _rule_case(value: int) -> str:
    out = "NULL"
    for rule in sorted(url_filter.RULES, key=lambda x: len(x[1])):
        host, slash, path = rule[1].partition("/")
        out = f"CASE WHEN (host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN '{rule[value]}' ELSE {out} END"
    return out


def _host(link: str) -> str:
    return f"translate(regexp_extract(substr({link}, strpos({link}, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _urls() -> str:
    link = "CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END"
    sql = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, html, CASE WHEN strpos(url, '://') > 0 THEN {_host("url")} ELSE '' END AS host,
  CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
q AS (SELECT *, {_rule_case(1)} AS rule, {_rule_case(0)} AS said FROM p),
seeds AS (SELECT host, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad FROM q WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, {_host(f"({link})")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?([a-z]*:?//[^"''\\s>]+)', 1)) AS link FROM p WHERE contains(html, '//'))),
parts AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM p),
chain AS (SELECT array_to_string(l[-k:], '.') AS up, array_to_string(l[-k - 1:], '.') AS down FROM (SELECT l, unnest(range(least, len(l))) AS k FROM (SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ({", ".join(f"'{x}'" for x in url_filter.SUFFIXES)}) THEN 3 ELSE 2 END AS least FROM parts) WHERE len(l) > least)),
ties AS (SELECT up AS src, down AS dst FROM chain UNION SELECT down, up FROM chain),
e AS (SELECT src, dst, sum(n) AS weight FROM (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL UNION ALL SELECT src, dst, 1 FROM ties) GROUP BY src, dst),
f AS MATERIALIZED (SELECT src, dst, CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY src) AS forth, CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY dst) AS back FROM e),
n AS (SELECT host FROM seeds UNION SELECT src FROM f UNION SELECT dst FROM f),
r0 AS MATERIALIZED (SELECT n.host, coalesce(good, 0) / greatest(1, sum(good) OVER ()) AS t0, coalesce(bad, 0) / greatest(1, sum(bad) OVER ()) AS b0, coalesce(good, 0) / greatest(1, sum(good) OVER ()) AS t, coalesce(bad, 0) / greatest(1, sum(bad) OVER ()) AS b FROM n LEFT JOIN seeds USING (host))"""
    a = url_filter.DAMPING
    for k in range(url_filter.STEPS):
        sql += f""",
r{k + 1} AS MATERIALIZED (SELECT r.host, t0, b0, {1 - a!r} * t0 + {a} * coalesce(x.t, 0) AS t, {1 - a!r} * b0 + {a} * coalesce(y.b, 0) AS b FROM r{k} r
  LEFT JOIN (SELECT dst AS host, sum(forth * t) AS t FROM f JOIN r{k} q ON f.src = q.host GROUP BY dst) x USING (host)
  LEFT JOIN (SELECT src AS host, sum(back * b) AS b FROM f JOIN r{k} q ON f.dst = q.host GROUP BY src) y USING (host))"""
    last = "ranked"
    return sql + f""",
ranked AS (SELECT host, t / coalesce(nullif(sum(t) OVER (), 0), 1) AS t, b / coalesce(nullif(sum(b) OVER (), 0), 1) AS b FROM r{url_filter.STEPS}),
bad AS (SELECT host FROM {last} WHERE b > t AND b > {url_filter.LEVEL} * (SELECT avg(b) FROM {last}))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM q"""


_LOWER_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\\x{80}-\\x{10FFFF}]+')"


def _shingled(table: str, key: str) -> str:
    """Distinct five-word shingles of each row of a table."""
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT {key}, {_LOWER_WORDS} AS w FROM {table}) WHERE len(w) >= 5)"


LEAKS = f"""
WITH d AS ({_shingled("documents", "doc_id")}),
b AS ({_shingled("benchmark", "item_id")}),
n AS (SELECT item_id, CAST(count(*) AS INTEGER) AS n_item FROM b GROUP BY item_id),
p AS (SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM p JOIN n USING (item_id) WHERE n_shared >= {decontaminate.THRESHOLD} * n_item
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, text, {_LOWER_WORDS} AS w FROM documents),
one AS (SELECT min(doc_id) AS node, w FROM w WHERE len(w) > 0 GROUP BY w),
sh AS (SELECT DISTINCT node, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT node, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM one)),
n AS (SELECT node, count(*) AS n FROM sh GROUP BY node),
e AS (SELECT a, b FROM (SELECT x.node AS a, y.node AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.node < y.node GROUP BY x.node, y.node) JOIN n p ON p.node = a JOIN n q ON q.node = b WHERE i >= {near_dedup.THRESHOLD} * (p.n + q.n - i)),
ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT node, node AS low FROM one UNION SELECT ways.b, reach.low FROM reach JOIN ways ON ways.a = reach.node WHERE reach.low < ways.b),
comp AS (SELECT node, min(low) AS class_id FROM reach GROUP BY node)
SELECT doc_id, CASE WHEN len(w) > 0 THEN class_id WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS class_id
FROM w LEFT JOIN one USING (w) LEFT JOIN comp USING (node)
"""

ORACLES = {
    "op1_near_dedup": NEAR,
    "op3_secret_scan": SECRETS,
    "op4_decontamination": LEAKS,
    "op6_chat_format": CHAT,
    "op8_url_filter": _urls(),
    "op9_mixing": MIX,
    "op10_quality_rules": RULES,
}
