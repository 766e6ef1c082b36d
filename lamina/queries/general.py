"""Queries of the general data-preparation operators (problems 1 to 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.operators import compact, drift, faulty_rows, sessions
from lamina.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return faulty_rows.faulty_rows(table(spark, d, "raw_rows"))


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return faulty_rows.readable_rows(table(spark, d, "raw_rows"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.file_changes(table(spark, d, "feed_lines"))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "feed_lines"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = sessions.sessionize(table(spark, d, "event_log"), "user_id", "timestamp", "event_id")
    return found.select("user_id", "start_us", "end_us", "n_events")


def p3_by_type(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessionize(table(spark, d, "event_log"), "user_id", "timestamp", "event_id", "event_type")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return compact.redundant_rows(table(spark, d, "tiny_rows"))


def p4_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The records of the few files that came out, with the place of the row that each was taken from."""
    return compact.compact(table(spark, d, "tiny_rows")).destination.drop("file_no")


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p2_found, p2_table, p3_found, p3_by_type, p4_found, p4_compacted)}

_Q = '"[^"]*(?:""[^"]*)*"'
_F = f'(?:{_Q}|(?:[^",][^,]*)?)'
_NUM = "[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?"
_TYPED = """
lines AS (SELECT row_id, regexp_replace(line, '\\r$', '') AS b FROM raw_rows),
cells AS (SELECT row_id, b, regexp_full_match(b, '(?s){F}(?:,{F})*') AS quoted, regexp_full_match(b, '(?s){F}(?:,{F}){{4}}') AS five,
  list_transform(regexp_extract_all(',' || b, '(?s),({F})', 1), lambda c: CASE WHEN c[1] = '"' THEN replace(c[2:-2], '""', '"') ELSE c END) AS c FROM lines),
judged AS (SELECT row_id, c, CASE WHEN b IS NULL THEN 'column_count' WHEN NOT quoted THEN 'quoting' WHEN NOT five THEN 'column_count'
  WHEN NOT regexp_full_match(trim(c[1], ' '), '[0-9]{{1,18}}') THEN 'event_id'
  WHEN NOT regexp_full_match(trim(c[2], ' '), '[0-9]{{1,9}}') THEN 'org_id'
  WHEN NOT (trim(c[3], ' ') = '' OR (regexp_full_match(trim(c[3], ' '), '{N}') AND coalesce(isfinite(try_cast(trim(c[3], ' ') AS DOUBLE)), false))) THEN 'score' END AS reason FROM cells)
""".replace("{F}", _F).replace("{N}", _NUM).replace("{{", "{").replace("}}", "}")
_EVENTS = """
ev AS (SELECT DISTINCT user_id, epoch_us("timestamp") AS t, event_id, event_type FROM event_log
  WHERE "timestamp" IS NOT NULL AND user_id IS NOT NULL AND regexp_replace(user_id, '\\s', '', 'g') <> ''),
marked AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 1800000000 THEN 0 ELSE 1 END AS s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)),
numbered AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM marked),
spans AS (SELECT user_id, k, min(t) AS start_us, max(t) AS end_us, count(*) AS n_events FROM numbered GROUP BY ALL)
"""
_RECORDS = """
parsed AS (SELECT file_id, row_no, event_id, org_id, payload,
  json_extract(payload, '$.score')::VARCHAR AS score, payload->>'$.profile.name' AS name, payload->>'$.profile.tier' AS tier,
  json_extract(payload, '$.scores')::VARCHAR AS scores, json_extract(payload, '$.amount')::VARCHAR AS amount,
  json_type(payload, '$.profile') AS kind FROM tiny_rows),
keyed AS (SELECT *, coalesce(try_cast(score AS DOUBLE)::VARCHAR, nullif(score, 'null')) AS s, coalesce(try_cast(amount AS DOUBLE)::VARCHAR, nullif(amount, 'null')) AS a,
  coalesce(try_cast(nullif(scores, 'null') AS DOUBLE[])::VARCHAR, nullif(scores, 'null')) AS l, nullif(kind, 'NULL') AS k FROM parsed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id, org_id, payload IS NULL, s, name, tier, l, a, k ORDER BY file_id, row_no) AS n,
  count(*) OVER (PARTITION BY event_id, org_id, payload IS NULL, s, name, tier, l, a, k) AS copies FROM keyed)
"""
_CHANGES = r"""
WITH lines AS (SELECT feed, file_no, line, row_number() OVER () AS r FROM feed_lines WHERE json_valid(line) AND json_type(line) = 'OBJECT'),
nodes AS (SELECT l.feed, l.file_no, l.r, replace(substr(t.fullkey, 3), '"', '') AS p, replace(substr(t.path, 3), '"', '') AS up, t.type AS kind, t.value::VARCHAR AS v
  FROM lines l, json_tree(l.line) t WHERE t.type <> 'NULL' AND t.fullkey NOT IN ('$', '$.event_id', '$.org_id')),
typed AS (SELECT *, CASE kind WHEN 'OBJECT' THEN 'Struct' WHEN 'ARRAY' THEN 'List' WHEN 'BOOLEAN' THEN 'Boolean' WHEN 'VARCHAR' THEN 'Utf8' WHEN 'DOUBLE' THEN 'Float64' ELSE 'Int64' END AS k FROM nodes),
kinds AS (SELECT feed, file_no, p, up, list_sort(list(DISTINCT k)) AS ks FROM typed WHERE p NOT LIKE '%[%' GROUP BY ALL),
elements AS (SELECT feed, file_no, up AS p, list_sort(list(DISTINCT k)) AS ks FROM typed WHERE p LIKE '%]' GROUP BY ALL),
named AS (SELECT h.feed, h.file_no, h.p, h.up, h.ks, e.ks AS es FROM kinds h LEFT JOIN elements e USING (feed, file_no, p)),
heads AS (SELECT feed, file_no, p, up, CASE WHEN ks = ['List'] THEN 'List<' || CASE WHEN es IS NULL THEN '?' WHEN len(es) = 1 THEN es[1] WHEN es = ['Float64', 'Int64'] THEN 'Float64' ELSE 'Utf8' END || '>'
  WHEN len(ks) = 1 THEN ks[1] WHEN ks = ['Float64', 'Int64'] THEN 'Float64' ELSE 'Utf8' END AS t FROM named),
files AS (SELECT feed, file_no, lag(file_no) OVER (PARTITION BY feed ORDER BY file_no) AS before FROM (SELECT DISTINCT feed, file_no FROM feed_lines)),
steps AS (SELECT * FROM files WHERE before IS NOT NULL),
old AS (SELECT s.feed, s.file_no, h.p, h.up, h.t FROM steps s JOIN heads h ON h.feed = s.feed AND h.file_no = s.before),
new AS (SELECT s.feed, s.file_no, h.p, h.up, h.t FROM steps s JOIN heads h USING (feed, file_no)),
paired AS (SELECT feed, file_no, coalesce(old.p, new.p) AS p, coalesce(old.up, new.up) AS up, old.t AS a, new.t AS b FROM old FULL JOIN new USING (feed, file_no, p)),
kept AS (SELECT c.* FROM paired c LEFT JOIN paired u ON u.feed = c.feed AND u.file_no = c.file_no AND u.p = c.up LEFT JOIN paired g ON g.feed = c.feed AND g.file_no = c.file_no AND g.p = u.up
  WHERE (c.up = '' OR (u.a = 'Struct' AND u.b = 'Struct')) AND (coalesce(u.up, '') = '' OR (g.a = 'Struct' AND g.b = 'Struct'))),
changed AS (SELECT feed, file_no, CASE WHEN b IS NULL THEN 'removed' WHEN a IS NULL THEN 'added' ELSE 'retyped' END AS kind, p, up, coalesce(a, b) AS t FROM kept
  WHERE a IS NULL OR b IS NULL OR (a <> b AND NOT (a LIKE 'List<%' AND b LIKE 'List<%' AND 'List<?>' IN (a, b)))),
pairs AS (SELECT o.feed, o.file_no, o.p, n.p AS q FROM changed o JOIN changed n USING (feed, file_no, up) WHERE o.kind = 'removed' AND n.kind = 'added' AND (o.t = n.t OR (o.t LIKE 'List<%' AND n.t LIKE 'List<%' AND 'List<?>' IN (o.t, n.t)))),
sent AS (SELECT t.feed, t.file_no, t.p, json_extract(l.line, '$.event_id')::VARCHAR AS e, CASE WHEN k IN ('Int64', 'Float64') THEN v::DOUBLE::VARCHAR WHEN k = 'List' THEN regexp_replace(regexp_replace(v, '\s', '', 'g'), '\.0+([,\]])', '\1', 'g') ELSE v END AS v
  FROM typed t JOIN lines l USING (r) WHERE t.p NOT LIKE '%[%' AND json_extract(l.line, '$.event_id') IS NOT NULL),
seen AS (SELECT feed, file_no, p, e, min(v) AS lo, max(v) AS hi FROM sent GROUP BY ALL),
met AS (SELECT x.feed, x.file_no, x.p, x.q, count(*) AS n, bool_and(a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo) AS same FROM pairs x JOIN steps s USING (feed, file_no)
  JOIN seen a ON a.feed = x.feed AND a.file_no = s.before AND a.p = x.p JOIN seen b ON b.feed = x.feed AND b.file_no = x.file_no AND b.p = x.q AND b.e = a.e GROUP BY ALL),
fit AS (SELECT *, row_number() OVER (PARTITION BY feed, file_no, p ORDER BY n DESC, q) AS i, row_number() OVER (PARTITION BY feed, file_no, q ORDER BY n DESC, p) AS j FROM met WHERE n >= 2 AND same),
moved AS (SELECT feed, file_no, p, q FROM fit WHERE i = 1 AND j = 1)
SELECT feed, file_no, 'renamed' AS change_kind, 'payload.' || p AS field_path, 'payload.' || q AS new_path FROM moved
UNION ALL SELECT c.feed, c.file_no, kind, 'payload.' || p, '' FROM changed c WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.feed = c.feed AND m.file_no = c.file_no AND ((kind = 'removed' AND m.p = c.p) OR (kind = 'added' AND m.q = c.p)))
"""
SQL = {
    "p2_found": _CHANGES,
    "p1_found": f"WITH {_TYPED} SELECT row_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_loaded": f"WITH {_TYPED} SELECT row_id, trim(c[1], ' ')::BIGINT AS event_id, trim(c[2], ' ')::INTEGER AS org_id, try_cast(nullif(trim(c[3], ' '), '') AS DOUBLE) AS score, c[4] AS name, try_cast(nullif(trim(c[5], ' '), '') AS INTEGER) AS age FROM judged WHERE reason IS NULL",
    "p3_found": f"WITH {_EVENTS} SELECT user_id, start_us, end_us, n_events FROM spans",
    "p3_by_type": f"WITH {_EVENTS} SELECT n.user_id, start_us, end_us, end_us - start_us AS duration_us, event_type, count(*) AS n_events FROM numbered n JOIN spans s ON n.user_id = s.user_id AND n.k = s.k GROUP BY ALL",
    "p4_compacted": f"WITH {_RECORDS} SELECT file_id, row_no, event_id, org_id, payload, copies FROM ranked WHERE n = 1",
    "p4_found": f"WITH {_RECORDS} SELECT file_id, row_no FROM ranked WHERE n > 1",
}
