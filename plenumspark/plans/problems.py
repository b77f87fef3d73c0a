"""Queries of the general training-data operators (problems 1, 3, 5 and 6) over whole tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenumspark.functions.wallclock import wall_micros
from plenumspark.operators.asof import known_at
from plenumspark.operators.drift import schema_changes, union_schema, union_table, union_values
from plenumspark.operators.intervals import day_unit, periods_and_gaps, unit_day
from plenumspark.operators.orphans import orphans
from plenumspark.operators.persons import names_somebody, resolve
from plenumspark.session import checkpointed, table


def _attributed(spark: SparkSession, d: str) -> DataFrame:
    """(u_id, person_party_id): each segment that has a party row in force and known at its year's start."""
    person = table(spark, d, "person").select("person_id", "wiki_id")
    events = table(spark, d, "protocol_segments").select("u_id", "who", "year").where(F.col("year").isNotNull() & names_somebody(F.col("who")))
    party = resolve(table(spark, d, "person_party").select("person_party_id", "person_id", "start_date", "end_date", "recorded_at"), "person_id", person)
    # One row per distinct speaker and year goes through the lookup; segments are touched twice, for the keys and at the end.
    keys = checkpointed(resolve(events.select("who", "year").distinct(), "who", person)).withColumn("at", F.make_date(F.col("year"), F.lit(1), F.lit(1)))
    found = known_at(keys, party, event_entity="person_key", event_time="at", entity="person_key", start="start_date", end="end_date", known="recorded_at", row_key="person_party_id")
    keys = keys.join(found, (keys["person_key"] == found["entity"]) & (wall_micros(keys["at"]) == found["event_micros"])).select("who", "year", F.col("row_key").alias("person_party_id"))
    return events.join(keys, ["who", "year"]).select("u_id", "person_party_id").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _attributed(spark, d)


def p1_segment_party(spark: SparkSession, d: str) -> DataFrame:
    """Every segment once with the party known at its year's start, null where there is none."""
    party = table(spark, d, "person_party").select("person_party_id", "party_id").distinct()
    found = _attributed(spark, d).join(party, "person_party_id").select("u_id", "party_id")
    return table(spark, d, "protocol_segments").select("u_id").distinct().join(found, "u_id", "left")


def _references(spark: SparkSession, d: str) -> DataFrame:
    person = table(spark, d, "person").select("person_id", "wiki_id")
    parts = None
    for name, key in (("persons_of_interest", "pid"), ("person_party", "person_party_id"), ("terms_of_office", "terms_of_office_id")):
        part = table(spark, d, name).select(F.lit(name).alias("child_table"), F.col(key).alias("child_key"), "person_id", F.col("recorded_at").alias("at"))
        parts = part if parts is None else parts.unionByName(part)
    return resolve(parts, "person_id", person, "ref")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "person").select(F.col("person_id").alias("key"), "recorded_at", "deleted_at")
    return orphans(_references(spark, d), parents)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, period and reason."""
    return p3_found(spark, d).groupBy("child_table", "period", "reason").agg(F.count("*").alias("n_orphans"))


def _spans(spark: SparkSession, d: str, name: str) -> DataFrame:
    person = table(spark, d, "person").select("person_id", "wiki_id")
    if name == "terms_of_office":
        rows = table(spark, d, name).select("person_id", day_unit(F.col("start_date")).alias("first"), day_unit(F.coalesce("end_date", F.lit("9999-12-31").cast("date"))).alias("last"))
    else:
        rows = table(spark, d, name).select("person_id", F.col("start_year").cast("long").alias("first"), F.coalesce("end_year", F.lit(9999)).cast("long").alias("last"))
    rows = resolve(rows.where("first IS NOT NULL AND first <= last").distinct(), "person_id", person, "entity")
    return periods_and_gaps(rows.select("entity", "first", "last"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    days, years = _spans(spark, d, "terms_of_office"), _spans(spark, d, "person_party")
    as_rows = lambda df, name, text: df.select(F.lit(name).alias("interval_table"), F.col("entity").alias("person_id"), "span_kind", text(F.col("first")).alias("from_key"), text(F.col("last")).alias("to_key"))
    return as_rows(days, "terms_of_office", unit_day).unionByName(as_rows(years, "person_party", lambda c: c.cast("string")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(table(spark, d, "metadata_records"))


def p6_person(spark: SparkSession, d: str) -> DataFrame:
    return union_table(table(spark, d, "metadata_records"), "person")


def p6_document_index(spark: SparkSession, d: str) -> DataFrame:
    return union_table(table(spark, d, "metadata_records"), "document_index")


def p6_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of both tables, the field each began as, and its type."""
    records = table(spark, d, "metadata_records")
    return union_schema(records, "person").unionByName(union_schema(records, "document_index"))


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """All values of both tables, one row each."""
    records = table(spark, d, "metadata_records")
    return union_values(records, "person").unionByName(union_values(records, "document_index"))


QUERIES = {q.__name__: q for q in (p1_found, p1_segment_party, p3_found, p3_report, p5_found, p6_found, p6_person, p6_document_index, p6_columns, p6_values)}

_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]+"


def _trim(ref: str) -> str:
    return f"regexp_replace({ref}, '^{_WS}|{_WS}$', '', 'g')"


def _key(ref: str) -> str:
    t = _trim(ref)
    return f"coalesce((SELECT min(w.person_id) FROM person w WHERE w.wiki_id = {t}), {t})"


def _named(ref: str) -> str:
    t = _trim(ref)
    return f"({t} <> '' AND lower({t}) <> 'unknown')"


_P1 = f"""
WITH pp AS (SELECT DISTINCT person_party_id, {_key('p.person_id')} AS k, start_date, end_date, recorded_at FROM person_party p WHERE {_named('p.person_id')}),
ev AS (SELECT who, year, {_key('e.who')} AS k, make_date(year, 1, 1) AS t FROM (SELECT DISTINCT who, year FROM protocol_segments WHERE year IS NOT NULL AND {_named('who')}) e),
hit AS (SELECT ev.who, ev.year, arg_max(pp.person_party_id, (pp.start_date, pp.recorded_at, pp.person_party_id)) AS person_party_id
  FROM ev JOIN pp ON ev.k = pp.k AND pp.start_date <= ev.t AND (pp.end_date IS NULL OR pp.end_date >= ev.t) AND pp.recorded_at <= ev.t GROUP BY 1, 2),
found AS (SELECT DISTINCT s.u_id, hit.person_party_id FROM protocol_segments s JOIN hit ON s.who = hit.who AND s.year = hit.year)
"""
_P3 = f"""
WITH child AS (
  SELECT 'persons_of_interest' AS child_table, pid AS child_key, person_id, recorded_at FROM persons_of_interest
  UNION SELECT 'person_party', person_party_id, person_id, recorded_at FROM person_party
  UNION SELECT 'terms_of_office', terms_of_office_id, person_id, recorded_at FROM terms_of_office),
c AS (SELECT child_table, child_key, {_key('x.person_id')} AS k, recorded_at AS r FROM child x WHERE {_named('x.person_id')}),
j AS (SELECT c.child_table, c.child_key, c.r, count(p.person_id) AS n, coalesce(bool_or(p.recorded_at <= c.r AND (p.deleted_at IS NULL OR p.deleted_at > c.r)), false) AS live,
  coalesce(bool_and(p.recorded_at > c.r), false) AS late FROM c LEFT JOIN person p ON p.person_id = c.k GROUP BY 1, 2, 3),
found AS (SELECT child_table, child_key, CAST(year(r) AS INTEGER) AS period, CASE WHEN n = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END AS reason FROM j WHERE NOT live)
"""


def _islands(table_name: str, first: str, last: str, one: str, back: str) -> str:
    return f"""
SELECT '{table_name}' AS interval_table, k AS person_id, kind AS span_kind, {back.format('a')} AS from_key, {back.format('b')} AS to_key FROM (
  WITH s AS (SELECT DISTINCT {_key('t.person_id')} AS k, {first} AS a, {last} AS b FROM {table_name} t WHERE {_named('t.person_id')} AND {first} IS NOT NULL AND {first} <= {last}),
  m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + {one} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS no FROM m),
  p AS (SELECT k, no, min(a) AS a, max(b) AS b FROM g GROUP BY 1, 2),
  n AS (SELECT *, lead(a) OVER (PARTITION BY k ORDER BY no) AS nxt FROM p)
  SELECT k, 'period' AS kind, a, b FROM n UNION ALL SELECT k, 'gap', b + {one}, nxt - {one} FROM n WHERE nxt IS NOT NULL)"""


_P6 = """
WITH RECURSIVE r AS (SELECT DISTINCT series_no, file_no, file_id, record_key, payload FROM metadata_records),
f AS (SELECT file_id, lag(file_id) OVER (PARTITION BY series_no ORDER BY file_no, file_id) AS prev_id FROM (SELECT DISTINCT series_no, file_no, file_id FROM r)),
k AS (SELECT file_id, record_key, payload, unnest(json_keys(payload)) AS field FROM r),
v AS (SELECT file_id, record_key, field, json_type(payload, '$."' || field || '"') AS t, json_extract_string(payload, '$."' || field || '"') AS x FROM k),
h AS (SELECT file_id, field, bit_or(CASE t WHEN 'NULL' THEN 0 WHEN 'UBIGINT' THEN 1 WHEN 'BIGINT' THEN 1 WHEN 'DOUBLE' THEN 2 WHEN 'BOOLEAN' THEN 4 WHEN 'VARCHAR' THEN 8 WHEN 'ARRAY' THEN 16 ELSE 32 END) AS bits FROM v GROUP BY 1, 2),
p AS (SELECT file_id, field, CASE WHEN bits = 0 THEN NULL WHEN bits IN (1, 2, 4, 8, 16, 32) THEN bits WHEN bits = 3 THEN 2 ELSE 8 END AS t FROM h),
gone AS (SELECT f.file_id, f.prev_id, b.field FROM f JOIN p b ON b.file_id = f.prev_id WHERE NOT EXISTS (SELECT 1 FROM p a WHERE a.file_id = f.file_id AND a.field = b.field)),
come AS (SELECT f.file_id, f.prev_id, a.field FROM f JOIN p a ON a.file_id = f.file_id WHERE f.prev_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p b WHERE b.file_id = f.prev_id AND b.field = a.field)),
m AS (SELECT g.file_id, g.field AS old, c.field AS new, count(*) AS n, count(*) FILTER (WHERE o.x = w.x) AS same
  FROM gone g JOIN come c ON c.file_id = g.file_id JOIN r rb ON rb.file_id = g.prev_id JOIN r ra ON ra.file_id = g.file_id AND ra.record_key = rb.record_key
  LEFT JOIN v o ON o.file_id = g.prev_id AND o.record_key = rb.record_key AND o.field = g.field AND o.t <> 'NULL'
  LEFT JOIN v w ON w.file_id = g.file_id AND w.record_key = ra.record_key AND w.field = c.field AND w.t <> 'NULL'
  WHERE o.x IS NOT NULL OR w.x IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY file_id, old ORDER BY same / n DESC, n DESC, new) AS i, row_number() OVER (PARTITION BY file_id, new ORDER BY same / n DESC, n DESC, old) AS j FROM m WHERE same >= 0.8 * n),
ren AS (SELECT file_id, old, new FROM b WHERE i = 1 AND j = 1)
"""
_P6_UNION = _P6.rstrip() + """,
edge AS (SELECT f.file_id, p.field, b.file_id AS prev_id, b.field AS old FROM f JOIN p ON p.file_id = f.file_id
  LEFT JOIN ren ON ren.file_id = f.file_id AND ren.new = p.field LEFT JOIN p b ON b.file_id = f.prev_id AND b.field = coalesce(ren.old, p.field)),
line AS (SELECT file_id, field, field AS name FROM edge WHERE old IS NULL
  UNION ALL SELECT e.file_id, e.field, l.name FROM line l JOIN edge e ON e.prev_id = l.file_id AND e.old = l.field),
typed AS (SELECT t.table_name, l.name, bit_or(h.bits) AS bits, min(t.file_no * 1000000 + t.series_no) AS since FROM line l JOIN h ON h.file_id = l.file_id AND h.field = l.field
  JOIN (SELECT DISTINCT table_name, file_id, file_no, series_no FROM metadata_records) t ON t.file_id = l.file_id GROUP BY 1, 2),
named AS (SELECT *, row_number() OVER (PARTITION BY table_name, lower(name) ORDER BY since, name) AS no FROM typed),
cols AS (SELECT table_name, name, CASE WHEN lower(name) IN ('series_no', 'file_no', 'file_id', 'record_key') THEN name || '_' WHEN no = 1 THEN name ELSE name || '_' || no END AS column_name,
  CASE bits WHEN 0 THEN 'string' WHEN 1 THEN 'whole' WHEN 2 THEN 'fractional' WHEN 3 THEN 'fractional' WHEN 4 THEN 'boolean' WHEN 16 THEN 'array' WHEN 32 THEN 'object' ELSE 'string' END AS type FROM named)
"""

SQL = {
    "p1_found": _P1 + "SELECT * FROM found",
    "p1_segment_party": _P1 + "SELECT s.u_id, x.party_id FROM (SELECT DISTINCT u_id FROM protocol_segments) s LEFT JOIN (SELECT f.u_id, p.party_id FROM found f JOIN (SELECT DISTINCT person_party_id, party_id FROM person_party) p USING (person_party_id)) x USING (u_id)",
    "p3_found": _P3 + "SELECT * FROM found",
    "p3_report": _P3 + "SELECT child_table, period, reason, count(*) AS n_orphans FROM found GROUP BY ALL",
    "p5_found": _islands("terms_of_office", "(t.start_date - DATE '0001-01-01')", "(coalesce(t.end_date, DATE '9999-12-31') - DATE '0001-01-01')", "1", "strftime(DATE '0001-01-01' + CAST({0} AS INTEGER), '%Y-%m-%d')")
    + " UNION ALL " + _islands("person_party", "t.start_year", "coalesce(t.end_year, 9999)", "1", "CAST({0} AS VARCHAR)"),
    "p6_found": _P6 + """
SELECT file_id, 'renamed' AS change_kind, old AS field_name, new AS new_name FROM ren
UNION ALL SELECT file_id, 'removed', field, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_id = g.file_id AND ren.old = g.field)
UNION ALL SELECT file_id, 'added', field, '' FROM come c WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_id = c.file_id AND ren.new = c.field)
UNION ALL SELECT f.file_id, 'retyped', a.field, '' FROM f JOIN p a ON a.file_id = f.file_id JOIN p b ON b.file_id = f.prev_id AND b.field = a.field WHERE a.t <> b.t
""",
    "p6_columns": _P6_UNION + "SELECT table_name, column_name, name AS field_name, type FROM cols",
    "p6_values": _P6_UNION + """
SELECT c.table_name, v.file_id, v.record_key, c.column_name,
  CASE c.type WHEN 'whole' THEN CAST(TRY_CAST(v.x AS BIGINT) AS VARCHAR) WHEN 'boolean' THEN CAST(TRY_CAST(v.x AS BOOLEAN) AS VARCHAR) WHEN 'fractional' THEN NULL ELSE v.x END AS value,
  CASE c.type WHEN 'fractional' THEN TRY_CAST(v.x AS DOUBLE) END AS number
FROM v JOIN line l ON l.file_id = v.file_id AND l.field = v.field JOIN (SELECT DISTINCT file_id, table_name FROM metadata_records) t ON t.file_id = v.file_id JOIN cols c ON c.table_name = t.table_name AND c.name = l.name
WHERE v.t <> 'NULL' AND (value IS NOT NULL OR number IS NOT NULL)
""",
}
