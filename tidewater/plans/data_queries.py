"""Queries of the general data problems over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.operators.instants import format_mixture, instants
from tidewater.operators.orphans import orphan_counts, orphans
from tidewater.operators.snapshot_diff import change_counts, snapshot_changes
from tidewater.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "document_snapshots"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return change_counts(p1_found(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return instants(table(spark, d, "temporal_features"), table(spark, d, "dataset_metadata"))


def p3_mixture(spark: SparkSession, d: str) -> DataFrame:
    return format_mixture(table(spark, d, "temporal_features"), table(spark, d, "dataset_metadata"))


def _orphan_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "document_snapshots"), table(spark, d, "search_results"), table(spark, d, "citation_features")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(*_orphan_tables(spark, d))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(*_orphan_tables(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p3_found, p3_mixture, p6_found, p6_counts)}

_KEY = r"regexp_replace(doc_id, '^\s+|\s+$', '', 'g')"
_ABSTRACT = r"trim(regexp_replace(coalesce(abstract, ''), '[ \t\n\r\x{0b}\x{0c}\x{85}\x{a0}\x{2007}\x{202f}\x{2028}\x{2029}]+', ' ', 'g'))"

_P1 = f"""
WITH v AS (
  SELECT snapshot_id, {_KEY} AS k, arg_max({_ABSTRACT}, coalesce(delivered_at, TIMESTAMP '0001-01-01')) AS a
  FROM document_snapshots WHERE {_KEY} <> '' AND snapshot_id IS NOT NULL GROUP BY 1, 2),
s AS (SELECT snapshot_id, row_number() OVER (ORDER BY snapshot_id) AS n FROM (SELECT DISTINCT snapshot_id FROM v)),
w AS (SELECT v.*, n FROM v JOIN s USING (snapshot_id)),
found AS (
  SELECT coalesce(l.n, e.n + 1) AS n, coalesce(l.k, e.k) AS doc_id,
    CASE WHEN e.k IS NULL THEN 'added' WHEN l.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM w AS l FULL JOIN w AS e ON l.k = e.k AND l.n = e.n + 1
  WHERE e.k IS NULL OR l.k IS NULL OR l.a <> e.a)
SELECT s.snapshot_id, doc_id, change_kind FROM found JOIN s USING (n) WHERE n > 1
"""

_PRESENT = f"SELECT DISTINCT snapshot_id, {_KEY} AS doc_id FROM document_snapshots WHERE {_KEY} <> ''"
_REFS = f"""
SELECT DISTINCT 'search_results' AS ref_table, snapshot_id, {_KEY} AS doc_id FROM search_results WHERE {_KEY} <> ''
UNION SELECT DISTINCT 'citation_features', snapshot_id, {_KEY} FROM citation_features WHERE {_KEY} <> '' AND total_inbound_citations > 0
"""
_P6 = f"""
WITH p AS ({_PRESENT}), r AS ({_REFS}),
f AS (SELECT doc_id, min(snapshot_id) AS first_seen FROM p GROUP BY 1)
SELECT r.ref_table, r.snapshot_id, r.doc_id,
  CASE WHEN first_seen IS NULL THEN 'missing' WHEN first_seen < r.snapshot_id THEN 'removed' ELSE 'later' END AS reason
FROM r LEFT JOIN f USING (doc_id)
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = r.doc_id AND p.snapshot_id = r.snapshot_id)
"""
_P6_COUNTS = f"""
WITH p AS ({_PRESENT}), r AS ({_REFS}),
s AS (SELECT snapshot_id, row_number() OVER (ORDER BY snapshot_id) AS n FROM (SELECT snapshot_id FROM p UNION SELECT snapshot_id FROM r)),
q AS (SELECT r.ref_table, r.doc_id, rs.n AS born, ts.n AS n, ts.snapshot_id,
    EXISTS (SELECT 1 FROM p WHERE p.doc_id = r.doc_id AND p.snapshot_id = ts.snapshot_id) AS here
  FROM r JOIN s AS rs ON rs.snapshot_id = r.snapshot_id JOIN s AS ts ON ts.n >= rs.n),
w AS (SELECT *, lag(here) OVER (PARTITION BY ref_table, doc_id, born ORDER BY n) AS was FROM q)
SELECT ref_table, snapshot_id,
  count(*) FILTER (WHERE n = born AND NOT here) AS new_orphans,
  count(*) FILTER (WHERE n > born AND NOT was AND here) AS resolved,
  count(*) FILTER (WHERE n > born AND was AND NOT here) AS reopened,
  count(*) FILTER (WHERE NOT here) AS open_refs
FROM w GROUP BY 1, 2
"""

_REST = r"^(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?(?: ?(am|pm))? ?(z|[a-z]{3,4}|[+-]\d{2}(?::?\d{2})?)?(?:\[.*\])?$"
_READ = rf"""
WITH RECURSIVE v AS (
  SELECT 'temporal_features' AS src_table, feature_id AS row_id, 'publication_datetime' AS field_name, publication_datetime AS text, feed_zone FROM temporal_features
  UNION ALL SELECT 'temporal_features', feature_id, 'update_datetime', update_datetime, feed_zone FROM temporal_features
  UNION ALL SELECT 'dataset_metadata', load_id, 'timestamp', timestamp, feed_zone FROM dataset_metadata),
t AS (SELECT * EXCLUDE (text), lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM v WHERE text IS NOT NULL),
p AS (SELECT *,
  regexp_extract(t, '^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[t ](.+))?$', ['y', 'm', 'd', 'r']) AS iso,
  regexp_extract(t, '^(\d{{4}})(\d{{2}})(\d{{2}})(?:t(\d{{2}})(\d{{2}})(\d{{2}})(z?))?$', ['y', 'm', 'd', 'h', 'i', 's', 'z']) AS com,
  regexp_extract(t, '^(\d{{1,2}})([/.])(\d{{1,2}})[/.](\d{{4}}) (.+)$', ['a', 'sep', 'b', 'y', 'r']) AS par,
  regexp_extract(t, '^(?:[a-z]{{3}}, )?(\d{{1,2}}) ([a-z]+) (\d{{4}})(?: (.+))?$', ['d', 'm', 'y', 'r']) AS dm,
  regexp_extract(t, '^([a-z]+) (\d{{1,2}}), (\d{{4}})(?: (.+))?$', ['m', 'd', 'y', 'r']) AS md,
  regexp_extract(t, '^(\d{{4}})(?:-(\d{{2}}))?$', ['y', 'm']) AS ym FROM t),
q AS (SELECT src_table, row_id, field_name, feed_zone, t,
  CASE WHEN iso.y <> '' THEN iso.y WHEN com.y <> '' THEN com.y WHEN par.y <> '' THEN par.y WHEN dm.y <> '' THEN dm.y WHEN md.y <> '' THEN md.y ELSE ym.y END AS y,
  CASE WHEN iso.y <> '' THEN iso.m WHEN com.y <> '' THEN com.m WHEN par.y <> '' THEN CASE par.sep WHEN '/' THEN par.a ELSE par.b END
    WHEN dm.y <> '' THEN CAST(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], left(dm.m, 3)) AS VARCHAR)
    WHEN md.y <> '' THEN CAST(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], left(md.m, 3)) AS VARCHAR)
    WHEN ym.y <> '' THEN CASE ym.m WHEN '' THEN '1' ELSE ym.m END END AS m,
  CASE WHEN iso.y <> '' THEN iso.d WHEN com.y <> '' THEN com.d WHEN par.y <> '' THEN CASE par.sep WHEN '/' THEN par.b ELSE par.a END WHEN dm.y <> '' THEN dm.d WHEN md.y <> '' THEN md.d WHEN ym.y <> '' THEN '1' END AS d,
  CASE WHEN par.y <> '' THEN CASE par.sep WHEN '/' THEN par.b ELSE par.a END WHEN com.y <> '' AND com.h = '' THEN substr(t, 3, 2) END AS m2,
  CASE WHEN par.y <> '' THEN CASE par.sep WHEN '/' THEN par.a ELSE par.b END WHEN com.y <> '' AND com.h = '' THEN left(t, 2) END AS d2,
  CASE WHEN par.y <> '' THEN par.y WHEN com.y <> '' AND com.h = '' THEN right(t, 4) END AS y2,
  CASE WHEN iso.y <> '' THEN 'iso' WHEN com.y <> '' THEN 'compact_ymd' WHEN par.y <> '' THEN CASE par.sep WHEN '/' THEN 'slash_mdy' ELSE 'dot_dmy' END WHEN dm.y <> '' THEN 'day_month_name' WHEN md.y <> '' THEN 'month_name_day' WHEN ym.m <> '' THEN 'year_month' ELSE 'year' END AS fmt,
  CASE WHEN par.y <> '' THEN CASE par.sep WHEN '/' THEN 'slash_dmy' ELSE 'dot_mdy' END ELSE 'compact_dmy' END AS fmt2,
  CASE WHEN iso.y <> '' THEN iso.r WHEN com.h <> '' THEN com.h || ':' || com.i || ':' || com.s || com.z WHEN par.y <> '' THEN par.r WHEN dm.y <> '' THEN dm.r WHEN md.y <> '' THEN md.r ELSE '' END AS r FROM p),
c AS (SELECT *, regexp_extract(r, '{_REST}', ['h', 'i', 's', 'f', 'ap', 'z']) AS k,
  CASE WHEN y <> '' AND m IS NOT NULL AND TRY_CAST(y AS INT) >= 1 THEN TRY_CAST(y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) END AS day,
  CASE WHEN TRY_CAST(y2 AS INT) >= 1 THEN TRY_CAST(y2 || '-' || lpad(m2, 2, '0') || '-' || lpad(d2, 2, '0') AS DATE) END AS day2 FROM q),
n AS (SELECT *, CASE WHEN k.ap = '' THEN TRY_CAST(k.h AS INT) WHEN TRY_CAST(k.h AS INT) BETWEEN 1 AND 12 THEN TRY_CAST(k.h AS INT) % 12 + CASE k.ap WHEN 'pm' THEN 12 ELSE 0 END END AS hh FROM c),
w AS (SELECT *, CASE WHEN r = '' THEN 0 WHEN hh < 24 AND TRY_CAST(k.i AS INT) < 60 AND coalesce(TRY_CAST(k.s AS INT), 0) < 60 THEN 0 END + epoch_us(day2) AS wall2, CASE WHEN r = '' THEN epoch_us(day) WHEN hh < 24 AND TRY_CAST(k.i AS INT) < 60 AND coalesce(TRY_CAST(k.s AS INT), 0) < 60
    THEN epoch_us(day) + ((hh * 60 + TRY_CAST(k.i AS BIGINT)) * 60 + coalesce(TRY_CAST(k.s AS BIGINT), 0)) * 1000000 + TRY_CAST(rpad(left(k.f, 6), 6, '0') AS BIGINT) END AS wall,
  CASE WHEN k.z IN ('z', 'utc', 'gmt') THEN 0 WHEN k.z = 'cet' THEN 60 WHEN k.z = 'cest' THEN 120 WHEN k.z = 'est' THEN -300 WHEN k.z = 'edt' THEN -240
    WHEN k.z <> '' THEN (CASE left(k.z, 1) WHEN '-' THEN -1 ELSE 1 END) * (TRY_CAST(substr(k.z, 2, 2) AS INT) * 60 + coalesce(TRY_CAST(right(replace(k.z, ':', ''), -3) AS INT), 0)) WHEN feed_zone IS NULL THEN 0 END AS minutes FROM n),
u AS (SELECT *, epoch_us(timezone(coalesce(feed_zone, 'UTC'), make_timestamp(wall))) AS last_us FROM w),
f AS (SELECT src_table, row_id, field_name, feed_zone, fmt, fmt2, wall, wall2, minutes, last_us, t, CASE
  WHEN regexp_full_match(t, '\d{{10,18}}') THEN TRY_CAST(t AS BIGINT) * CASE WHEN TRY_CAST(t AS BIGINT) < 100000000000 THEN 1000000 ELSE 1000 END
  WHEN minutes IS NOT NULL THEN wall - TRY_CAST(minutes AS BIGINT) * 60000000
  -- of a repeated hour the first: an hour earlier shows the same wall clock
  WHEN epoch_us(timezone(feed_zone, make_timestamptz(last_us - 3600000000))) = wall THEN last_us - 3600000000 ELSE last_us END AS utc_us FROM u)
"""
_P3 = f"{_READ} SELECT DISTINCT src_table, row_id, field_name, utc_us FROM f WHERE utc_us IS NOT NULL"
#: The mixture of each source, by as many steps as the operator takes, and what it chooses.
_P3_MIXTURE = rf"""{_READ},
cs AS (SELECT src_table, field_name, feed_zone, list_sort(list_filter([
  CASE WHEN utc_us IS NOT NULL THEN CASE WHEN regexp_full_match(t, '\d{{10,18}}') THEN CASE WHEN TRY_CAST(t AS BIGINT) < 100000000000 THEN 'epoch_s' ELSE 'epoch_ms' END ELSE fmt END END,
  CASE WHEN regexp_full_match(t, '\d{{10,18}}') THEN CASE WHEN TRY_CAST(t AS BIGINT) < 100000000000 THEN 'epoch_ms_short' END WHEN wall2 IS NOT NULL THEN fmt2 END,
  CASE WHEN minutes IS NULL AND utc_us < last_us THEN 'repeated_second' END], lambda x: x IS NOT NULL)) AS fmts FROM f),
sets AS (SELECT *, count(*) AS n FROM cs WHERE len(fmts) > 0 GROUP BY ALL),
src AS (SELECT *, coalesce(feed_zone, '-') AS zone, unnest(fmts) AS fmt FROM sets),
em AS (
  SELECT 0 AS i, src_table, field_name, zone, fmt, 1.0::DOUBLE / count(*) OVER (PARTITION BY src_table, field_name, zone) AS weight FROM (SELECT DISTINCT src_table, field_name, zone, fmt FROM src)
  UNION ALL
  SELECT i + 1, src_table, field_name, zone, fmt, s / sum(s) OVER (PARTITION BY src_table, field_name, zone) FROM (
    SELECT i, src_table, field_name, zone, fmt, sum(n * p) + 0.5::DOUBLE AS s FROM (
      SELECT i, src_table, field_name, zone, fmt, n, weight / sum(weight) OVER (PARTITION BY src_table, field_name, zone, fmts) AS p FROM src JOIN em USING (src_table, field_name, zone, fmt) WHERE i < 500) GROUP BY ALL)),
post AS (SELECT src_table, field_name, feed_zone, fmts, n, fmt, weight / sum(weight) OVER (PARTITION BY src_table, field_name, zone, fmts) AS p FROM src JOIN em USING (src_table, field_name, zone, fmt) WHERE i = 500),
best AS (SELECT * FROM post QUALIFY row_number() OVER (PARTITION BY src_table, field_name, feed_zone, fmts ORDER BY round(p, 9) DESC, fmt) = 1)
SELECT src_table, field_name, feed_zone, fmt, CAST(sum(n) AS BIGINT) AS n_values, CAST(coalesce(sum(n) FILTER (WHERE p < 0.95), 0) AS BIGINT) AS n_ambiguous FROM best GROUP BY 1, 2, 3, 4
"""

SQL = {
    "p3_found": _P3,
    "p3_mixture": _P3_MIXTURE,
    "p1_found": _P1,
    "p1_counts": f"SELECT snapshot_id, change_kind, count(*) AS n_docs FROM ({_P1}) GROUP BY 1, 2",
    "p6_found": _P6,
    "p6_counts": _P6_COUNTS,
}
