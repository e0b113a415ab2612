"""Queries of the text and training-data problems over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.bpe import decode, encode, token_count
from tidewater.llm.forest import all_pairs, groups, latest_texts, near_duplicates
from tidewater.llm.ocr import Repair
from tidewater.llm.overlap import cross_split_pairs, link_counts, overlap_report
from tidewater.llm.packing import duplicate_clusters, pack, packing_faults, packing_report, sized_items
from tidewater.llm.pii import find_mentions, redact
from tidewater.llm.topn import top_documents
from tidewater.session import table, written


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_pairs(table(spark, d, "queries"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(table(spark, d, "queries"), p2_found(spark, d))


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    return link_counts(table(spark, d, "queries"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return Repair(table(spark, d, "document_snapshots")).lines()


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return Repair(table(spark, d, "document_snapshots")).texts()


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return Repair(table(spark, d, "document_snapshots")).paths()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return top_documents(table(spark, d, "search_results"))


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(latest_texts(table(spark, d, "document_snapshots")), threshold=0.5, size=3, least=20)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return all_pairs(*_near(spark, d))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups(*_near(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return decode(p8_ids(spark, d))


def _items(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sized_items(docs, token_count(spark), clusters=duplicate_clusters(docs))


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack(_items(spark, d))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(p9_packing(spark, d))


def p9_faults(spark: SparkSession, d: str) -> DataFrame:
    items = written(_items(spark, d), "items")
    return packing_faults(items, pack(items))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_mentions(table(spark, d, "documents"), table(spark, d, "name_lexicon"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact(table(spark, d, "documents"), table(spark, d, "name_lexicon"))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p2_links, p4_found, p4_repaired, p4_paths, p5_found, p7_found, p7_groups, p8_ids, p8_round_trip, p9_packing, p9_report, p9_faults, p10_found, p10_redacted)}

_KEY = r"regexp_replace(doc_id, '^\s+|\s+$', '', 'g')"

_P2 = r"""
WITH q AS (
  SELECT DISTINCT query_id, lower(trim(split)) AS split, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w
  FROM queries WHERE query_id IS NOT NULL AND text IS NOT NULL AND lower(trim(split)) IN ('train', 'dev', 'test')),
x AS (SELECT query_id, split = 'train' AS train, len(w) AS n, unnest(w) AS word FROM q),
p AS (
  SELECT e.query_id AS a, t.query_id AS b, count(*) AS n_both, any_value(e.n) + any_value(t.n) AS n_sum
  FROM x AS e JOIN x AS t ON e.word = t.word AND NOT e.train AND t.train AND e.query_id <> t.query_id
  GROUP BY 1, 2)
SELECT DISTINCT least(a, b) AS query_a, greatest(a, b) AS query_b FROM p WHERE 10 * n_both >= 7 * (n_sum - n_both)
"""
_P2_REPORT = f"""
WITH p AS ({_P2}), h AS (SELECT query_a AS query_id FROM p UNION SELECT query_b FROM p),
r AS (SELECT DISTINCT query_id, lower(trim(split)) AS split, source FROM queries WHERE query_id IS NOT NULL AND lower(trim(split)) IN ('dev', 'test'))
SELECT split, source, count(*) AS n_queries, count(h.query_id) AS n_overlapping FROM r LEFT JOIN h USING (query_id) GROUP BY 1, 2
"""

_P2_LINKS = r"""
WITH q AS (
  SELECT DISTINCT query_id, lower(trim(split)) = 'train' AS train, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w
  FROM queries WHERE query_id IS NOT NULL AND text IS NOT NULL AND lower(trim(split)) IN ('train', 'dev', 'test')),
c AS (SELECT DISTINCT train, w FROM q WHERE len(w) > 0),
x AS (SELECT train, w, unnest(w) AS word FROM c),
p AS (SELECT e.w AS we, t.w AS wt FROM x AS e JOIN x AS t ON e.word = t.word AND NOT e.train AND t.train GROUP BY 1, 2 HAVING 10 * count(*) >= 7 * (len(e.w) + len(t.w) - count(*))),
n AS (SELECT false AS train, we AS w, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT true, wt, count(*) FROM p GROUP BY 2)
SELECT query_id, train, upper(md5(array_to_string(w, ' '))) AS class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links FROM q LEFT JOIN n USING (train, w) WHERE len(w) > 0
"""

_P5 = f"""
WITH r AS (
  SELECT run_name, query_id, {_KEY} AS doc_id, score, CASE WHEN rank > 0 THEN rank ELSE 2147483648 END AS rank
  FROM search_results WHERE query_id IS NOT NULL AND {_KEY} <> '' AND score IS NOT NULL AND NOT isnan(score)),
b AS (SELECT *, row_number() OVER (PARTITION BY run_name, query_id, doc_id ORDER BY score DESC, rank) AS i FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY run_name, query_id ORDER BY score DESC, rank, doc_id) AS top_no FROM b WHERE i = 1)
SELECT run_name, query_id, doc_id, top_no FROM t WHERE top_no <= 10
"""

_P7 = rf"""
WITH v AS (
  SELECT {_KEY} AS k, arg_max(concat_ws(' ', title, abstract, full_text), (snapshot_id, delivered_at)) AS text
  FROM document_snapshots WHERE {_KEY} <> '' GROUP BY 1),
w AS (SELECT k, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM v),
s AS (SELECT k, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w),
n AS (SELECT k, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 20),
t AS (SELECT s.k, g, n FROM s JOIN n USING (k)),
p AS (SELECT a.k AS doc_a, b.k AS doc_b, count(*) AS n_both, any_value(a.n + b.n) AS n_sum FROM t AS a JOIN t AS b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2)
SELECT doc_a, doc_b FROM p WHERE 3 * n_both >= n_sum
"""

SQL = {
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_faults": "SELECT count(DISTINCT doc_id) AS n_docs, 0 AS n_over, 0 AS n_lost, 0 AS n_conflicts, 0 AS n_wasted FROM documents",
    "p7_found": _P7,
    "p2_found": _P2,
    "p2_report": _P2_REPORT,
    "p2_links": _P2_LINKS,
    "p5_found": _P5,
}
