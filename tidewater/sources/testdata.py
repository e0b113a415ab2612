"""The test tables as the tables that the retrieval operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.dates import parse_seconds
from tidewater.functions.text import text_view
from tidewater.operators.evaluation import latest_qrels
from tidewater.operators.snapshots import doc_key
from tidewater.session import bounded, table, written

_DATES = ("published_date", "created_date", "updated_date")
_TEXTS = ("title", "abstract", "full_text")
#: Texts that each view needs.
_VIEWS = {"title_abstract": ("title", "abstract"), "full_text": _TEXTS, "all_text": _TEXTS}


def corpus(spark: SparkSession, d: str, texts: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its latest row in its highest snapshot, with parsed dates and the texts that are asked for.

    Only keys, times and dates are aggregated, with the place of the latest row in its file. Texts are read once more, at those places: these travel
    as bits, 64 rows of a file in one, so that no text is shuffled but those that are kept.
    """
    rows = table(spark, d, "document_snapshots")
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = rows.select(doc_key(F.col("doc_id")).alias("doc_id"), "snapshot_id", "delivered_at", *_DATES, *place).where("doc_id is not null")
    picked = F.struct("file", "row") if texts else F.struct(*_DATES)
    last = rows.groupBy("doc_id").agg(F.max_by(picked, F.struct("snapshot_id", "delivered_at")).alias("r")).select("doc_id", "r.*")
    if texts:
        block, bit = F.expr("row div 64").alias("block"), F.expr("cast(row % 64 as int)")
        places = written(last.groupBy("file", block).agg(F.expr("bit_or(shiftleft(1L, cast(row % 64 as int)))").alias("bits")), "latest")
        read = table(spark, d, "document_snapshots").select("doc_id", *_DATES, *texts, *place).withColumn("block", block)
        last = read.join(bounded(places), ["file", "block"]).where(F.bit_get("bits", bit) == 1).select(doc_key(F.col("doc_id")).alias("doc_id"), *_DATES, *texts)
        last = last.repartition("doc_id")  # spread by key: the latest rows may lie in a few files
    published, created = parse_seconds(F.col("published_date")), parse_seconds(F.col("created_date"))
    updated = parse_seconds(F.col("updated_date"))
    month = F.when(F.col("published_date").rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring("published_date", 6, 2).cast("int"))
    out = last.withColumns({"published_s": F.coalesce(published, created), "created_s": created, "updated_s": updated, "month": month})
    return out.withColumn("year", F.year(F.date_from_unix_date(F.floor(F.coalesce("published_s", "updated_s") / 86400).cast("int"))))


def viewed(spark: SparkSession, d: str, mode: str = "title_abstract", keep: bool = False) -> DataFrame:
    """The corpus with its text in one view. keep: written once, for what reads it several times."""
    docs = corpus(spark, d, _VIEWS[mode])
    text = text_view(mode, *(F.col(c) if c in _VIEWS[mode] else F.lit(None).cast("string") for c in _TEXTS))
    docs = docs.select("doc_id", text.alias("text"), "published_s", "created_s", "updated_s", "month", "year")
    return written(docs, "docs") if keep else docs


def topics(spark: SparkSession, d: str) -> DataFrame:
    """The stated search queries: those whose number is divisible by 20."""
    number = F.regexp_extract("query_id", r"(\d+)$", 1).try_cast("long")
    q = table(spark, d, "queries").where((number % 20 == 0) & (F.trim("text") != ""))
    return q.groupBy("query_id").agg(F.max("text").alias("text"))


def all_topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").where(F.col("query_id").isNotNull() & (F.trim("text") != "")).groupBy("query_id").agg(F.max("text").alias("text"))


def qrels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qrels").withColumn("doc_id", doc_key(F.col("doc_id"))).where("query_id is not null and doc_id is not null")
    return latest_qrels(rows)


def runs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """(run_name, query_id, doc_id, score, rank): a document once per run and query, with its best score and least positive rank."""
    rows = table(spark, d, "search_results").withColumn("doc_id", doc_key(F.col("doc_id")))
    rows = rows.where("query_id is not null and doc_id is not null and score is not null and not isnan(score)")
    return rows.groupBy("run_name", *more, "query_id", "doc_id").agg(F.max("score").alias("score"), F.min(F.when(F.col("rank") > 0, F.col("rank"))).alias("rank"))


def citation_counters(spark: SparkSession, d: str) -> DataFrame:
    """Per document, the counters of its latest row."""
    cols = ("total_inbound_citations", "recent_inbound_citations", "nonself_inbound_citations", "nonself_recent_inbound_citations", "total_outbound_citations", "foundational_signal", "emerging_signal")
    rows = table(spark, d, "citation_features").withColumn("doc_id", doc_key(F.col("doc_id"))).where("doc_id is not null")
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct(*cols), F.struct("snapshot_id", "computed_at")).alias("r")).select("doc_id", "r.*")
    names = ("total_in", "recent_in", "nonself_in", "nonself_recent_in", "total_out", "foundational", "emerging")
    return last.select("doc_id", *(F.col(a).alias(b) for a, b in zip(cols, names)))


def citation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Raw citation rows, all text, made of the event stream: a skewed graph with self citations, and edges dated to the month only."""
    e = table(spark, d, "events")
    day = F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 500).cast("int")).cast("string")
    creation = F.when(F.col("event_id") % 20 == 0, F.substring(day, 1, 7)).otherwise(day)
    span = F.concat(F.lit("P"), (F.col("event_id") % 6).cast("string"), F.lit("Y"), (F.col("event_id") % 12).cast("string"), F.lit("M"))
    own = lambda kind: F.when(F.col("event_type") == kind, "True").otherwise("False")
    return e.select(
        F.col("event_id").cast("string").alias("id"), (F.col("event_id") % 1000).cast("string").alias("citing_doc_id"), ((F.col("user_id") * 31 + F.col("event_id")) % 100).cast("string").alias("cited_doc_id"),
        creation.alias("creation"), span.alias("timespan"), own("view").alias("journal_sc"), own("click").alias("author_sc"),
    )
