"""Citation features per document, as of a cutoff."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.dates import DAY, iso_duration_days, parse_seconds
from tidewater.session import bounded, exists, written

SIGNALS = ("total", "recent", "foundation", "emerging", "outbound")


def edges(raw: DataFrame) -> DataFrame:
    """(citing, cited, created_s, lag_days, is_self) of raw citation rows, all text; edges without a full date are dropped."""
    true = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) == "true"
    return raw.select(
        F.col("citing_doc_id").alias("citing"), F.col("cited_doc_id").alias("cited"), parse_seconds(F.col("creation"), "edge").alias("created_s"), iso_duration_days(F.col("timespan")).alias("lag_days"), (true("journal_sc") | true("author_sc")).alias("is_self")
    ).where("created_s is not null")


def citation_counts(e: DataFrame, cutoff_s: int, window_days: int = 180, exclude_self: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Counters per document from edges created up to the cutoff; of the documents of only(doc_id), if given. A hub's edges are folded before the exchange, so hot documents don't skew it."""
    recent = F.col("created_s") >= cutoff_s - max(window_days, 1) * DAY
    own = F.lit(False) if not exclude_self else F.col("is_self")
    e = e.where(F.col("created_s") <= cutoff_s)
    into, out_of = e, e
    if only is not None:
        wanted = bounded(written(only.select("doc_id").distinct(), "wanted"))
        into, out_of = (e.join(wanted.withColumnRenamed("doc_id", c), c, "left_semi") for c in ("cited", "citing"))
    inbound = into.groupBy(F.col("cited").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("total_in"), F.count_if(recent).alias("recent_in"), F.count_if(~own).alias("nonself_in"), F.count_if(~own & recent).alias("nonself_recent_in"), F.sum("lag_days").alias("lag_sum"), F.count("lag_days").alias("lag_n")
    )
    outbound = out_of.groupBy(F.col("citing").alias("doc_id")).agg(F.count(F.lit(1)).alias("total_out"), F.count_if(recent).alias("recent_out"))
    both = inbound.join(outbound, "doc_id", "full_outer")
    counters = ("total_in", "recent_in", "nonself_in", "nonself_recent_in", "total_out", "recent_out")
    return both.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counters), F.when(F.col("lag_n") > 0, F.col("lag_sum") / F.col("lag_n")).alias("mean_lag"))


def citation_features(counts: DataFrame, window_days: int = 180) -> DataFrame:
    ratio = F.col("recent_in") / F.greatest("total_in", F.lit(1))
    strength = F.greatest("nonself_in", "total_in")
    return counts.withColumns(
        {"recent_ratio": ratio, "velocity": F.col("recent_in") / float(max(window_days, 1)), "foundational": F.log1p(strength.cast("double")) * (1 - ratio), "emerging": F.log1p(F.col("recent_in").cast("double")) * ratio}
    )


def cached_features(raw: DataFrame, root: str, cutoff_s: int, window_days: int = 180, exclude_self: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Counters and features of raw citation rows as of a cutoff, read from a table under root if one of these parameters was written before.

    The table holds all documents and is keyed by its parameters, never by a list of documents; `only` picks from it.
    """
    spark = raw.sparkSession
    key = hashlib.sha1(f"{cutoff_s}|{window_days}|{int(exclude_self)}".encode()).hexdigest()[:16]
    path = f"{root}/citation_features_{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        citation_features(citation_counts(edges(raw), cutoff_s, window_days, exclude_self), window_days).write.mode("overwrite").parquet(path)
    got = spark.read.parquet(path)
    return got if only is None else got.join(bounded(only.select("doc_id").distinct()), "doc_id", "left_semi")


def signals(f: dict[str, Column]) -> dict[str, Column]:
    """Signals of the overlay from counters (null: 0): total, recent, foundation, emerging, outbound."""
    z = lambda c: F.coalesce(f[c].cast("double"), F.lit(0.0))
    return {
        "total": F.log1p(F.greatest(z("nonself_in"), z("total_in"))),
        "recent": F.log1p(F.greatest(z("nonself_recent_in"), z("recent_in"))),
        "foundation": z("foundational"),
        "emerging": z("emerging"),
        "outbound": F.log1p(z("total_out")),
    }
