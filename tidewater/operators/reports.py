"""Comparisons across snapshots, models and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TINY = 1e-9


def snapshot_deltas(rows: DataFrame, metrics: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """rows(method, snapshot_id, metrics) to (method, newer, older, metric, old_value, new_value, delta, pct): pct is null where the old value is 0."""
    spark = rows.sparkSession
    long = rows.select("method", "snapshot_id", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))))
    wanted = spark.createDataFrame(pairs, "newer string, older string")
    new = long.join(F.broadcast(wanted), F.col("snapshot_id") == F.col("newer")).select("method", "newer", "older", "metric", F.col("value").alias("new_value"))  # a few comparisons
    old = long.select("method", F.col("snapshot_id").alias("older"), "metric", F.col("value").alias("old_value"))
    both = new.join(old, ["method", "older", "metric"])
    delta = F.col("new_value") - F.col("old_value")
    return both.select("method", "newer", "older", "metric", "old_value", "new_value", delta.alias("delta"), F.when(F.col("old_value") != 0, delta / F.col("old_value")).alias("pct"))


def method_snapshot_pivot(rows: DataFrame, metrics: list[str], snapshots: list[str]) -> DataFrame:
    """One row per method, a column per snapshot and metric."""
    return rows.groupBy("method").pivot("snapshot_id", snapshots).agg(*(F.first(m).alias(m) for m in metrics))


def comparison(rows: DataFrame, by: str, first: str, name: str = "method") -> DataFrame:
    """Rows in report order: `first` ascending, metric `by` descending, name ascending."""
    return rows.orderBy(first, F.desc(by), name)


def temporal_change(rows: DataFrame, metric: str, pivot: str, transitions: list[tuple[str, str]]) -> DataFrame:
    """rows(model, split_name, metric): how each model changes from an earlier to a later split, and that against the pivot model.

    ri = (earlier - later) / earlier, 0 where earlier is about 0; dri = ri - ri of the pivot; er = ri / ri of the pivot, whose size is at least 1e-9.
    """
    spark = rows.sparkSession
    steps = spark.createDataFrame([(i, f"{a}->{b}", a, b) for i, (a, b) in enumerate(transitions)], "place int, transition string, earlier_split string, later_split string")
    side = lambda s: rows.select("model", F.col("split_name").alias(f"{s}_split"), F.col(metric).alias(f"{s}_score"))
    both = F.broadcast(steps).join(side("earlier"), "earlier_split").join(side("later"), ["model", "later_split"])
    e, l = F.col("earlier_score"), F.col("later_score")
    both = both.withColumn("ri", F.when(F.abs(e) < 1e-12, 0.0).otherwise((e - l) / e))
    base = both.where(F.col("model") == pivot).select("transition", F.col("ri").alias("base"))
    if missing := [r[0] for r in steps.join(base, "transition", "left_anti").select("transition").collect()]:  # as many as there are transitions
        raise ValueError(f"no rows of {pivot} for {', '.join(sorted(missing))}")
    out = both.join(base, "transition")
    floor = F.when(F.abs("base") >= TINY, F.col("base")).when(F.col("base") < 0, -TINY).otherwise(TINY)
    return out.select("place", "transition", "model", "earlier_score", "later_score", l.alias("arp"), ((e + l) / 2).alias("marp"), "ri", (F.col("ri") - F.col("base")).alias("dri"), (F.col("ri") / floor).alias("er")).orderBy("place", "dri", "model")


def cube_summary(rows: DataFrame, metric: str) -> DataFrame:
    """Mean of a metric over every combination of method and snapshot, with totals (null)."""
    return rows.cube("method", "snapshot_id").agg(F.round(F.avg(metric), 6).alias(f"mean_{metric}"), F.count(F.lit(1)).alias("n_rows"))


def rank_stability(runs: DataFrame, depth: int = 10) -> DataFrame:
    """runs(run_name, snapshot_no, query_id, doc_id, rank): per run and snapshot, the mean share of each query's top documents that the snapshot before didn't have there."""
    top = runs.where(F.col("rank") <= depth).select("run_name", "snapshot_no", "query_id", "doc_id")
    before = top.select("run_name", (F.col("snapshot_no") + 1).alias("snapshot_no"), "query_id", "doc_id")
    asked = top.select("run_name", "snapshot_no", "query_id").distinct().join(before.select("run_name", "snapshot_no", "query_id").distinct(), ["run_name", "snapshot_no", "query_id"])
    kept = top.join(before, ["run_name", "snapshot_no", "query_id", "doc_id"]).groupBy("run_name", "snapshot_no", "query_id").agg(F.count(F.lit(1)).alias("k"))
    per = asked.join(kept, ["run_name", "snapshot_no", "query_id"], "left").withColumn("drop", 1 - F.coalesce("k", F.lit(0)) / depth)
    return per.groupBy("run_name", "snapshot_no").agg(F.round(F.avg("drop"), 6).alias("rank_stability_drop"), F.count(F.lit(1)).alias("n_queries"))
