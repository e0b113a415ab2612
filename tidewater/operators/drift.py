"""How a collection grows and ages, and when that calls for a new index.

Documents are folded to counts per day first; everything after works on those counts, so running sums replace rescans.
The windows without partitions below run over two rows per day at most, or one per week, never over documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.dates import DAY, day_number, day_text, week_start


def daily_counts(docs: DataFrame) -> DataFrame:
    """(day, new_docs, cumulative_docs, velocity) for days that occur; velocity is the mean of the last seven such days."""
    d = docs.where("published_s is not null").groupBy(day_number(F.col("published_s")).alias("d")).agg(F.count(F.lit(1)).alias("new_docs"))
    w = Window.orderBy("d")
    return d.select(day_text(F.col("d")).alias("day"), "new_docs", F.sum("new_docs").over(w).alias("cumulative_docs"), F.round(F.avg("new_docs").over(w.rowsBetween(-6, 0)), 1).alias("velocity"))


def weekly(docs: DataFrame, gap_s: int, stale_days: int = 90) -> DataFrame:
    """One row per week that occurs: counts, staleness at its Sunday 00:00, and the age of the mean document.

    A document is stale if it is more than `stale_days` whole days old; the share is of documents up to that Sunday 00:00.
    gap_days = whole days from the mean date of these documents to gap_s; it may be negative.
    """
    day = day_number(F.col("published_s"))
    # every instant asked for is a midnight: what counts of a document is the first midnight that isn't before it
    next_midnight = F.ceil(F.col("published_s") / DAY).cast("long")
    per_day = docs.where("published_s is not null").groupBy(day.alias("day"), next_midnight.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum("published_s").alias("seconds"))
    weeks = per_day.groupBy(week_start(F.col("day")).alias("week")).agg(F.sum("n").alias("new_docs"))
    w = Window.orderBy("week")
    weeks = weeks.withColumn("cumulative_docs", F.sum("new_docs").over(w)).withColumn("cut", F.col("week").cast("long") + 6)
    # counts as of an instant: days and cutoffs in one order, one running sum
    none = F.lit(0).cast("long")
    at = lambda shift: weeks.select((F.col("cut") - shift).alias("at"), none.alias("n"), none.alias("seconds"), F.col("week"), F.lit(shift).alias("shift"))
    line = per_day.select("at", "n", "seconds", F.lit(None).cast("int").alias("week"), F.lit(None).cast("int").alias("shift")).unionByName(at(0)).unionByName(at(stale_days + 1))
    run = Window.orderBy("at", F.col("week").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    sums = line.select("week", "shift", F.sum("n").over(run).alias("docs"), F.sum("seconds").over(run).alias("seconds")).where("week is not null")
    now = sums.where("shift = 0").select("week", F.col("docs").alias("total_docs"), "seconds")
    old = sums.where("shift <> 0").select("week", F.col("docs").alias("stale_docs"))
    out = weeks.join(now, "week").join(old, "week")
    some = F.col("total_docs") > 0
    return out.select(
        day_text(F.col("week")).alias("week_start"), "new_docs", "cumulative_docs", "total_docs", "stale_docs",
        F.when(some, F.round(F.col("stale_docs") / F.col("total_docs"), 4)).alias("staleness_rate"),
        F.when(some, F.floor((gap_s - F.col("seconds") / F.col("total_docs")) / DAY)).alias("gap_days"),
    )


def summary(docs: DataFrame, weeks: DataFrame) -> DataFrame:
    """One row over the collection."""
    s = F.col("published_s")
    base = docs.agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(s.isNull()).alias("n_undated"), day_text(day_number(F.min(s))).alias("first_day"), day_text(day_number(F.max(s))).alias("last_day"), day_text(F.floor(F.avg(s) / DAY).cast("int")).alias("mean_day"), (day_number(F.max(s)) - day_number(F.min(s))).alias("span_days")
    )
    last = weeks.agg(F.max_by("staleness_rate", "week_start").alias("final_staleness"))
    return base.crossJoin(last)  # one row each


@dataclass(frozen=True)
class Thresholds:
    staleness: float = 0.15
    coverage: float = 0.05
    gap_growth: float = 30.0
    velocity: float = 2.0
    rank_drop: float = 0.2
    sustained: int = 3
    baseline_weeks: int = 4


ACTIONS = ("none", "soft_alert", "incremental_reindex", "full_rebuild")


def decisions(weeks: DataFrame, stability: DataFrame | None = None, t: Thresholds = Thresholds(), reindexed: str = "first") -> DataFrame:
    """One row per week: what drifted, and the highest action that calls for.

    The index is taken to hold the documents of the first week (reindexed='first') or those of a named week. stability(week_start,
    rank_stability_drop) may be sparse: its last observations count through weeks without one.
    """
    weeks = weeks.where("total_docs > 0")
    line = Window.orderBy("week_start")
    w = weeks.withColumn("n", F.row_number().over(line))
    anchor = F.col("n") == 1 if reindexed == "first" else F.col("week_start") == reindexed
    base = w.agg(F.greatest(F.max(F.when(anchor, F.col("cumulative_docs"))), F.lit(1)).alias("indexed"), F.max(F.when(anchor, F.col("gap_days"))).alias("base_gap"), F.avg(F.when(F.col("n") <= t.baseline_weeks, F.col("new_docs") / 7)).alias("base_velocity"))
    w = w.crossJoin(F.broadcast(base))  # one row
    w = w.join(stability.select("week_start", "rank_stability_drop"), "week_start", "left") if stability is not None else w.withColumn("rank_stability_drop", F.lit(None).cast("double"))
    seen = F.slice(F.collect_list(F.col("rank_stability_drop") > t.rank_drop).over(line), -t.sustained, t.sustained)
    count = F.count("rank_stability_drop").over(line)
    w = w.withColumns(
        {
            "coverage_gap": F.greatest(F.col("cumulative_docs") - F.col("indexed"), F.lit(0)) / F.col("indexed"),
            "velocity": F.col("new_docs") / 7,
            "gap_growth": F.col("gap_days") - F.col("base_gap"),
            "sustained_drop": F.when(count >= t.sustained, F.forall(seen, lambda x: x)).otherwise(False),
        }
    )
    soft = (F.col("staleness_rate") > t.staleness) & (F.col("coverage_gap") > t.coverage)
    gap = F.col("gap_growth") > t.gap_growth
    fast = (F.col("base_velocity") > 0) & (F.col("velocity") > t.velocity * F.col("base_velocity"))
    drop = F.col("sustained_drop")
    level = F.when(drop, 3).when(gap | fast, 2).when(soft, 1).otherwise(0)
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), level + 1)
    why = F.concat_ws("; ", F.when(soft, "stale_and_uncovered"), F.when(gap, "gap_growth"), F.when(fast, "velocity"), F.when(drop, "sustained_rank_drop"))
    r6 = lambda c: F.round(c, 6).alias(c)
    return w.select("week_start", "staleness_rate", r6("coverage_gap"), r6("velocity"), "gap_growth", "sustained_drop", level.alias("level"), action.alias("action"), F.when(level == 0, "within_thresholds").otherwise(why).alias("reason"))


def latest_actionable(decided: DataFrame) -> DataFrame:
    """The last week that calls for something; no row if none does."""
    row = F.struct(*decided.columns)
    return decided.where("level > 0").agg(F.max_by(row, "week_start").alias("r")).where("r is not null").select("r.*")


def index_versions(decided: DataFrame, baseline: str, window_end: str, soft: bool = False) -> DataFrame:
    """(index_no, cutoff, previous_cutoff, action, reason): the baseline index, then one for each decision after it of level 2 or more (1 if soft).

    A cutoff is the Sunday of the decision's week; after the window's end one more is kept. previous_cutoff is that of the version kept before.
    """
    cut = F.date_add(F.col("week_start").cast("date"), 6).cast("string")
    kept = decided.where(F.col("level") >= (1 if soft else 2)).select(cut.alias("cutoff"), "action", "reason").where(F.col("cutoff") > baseline)
    late = F.col("cutoff") > window_end
    kept = kept.withColumn("n_late", F.sum(late.cast("int")).over(Window.orderBy("cutoff"))).where(~late | (F.col("n_late") <= 1)).drop("n_late")
    first = decided.sparkSession.createDataFrame([(baseline, "baseline", "baseline")], "cutoff string, action string, reason string")
    line = Window.orderBy("cutoff")
    return first.unionByName(kept).withColumn("index_no", F.row_number().over(line) - 1).withColumn("previous_cutoff", F.lag("cutoff").over(line))


def membership(docs: DataFrame, versions: DataFrame, baseline: str, window_end_s: int) -> DataFrame:
    """(doc_id, published_day, index_no, in_baseline, days_after): each dated document in the first version whose cutoff day it reaches.

    Versions are intervals that don't overlap, so every document meets at most one row of a table as small as the number of reindexings.
    """
    end = lambda c: (F.unix_date(F.col(c).cast("date")).cast("long") + 1) * DAY - 1
    v = versions.select("index_no", end("cutoff").alias("hi"), F.coalesce(end("previous_cutoff"), F.lit(-(2**60))).alias("lo"))
    d = docs.where(F.col("published_s").isNotNull() & (F.col("published_s") <= window_end_s)).select("doc_id", "published_s")
    met = d.join(F.broadcast(v), (F.col("published_s") > F.col("lo")) & (F.col("published_s") <= F.col("hi")))
    day = day_number(F.col("published_s"))
    base = F.unix_date(F.lit(baseline).cast("date"))
    return met.select("doc_id", day_text(day).alias("published_day"), "index_no", (day <= base).alias("in_baseline"), F.greatest(day - base, F.lit(0)).alias("days_after"))
