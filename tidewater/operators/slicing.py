"""Evaluation by slices of time: months, growing cutoffs, and reindexing scenarios. All slices are one job, keyed by slice."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.dates import DAY
from tidewater.operators.evaluation import ideals, scored
from tidewater.session import bounded, written

#: Months of each split, in any year.
SPLITS = {"march_only": (3,), "march_april": (3, 4), "march_april_may": (3, 4, 5)}


def judged(qrels: DataFrame, least: int = 1, keys: tuple[str, ...] = ("slice",)) -> DataFrame:
    """Judgments of queries that keep at least `least` of them."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "query_id"))
    return qrels.withColumn("n_judged", n).where(F.col("n_judged") >= least).drop("n_judged")


def _evaluated(slices: list[str], counts: DataFrame, runs: DataFrame, run_in: list[Column], qrels: DataFrame, qrel_in: list[Column], metrics: list[str], least: int = 1) -> DataFrame:
    """Metrics per slice and run. run_in and qrel_in: for each slice, whether a row of runs, or of qrels, belongs to it. Slices without judgments have 0.

    A run's rows are ranked once: of a relevant document its rank in each slice is a running count of the rows of that slice down to it. Only hits are
    laid out by slice. Every run of the job is scored in every slice, with 0 where it found nothing.
    """
    false = lambda c: F.coalesce(c, F.lit(False))
    places = F.array(*(F.struct(F.lit(n).alias("slice"), F.lit(i).alias("no"), false(c).alias("in")) for i, (n, c) in enumerate(zip(slices, qrel_in))))
    kept = judged(qrels.select("query_id", "doc_id", "relevance", F.inline(places)).where("in").drop("in"), least)
    kept = written(kept, "judged")
    asked = kept.groupBy("query_id").agg(F.collect_set("no").alias("nos"))
    runs = runs.select("run_name", "query_id", "doc_id", F.round("score", 6).alias("score"), F.array(*map(false, run_in)).alias("inside"))
    runs = written(runs.where(F.exists("inside", lambda x: x)).join(bounded(asked), "query_id"), "runs")
    names = written(runs.where(F.exists("nos", lambda i: F.col("inside")[i])).select("run_name").distinct(), "names")  # as many as there are runs
    line = Window.partitionBy("run_name", "query_id").orderBy(F.desc("score"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ranks = F.array(*(F.sum(F.col("inside")[i].cast("int")).over(line) for i in range(len(slices))))
    ranked = runs.select("run_name", "query_id", "doc_id", "inside", ranks.alias("ranks"))
    hits = ranked.join(kept.where("relevance > 0"), ["query_id", "doc_id"]).where(F.col("inside")[F.col("no")])
    hits = hits.select("slice", "run_name", "query_id", F.col("ranks")[F.col("no")].alias("r"), "relevance")
    hits = written(hits, "hits")
    # queries without hits add nothing but to the number of queries that means are over, so they aren't laid out
    some = hits.select("slice", "run_name", "query_id").distinct().join(ideals(kept, metrics, ["slice", "query_id"]), ["slice", "query_id"])
    sums = scored(some, hits, metrics, ["slice", "run_name", "query_id"]).groupBy("slice", "run_name").agg(*(F.sum(m).alias(m) for m in metrics))
    asked = kept.groupBy("slice").agg(F.countDistinct("query_id").alias("n_queries"))
    grid = names.select("run_name", F.explode(F.array(*map(F.lit, slices))).alias("slice"))
    out = grid.join(sums, ["slice", "run_name"], "left").join(F.broadcast(asked), "slice", "left").join(F.broadcast(counts), "slice", "left")  # a row per slice
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return out.select("slice", "run_name", zero("n_queries", 0), zero("n_docs", 0), *(F.round(F.coalesce(F.col(m) / F.col("n_queries"), F.lit(0.0)), 6).alias(m) for m in metrics))


def _counted(docs: DataFrame, slices: list[str], inside: list[Column]) -> DataFrame:
    """(slice, n_docs) in one pass."""
    one = docs.agg(*(F.count_if(c).alias(f"n{i}") for i, c in enumerate(inside)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(s).alias("slice"), F.col(f"n{i}").alias("n_docs")) for i, s in enumerate(slices)))))


def by_month(docs: DataFrame, runs: DataFrame, qrels: DataFrame, metrics: list[str], splits: dict[str, tuple[int, ...]] = SPLITS, least: int = 1) -> DataFrame:
    """docs(doc_id, month): only documents of a split's months count, in runs and in judgments; queries with fewer than `least` judgments left are dropped. The year isn't looked at."""
    months = docs.select("doc_id", "month").where("month is not null")
    inside = [F.col("month").isin(*ms) for ms in splits.values()]
    return _evaluated(list(splits), _counted(months, list(splits), inside), runs.join(months, "doc_id"), inside, qrels.join(months, "doc_id"), inside, metrics, least)


Points = list[tuple[str, int]]


def cutoffs(start_s: int, end_s: int, step_days: int = 7) -> Points:
    """(slice, cutoff_s) of each step: the first cutoff is the last day of the first step, at its start."""
    return [(_day(c), c) for c in range(start_s + (step_days - 1) * DAY, end_s + 1, step_days * DAY)]


def _day(s: int) -> str:
    return (date(1970, 1, 1) + timedelta(days=s // DAY)).isoformat()


def _dated(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.join(docs.select("doc_id", "published_s").where("published_s is not null"), "doc_id")


def _upto(points: Points) -> list[Column]:
    return [F.col("published_s") <= c for _, c in points]


def cumulative(docs: DataFrame, runs: DataFrame, qrels: DataFrame, points: Points, metrics: list[str]) -> DataFrame:
    """Runs and judgments both grow with the cutoff."""
    names = [n for n, _ in points]
    return _evaluated(names, _counted(docs, names, _upto(points)), _dated(runs, docs), _upto(points), _dated(qrels, docs), _upto(points), metrics)


def frozen(docs: DataFrame, runs: DataFrame, qrels: DataFrame, points: Points, frozen_s: int, metrics: list[str]) -> DataFrame:
    """Runs stay as of `frozen_s` while judgments grow; n_new counts documents since."""
    names = [n for n, _ in points]
    out = _evaluated(names, _counted(docs, names, _upto(points)), _dated(runs, docs), [F.col("published_s") <= frozen_s] * len(points), _dated(qrels, docs), _upto(points), metrics)
    base = docs.where(F.col("published_s") <= frozen_s).agg(F.count(F.lit(1)).alias("n_frozen"))
    return out.crossJoin(F.broadcast(base)).withColumn("n_new", F.greatest(F.col("n_docs") - F.col("n_frozen"), F.lit(0)))  # one row


def scenarios(docs: DataFrame, runs: DataFrame, qrels: DataFrame, points: Points, baseline_s: int, end_s: int, metrics: list[str]) -> DataFrame:
    """Three ways to keep an index, side by side: never reindexed, appended to, and rebuilt. Judgments are those of the whole window; appending and rebuilding hold the same documents."""
    names = ["none", *(n for n, _ in points)]
    run_in = [F.col("published_s") <= baseline_s, *_upto(points)]
    whole = _dated(qrels, docs).where(F.col("published_s") <= end_s)
    both = written(_evaluated(names, _counted(docs, names, run_in), _dated(runs, docs), run_in, whole, [F.lit(True)] * len(names), metrics), "scenarios")
    fixed = both.where("slice = 'none'").select("run_name", *(F.col(m).alias(f"none_{m}") for m in metrics))
    grown = both.where("slice <> 'none'")
    return grown.join(fixed, "run_name").select("slice", "run_name", *(F.round(f"none_{m}", 4).alias(f"none_{m}") for m in metrics), *(F.round(m, 4).alias(f"{kind}_{m}") for kind in ("append", "global") for m in metrics))


@dataclass(frozen=True)
class SplitPlan:
    """Months of each split, the date that months are taken from, and the least judgments of a query that is kept."""

    splits: dict[str, tuple[int, ...]]
    date_field: str = "publishedDate"
    least: int = 1


def split_plan(path: str | Path | None = None) -> SplitPlan:
    """From a YAML file: `splits`, a list of names and months, or `monthly_split` with train_months and validation_months. By default train is March and April, validation May."""
    raw: dict = {}
    if path is not None:
        import yaml

        raw = yaml.safe_load(Path(path).read_text()) or {}
    m = raw.get("monthly_split", {})
    splits = raw.get("splits") or [{"name": "train_months", "months": m.get("train_months", [3, 4])}, {"name": "validation_months", "months": m.get("validation_months", [5])}]
    return SplitPlan({str(x["name"]): tuple(x["months"]) for x in splits}, m.get("date_field", "publishedDate"), int(m.get("minimum_qrels_per_query", 1)))


def with_month(docs: DataFrame, date_field: str = "publishedDate") -> DataFrame:
    """(doc_id, month) of the date under a column or metadata key of that name; null unless it is a full date."""
    c = F.col(date_field) if date_field in docs.columns else F.try_element_at("metadata", F.lit(date_field))
    return docs.select("doc_id", F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 6, 2).cast("int")).alias("month"))
