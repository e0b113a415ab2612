"""Jobs from files to files: evaluation, fusion and overlay of stored runs, suites of experiments, and what each has reached."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import fusion, reports
from tidewater.operators.evaluation import mean_metrics, per_query
from tidewater.operators.overlay import overlay
from tidewater.plans.bundles import Bundle
from tidewater.plans.config import Experiment
from tidewater.plans.pipelines import evidence_of, run_snapshots
from tidewater.session import exists, write_text, written
from tidewater.sources.readers import read_run
from tidewater.sources.writers import status_row, write_csv, write_report, write_run


def progress(spark: SparkSession, path: str, **more: str) -> Callable[[str, int, int, str], None]:
    """A sink (stage, completed, total, note) that keeps the latest state in one JSON file."""
    return lambda stage, completed, total, note="": write_text(spark, path, json.dumps({**more, "stage": stage, "completed": completed, "total": total, "note": note}, indent=2, sort_keys=True))


def evaluate(run: DataFrame, qrels: DataFrame | None, metrics: list[str], folder: str, name: str, snapshot_id: str = "") -> dict[str, float] | None:
    """Writes metrics.json and per_query.csv of one run under folder; without judgments a status in their place, and None."""
    spark = run.sparkSession
    if qrels is None:
        status_row(spark, name, metrics).coalesce(1).write.mode("overwrite").json(f"{folder}/metrics")
        return None
    scores = written(per_query(run.withColumn("run_name", F.lit(name)), qrels, metrics, tie="line_no" if "line_no" in run.columns else "doc_id"), "scores")
    write_csv(scores.drop("run_name").orderBy("query_id").coalesce(1), f"{folder}/per_query.csv")
    means = mean_metrics(scores, metrics).first()
    got = {m: means[m] if means else 0.0 for m in metrics}
    write_text(spark, f"{folder}/metrics.json", json.dumps({"run_name": name, "snapshot_id": snapshot_id, "n_queries": means["n_queries"] if means else 0, "metrics": got}, indent=2, sort_keys=True))
    return got


def evaluate_file(spark: SparkSession, path: str, qrels: DataFrame | None, metrics: list[str], folder: str, name: str, snapshot_id: str = "") -> dict[str, float] | None:
    """A stored run; a document that a query lists twice counts once, with the last line's score; ties are in the file's order."""
    return evaluate(read_run(spark, path, keep_rows=False, keep_lines=True), qrels, metrics, folder, name, snapshot_id)


def fuse_files(spark: SparkSession, paths: list[str], folder: str, name: str, qrels: DataFrame | None = None, metrics: Iterable[str] = ("map",), k: int = 60, top: int = 1000, tell: Callable | None = None) -> dict[str, float] | None:
    """Reciprocal-rank fusion of any number of run files into folder/run, and its metrics. Each file is a list of its own, whatever name its lines carry."""
    tell = tell or progress(spark, f"{folder}/progress.json", run_name=name)
    every = None
    for i, p in enumerate(paths):
        one = read_run(spark, p).withColumn("run_name", F.lit(f"{i}"))
        every = one if every is None else every.unionByName(one)
    tell("fusing", len(paths), len(paths), "")
    fused = written(fusion.rrf(fusion.ranked_runs(every), k, top).withColumn("run_name", F.lit(name)), "fused")
    write_run(fused, f"{folder}/run")
    got = evaluate(fused, qrels, list(metrics), folder, name)
    tell("complete", len(paths), len(paths), "")
    return got


def overlay_file(spark: SparkSession, path: str, bundle: Bundle, e: Experiment, at_s: int, folder: str, tell: Callable | None = None) -> dict[str, float] | None:
    """The overlay of e on a stored run, into folder/run, and its metrics."""
    if e.overlay is None:
        raise ValueError("the experiment has no overlay")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    tell = tell or progress(spark, f"{folder}/progress.json", run_name=e.name, snapshot_id=bundle.snapshot_id)
    tell("overlay", 0, 1, path)
    base = written(fusion.ranked_runs(read_run(spark, path)).select("query_id", "doc_id", "score", "rank"), "run")
    evidence = bundle.evidence if bundle.evidence is not None else evidence_of(bundle.docs, e.retrieval.text)
    done = written(overlay(base, bundle.topics, evidence, at_s, e.overlay, e.retrieval.top_k).withColumn("run_name", F.lit(e.name)), "overlaid")
    write_run(done, f"{folder}/run")
    got = evaluate(done, bundle.qrels, list(e.metrics), folder, e.name, bundle.snapshot_id)
    tell("complete", 1, 1, "")
    return got


def suite(spark: SparkSession, experiments: list[Experiment], load: Callable[[Experiment, str], Bundle], report_dir: str) -> DataFrame:
    """(method, snapshot_id, n_queries, metrics): every experiment over its snapshots, with consolidated reports under report_dir: metrics by method and snapshot, their changes
    between consecutive snapshots, and means. Metrics that not all experiments have are left out of the reports."""
    metrics = [m for m in experiments[0].metrics if all(m in e.metrics for e in experiments)]
    every = None
    for e in experiments:
        got = run_snapshots(spark, lambda n, e=e: load(e, n), e)
        if "snapshot_id" in got.columns:
            one = got.select(F.col("run_name").alias("method"), "snapshot_id", "n_queries", *metrics)
            every = one if every is None else every.unionByName(one)
    if every is None:
        raise ValueError("no experiment has judgments")
    every = written(every, "suite")
    names = sorted({s for e in experiments for s in e.snapshots})
    deltas = reports.snapshot_deltas(every, metrics, list(zip(names[1:], names)))
    for kind in ("json", "md", "html"):
        write_report(every.orderBy("method", "snapshot_id"), f"{report_dir}/metrics.{kind}", "Metrics by method and snapshot")
        write_report(deltas.orderBy("method", "newer", "metric"), f"{report_dir}/deltas.{kind}", "Changes between snapshots")
        write_report(reports.cube_summary(every, metrics[0]).orderBy("method", "snapshot_id"), f"{report_dir}/means.{kind}", f"Mean {metrics[0]}")
    write_csv(every.coalesce(1), f"{report_dir}/metrics.csv")
    return every
