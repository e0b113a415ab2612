"""Named retrieval pipelines, and the loop that runs, writes and scores them for each snapshot."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.dates import parse_seconds
from tidewater.functions.text import text_view
from tidewater.operators import dense, fusion, lexical
from tidewater.operators.citations import signals
from tidewater.operators.evaluation import mean_metrics, per_query
from tidewater.operators.overlay import evaluation_time, overlay
from tidewater.plans import reindex
from tidewater.plans.bundles import Bundle
from tidewater.plans.config import Experiment, for_snapshot
from tidewater.session import written
from tidewater.sources.writers import status_row, write_csv, write_run

Pipeline = Callable[[DataFrame, DataFrame, Experiment], DataFrame]
PIPELINES: dict[str, Pipeline] = {}


def pipeline(name: str) -> Callable[[Pipeline], Pipeline]:
    return lambda f: PIPELINES.setdefault(name, f)


def _view(docs: DataFrame, mode: str) -> DataFrame:
    return docs.withColumn("text", text_view(mode, F.col("title"), F.col("abstract"), F.col("full_text")))


def _bm25(docs: DataFrame, topics: DataFrame, e: Experiment, mode: str, k: int | None = None) -> DataFrame:
    r = e.retrieval
    if r.index_root:
        return reindex.search(docs.sparkSession, build_index(docs, e, mode), topics, k or r.top_k, r.k1, r.b)
    return lexical.bm25(_view(docs, mode), topics, k or r.top_k, r.k1, r.b)


def build_index(docs: DataFrame, e: Experiment, mode: str) -> str:
    """The folder of the stored index of one snapshot and text mode; it is built and promoted if none is live there."""
    spark, root = docs.sparkSession, f"{e.retrieval.index_root}/{'-'.join(e.snapshots) or 'all'}/{mode}"
    if reindex.live_version(spark, root) is None:
        version = f"v{time.time_ns()}"
        reindex.build(_view(docs, mode).select("doc_id", "text"), root, version)
        reindex.promote(spark, root, version)
    return root


def _rm3(docs: DataFrame, topics: DataFrame, e: Experiment, mode: str) -> DataFrame:
    return lexical.rm3(_view(docs, mode), topics, e.retrieval.top_k, docs=e.expansion.docs, terms=e.expansion.terms, original=e.expansion.original)


PIPELINES["lexical_title_abstract"] = lambda d, t, e: _bm25(d, t, e, "title_abstract")
PIPELINES["lexical_full_text"] = lambda d, t, e: _bm25(d, t, e, "full_text")
PIPELINES["rm3_title_abstract"] = lambda d, t, e: _rm3(d, t, e, "title_abstract")
PIPELINES["rm3_full_text"] = lambda d, t, e: _rm3(d, t, e, "full_text")
PIPELINES["dense"] = lambda d, t, e: dense.hash_search(_view(d, e.retrieval.text), t, e.retrieval.top_k)


@pipeline("lexical_rerank")
def _lexical_rerank(docs, topics, e):
    base = written(_bm25(docs, topics, e, "title_abstract"), "run")
    depth = min(e.rerank.candidate_k, e.rerank.top_k)
    head = fusion.rerank(base.where(F.col("rank") <= depth), topics, _view(docs, "title_abstract"), depth)
    return fusion.splice(base, head, e.retrieval.top_k).drop("part")


@pipeline("dense_rerank")
def _dense_rerank(docs, topics, e):
    v = _view(docs, e.retrieval.text)
    return fusion.rerank(dense.hash_search(v, topics, e.rerank.candidate_k), topics, v, e.rerank.top_k)


def _lists(docs: DataFrame, topics: DataFrame, e: Experiment) -> tuple[DataFrame, DataFrame]:
    v, k = _view(docs, e.retrieval.text), e.rerank.candidate_k
    both = _bm25(docs, topics, e, e.retrieval.text, k).withColumn("run_name", F.lit("lexical")).unionByName(dense.hash_search(v, topics, k).withColumn("run_name", F.lit("dense")))
    return written(both, "lists"), v


@pipeline("hybrid_union_rerank")
def _hybrid_union(docs, topics, e):
    both, v = _lists(docs, topics, e)
    return fusion.rerank(fusion.union_candidates(both, ["lexical", "dense"], 2 * e.rerank.candidate_k), topics, v, e.rerank.top_k)


@pipeline("hybrid_rrf_rerank")
def _hybrid_rrf(docs, topics, e):
    both, v = _lists(docs, topics, e)
    return fusion.rerank(fusion.rrf_in_order(both, ["lexical", "dense"], top=2 * e.rerank.candidate_k), topics, v, e.rerank.top_k)


def run(docs: DataFrame, topics: DataFrame, e: Experiment, evidence: DataFrame | None = None, at_s: int = 0) -> DataFrame:
    """(query_id, doc_id, score, rank, run_name): the pipeline that e names, with the overlay if e has one.

    evidence(doc_id, text, published_s, updated_s, year, total_in, sig_*) is what the overlay reads.
    """
    if e.retrieval.pipeline not in PIPELINES:
        raise ValueError(f"unknown pipeline: {e.retrieval.pipeline}")
    out = PIPELINES[e.retrieval.pipeline](docs, topics, e)
    if e.overlay is not None:
        if evidence is None:
            raise ValueError("the overlay needs evidence")
        out = overlay(written(out.select("query_id", "doc_id", "score", "rank"), "run"), topics, evidence, at_s, e.overlay, e.retrieval.top_k)
    return out.select("query_id", "doc_id", "score", "rank").withColumn("run_name", F.lit(e.name))


def evidence_of(docs: DataFrame, mode: str = "title_abstract", counters: DataFrame | None = None) -> DataFrame:
    """What an overlay reads, of docs with their dates as columns or in metadata; counters(doc_id, total_in, ...) of citations, none: no citations."""
    date = lambda k: parse_seconds(F.col(k) if k in docs.columns else F.try_element_at("metadata", F.lit(k)) if "metadata" in docs.columns else F.lit(None).cast("string"))
    out = _view(docs, mode).select("doc_id", "text", date("publishedDate").alias("p"), date("createdDate").alias("created_s"), date("updatedDate").alias("updated_s")).withColumn("published_s", F.coalesce("p", "created_s")).drop("p")
    out = out.withColumn("year", F.year(F.date_from_unix_date(F.floor(F.coalesce("published_s", "updated_s") / 86400).cast("int"))))
    names = ("total_in", "recent_in", "nonself_in", "nonself_recent_in", "total_out", "foundational", "emerging")
    out = out.join(counters, "doc_id", "left") if counters is not None else out.withColumns({c: F.lit(None).cast("double") for c in names})
    return out.withColumns({f"sig_{k}": v for k, v in signals({c: F.col(c) for c in names}).items()}).withColumn("total_in", F.greatest("total_in", "nonself_in"))


def run_snapshots(spark: SparkSession, load: Callable[[str], Bundle | tuple], e: Experiment) -> DataFrame:
    """(snapshot_id, run_name, n_queries, metrics): each snapshot's run is written under e.output_dir and scored; load gives its bundle (documents, topics, judgments and so on).

    An overlay reads the bundle's evidence, or what the documents themselves hold, as of the snapshot's evaluation time. A snapshot without judgments is written with a status in place of metrics, and isn't in the result.
    """
    out: DataFrame | None = None
    metrics = list(e.metrics)
    for name in e.snapshots:
        got = load(name)
        b = got if isinstance(got, Bundle) else Bundle(*got)
        evidence, at_s = None, 0
        if e.overlay is not None:
            evidence = b.evidence if b.evidence is not None else evidence_of(b.docs, e.retrieval.text)
            at_s = evaluation_time(evidence, name, b.timestamp, e.overlay)
        qrels = b.qrels
        r = written(run(b.docs, b.topics, for_snapshot(e, name), evidence, at_s), "run")
        folder = f"{e.output_dir}/{e.name}/{name}"
        write_run(r, f"{folder}/run")
        if qrels is None:
            status_row(spark, e.name, metrics).coalesce(1).write.mode("overwrite").json(f"{folder}/metrics")
            continue
        scores = written(per_query(r, qrels, metrics), "scores")
        write_csv(scores.drop("run_name").orderBy("query_id").coalesce(1), f"{folder}/per_query.csv")
        m = mean_metrics(scores, metrics).withColumn("snapshot_id", F.lit(name))
        m.coalesce(1).write.mode("overwrite").json(f"{folder}/metrics")
        out = m if out is None else out.unionByName(m)
    return out if out is not None else status_row(spark, e.name, metrics).limit(0)
