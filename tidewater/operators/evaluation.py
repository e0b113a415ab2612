"""Ranking metrics per query and on average, over any number of runs in one job."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_METRIC = re.compile(r"(map|ndcg_cut|recall|recip_rank_cut)(?:_(\d+))?$")


def metric(name: str) -> tuple[str, int]:
    """('ndcg_cut', 10) of 'ndcg_cut_10'; map has no depth."""
    m = _METRIC.match(name)
    if not m or (m.group(1) == "map") == bool(m.group(2)):
        raise ValueError(f"unknown metric: {name}")
    return m.group(1), int(m.group(2) or 0)


def latest_qrels(qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance): the latest judgment of each pair; a null relevance is 0."""
    rel = F.coalesce("relevance", F.lit(0)).cast("int")
    key = F.struct(F.col("judged_at"), rel)
    return qrels.groupBy("query_id", "doc_id").agg(F.max_by(rel, key).alias("relevance"))


def per_query(runs: DataFrame, qrels: DataFrame, metrics: list[str], *, preset: str = "builtin", depth: int | None = None, order_by: str = "score", keys: tuple[str, ...] = ("run_name",), decimals: int | None = 6, tie: str = "doc_id") -> DataFrame:
    """One row per run and judged query with its metrics.

    builtin: gain 2**rel-1, ties by doc_id, every judged query counts (0 where the run has nothing).
    trec: gain rel, ties by doc_id descending, only queries that the run has.
    runs(*keys, query_id, doc_id, score[, rank]); qrels(query_id, doc_id, relevance), with keys too if these slice judgments.
    tie: what orders equal scores instead of doc_id, such as line_no, the place in a run file. Scores are rounded to `decimals` first, as run files carry them. Whole runs count, or only their first `depth` documents.
    """
    trec = preset == "trec"
    keys = list(keys)
    sliced = [k for k in keys if k in qrels.columns]
    score = F.col("score") if decimals is None else F.round("score", decimals)
    order = [F.col("rank")] if order_by == "rank" else [score.desc(), F.col("doc_id").desc() if trec and tie == "doc_id" else F.col(tie)]
    ranked = runs.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "query_id").orderBy(*order)))
    if depth is not None:
        ranked = ranked.where(F.col("r") <= depth)
    hits = ranked.join(qrels.where("relevance > 0"), [*sliced, "query_id", "doc_id"]).select(*keys, "query_id", "r", "relevance")
    best = ideals(qrels, metrics, [*sliced, "query_id"], trec)
    if trec:
        every = ranked.select(*keys, "query_id").distinct().join(best, [*sliced, "query_id"])
    else:
        names = runs.select(*keys).distinct()
        every = best.join(names, sliced) if sliced else best.crossJoin(F.broadcast(names))  # run names: as many as there are runs
    return scored(every, hits, metrics, [*keys, "query_id"], trec)


def _gain(trec: bool):
    return (lambda c: c.cast("double")) if trec else (lambda c: F.pow(F.lit(2.0), c) - 1)


def _dcg(k: int, r: str, trec: bool) -> Column:
    return F.sum(F.when(F.col(r) <= k, _gain(trec)(F.col("relevance")) / F.log2(F.col(r) + 1.0)))


def ideals(qrels: DataFrame, metrics: list[str], keys: list[str], trec: bool = False) -> DataFrame:
    """(keys, n_rel, i_metric): relevant documents, and the ideal sum of each discounted gain."""
    sums = [_dcg(k, "i", trec).alias(f"i_{m}") for m in metrics for kind, k in [metric(m)] if kind == "ndcg_cut"]
    return qrels.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("relevance"), "doc_id"))).groupBy(*keys).agg(F.count_if(F.col("relevance") > 0).alias("n_rel"), *sums)


def scored(every: DataFrame, hits: DataFrame, metrics: list[str], keys: list[str], trec: bool = False) -> DataFrame:
    """(keys, metrics) for each row of every(keys, n_rel, i_metric): from hits(keys, r, relevance), the relevant documents with their ranks; 0 without hits."""
    hits = hits.withColumn("seen", F.row_number().over(Window.partitionBy(*keys).orderBy("r")))
    want = [(m, *metric(m)) for m in metrics]
    aggs = []
    for name, kind, k in want:
        if kind == "map":
            x = F.sum(F.col("seen") / F.col("r"))
        elif kind == "recall":
            x = F.count_if(F.col("r") <= k).cast("double")
        elif kind == "recip_rank_cut":
            x = F.min(F.when(F.col("r") <= k, F.col("r")))
        else:
            x = _dcg(k, "r", trec)
        aggs.append(x.alias(f"x_{name}"))
    out = every.join(hits.groupBy(*keys).agg(*aggs), keys, "left")
    value: dict[str, Column] = {}
    for name, kind, _ in want:
        x = F.coalesce(F.col(f"x_{name}"), F.lit(0)).cast("double")
        if kind in ("map", "recall"):
            value[name] = F.when(F.col("n_rel") > 0, x / F.col("n_rel")).otherwise(0.0)
        elif kind == "recip_rank_cut":
            value[name] = F.when(x > 0, 1 / x).otherwise(0.0)
        else:
            value[name] = F.when(F.col(f"i_{name}") > 0, x / F.col(f"i_{name}")).otherwise(0.0)
    return out.select(*keys, *(v.alias(n) for n, v in value.items()))


def mean_metrics(scores: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("run_name",), decimals: int = 6) -> DataFrame:
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(m), decimals).alias(m) for m in metrics))
