"""Run-level set operations: re-ranking, fusion, union, and splicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scoring import rrf_term
from tidewater.functions.text import ws_tokens
from tidewater.operators.lexical import top_k
from tidewater.session import bounded

NO_RANK = 1_000_000_000


def ranked_runs(runs: DataFrame, depth: int | None = None) -> DataFrame:
    """Ranks 1..n per run and query: by positive rank, the rest after, then score, then doc_id. Whole runs, or their first `depth` rows."""
    rank = F.when(F.col("rank") > 0, F.col("rank")).otherwise(NO_RANK)
    w = Window.partitionBy("run_name", "query_id").orderBy(rank, F.desc("score"), "doc_id")
    out = runs.withColumn("rank", F.row_number().over(w))
    return out if depth is None else out.where(F.col("rank") <= depth)


def rrf(runs: DataFrame, k: int = 60, top: int = 1000) -> DataFrame:
    """Reciprocal-rank fusion of ranked runs (run_name, query_id, doc_id, rank); a document that a run repeats counts each time."""
    fused = runs.groupBy("query_id", "doc_id").agg(F.sum(rrf_term(F.col("rank"), k)).alias("score"))
    return top_k(fused, top)


def rrf_in_order(runs: DataFrame, order: list[str], k: int = 60, top: int = 1000) -> DataFrame:
    """Fusion of lists in a given order: ties go to what was seen first, list by list."""
    seen = F.min(F.struct(_place(order).alias("list"), "rank"))
    fused = runs.where(F.col("run_name").isin(order)).groupBy("query_id", "doc_id").agg(F.sum(rrf_term(F.col("rank"), k)).alias("score"), seen.alias("seen"))
    return top_k(fused, top, tie=("seen", "doc_id")).drop("seen")


def _place(order: list[str]) -> Column:
    out = F.lit(len(order))
    for i, name in enumerate(order):
        out = F.when(F.col("run_name") == name, i).otherwise(out)
    return out


def union_candidates(runs: DataFrame, order: list[str], top: int | None = None) -> DataFrame:
    """(query_id, doc_id, rank): the first list in its order, then what the next ones add."""
    seen = runs.where(F.col("run_name").isin(order)).groupBy("query_id", "doc_id").agg(F.min(F.struct(_place(order).alias("list"), "rank")).alias("seen"))
    out = seen.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("seen", "doc_id"))).drop("seen")
    return out.where(F.col("rank") <= top) if top else out


def overlap_words(q: Column, d: Column) -> Column:
    """overlap_score of lists of words."""
    n = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    return F.aggregate(F.array_distinct(q), F.lit(0).cast("long"), lambda s, w: s + F.least(n(q, w), n(d, w))).cast("double")


def overlap_score(query: Column, text: Column) -> Column:
    """Words that query and text share, as often as both have them."""
    return overlap_words(ws_tokens(F.coalesce(query, F.lit(""))), ws_tokens(F.coalesce(text, F.lit(""))))


def pair_scores(candidates: DataFrame, topics: DataFrame, docs: DataFrame, scorer=overlap_score) -> DataFrame:
    """(query_id, doc_id, cand_rank, score) of candidates (query_id, doc_id, rank). Those that docs(doc_id, text) doesn't hold are dropped."""
    asked, texts = F.col("text"), F.col("text")
    if scorer is overlap_score:  # each text is split once, not for each word of each pair
        asked, texts, scorer = (*(ws_tokens(F.coalesce("text", F.lit(""))) for _ in "qd"), overlap_words)
    pairs = candidates.select("query_id", "doc_id", F.col("rank").alias("cand_rank")).join(docs.select("doc_id", texts.alias("text")), "doc_id").join(bounded(topics.select("query_id", asked.alias("query"))), "query_id")
    return pairs.select("query_id", "doc_id", "cand_rank", scorer(F.col("query"), F.col("text")).alias("score"))


def rerank(candidates: DataFrame, topics: DataFrame, docs: DataFrame, k: int, scorer=overlap_score) -> DataFrame:
    """Candidates (query_id, doc_id, rank) by a pair score, ties in candidate order. Candidates that docs(doc_id, text) doesn't hold are dropped."""
    return top_k(pair_scores(candidates, topics, docs, scorer), k, tie=("cand_rank", "doc_id"))


def splice(base: DataFrame, head: DataFrame, k: int) -> DataFrame:
    """The reranked head, then what it leaves of the base run, in its order and with its scores."""
    first = head.select("query_id", "doc_id", "score", F.lit(0).alias("part"), F.col("rank").alias("pos"))
    rest = base.join(head.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", "score", F.lit(1).alias("part"), F.col("rank").alias("pos"))
    w = Window.partitionBy("query_id").orderBy("part", "pos", "doc_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("pos")
