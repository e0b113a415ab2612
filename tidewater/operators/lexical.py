"""Lexical retrieval: index tables, BM25 and pseudo-relevance feedback.

The index is tables (postings, lengths, document frequencies). Postings are reduced to the terms that are asked for and packed; a search takes
blocks of queries through them, and only the top k of a query become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.stem import porter
from tidewater.functions.text import bm25_tokens
from tidewater.operators import packed
from tidewater.session import bounded, written

K1, B = 1.5, 0.75


def top_k(scored: DataFrame, k: int, *, group: tuple[str, ...] = ("query_id",), tie: tuple[str, ...] = ("doc_id",), rank: str = "rank") -> DataFrame:
    """The k best rows of each group by score (to 8 digits), ties by `tie`; ranks from 1."""
    w = Window.partitionBy(*group).orderBy(F.round("score", 8).desc(), *tie)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


#: Words that a search may leave out.
STOP_WORDS = tuple(
    """a about after all also an and any are as at be because been before between both but by can could did do does for from had has have he her his how if in into is it its
    may more most no not of on only or other our over she should so some such than that the their them then there these they this those through to under up was we were what when where
    which while who will with would you""".split()
)


@dataclass(frozen=True)
class Analysis:
    """How tokens become terms, and a ranking's inverse document frequency: `plus` is ln(1 + x), `plain` is ln(x), which is negative for words of more than half of all documents."""

    stop: tuple[str, ...] = ()
    stem: bool = False
    idf: str = "plus"


PLAIN = Analysis()


def analysed(rows: DataFrame, a: Analysis) -> DataFrame:
    """rows(key, tokens) with tokens as terms: stop words are dropped, the others stemmed, in this order."""
    if a.stop:
        rows = rows.withColumn("tokens", F.filter("tokens", lambda x: ~x.isin(*a.stop)))
    if a.stem:

        def stems(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known: dict[str, str] = {}
            for pdf in frames:
                if len(known) > 1_000_000:
                    known.clear()
                for words in pdf["tokens"]:
                    for w in words:
                        if w not in known:
                            known[w] = porter(w)
                yield pdf.assign(tokens=[[known[w] for w in words] for words in pdf["tokens"]])

        rows = rows.mapInPandas(stems, rows.schema)
    return rows


def tokenized(docs: DataFrame, analysis: Analysis = PLAIN) -> DataFrame:
    """docs(doc_id, text) to (doc_id, tokens, length). Documents without words stay, with length 0."""
    return analysed(docs.select("doc_id", bm25_tokens(F.coalesce("text", F.lit(""))).alias("tokens")), analysis).withColumn("length", F.size("tokens").cast("long"))


def postings(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "length", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def collection_stats(tokens: DataFrame) -> DataFrame:
    """One row: documents (empty ones count), their mean length, all tokens."""
    return tokens.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"), F.sum("length").alias("n_tokens"))


def document_frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(topics: DataFrame, analysis: Analysis = PLAIN) -> DataFrame:
    """(query_id, term, weight): a repeated word weighs as often as it stands."""
    tokens = analysed(topics.select("query_id", bm25_tokens(F.coalesce("text", F.lit(""))).alias("tokens")), analysis)
    return tokens.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def ranked(tokens: DataFrame, weighted: DataFrame, k: int, k1: float = K1, b: float = B, idf: str = "plus", stats: DataFrame | None = None, df: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of weighted query terms (query_id, term, weight), of scores over 0. tokens(doc_id, tokens, length[, tfs]); stats (one row) and df(term, df) are counted if they aren't given."""
    if idf not in ("plus", "plain"):
        raise ValueError(f"unknown idf: {idf}")
    weighted = written(weighted, "weights")
    stats = collection_stats(tokens) if stats is None else stats
    turns = -(-weighted.count() // packed.WEIGHT_ROWS)
    out = None
    for i in range(max(1, turns)):
        part = weighted if turns <= 1 else weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == i)
        one, whole = packed.search(tokens, stats, part, k, k1, b, idf, df)
        one = one if whole else top_k(one.drop("rank"), k)
        out = one if out is None else out.unionByName(one)
    return out


def indexed_search(post: DataFrame, df: DataFrame, stats: DataFrame, topics: DataFrame, k: int = 1000, k1: float = K1, b: float = B, most_terms: int = 2000) -> DataFrame:
    """(query_id, doc_id, score, rank) by a stored index (postings sorted by term, document frequencies, stats): nothing is tokenized but the topics.

    Up to `most_terms` asked terms are pushed down to the scan of the postings, which skips row groups; more are joined.
    """
    weighted = written(query_terms(topics), "weights")
    asked = weighted.select("term").distinct()
    few = [r.term for r in asked.limit(most_terms + 1).collect()]
    if len(few) <= most_terms:
        post, df = (x.where(F.col("term").isin(few)) for x in (post, df))
    else:
        post, df = (x.join(bounded(asked), "term", "left_semi") for x in (post, df))
    docs = post.groupBy("doc_id").agg(F.max("length").alias("length"), F.collect_list(F.struct("term", "tf")).alias("p"))
    docs = docs.select("doc_id", F.col("p.term").alias("tokens"), "length", F.col("p.tf").alias("tfs"))
    return ranked(docs, weighted, k, k1, b, stats=stats, df=df)


def bm25(docs: DataFrame, topics: DataFrame, k: int = 1000, k1: float = K1, b: float = B, analysis: Analysis = PLAIN) -> DataFrame:
    """(query_id, doc_id, score, rank) over docs(doc_id, text) for topics(query_id, text)."""
    return ranked(written(tokenized(docs, analysis), "tokens"), query_terms(topics, analysis), k, k1, b, analysis.idf)


def relevance_model(tokens: DataFrame, feedback: DataFrame, terms: int = 10) -> DataFrame:
    """(query_id, term, p): the strongest terms of feedback(query_id, doc_id, score) documents, weighted by their scores, summing to 1."""
    share = F.col("score") / F.sum("score").over(Window.partitionBy("query_id"))
    fb = feedback.withColumn("share", share)
    p = tokens.where("length > 0").join(bounded(fb), "doc_id").select("query_id", "share", "length", F.explode("tokens").alias("term"))
    p = p.groupBy("query_id", "term").agg(F.sum(F.col("share") / F.col("length")).alias("score"))
    best = top_k(p, terms, tie=("term",))
    return best.select("query_id", "term", (F.col("score") / F.sum("score").over(Window.partitionBy("query_id"))).alias("p"))


def expanded_terms(tokens: DataFrame, topics: DataFrame, docs: int = 3, terms: int = 10, original: float = 0.6) -> DataFrame:
    """(query_id, term, weight): the query's own terms, and those of its best documents; `original` is the weight of the query."""
    own = query_terms(topics)
    feedback = written(ranked(tokens, own, docs).drop("rank"), "feedback")
    own = own.select("query_id", "term", (F.lit(original) * F.col("weight") / F.sum("weight").over(Window.partitionBy("query_id"))).alias("weight"))
    new = relevance_model(tokens, feedback, terms).select("query_id", "term", ((1 - original) * F.col("p")).alias("weight"))
    return own.unionByName(new).groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))


def rm3(docs: DataFrame, topics: DataFrame, k: int = 1000, /, **params) -> DataFrame:
    tokens = written(tokenized(docs), "tokens")
    return ranked(tokens, expanded_terms(tokens, topics, **params), k)


def merged_stats(live: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document frequencies, collection stats) of two indexes put together: all of it adds up. Where a document is in both, the delta's holds."""
    live = live.join(delta.select("doc_id"), "doc_id", "left_anti")
    both = live.unionByName(delta)
    df = document_frequencies(postings(live)).unionByName(document_frequencies(postings(delta))).groupBy("term").agg(F.sum("df").alias("df"))
    return df, collection_stats(both)
