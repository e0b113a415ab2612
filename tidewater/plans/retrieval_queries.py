"""Queries of the retrieval operators over the test tables. Their SQL is in retrieval_sql."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import cues
from tidewater.functions.dates import age_days, iso_duration_days
from tidewater.functions.scoring import bm25_idf, decay, maturity
from tidewater.functions.text import text_view
from tidewater.functions.vectors import norm
from tidewater.operators import citations as cit
from tidewater.operators import dense, drift, fusion, lexical, reports, slicing
from tidewater.operators.evaluation import mean_metrics, per_query
from tidewater.operators.overlay import Settings, evaluation_time, overlay, query_profiles
from tidewater.operators.snapshots import numbered, snapshot_names
from tidewater.sources import testdata as td
from tidewater.sources.readers import within
from tidewater.plans import reindex
from tidewater.session import bounded, shared_dir, table, written

#: 2025-11-30T23:59:59Z, 2025-05-31T23:59:59Z, 2025-03-31T23:59:59Z, 2025-02-28T23:59:59Z, 2025-03-01T00:00:00Z, 2025-04-01T00:00:00Z
AT, WINDOW_END, FROZEN, BASELINE, WINDOW_START, AFTER = 1764547199, 1748735999, 1743465599, 1740787199, 1740787200, 1743465600
METRICS = ["ndcg_cut_10", "map", "recall_100", "recip_rank_cut_10"]
Q = {}


def query(f):
    Q[f.__name__] = f
    return f


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# --- text and index


@query
def text_views(s: SparkSession, d: str) -> DataFrame:
    t = [F.col(c) for c in ("title", "abstract", "full_text")]
    return td.corpus(s, d, ("title", "abstract", "full_text")).select("doc_id", *(text_view(m, *t).alias(m) for m in ("title_abstract", "full_text", "all_text")))


@query
def bm25_tokens(s, d):
    t = lexical.tokenized(td.viewed(s, d))
    return t.select("doc_id", "length", F.size(F.array_distinct("tokens")).cast("long").alias("n_terms"))


@query
def bm25_postings(s, d):
    return lexical.postings(lexical.tokenized(td.viewed(s, d)))


@query
def bm25_doc_stats(s, d):
    return lexical.collection_stats(lexical.tokenized(td.viewed(s, d))).select("n_docs", "n_tokens", *r6("mean_length"))


@query
def bm25_df_idf(s, d):
    t = written(lexical.tokenized(td.viewed(s, d)), "tokens")
    one = lexical.collection_stats(t).select("n_docs")
    df = lexical.document_frequencies(lexical.postings(t)).crossJoin(F.broadcast(one))  # one row
    return df.select("term", "df", F.round(bm25_idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


def _run(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", *r6("score"), "rank")


@query
def bm25_topk_ta(s, d):
    return _run(lexical.bm25(td.viewed(s, d), td.topics(s, d), 100))


@query
def bm25_topk_ft(s, d):
    return _run(lexical.bm25(td.viewed(s, d, "full_text"), td.topics(s, d), 100))


@query
def bm25_stopped_topk(s, d):
    return _run(lexical.bm25(td.viewed(s, d), td.topics(s, d), 100, 1.2, analysis=lexical.Analysis(stop=lexical.STOP_WORDS)))


@query
def bm25_stemmed_topk(s, d):
    return _run(lexical.bm25(td.viewed(s, d), td.topics(s, d), 100, 1.2, analysis=lexical.Analysis(stop=lexical.STOP_WORDS, stem=True)))


@query
def bm25_frozen_cutoff(s, d):
    return _run(lexical.bm25(td.viewed(s, d).where(F.col("published_s") <= FROZEN), td.topics(s, d), 100))


@query
def bm25_stored_index(s, d):
    """The same ranking as bm25_topk_ta, from an index that was built and promoted beforehand."""
    root = f"{shared_dir(s).rstrip('/')}/index-{uuid.uuid4().hex}"
    reindex.build(td.viewed(s, d).select("doc_id", "text"), root, "v1")
    reindex.promote(s, root, "v1")
    return _run(reindex.search(s, root, td.topics(s, d), 100))


@query
def rm3_terms(s, d):
    return lexical.expanded_terms(written(lexical.tokenized(td.viewed(s, d)), "tokens"), td.topics(s, d)).select("query_id", "term", *r6("weight"))


@query
def rm3_topk(s, d):
    return _run(lexical.rm3(td.viewed(s, d), td.topics(s, d), 100))


@query
def delta_merge_stats(s, d):
    docs = td.viewed(s, d, keep=True)
    t = written(lexical.tokenized(docs).join(docs.select("doc_id", "published_s"), "doc_id"), "tokens")
    live, delta = t.where(F.col("published_s") <= FROZEN), within(t, FROZEN, WINDOW_END)
    df, one = lexical.merged_stats(live.drop("published_s"), delta.drop("published_s"))
    return df.crossJoin(F.broadcast(one)).select("term", "df", "n_docs", "n_tokens")  # one row


# --- evaluation


@query
def eval_per_query(s, d):
    return per_query(td.runs(s, d), td.qrels(s, d), METRICS).select("run_name", "query_id", *r6(*METRICS))


@query
def eval_mean_builtin(s, d):
    return mean_metrics(per_query(td.runs(s, d), td.qrels(s, d), METRICS), METRICS)


@query
def eval_mean_trec(s, d):
    return mean_metrics(per_query(td.runs(s, d), td.qrels(s, d), METRICS, preset="trec"), METRICS)


# --- fusion and reranking


def _ranked(s, d, *names: str) -> DataFrame:
    return fusion.ranked_runs(td.runs(s, d).where(F.col("run_name").isin(*names)))


LEX, DENSE, FULL = "bm25_title_abstract", "dense_title_abstract", "bm25_full_text"


@query
def ranked_runs(s, d):
    return fusion.ranked_runs(td.runs(s, d)).select("run_name", "query_id", "doc_id", "rank")


@query
def rrf_two(s, d):
    return fusion.rrf(_ranked(s, d, LEX, DENSE)).select("query_id", "doc_id", F.round("score", 8).alias("score"), "rank")


@query
def rrf_three(s, d):
    return fusion.rrf(_ranked(s, d, LEX, DENSE, FULL)).select("query_id", "doc_id", F.round("score", 8).alias("score"), "rank")


@query
def rrf_pairwise(s, d):
    return fusion.rrf_in_order(_ranked(s, d, LEX, DENSE), [LEX, DENSE], top=100).select("query_id", "doc_id", F.round("score", 8).alias("score"), "rank")


@query
def union_candidates(s, d):
    return fusion.union_candidates(_ranked(s, d, LEX, DENSE), [LEX, DENSE], 200)


@query
def overlap_rerank(s, d):
    docs, t = td.viewed(s, d, keep=True), td.topics(s, d)
    return _run(fusion.rerank(lexical.bm25(docs, t, 20), t, docs, 20))


@query
def rerank_head_tail(s, d):
    docs, t = td.viewed(s, d, keep=True), td.topics(s, d)
    base = written(lexical.bm25(docs, t, 50), "run")
    return fusion.splice(base, fusion.rerank(base.where("rank <= 20"), t, docs, 20), 50).select("query_id", "doc_id", *r6("score"), "part", "rank")


@query
def rerank_sweep(s, d):
    docs, t = td.viewed(s, d, keep=True), td.topics(s, d)
    scored, out = written(fusion.pair_scores(lexical.bm25(docs, t, 50), t, docs), "scored"), None  # a pair's score is the same at any depth
    for depth in (10, 20, 50):
        one = lexical.top_k(scored.where(F.col("cand_rank") <= depth), 10, tie=("cand_rank", "doc_id")).withColumn("candidate_k", F.lit(depth))
        out = one if out is None else out.unionByName(one)
    return out.select("candidate_k", "query_id", "doc_id", *r6("score"), "rank")


# --- vectors


@query
def hash_embed(s, d):
    return dense.hash_embedding(td.viewed(s, d), "doc_id").select("doc_id", "bucket", *r6("weight"))


@query
def hash_dense_topk(s, d):
    return _run(dense.hash_search(td.viewed(s, d), td.topics(s, d), 20))


@query
def vector_norms(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


@query
def vector_topk(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return dense.exact_search(v, v.where("id % 20 = 0"), 10).select("query_id", "doc_id", *r6("score"), "rank")


@query
def hybrid_rrf_rerank(s, d):
    docs, t = td.viewed(s, d, keep=True), td.topics(s, d)
    lists = lexical.bm25(docs, t, 20).withColumn("run_name", F.lit("lexical")).unionByName(dense.hash_search(docs, t, 20).withColumn("run_name", F.lit("dense")))
    pool = fusion.rrf_in_order(lists, ["lexical", "dense"], top=40)
    return _run(fusion.rerank(pool, t, docs, 20))


@query
def hybrid_union_rerank(s, d):
    docs, t = td.viewed(s, d, keep=True), td.topics(s, d)
    lists = lexical.bm25(docs, t, 20).withColumn("run_name", F.lit("lexical")).unionByName(dense.hash_search(docs, t, 20).withColumn("run_name", F.lit("dense")))
    return _run(fusion.rerank(fusion.union_candidates(lists, ["lexical", "dense"], 40), t, docs, 20))


# --- time and query understanding


@query
def evaluation_times(s, d):
    """When ages are taken for each snapshot of the corpus, and without one."""
    docs = written(td.corpus(s, d), "docs")
    names = [*snapshot_names(table(s, d, "document_snapshots")), None]
    return s.createDataFrame([(n, evaluation_time(docs, n)) for n in names], "snapshot_id string, at_s long")


@query
def doc_ages(s, d):
    pub = age_days(AT, F.col("published_s"))
    upd = age_days(AT, F.coalesce("updated_s", "published_s"))
    return td.corpus(s, d).select("doc_id", F.round(pub, 6).alias("age_days"), F.round(upd, 6).alias("update_age_days"), F.round(decay(pub, 90), 6).alias("recency"), F.round(decay(upd, 90), 6).alias("update_score"), F.round(maturity(pub, 365), 6).alias("foundation"))


@query
def lexical_novelty(s, d):
    docs, t = td.viewed(s, d, keep=True), td.topics(s, d)
    words = cues.token_set(F.coalesce("text", F.lit("")))  # each text is split once, not for each of its pairs
    top = lexical.bm25(docs, t, 10).join(docs.select("doc_id", words.alias("d")), "doc_id").join(bounded(t.select("query_id", words.alias("q"))), "query_id")
    return top.select("query_id", "doc_id", F.round(cues.novelty(F.col("q"), F.col("d")), 6).alias("novelty"))


@query
def intent_labels(s, d):
    x = cues.intent_scores(F.col("text"))
    soft = cues.softmax(x)
    return td.all_topics(s, d).select("query_id", cues.intent_label(x).alias("intent"), *(F.round(v, 6).alias(f"p_{k}") for k, v in soft.items()))


@query
def evidence_route(s, d):
    t = F.col("text")
    return td.all_topics(s, d).select("query_id", cues.asks_time(t).alias("time_cue"), cues.asks_citations(t).alias("citation_cue"), cues.evidence_route(t).alias("route"))


def _base(s, d, k=1000):
    docs = td.viewed(s, d, keep=True)
    return written(lexical.bm25(docs, td.topics(s, d), k), "run"), docs


def _overlay_docs(s, d, docs):
    docs = docs.select("doc_id", "text", "published_s", "updated_s", "year")
    c = td.citation_counters(s, d)
    sig = cit.signals({k: F.col(k) for k in c.columns if k != "doc_id"})
    out = docs.join(c, "doc_id", "left").withColumns({f"sig_{k}": v for k, v in sig.items()})
    return out.withColumn("total_in", F.greatest("total_in", "nonself_in"))


@query
def query_profile(s, d):
    base, docs = _base(s, d, Settings().profile_top)  # a profile is of these ranks alone
    p = query_profiles(base, td.topics(s, d), _overlay_docs(s, d, docs), Settings())
    return p.select("query_id", *r6("entropy", "old_share", "cited_share"), "span", "alpha", "beta", "route")


# --- citations


@query
def iso_duration(s, d):
    return td.citation_rows(s, d).select("id", iso_duration_days(F.col("timespan")).alias("days"))


CUT = 1735689599  # 2024-12-31T23:59:59Z


@query
def citation_degrees(s, d):
    return cit.citation_counts(cit.edges(td.citation_rows(s, d)), CUT).withColumn("mean_lag", F.round("mean_lag", 6))


@query
def citation_features(s, d):
    return cit.citation_features(cit.citation_counts(cit.edges(td.citation_rows(s, d)), CUT)).select("doc_id", *r6("recent_ratio", "velocity", "foundational", "emerging"))


# --- overlay


def _overlay(mode: str):
    def f(s: SparkSession, d: str) -> DataFrame:
        base, docs = _base(s, d)
        return overlay(base, td.topics(s, d), _overlay_docs(s, d, docs), AT, Settings(mode=mode), numbered=True).select("query_id", "doc_id", *r6("score"), "rank")

    f.__name__ = f"overlay_{mode}"
    return f


for _m in ("direct", "citation_only", "router", "additive"):
    query(_overlay(_m))


# --- slices


def _three(s, d):
    docs = td.corpus(s, d).select("doc_id", "published_s", "month")
    return docs, td.runs(s, d), td.qrels(s, d)


POINTS, LATER_POINTS = slicing.cutoffs(WINDOW_START, WINDOW_END), slicing.cutoffs(AFTER, WINDOW_END)


@query
def month_split_eval(s, d):
    return slicing.by_month(*_three(s, d), METRICS)


@query
def cumulative_eval(s, d):
    return slicing.cumulative(*_three(s, d), POINTS, METRICS)


@query
def frozen_index_eval(s, d):
    return slicing.frozen(*_three(s, d), LATER_POINTS, FROZEN, METRICS)


@query
def reindex_scenarios(s, d):
    return slicing.scenarios(*_three(s, d), POINTS, BASELINE, WINDOW_END, ["ndcg_cut_10", "recall_100"])


# --- reports


def _by_snapshot(s, d):
    scores = per_query(td.runs(s, d, "snapshot_id"), td.qrels(s, d), ["ndcg_cut_10", "map"], keys=("run_name", "snapshot_id"))
    return mean_metrics(scores, ["ndcg_cut_10", "map"], keys=("run_name", "snapshot_id")).withColumnRenamed("run_name", "method")


@query
def snapshot_deltas(s, d):
    pairs = [("snapshot-2", "snapshot-1"), ("snapshot-3", "snapshot-2"), ("snapshot-3", "snapshot-1")]
    return reports.snapshot_deltas(_by_snapshot(s, d), ["ndcg_cut_10", "map"], pairs).withColumns({c: F.round(c, 6) for c in ("old_value", "new_value", "delta", "pct")})


@query
def method_snapshot_pivot(s, d):
    names, metrics = snapshot_names(table(s, d, "search_results")), ["ndcg_cut_10", "map"]
    p = reports.method_snapshot_pivot(_by_snapshot(s, d), metrics, names)
    return p.select("method", *(F.col(f"`{n}_{m}`").alias(f"s{i}_{m}") for i, n in enumerate(names, 1) for m in metrics))


@query
def method_cube(s, d):
    return reports.cube_summary(_by_snapshot(s, d), "ndcg_cut_10")


@query
def model_comparison(s, d):
    rows = per_query(td.runs(s, d), td.qrels(s, d), METRICS)
    rows = mean_metrics(rows, METRICS).withColumnRenamed("run_name", "method").withColumn("qrels_variant", F.lit("all"))
    w = Window.partitionBy("qrels_variant").orderBy(F.desc("ndcg_cut_10"), "method")
    return reports.comparison(rows.withColumn("place", F.row_number().over(w)), "ndcg_cut_10", "qrels_variant")


@query
def temporal_change(s, d):
    rows = slicing.by_month(*_three(s, d), ["ndcg_cut_10"]).withColumnsRenamed({"run_name": "model", "slice": "split_name"})
    steps = [("march_only", "march_april"), ("march_april", "march_april_may"), ("march_only", "march_april_may")]
    out = reports.temporal_change(rows, "ndcg_cut_10", LEX, steps)
    return out.select("transition", "model", *r6("earlier_score", "later_score", "arp", "marp", "ri", "dri", "er"))


@query
def rank_stability(s, d):
    runs = td.runs(s, d, "snapshot_id")
    runs = numbered(runs, snapshot_names(table(s, d, "document_snapshots"))).withColumnRenamed("snap_no", "snapshot_no")
    w = Window.partitionBy("run_name", "snapshot_no", "query_id").orderBy(F.desc("score"), "doc_id")
    return reports.rank_stability(runs.withColumn("rank", F.row_number().over(w)).where("rank <= 10"))


# --- drift


def _docs(s, d):
    return td.corpus(s, d).select("doc_id", "published_s")


@query
def daily_counts_velocity(s, d):
    return drift.daily_counts(_docs(s, d))


@query
def weekly_drift(s, d):
    return drift.weekly(_docs(s, d), WINDOW_END)


@query
def collection_summary(s, d):
    docs = _docs(s, d)
    return drift.summary(docs, drift.weekly(docs, WINDOW_END))


def _decided(s, d):
    return drift.decisions(drift.weekly(_docs(s, d), WINDOW_END), None, drift.Thresholds(staleness=0.8, coverage=0.03, gap_growth=20, velocity=1.5))


@query
def trigger_decisions(s, d):
    return _decided(s, d)


@query
def latest_actionable(s, d):
    return drift.latest_actionable(_decided(s, d))


@query
def index_versions(s, d):
    return drift.index_versions(_decided(s, d), "2025-03-31", "2025-11-30")


@query
def index_membership(s, d):
    return drift.membership(_docs(s, d), drift.index_versions(_decided(s, d), "2025-03-31", "2025-11-30"), "2025-03-31", AT)


@query
def streaming_weekly_counts(s, d):
    from tidewater.streaming.weekly import run_available

    schema = table(s, d, "events").schema
    return run_available(s, f"{d}/events.parquet", schema, "weekly_counts")


QUERIES = Q
