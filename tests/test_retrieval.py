"""Retrieval, fusion, evaluation, overlay, slices and drift by hand."""

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewater.functions import cues
from tidewater.functions.dates import iso_duration_days, parse_seconds
from tidewater.operators import citations as cit
from tidewater.operators import dense, drift, evaluation, fusion, lexical, reports, slicing
from tidewater.operators.evaluation import mean_metrics, per_query
from tidewater.operators.overlay import Settings, evaluation_time, overlay, query_profiles, year_entropy


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_dates(spark):
    p = lambda t, m="lenient": one(spark, parse_seconds(F.lit(t), m))
    assert p("1970-01-02") == 86400 == p("1970-01-02T00:00:00Z") == p("1970-01-02T02:00:00+02:00") == p("19700102")
    assert p("1970-02") == 31 * 86400 and p("1971") == 365 * 86400
    assert p("1970-02", "iso") is None and p("1971", "edge") is None and p("19700102", "edge") is None and p("2020-13-01") is None and p("") is None
    d = lambda t: one(spark, iso_duration_days(F.lit(t)))
    assert d("P1Y2M3D") == 428 and d("P") == 0 and d("-P1Y") is None and d("P1YT2H") is None and d("") is None


def docs(spark):
    return spark.createDataFrame([("a", "the cat sat"), ("b", "the cat cat"), ("c", ""), ("d", None), ("e", "the dog")], "doc_id string, text string")


def test_bm25_by_hand(spark):
    q = spark.createDataFrame([("q", "cat Cat"), ("n", "zebra")], "query_id string, text string")
    got = {r.doc_id: (r.score, r["rank"]) for r in lexical.bm25(docs(spark), q, 10).collect()}
    idf, avg = math.log(1 + (5 - 2 + 0.5) / 2.5), 8 / 5
    term = lambda tf, n: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg))
    assert got.keys() == {"a", "b"} and got["b"][1] == 1
    assert got["a"][0] == pytest.approx(2 * term(1, 3)) and got["b"][0] == pytest.approx(2 * term(2, 3))  # a repeated word counts twice


def test_bm25_of_nothing(spark):
    q = spark.createDataFrame([], "query_id string, text string")
    assert rows(lexical.bm25(docs(spark), q, 10)) == []
    assert rows(lexical.bm25(docs(spark).limit(0), spark.createDataFrame([("q", "cat")], "query_id string, text string"), 10)) == []


def texts(n):
    """Texts of few words, so that many scores tie."""
    return [(f"d{(i * 7919) % 1000:03d}", " ".join(["cat", "dog", "sat", "eel"][(i >> j) % 4] for j in range(i % 6))) for i in range(n)]


def by_hand(texts, topics, k, weights=None):
    """The ranking that BM25's formula gives, pair by pair."""
    n, avg = len(texts), sum(len(t.split()) for _, t in texts) / len(texts)
    df = lambda w: sum(w in t.split() for _, t in texts)
    idf = {w: math.log1p((n - df(w) + 0.5) / (df(w) + 0.5)) for _, q in topics for w in q.split()}
    out = set()
    for q, query in topics:
        scores = [(d, sum(idf[w] * t.split().count(w) * 2.5 / (t.split().count(w) + 1.5 * (0.25 + 0.75 * len(t.split()) / avg)) for w in query.split())) for d, t in texts]
        best = sorted((-round(x, 8), d) for d, x in scores if x > 0)[:k]
        out |= {(q, d, rank, -x) for rank, (x, d) in enumerate(best, 1)}
    return out


TOPICS = [("p", "cat eel"), ("q", "dog"), ("r", "sat sat cat"), ("s", "zebra")]


def searched(spark, run):
    return {(r.query_id, r.doc_id, r["rank"], round(r.score, 8)) for r in run.collect()}


@pytest.mark.parametrize("small", [{}, {"CHUNK": 16}, {"CHUNK": 16, "GROUP_BYTES": 400}, {"WEIGHT_ROWS": 2}, {"CHUNK": 8, "BLOCK": 1}])
def test_bm25_in_chunks_and_blocks(spark, monkeypatch, small):
    from tidewater.operators import packed

    for name, value in small.items():
        monkeypatch.setattr(packed, name, value)
    t = spark.createDataFrame(TOPICS, "query_id string, text string")
    d = spark.createDataFrame(texts(150), "doc_id string, text string").repartition(2)
    for k in (3, 20, 1000):
        assert searched(spark, lexical.bm25(d, t, k)) == by_hand(texts(150), TOPICS, k)


def test_bm25_pairs_are_no_rows(spark):
    """Blocks of queries meet chunks of documents; only the best of each query leave a task."""
    t = spark.createDataFrame(TOPICS, "query_id string, text string")
    plan = lexical.bm25(spark.createDataFrame(texts(50), "doc_id string, text string"), t, 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Aggregate" not in plan


def test_merged_index_equals_rebuilt(spark):
    t = lexical.tokenized(docs(spark))
    df, stats = lexical.merged_stats(t.where("doc_id in ('a', 'c')"), t.where("doc_id not in ('a', 'c')"))
    assert rows(df) == rows(lexical.document_frequencies(lexical.postings(t)))
    assert rows(stats) == rows(lexical.collection_stats(t))


def test_rm3_weights_sum_to_one(spark):
    q = spark.createDataFrame([("q", "cat")], "query_id string, text string")
    w = {r.term: r.weight for r in lexical.expanded_terms(lexical.tokenized(docs(spark)), q).collect()}
    assert sum(w.values()) == pytest.approx(1) and max(w, key=w.get) == "cat"


RUNS = "run_name string, query_id string, doc_id string, score double, rank int"


def test_fusion(spark):
    r = spark.createDataFrame([("x", "q", "a", 3.0, 1), ("x", "q", "b", 2.0, 0), ("x", "q", "c", 1.0, 2), ("y", "q", "b", 9.0, 1), ("y", "q", "d", 9.0, None)], RUNS)
    ranked = fusion.ranked_runs(r)
    assert [(x.doc_id, x["rank"]) for x in ranked.where("run_name = 'x'").orderBy("rank").collect()] == [("a", 1), ("c", 2), ("b", 3)]  # no positive rank: last
    got = [(x.doc_id, round(x.score, 6)) for x in fusion.rrf(ranked).orderBy("rank").collect()]
    assert got == [("b", round(1 / 63 + 1 / 61, 6)), ("a", round(1 / 61, 6)), ("c", round(1 / 62, 6)), ("d", round(1 / 62, 6))]
    assert [x.doc_id for x in fusion.union_candidates(ranked, ["y", "x"]).orderBy("rank").collect()] == ["b", "d", "a", "c"]


def test_fusion_of_whole_runs(spark, tmp_path):
    from tidewater.plans import retrieval_queries as q

    lists = {q.LEX: range(1200), q.DENSE: range(1199, -1, -1)}
    rank = {(name, i): n for name, ids in lists.items() for n, i in enumerate(ids, 1)}
    spark.createDataFrame([(name, "q", f"d{i:04d}", 2000.0 - n, n) for (name, i), n in rank.items()], RUNS).write.parquet(str(tmp_path / "search_results.parquet"))
    assert q.ranked_runs(spark, str(tmp_path)).count() == 2400
    got = {r.doc_id: r.score for r in q.rrf_two(spark, str(tmp_path)).collect()}
    assert len(got) == 1000
    assert got["d0000"] == pytest.approx(1 / 61 + 1 / 1260, abs=1e-8)


def test_rerank_and_splice(spark):
    q = spark.createDataFrame([("q", "dog the the")], "query_id string, text string")
    base = spark.createDataFrame([("q", "a", 9.0, 1), ("q", "x", 8.0, 2), ("q", "e", 7.0, 3), ("q", "c", 6.0, 4)], "query_id string, doc_id string, score double, rank int")
    head = fusion.rerank(base.where("rank <= 3"), q, docs(spark), 3)
    assert [(r.doc_id, r.score) for r in head.orderBy("rank").collect()] == [("e", 2.0), ("a", 1.0)]  # x isn't in the corpus
    assert [r.doc_id for r in fusion.splice(base, head, 10).orderBy("rank").collect()] == ["e", "a", "x", "c"]


def test_metrics_by_hand(spark):
    r = spark.createDataFrame([("x", "q", "a", 3.0, 1), ("x", "q", "b", 2.0, 2), ("x", "q", "c", 1.0, 3), ("x", "other", "a", 1.0, 1)], RUNS)
    j = spark.createDataFrame([("q", "b", 2), ("q", "z", 1), ("q", "a", 0), ("none", "a", 1), ("zero", "a", 0)], "query_id string, doc_id string, relevance int")
    m = ["ndcg_cut_10", "map", "recall_100", "recip_rank_cut_10"]
    got = {x.query_id: [x[c] for c in m] for x in evaluation.per_query(r, j, m).collect()}
    assert got["q"] == pytest.approx([(3 / math.log2(3)) / (3 + 1 / math.log2(3)), 0.25, 0.5, 0.5])
    assert got["none"] == got["zero"] == [0, 0, 0, 0] and "other" not in got
    trec = {x.query_id: x.ndcg_cut_10 for x in evaluation.per_query(r, j, m, preset="trec").collect()}
    assert trec.keys() == {"q"} and trec["q"] == pytest.approx((2 / math.log2(3)) / (2 + 1 / math.log2(3)))
    with pytest.raises(ValueError):
        evaluation.metric("precision_5")


def test_metrics_of_whole_runs(spark):
    r = spark.createDataFrame([("x", "q", f"d{i:04d}", 2000.0 - i, i) for i in range(1, 1201)], RUNS)
    j = spark.createDataFrame([("q", "d1100", 1)], "query_id string, doc_id string, relevance int")
    for preset in ("builtin", "trec"):
        assert evaluation.per_query(r, j, ["map"], preset=preset).first()["map"] == pytest.approx(1 / 1100)
        assert evaluation.per_query(r, j, ["map"], preset=preset, depth=1000).first()["map"] == 0


def test_latest_judgment_wins(spark):
    j = spark.sql("select * from values ('q', 'a', 1, timestamp '2025-01-01'), ('q', 'a', null, timestamp '2025-02-01'), ('q', 'b', 2, timestamp '2025-01-01') t(query_id, doc_id, relevance, judged_at)")
    assert rows(evaluation.latest_qrels(j)) == [("q", "a", 0), ("q", "b", 2)]


def test_cues(spark):
    route = lambda t: one(spark, cues.evidence_route(F.lit(t)))
    assert route("latest neural retrieval updates in 2026") == "temporal"
    assert route("seminal influential retrieval papers") == "citation"
    assert route("recent survey comparing retrieval benchmarks") == "mixed"
    assert route(None) == "temporal"
    intent = lambda t: one(spark, cues.intent_label(cues.intent_scores(F.lit(t))))
    assert intent("plain words") == "foundational" and intent("plain words?") == "survey" and intent("latest state of the art") == "current" and intent("how has it changed") == "evolving"
    soft = spark.range(1).select(*(v.alias(k) for k, v in cues.softmax(cues.intent_scores(F.lit("trend"))).items())).first()
    assert sum(soft) == pytest.approx(1)
    assert one(spark, cues.lexical_novelty(F.lit("a"), F.lit(""))) == 0
    assert one(spark, cues.lexical_novelty(F.lit("a"), F.lit("a recent novel"))) == pytest.approx(0.4 + 0.1 * 2 / 3)


def test_entropy_and_profiles(spark):
    y = spark.createDataFrame([("q", 2020), ("q", 2020), ("q", 2021), ("p", 2020), ("n", None)], "query_id string, year int")
    got = {r.query_id: r.entropy for r in year_entropy(y).collect()}
    p = [2 / 3, 1 / 3]
    assert got["q"] == pytest.approx(-sum(x * math.log(x) for x in p) / math.log(2)) and got["p"] == 0 and "n" not in got
    run = spark.createDataFrame([("q", d, 1.0, i) for i, d in enumerate("abc", 1)], "query_id string, doc_id string, score double, rank int")
    d = spark.createDataFrame([("a", 2015, 20), ("b", 2016, 20), ("c", 2025, 0)], "doc_id string, year int, total_in int")
    t = spark.createDataFrame([("q", "retrieval")], "query_id string, text string")
    r = query_profiles(run, t, d, Settings()).first()
    assert (r.span, r.beta, r.route) == (10, 0.12, "citation") and r.old_share == pytest.approx(2 / 3)
    assert query_profiles(run, t.withColumn("text", F.lit("latest updates in 2026")), d, Settings()).first().alpha == 0.25
    assert query_profiles(run, t.withColumn("text", F.lit("seminal retrieval benchmark")), d, Settings()).first().beta == 0.25


def test_overlay(spark):
    run = spark.createDataFrame([("q", "a", 9.0, 1), ("q", "x", 8.0, 2), ("q", "b", 7.0, 3), ("q", "t", 6.0, 4), ("gone", "a", 1.0, 1)], "query_id string, doc_id string, score double, rank int")
    sig = {f"sig_{c}": F.lit(0.0) for c in cit.SIGNALS}
    d = spark.createDataFrame([("a", "words", 0, 0, 2020, 0), ("b", "words", 86400 * 300, None, 2021, 0)], "doc_id string, text string, published_s long, updated_s long, year int, total_in int").withColumns(sig)
    t = spark.createDataFrame([("q", "latest words")], "query_id string, text string")
    for mode in ("direct", "citation_only", "router", "additive"):
        got = overlay(run, t, d, 86400 * 300, Settings(mode=mode, head=3)).orderBy("rank").collect()
        assert {r.doc_id for r in got} == {"a", "x", "b", "t"} and [r["rank"] for r in got] == [1, 2, 3, 4] and got[-1].doc_id == "t" and got[-1].score == 6.0
        assert {r.doc_id: r.score for r in got}["x"] == pytest.approx(0.5)  # not in the corpus: its relevance alone
        if mode == "citation_only":
            assert [r.doc_id for r in got] == ["a", "x", "b", "t"]  # no citations: the order stays
    hints = spark.createDataFrame([("q", "b", 5.0), ("q", "x", 5.0)], "query_id string, doc_id string, boost double")
    assert overlay(run, t, d, 86400 * 300, Settings(head=3), hints=hints).orderBy("rank").first().doc_id == "b"
    low = overlay(run, t, d, 86400 * 300, Settings(head=3, tail="rescale")).orderBy("rank").collect()
    assert all(x.score >= y.score for x, y in zip(low, low[1:]))
    with pytest.raises(ValueError):
        overlay(run, t, d, 0, Settings(mode="other"))


def test_citations(spark):
    raw = spark.createDataFrame([("1", "", "", "2024-01-01", "P1Y", "True", "", "a", "b"), ("2", "", "", "2024-06-01", "", "false", "FALSE", "c", "b"), ("3", "", "", "2024-05", "P1Y", "", "", "c", "b"), ("4", "", "", "2030-01-01", "P1Y", "", "", "c", "b")], "id string, citing string, cited string, creation string, timespan string, journal_sc string, author_sc string, citing_doc_id string, cited_doc_id string")
    c = {r.doc_id: r for r in cit.citation_features(cit.citation_counts(cit.edges(raw), 1719792000)).collect()}  # 2024-07-01
    b = c["b"]
    assert (b.total_in, b.recent_in, b.nonself_in, b.nonself_recent_in, b.mean_lag) == (2, 1, 1, 1, 365.0) and (c["a"].total_out, c["a"].recent_out) == (1, 0)
    assert b.recent_ratio == 0.5 and b.foundational == pytest.approx(math.log(3) / 2) and b.emerging == pytest.approx(math.log(2) / 2)


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(7)], "id long, vec array<float>")
    got = dense.exact_search(v, v.where("id = 0"), 3, size=2).orderBy("rank").collect()
    cos = sorted(((1 + 0) / math.sqrt((i % 3) ** 2 + 1 + i * i), -i) for i in range(1, 7))[::-1][:3]
    assert [r.doc_id for r in got] == [-i for _, i in cos] and [r.score for r in got] == pytest.approx([s for s, _ in cos])
    h = dense.hash_embedding(docs(spark), "doc_id")
    assert {r.doc_id: round(r.n, 6) for r in h.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()} == {"a": 1, "b": 1, "e": 1}


@pytest.mark.parametrize("numbers", [4_000_000, 256])
def test_hash_search_is_every_pair(spark, monkeypatch, numbers):
    """Also where few documents have a component in common with the query, or only opposite ones."""
    monkeypatch.setattr(dense, "QUERY_NUMBERS", numbers)
    t, d = spark.createDataFrame([*TOPICS, ("n", None)], "query_id string, text string"), spark.createDataFrame([*texts(60), ("x", None), ("y", "w1 w2 w3 w4 w5 w6")], "doc_id string, text string").repartition(2)
    v = {key: dense.hash_embedding(x, key) for x, key in ((d, "doc_id"), (t, "query_id"))}
    pairs = v["doc_id"].join(v["query_id"].withColumnRenamed("weight", "qw"), "bucket").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))
    for k in (5, 100):
        got = dense.hash_search(d, t, k)
        assert searched(spark, got) == searched(spark, lexical.top_k(pairs, k))
        assert "SortMergeJoin" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" not in plan and "MapInArrow" in plan


def test_month_split_of_all_months_is_everything(spark):
    d = spark.createDataFrame([("a", 1, 3), ("b", 2, 4), ("u", None, None)], "doc_id string, published_s long, month int")
    r = spark.createDataFrame([("x", "q", "a", 2.0, 1), ("x", "q", "b", 1.0, 2)], RUNS)
    j = spark.createDataFrame([("q", "b", 1), ("p", "a", 1), ("w", "u", 1)], "query_id string, doc_id string, relevance int")
    got = {x.slice: x for x in slicing.by_month(d, r, j, ["map"], {"all": tuple(range(1, 13)), "march": (3,), "july": (7,)}).collect()}
    assert (got["all"].n_queries, got["all"].n_docs, got["all"].map) == (2, 2, 0.25)
    assert (got["march"].n_queries, got["march"].n_docs, got["march"].map) == (1, 1, 0.0)
    assert (got["july"].n_queries, got["july"].n_docs, got["july"].map) == (0, 0, 0.0)


def test_reports(spark):
    m = spark.createDataFrame([("pivot", "e", 0.5), ("pivot", "l", 0.5), ("x", "e", 0.0), ("x", "l", 0.3), ("y", "e", 0.4), ("y", "l", 0.2)], "model string, split_name string, v double")
    got = {r.model: r for r in reports.temporal_change(m, "v", "pivot", [("e", "l")]).collect()}
    assert got["x"].ri == 0 and got["y"].ri == pytest.approx(0.5) and got["y"].er == pytest.approx(0.5 / 1e-9)
    s = spark.createDataFrame([("x", "s1", 0.0), ("x", "s2", 0.5)], "method string, snapshot_id string, v double")
    r = reports.snapshot_deltas(s, ["v"], [("s2", "s1")]).first()
    assert r.delta == 0.5 and r.pct is None


def test_drift(spark):
    day = 86400
    monday = 4 * day  # 1970-01-05
    d = spark.createDataFrame([("a", monday), ("b", monday + 6 * day + 3600), ("c", monday + 100 * day), ("u", None)], "doc_id string, published_s long")
    w = {r.week_start: r for r in drift.weekly(d, monday + 200 * day).collect()}
    first = w["1970-01-05"]
    assert (first.new_docs, first.total_docs, first.stale_docs) == (2, 1, 0)  # b came on Sunday after 00:00
    last = w["1970-04-13"]
    assert (last.total_docs, last.stale_docs, last.staleness_rate) == (3, 2, 0.6667)
    assert drift.daily_counts(d).count() == 3
    s = drift.summary(d, drift.weekly(d, 0)).first()
    assert (s.n_docs, s.n_undated, s.span_days) == (4, 1, 100)
    dec = drift.decisions(drift.weekly(d, monday + 200 * day), None, drift.Thresholds(staleness=0.5)).orderBy("week_start").collect()
    assert [r.level for r in dec] == [0, 1] and dec[1].reason == "stale_and_uncovered"


def test_sustained_drop_survives_gaps(spark):
    weeks = spark.createDataFrame([(f"2025-01-{i:02d}", 1, i, i, 0, 0.0, 0) for i in range(1, 7)], "week_start string, new_docs long, cumulative_docs long, total_docs long, stale_docs long, staleness_rate double, gap_days long")
    st = spark.createDataFrame([("2025-01-01", 0.3), ("2025-01-02", 0.3), ("2025-01-04", 0.3), ("2025-01-06", 0.1)], "week_start string, rank_stability_drop double")
    got = [r.level for r in drift.decisions(weeks, st).orderBy("week_start").collect()]
    assert got == [0, 0, 0, 3, 3, 0]


def test_versions_and_membership(spark):
    dec = spark.createDataFrame([("2025-03-24", 2, "r", "x"), ("2025-04-07", 2, "r", "x"), ("2025-04-14", 1, "s", "x"), ("2025-06-02", 3, "f", "x"), ("2025-06-09", 3, "f", "x")], "week_start string, level int, action string, reason string")
    v = drift.index_versions(dec, "2025-03-31", "2025-05-31")
    assert [(r.index_no, r.cutoff, r.previous_cutoff) for r in v.orderBy("index_no").collect()] == [(0, "2025-03-31", None), (1, "2025-04-13", "2025-03-31"), (2, "2025-06-08", "2025-04-13")]
    at = lambda t: one(spark, parse_seconds(F.lit(t)))
    d = spark.createDataFrame([("a", at("2025-03-31T23:59:59Z")), ("b", at("2025-04-01T00:00:00Z")), ("c", at("2025-06-08T23:59:59Z")), ("late", at("2025-07-01")), ("u", None)], "doc_id string, published_s long")
    got = {r.doc_id: (r.index_no, r.in_baseline, r.days_after) for r in drift.membership(d, v, "2025-03-31", at("2025-12-31")).collect()}
    assert got == {"a": (0, True, 0), "b": (1, False, 1), "c": (2, False, 69)}


def test_pivot_has_every_snapshot(spark, tmp_path):
    from tidewater.plans import retrieval_queries as q

    spark.createDataFrame([("x", f"snapshot-{i}", "q", "a" if i == 3 else "b", 1.0, 1) for i in (1, 2, 3)], "run_name string, snapshot_id string, query_id string, doc_id string, score double, rank int").write.parquet(str(tmp_path / "search_results.parquet"))
    spark.sql("select 'q' query_id, 'a' doc_id, 1 relevance, timestamp '2025-01-01' judged_at").write.parquet(str(tmp_path / "qrels.parquet"))
    got = q.method_snapshot_pivot(spark, str(tmp_path))
    assert got.columns == ["method", *(f"s{i}_{m}" for i in (1, 2, 3) for m in ("ndcg_cut_10", "map"))]
    assert rows(got) == [("x", 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)]


def test_boosts_pass_gate_and_route(spark):
    """A hint counts in the temporal score: as it is in direct mode, times alpha in additive mode, not at all where only citations count or the gate is shut."""
    sig = {f"sig_{k}": F.lit(0.0) for k in cit.SIGNALS}
    run = spark.createDataFrame([("q", "a", 9.0, 1), ("q", "b", 1.0, 2), ("q", "c", 5.0, 3)], "query_id string, doc_id string, score double, rank int")
    d = spark.createDataFrame([(x, "words", None, None, None, 0) for x in "abc"], "doc_id string, text string, published_s long, updated_s long, year int, total_in int").withColumns(sig)
    t = spark.createDataFrame([("q", "latest words")], "query_id string, text string")
    hints = spark.createDataFrame([("q", "b", 2.0), ("q", "c", 2.0)], "query_id string, doc_id string, boost double")
    score = lambda mode, h=None: {r.doc_id: r.score for r in overlay(run, t, d, 0, Settings(mode=mode), hints=h).collect()}
    gained = lambda mode: {k: round(v - score(mode)[k], 9) for k, v in score(mode, hints).items()}
    assert gained("direct") == {"a": 0.0, "b": 2.0, "c": 2.0}
    assert gained("additive") == {"a": 0.0, "b": 0.0, "c": 0.5}  # b is under the gate; alpha is 0.25
    assert gained("citation_only") == {"a": 0.0, "b": 0.0, "c": 0.0}
    assert gained("router") == {"a": 0.0, "b": 0.0, "c": 0.5}


def test_share_of_old_documents_is_of_dated_ones(spark):
    run = spark.createDataFrame([("q", x, 1.0, i) for i, x in enumerate("abcd", 1)], "query_id string, doc_id string, score double, rank int")
    d = spark.createDataFrame([("a", 2025, 0), ("b", 2010, 30), ("c", None, 0)], "doc_id string, year int, total_in int")
    p = query_profiles(run, spark.createDataFrame([("q", "words"), ("n", "no run")], "query_id string, text string"), d, Settings())
    got = {r.query_id: r for r in p.collect()}
    assert got["q"].old_share == 0.5 and got["q"].cited_share == 0.25 and got["q"].span == 15 and got["q"].beta == 0.12


def test_evaluation_time(spark):
    at = lambda t: one(spark, parse_seconds(F.lit(t)))
    d = spark.createDataFrame([(at("2020-01-01"), at("2019-01-01"), None), (None, None, at("2021-05-05"))], "published_s long, created_s long, updated_s long")
    assert evaluation_time(d, "snapshot-2") == at("2025-08-31T23:59:59Z") and evaluation_time(d, "snapshot-2", "2024-02-02") == at("2024-02-02")
    assert evaluation_time(d, "other") == at("2021-05-05") and evaluation_time(d, "snapshot-2", by="latest") == at("2021-05-05")
    assert evaluation_time(d, s=Settings(use_update=False, use_creation=True)) == at("2019-01-01")
    assert evaluation_time(d.limit(0)) > at("2025-01-01")


def test_cutoffs_end_their_step():
    day = 86400
    assert slicing.cutoffs(0, 20 * day, 7) == [("1970-01-07", 6 * day), ("1970-01-14", 13 * day), ("1970-01-21", 20 * day)]
    assert slicing.cutoffs(0, 5 * day) == []


def test_growing_slices_against_one_at_a_time(spark):
    """Ranks by running counts equal those of filtered runs that are ranked anew."""
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(f"d{i}", int(rng.integers(0, 40)) if i % 9 else None) for i in range(60)], "doc_id string, published_s long")
    r = spark.createDataFrame([(run, f"q{q}", f"d{i}", float(rng.integers(0, 12)), 1) for run in "xy" for q in range(6) for i in rng.choice(60, 25, replace=False)], RUNS)
    j = spark.createDataFrame([(f"q{q}", f"d{i}", int(rng.integers(0, 3))) for q in range(7) for i in rng.choice(60, 8, replace=False)], "query_id string, doc_id string, relevance int")
    metrics, points = ["ndcg_cut_10", "map", "recall_100", "recip_rank_cut_10"], [("a", 5), ("b", 17), ("c", 39)]
    got = {(x.slice, x.run_name): x for x in slicing.cumulative(d, r, j, points, metrics).collect()}
    for name, cut in points:
        inside = d.where(F.col("published_s") <= cut).select("doc_id")
        some = j.join(inside, "doc_id")
        for x in mean_metrics(per_query(r.join(inside, "doc_id"), some, metrics), metrics).collect():
            assert [got[name, x.run_name][m] for m in ("n_queries", *metrics)] == pytest.approx([x[m] for m in ("n_queries", *metrics)], abs=1e-6)


def test_split_plan(tmp_path):
    assert slicing.split_plan() == slicing.SplitPlan({"train_months": (3, 4), "validation_months": (5,)})
    (tmp_path / "p.yaml").write_text("monthly_split: {date_field: createdDate, minimum_qrels_per_query: 2, train_months: [1]}\n")
    assert slicing.split_plan(tmp_path / "p.yaml") == slicing.SplitPlan({"train_months": (1,), "validation_months": (5,)}, "createdDate", 2)
    (tmp_path / "p.yaml").write_text("splits: [{name: all, months: [3, 4, 5]}]\n")
    assert slicing.split_plan(tmp_path / "p.yaml").splits == {"all": (3, 4, 5)}


def test_missing_pivot_is_an_error(spark):
    m = spark.createDataFrame([("x", "e", 0.5), ("x", "l", 0.5)], "model string, split_name string, v double")
    with pytest.raises(ValueError, match="pivot"):
        reports.temporal_change(m, "v", "pivot", [("e", "l")])


def test_cached_citation_features(spark, tmp_path):
    raw = spark.createDataFrame([("1", "", "", "2024-01-01", "P1Y", "", "", "a", "b"), ("2", "", "", "2024-06-01", "", "", "", "c", "b")], "id string, citing string, cited string, creation string, timespan string, journal_sc string, author_sc string, citing_doc_id string, cited_doc_id string")
    cut = 1719792000
    first = rows(cit.cached_features(raw, str(tmp_path), cut))
    assert len(first) == 3 and rows(cit.cached_features(raw.limit(0), str(tmp_path), cut)) == first  # read, not made
    only = spark.createDataFrame([("b",), ("z",)], "doc_id string")
    assert [r[0] for r in rows(cit.cached_features(raw, str(tmp_path), cut, only=only))] == ["b"]
    assert rows(cit.cached_features(raw.limit(0), str(tmp_path), cut, window_days=30)) == []  # other parameters, another table
    some = rows(cit.citation_counts(cit.edges(raw), cut, only=only))
    assert [r for r in rows(cit.citation_counts(cit.edges(raw), cut)) if r[0] == "b"] == some


def test_vectors_in_blocks_equal_those_of_one_matrix(spark, monkeypatch):
    v = spark.createDataFrame([(f"v{i}", [float(i % 5), 1.0, float(i % 7)]) for i in range(40)] + [("none", None)], "id string, vec array<float>")
    q = v.where("id in ('v0', 'v3', 'none')")
    whole = rows(dense.exact_search(v, q, 4))
    monkeypatch.setattr(dense, "QUERY_NUMBERS", 0)
    assert rows(dense.exact_search(v, q, 4, size=7)) == whole and len(whole) == 8
    assert rows(dense.exact_search(v, q.limit(0), 4)) == []


def test_date_queries_read_no_texts(spark):
    from tidewater.plans import retrieval_queries as rq

    for f in (rq.daily_counts_velocity, rq.collection_summary):
        plan = f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "full_text" not in plan.split("== Physical Plan ==")[1] and "abstract" not in plan.split("== Physical Plan ==")[1]


def test_stems_by_hand():
    from tidewater.functions.stem import porter

    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll as as naïve naïve".split()
    assert [(w, porter(w)) for w in pairs[::2]] == list(zip(pairs[::2], pairs[1::2]))


def test_analysed_search(spark):
    d = spark.createDataFrame([("a", "the running dogs"), ("b", "a dog runs"), ("c", "of the"), ("d", None)], "doc_id string, text string")
    t = spark.createDataFrame([("q", "the run of dogs"), ("n", None)], "query_id string, text string")
    found = lambda **k: {r.doc_id for r in lexical.bm25(d, t, 5, analysis=lexical.Analysis(**k)).collect()}
    assert found() == {"a", "c"} and found(stop=lexical.STOP_WORDS) == {"a"} and found(stop=lexical.STOP_WORDS, stem=True) == {"a", "b"}
    assert found(stop=lexical.STOP_WORDS, idf="plain") == {"a"}
    with pytest.raises(ValueError):
        found(idf="other")


def test_ties_in_the_order_of_lines(spark):
    r = spark.createDataFrame([("x", "q", "b", 1.0, 0), ("x", "q", "a", 1.0, 1)], "run_name string, query_id string, doc_id string, score double, line_no long")
    j = spark.createDataFrame([("q", "b", 1)], "query_id string, doc_id string, relevance int")
    assert per_query(r, j, ["map"], tie="line_no").first().map == 1.0 and per_query(r, j, ["map"]).first().map == 0.5


SMALL = "/root/testdata/sf0.001"


def plan_of(df, optimized=False):
    x = df._jdf.queryExecution()
    return (x.optimizedPlan() if optimized else x.executedPlan()).toString()


def overlaid(spark, mode):
    t = spark.createDataFrame([("q", "recent cat"), ("p", "dog")], "query_id string, text string")
    run = spark.createDataFrame([("q", "a", 2.0, 1), ("q", "b", 1.0, 2), ("p", "a", 1.0, 1), ("none", "a", 1.0, 1)], "query_id string, doc_id string, score double, rank int")
    d = docs(spark).selectExpr("doc_id", "text", "1.0e9 as published_s", "cast(null as long) as updated_s", "2001 as year", "1L as total_in", *(f"1.0D as sig_{n}" for n in cit.SIGNALS))
    return overlay(run, t, d, 1_700_000_000, Settings(mode=mode))


def test_overlay_additive_splits_each_text_once(spark):
    """The only split is of documents, before they meet queries; texts don't go on with the pairs."""
    got = overlaid(spark, "additive")
    assert plan_of(got, True).count("regexp_extract_all") == 1
    assert {(r.query_id, r.doc_id) for r in got.collect()} == {("q", "a"), ("q", "b"), ("p", "a")}


def test_overlay_router_splits_each_text_once(spark):
    got = overlaid(spark, "router")
    assert plan_of(got, True).count("regexp_extract_all") == 1 and got.count() == 3


def test_overlay_citation_only_reads_no_text_with_its_pairs(spark):
    got = overlaid(spark, "citation_only")
    assert "regexp_extract_all" not in plan_of(got, True) and got.count() == 3  # queries' profiles are written, texts aren't needed


def test_overlay_direct_splits_each_text_once(spark):
    got = overlaid(spark, "direct")
    assert plan_of(got, True).count("regexp_extract_all") == 1 and got.count() == 3


def test_rerank_splits_each_text_once(spark):
    t = spark.createDataFrame([("q", "dog the the")], "query_id string, text string")
    base = spark.createDataFrame([("q", "a", 9.0, 1), ("q", "e", 7.0, 2)], "query_id string, doc_id string, score double, rank int")
    got = fusion.rerank(base, t, docs(spark), 3)
    assert plan_of(got, True).count("split(") == 2 and [r.doc_id for r in got.orderBy("rank").collect()] == ["e", "a"]


def test_hybrid_rrf_rerank_without_rows_of_components(spark):
    from tidewater.plans import retrieval_queries as q

    plan = plan_of(q.hybrid_rrf_rerank(spark, SMALL), True)
    assert "bucket" not in plan and "MapInArrow" in plan and plan.count("split(") == 2  # of queries and of texts, before they meet


def test_hybrid_union_rerank_without_rows_of_components(spark):
    from tidewater.plans import retrieval_queries as q

    plan = plan_of(q.hybrid_union_rerank(spark, SMALL), True)
    assert "bucket" not in plan and "MapInArrow" in plan and plan.count("split(") == 2  # of queries and of texts, before they meet


def test_rerank_sweep_scores_each_pair_once(spark):
    from tidewater.plans import retrieval_queries as q

    assert "split(" not in plan_of(q.rerank_sweep(spark, SMALL), True)


def test_lexical_novelty_splits_each_text_once(spark):
    from tidewater.plans import retrieval_queries as q

    assert plan_of(q.lexical_novelty(spark, SMALL), True).count("regexp_extract_all") == 2  # of queries and of texts, before they meet


def test_query_profile_ranks_what_it_looks_at(spark, monkeypatch):
    from tidewater.plans import retrieval_queries as q

    depths, bm25 = [], lexical.bm25
    monkeypatch.setattr(lexical, "bm25", lambda d, t, k, *a, **o: depths.append(k) or bm25(d, t, k, *a, **o))
    assert q.query_profile(spark, SMALL).count() == q.td.topics(spark, SMALL).count()
    assert depths == [Settings().profile_top]


@pytest.mark.parametrize("most_terms", [2000, 1])
def test_stored_index_in_chunks(spark, monkeypatch, most_terms):
    from tidewater.operators import packed

    monkeypatch.setattr(packed, "CHUNK", 16)
    t, d = (spark.createDataFrame(x, f"{key} string, text string") for x, key in ((TOPICS, "query_id"), (texts(150), "doc_id")))
    tokens = lexical.tokenized(d)
    post = lexical.postings(tokens)
    got = lexical.indexed_search(post, lexical.document_frequencies(post), lexical.collection_stats(tokens), t, 20, most_terms=most_terms)
    assert "Exchange" not in plan_of(got) and searched(spark, got) == by_hand(texts(150), TOPICS, 20)


def test_rm3_terms_without_rows_of_pairs(spark):
    """Feedback documents are the best 3 by hand, and what they were found from is no shuffled pairs."""
    t, d = (spark.createDataFrame(x, f"{key} string, text string") for x, key in ((TOPICS, "query_id"), (texts(60), "doc_id")))
    best = lexical.ranked(lexical.tokenized(d), lexical.query_terms(t), 3)
    assert "Exchange" not in plan_of(best) and searched(spark, best) == by_hand(texts(60), TOPICS, 3)
    w = {}
    for r in lexical.expanded_terms(lexical.tokenized(d), t).collect():
        w[r.query_id] = w.get(r.query_id, 0) + r.weight
    assert w == pytest.approx({"p": 1, "q": 1, "r": 1, "s": 0.6})  # nothing was found for s


def test_rm3_topk_without_rows_of_pairs(spark):
    t, d = (spark.createDataFrame(x, f"{key} string, text string") for x, key in ((TOPICS, "query_id"), (texts(60), "doc_id")))
    got = lexical.rm3(d, t, 5)
    assert "Exchange" not in plan_of(got) and "MapInArrow" in plan_of(got)
    assert {r.query_id: r.n for r in got.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {"p": 5, "q": 5, "r": 5}


def test_full_text_search_without_rows_of_pairs(spark):
    from tidewater.plans import retrieval_queries as q

    assert "Exchange" not in (plan := plan_of(q.bm25_topk_ft(spark, SMALL))) and "MapInArrow" in plan


@pytest.mark.parametrize("mode", ["direct", "citation_only", "router"])
def test_overlay_of_numbered_run_ranks_heads_only(spark, mode):
    """The same rows as of a ranking of head and tail together; no tail row is shuffled for its place."""
    t = spark.createDataFrame([("q", "recent cat"), ("p", "dog seminal")], "query_id string, text string")
    run = spark.createDataFrame([(q, f"d{(i * 7 + n) % 40}", 50.0 - i // 3, i) for n, q in enumerate(("q", "p", "none")) for i in range(1, 30 + n)], "query_id string, doc_id string, score double, rank int")
    d = spark.range(30).selectExpr("concat('d', id) as doc_id", "element_at(array('recent novel cat', 'a dog', 'updated things', ''), 1 + cast(id % 4 as int)) as text", "1.6e9 + id * 3000000 as published_s", "cast(null as long) as updated_s", "2001 + cast(id % 20 as int) as year", "id % 13 as total_in", *(f"double(id % {k + 3}) as sig_{n}" for k, n in enumerate(cit.SIGNALS)))
    for tail, top, n in (("raw", 12, 24), ("rescale", 1000, 59)):
        whole, heads = (overlay(run, t, d, 1_700_000_000, Settings(mode=mode, head=8, tail=tail), top, numbered=x) for x in (False, True))
        assert whole.schema == heads.schema and rows(whole) == rows(heads) and heads.count() == n
    plan = plan_of(overlay(run, t, d, 1_700_000_000, Settings(mode=mode, head=8), numbered=True), True)
    assert plan.rindex("Window") > plan.index("Union")  # under the union: of heads


def test_novelty_of_known_words(spark):
    q, d = F.lit("a new recent"), F.lit("a recent novel latest old")
    one_ = lambda known: one(spark, cues.novelty(cues.token_set(q), cues.token_set(d), cues.novelty_words(cues.token_set(d)) if known else None))
    assert one_(True) == one_(False) == pytest.approx(0.4 + 0.1 * 3 / 5)


def heads_alone_are_ranked(plan):
    """The union of heads and tails is the outermost of the optimized plan's steps that rank, so no tail is shuffled for its place."""
    return "Window" in plan and "Window" not in plan[: plan.index("Union")]


def test_overlay_direct_keeps_tails_in_place(spark):
    from tidewater.plans import retrieval_queries as q

    assert heads_alone_are_ranked(plan_of(q.Q["overlay_direct"](spark, SMALL), True))


def test_overlay_citation_only_keeps_tails_in_place(spark):
    from tidewater.plans import retrieval_queries as q

    assert heads_alone_are_ranked(plan_of(q.Q["overlay_citation_only"](spark, SMALL), True))


def test_full_texts_travel_only_from_the_latest_rows(spark, monkeypatch):
    """Beyond the bound of broadcasts for their documents, the places of latest rows still travel as bits: a text is spread once, and joins no shuffled texts."""
    from tidewater import session
    from tidewater.sources import testdata as td

    docs = td.corpus(spark, SMALL).count()
    monkeypatch.setattr(session.bounded, "__defaults__", (None, docs // 4))
    got = td.corpus(spark, SMALL, ("title", "abstract"))
    plan = plan_of(got)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert got.count() == docs == got.select("doc_id").distinct().count()


def test_texts_are_those_of_the_latest_rows(spark, tmp_path):
    """Rows of several blocks of 64, the first and last bit of each among them, against a ranking of whole rows."""
    from pyspark.sql import Window
    from tidewater.sources import testdata as td

    data = [(f" D{i % 67}" if i % 3 else f"D{i % 67} ", f"snapshot-{1 + i * 7 % 5}", i * 31 % 400, f"t{i}") for i in range(400)] + [(" ", "snapshot-9", 1, "no"), (None, "snapshot-9", 1, "no")]
    df = spark.createDataFrame(data, "doc_id string, snapshot_id string, n long, title string").selectExpr(
        "doc_id", "snapshot_id", "title", "'x' as abstract", "'y' as full_text", "concat('2025-01-', lpad(1 + n % 28, 2, '0')) as published_date", "'2024' as created_date", "'2025-02-01' as updated_date", "timestamp_seconds(n) as delivered_at"
    )
    df.coalesce(1).write.parquet(f"{tmp_path}/document_snapshots.parquet")
    w = Window.partitionBy(F.trim("doc_id")).orderBy(F.desc("snapshot_id"), F.desc("delivered_at"))
    want = df.where("trim(doc_id) <> ''").withColumn("r", F.row_number().over(w)).where("r = 1").select(F.trim("doc_id"), "title", "published_date")
    assert rows(td.corpus(spark, str(tmp_path), ("title",)).select("doc_id", "title", "published_date")) == rows(want)
