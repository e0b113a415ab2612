"""Configurations, pipelines and the reindex loop."""

import pytest
from conftest import rows

from tidewater.operators import fusion, lexical
from tidewater.operators.overlay import Settings
from tidewater.plans import bundles, config, jobs, pipelines, reindex, vectors
from tidewater.session import clear_written, read_text, write_text, written
from tidewater.sources.writers import write_run


def test_config(tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs" / "base.yaml").write_text("name: base\nmetrics: [map, recall_100]\nretrieval: {top_k: 7, k1: 1.2}\n")
    (tmp_path / "configs" / "child.yaml").write_text("extends: base.yaml\nname: child\nmetrics: [map]\nretrieval: {k1: 2.0}\noverlay: {mode: router}\n")
    e = config.load(tmp_path / "configs" / "child.yaml")
    assert (e.name, e.metrics, e.retrieval.top_k, e.retrieval.k1, e.overlay.mode) == ("child", ("map",), 7, 2.0, "router")
    assert e.output_dir == str(tmp_path.resolve() / "outputs")
    (tmp_path / "a.yaml").write_text("extends: a.yaml\n")
    with pytest.raises(ValueError, match="itself"):
        config.load(tmp_path / "a.yaml")
    (tmp_path / "b.yaml").write_text("nmae: x\n")
    with pytest.raises(ValueError, match="nmae"):
        config.load(tmp_path / "b.yaml")


def docs(spark):
    return spark.createDataFrame([("a", "cat", "sat", ""), ("b", "dog", "sat cat cat", "bird cat"), ("c", "", "", "")], "doc_id string, title string, abstract string, full_text string")


@pytest.mark.parametrize("name", sorted(pipelines.PIPELINES))
def test_every_pipeline(spark, name):
    topics = spark.createDataFrame([("q", "cat sat"), ("n", "zzz")], "query_id string, text string")
    got = pipelines.run(docs(spark), topics, config.Experiment(retrieval=config.Retrieval(pipeline=name, top_k=5))).where("query_id = 'q'").orderBy("rank").collect()
    assert {r.doc_id for r in got} >= {"a", "b"} and [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_run_snapshots(spark, tmp_path):
    topics = spark.createDataFrame([("q", "bird")], "query_id string, text string")
    qrels = spark.createDataFrame([("q", "b", 1)], "query_id string, doc_id string, relevance int")
    e = config.Experiment(name="x", snapshots=("s1", "s2"), metrics=("map",), output_dir=str(tmp_path), retrieval=config.Retrieval(pipeline="lexical_full_text"))
    got = pipelines.run_snapshots(spark, lambda n: (docs(spark), topics, qrels if n == "s1" else None), e)
    assert [(r.snapshot_id, r.map) for r in got.collect()] == [("s1", 1.0)]
    assert "skipped" in next((tmp_path / "x" / "s2" / "metrics").glob("*.json")).read_text()
    with pytest.raises(ValueError):
        pipelines.run(docs(spark), topics, config.Experiment(retrieval=config.Retrieval(pipeline="none")))


def test_reindex_loop(spark, tmp_path):
    d = spark.createDataFrame([("a", "cat sat", 10), ("b", "dog", 20), ("c", "cat", 30)], "doc_id string, text string, published_s long")
    root, go = str(tmp_path), {"execute": True, "promote_now": True}
    step = lambda level, upto, **k: reindex.step(spark, root, d, {"level": level, "week_start": "2025-01-06"} if level else None, after_s=20, upto_s=upto, **k)
    assert step(0, 20).state == "no_action" and step(1, 20).state == "soft_alert_only" and step(2, 20).strategy == "full"
    first = step(3, 20, **go)
    assert (first.state, first.n_docs) == ("promoted", 2) and reindex.live_version(spark, root) == first.shadow
    second = step(2, 30, execute=True)
    assert (second.state, second.n_docs) == ("incremental_shadow_built", 1) and reindex.live_version(spark, root) == first.shadow
    reindex.promote(spark, root, second.shadow)
    whole = lexical.postings(lexical.tokenized(d))
    read = lambda t: spark.read.parquet(f"{root}/{reindex.live_version(spark, root)}/{t}")
    assert rows(read("postings").select(whole.columns)) == rows(whole)
    assert rows(read("frequencies")) == rows(lexical.document_frequencies(whole))
    assert rows(read("stats")) == rows(lexical.collection_stats(lexical.tokenized(d)))
    with pytest.raises(ValueError):
        reindex.promote(spark, root, "v0")


def test_written_tables_can_be_cleared(spark):
    t = written(spark.range(3))
    assert t.count() == 3
    clear_written(spark)
    with pytest.raises(Exception):
        spark.read.parquet(t.inputFiles()[0]).count()


def test_stored_index_ranks_like_texts(spark, tmp_path):
    d = docs(spark).selectExpr("doc_id", "title || ' ' || abstract || ' ' || full_text as text")
    t = spark.createDataFrame([("q", "cat sat"), ("p", "bird dog"), ("n", "zzz")], "query_id string, text string")
    root = str(tmp_path)
    with pytest.raises(ValueError, match="no live"):
        reindex.search(spark, root, t)
    reindex.build(d, root, "v1")
    reindex.promote(spark, root, "v1")
    want = rows(lexical.bm25(d, t, 5))
    found = reindex.search(spark, root, t, 5)
    assert rows(found) == want and len(want) == 3
    post, df, stats = reindex.load(spark, root)
    assert rows(lexical.indexed_search(post, df, stats, t, 5, most_terms=1)) == want  # more terms than are pushed down
    plan = post.where(post.term.isin("cat"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term" in plan or "PushedFilters: [IsNotNull(term)" in plan


def test_vector_index(spark, tmp_path):
    d = spark.createDataFrame([("a", "cat sat"), ("b", "dog"), ("c", None)], "doc_id string, text string")
    t = spark.createDataFrame([("q", "cat"), ("a", "dog")], "query_id string, text string")
    root, e = str(tmp_path), vectors.Encoder()
    assert vectors.ensure_vectors(d, root, e) == 3 and vectors.ensure_vectors(d, root, e) == 0
    more = d.unionByName(spark.createDataFrame([("d", "bird")], d.schema)).replace("dog", "cat cat", "text")
    assert vectors.ensure_vectors(more, root, e) == 2  # one is new, one has changed
    got = {(r.query_id, r["rank"]): r.doc_id for r in vectors.vector_search(spark, root, t, e, 1).collect()}
    assert got["q", 1] == "b"
    other = vectors.Encoder(version="hash-2")
    with pytest.raises(ValueError, match="hash-2"):
        vectors.vector_search(spark, root, t, other, 1)
    assert vectors.ensure_vectors(more, root, other) == 4
    assert vectors.encoder_or_hash(lambda: __import__("no_such_model")).version == "hash-1"
    prefixed = vectors.Encoder(encode=lambda x: [[float(len(v))] for v in x], dim=1, text_prefix="ab", query_prefix="c")
    assert {r.doc_id: r.vec[0] for r in vectors.encoded(d, "doc_id", prefixed).collect()} == {"a": 9.0, "b": 5.0, "c": 2.0}


def test_pair_scorer_slot(spark):
    score = vectors.pair_scorer(lambda q, t: t.str.len().astype(float))
    t = spark.createDataFrame([("q", "x")], "query_id string, text string")
    d = spark.createDataFrame([("a", "x"), ("b", "xxx")], "doc_id string, text string")
    c = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, doc_id string, rank int")
    assert [r.doc_id for r in fusion.rerank(c, t, d, 2, score).orderBy("rank").collect()] == ["b", "a"]


def _bundle(spark, judged=True):
    d = docs(spark).selectExpr("*", "'2025-05-01' publishedDate", "cast(null as string) createdDate", "'2025-05-02' updatedDate")
    t = spark.createDataFrame([("q", "latest cat")], "query_id string, text string")
    return bundles.Bundle(d, t, spark.createDataFrame([("q", "b", 1)], "query_id string, doc_id string, relevance int") if judged else None, snapshot_id="snapshot-1")


def test_run_files_are_fused_and_overlaid(spark, tmp_path):
    for name, order in (("x", "ab"), ("y", "bc")):
        write_run(spark.createDataFrame([("q", d, 2.0 - i, i + 1, "same") for i, d in enumerate(order)], "query_id string, doc_id string, score double, rank int, run_name string"), str(tmp_path / name))
    b = _bundle(spark)
    got = jobs.fuse_files(spark, [str(tmp_path / "x"), str(tmp_path / "y")], str(tmp_path / "fused"), "fused", b.qrels, ["map", "recall_100"])
    assert got == {"map": 1.0, "recall_100": 1.0}  # b stands in both lists
    assert '"stage": "complete"' in read_text(spark, str(tmp_path / "fused" / "progress.json"))
    assert "map" in next((tmp_path / "fused" / "per_query.csv").glob("*.csv")).read_text()
    e = config.Experiment(name="o", metrics=("map",), overlay=Settings(mode="direct"))
    assert jobs.overlay_file(spark, str(tmp_path / "x"), b, e, 1748735999, str(tmp_path / "over"))["map"] == 0.5
    with pytest.raises(FileNotFoundError):
        jobs.overlay_file(spark, str(tmp_path / "none"), b, e, 0, str(tmp_path / "over"))
    assert jobs.evaluate_file(spark, str(tmp_path / "y"), None, ["map"], str(tmp_path / "no"), "y") is None


def test_suite_with_overlay(spark, tmp_path):
    base = config.Experiment(name="plain", snapshots=("snapshot-1", "snapshot-2"), metrics=("map",), output_dir=str(tmp_path), retrieval=config.Retrieval(top_k=5))
    over = config.Experiment(name="over", snapshots=("snapshot-1",), metrics=("map",), output_dir=str(tmp_path), retrieval=config.Retrieval(top_k=5), overlay=Settings(mode="router"))
    got = jobs.suite(spark, [base, over], lambda e, n: _bundle(spark, n == "snapshot-1" or e.name == "plain"), str(tmp_path / "reports"))
    assert sorted((r.method, r.snapshot_id) for r in got.collect()) == [("over", "snapshot-1"), ("plain", "snapshot-1"), ("plain", "snapshot-2")]
    for f in ("metrics.json", "deltas.md", "means.html"):
        assert (tmp_path / "reports" / f).exists()
    assert config.for_snapshot(base, "snapshot-2").snapshots == ("snapshot-2",) and config.for_training(base).snapshots == ("snapshot-1",)


def test_bundles(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"key": " 1 ", "title": "t", "body": "b"}\n')
    (tmp_path / "q.tsv").write_text("query_id\tq\n7\tcats\n")
    (tmp_path / "j.txt").write_text("7 0 1 2\n")
    at = lambda n: str(tmp_path / n)
    b = bundles.load(spark, bundles.Dataset(corpus_path=at("c.jsonl"), queries_path=at("q.tsv"), qrels_path=at("j.txt"), corpus_fields={"doc_id": "key"}, query_fields={"query_text": "q"}), "snapshot-1")
    assert b.docs.first().doc_id == "1" and b.docs.first().full_text == "b" and rows(b.topics) == [("7", "cats")] and rows(b.qrels) == [("7", "1", 2)]
    for folder, text in (("x_abstract", '{"id": "1", "title": "t", "abstract": "a"}\n{"title": "no id"}\n'), ("x_fulltext", '{"id": "1", "fullText": "whole"}\n')):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part.jsonl").write_text(text)
    (tmp_path / "t.tsv").write_text("7\tcats\n")
    s = bundles.Dataset(backend="snapshot_folders", root=str(tmp_path), queries_path=at("t.tsv"), folders={"snapshot-1": ("x_abstract", "x_fulltext")})
    got = bundles.load(spark, s, "snapshot-1")
    assert [(r.doc_id, r.title, r.abstract, r.full_text) for r in got.docs.collect()] == [("1", "t", "a", "whole")] and got.qrels is None
    (tmp_path / "snapshot1").mkdir()
    assert bundles.snapshot_folders(spark, str(tmp_path), "snapshot-1", s.folders) == [f"{tmp_path}/snapshot1"]
    with pytest.raises(ValueError, match="unknown backend"):
        bundles.load(spark, bundles.Dataset(backend="none"), "s")
    (tmp_path / "bad.tsv").write_text("query_id\tq\n\tcats\n")
    with pytest.raises(Exception, match="query_id"):
        bundles.load(spark, bundles.Dataset(corpus_path=at("c.jsonl"), queries_path=at("bad.tsv"), corpus_fields={"doc_id": "key"}, query_fields={"query_text": "q"}), "s").topics.collect()


def test_small_files_of_any_store(spark, tmp_path):
    p = f"file://{tmp_path}/a/b.json"
    assert read_text(spark, p) is None
    write_text(spark, p, "ä")
    write_text(spark, p, "öx")
    assert read_text(spark, p) == "öx"


def test_late_rows_are_dropped(spark, tmp_path):
    import os
    from datetime import datetime

    from tidewater.streaming.weekly import run_available

    for i, days in enumerate([(datetime(2025, 1, 7), datetime(2025, 3, 4)), (datetime(2025, 3, 5),), (datetime(2025, 1, 8), datetime(2025, 3, 6))]):
        spark.createDataFrame([(d,) for d in days], "ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"s{i}"))
        f = next((tmp_path / f"s{i}").glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        f.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i * 100,) * 2)
    got = {r.week_start: r.n_events for r in run_available(spark, str(tmp_path / "in"), "ts timestamp", "weeks").collect()}
    assert got == {datetime(2025, 1, 6): 1, datetime(2025, 3, 3): 3}  # the January row of the last file comes after its week was closed


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace as N

    from tidewater import session

    no = N(isDefined=lambda: False)
    sc = N(master="spark://x", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: no)))
    with pytest.raises(RuntimeError, match="share"):
        session.shared_dir(N(conf=N(get=lambda *a: None), sparkContext=sc))


def test_pipelines_reuse_stored_indexes(spark, tmp_path):
    topics = spark.createDataFrame([("q", "cat sat")], "query_id string, text string")
    plain = config.Experiment(snapshots=("s1",), retrieval=config.Retrieval(top_k=5))
    kept = config.Experiment(snapshots=("s1",), retrieval=config.Retrieval(top_k=5, index_root=str(tmp_path)))
    want = rows(pipelines.run(docs(spark), topics, plain))
    assert rows(pipelines.run(docs(spark), topics, kept)) == want
    live = reindex.live_version(spark, str(tmp_path / "s1" / "title_abstract"))
    assert rows(pipelines.run(docs(spark).limit(0), topics, kept)) == want  # read, not built
    assert reindex.live_version(spark, str(tmp_path / "s1" / "title_abstract")) == live
