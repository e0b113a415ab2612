"""Readers and writers."""

import gzip

import pytest
from conftest import rows

from tidewater.sources import readers as rd
from tidewater.sources import writers as wr


def test_format():
    assert rd.infer_format("a/b.JSONL") == "jsonl" and rd.infer_format("x", "TSV") == "tsv"
    with pytest.raises(ValueError):
        rd.infer_format("x.parquet")


def test_records(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"id": "1", "text": "x"}]')
    (tmp_path / "d.json").write_text('{"data": [{"id": "1", "text": "x"}]}')
    (tmp_path / "r.jsonl").write_text('{"id": "1", "text": "x"}\n\n{"id": "2", "text": null}\n')
    (tmp_path / "c.tsv").write_text("id\ttext\n1\tx\n")
    (tmp_path / "m.json").write_text('{"count": 1,\n "data": [{"id": "1", "text": "x"}]}')
    (tmp_path / "no.json").write_text('{"rows": [{"id": "1"}]}')
    with pytest.raises(ValueError, match="neither"):
        rd.read_records(spark, str(tmp_path / "no.json"))
    for f in ("l.json", "d.json", "m.json", "c.tsv"):
        assert rows(rd.read_records(spark, str(tmp_path / f)).select("id", "text")) == [("1", "x")]
    assert rd.read_records(spark, str(tmp_path / "r.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n{"id":\n')
    with pytest.raises(Exception):
        rd.read_records(spark, str(tmp_path / "bad.jsonl")).collect()


def test_corpus(spark):
    df = spark.createDataFrame([("1", "", " t ", None, "body", "2020")], "doc_id string, id string, title string, full_text string, text string, publishedDate string")
    r = rd.normalize_corpus(df).first()
    assert (r.doc_id, r.title, r.abstract, r.full_text, r.metadata) == ("1", "t", "", "body", {"publishedDate": "2020"})
    assert rd.normalize_corpus(df, load_full_text=False).first().full_text == ""
    assert rd.normalize_corpus(df.selectExpr("'' as doc_id", "title"), missing="skip").count() == 0
    with pytest.raises(Exception, match="no doc_id"):
        rd.normalize_corpus(df.selectExpr("'' as doc_id", "title")).collect()


def test_merge(spark):
    data = [("1", "", "a", "x", {"k": "1"}, "abstract", 1), ("1", "t", "b", "y", {"k": "2", "m": "3"}, "abstract", 2), ("1", "", "", "f1", {}, "fulltext", 3), ("1", "u", "", "f2", {}, "fulltext", 4), ("2", "", "", "", {}, "abstract", 5)]
    df = spark.createDataFrame(data, "doc_id string, title string, abstract string, full_text string, metadata map<string,string>, kind string, ord int")
    got = {r.doc_id: (r.title, r.abstract, r.full_text, r.metadata) for r in rd.merge_corpus(df).collect()}
    assert got == {"1": ("t", "a", "f2", {"k": "1", "m": "3"}), "2": ("", "", "", {})}


def test_run_files(spark, tmp_path):
    df = spark.createDataFrame([("q", "b", 0.5, 2, "r"), ("q", "a", 1.2345678, 1, "r")], "query_id string, doc_id string, score double, rank int, run_name string")
    wr.write_run(df, str(tmp_path / "run"))
    assert rows(rd.read_run(spark, str(tmp_path / "run"))) == [("q", "a", 1.234568, 1, "r"), ("q", "b", 0.5, 2, "r")]
    wr.write_run(df, str(tmp_path / "gz"), compress=True)
    assert gzip.open(next((tmp_path / "gz").glob("*.gz"))).read()
    (tmp_path / "dup.txt").write_text("q Q0 a 1 1.0 r\nq Q0 a 2 3.0 r\n")
    assert rows(rd.read_run(spark, str(tmp_path / "dup.txt"), keep_rows=False)) == [("q", "a", 3.0)]
    (tmp_path / "bad.txt").write_text("q Q0 a 1\n")
    with pytest.raises(Exception, match="6 columns"):
        rd.read_run(spark, str(tmp_path / "bad.txt")).collect()


def test_topics_and_qrels(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("1\tone two\tthree\n\n2\tx\n")
    assert rows(rd.read_topics_tsv(spark, str(tmp_path / "t.tsv"))) == [("1", "one two\tthree"), ("2", "x")]
    (tmp_path / "q.txt").write_text("q 0 d  2\n")
    assert rows(rd.read_records(spark, str(tmp_path / "q.txt")).drop("line_no")) == [("q", "d", 2)]


def test_index_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "term string, n int")
    wr.write_index({"postings": df}, str(tmp_path))
    assert rows(wr.read_index(spark, str(tmp_path), ["postings"])["postings"]) == [("a", 2), ("b", 1)]
    for kind in ("json", "md", "html"):
        wr.write_report(df, str(tmp_path / f"r.{kind}"), "Terms & counts")
        assert "a" in (tmp_path / f"r.{kind}").read_text()
    assert wr.status_row(spark, "x", ["map"]).first().status == "skipped"


def test_entry_and_sql_keys():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
