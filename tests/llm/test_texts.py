"""Tokenizing, packing, masking and scan repair."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from conftest import rows

from tidewater.llm import bpe, ocr, packing, pii


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(open(bpe.default_path(), "rb").read())


HARD = ["", " ", "\n\n a", "a" * 3000, " " * 2000, "ab" * 900, "<|endoftext|> x", "😀" * 300, "é" * 400, "=-" * 500, "\x1c\x1d \x85 ᠎ x​ y", "0" * 700, "the" * 500, "''''s't" * 60, "I'll we've\tx\r\ny", "é ﬁ ｆｕｌｌ 数据"]


def test_ids_equal_the_public_library(merges):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    rng = random.Random(4)
    texts = HARD + ["".join(rng.choice("abcdeéè the ing\n ") for _ in range(rng.randint(1, 300))) for _ in range(150)] + ["".join(rng.choice("aeinrst") for _ in range(rng.randint(200, 900))) for _ in range(20)]
    e, d = bpe.Encoder(merges), bpe.Decoder(merges)
    for t in texts:
        ids = e.encode(t)
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert d.decode(ids) == t


def test_transducer_keeps_constant_memory(merges):
    t, rng, most = bpe.Transducer(merges), random.Random(2), 0
    data = bytes(rng.choice(b"aeinrstlo") for _ in range(60_000))
    out = []
    for i in range(0, len(data), 100):
        out += t.feed(data[i : i + 100])
        most = max(most, len(t.data))
    out += t.finish()
    assert most <= 3 * merges.lookahead
    assert b"".join(merges.tokens[i] for i in out) == data


def test_decoder_waits_for_whole_characters(merges):
    d = bpe.Decoder(merges)
    ids = bpe.Encoder(merges).encode("😀é")
    steps = [d.feed(i) for i in ids]
    assert "".join(steps) + d.finish() == "😀é" and "" in steps
    assert d.decode(ids[:1]) == "�"


def test_encode_tables(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (3, None, "x"), (None, "a", "x")], "doc_id long, text string, ids string")
    got = bpe.encode(df)
    assert sorted((r.doc_id or 0, list(r.ids)) for r in got.collect()) == [(0, [64]), (1, [31373, 995]), (2, []), (3, []), (3, [])]
    assert [r.text for r in bpe.decode(got).orderBy("doc_id").collect()] == ["a", "hello world", "", "", ""]
    assert rows(bpe.encode(df.limit(0))) == []


def items(spark, data):
    return spark.createDataFrame([(i, 0, n, s, c) for i, (n, s, c) in enumerate(data)], "doc_id long, piece int, n_tokens int, source string, cluster long")


def test_packing(spark):
    rng = np.random.default_rng(0)
    data = [(int(rng.integers(0, 700)), f"s{rng.integers(5)}" if rng.random() < 0.6 else "hot", int(rng.integers(40)) if rng.random() < 0.3 else None) for _ in range(3000)]
    it = items(spark, data)
    for shard in (20_000, 500):
        p = packing.pack(it, capacity=2048, shard_items=shard)
        assert tuple(packing.packing_faults(it, p).first()) == (3000, 0, 0, 0, 0)
        r = packing.packing_report(p).first()
        assert r.n_containers <= r.least_containers * 1.02 + 2


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_packing_keeps_null_and_repeated_ids(spark, kind):
    data = [(None if i % 7 == 0 else str(i % 90), 0, 200 + 37 * i % 1100, "s", i) for i in range(300)]
    it = spark.createDataFrame(data, "doc_id string, piece int, n_tokens int, source string, cluster long").selectExpr(f"cast(doc_id as {kind}) doc_id", "piece", "n_tokens", "source", "cluster")
    p = packing.pack(it, shard_items=40)
    assert rows(p.select("doc_id", "piece", "n_tokens")) == rows(it.select("doc_id", "piece", "n_tokens"))
    assert tuple(packing.packing_faults(it, p).first())[1:3] == (0, 0)


def test_packing_cuts_only_what_must_be_cut(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "x" * 25, "a"), (2, "y" * 10, "a"), (3, "y" * 10, None), (4, "", "a"), (5, None, "b"), (6, "z" * 20, "a")], "doc_id long, text string, source string")
    it = packing.sized_items(df, lambda c: F.coalesce(F.length(c), F.lit(0)), capacity=10)
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in it.collect()) == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 10), (3, 0, 10), (4, 0, 0), (5, 0, 0), (6, 0, 10), (6, 1, 10)]
    p = packing.pack(it, capacity=10)
    assert tuple(packing.packing_faults(it, p, 10).first()) == (6, 0, 0, 0, 0)
    assert rows(packing.pack(it.limit(0))) == []


def test_copies_of_cut_texts_share_no_container(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "x" * 13, "a") for i in range(6)] + [(10 + i, "yz"[i] * 3, "a") for i in range(2)], "doc_id long, text string, source string")
    it = packing.sized_items(df, lambda c: F.coalesce(F.length(c), F.lit(0)), capacity=10)
    p = packing.pack(it, capacity=10)
    assert tuple(packing.packing_faults(it, p, 10).first())[:4] == (8, 0, 0, 0)
    rest = p.where("piece = 1").select("container_id").distinct().count()
    assert rest == 6


def test_near_duplicates_share_no_container(spark):
    words = [f"w{i}" for i in range(60)]
    data = [(1, " ".join(words), "a"), (2, " ".join([*words[:-1], "other"]), "a"), (3, "something else", "a"), (4, "something else", "a"), (5, None, "a")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    c = {r.doc_id: r.cluster for r in packing.duplicate_clusters(df).collect()}
    assert set(c) == {"1", "2"} and c["1"] == c["2"]
    from pyspark.sql import functions as F

    it = packing.sized_items(df, lambda x: F.coalesce(F.length(x), F.lit(0)), clusters=packing.duplicate_clusters(df))
    assert len({r.cluster for r in it.collect()}) == 3


def test_crowded_best_fit_is_quick():
    """20,000 items of one size, a third of one cluster: no search walks over all bins again and again."""
    import time

    n = 20_000
    pdf = pd.DataFrame({"n_tokens": [1024] * n, "source": [f"s{i % 9}" for i in range(n)], "cluster": [1 if i % 3 == 0 else None for i in range(n)]})
    t = time.time()
    bins = packing.best_fit(pdf, 2048)
    assert time.time() - t < 30
    assert len(set(bins)) == n // 2 and pd.Series(bins)[pdf["cluster"].eq(1)].is_unique


def test_best_fit_takes_the_tightest_compatible_bin():
    pdf = pd.DataFrame({"n_tokens": [8, 6, 2, 2], "source": ["a", "b", "c", "c"], "cluster": [1, None, 1, None]})
    bins = packing.best_fit(pdf, 10)
    assert bins[2] == bins[1] != bins[0]  # the tightest bin holds a copy
    assert bins[3] == bins[0]


NAMES = pii.Names([(g, "given") for g in ("Hana", "Olga", "José")] + [(f + t, "family") for f in ("Kess", "Nov", "Wyr", "Fen", "Dorn", "Lam") for t in ("wyck", "iello", "etti", "ides", "ovecz", "anovi")] + [("Market", "family"), ("Market", "common")])


def found(text):
    return [(k, text[a:b]) for k, a, b in pii.mentions(text, NAMES)]


CASES = [
    ("Write to olga.k@inst.example or kk [at] uni-x [dot] example.", [("email", "olga.k@inst.example"), ("email", "kk [at] uni-x [dot] example")]),
    ("mailto:a_b(at)mail.test, or ab AT inst DOT example DOT org now", [("email", "a_b(at)mail.test"), ("email", "ab AT inst DOT example DOT org")]),
    ("Handle: @quarnlab, rank-tools@1.2.3, P@10", []),
    ("Call +44 20 7946 0899 or (641) 555-0191, 030/23125-136; 434-555-0196 or 0044 (0)20 7946 0471 ext. 0.", [("phone", "+44 20 7946 0899"), ("phone", "(641) 555-0191"), ("phone", "030/23125-136"), ("phone", "434-555-0196"), ("phone", "0044 (0)20 7946 0471 ext. 0")]),
    ("Call five five five, zero one", []),
    ("Call +1 five five five zero one two three four five six today", [("phone", "+1 five five five zero one two three four five six")]),
    ("Accession 646-22-2012, ISSN 9999-2013, grant 2003-0436-4912, doi:10.99999/1.2-3, v1.32.722", []),
    ("SSN 963-59-7904, passport no. ZZ4085166; ORCID iD: 0000-0007-9140-406X (patient no. 34465214)", [("id_number", "963-59-7904"), ("id_number", "ZZ4085166"), ("id_number", "0000-0007-9140-406X"), ("id_number", "34465214")]),
    ("national insurance no. QX 21 32 26 D; Personenkennzahl 231393-3922T", [("id_number", "QX 21 32 26 D"), ("id_number", "231393-3922T")]),
    ("at Flat 9, 109 Kelmere Street, Noremora. P.O. Box 611, Calvheim 99129", [("address", "Flat 9, 109 Kelmere Street, Noremora"), ("address", "P.O. Box 611, Calvheim 99129")]),
    ("in Am Malcroft 98, 99071 Calvgrad; 252, rue de Osmere, 99666 Dornford; Calle Fendale 305, 7.º C, 99371 Dorngrad", [("address", "Am Malcroft 98, 99071 Calvgrad"), ("address", "252, rue de Osmere, 99666 Dornford"), ("address", "Calle Fendale 305, 7.º C, 99371 Dorngrad")]),
    ("Station 21 lies on the Novetti Road transect", []),
    ("Dr. Hana Kesswyck, J. Novetti and Wyrides, Olga; LAMOVECZ, J.F. met JOSÉ\nFENIELLO-DORNETTI", [("name", "Hana Kesswyck"), ("name", "J. Novetti"), ("name", "Wyrides, Olga"), ("name", "LAMOVECZ, J.F."), ("name", "JOSÉ\nFENIELLO-DORNETTI")]),
    ("The Novetti test, Kesswyck and Wyrides (1967), Lametti et al., the Market", []),
    ("We thank Ms S. Novanovi and Prof. Hana B. Wyrides.", [("name", "S. Novanovi"), ("name", "Hana B. Wyrides")]),
    ("We thank Bruno van der Kessides.", [("name", "Bruno van der Kessides")]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_mentions(text, want):
    assert found(text) == want


REAL = pii.Names([("Chukwuemeka", "given")] + [(n, "family") for n in ("Smith", "Nguyen", "Okafor", "Li", "Garcia", "Brown")] + [("Brown", "common")])


@pytest.mark.parametrize("text, want", [("J. Smith and Chukwuemeka Okafor met Nguyen, T. in May.", ["J. Smith", "Chukwuemeka Okafor", "Nguyen, T."]), ("We thank Wei Li.", ["Wei Li"]), ("The Brown fox; Chukwuemeka Brown too.", ["Chukwuemeka Brown"]), ("Smith alone, the Garcia et al. method", []), ("Chukwuemeka\r\n  Garcia", ["Chukwuemeka\r\n  Garcia"]), ("A" + "a" * 80 + "-Maria Garcia came", ["A" + "a" * 80 + "-Maria Garcia"])])
def test_real_names(text, want):
    assert [text[a:b] for k, a, b in pii.mentions(text, REAL) if k == "name"] == want


@pytest.mark.parametrize("text, want", [("jane dot doe at example dot org", ["jane dot doe at example dot org"]), ("Tel. 555 01 99 22 11", ["555 01 99 22 11"]), ("+1 double five five zero one triple four two", ["+1 double five five zero one triple four two"]), ("ԛuinn＠ｅxample.org", ["ԛuinn＠ｅxample.org"])])
def test_disguises(text, want):
    assert [text[a:b] for _, a, b in pii.mentions(text, REAL)] == want


def test_many_mentions_in_one_text():
    import time

    text = " and ".join(f"J. Smith, a{i}@example.org" for i in range(10_000))
    t = time.time()
    assert len(pii.mentions(text, REAL)) == 20_000
    assert time.time() - t < 30


def test_corpus_knowledge_and_blocks(spark, monkeypatch):
    """Given names that the lexicon lacks, words that aren't any, common family words; and the same from blocks as from what travels."""
    lex = spark.createDataFrame([("Hana", "given"), ("Garcia", "family"), ("Smith", "family"), ("Reef", "family")], "name_text string, name_kind string")
    texts = ["Bruno Garcia and Bruno Smith wrote.", "Station Smith, Station 21, Station 22, Station 23. By Bruno Smith", "the reef, a reef, one reef, this reef; the Reef. Bruno Reef, Hana Reef", None, "", "Hana Smith"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = [(0, "name", 1), (0, "name", 18), (1, "name", 55), (2, "name", 62), (5, "name", 1)]
    assert rows(pii.find_mentions(df, lex)) == want
    masked = rows(pii.redact(df, lex))
    monkeypatch.setattr(pii, "LEXICON_ROWS", 3)
    monkeypatch.setattr(pii, "BLOCK_TEXTS", 2)
    assert rows(pii.find_mentions(df, lex)) == want
    assert rows(pii.redact(df, lex)) == masked and len(masked) == 6


def test_offsets_hold_behind_odd_characters():
    text = "😀​ｆｕｌｌ ‪Hana​ Kesswyck‬: ｏlga＠inst．example"
    got = pii.mentions(text, NAMES)
    assert [(k, text[a:b].strip("‬")) for k, a, b in got] == [("name", "Hana​ Kesswyck"), ("email", "ｏlga＠inst．example")]
    assert pii.masked("x Hana Kesswyck, +1 (246) 555-0110!", NAMES) == "x [NAME], [PHONE]!"
    assert pii.masked(None, NAMES) is None and pii.masked("", NAMES) == ""


def test_mention_tables(spark):
    lex = spark.createDataFrame([("Hana", "given"), (None, "given"), ("Kesswyck", "family")], "name_text string, name_kind string")
    df = spark.createDataFrame([(1, "Hana Kesswyck", 1), (1, "Hana Kesswyck", 1), (2, None, 1), (3, "", 1)], "doc_id long, text string, kind int")
    assert rows(pii.find_mentions(df, lex)) == [(1, "name", 1)]
    assert {r.text for r in pii.redact(df, lex).collect()} == {"[NAME]", None, ""}
    assert rows(pii.find_mentions(df.limit(0), lex)) == []


PAGE = """12    Towards membrane pulses: evidence

   Over the study period, the membrane of the pulse drives the magn-
etic detector. The rnembrane follows the cross-
lingual detector without any change in the mem-

Journal of Lattice Biology    13

brane when the signäl stays magnetic. The detector of the membrane
drives the pulse.
   The pulse follows the detector 5ignal."""


def corpus(spark):
    clean = ("The membrane follows the magnetic detector signal. Over the study period the pulse drives the cross-lingual detector without any change. When evidence stays, towards pulses. " * 5)
    data = [("d1", "snapshot-1", "Towards membrane pulses: evidence from a signal", "cross-lingual pulse", PAGE), (" d1", "snapshot-1", "Towards membrane pulses: evidence from a signal", "cross-lingual pulse", PAGE), ("d2", "snapshot-1", "t", clean, clean), ("d3", "snapshot-1", None, None, None), (None, "snapshot-1", "t", "a", PAGE), ("d4", "snapshot-2", None, "a", "")]
    from datetime import datetime

    return spark.createDataFrame([(*x, datetime(2025, 1, 1), 1) for x in data], "doc_id string, snapshot_id string, title string, abstract string, full_text string, delivered_at timestamp_ntz, kind int")


def test_scan_lines(spark):
    got = rows(ocr.Repair(corpus(spark)).lines().drop("snapshot_id"))
    assert sorted(got) == [("d1", 1, "furniture"), ("d1", 3, "split_word"), ("d1", 4, "misread"), ("d1", 5, "split_word"), ("d1", 7, "furniture"), ("d1", 9, "misread"), ("d1", 11, "misread")]


def test_scan_lines_where_texts_are_written_first(spark, monkeypatch):
    want = rows(ocr.Repair(corpus(spark)).lines())
    monkeypatch.setattr(ocr, "BROADCAST_ROWS", 0)
    assert rows(ocr.Repair(corpus(spark)).lines()) == want


def test_scan_repair(spark):
    got = {r.doc_id: r.text for r in ocr.Repair(corpus(spark)).texts().collect()}
    assert got["d1"] == (
        "Over the study period, the membrane of the pulse drives the magnetic detector. The membrane follows the cross-lingual detector without any change in the membrane when the signal stays magnetic. "
        "The detector of the membrane drives the pulse.\n\nThe pulse follows the detector signal."
    )
    assert got["d2"].startswith("The membrane follows") and got["d4"] == "" and "d3" not in got


def test_repairs_by_path(spark):
    """Dropped, added and changed letters come through the index where the corpus speaks for them; a form of a word, or a word in other company, stays."""
    from datetime import datetime

    clean = "The gradient follows the sediment layer. A household controls the sediment layer again. " * 30
    page = "The gradient follows the sed-\niment layer and the\nhouse. The sedment layer, the sepdiment layer, a houschold\ncontrols the sedinent layer and the sedimentx layer, my\nsedxment house, the gr0ndient flow, q5uvw1y here."
    data = [("c", "t", clean, None), ("p", "t", None, page), ("w", "t", None, "A letter\nto a friend who\nbreaks his lines\nat will.")]
    docs = spark.createDataFrame([(d, "snapshot-1", *x, datetime(2025, 1, 1)) for d, *x in data], "doc_id string, snapshot_id string, title string, abstract string, full_text string, delivered_at timestamp_ntz")
    r = ocr.Repair(docs)
    got = {(x.word, x.fix, x.path) for x in r.misread().collect()}
    assert {("sedment", "sediment", "edit"), ("sepdiment", "sediment", "edit"), ("sedinent", "sediment", "edit"), ("houschold", "household", "confusion")} <= got
    assert not {w for w, *_ in got} & {"sedimentx", "sedxment", "letter", "flow"}
    assert {p.path: p.n_words for p in r.paths().collect()}["edit"] == 3
    assert {x.doc_id for x in r.lines().collect()} == {"p"}


@pytest.mark.parametrize("text, want", [("one line", False), ("", False), (None, False), ("A plain\nletter with\nits lines broken\nby hand.", False), ("It goes on with the mem-\nbrane of a\ncell and so\non.", True), ("It goes on\nover lines and\n   - 12 -\nmore lines of\ntext.", True), ("x" * 300 + " goes\non for " + "y" * 300 + " and a bro-\nken word in\nit.", True), ("A paragraph.\n\nAnother one.", False)])
def test_scans_are_told_by_several_signs(text, want):
    assert ocr.is_scanned(text) is want


def test_scan_of_nothing(spark):
    r = ocr.Repair(corpus(spark).limit(0))
    assert rows(r.lines()) == [] and rows(r.texts()) == []


def test_skeletons_meet_for_every_confusion():
    for t, r in ocr.CONFUSIONS:
        assert ocr.skeleton(t) == ocr.skeleton(r)
    assert ocr.confusion_distance("matches", "matclies") == pytest.approx(0.2)
    assert ocr.confusion_distance("modern", "rnodem") == pytest.approx(0.4)
    assert ocr.confusion_distance("matches", "marches") == ocr.REPAIR
    assert ocr.confusion_distance("cat", "cart", 2.0) == 1


@pytest.mark.parametrize("line, want", [("  138", True), ("- 86 -", True), ("xii", True), ("Page 3 of 9", True), ("Journal of Lattice Biology 20 (1951) 607", True), ("PROCEEDINGS OF MARINE LEXICOLOGY", True), ("Notes of Polar Cartometry, Vol. 5, 1942", True), ("A title that is long  |  1934", True), ("56.", False), ("[37].", False), ("of the BM25 pulse.", False), ("The results suggest that", False), ("", False)])
def test_furniture(line, want):
    assert ocr.is_furniture(line, "A title that is long and goes on") is want
