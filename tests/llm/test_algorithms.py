"""Overlaps, top-N and near-duplicates against brute force."""

import itertools
import re

import numpy as np
import pytest
from conftest import rows

from tidewater.llm import forest, overlap, topn

WORD = re.compile(r"[^\W_]+")


def brute_overlap(data, t):
    texts = {}
    for q, text, split in data:
        s = (split or "").strip().lower()
        if q is not None and s in ("train", "dev", "test"):
            w = frozenset(WORD.findall((text or "").lower()))
            if w:
                texts.setdefault((q, s == "train"), set()).add(w)
    out = set()
    for (a, ta), wa in texts.items():
        for (b, tb), wb in texts.items():
            if ta and not tb and a != b and any(len(x & y) >= t * len(x | y) - 1e-12 for x in wa for y in wb):
                out.add((min(a, b), max(a, b)))
    return sorted(out)


@pytest.mark.parametrize("seed, t", [(0, 0.7), (1, 0.5), (2, 0.9), (3, 0.7)])
def test_overlap_against_brute_force(spark, seed, t):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["of", "the", "survey"]
    base = [list(rng.choice(vocabulary, rng.integers(1, 14), replace=False)) for _ in range(40)]
    data = []
    for i in range(220):
        w = list(base[rng.integers(len(base))])
        for _ in range(rng.integers(0, 4)):
            if rng.random() < 0.5 and w:
                w.pop(rng.integers(len(w)))
            else:
                w.insert(rng.integers(len(w) + 1), vocabulary[rng.integers(len(vocabulary))])
        rng.shuffle(w)
        data.append((f"q{i:03d}", " ".join(w), ["train", " Train", "dev", "TEST "][rng.integers(4)]))
    df = spark.createDataFrame(data, "query_id string, text string, split string")
    assert rows(overlap.cross_split_pairs(df, threshold=t)) == brute_overlap(data, t)


def test_overlap_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(1500))
    data = [("a", "One two", "train"), ("a", "One two", "train"), ("b", "two, ONE!", "dev"), ("c", None, "dev"), ("d", "", "train"), ("e", "?!", "test"), (None, "one two", "dev"), ("f", "one two", None), ("g", "one two", "other"), ("h", long, "train"), ("i", long + " y", "test"), ("j", "one", "train")]
    df = spark.createDataFrame([(*x, "s", 1) for x in data], "query_id string, text string, split string, source string, words int")
    pairs = overlap.cross_split_pairs(df)
    assert rows(pairs) == [("a", "b"), ("h", "i")]
    assert {(r.split, r.n_queries, r.n_overlapping) for r in overlap.overlap_report(df, pairs).collect()} == {("dev", 2, 1), ("test", 2, 1)}
    assert rows(overlap.cross_split_pairs(df.limit(0))) == []


def test_banded_distance():
    rng = np.random.default_rng(0)
    for la, lb, k in [(7, 10, 3), (5, 5, 2), (10, 7, 3), (1, 1, 0), (6, 9, 2)]:
        a, b = (np.stack([np.sort(rng.permutation(12)[:n]) for _ in range(80)]) for n in (la, lb))
        exact = np.array([len(set(x) ^ set(y)) for x, y in zip(a, b)])
        assert (overlap.banded_distance(a, b, k) == np.minimum(exact, k + 1)).all()


def brute_top(data, n):
    best = {}
    for run, q, d, s, r in data:
        d = (d or "").strip()
        if q is None or not d or s is None or s != s:
            continue
        k = (-s, r if r and r > 0 else 2**31)
        best.setdefault((run, q), {})
        if k < best[run, q].get(d, (9e99, 0)):
            best[run, q][d] = k
    return sorted(((run, q, d, i) for (run, q), ds in best.items() for i, (_, _, d) in enumerate(sorted((*k, d) for d, k in ds.items())[:n], 1)), key=repr)


def test_top_n_against_brute_force(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(4000):
        q = "hot" if rng.random() < 0.35 else f"q{rng.integers(60)}"
        score = [float(rng.integers(6)), float(rng.random()), None, float("nan"), float("inf")][rng.choice(5, p=[0.5, 0.46, 0.02, 0.01, 0.01])]
        data.append((f"r{rng.integers(3)}" if rng.random() < 0.97 else None, q if rng.random() < 0.99 else None, [f"d{rng.integers(300)}", f" d{rng.integers(300)} ", "  ", None][rng.choice(4, p=[0.8, 0.17, 0.02, 0.01])], score, [None, -1, 0, int(rng.integers(1, 9))][rng.integers(4)]))
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(data)], "run_name string, query_id string, doc_id string, score double, rank int, band int")
    for n in (1, 10):
        assert rows(topn.top_documents(df, n)) == brute_top(data, n)
    assert rows(topn.top_n(df.withColumnRenamed("doc_id", "item").where("item is not null and trim(item) <> '' and query_id is not null and item not like ' %'"), keys=("run_name", "query_id"), n=3, bands=(0.5,)).drop("score", "rank")) == brute_top([x for x in data if x[2] and x[2].strip() and not x[2].startswith(" ")], 3)
    assert rows(topn.top_documents(df.limit(0))) == []


def sh(text, size):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def make_texts(rng, n, groups):
    words = [f"v{i}" for i in range(3000)]
    plain = "we find that the results suggest that".split()
    base = [[*plain, *rng.choice(words, rng.integers(40, 160))] for _ in range(groups)]
    out = []
    for i in range(n):
        w = list(base[rng.integers(groups)])
        for _ in range(rng.integers(0, 9)):
            at = rng.integers(len(w))
            w[at : at + rng.integers(0, 3)] = [str(x) for x in rng.choice(words, rng.integers(0, 3))]
        out.append((f"D{i:04d}", " ".join(map(str, w))))
    return out


@pytest.mark.parametrize("threshold, size", [(0.5, 3), (0.8, 5)])
def test_near_duplicates_against_brute_force(spark, threshold, size):
    rng = np.random.default_rng(7)
    data = make_texts(rng, 260, 60)
    data += [(f"E{i}", data[0][1]) for i in range(5)] + [("S", "too short"), ("N", None), ("O", "")]
    df = spark.createDataFrame([(*x, 1) for x in data], "key string, text string, rep int")
    members, links = forest.near_duplicates(df, threshold=threshold, size=size, least=20)
    got = set(rows(forest.all_pairs(members, links)))
    sets = {k: s for k, t in data if t and len(s := sh(t, size)) >= 20}
    exact = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    assert got <= exact
    assert len(got) >= 0.99 * len(exact)
    assert len([p for p in got if p[0] in ("D0000", "E0", "E1") and p[1] in ("E0", "E1")]) == 3


def test_groups(spark):
    members = spark.createDataFrame([(k, k) for k in "abcdefg"] + [("z", "a")], "key string, rep string")
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("f", "g")], "a string, b string")
    got = {r.doc_id: (r.group_id, r.n_links) for r in forest.groups(members, chain).collect()}
    assert got == {"a": ("a", 1), "b": ("a", 2), "c": ("a", 2), "d": ("a", 1), "e": ("e", 0), "f": ("f", 1), "g": ("f", 1), "z": ("a", 1)}


def test_crowded_regions_stream_the_same_pairs():
    """A region that is cut while it streams gives what it gives in one piece, as far as leaves go."""
    import pandas as pd

    rng = np.random.default_rng(1)
    n = 900
    label = rng.integers(0, 3, (n, forest.DEPTH)).astype(np.uint8)
    label[:, : forest.MIN_DEPTH] = rng.integers(0, 2, (n, 1))
    order = np.lexsort(label.T[::-1])
    pdf = pd.DataFrame({"tree": 0, "label": [label[i].tobytes() for i in order], "key": [f"k{i}" for i in order], "sketch": [b"\x01" * forest.SKETCH] * n})
    whole = set(map(tuple, pd.concat(forest.neighbours(iter([pdf]), 1)).itertuples(index=False)))
    parts = set(map(tuple, pd.concat(forest.neighbours(iter([pdf[i : i + 50].reset_index(drop=True) for i in range(0, n, 50)]), 1, hold=120)).itertuples(index=False)))
    same = {(min(a, b), max(a, b)) for a, b in itertools.combinations(pdf["key"], 2) if label[int(a[1:])].tobytes() == label[int(b[1:])].tobytes()}
    assert same <= whole and same <= parts


def test_near_duplicates_of_nothing(spark):
    members, links = forest.near_duplicates(spark.createDataFrame([], "key string, text string"))
    assert rows(members) == [] and rows(links) == [] and rows(forest.groups(members, links)) == []


@pytest.mark.parametrize("n, block", [(400, None), (300, 70)])
def test_crowd_of_edited_copies(spark, monkeypatch, n, block):
    """A crowd finds as much as a few texts do, in one block or several."""
    monkeypatch.setattr(forest, "BLOCK", block or forest.BLOCK)
    rng = np.random.default_rng(11)
    base, data = [f"b{i}" for i in range(160)], []
    for i in range(n):
        w = list(base)
        for at in rng.choice(160, rng.integers(1, 18), replace=False):
            w[at] = f"e{rng.integers(1_000_000)}"
        data.append((f"C{i:04d}", " ".join(w)))
    members, links = forest.near_duplicates(spark.createDataFrame(data, "key string, text string"), threshold=0.5, size=3, least=20)
    got = set(rows(forest.all_pairs(members, links)))
    sets = {k: sh(t, 3) for k, t in data}
    exact = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert got <= exact
    assert len(got) >= 0.995 * len(exact)


def test_crowds_come_out_whole_while_they_stream():
    import pandas as pd

    sizes = [3, 70, 2, 200, 5]
    label = [bytes([i] * forest.DEPTH) for i, n in enumerate(sizes) for _ in range(n)]
    pdf = pd.DataFrame({"tree": 1, "label": label, "key": [f"k{i:03d}" for i in range(len(label))], "sketch": [b"\x01" * forest.SKETCH] * len(label)})
    for hold, step in ((1000, 280), (100, 40), (10, 7)):
        out = pd.concat(forest.neighbours(iter([pdf[i : i + step].reset_index(drop=True) for i in range(0, len(pdf), step)]), 1, hold=hold, crowd=64))
        rest = out[out["b"].isna()]
        assert sorted(zip(rest["a"], rest["label"])) == [(k, x) for k, x in zip(pdf["key"], label) if x[0] in (1, 3)]
        assert len(out) - len(rest) == 3 + 1 + 10


def test_groups_never_end_unfinished(spark):
    names = [f"k{i:02d}" for i in range(40)]
    members = spark.createDataFrame([(k, k) for k in names], "key string, rep string")
    chain = spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")
    with pytest.raises(RuntimeError, match="still change"):
        forest.groups(members, chain, rounds=1)
    assert {r.group_id for r in forest.groups(members, chain).collect()} == {"k00"}
