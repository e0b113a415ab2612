"""Near-duplicate texts with an LSH forest.

Every text becomes its set of distinct word sequences. A forest of TREES sorted orders is built: in each, a text's
label is DEPTH minhash values. Texts with the same label form a region, and all texts of a region are candidates of each other.
In a region of up to LEAF texts a small minhash sketch drops candidates that are plainly unlike; the rest are verified exactly on the
full sets. A larger region is split into blocks; every pair of blocks is a task of its own, which counts what its texts share exactly.

Texts with equal sets are one class and enter the forest once; members are joined back at the end.
A task holds small regions or two blocks, not a group. However many texts are alike, a pair at the threshold meets in a tree
with probability t**DEPTH (at 0.5, 40 trees: 0.995 over all).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.snapshots import doc_key, numbered, snapshot_names
from tidewater.session import BROADCAST_ROWS, bounded, written

TREES, DEPTH, SKETCH = 40, 3, 32
#: Values of a label that the texts of a region share: all.
MIN_DEPTH = DEPTH
#: A region of more than LEAF texts is split into blocks of about BLOCK.
LEAF, BLOCK = 64, 1000
_WORD = re.compile(r"[^\W_]+")
_MIX = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], np.uint64)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    m = TREES * DEPTH + SKETCH
    return rng.integers(1, 2**32, m, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, m, dtype=np.uint32)


def shingles(text: str, size: int, known: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the sequences of `size` words."""
    found = _WORD.findall(text.lower())
    if len(found) < size:
        return np.zeros(0, np.uint64)
    if len(known) > 2_000_000:
        known.clear()
    ids = np.empty(len(found), np.uint64)
    for i, w in enumerate(found):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        ids[i] = h
    n = len(ids) - size + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(size):
            h = (h ^ ids[j : j + n]) * _MIX[j % 3]
            h ^= h >> np.uint64(29)
        h *= _MIX[3]
        h ^= h >> np.uint64(32)
    return np.unique(h)


def signatures(frames: Iterator[pd.DataFrame], size: int, least: int) -> Iterator[pd.DataFrame]:
    """(key, text) to (key, cls, n, items, labels, sketch); texts with fewer than `least` distinct sequences are dropped."""
    a, b = _functions()
    known: dict[str, int] = {}
    for pdf in frames:
        rows = []
        for key, text in zip(pdf["key"], pdf["text"]):
            s = shingles(text, size, known)
            if len(s) < least:
                continue
            low = (s >> np.uint64(32)).astype(np.uint32)
            best = np.full(len(a), 0xFFFFFFFF, np.uint32)
            for at in range(0, len(low), 512):
                with np.errstate(over="ignore"):
                    np.minimum(best, (low[at : at + 512, None] * a + b).min(axis=0), out=best)
            # fold the 32 bits of each minimum into one byte
            v = best ^ (best >> np.uint32(15))
            v = ((v * np.uint32(0x2C1B3C6D)) >> np.uint32(24)).astype(np.uint8)
            rows.append((key, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), s.tobytes(), v[: TREES * DEPTH].tobytes(), v[TREES * DEPTH :].tobytes()))
        yield pd.DataFrame(rows, columns=["key", "cls", "n", "items", "labels", "sketch"])


_SIGNED = "key string, cls binary, n int, items binary, labels binary, sketch binary"


def _pairs_of(keys: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray, least: int, out: list) -> None:
    """Adds the index pairs (i, j) whose sketches agree in at least `least` places."""
    for s in range(0, len(i), 200_000):
        x, y = i[s : s + 200_000], j[s : s + 200_000]
        ok = (sketch[x] == sketch[y]).sum(axis=1) >= least
        if ok.any():
            out.append((keys[x[ok]], keys[y[ok]]))


def _regions(keys: np.ndarray, head: np.ndarray, sketch: np.ndarray, least: int) -> list:
    """head is tree and label. Candidates of many whole regions, one after the other: every pair of each."""
    out: list = []
    n = len(keys)
    starts = np.r_[0, np.flatnonzero((head[1:, : 1 + MIN_DEPTH] != head[:-1, : 1 + MIN_DEPTH]).any(axis=1)) + 1]
    sizes = np.diff(np.r_[starts, n])
    ends = np.repeat(starts + sizes, sizes)
    i = np.arange(n)
    for gap in range(1, int(sizes.max())):
        i = i[i + gap < ends[i]]
        _pairs_of(keys, sketch, i, i + gap, least, out)
    return out


def neighbours(frames: Iterator[pd.DataFrame], least: int, hold: int = 50_000, crowd: int | None = None) -> Iterator[pd.DataFrame]:
    """Rows (tree, label, key, sketch) sorted by tree and label, to candidate pairs (a, b): every pair of each region.

    Rows are gathered until there are more than `hold`, then all but the last, open region is worked off.
    If `crowd` is given, rows are (a, b, tree, label): pairs with null tree and label, and of a region of more than `crowd` texts its keys as a, with null b.
    """
    kept = None
    passing = None

    def close(keys: np.ndarray, head: np.ndarray, sketch: np.ndarray) -> pd.DataFrame:
        out = _regions(keys, head, sketch, least) if len(keys) else []
        if not out:
            return pd.DataFrame({"a": [], "b": []}, dtype=object)
        x, y = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        swap = x > y
        pairs = pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y)})
        return pairs[pairs["a"] != pairs["b"]].drop_duplicates()

    def worked(keys: np.ndarray, head: np.ndarray, sketch: np.ndarray) -> pd.DataFrame:
        if crowd is None:
            return close(keys, head, sketch)
        starts = np.r_[0, np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1]
        sizes = np.diff(np.r_[starts, len(keys)])
        many = np.repeat(sizes > crowd, sizes) | ((head == passing).all(axis=1) if passing is not None else False)
        rest = pd.DataFrame({"a": keys[many], "b": None, "tree": head[many, 0].astype(int), "label": [x.tobytes() for x in head[many, 1:]]}, dtype=object)
        return pd.concat([close(keys[~many], head[~many], sketch[~many]).assign(tree=None, label=None), rest], ignore_index=True)

    for pdf in frames:
        if not len(pdf):
            continue
        keys = pdf["key"].to_numpy(object)
        head = np.column_stack([pdf["tree"].to_numpy(np.uint8), np.frombuffer(b"".join(pdf["label"]), np.uint8).reshape(-1, DEPTH)])
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, SKETCH)
        if kept is not None:
            keys, head, sketch = np.concatenate([kept[0], keys]), np.concatenate([kept[1], head]), np.concatenate([kept[2], sketch])
        last = 0
        if len(keys) > hold:
            other = np.flatnonzero((head != head[-1]).any(axis=1))
            last = int(other[-1]) + 1 if other.size else 0
            if last:
                yield worked(keys[:last], head[:last], sketch[:last])
            if crowd is not None and (len(keys) - last > crowd or passing is not None and (head[-1] == passing).all()):
                passing = head[-1]  # the open region is a crowd: its rows needn't wait
                yield worked(keys[last:], head[last:], sketch[last:])
                last = len(keys)
        kept = (keys[last:], head[last:], sketch[last:])
    if kept is not None and len(kept[0]):
        yield worked(*kept)


def block_links(pdf: pd.DataFrame, threshold: float, few: int = 32) -> pd.DataFrame:
    """pdf(tree, i, j, block, key, labels, items): the texts of blocks i and j of a region. Links (a, b) between i and j, exactly.

    A pair that an earlier tree brought together too is left to that tree.
    """
    t = Fraction(str(threshold))
    tree = int(pdf["tree"].iloc[0])
    block, keys = pdf["block"].to_numpy(), pdf["key"].to_numpy(object)
    left, right = np.flatnonzero(block == pdf["i"].iloc[0]), np.flatnonzero(block == pdf["j"].iloc[0])
    sets = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
    n = np.array([len(x) for x in sets])
    labels = np.frombuffer(b"".join(pdf["labels"]), np.uint8).reshape(len(pdf), TREES, DEPTH)[:, :tree].astype(np.int64)
    met = sum(labels[:, :, k] << (8 * k) for k in range(DEPTH))
    # of each sequence, where in `right` the sets are that hold it
    known, code = np.unique(np.concatenate([sets[y] for y in right] or [np.zeros(0, np.uint64)]), return_inverse=True)
    holders = np.repeat(np.arange(len(right)), n[right])[np.argsort(code, kind="stable")]
    ends = np.cumsum(np.bincount(code, minlength=len(known)))
    begins = np.r_[0, ends[:-1]]
    same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    a, b = [], []
    for at, x in enumerate(left):
        new = ~(met[right] == met[x]).any(axis=1)
        if same:
            new[: at + 1] = False
        found = np.flatnonzero(new)
        if len(found) <= few:
            both = np.array([len(np.intersect1d(sets[x], sets[right[y]], assume_unique=True)) for y in found], np.int64)
        else:
            c = np.minimum(np.searchsorted(known, sets[x]), len(known) - 1)
            c = c[known[c] == sets[x]]
            long = ends[c] - begins[c]
            place = np.arange(long.sum()) + np.repeat(begins[c] - (np.cumsum(long) - long), long)
            both = np.bincount(holders[place], minlength=len(right))[found]
        ok = found[both * t.denominator >= t.numerator * (n[x] + n[right[found]] - both)]
        a.append(np.repeat(keys[x], len(ok)))
        b.append(keys[right[ok]])
    x, y = (np.concatenate([np.zeros(0, object), *v]).astype(object) for v in (a, b))
    swap = x > y
    return pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y)}, dtype=object)


def verified(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Exact check on the full sets: keeps pairs with |both| / |either| >= threshold."""
    t = Fraction(str(threshold))
    for pdf in frames:
        keep = []
        for x, y in zip(pdf["items_a"], pdf["items_b"]):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(both * t.denominator >= t.numerator * (len(p) + len(q) - both))
        yield pdf.loc[keep, ["a", "b"]]


def latest_texts(docs: DataFrame) -> DataFrame:
    """(key, text) of each document's valid row in its highest snapshot: title, abstract and full_text as one text, nulls left out.

    Only keys are aggregated; texts are read once more against them, and spread by key, as a snapshot's texts may lie in a few files. Rows that tie in delivered_at all come out.
    """
    names = snapshot_names(docs)
    rows = numbered(docs.select(doc_key(F.col("doc_id")).alias("key"), "snapshot_id", "delivered_at", "title", "abstract", "full_text").where("key is not null"), names)
    when = F.struct("snap_no", "delivered_at")
    best = written(rows.groupBy("key").agg(F.max(when).alias("w")).select("key", "w.snap_no", "w.delivered_at"), "latest")
    n = best.count()
    j = rows.alias("r").join(bounded(best, n).alias("l"), (F.col("r.key") == F.col("l.key")) & (F.col("r.snap_no") == F.col("l.snap_no")) & F.col("r.delivered_at").eqNullSafe(F.col("l.delivered_at")), "left_semi")
    out = j.select("key", F.concat_ws(" ", "title", "abstract", "full_text").alias("text"))
    return out.repartition("key") if n <= BROADCAST_ROWS else out  # else the join has spread them


def _crowd_links(crowds: DataFrame, members: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """crowds(tree, label, key) of regions of more than LEAF texts, to links (a, b). Every text goes to the pairs of blocks that its block is in."""
    sizes = crowds.groupBy("tree", "label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = crowds.join(sizes, ["tree", "label"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    keys = bounded(members.where("key = rep").select("key", "cls").join(crowds.select("key").distinct(), "key", "left_semi"))
    texts = signed.select("key", "cls", "labels", "items").join(keys, ["key", "cls"], "left_semi").dropDuplicates(["key"]).drop("cls")
    rows = placed.join(texts, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("tree", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "labels", "items")
    return rows.groupBy("tree", "label", "i", "j").applyInPandas(lambda pdf: block_links(pdf, threshold), "a string, b string")


def near_duplicates(texts: DataFrame, *, threshold: float = 0.8, size: int = 5, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """texts(key, text) to (members, links).

    members(key, rep): every text of at least `least` distinct sequences of `size` words, and the least key of its class of equal sets.
    links(a, b): pairs of representatives, a < b, whose sets share at least `threshold`. If a key has several texts, one is taken (the largest set hash).
    Null texts, texts that are too short and an empty table give no rows.
    """
    signed = written(texts.where("key is not null and text is not null").mapInPandas(lambda frames: signatures(frames, size, least), _SIGNED), "signed")
    one = signed.groupBy("key").agg(F.max("cls").alias("cls"))
    classes = one.groupBy("cls").agg(F.min("key").alias("rep"))
    members = written(one.join(classes, "cls").select("key", "cls", "rep"), "members")
    reps = members.where("key = rep").select("key", "cls")
    placed = signed.select("key", "cls", "labels", "sketch").join(bounded(reps), ["key", "cls"], "left_semi").dropDuplicates(["key"])
    rows = placed.select("key", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "labels")
    rows = rows.select("tree", F.expr(f"substring(labels, tree * {DEPTH} + 1, {DEPTH})").alias("label"), "key", "sketch")
    rows = rows.repartition("tree", "label").sortWithinPartitions("tree", "label", "key")
    agree = int(SKETCH * max(0.0, threshold - 0.3))
    found = written(rows.mapInPandas(lambda frames: neighbours(frames, agree, crowd=LEAF), "a string, b string, tree int, label binary").distinct(), "found")
    pairs, crowds = found.where("b is not null").select("a", "b"), found.where("b is null").select("tree", "label", F.col("a").alias("key"))
    used = written(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "used")
    items = signed.join(bounded(members.where("key = rep").select("key", "cls").join(used, "key", "left_semi")), ["key", "cls"], "left_semi").select("key", "items").dropDuplicates(["key"])
    sides = pairs.join(items.select(F.col("key").alias("a"), F.col("items").alias("items_a")), "a").join(items.select(F.col("key").alias("b"), F.col("items").alias("items_b")), "b")
    links = written(sides.mapInPandas(lambda frames: verified(frames, threshold), "a string, b string"), "links")
    if not crowds.isEmpty():
        links = written(links.unionByName(written(_crowd_links(crowds, members, signed, threshold), "crowded")).distinct(), "links")
    return members.select("key", "rep"), links


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: links between all members of linked classes, and pairs within each class."""
    a = members.select(F.col("rep").alias("a"), F.col("key").alias("ka"))
    b = members.select(F.col("rep").alias("b"), F.col("key").alias("kb"))
    across = links.join(a, "a").join(b, "b").select(F.least("ka", "kb").alias("doc_a"), F.greatest("ka", "kb").alias("doc_b"))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    several = members.join(copies, "rep", "left_semi")
    within = several.select("rep", F.col("key").alias("doc_a")).join(several.select("rep", F.col("key").alias("doc_b")), "rep").where("doc_a < doc_b").select("doc_a", "doc_b")
    return across.unionByName(within)


def groups(members: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(doc_id, group_id, n_links): connected groups of near-duplicates, named by their least key; n_links counts linked classes of other texts.

    Least labels spread along links and then jump to the label of their label, so long chains take few rounds. Only classes with links take part.
    Ends when nothing changes; an error if `rounds` are given and don't reach that.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "label")
    done = 0
    while True:
        near = edges.join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, "a", "left").select("a", F.least("label", "near").alias("l"), F.col("label").alias("old"))
        jump = step.join(label.select(F.col("a").alias("l"), F.col("label").alias("up")), "l", "left")
        new = written(jump.select("a", F.least("l", F.coalesce("up", "l")).alias("label"), "old"), "label")
        changed = new.where("label <> old").count()
        label = new.select("a", "label")
        if not changed:
            break
        done += 1
        if done == rounds:
            raise RuntimeError(f"labels still change after {rounds} rounds")
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    known = label.join(degree, "a").withColumnRenamed("a", "rep")
    return members.join(known, "rep", "left").select(F.col("key").alias("doc_id"), F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
