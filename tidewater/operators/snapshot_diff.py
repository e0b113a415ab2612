"""What changed between full snapshots: invertible Bloom lookup tables per hash bucket.

Each snapshot row becomes an element (key hash, value hash), 128 bits each. Elements fall
into hash buckets; per bucket a table of cells (three cells per element, one in each third of the table)
holds counts and XOR sums. The tables of consecutive snapshots are subtracted, so what they share
cancels, and what differs is peeled out of the rest cell by cell. Buckets that can't be peeled, or whose
digest doesn't match what was peeled, are made again with larger tables; what is still left after
`rounds` goes through an exact comparison by key. Only the rows of failed buckets are read again.

Shuffle volume: cells, not rows; map-side aggregation folds the rows of a bucket before the exchange.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.hashing import xxhash64_longs
from tidewater.operators.snapshots import doc_key, numbered, snapshot_names
from tidewater.session import bounded, written

_LONGS = ("k1", "k2", "v1", "v2")
_CHECK, _DIGEST, _CELL, _BUCKET = 101, 102, 103, 104


def abstract_form(c: Column) -> Column:
    """Text as it is compared: runs of spaces, tabs, line ends and no-break spaces are one space; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[ \\t\\n\\r\\x0b\\x0c\\u0085\\u00a0\\u2007\\u202f\\u2028\\u2029]+", " "))


def elements(docs: DataFrame, value: Column, names: list[str]) -> DataFrame:
    """One row per snapshot and key, from the row with the latest delivered_at (ties: the larger value hash).

    Only hashes of the value are shuffled. Rows without a key or snapshot are dropped; a null delivered_at is the earliest.
    """
    rows = numbered(docs.select(doc_key(F.col("doc_id")).alias("key"), "snapshot_id", "delivered_at", value.alias("value")).where("key is not null"), names)
    v = F.struct(F.col("delivered_at"), F.xxhash64("value").alias("v1"), F.xxhash64(F.lit("value"), "value").alias("v2"))
    latest = rows.groupBy("snap_no", "key").agg(F.max(v).alias("v"))
    return latest.select("snap_no", "key", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("key"), "key").alias("k2"), "v.v1", "v.v2")


def _tables(elems: DataFrame, buckets: int, cells: int, last: int, only: DataFrame | None) -> DataFrame:
    """Subtracted tables: one row per (pair, bucket, cell) that isn't empty; pair is the number of the later snapshot."""
    third = cells // 3
    e = elems.withColumn("bucket", F.pmod(F.xxhash64(F.lit(_BUCKET).cast("long"), "k1", "k2"), F.lit(buckets)))
    hashed = lambda tag: F.xxhash64(F.lit(tag).cast("long"), *_LONGS)
    place = lambda j: (F.pmod(F.xxhash64(F.lit(_CELL + 10 * j).cast("long"), F.lit(cells).cast("long"), *_LONGS), F.lit(third)) + j * third).cast("int")
    e = e.select("snap_no", "bucket", *_LONGS, hashed(_CHECK).alias("check"), hashed(_DIGEST).alias("digest"), F.explode(F.array(*(place(j) for j in range(3)))).alias("cell"))
    if only is None:
        folded = e.groupBy("snap_no", "bucket", "cell").agg(F.count(F.lit(1)).alias("n"), *(F.bit_xor(c).alias(c) for c in (*_LONGS, "check", "digest")))
        sides = F.array(F.struct(F.col("snap_no").alias("pair"), F.lit(1).alias("sign")), F.struct((F.col("snap_no") + 1).alias("pair"), F.lit(-1).alias("sign")))
        signed = folded.select("*", F.inline(sides)).where(F.col("pair").between(2, last))
    else:
        sides = F.array(F.struct(F.col("snap_no").alias("pair"), F.lit(1).alias("sign")), F.struct((F.col("snap_no") + 1).alias("pair"), F.lit(-1).alias("sign")))
        signed = e.select("*", F.lit(1).alias("n"), F.inline(sides)).join(only, ["pair", "bucket"], "left_semi")
    cut = signed.groupBy("pair", "bucket", "cell").agg(F.sum(F.col("sign") * F.col("n")).alias("n"), *(F.bit_xor(c).alias(c) for c in (*_LONGS, "check", "digest")))
    return cut.where("n <> 0 or k1 <> 0 or k2 <> 0 or v1 <> 0 or v2 <> 0 or check <> 0")


_PEELED = "pair int, bucket long, ok boolean, sign int, k1 long, k2 long"


def peel(pdf: pd.DataFrame, cells: int) -> pd.DataFrame:
    """Peels every (pair, bucket) of pdf at once. One row per recovered element, or one row with ok false for a bucket that failed."""
    third = cells // 3
    codes, groups = pd.factorize(pd.MultiIndex.from_arrays([pdf["pair"], pdf["bucket"]]))
    size = len(groups) * cells
    at = codes.astype(np.int64) * cells + pdf["cell"].to_numpy(np.int64)
    held = {c: np.zeros(size, np.int64) for c in ("n", *_LONGS, "check", "digest")}
    for c, a in held.items():
        a[at] = pdf[c].to_numpy(np.int64)
    digest = np.bitwise_xor.reduce(held["digest"].reshape(len(groups), cells)[:, :third], axis=1)
    found: list[np.ndarray] = []
    live = np.unique(at)
    while len(live):
        pure = live[np.abs(held["n"][live]) == 1]
        pure = pure[xxhash64_longs(_CHECK, *(held[c][pure] for c in _LONGS)) == held["check"][pure]]
        if not len(pure):
            break
        got = np.column_stack([pure // cells, held["n"][pure], *(held[c][pure] for c in _LONGS)])
        got = np.unique(got, axis=0)
        found.append(got)
        g, sign = got[:, 0], got[:, 1]
        parts = [np.ascontiguousarray(got[:, i]) for i in range(2, 6)]
        check = xxhash64_longs(_CHECK, *parts)
        touched = []
        for j in range(3):
            h = xxhash64_longs(_CELL + 10 * j, cells, *parts)
            to = g * cells + np.mod(h, third) + j * third
            np.subtract.at(held["n"], to, sign)
            for c, p in zip((*_LONGS, "check"), (*parts, check)):
                np.bitwise_xor.at(held[c], to, p)
            touched.append(to)
        live = np.unique(np.concatenate(touched))
    rest = sum((held[c] != 0).astype(np.int8) for c in ("n", *_LONGS, "check")).reshape(len(groups), cells).any(axis=1)
    every = np.concatenate(found) if found else np.zeros((0, 6), np.int64)
    own = np.zeros(len(groups), np.int64)
    np.bitwise_xor.at(own, every[:, 0], xxhash64_longs(_DIGEST, *(np.ascontiguousarray(every[:, i]) for i in range(2, 6))) if len(every) else np.zeros(0, np.int64))
    ok = ~rest & (own == digest)
    pair = groups.get_level_values(0).to_numpy(np.int32)
    bucket = groups.get_level_values(1).to_numpy(np.int64)
    keep = every[ok[every[:, 0]]]
    good = pd.DataFrame({"pair": pair[keep[:, 0]], "bucket": bucket[keep[:, 0]], "ok": True, "sign": keep[:, 1].astype(np.int32), "k1": keep[:, 2], "k2": keep[:, 3]})
    bad = pd.DataFrame({"pair": pair[~ok], "bucket": bucket[~ok], "ok": False, "sign": np.int32(0), "k1": np.int64(0), "k2": np.int64(0)})
    return pd.concat([good, bad], ignore_index=True)


def _recovered(cut: DataFrame, cells: int, groups: int, pairs: int) -> DataFrame:
    per_task = max(1, 100_000 // cells)
    spread = F.pmod(F.xxhash64(F.col("bucket")), F.lit(max(1, -(-groups * pairs // per_task))))
    return written(cut.withColumn("part", spread).groupBy("part").applyInPandas(lambda pdf: peel(pdf, cells), _PEELED), "peeled")


def snapshot_changes(docs: DataFrame, value: Column | None = None, *, names: list[str] | None = None, bucket_rows: int = 1024, expected_change: float = 0.1, rounds: int = 4) -> DataFrame:
    """(snapshot_id, doc_id, change_kind) between each snapshot and the one just before.

    docs needs doc_id, snapshot_id, delivered_at and what `value` (default: abstract_form of abstract) uses;
    further columns are ignored. An empty table, or one snapshot, gives no rows. Null and blank keys are ignored;
    a null value equals ''. expected_change only sizes the first tables: a wrong guess costs another round, never rows.
    """
    names = snapshot_names(docs) if names is None else names
    elems = written(elements(docs, abstract_form(F.col("abstract")) if value is None else value, names), "elements")
    total = elems.count()
    buckets = max(1, -(-total // max(1, len(names)) // bucket_rows))
    cells = 3 * max(16, int(bucket_rows * expected_change * 2))
    cut = _tables(elems, buckets, cells, len(names), None)
    parts = [_recovered(cut, cells, buckets, max(1, len(names) - 1))]
    failed = written(parts[0].where("not ok").select("pair", "bucket"), "failed")
    n = failed.count()
    for _ in range(rounds):
        if not n:
            break
        cells *= 4
        cut = _tables(elems, buckets, cells, len(names), bounded(failed, n))
        parts.append(_recovered(cut, cells, n, 1))
        failed = written(parts[-1].where("not ok").select("pair", "bucket"), "failed")
        n = failed.count()
    found = parts[0].where("ok")
    for p in parts[1:]:
        found = found.unionByName(p.where("ok"))
    kinds = found.groupBy("pair", "k1", "k2").agg(F.max(F.col("sign") > 0).alias("later"), F.max(F.col("sign") < 0).alias("earlier"))
    if n:
        kinds = kinds.unionByName(_exact(elems, buckets, bounded(failed, n)))
    kinds = kinds.withColumn("snap_no", F.when(F.col("later"), F.col("pair")).otherwise(F.col("pair") - 1))
    kind = F.when(F.col("later") & F.col("earlier"), "changed").when(F.col("later"), "added").otherwise("removed")
    name = F.element_at(F.array(*(F.lit(x) for x in names)), F.col("pair")) if names else F.lit(None).cast("string")
    return kinds.join(elems.select("snap_no", "k1", "k2", "key"), ["snap_no", "k1", "k2"]).select(name.alias("snapshot_id"), F.col("key").alias("doc_id"), kind.alias("change_kind"))


def _exact(elems: DataFrame, buckets: int, failed: DataFrame) -> DataFrame:
    """The buckets that no table size could peel, compared key by key."""
    e = elems.withColumn("bucket", F.pmod(F.xxhash64(F.lit(_BUCKET).cast("long"), "k1", "k2"), F.lit(buckets)))
    sides = F.array(F.struct(F.col("snap_no").alias("pair"), F.lit(True).alias("late")), F.struct((F.col("snap_no") + 1).alias("pair"), F.lit(False).alias("late")))
    e = e.select("bucket", *_LONGS, F.inline(sides)).join(failed, ["pair", "bucket"], "left_semi")
    v = F.struct("v1", "v2")
    both = e.groupBy("pair", "k1", "k2").agg(F.max(F.when(F.col("late"), v)).alias("a"), F.max(F.when(~F.col("late"), v)).alias("b"))
    return both.where("a is null or b is null or a <> b").select("pair", "k1", "k2", F.col("a").isNotNull().alias("later"), F.col("b").isNotNull().alias("earlier"))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("snapshot_id", "change_kind").agg(F.count(F.lit(1)).alias("n_docs"))
