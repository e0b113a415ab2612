"""Filling containers of fixed capacity: conflict-constrained best fit.

Items are cut only if they alone exceed the capacity. Items are spread over shards of bounded size at random, so a shard
is a fair sample of all sizes and sources, however hot one is, and is packed on its own: largest first, into the bin with the least
room that still takes the item. Bins are ordered by residual; each carries bitmaps of its sources and
duplicate clusters. The search starts at the tightest residual and moves on to the next while bins conflict. Two items of
one duplicate cluster (copies and near-duplicates, pieces of cut ones included) never share a container; among bins of equal
residual one without the item's source is taken first. Bins of one residual are held by source bitmap, and per residual it
is known how many bins hold a cluster, so a residual at which all bins conflict is passed at once and no look is cut short.
Containers that are left with much room are opened again and packed once more across shards.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import normalize_ws
from tidewater.llm.forest import groups, near_duplicates
from tidewater.session import written

CAPACITY = 2048
SHARD_ITEMS = 20_000
_OUT = "shard int, bin int, item long, doc_id string, piece int, n_tokens int"


def best_fit(pdf: pd.DataFrame, capacity: int) -> list[int]:
    """The bin of each row of pdf(n_tokens, source, cluster); items of size 0 take any bin. A null cluster conflicts with nothing."""
    repeated = pdf["cluster"].value_counts()
    bit = {c: i for i, c in enumerate(repeated.index[repeated > 1])}
    mark = {s: i for i, s in enumerate(pdf["source"].dropna().unique())}
    at_residual: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]  # by source bitmap
    n_bins = [0] * (capacity + 1)
    holding: list[Counter] = [Counter() for _ in range(capacity + 1)]  # bins that hold a cluster
    nonempty = 0
    clusters: list[int] = []
    inside: list[list[int]] = []
    sources: list[int] = []
    out = [0] * len(pdf)
    order = pdf["n_tokens"].to_numpy().argsort(kind="stable")[::-1]
    sizes, cl, so = pdf["n_tokens"].tolist(), pdf["cluster"].tolist(), pdf["source"].tolist()
    for row in order:
        size = sizes[row]
        if size == 0:
            break
        at = bit.get(cl[row], -1)
        own = 1 << at if at >= 0 else 0
        src = 1 << mark[so[row]] if so[row] in mark else 0
        b = -1
        rest = nonempty >> size
        residual = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            residual += step
            if not own or holding[residual][at] < n_bins[residual]:
                # bitmaps without the source first
                for taken in sorted(at_residual[residual], key=lambda m: bool(m & src)):
                    bins = at_residual[residual][taken]
                    i = next((i for i in range(len(bins) - 1, -1, -1) if not own & clusters[bins[i]]), -1)
                    if i >= 0:
                        b = bins.pop(i)
                        if not bins:
                            del at_residual[residual][taken]
                        break
                if b >= 0:
                    break
            rest >>= step + 1
            residual += 1
        if b >= 0:
            n_bins[residual] -= 1
            if not n_bins[residual]:
                nonempty &= ~(1 << residual)
            for c in inside[b]:
                holding[residual][c] -= 1
        else:
            b, residual = len(clusters), capacity
            clusters.append(0)
            inside.append([])
            sources.append(0)
        if own:
            clusters[b] |= own
            inside[b].append(at)
        sources[b] |= src
        out[row] = b
        left = residual - size
        if left:
            at_residual[left].setdefault(sources[b], []).append(b)
            n_bins[left] += 1
            for c in inside[b]:
                holding[left][c] += 1
            nonempty |= 1 << left
    return out


def _packed(items: DataFrame, capacity: int, shard_items: int, n: int) -> DataFrame:
    shards = max(1, -(-n // shard_items))
    kind = items.schema["doc_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # an order that doesn't depend on how rows arrived
        pdf = pdf.sort_values(["n_tokens", "h", "piece"], kind="stable").reset_index(drop=True)
        return pdf.assign(bin=best_fit(pdf, capacity))[["shard", "bin", "item", "doc_id", "piece", "n_tokens"]]

    # as strings, since pandas has no whole numbers beside nulls
    spread = items.withColumn("h", F.xxhash64("doc_id", "piece")).withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    return spread.groupBy("shard").applyInPandas(run, _OUT).withColumn("doc_id", F.col("doc_id").cast(kind))


def duplicate_clusters(docs: DataFrame) -> DataFrame:
    """(doc_id, cluster) of the documents that have near-duplicates (0.8 of their sequences of five words in common) or copies of five words or more; doc_id as text."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("key"), "text")
    found = written(groups(*near_duplicates(texts)), "clusters")
    several = found.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_id")
    return found.join(several, "group_id", "left_semi").select("doc_id", F.xxhash64("group_id").alias("cluster"))


def sized_items(docs: DataFrame, count, capacity: int = CAPACITY, clusters: DataFrame | None = None) -> DataFrame:
    """(doc_id, piece, n_tokens, source, cluster) of docs(doc_id, text, source): pieces of at most `capacity` tokens.

    clusters(doc_id as text, cluster), one row per doc_id, names clusters; of other documents copies of a text (white space aside) are one. All pieces of a text are of its cluster.
    """
    own = F.when(F.length("text") > 0, F.xxhash64(normalize_ws(F.col("text"))))
    sized = docs.select("doc_id", "source", count(F.col("text")).alias("n"), own.alias("cluster"))
    if clusters is not None:
        named = clusters.select(F.col("doc_id").alias("_id"), F.col("cluster").alias("_named"))
        sized = sized.join(named, F.col("doc_id").cast("string") == F.col("_id"), "left").select("doc_id", "source", "n", F.coalesce("_named", "cluster").alias("cluster"))
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1))
    cut = sized.select("doc_id", "source", "cluster", "n", F.explode(pieces).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("n_tokens"), "source", "cluster")


def pack(items: DataFrame, *, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, full: float = 0.98, rounds: int = 2) -> DataFrame:
    """(container_id, doc_id, piece, n_tokens): every item in one container of at most `capacity` tokens.

    Items of 0 tokens (null and empty texts) are put in some container too. An empty table gives no rows.
    Pieces of a cut text are kept from each other and from those of its copies. doc_ids should be unique; rows that repeat one are items of their own.
    """
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "items")  # written, so the numbers stay
    done: DataFrame | None = None
    current = items
    for r in range(rounds):
        n = current.count()
        if not n:
            break
        bins = written(_packed(current, capacity, shard_items, n), "bins").withColumn("round", F.lit(r))
        if r + 1 == rounds or n <= shard_items:
            part = bins
            current = None
        else:
            fill = bins.groupBy("shard", "bin").agg(F.sum("n_tokens").alias("fill"))
            marked = bins.join(fill, ["shard", "bin"]).withColumn("open", F.col("fill") < full * capacity)
            part = marked.where("not open").drop("fill", "open")
            current = written(items.join(marked.where("open").select("item"), "item", "left_semi"), "again")
        done = part if done is None else done.unionByName(part)
        if current is None:
            break
    if done is None:
        return items.select(F.lit(None).cast("long").alias("container_id"), "doc_id", "piece", "n_tokens")
    number = F.shiftleft(F.col("round").cast("long"), 60) + F.shiftleft(F.col("shard").cast("long"), 24) + F.col("bin")
    return done.select(number.alias("container_id"), "doc_id", "piece", "n_tokens")


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused room, and the fewest containers that could hold the tokens."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("fill").alias("n_tokens"), F.sum(capacity - F.col("fill")).alias("n_unused"), F.ceil(F.sum("fill") / capacity).alias("least_containers"))


def packing_faults(items: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row that should be all zero but n_docs: containers over capacity, items missing or twice, items that share a container with one of their cluster
    (of items with a doc_id), and containers beyond 1.01 times the fewest that could hold the tokens, and one.

    A conflict can force more containers than that: the largest cluster needs one for each of its items, which counts as the least then.
    """
    over = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("f")).agg(F.count_if(F.col("f") > capacity).alias("n_over"))
    seen = items.select("doc_id", "piece", F.lit(1).alias("a")).unionByName(packed.select("doc_id", "piece", F.lit(-1).alias("a"))).groupBy("doc_id", "piece").agg(F.sum("a").alias("a")).agg(F.count_if(F.col("a") != 0).alias("n_lost"))
    shared = packed.join(items.where("cluster is not null").select("doc_id", "piece", "cluster").distinct(), ["doc_id", "piece"]).groupBy("container_id", "cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_conflicts"))
    docs = items.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    crowd = items.where("cluster is not null and n_tokens > 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("crowd"))
    least = F.greatest(F.ceil(F.sum("fill") / capacity), F.first("crowd"))
    waste = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill")).crossJoin(F.broadcast(crowd)).agg(F.greatest(F.count(F.lit(1)) - F.floor(least * 1.01) - 1, F.lit(0)).alias("n_wasted"))
    return docs.crossJoin(over).crossJoin(seen).crossJoin(shared).crossJoin(waste)  # one row each
