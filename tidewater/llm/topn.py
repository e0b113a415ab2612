"""The N best items of every group, by descending score bands.

Scores are cut into bands at quantiles of each partition key (here: the run), narrow at the top. The rows are written once,
a folder per band, so a band reads its own rows only. Bands are worked from the top: the rows of one band are joined against the groups that are already full (anti-join), a
group's items that a higher band already gave are left out, and the rest are ranked exactly, with all ties, as equal scores
always share a band. A group leaves as soon as it has N items, so the low rows of big groups are never deduplicated or sorted.

A group may hold a third of all rows: duplicates fold before the exchange, on a key that includes the item;
ranks use a window with a group limit, which keeps at most N rows a group and task before the exchange;
the anti-join is split by AQE where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.snapshots import doc_key
from tidewater.session import bounded, written

#: Shares of the rows of a run that lie above each band edge.
BANDS = (0.05, 0.25)
#: Rank of items that have no positive rank: after all others.
_NO_RANK = 2**31


def _null_safe(names: list[str], a: str, b: str) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return on


def top_n(rows: DataFrame, *, keys: tuple[str, ...], n: int = 10, bands: tuple[float, ...] = BANDS, accuracy: int = 1000) -> DataFrame:
    """The first n items of each group: columns keys, item, score, rank, top_no.

    rows has keys, item, score, rank. Rows with a null item, or a null or NaN score, don't count. An item counts once per group,
    with its highest score and the smallest positive rank among its rows of that score. Order: score descending, then
    rank (none last), then item. Null keys are groups of their own. Infinite scores count. An empty table gives no rows.
    Bands only order the work: any edges give the same result.
    """
    keys = list(keys)
    rank = F.when(F.col("rank") > 0, F.col("rank").cast("long")).otherwise(F.lit(_NO_RANK))
    rows = rows.where(F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    rows = rows.select(*keys, "item", (F.col("score") + F.lit(0.0)).alias("score"), rank.alias("rank"))
    edges = rows.groupBy(keys[0]).agg(F.percentile_approx("score", [1 - b for b in bands], accuracy).alias("edges"))
    edges = written(edges, "edges")
    banded = rows.alias("a").join(bounded(edges).alias("b"), F.col(f"a.{keys[0]}").eqNullSafe(F.col(f"b.{keys[0]}")))
    number = F.lit(len(bands))
    for i in reversed(range(len(bands))):
        number = F.when(F.col("score") >= F.try_element_at("edges", F.lit(i + 1)), i).otherwise(number)
    banded = banded.select(*(F.col(f"a.{k}").alias(k) for k in keys), "item", "score", "rank", number.alias("band"))
    banded = written(banded, "banded", by="band")
    done: DataFrame | None = None
    for band in range(len(bands) + 1):
        part = banded.where(F.col("band") == band).drop("band")
        if done is not None:
            # A full group needs nothing more; of an open group, the items that a higher band gave are left out.
            taken = done.select(*keys, "item")
            full = done.where(F.col("top_no") == n).select(*keys)
            part = part.alias("a").join(bounded(full).alias("b"), _null_safe(keys, "a", "b"), "left_anti")
        # max of (score, -rank): numbers only, folded before the exchange
        best = part.groupBy(*keys, "item").agg(F.max("score").alias("score"), F.max(F.struct("score", -F.col("rank"))).alias("s"))
        best = best.select(*keys, "item", "score", (-F.col("s.col2")).alias("rank"))
        start = None
        if done is not None:
            best = best.alias("a").join(taken.alias("b"), _null_safe([*keys, "item"], "a", "b"), "left_anti")
            start = done.groupBy(*keys).agg(F.max("top_no").alias("had"))
        w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "rank", "item")
        best = best.withColumn("top_no", F.row_number().over(w)).where(F.col("top_no") <= n)
        if start is not None:
            best = best.alias("a").join(start.alias("b"), _null_safe(keys, "a", "b"), "left")
            best = best.select(*(F.col(f"a.{c}").alias(c) for c in (*keys, "item", "score", "rank")), (F.col("a.top_no") + F.coalesce("b.had", F.lit(0))).alias("top_no")).where(F.col("top_no") <= n)
        best = written(best.withColumn("top_no", F.col("top_no").cast("long")), f"band{band}")
        done = best if done is None else done.unionByName(best)
    return done


def top_documents(search_results: DataFrame, n: int = 10) -> DataFrame:
    """(run_name, query_id, doc_id, top_no) of search_results: rows without query_id or doc_id are ignored, doc_ids come out trimmed."""
    rows = search_results.where("query_id is not null").select("run_name", "query_id", doc_key(F.col("doc_id")).alias("item"), "score", "rank")
    return top_n(rows, keys=("run_name", "query_id"), n=n).select("run_name", "query_id", F.col("item").alias("doc_id"), "top_no")
