"""Valid rows of a table that is delivered in full, again and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import strip


def doc_key(c: Column) -> Column:
    """doc_id without surrounding white space; blank becomes null."""
    return F.nullif(strip(c), F.lit(""))


def snapshot_order(c: Column) -> Column:
    """Sort key of snapshot names: the trailing number, else nothing, then the name."""
    return F.struct(F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, r"(\d{1,15})$", 1), F.lit("")), F.lit("9" * 15)).cast("long"), F.lit(-1)), c)


def snapshot_names(df: DataFrame) -> list[str]:
    """The distinct snapshot_ids in order. One name per delivery: bounded by the number of deliveries, not by rows."""
    got = df.where(F.col("snapshot_id").isNotNull()).select("snapshot_id").distinct().orderBy(snapshot_order(F.col("snapshot_id"))).collect()
    return [r[0] for r in got]


def numbered(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds snap_no (1-based place of snapshot_id in `names`); rows of other or null snapshots are dropped."""
    if not names:
        return df.withColumn("snap_no", F.lit(0)).where(F.lit(False))
    places = F.create_map(*(x for i, n in enumerate(names, 1) for x in (F.lit(n), F.lit(i))))
    return df.withColumn("snap_no", F.try_element_at(places, F.col("snapshot_id"))).where(F.col("snap_no").isNotNull())
