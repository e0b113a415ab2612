"""References to records that do not exist: pending-orphan state, kept per key and advanced period by period.

State, one row per parent key: `first_period` (when the parent first arrived), and whether the current and the last
snapshot hold it. Hot state, one row per reference (table, period, key) whose parent has never been there: it waits as `missing`.
For each new period, in order,
- the new references probe the parent index: present parents satisfy them, parents gone before make them
  `removed`, the rest wait;
- arriving parents resolve references that wait (`missing` becomes `later`).
Whatever is settled is written once and not touched again: whether a settled reference is open just now is that of its parent,
so parents that vanish reopen references, and parents that return close them, by a join of the parents that moved
with the references of earlier periods, of which the others' keys are read but not written.
Every step is a join on the key of the state with one period's rows; nothing is collected but period names.
The state is written to the shared folder after each period, so a lost executor costs one period at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.snapshots import doc_key, numbered, snapshot_names
from tidewater.session import written


@dataclass
class OrphanState:
    """index(doc_id, first_period, present, was), waiting(ref_table, period, doc_id), settled(... status) and counts, a DataFrame per period each."""

    index: DataFrame
    waiting: DataFrame
    settled: list[DataFrame]
    seen: list[DataFrame]
    counts: list[DataFrame]


def empty_state(spark) -> OrphanState:
    return OrphanState(
        spark.createDataFrame([], "doc_id string, first_period int, present boolean, was boolean"),
        spark.createDataFrame([], "ref_table string, period int, doc_id string"),
        [],
        [],
        [],
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def advance(state: OrphanState, period: int, parents: DataFrame, refs: DataFrame) -> OrphanState:
    """One period. parents(doc_id) and refs(ref_table, doc_id) are distinct and of this period only."""
    arrived = parents.select("doc_id", F.lit(True).alias("here"))
    index = state.index.join(arrived, "doc_id", "full_outer").select(
        "doc_id",
        F.coalesce("first_period", F.lit(period)).alias("first_period"),
        F.coalesce("here", F.lit(False)).alias("present"),
        F.coalesce("present", F.lit(False)).alias("was"),
    )
    index = written(index, "parents")
    new = refs.select("ref_table", F.lit(period).alias("period"), "doc_id", F.lit(True).alias("fresh"))
    probe = state.waiting.withColumn("fresh", F.lit(False)).unionByName(new).join(index, "doc_id", "left")
    known, here = F.col("first_period").isNotNull(), F.coalesce("present", F.lit(False))
    status = F.when(F.col("fresh"), F.when(here, "satisfied").when(known, "removed").otherwise("missing")).when(known, "later").otherwise("missing")
    moved = written(probe.select("ref_table", "period", "doc_id", "fresh", status.alias("status")), "refs")
    waiting = moved.where("status = 'missing'").select("ref_table", "period", "doc_id")
    settled = moved.where("status <> 'missing'").select("ref_table", "period", "doc_id", "status")
    counts = moved.where("fresh").groupBy("ref_table").agg(F.count_if(F.col("status") != "satisfied").alias("new_orphans")).withColumns({"resolved": F.lit(0).cast("long"), "reopened": F.lit(0).cast("long")})
    if state.seen:
        turned = index.where("present <> was").select("doc_id", "present")
        back = _all(state.seen).join(turned, "doc_id").groupBy("ref_table").agg(F.count_if("present").alias("resolved"), F.count_if(~F.col("present")).alias("reopened"))
        counts = counts.unionByName(back.withColumn("new_orphans", F.lit(0).cast("long")))
    return OrphanState(index, waiting, [*state.settled, settled], [*state.seen, refs.select("ref_table", "doc_id")], [*state.counts, counts.withColumn("period", F.lit(period))])


def reference_rows(search_results: DataFrame, citation_features: DataFrame) -> DataFrame:
    """(ref_table, snapshot_id, doc_id), distinct: what the two tables name. Aggregated before it is shuffled, so no key is hot."""
    sr = search_results.select(F.lit("search_results").alias("ref_table"), "snapshot_id", doc_key(F.col("doc_id")).alias("doc_id"))
    cf = citation_features.where("total_inbound_citations > 0").select(F.lit("citation_features").alias("ref_table"), "snapshot_id", doc_key(F.col("doc_id")).alias("doc_id"))
    return sr.unionByName(cf).where("doc_id is not null and snapshot_id is not null").distinct()


def run_periods(documents: DataFrame, refs: DataFrame) -> tuple[OrphanState, list[str]]:
    """Advances the state over all periods (snapshot_ids of either side, in order). Null and blank keys are ignored; late rows count for the period they name."""
    parents = documents.select(doc_key(F.col("doc_id")).alias("doc_id"), "snapshot_id").where("doc_id is not null and snapshot_id is not null").distinct()
    refs = written(refs, "refs")
    names = snapshot_names(parents.select("snapshot_id").unionByName(refs.select("snapshot_id")))
    parents = written(numbered(parents, names).select("doc_id", "snap_no"), "parents")
    refs = numbered(refs, names)
    state = empty_state(documents.sparkSession)
    for i in range(1, len(names) + 1):
        state = advance(state, i, parents.where(F.col("snap_no") == i).select("doc_id"), refs.where(F.col("snap_no") == i).select("ref_table", "doc_id"))
    return state, names


def _name(names: list[str], c: str):
    return F.element_at(F.array(*(F.lit(x) for x in names)), F.col(c)) if names else F.lit(None).cast("string")


def orphans(documents: DataFrame, search_results: DataFrame, citation_features: DataFrame) -> DataFrame:
    """(ref_table, snapshot_id, doc_id, reason), one row per orphan. Empty tables give no rows; repeated rows one."""
    state, names = run_periods(documents, reference_rows(search_results, citation_features))
    open_ = _all([state.waiting.withColumn("status", F.lit("missing")), *state.settled]).where("status <> 'satisfied'")
    return open_.select("ref_table", _name(names, "period").alias("snapshot_id"), "doc_id", F.col("status").alias("reason"))


def orphan_counts(documents: DataFrame, search_results: DataFrame, citation_features: DataFrame) -> DataFrame:
    """Per period and table: new orphans, references resolved or reopened by this period's parents, and all that are open."""
    state, names = run_periods(documents, reference_rows(search_results, citation_features))
    if not state.counts:
        return documents.sparkSession.createDataFrame([], "ref_table string, snapshot_id string, new_orphans long, resolved long, reopened long, open_refs long")
    sums = _all(state.counts).groupBy("ref_table", "period").agg(*(F.sum(c).alias(c) for c in ("new_orphans", "resolved", "reopened")))
    # a row for each table and period from the table's first reference on; a few rows a period
    first = sums.groupBy("ref_table").agg(F.min("period").alias("first"))
    grid = first.select("ref_table", F.explode(F.sequence("first", F.lit(len(names)))).alias("period"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    every = grid.join(sums, ["ref_table", "period"], "left").select("ref_table", "period", *(z(c).alias(c) for c in ("new_orphans", "resolved", "reopened")))
    every = every.withColumn("open_refs", F.sum(F.col("new_orphans") + F.col("reopened") - F.col("resolved")).over(Window.partitionBy("ref_table").orderBy("period")))
    return every.select("ref_table", _name(names, "period").alias("snapshot_id"), "new_orphans", "resolved", "reopened", "open_refs")
