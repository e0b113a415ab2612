"""From a decision to an index: full and incremental builds beside the live one, and promotion by switching a pointer.

Versions are folders that are never changed once written. A pointer file names the live one, so that promotion is one small write,
and what was live stays as it was.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import lexical
from tidewater.plans.vectors import Encoder, ensure_vectors
from tidewater.session import exists, read_text, write_text
from tidewater.sources.readers import within


#: Bytes of a row group of the postings: small ones, so that a search reads little beside its terms.
POSTING_BLOCK = 8 << 20


@dataclass(frozen=True)
class Outcome:
    state: str
    level: int
    cutoff: str | None
    shadow: str | None = None
    n_docs: int = 0
    strategy: str | None = None
    dense: str | None = None


def _count(tokens: DataFrame, root: str, version: str) -> None:
    """Writes frequencies, from the postings as written, and statistics."""
    lexical.document_frequencies(tokens.sparkSession.read.parquet(f"{root}/{version}/postings")).write.parquet(f"{root}/{version}/frequencies")
    lexical.collection_stats(tokens).coalesce(1).write.parquet(f"{root}/{version}/stats")


def build(docs: DataFrame, root: str, version: str) -> int:
    """Writes the index tables of docs(doc_id, text); the number of documents."""
    tokens = lexical.tokenized(docs)
    tokens.write.parquet(f"{root}/{version}/tokens")
    tokens = docs.sparkSession.read.parquet(f"{root}/{version}/tokens")
    post = lexical.postings(tokens)
    post.repartitionByRange("term").sortWithinPartitions("term").write.option("parquet.block.size", POSTING_BLOCK).parquet(f"{root}/{version}/postings")
    _count(tokens, root, version)
    return tokens.count()


def merge(spark: SparkSession, root: str, live: str, delta: DataFrame, version: str) -> int:
    """A new version of the live index and a delta (doc_id, text): only the delta is tokenized; where a document is in both, the delta's holds."""
    new = lexical.tokenized(delta)
    new.write.parquet(f"{root}/{version}/delta")
    new = spark.read.parquet(f"{root}/{version}/delta")
    old = spark.read.parquet(f"{root}/{live}/tokens").join(new.select("doc_id"), "doc_id", "left_anti")
    old.unionByName(new).write.parquet(f"{root}/{version}/tokens")
    tokens = spark.read.parquet(f"{root}/{version}/tokens")
    kept = spark.read.parquet(f"{root}/{live}/postings").join(new.select("doc_id"), "doc_id", "left_anti")
    post = kept.unionByName(lexical.postings(new))
    post.repartitionByRange("term").sortWithinPartitions("term").write.option("parquet.block.size", POSTING_BLOCK).parquet(f"{root}/{version}/postings")
    _count(tokens, root, version)
    return new.count()


def live_version(spark: SparkSession, root: str) -> str | None:
    text = read_text(spark, f"{root}/LIVE")
    return json.loads(text)["version"] if text else None


def promote(spark: SparkSession, root: str, version: str) -> None:
    """Makes a version live; the one before is named in the pointer and stays. All of it goes through the Hadoop file system, so the root may lie on any store."""
    if not exists(spark, f"{root}/{version}/stats/_SUCCESS"):
        raise ValueError(f"{version} isn't complete")
    write_text(spark, f"{root}/LIVE", json.dumps({"version": version, "previous": live_version(spark, root)}))


def load(spark: SparkSession, root: str, version: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, document frequencies, collection stats) of a version, the live one by default."""
    version = version or live_version(spark, root)
    if version is None:
        raise ValueError(f"{root} has no live index")
    return tuple(spark.read.parquet(f"{root}/{version}/{t}") for t in ("postings", "frequencies", "stats"))


def search(spark: SparkSession, root: str, topics: DataFrame, k: int = 1000, k1: float = lexical.K1, b: float = lexical.B, version: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) from a stored index."""
    return lexical.indexed_search(*load(spark, root, version), topics, k, k1, b)


def step(spark: SparkSession, root: str, docs: DataFrame, decision: dict | None, *, after_s: int, upto_s: int, execute: bool = False, promote_now: bool = False, vectors: Encoder | None = None) -> Outcome:
    """One turn of the loop, for the latest actionable decision (a row as a dict, or None). docs(doc_id, text, published_s).

    States: no_action, soft_alert_only, plan (what would be done), incremental_shadow_built, shadow_built, promoted. Level 2 adds what was
    published in (after, upto] to the live index; level 3, or the lack of a live index, builds anew.
    With `vectors` level 3 also builds the vector index; below, the outcome says that it was left out.
    """
    if decision is None or decision["level"] == 0:
        return Outcome("no_action", 0, None)
    level, cutoff = decision["level"], decision["week_start"]
    if level == 1:
        return Outcome("soft_alert_only", 1, cutoff)
    live = live_version(spark, root)
    strategy = "incremental" if level == 2 and live else "full"
    if not execute:
        return Outcome("plan", level, cutoff, strategy=strategy)
    version = f"v{time.time_ns()}"
    if strategy == "incremental":
        n = merge(spark, root, live, within(docs, after_s, upto_s).select("doc_id", "text"), version)
    else:
        n = build(docs.where(F.col("published_s") <= upto_s).select("doc_id", "text"), root, version)
    dense = None
    if vectors is not None:
        dense = "dense_build_skipped_level_below_3" if level < 3 else f"{ensure_vectors(docs.where(F.col('published_s') <= upto_s).select('doc_id', 'text'), root + '/' + version + '/vectors', vectors)} vectors encoded"
    done = Outcome("incremental_shadow_built" if strategy == "incremental" else "shadow_built", level, cutoff, version, n, strategy, dense)
    write_text(spark, f"{root}/{version}/manifest.json", json.dumps(asdict(done)))
    if promote_now:
        promote(spark, root, version)
        done = Outcome("promoted", level, cutoff, version, n, strategy, dense)
    return done
