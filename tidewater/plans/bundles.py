"""Datasets by snapshot: what a backend loads, under one shape."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.text import as_text, first_non_empty
from tidewater.session import exists
from tidewater.sources import readers


@dataclass(frozen=True)
class Bundle:
    """docs(doc_id, title, abstract, full_text, metadata, ...), topics(query_id, text), qrels(query_id, doc_id, relevance) or None; evidence is what an overlay reads, made of docs if None."""

    docs: DataFrame
    topics: DataFrame
    qrels: DataFrame | None = None
    evidence: DataFrame | None = None
    name: str = ""
    snapshot_id: str = ""
    timestamp: str | None = None


@dataclass(frozen=True)
class Dataset:
    """Where a dataset lies. Paths may hold {snapshot}. Field maps name the columns of doc_id, title, abstract, full_text, and of query_id, query_text."""

    backend: str = "local_files"
    root: str = ""
    corpus_path: str = ""
    queries_path: str = ""
    qrels_path: str = ""
    corpus_format: str | None = None
    queries_format: str | None = None
    qrels_format: str | None = None
    corpus_fields: dict[str, str] = field(default_factory=dict)
    query_fields: dict[str, str] = field(default_factory=dict)
    load_full_text: bool = True
    folders: dict[str, tuple[str, ...]] = field(default_factory=dict)


Loader = Callable[[SparkSession, Dataset, str], Bundle]
LOADERS: dict[str, Loader] = {}


def loader(name: str) -> Callable[[Loader], Loader]:
    return lambda f: LOADERS.setdefault(name, f)


def load(spark: SparkSession, dataset: Dataset, snapshot_id: str) -> Bundle:
    """The bundle of one snapshot, by the dataset's backend; an unknown one is an error."""
    if dataset.backend not in LOADERS:
        raise ValueError(f"unknown backend: {dataset.backend}; known are {', '.join(sorted(LOADERS))}")
    return LOADERS[dataset.backend](spark, dataset, snapshot_id)


def normalize_topics(df: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """(query_id, text) under mapped names; a record without either is an error."""
    fields = fields or {}

    def named(target: str, *others: str):
        have = [c for c in (fields.get(target, target), target, *others) if c in df.columns]
        return first_non_empty(*(as_text(F.col(c)) for c in have)) if have else F.lit(None).cast("string")

    q, t = named("query_id"), named("query_text", "text")
    whole = q.isNotNull() & t.isNotNull()
    must = lambda c: F.when(whole, c).otherwise(F.raise_error(F.lit("a query has no query_id or no query_text")))
    return df.select(must(q).alias("query_id"), must(t).alias("text"))


def normalize_qrels(df: DataFrame) -> DataFrame:
    return df.select(as_text(F.col("query_id")).alias("query_id"), as_text(F.col("doc_id")).alias("doc_id"), F.coalesce(F.col("relevance").cast("int"), F.lit(0)).alias("relevance"))


def snapshot_folders(spark: SparkSession, root: str, snapshot_id: str, folders: dict[str, tuple[str, ...]]) -> list[str]:
    """The folder named like the snapshot without hyphens, if there is one; else those of its known names that exist."""
    plain = f"{root}/{snapshot_id.replace('-', '')}"
    if exists(spark, plain):
        return [plain]
    return [f"{root}/{n}" for n in folders.get(snapshot_id, ()) if exists(spark, f"{root}/{n}")]


def _qrels(spark: SparkSession, dataset: Dataset, snapshot_id: str) -> DataFrame | None:
    path = dataset.qrels_path.format(snapshot=snapshot_id)
    return normalize_qrels(readers.read_records(spark, path, dataset.qrels_format)) if path and exists(spark, path) else None


@loader("local_files")
def _local(spark: SparkSession, dataset: Dataset, snapshot_id: str) -> Bundle:
    if not dataset.corpus_path or not dataset.queries_path:
        raise ValueError("local files need corpus_path and queries_path")
    at = lambda p: p.format(snapshot=snapshot_id)
    docs = readers.normalize_corpus(readers.read_records(spark, at(dataset.corpus_path), dataset.corpus_format), dataset.corpus_fields, dataset.load_full_text)
    topics = normalize_topics(readers.read_records(spark, at(dataset.queries_path), dataset.queries_format), dataset.query_fields)
    return Bundle(docs, topics, _qrels(spark, dataset, snapshot_id), name=dataset.root or "local", snapshot_id=snapshot_id)


@loader("snapshot_folders")
def _folders(spark: SparkSession, dataset: Dataset, snapshot_id: str) -> Bundle:
    """Folders of JSON lines per snapshot: abstracts and full texts are merged by document; a record without an id is skipped."""
    found = snapshot_folders(spark, dataset.root, snapshot_id, dataset.folders)
    if not found:
        raise ValueError(f"{dataset.root} has no folder of {snapshot_id}")
    every = None
    for i, path in enumerate(found):
        kind = "fulltext" if "fulltext" in path.lower() else "abstract"
        raw = spark.read.option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl*").json(path)
        part = readers.normalize_corpus(raw, dataset.corpus_fields, dataset.load_full_text, missing="skip")
        part = part.select("doc_id", "title", "abstract", "full_text", "metadata", F.lit(kind).alias("kind"), F.struct(F.lit(i).alias("i"), F.monotonically_increasing_id().alias("n")).alias("ord"))
        every = part if every is None else every.unionByName(part)
    at = dataset.queries_path.format(snapshot=snapshot_id)
    topics = readers.read_topics_tsv(spark, at) if at.endswith(".tsv") else normalize_topics(readers.read_records(spark, at, dataset.queries_format), dataset.query_fields)
    return Bundle(readers.merge_corpus(every), topics, _qrels(spark, dataset, snapshot_id), name=dataset.root, snapshot_id=snapshot_id)


def tables(backend: dict[str, Any]) -> Loader:
    """A loader of tables that stand ready: {snapshot_id: Bundle}."""
    return lambda spark, dataset, snapshot_id: backend[snapshot_id]
