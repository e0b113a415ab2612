"""The slot for text encoders, and vector indexes as tables with metadata: built in parallel, added to, and rebuilt where they don't fit."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.dense import exact_search
from tidewater.session import read_text, write_text, written

DIM = 256


def hash_encode(texts: list[str]) -> np.ndarray:
    """The hashing embedder as dense rows of length 1: bucket and sign of each word by its md5."""
    out = np.zeros((len(texts), DIM))
    for row, text in zip(out, texts):
        for w in text.lower().split():
            h = hashlib.md5(w.encode()).digest()
            row[int.from_bytes(h[:4], "big") % DIM] += 1.0 if h[4] % 2 == 0 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Encoder:
    """What turns a batch of texts into vectors: a local model, or a client of a remote one. Prefixes stand before texts and queries; the version names what made the vectors."""

    encode: Callable[[list[str]], np.ndarray] = hash_encode
    dim: int = DIM
    version: str = "hash-1"
    text_prefix: str = ""
    query_prefix: str = ""


def encoder_or_hash(load: Callable[[], Encoder]) -> Encoder:
    """The encoder that `load` gives, or the hashing embedder if it can't be loaded."""
    try:
        return load()
    except (ImportError, OSError):
        return Encoder()


def encoded(texts: DataFrame, key: str, e: Encoder, query: bool = False) -> DataFrame:
    """texts(key, text) to (key, vec): whole Arrow batches go to the encoder. Null texts are empty ones."""
    kind = texts.schema[key].dataType.simpleString()
    encode, dim = e.encode, e.dim

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            v = np.asarray(encode(pdf["t"].tolist()), np.float32)
            if v.shape != (len(pdf), dim):
                raise ValueError(f"the encoder gave {v.shape} for {len(pdf)} texts of {dim}")
            yield pd.DataFrame({key: pdf[key], "vec": list(v)})

    prefix = e.query_prefix if query else e.text_prefix
    return texts.select(key, F.concat(F.lit(prefix), F.coalesce("text", F.lit(""))).alias("t")).mapInPandas(run, f"{key} {kind}, vec array<float>")


def _meta(e: Encoder) -> dict:
    return {"dim": e.dim, "version": e.version, "text_prefix": e.text_prefix}


def fits(spark: SparkSession, root: str, e: Encoder) -> bool:
    """Whether the vectors under root were made by this encoder, in this dimension and with this prefix."""
    text = read_text(spark, f"{root}/metadata.json")
    return bool(text) and {k: v for k, v in json.loads(text).items() if k != "parts"} == _meta(e)


def ensure_vectors(docs: DataFrame, root: str, e: Encoder) -> int:
    """Brings the index of docs(doc_id, text) up to date: new and changed texts are encoded and added; an index that doesn't fit is built anew. The number encoded.

    Parts are never changed. Of a document the vector in the latest part holds, if it is of the text that docs has.
    """
    spark = docs.sparkSession
    parts = json.loads(read_text(spark, f"{root}/metadata.json"))["parts"] if fits(spark, root, e) else 0
    docs = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    if parts:
        have = stored_vectors(spark, root).select("doc_id", "digest")
        new = docs.join(have, ["doc_id", "digest"], "left_anti")
    else:
        new = docs
    new = written(new, "to_encode")
    n = new.count()
    if n or not parts:
        made = encoded(new.select("doc_id", "text"), "doc_id", e)
        made = made.join(new.select("doc_id", "digest"), "doc_id")
        folder = f"{root}/part-{parts}"
        made.write.mode("overwrite").parquet(folder)
        write_text(spark, f"{root}/metadata.json", json.dumps(_meta(e) | {"parts": parts + 1}))
    return n


def stored_vectors(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, vec, digest): each document's vector of the latest part that has it."""
    parts = json.loads(read_text(spark, f"{root}/metadata.json"))["parts"]
    every = None
    for i in range(parts):
        one = spark.read.parquet(f"{root}/part-{i}").withColumn("part", F.lit(i))
        every = one if every is None else every.unionByName(one)
    if parts == 1:
        return every.drop("part")
    return every.groupBy("doc_id").agg(F.max_by(F.struct("vec", "digest"), "part").alias("x")).select("doc_id", "x.*")


def vector_search(spark: SparkSession, root: str, topics: DataFrame, e: Encoder, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) by inner product over the stored vectors; an error if they aren't this encoder's."""
    if not fits(spark, root, e):
        raise ValueError(f"the vectors under {root} aren't of {e.version}")
    docs = stored_vectors(spark, root).select(F.col("doc_id").alias("id"), "vec")
    asked = written(encoded(topics, "query_id", e, query=True).select(F.col("query_id").alias("id"), "vec"), "queries")
    return exact_search(docs, asked, k, cosine=False, others=False)


def pair_scorer(score: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Column, Column], Column]:
    """A scorer for rerank() from a function of whole batches of queries and texts, such as a model of pairs."""
    return F.pandas_udf(score, "double")
