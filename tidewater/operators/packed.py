"""Exact ranking of weighted terms over packed postings.

Documents are packed in chunks (postings as arrays, sorted by term), queries in blocks. Each task takes a block of queries through the chunks
and keeps the best k of every query, so that no pair of query and document is ever a row that is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import written

#: Documents of a chunk (positions are of 16 bits), and tokens at which it is closed before.
CHUNK, CHUNK_TOKENS = 16_384, 3_000_000
#: Bytes of postings that one task takes its queries through; more are split between tasks, and the best of all are ranked at the end.
GROUP_BYTES = 64_000_000
#: Rows of query weights that travel at once; more queries are worked off in turns.
WEIGHT_ROWS = 1_000_000
#: Queries of a block at most.
BLOCK = 1_500


def rounded(x: np.ndarray) -> np.ndarray:
    """x times 10^8 as whole numbers, halves away from zero: what ranks compare."""
    return np.copysign(np.floor(np.abs(x) * 1e8 + 0.5), x)


def first_k(keys: np.ndarray, k: int) -> np.ndarray:
    """Places, ascending, of the k greatest keys; of equal ones the first."""
    if len(keys) <= k:
        return np.arange(len(keys))
    cut = np.partition(keys, len(keys) - k)[len(keys) - k]
    over = keys > cut
    over[np.flatnonzero(keys == cut)[: k - int(over.sum())]] = True
    return np.flatnonzero(over)


class Best:
    """The best k documents of each query so far. Documents come in chunks that are sorted by id; of equal keys the least ids stay."""

    def __init__(self, n: int, k: int):
        self.k, self.docs, self.n_docs = k, [], 0
        self.ids, self.scores = [np.empty(0, np.int64)] * n, [np.empty(0)] * n
        self.cut = np.full(n, -np.inf)  # the key that a row must have at least

    def chunk(self, docs: pa.Array) -> None:
        self.docs.append(docs)
        self.n_docs += len(docs)

    def add(self, q: int, places: np.ndarray, scores: np.ndarray) -> None:
        """Rows of the latest chunk, places ascending."""
        kept = first_k(rounded(scores), self.k)
        if not len(kept):
            return
        ids = np.concatenate([self.ids[q], places[kept] + (self.n_docs - len(self.docs[-1]))])
        scores = np.concatenate([self.scores[q], scores[kept]])
        if len(ids) >= self.k:
            keys = rounded(scores)
            self.cut[q] = cut = np.partition(keys, len(keys) - self.k)[len(keys) - self.k]
            on = keys >= cut
            ids, scores, keys = ids[on], scores[on], keys[on]
            if len(ids) > 3 * self.k:  # many ties
                self.docs = [pa.concat_arrays(self.docs[:-1]), self.docs[-1]] if len(self.docs) > 2 else self.docs
                by_id = pc.sort_indices(pa.chunked_array(self.docs).take(pa.array(ids))).to_numpy()
                ids, scores, keys = ids[by_id], scores[by_id], keys[by_id]
                best = first_k(keys, self.k)
                ids, scores = ids[best], scores[best]
        self.ids[q], self.scores[q] = ids, scores

    def batches(self, names: pa.Array, schema: pa.Schema, at_once: int = 200) -> Iterator[pa.RecordBatch]:
        """(query_id, doc_id, score, rank)."""
        if not self.docs:
            return
        docs = pa.concat_arrays(self.docs)
        place = np.empty(len(docs), np.int64)
        place[pc.sort_indices(docs).to_numpy()] = np.arange(len(docs))
        for a in range(0, len(self.ids), at_once):
            ids, scores, n = [], [], []
            for i, s in zip(self.ids[a : a + at_once], self.scores[a : a + at_once]):
                order = np.lexsort((place[i], -rounded(s)))[: self.k]
                ids.append(i[order])
                scores.append(s[order])
                n.append(len(order))
            which = np.repeat(np.arange(a, a + len(n)), n)
            rank = np.concatenate([np.arange(1, x + 1, dtype=np.int32) for x in n])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(which)), docs.take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(scores)), pa.array(rank)], schema=schema)


PACKED = "lengths binary, terms array<int>, counts array<int>, places binary, tfs binary"


def packed(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """tokens(doc_id, tokens, length[, tfs]) to chunks (docs, lengths, terms, counts, places, tfs) of the postings of these terms. Without tfs each token counts as 1."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    sent = tokens.sparkSession.sparkContext.broadcast(terms)
    cols = ["doc_id", "tokens", "length", *(["tfs"] if "tfs" in tokens.columns else [])]

    def close(parts: list[tuple]) -> pa.RecordBatch:
        docs = pa.concat_arrays([p[0] for p in parts])
        by_id = pc.sort_indices(docs).to_numpy()
        place = np.empty(len(docs), np.int64)
        place[by_id] = np.arange(len(docs))
        starts = np.cumsum([0, *(len(p[0]) for p in parts)])
        keys = np.concatenate([p[2].astype(np.int64) * CHUNK + place[p[3] + a] for p, a in zip(parts, starts)])
        if parts[0][4] is None:
            keys, tf = np.unique(keys, return_counts=True)
        else:
            keys, at = np.unique(keys, return_inverse=True)
            tf = np.bincount(at, weights=np.concatenate([p[4] for p in parts]), minlength=len(keys))
        found, counts = np.unique(keys // CHUNK, return_counts=True)
        lengths = np.concatenate([p[1] for p in parts])[by_id]
        one = lambda x, t: pa.array([x], pa.list_(t))
        raw = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs.take(pa.array(by_id))), raw(lengths, np.int64), one(found.astype(np.int32), pa.int32()), one(counts.astype(np.int32), pa.int32()), raw(keys % CHUNK, np.uint16), raw(tf, np.int32)],
            names=["docs", "lengths", "terms", "counts", "places", "tfs"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        parts: list[tuple] = []
        n = size = 0
        for whole in batches:
            step = min(CHUNK, 1024)
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                if n + b.num_rows > CHUNK or size > CHUNK_TOKENS:
                    yield close(parts)
                    parts, n, size = [], 0, 0
                words = b.column(1)
                id_ = pc.index_in(words.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(b.num_rows), pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))
                on = id_ >= 0
                tf = b.column(3).flatten().to_numpy(zero_copy_only=False)[on] if len(cols) > 3 else None
                parts.append((b.column(0), b.column(2).to_numpy(zero_copy_only=False), id_[on].astype(np.int32), of[on].astype(np.int32), tf))
                n, size = n + b.num_rows, size + int(on.sum())
        if parts:
            yield close(parts)

    return tokens.select(*cols).mapInArrow(pack, f"docs array<{kind}>, {PACKED}")


def search(tokens: DataFrame, stats: DataFrame, weighted: DataFrame, k: int, k1: float, b: float, idf: str = "plus", df: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(query_id, doc_id, score > 0, rank) of weights (query_id, term, weight) over tokens(doc_id, tokens, length[, tfs]), and whether these ranks are of all documents: else they are of each part of them.

    stats (one row) has n_docs and mean_length; df(term, df) is counted if it isn't given.
    """
    spark = tokens.sparkSession
    kinds = [f.dataType.simpleString() for f in (weighted.schema["query_id"], tokens.schema["doc_id"])]
    schema = f"query_id {kinds[0]}, doc_id {kinds[1]}, score double, rank int"
    rows = weighted.select("query_id", "term", F.col("weight").cast("double")).where("query_id is not null").orderBy("query_id", "term").toArrow().combine_chunks()
    one = stats.select("n_docs", "mean_length").first()
    if not rows.num_rows or not one.n_docs:
        return spark.createDataFrame([], schema), True
    col = lambda i: pa.concat_arrays(rows.column(i).chunks)
    words, names = col(1).dictionary_encode(), col(0).dictionary_encode()  # names in order
    chunks = written(packed(tokens, words.dictionary.to_pylist()), "packed")
    if df is None:
        df = chunks.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
        found = df.toPandas()
        of, seen = found["terms"].to_numpy(), found["df"].to_numpy(float)
    else:
        found = df.select("term", "df").toArrow().combine_chunks()
        of = pc.index_in(found.column(0), value_set=words.dictionary)
        of, seen = pc.fill_null(of, -1).to_numpy(), found.column(1).to_numpy().astype(float)
    x = (one.n_docs - seen + 0.5) / (seen + 0.5)
    weight_of = np.zeros(len(words.dictionary))
    weight_of[of[of >= 0]] = (np.log1p(x) if idf == "plus" else np.log(x))[of >= 0]
    n = len(names.dictionary)
    starts = np.concatenate([[0], np.cumsum(np.bincount(names.indices.to_numpy(), minlength=n))])
    blocks = min(n, max(2 * spark.sparkContext.defaultParallelism, -(-n // BLOCK)))
    sent = spark.sparkContext.broadcast((names.dictionary, starts, words.indices.to_numpy(), col(2).to_numpy(), weight_of))
    mean = one.mean_length or 1.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts, of, ws, weight_of = sent.value
        best = None
        for batch in batches:
            for r in range(batch.num_rows):
                block, docs, lengths, terms, counts, places, tfs = (c[r] for c in batch.columns)
                if best is None:
                    low, high = n * block.as_py() // blocks, n * (block.as_py() + 1) // blocks
                    best = Best(high - low, k)
                docs, terms, counts = docs.values, terms.values.to_numpy(), counts.values.to_numpy()
                place, tf = (np.frombuffer(v.as_buffer(), t) for v, t in ((places, np.uint16), (tfs, np.int32)))
                norm = k1 * (1 - b + b * np.frombuffer(lengths.as_buffer(), np.int64) / mean)
                impact = np.repeat(weight_of[terms], counts) * (tf * (k1 + 1) / (tf + norm[place]))
                place, size = place.astype(np.int64), len(docs)
                ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
                slot = np.full(len(weight_of), -1, np.int64)
                slot[terms] = np.arange(len(terms))
                # terms of many documents as whole rows
                wide = {}
                for i in np.flatnonzero(counts > size // 4).tolist():
                    wide[i] = np.zeros(size)
                    wide[i][place[ends[i] : ends[i + 1]]] = impact[ends[i] : ends[i + 1]]
                best.chunk(docs)
                total, part = np.empty(size), np.empty(size)
                for q in range(low, high):
                    a, e = starts[q], starts[q + 1]
                    total.fill(0)
                    for i, w in zip(slot[of[a:e]].tolist(), ws[a:e].tolist()):
                        if i in wide:
                            np.multiply(wide[i], w, out=part)
                            np.add(total, part, out=total)
                        elif i >= 0:
                            total[place[ends[i] : ends[i + 1]]] += w * impact[ends[i] : ends[i + 1]]
                    cut = best.cut[q - low]
                    on = np.flatnonzero(total >= (cut - 1) / 1e8) if cut > 1 else np.flatnonzero(total > 0)
                    if len(on):
                        on = on[rounded(total[on]) >= cut]
                        best.add(q - low, on, total[on])
        if best is not None:
            arrow = pa.schema([("query_id", names.type), ("doc_id", best.docs[0].type), ("score", pa.float64()), ("rank", pa.int32())])
            yield from best.batches(names.slice(low, high - low), arrow)

    size = chunks.agg(F.sum(F.length("places") + F.length("tfs"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    grid = spark.range(0, blocks, 1, blocks).select(F.col("id").cast("int").alias("block")).hint("shuffle_replicate_nl").crossJoin(chunks.coalesce(groups))  # of blocks and chunks, not rows
    return grid.mapInArrow(score, schema), groups == 1
