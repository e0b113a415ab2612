"""Encoding with a public byte-pair tokenizer as a bounded-lookahead streaming transducer.

The vocabulary file (base64 token, rank) is read where the driver runs and broadcast: it is of fixed size (under 1 MB).

A token sequence is what byte-pair merging makes of its bytes exactly if every two neighbours are: merging the bytes of both
gives both back. So the encoding of each prefix ends in one token that is known from the encoding of a shorter prefix, and a
machine that reads byte by byte only keeps, per position, the length of that last token. A token that starts behind the current
byte ends at most `lookahead` bytes (the longest token) later, so whatever comes, the final encoding goes through one of the
last `lookahead` positions. As soon as the paths from all of these meet, the tokens up to there are stable: they are emitted and forgotten.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: The public pattern that cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Merges:
    """The tables of one merge list."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.lookahead = max(map(len, self.ranks))
        #: The longest token that ends in a byte: no longer one needs to be looked up there.
        self.reach = [0] * 256
        for t in self.ranks:
            self.reach[t[-1]] = max(self.reach[t[-1]], len(t))
        self.joins: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging of a few bytes: the lowest rank first, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def holds(self, left: bytes, right: bytes) -> bool:
        """Whether `left` and `right` can stand next to each other."""
        key = (left, right)
        known = self.joins.get(key)
        if known is None:
            if len(self.joins) > 500_000:
                self.joins.clear()
            known = self.joins[key] = self.merged(left + right) == [left, right]
        return known


class Transducer:
    """Reads bytes, returns ids as soon as they are stable. Between calls it holds the bytes behind the last stable token."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.reset()

    def reset(self) -> None:
        self.data = bytearray()
        self.last = [0]  # length of the last token of each prefix of data
        self.before = b""  # the stable token in front of data

    def feed(self, chunk: bytes) -> list[int]:
        m, out = self.m, []
        ranks, holds = m.ranks, m.holds
        for byte in chunk:
            self.data.append(byte)
            end = len(self.data)
            for n in range(min(m.reach[byte], end), 0, -1):
                start = end - n
                token = bytes(self.data[start:end])
                if token not in ranks:
                    continue
                if start:
                    k = self.last[start]
                    if k == 0 or not holds(bytes(self.data[start - k : start]), token):
                        continue
                elif self.before and not holds(self.before, token):
                    continue
                self.last.append(n)
                break
            else:
                self.last.append(0)  # no encoding of this prefix ends here given what is stable
            if end % m.lookahead == 0 and end >= 2 * m.lookahead:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        """Emits up to where the paths from all positions that a later token can start at have met."""
        end = len(self.data)
        at = {p for p in range(end - self.m.lookahead + 1, end + 1) if self.last[p]}
        while len(at) > 1:
            p = max(at)
            at.remove(p)
            at.add(p - self.last[p])
        meet = at.pop()
        return self._emit(meet) if meet else []

    def _emit(self, to: int) -> list[int]:
        out, p = [], to
        while p:
            n = self.last[p]
            out.append(bytes(self.data[p - n : p]))
            p -= n
        out.reverse()
        if out:
            self.before = out[-1]
            del self.data[:to]
            self.last = [0, *self.last[to + 1 :]]
        return [self.m.ranks[t] for t in out]

    def finish(self) -> list[int]:
        out = self._emit(len(self.data))
        self.reset()
        return out


class Encoder:
    """Text to ids. Words seen before come from a bounded memory; everything else goes through the transducer."""

    def __init__(self, merges: Merges, remember: int = 300_000):
        self.t = Transducer(merges)
        self.find = regex.compile(PATTERN).finditer
        self.known: dict[str, tuple[int, ...]] = {}
        self.remember = remember

    def stream(self, text: str) -> Iterator[Iterable[int]]:
        known = self.known
        for m in self.find(text):
            word = m.group()
            ids = known.get(word)
            if ids is not None:
                yield ids
            elif len(word) <= 64:
                if len(known) >= self.remember:
                    known.clear()
                known[word] = ids = tuple(self.t.feed(word.encode()) + self.t.finish())
                yield ids
            else:
                for at in range(0, len(word), 256):
                    yield self.t.feed(word[at : at + 256].encode())
                yield self.t.finish()

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.stream(text) for i in ids] if text else []

    def count(self, text: str | None) -> int:
        return sum(len(ids) for ids in self.stream(text)) if text else 0


class Decoder:
    """Ids to text, one id at a time: bytes of an unfinished character wait until it is complete; broken ones become U+FFFD."""

    def __init__(self, merges: Merges):
        self.tokens = merges.tokens
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, token_id: int) -> str:
        return self.state.decode(self.tokens[token_id])

    def finish(self) -> str:
        rest = self.state.decode(b"", True)
        self.state.reset()
        return rest

    def decode(self, ids: Iterable[int]) -> str:
        return "".join([self.feed(int(i)) for i in ids]) + self.finish()


def _shipped(spark: SparkSession, path: str | None):
    with open(path or default_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): every row of docs(doc_id, text). Empty and null texts give an empty list; texts that look like special tokens are ordinary text."""
    file = _shipped(docs.sparkSession, path)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges(file.value))
        for b in frames:
            ids = [encoder.encode(t) for t in b.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, ids array<int>")


def token_count(spark: SparkSession, path: str | None = None):
    """Column function: number of ids of a text; 0 for null."""
    file = _shipped(spark, path)

    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(Merges(file.value))
        for t in texts:
            yield pd.Series([encoder.count(x) for x in t], dtype="int64")

    counts.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(counts, "long")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); an empty or null list gives ''."""
    file = _shipped(encoded.sparkSession, path)

    def texts(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(Merges(file.value))
        for s in ids:
            yield pd.Series([decoder.decode(x) if x is not None else "" for x in s], dtype=object)

    texts.__annotations__ = {"ids": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return encoded.select("doc_id", pandas_udf(texts, "string")(F.col("ids")).alias("text"))
