"""Same or near-same texts across splits: an edit-distance segment join over words.

A text is the sequence of its distinct words in one global order (rarest first). Between two such sequences
the insert/delete edit distance is the number of words in one text only, so a share of common words of at least t means
a distance of at most k = (1-t)/(1+t) * (words of both), and of the parity of their sum. For every length that a training text can have
to fit, an evaluation text is cut into k+1 segments: single words and pairs from the rare end, the last one taking what is left (its first three words count).
There are as many pairs as leave the last segment's first word about as rare as single words would. With at most k edits one segment stands unedited in the training text, at a position that
k allows (|shift| + |length difference - shift| <= k). Segments and the training texts' runs of one to three words meet by
words and length together, so a common word is no key of its own. Candidates are verified with banded dynamic programming.

Lengths up to EXACT words are told apart; longer ones fall into bands that grow by a tenth, with the k of the band's longest.
Equal word sets are one class before the join, so repeated texts cost one row; members are joined back at the end, by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import strip, words
from tidewater.session import written

#: Most words of a segment that its key holds.
_HEAD = 3
#: Lengths up to which every length is a band of its own, and the growth of bands beyond.
EXACT, GROWTH = 24, 1.1


def banded_distance(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Insert/delete edit distance of the rows of a and b (n x la, n x lb), k+1 where it is larger than k.

    Only cells within k of the diagonal are computed, for all n pairs at once.
    """
    n, la = a.shape
    lb = b.shape[1]
    big = k + 1
    if abs(la - lb) > k:
        return np.full(n, big)
    # by anti-diagonals i + j = d; cell i of a row stands at place i + 1
    last2 = np.full((n, la + 2), big)
    last = last2.copy()
    last[:, 1] = 0
    for d in range(1, la + lb + 1):
        i = np.arange(max(0, d - lb, -((k - d) // 2)), min(la, d, (d + k) // 2) + 1)
        cur = np.full((n, la + 2), big)
        if len(i):
            best = np.minimum(last[:, i], last[:, i + 1]) + 1
            both = i[(i > 0) & (i < d)]
            if len(both):
                at = both - i[0]
                best[:, at] = np.where(a[:, both - 1] == b[:, d - both - 1], np.minimum(best[:, at], last2[:, both]), best[:, at])
            cur[:, i + 1] = np.minimum(best, big)
        last2, last = last, cur
    return last[:, la + 1]


def _limits(threshold: float) -> tuple[int, int, int, int]:
    t = Fraction(str(threshold))
    r = (1 - t) / (1 + t)
    return t.numerator, t.denominator, r.numerator, r.denominator


def verify(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Keeps the pairs (words_e, words_t) that share at least `threshold` of their words."""
    _, _, rn, rd = _limits(threshold)
    for pdf in frames:
        la, lb = pdf["words_e"].str.len(), pdf["words_t"].str.len()
        keep = np.zeros(len(pdf), bool)
        for (x, y), at in pdf.groupby([la, lb]).indices.items():
            k = rn * (x + y) // rd
            # a block at a time, so that memory stays flat for very long texts
            step = max(1, 2_000_000 // (x + y + 2 * k + 1))
            for s in range(0, len(at), step):
                part = at[s : s + step]
                a, b = (np.stack(pdf[c].iloc[part].to_list()) for c in ("words_e", "words_t"))
                keep[part] = banded_distance(a, b, int(k)) <= k
        yield pdf.loc[keep, ["cls_e", "cls_t"]]


def word_classes(texts: DataFrame) -> DataFrame:
    """texts(text, ...) plus cls, the class of its set of distinct words; texts without words are dropped."""
    w = F.array_sort(F.array_distinct(words(F.col("text"))))
    out = texts.withColumn("_w", w).where("size(_w) > 0")
    return out.withColumn("cls", F.unhex(F.md5(F.concat_ws(" ", "_w"))))


def ordered_words(classes: DataFrame) -> DataFrame:
    """(cls, words, counts): word hashes in the global order, rarest first, and how many classes hold each. classes(cls, _w) is distinct."""
    flat = classes.select("cls", F.explode("_w").alias("word"))
    counts = flat.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    placed = flat.join(counts, "word").select("cls", F.struct("n", F.xxhash64("word").alias("h")).alias("x"))
    return placed.groupBy("cls").agg(F.array_sort(F.collect_list("x")).alias("x")).select("cls", F.col("x.h").alias("words"), F.col("x.n").alias("counts"))


def _band(l: Column) -> Column:
    return F.when(l <= EXACT, l).otherwise(EXACT + 1 + F.floor(F.log(l / EXACT) / F.log(F.lit(GROWTH)))).cast("int")


def segments(texts: DataFrame, threshold: float, rarer: int = 4) -> DataFrame:
    """texts(cls, words, counts) to (cls, le, pe, sig): the segments of evaluation texts, for each band of lengths they can be paired with.

    The last segment starts at the word `last`, whose count is at most `rarer` times that of the word at k, where it would start behind single words.
    """
    num, den, rn, rd = _limits(threshold)
    le, band, top, k, last, at = (F.col(c) for c in ("le", "band", "top", "k", "last", "at"))
    out = texts.select("cls", "words", "counts", F.size("words").alias("le"))
    out = out.withColumns({"least": F.ceil(le * num / den).cast("int"), "longest": F.floor(le * den / num).cast("int")})
    out = out.withColumn("band", F.explode(F.sequence(_band(F.col("least")), _band(F.col("longest")))))
    out = out.withColumn("top", F.when(band <= EXACT, band).otherwise(F.least("longest", F.ceil(EXACT * F.pow(F.lit(GROWTH), band - EXACT)).cast("int"))))
    out = out.withColumn("k", F.floor((le + top) * rn / rd).cast("int"))
    # edits are as many as change one length into the other, and pairs of them; a text of fewer words falls into single words
    out = out.withColumn("k", F.least(F.when((band <= EXACT) & ((k + le + top) % 2 == 1), k - 1).otherwise(k), le - 1))
    bound = F.col("counts")[k] * rarer
    out = out.withColumn("bound", bound).withColumn("last", k + F.size(F.filter(F.slice("counts", k + 2, k), lambda x: x <= F.col("bound"))))
    out = out.withColumn("at", F.explode(F.sequence(F.lit(0), k)))
    ones = 2 * k - last
    pe = F.when(at <= ones, at).otherwise(2 * at - ones)
    n = F.when(at == k, _HEAD).when(at < ones, 1).otherwise(2)
    out = out.withColumns({"pe": pe, "n": F.least(n, le - pe)})
    return out.select("cls", "le", "pe", F.xxhash64("band", F.slice("words", F.col("pe") + 1, F.col("n"))).alias("sig"))


def run_keys(words: str) -> Column:
    """array<struct<pt, sig>>: the runs of one to three words of a training text, with its band of lengths."""
    w, lt = F.col(words), F.size(words)

    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.greatest(lt - n, F.lit(0))), lambda i: F.struct(i.alias("pt"), F.xxhash64(_band(lt), F.slice(w, i + 1, n)).alias("sig")))
        return F.when(lt >= n, every).otherwise(F.array().cast("array<struct<pt:int,sig:bigint>>"))

    return F.concat(*map(runs, range(1, _HEAD + 1)))


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(cls_e, cls_t), distinct: classes of left (cls, words, counts) and right (cls, words), of different words, that share a segment where it may stand."""
    num, den, rn, rd = _limits(threshold)
    e = segments(left, threshold).withColumnRenamed("cls", "cls_e")
    t = right.select(F.col("cls").alias("cls_t"), F.size("words").alias("lt"), F.inline(run_keys("words")))
    shift = F.col("pt") - F.col("pe")
    fits = (F.abs(shift) + F.abs(F.col("lt") - F.col("le") - shift)) * rd <= rn * (F.col("lt") + F.col("le"))
    compatible = F.least("lt", "le") * den >= F.greatest("lt", "le") * num
    return e.join(t, "sig").where(fits & compatible & (F.col("cls_e") != F.col("cls_t"))).select("cls_e", "cls_t").distinct()


def segment_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(cls_e, cls_t), distinct: classes of left (cls, words, counts) and right (cls, words) that share at least `threshold` of their words."""
    found = candidate_pairs(left, right, threshold)
    pairs = found.join(left.select(F.col("cls").alias("cls_e"), F.col("words").alias("words_e")), "cls_e").join(right.select(F.col("cls").alias("cls_t"), F.col("words").alias("words_t")), "cls_t")
    near = pairs.mapInPandas(lambda frames: verify(frames, threshold), "cls_e binary, cls_t binary")
    return near.unionByName(left.select(F.col("cls").alias("cls_e")).join(right.select(F.col("cls").alias("cls_t")), F.col("cls_e") == F.col("cls_t")))


def cross_split_links(queries: DataFrame, *, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(query_id, train, cls) of the classes of equal word sets, links(cls_e, cls_t) between classes with evaluation texts and classes with training texts.

    queries has query_id, text, split; other columns are ignored. split is trimmed and its case ignored; rows with a
    null query_id, or a null or another split, are in no class, nor are null, empty and wordless texts. Repeated rows count once.
    """
    split = F.lower(strip(F.col("split")))
    rows = queries.where(F.col("query_id").isNotNull() & split.isin("train", "dev", "test")).select("query_id", (split == "train").alias("train"), "text")
    rows = written(word_classes(rows).select("query_id", "train", "cls", "_w").dropDuplicates(["query_id", "train", "cls"]), "members")
    sides = rows.groupBy("cls").agg(F.max("train").alias("t"), F.max(~F.col("train")).alias("e"), F.first("_w").alias("_w"))
    classes = written(ordered_words(sides.select("cls", "_w")).join(sides.select("cls", "t", "e"), "cls"), "classes")
    links = segment_pairs(classes.where("e").select("cls", "words", "counts"), classes.where("t").select("cls", "words"), threshold)
    return rows.select("query_id", "train", "cls"), links


def cross_split_pairs(queries: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """(query_a, query_b), query_a < query_b, distinct: texts of dev or test that stand, exactly or nearly, in train; see cross_split_links."""
    rows, pairs = cross_split_links(queries, threshold=threshold)
    e = rows.where("not train").select(F.col("cls").alias("cls_e"), F.col("query_id").alias("qe"))
    t = rows.where("train").select(F.col("cls").alias("cls_t"), F.col("query_id").alias("qt"))
    both = pairs.join(e, "cls_e").join(t, "cls_t").where("qe <> qt")
    return both.select(F.least("qe", "qt").alias("query_a"), F.greatest("qe", "qt").alias("query_b")).distinct()


def link_counts(queries: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """(query_id, train, class_id, n_links): one row per query, side and class; n_links counts classes of the other side that overlap with it, its own included if it stands there too."""
    rows, links = cross_split_links(queries, threshold=threshold)
    links = written(links, "links")
    n = links.groupBy(F.col("cls_e").alias("cls"), F.lit(False).alias("train")).agg(F.count(F.lit(1)).alias("n")).unionByName(links.groupBy(F.col("cls_t").alias("cls"), F.lit(True).alias("train")).agg(F.count(F.lit(1)).alias("n")))
    return rows.join(n, ["cls", "train"], "left").select("query_id", "train", F.hex("cls").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_links"))


def overlap_report(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(split, source, n_queries, n_overlapping): evaluation queries per split and source, and how many overlap with train. A null source stays null."""
    split = F.lower(strip(F.col("split")))
    rows = queries.where(F.col("query_id").isNotNull() & split.isin("dev", "test")).select("query_id", split.alias("split"), "source").distinct()
    hit = pairs.select(F.explode(F.array("query_a", "query_b")).alias("query_id")).distinct().withColumn("hit", F.lit(True))
    return rows.join(hit, "query_id", "left").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_queries"), F.count_if(F.coalesce("hit", F.lit(False))).alias("n_overlapping"))
