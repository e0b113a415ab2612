"""Repair of texts that were read from scanned pages.

1. A lexicon of word counts over all clean texts (titles, abstracts, unscanned full texts), folded in each task before the shuffle.
2. Scanned texts are cut into lines: page furniture, text lines, words that go on in the next text line.
3. Words that the lexicon doesn't hold look for corrections in a symmetric-delete index: a suspect and a printed word meet if they agree up to
   one deletion on either side, as they are read or as skeletons, in which confusable shapes are one. A weighted edit distance ranks
   the candidates: a confusion pair costs CONFUSED, any other edit 1. Confusions alone make a repair below REPAIR; where several candidates stay
   close, counts of neighbouring words decide. One edit beside confusions (below EDITED) makes a repair only if the corpus speaks for it: the
   printed word stands between the same two neighbours in clean texts, is far more frequent than what was read, and differs from it
   by more than an ending.
4. What no candidate explains but can't have been printed (digits and signs inside words) is put into its plain form: a fallback by pattern.
5. Furniture goes, broken words are joined, misread words replaced, lines flow into paragraphs.

Whether a text was scanned is told from several signals: sentences that go on over line ends, words broken at them, page furniture between
lines, odd characters in words. A bounded set of the most frequent words (known for certain) travels to the workers, to skip them early; everything
else is decided in joins with the whole lexicon. No step gathers more than one document's lines in one place.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.snapshots import doc_key
from tidewater.session import BROADCAST_ROWS, bounded, written

#: Most frequent words that are sent to workers to skip them early.
KNOWN_WORDS = 50_000
#: What is printed, and what is read instead.
CONFUSIONS = (("e", "c"), ("t", "f"), ("s", "5"), ("a", "ä"), ("o", "0"), ("i", "!"), ("l", "1"), ("n", "ri"), ("m", "rn"), ("d", "cl"), ("u", "ii"), ("g", "9"), ("w", "vv"), ("h", "li"), ("b", "6"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("cl", "d"), ("rn", "m"))
#: Cost of a confusion; any other edit costs 1. A repair by confusions must stay under REPAIR, one with an edit under EDITED.
CONFUSED, REPAIR, EDITED = 0.2, 1.0, 1.5
#: A repair with an edit: least length of the word, times that the printed word is more frequent, characters at the end that may be an ending.
EDIT_LENGTH, EDIT_RATIO, ENDING = 6, 20, 3
_HYPHENS = "-‐¬\xad"
_BITS = 20

_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"!*[^\W_](?:[^\W_]|!)*")
_BROKEN = re.compile(rf"(?P<p>(?:[^\W_]|!)+)(?P<h>[{_HYPHENS}])$")
_NUMBER = re.compile(r"[-–—\[( ]*(?:\d{1,4}|[ivxlcIVXLC!]{1,7})[-–—\]) ]*$")
_PAGE = re.compile(r"(?:page|seite|p\.|pp\.)\s*\d{1,4}(?:\s*(?:of|von|/)\s*\d{1,4})?$", re.I)
_TAIL = re.compile(r"(?:,\s*vol\.?\s*\d+(?:,\s*\d+)?(?:,\s*\d{4})?|\s+\d+\s*\(\d{4}\)\s*\d*|\s*\|\s*\d{1,4}|\s{2,}\d{1,4})$", re.I)
_FRONT = re.compile(r"^(?:\d{1,4}\s{2,}|\d{1,4}\s*\|\s*)")
_SMALL = {"of", "and", "the", "for", "in", "on", "to", "a", "an", "de", "la", "et", "und", "der", "y"}
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
#: What shapes are made of, down to strokes that aren't told apart.
_STROKES = str.maketrans({"m": "rri", "n": "ri", "d": "cl", "u": "ii", "w": "vv", "h": "li", "ﬁ": "fi", "ﬂ": "fl", "e": "c", "t": "f", "5": "s", "ä": "a", "0": "o", "!": "i", "1": "l", "9": "g", "6": "b"})


def skeleton(word: str) -> str:
    """The word taken apart into strokes, confusable ones made one: what is read and what is printed have the same skeleton."""
    return word.translate(_STROKES).replace("t", "f").replace("e", "c")


def deletes(s: str) -> set[str]:
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))} if len(s) > 3 else {s}


_FROM: dict[str, list[tuple[str, str]]] = {}
for _t, _r in CONFUSIONS:
    _FROM.setdefault(_t[0], []).append((_t, _r))


def confusion_distance(printed: str, read: str, limit: float = REPAIR) -> float:
    """Weighted edit distance from a printed word to what was read, or `limit` if it isn't below.

    A plain edit costs 1. For a limit of at most 1 only equal characters and confusions lead below it, so nothing else is followed.
    """
    plain = limit > 1
    best = {(0, 0): 0.0}
    todo = [(0, 0)]
    n, m = len(printed), len(read)
    end = limit
    while todo:
        i, j = todo.pop()
        x = best[i, j]
        if (i, j) == (n, m):
            end = min(end, x)
            continue
        steps = []
        if i < n and j < m and printed[i] == read[j]:
            steps.append((i + 1, j + 1, x))
        if i < n:
            for t, r in _FROM.get(printed[i], ()):
                if read.startswith(r, j) and printed.startswith(t, i):
                    steps.append((i + len(t), j + len(r), x + CONFUSED))
        if plain:
            if i < n and j < m:
                steps.append((i + 1, j + 1, x + 1))
            if i < n:
                steps.append((i + 1, j, x + 1))
            if j < m:
                steps.append((i, j + 1, x + 1))
        for p, q, c in steps:
            if c < end and c < best.get((p, q), limit):
                best[p, q] = c
                todo.append((p, q))
    return end


def lines_of(text: str) -> list[str]:
    """Lines split at line feeds; carriage returns and form feeds don't count."""
    return [x.replace("\r", "").replace("\f", "") for x in text.split("\n")]


def is_scanned(text: str | None, title: str | None = None) -> bool:
    """Whether a text was read from pages: at least two signs of it, one of them at line ends. An author's line breaks alone are none.

    Signs: sentences go on over at least a fifth of the line ends (two at least); a word is broken at a line end; there is page furniture; a word holds odd characters.
    """
    if not text or "\n" not in text:
        return False
    lines = [x.strip() for x in lines_of(text) if x.strip()]
    flows = breaks = 0
    for x, y in zip(lines, lines[1:]):
        if x[-1] in _HYPHENS and x[-2:-1].isalnum() and y[0].isalnum():
            breaks += 1
        elif y[0].islower() and x[-1] not in ".?!":
            flows += 1
    flowing = flows >= 2 and flows * 5 >= len(lines) - 1
    if not flowing and not breaks:
        return False
    if flowing and breaks:
        return True
    if any(is_furniture(x, title) for x in lines):
        return True
    return any(_strong(w.lower()) for x in lines for _, _, w in tokens_of(x))


def _letters(s: str) -> str:
    return "".join(_WORD.findall(s.lower()))


def _title_like(core: str, title: str) -> bool:
    """Whether core is the start of the title, read with some noise."""
    a, b = skeleton(_letters(core.replace("!", "i"))), skeleton(_letters(title.replace("!", "i")))
    if len(a) < 8 or not b:
        return False
    if b.startswith(a):
        return True
    head = b[: len(a)]
    if len(head) < len(a) - 2:
        return False
    wrong = sum(x != y for x, y in zip(a, head)) + abs(len(a) - len(head))
    return wrong <= len(a) // 10


def is_furniture(line: str, title: str | None) -> bool:
    """A running header, footer or page number. Text lines end sentences, or hold small words; furniture does neither."""
    s = line.strip()
    if not s:
        return False
    if len(s) > 30 and s[-1].islower() and s[0].islower():
        return False  # starts and ends within a sentence
    m = _NUMBER.match(s)
    if m:
        inner = s.strip("-–—[]() ")
        return inner.isdigit() or bool(inner) and bool(_ROMAN.match(inner.lower().replace("!", "i")))
    if _PAGE.match(s):
        return True
    core = _TAIL.sub("", _FRONT.sub("", s)).strip()
    marked = core != s
    if _title_like(core, title or ""):
        return True
    words = re.findall(r"[^\W\d_][^\s]*", core)
    if len(words) < 2 or core[-1:] in ".,;:?":
        return False
    if core.upper() == core and sum(c.isalpha() for c in core) >= 8:
        return True
    capital = [w for w in words if w[0].isupper()]
    if len(words) >= 3 and all(w[0].isupper() or w.lower() in _SMALL for w in words) and len(capital) >= 2:
        return True
    return marked and bool(re.search(r"\|\s*\d{1,4}$", s))


def analysed_lines(text: str, title: str | None) -> tuple[list[str], list[bool]]:
    lines = lines_of(text)
    marks = [is_furniture(x, title) for x in lines]
    # what repeats, digits aside, is furniture too
    forms = Counter(re.sub(r"\d+", "#", skeleton(x.strip().lower())) for x in lines if len(x.strip()) >= 8)
    for i, x in enumerate(lines):
        s = x.strip()
        if not marks[i] and len(s) >= 8 and forms[re.sub(r"\d+", "#", skeleton(s.lower()))] > 1 and s[-1] not in ".,;:?" and s[-1] not in _HYPHENS:
            marks[i] = True
    return lines, marks


def tokens_of(line: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(line)]


def analyse(text: str, title: str | None, known: set[str]) -> list[tuple]:
    """Rows (line_no, kind, a, b, line2, cut, prev, next) of a scanned text; tokens that are known for certain are left out.

    furniture; split with the joined word a and, after a plain hyphen, the compound b; token a, which a break may spread over
    line_no and line2, `cut` characters being on the first, and, after a plain hyphen, the compound b that it may be.
    """
    lines, marks = analysed_lines(text, title)
    rows: list[tuple] = [(i + 1, "furniture", None, None, None, None, None, None) for i, f in enumerate(marks) if f]
    body = [i for i, x in enumerate(lines) if not marks[i] and x.strip()]
    carried: tuple[int, str, str] | None = None  # first line, part, hyphen
    before = ""
    for n, i in enumerate(body):
        line = lines[i].rstrip()
        toks = tokens_of(line)
        b = _BROKEN.search(line)
        ahead = lines[body[n + 1]].lstrip() if n + 1 < len(body) else ""
        goes_on = b and ahead and re.match(r"[!5019]{0,3}[^\W\d_]", ahead)
        words = []
        for start, end, w in toks:
            low = w.lower()
            if carried is not None and not words:
                first, part, h = carried
                joined = part + low
                rows.append((first + 1, "split", joined, f"{part}-{low}" if h == "-" else None, i + 1, len(part), None, None))
                words.append((joined, first + 1, i + 1, len(part), part, low, h))
                carried = None
                continue
            if goes_on and start >= b.start("p"):
                if carried is None:
                    carried = (i, line[b.start("p") : b.end("p")].lower(), b.group("h"))
                continue
            words.append((low, i + 1, None, None, None, None, None))
        for k, (w, l1, l2, cut, part, rest, h) in enumerate(words):
            letters = any(c.isalpha() for c in w)
            if w not in known and (letters or ("!" in w and len(w) > 1)):
                rows.append((l1, "token", w, f"{part}-{rest}" if h == "-" else None, l2, cut, words[k - 1][0] if k else before, words[k + 1][0] if k + 1 < len(words) else ""))
        if words:
            before = words[-1][0]
    return rows


_ROWS = "version long, doc_id string, line_no long, kind string, a string, b string, line2 long, cut int, prev string, next string"


def _strong(word: str) -> str | None:
    """A word that no lexicon holds but whose odd characters can't have been printed: its plain form."""
    if len(word) < 4 or not re.search(r"(?:[a-z][5!0ä19ﬁﬂ]|^[5!0ä19ﬁﬂ](?=[a-z]{3}))(?:[a-z5!0ä19ﬁﬂ]|$)", word):
        return None
    if re.fullmatch(r"[a-z]{1,3}\d+[a-z]?", word) or sum(c.isdigit() for c in word) * 2 >= len(word):
        return None
    plain = word
    for t, r in CONFUSIONS:
        if r in "ﬁﬂä5!019":
            plain = plain.replace(r, t)
    return plain if plain.isalpha() else None


_ENDINGS = (("", ""), ("s", ""), ("es", ""), ("ies", "y"))


def index_keys(word: str) -> set[str]:
    """Deletes of the word as it is read (of EDIT_LENGTH letters at least) and of its skeleton."""
    keys = {f"~{k}" for k in deletes(skeleton(word))}
    return keys | deletes(word) if len(word) >= EDIT_LENGTH else keys


def index_rows(frames: Iterator[pd.DataFrame], lexicon: bool) -> Iterator[pd.DataFrame]:
    """(word[, n]) to (word, base, ending, extra, key) or (word, key, n): keys of the index.

    Suspects are also looked up without a plural ending; `extra` is what reading that ending cost.
    """
    for pdf in frames:
        out: list[tuple] = []
        if lexicon:
            out = [(w, k, n) for w, n in zip(pdf["word"], pdf["n"]) for k in index_keys(w)]
            yield pd.DataFrame(out, columns=["word", "key", "n"])
            continue
        for w in pdf["word"]:
            for cut, put in _ENDINGS:
                read = w[len(w) - len(cut) :]
                if cut and (len(w) < 5 or skeleton(read) != skeleton(cut)):
                    continue
                base = w[: len(w) - len(cut)] + put
                extra = CONFUSED * sum(x != y for x, y in zip(read, cut))
                out += [(w, base, cut, extra, k) for k in index_keys(base)]
        yield pd.DataFrame(out, columns=["word", "base", "ending", "extra", "key"])


def _other_ending(a: str, b: str) -> bool:
    """Whether two words differ in their last characters only, as forms of a word do."""
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return same >= min(len(a), len(b)) - ENDING


def ranked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, base, ending, extra, printed, n) to candidates under their limits: (word, fix, cost, n, bit)."""
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            cost = confusion_distance(r.printed, r.base) + r.extra
            if cost >= REPAIR:
                if r.ending or len(r.base) < EDIT_LENGTH or len(r.printed) < EDIT_LENGTH or _other_ending(r.printed, r.base):
                    continue
                cost = confusion_distance(r.printed, r.base, EDITED)
                if cost >= EDITED:
                    continue
            fix = r.printed + r.ending if r.ending != "ies" else r.printed[:-1] + "ies"
            out.append((r.word, fix, cost, r.n, zlib.crc32(r.printed.encode()) >> (32 - _BITS)))
        yield pd.DataFrame(out, columns=["word", "fix", "cost", "n", "bit"])


def valid_versions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, versions). valid(snapshot_id, doc_id, version): the row with the latest delivered_at of each document and snapshot, ties: the larger hash.
    versions(doc_id, version, title, abstract, full_text): each text of a document once, in however many snapshots it stands unchanged.
    """
    rows = docs.select("snapshot_id", doc_key(F.col("doc_id")).alias("doc_id"), "delivered_at", "title", "abstract", "full_text").where("doc_id is not null and snapshot_id is not null")
    # the three texts with their nulls: xxhash64 skips a null as if it weren't there
    version = F.xxhash64(*(F.coalesce(c, F.lit("")) for c in ("title", "abstract", "full_text")), *(F.col(c).isNull() for c in ("title", "abstract", "full_text")))
    rows = rows.withColumn("version", version)
    valid = written(rows.groupBy("snapshot_id", "doc_id").agg(F.max(F.struct("delivered_at", "version")).alias("v")).select("snapshot_id", "doc_id", "v.version"), "valid")
    one = written(valid.groupBy("doc_id", "version").agg(F.min("snapshot_id").alias("snapshot_id")), "first")
    n = one.count()
    texts = rows.drop("delivered_at").join(bounded(one, n), ["doc_id", "version", "snapshot_id"], "left_semi").drop("snapshot_id")
    if n > BROADCAST_ROWS:
        texts = written(texts, "texts")  # the join shuffles texts then: once, not in each of the passes over them
    # a row that was delivered twice stands twice: the copies meet by key, without their texts being compared
    return valid, texts


def lexicon_of(rows: DataFrame) -> DataFrame:
    """(word, n): words, and compounds with hyphens, of all clean texts."""
    compound = re.compile(r"[^\W_]+(?:-[^\W_]+)+")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for pdf in frames:
            for title, abstract, full in zip(pdf["title"], pdf["abstract"], pdf["full_text"]):
                for t in (title, abstract, None if is_scanned(full, title) else full):
                    if t:
                        t = t.lower()
                        c.update(_WORD.findall(t))
                        if "-" in t:
                            c.update(compound.findall(t))
            if len(c) > 500_000:
                yield pd.DataFrame(c.items(), columns=["word", "n"])
                c = Counter()
        yield pd.DataFrame(c.items(), columns=["word", "n"])

    return rows.select("title", "abstract", "full_text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def neighbour_counts(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """(first, second, n): pairs of neighbouring words in clean texts of which one may be a repair that context must decide on.

    bits holds hashes of those words, at most 2**20 whatever the data: a filter of fixed size, exact after the join that follows.
    """
    mask = np.zeros(1 << _BITS, bool)
    mask[[r[0] for r in bits.distinct().collect()]] = True
    packed = np.packbits(mask).tobytes()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        held: dict[str, bool] = {}

        def wanted(w: str) -> bool:
            x = held.get(w)
            if x is None:
                x = held[w] = bool(asked[zlib.crc32(w.encode()) >> (32 - _BITS)])
            return x

        for pdf in frames:
            c: Counter = Counter()
            for title, abstract, full in zip(pdf["title"], pdf["abstract"], pdf["full_text"]):
                for t in (title, abstract, None if is_scanned(full, title) else full):
                    if t:
                        w = _WORD.findall(t.lower())
                        c.update(p for p in zip(w, w[1:]) if wanted(p[0]) or wanted(p[1]))
            yield pd.DataFrame([(a, b, n) for (a, b), n in c.items()], columns=["first", "second", "n"])

    return rows.select("title", "abstract", "full_text").mapInPandas(count, "first string, second string, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))


class Repair:
    """The analysis of a corpus, as tables. Each version of a document's texts is analysed once, and joined with the snapshots that hold it at the end."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        self.valid, self.rows = valid_versions(docs)
        self.lexicon = written(lexicon_of(self.rows), "lexicon")
        top = [r[0] for r in self.lexicon.orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).select("word").collect()]
        sent = spark.sparkContext.broadcast("\n".join(top))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = set(sent.value.split("\n"))
            for pdf in frames:
                out = [(s, d, *x) for s, d, title, text in zip(pdf["version"], pdf["doc_id"], pdf["title"], pdf["full_text"]) if is_scanned(text, title) for x in analyse(text, title, known)]
                got = pd.DataFrame(out, columns=[c.split()[0] for c in _ROWS.split(", ")])
                yield got.astype({"line2": "Int64", "cut": "Int32"})

        texts = self.rows.where("full_text is not null").select("version", "doc_id", "title", "full_text")
        self.found = written(texts.mapInPandas(run, _ROWS), "found")
        self.tokens = self._tokens()
        self.splits = self._splits()
        self._fixes()

    def _splits(self) -> DataFrame:
        """Broken words; a compound that was broken at its own hyphen is none."""
        s = self.found.where("kind = 'split'").select("version", "doc_id", "line_no", "a", "b", "line2", "cut")
        plain = s.where("b is null")
        asked = s.where("b is not null").join(self.lexicon.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b", "left").join(self.lexicon.select(F.col("word").alias("a"), F.col("n").alias("na")), "a", "left")
        kept = asked.where(F.col("nb").isNull() | (F.coalesce("na", F.lit(0)) >= F.col("nb")))
        return plain.unionByName(kept.select(*plain.columns))

    def _tokens(self) -> DataFrame:
        """Words to look at: all but compounds broken at their own hyphen, whose parts the lexicon holds."""
        t = self.found.where("kind = 'token'").select("version", "doc_id", "line_no", F.col("a").alias("word"), "b", "line2", "cut", "prev", "next")
        asked = t.where("b is not null").withColumns({"part": F.substring_index("b", "-", 1), "rest": F.substring_index("b", "-", -1)})
        known = self.lexicon.select("word")
        asked = asked.join(known.select(F.col("word").alias("part"), F.lit(True).alias("p")), "part", "left").join(known.select(F.col("word").alias("rest"), F.lit(True).alias("r")), "rest", "left")
        broken = asked.where("p is null or r is null").select(*t.columns)
        return written(t.where("b is null").unionByName(broken).drop("b"), "tokens")

    def _fixes(self) -> None:
        """certain(word, fix, path) and by_context(word, prev, next, fix, path): repairs of words, chosen by cost, then by their neighbours, then by frequency."""
        tokens = self.tokens.select("word", "prev", "next")
        suspects = written(tokens.groupBy("word").agg(F.count(F.lit(1)).alias("times")).join(self.lexicon.select("word"), "word", "left_anti"), "suspects")
        left = suspects.mapInPandas(lambda f: index_rows(f, False), "word string, base string, ending string, extra double, key string")
        right = self.lexicon.where(~F.col("word").contains("-")).mapInPandas(lambda f: index_rows(f, True), "word string, key string, n long")
        met = left.join(right.select("key", F.col("word").alias("printed"), "n"), "key").select("word", "base", "ending", "extra", "printed", "n").distinct()
        near = written(met.mapInPandas(ranked, "word string, fix string, cost double, n long, bit int"), "near")
        best = near.groupBy("word").agg(F.min("cost").alias("least"))
        near = near.join(best, "word").where(F.col("cost") <= F.col("least") + 0.05)
        # a word that is a known one with an ending is none to repair, nor is a new one made of parts that recur
        near = written(near.where("least > 0").join(self._composed(near.select("word").distinct()), "word", "left_anti"), "ranked")
        edited = near.where(F.col("least") >= REPAIR).join(suspects, "word").where(F.col("n") >= EDIT_RATIO * F.col("times"))
        near = near.where(F.col("least") < REPAIR)
        several = near.groupBy("word").agg(F.countDistinct("fix").alias("k")).where("k > 1").select("word")
        single = near.join(several, "word", "left_anti").select("word", "fix", F.lit("confusion").alias("path")).distinct()
        # words that confusions explain (or an ending) aren't put into a plain form
        explained = best.where(F.col("least") < REPAIR).select("word")
        plain = suspects.join(explained, "word", "left_anti").mapInPandas(_plain, "word string, fix string").withColumn("path", F.lit("pattern"))
        self.certain = written(single.unionByName(plain), "fixes")
        asked = near.join(several, "word", "left_semi").select("word", "fix", "n", "bit", F.lit("context").alias("path"))
        asked = asked.unionByName(edited.join(plain.select("word"), "word", "left_anti").select("word", "fix", "n", "bit", F.lit("edit").alias("path")))
        unsure = written(asked.distinct(), "unsure")
        self.by_context = None
        if unsure.isEmpty():
            return
        pairs = written(neighbour_counts(self.rows, unsure.select("bit")), "pairs")
        asked = tokens.join(unsure.select("word").distinct(), "word", "left_semi").distinct().join(unsure, "word")
        seen = asked.join(pairs.select(F.col("first").alias("prev"), F.col("second").alias("fix"), F.col("n").alias("n1")), ["prev", "fix"], "left").join(pairs.select(F.col("first").alias("fix"), F.col("second").alias("next"), F.col("n").alias("n2")), ["fix", "next"], "left")
        seen = seen.where("path <> 'edit' or (n1 > 0 and n2 > 0)")
        score = F.struct(F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0)), F.col("n"), F.col("fix"))
        self.by_context = written(seen.groupBy("word", "prev", "next", "path").agg(F.max_by("fix", score).alias("fix")), "context")

    def paths(self) -> DataFrame:
        """(path, n_words, n_places): misread words and their places by what repaired them: confusion, context, edit (all through the index), pattern."""
        return self.misread().groupBy("path").agg(F.countDistinct("word").alias("n_words"), F.count(F.lit(1)).alias("n_places"))

    def _composed(self, suspects: DataFrame, head: int = 3, tail: int = 4) -> DataFrame:
        """Of suspects(word), those that fall into two parts that known words are made of.

        A part counts if known words go on after it, or come before it, with several different letters: at a seam, not in mid-part.
        """

        def cuts(w: DataFrame) -> DataFrame:
            at = F.sequence(F.lit(head), F.length("word") - tail)
            w = w.where((F.length("word") >= head + tail) & F.col("word").rlike("^[a-z]+$")).select("word", F.explode(at).alias("at"))
            return w.select("word", F.expr("substring(word, 1, at)").alias("head"), F.expr("substring(word, at + 1)").alias("tail"))

        own = cuts(self.lexicon.select("word"))
        heads = own.groupBy("head").agg(F.countDistinct(F.left("tail", F.lit(1))).alias("k")).where("k >= 4").select("head")
        tails = own.groupBy("tail").agg(F.countDistinct(F.right("head", F.lit(1))).alias("k")).where("k >= 3").select("tail")
        return cuts(suspects).join(heads, "head", "left_semi").join(tails, "tail", "left_semi").select("word").distinct()

    def misread(self) -> DataFrame:
        """(version, doc_id, line_no, word, fix, line2, cut, path) of every misread word."""
        out = self.tokens.join(self.certain, "word").drop("prev", "next")
        if self.by_context is not None:
            out = out.unionByName(self.tokens.join(self.by_context, ["word", "prev", "next"]).drop("prev", "next"))
        return out

    def lines(self) -> DataFrame:
        """(snapshot_id, doc_id, line_no, kind): one row per line and kind. A misread word that is broken counts for the line its wrong characters are on."""
        furniture = self.found.where("kind = 'furniture'").select("version", "doc_id", "line_no", "kind")
        split = self.splits.select("version", "doc_id", "line_no", F.lit("split_word").alias("kind"))
        m = self.misread()
        head_ok = F.col("line2").isNotNull() & (F.substr("fix", F.lit(1), F.col("cut")) == F.substr("word", F.lit(1), F.col("cut")))
        tail = F.length("word") - F.col("cut")
        tail_ok = F.col("line2").isNotNull() & (F.right("fix", tail) == F.right("word", tail))
        on = F.array_compact(F.array(F.when(~head_ok | F.col("line2").isNull(), F.col("line_no")), F.when(F.col("line2").isNotNull() & ~tail_ok, F.col("line2"))))
        wrong = m.select("version", "doc_id", F.explode(on).alias("line_no"), F.lit("misread").alias("kind"))
        lines = furniture.unionByName(split).unionByName(wrong).distinct()
        return lines.join(self.valid, ["version", "doc_id"]).select("snapshot_id", "doc_id", "line_no", "kind")

    def texts(self) -> DataFrame:
        """(snapshot_id, doc_id, text): every valid full text; those from scanned pages in repaired paragraphs, the others as they are."""
        split = self.splits.select("version", "doc_id", F.struct(F.lit("s").alias("k"), "line_no", F.col("a").alias("w"), F.lit(None).cast("string").alias("fix")).alias("x"))
        fix = self.misread().select("version", "doc_id", F.struct(F.lit("m").alias("k"), "line_no", F.col("word").alias("w"), "fix").alias("x"))
        per = split.unionByName(fix).groupBy("version", "doc_id").agg(F.collect_list("x").alias("acts"))
        texts = self.rows.where("full_text is not null").select("version", "doc_id", "title", "full_text").dropDuplicates(["version", "doc_id"])
        done = texts.join(per, ["version", "doc_id"], "left").mapInPandas(_repaired, "version long, doc_id string, text string")
        return done.join(self.valid, ["version", "doc_id"]).select("snapshot_id", "doc_id", "text")


def _plain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pd.DataFrame([(w, p) for w in pdf["word"] if (p := _strong(w))], columns=["word", "fix"])


def _cased(fix: str, as_read: str) -> str:
    if as_read.isupper() and len(as_read) > 1:
        return fix.upper()
    return fix[:1].upper() + fix[1:] if as_read[:1].isupper() else fix


def repaired(text: str, title: str | None, splits: set[int], fixes: dict[str, str]) -> str:
    """One scanned text in paragraphs. splits: numbers of lines whose last word goes on; fixes: by word as read, in lower case."""
    lines, marks = analysed_lines(text, title)
    indented = any(re.match(r"[ \t]{2,}\S", x) for i, x in enumerate(lines) if not marks[i])
    paragraphs: list[list[str]] = [[]]
    glue, blank, furniture = False, False, False
    for i, line in enumerate(lines):
        if marks[i]:
            furniture = True
            continue
        if not line.strip():
            blank = True
            continue
        ended = not paragraphs[-1] or paragraphs[-1][-1].rstrip()[-1:] in ".?!)]"
        starts = re.match(r"[ \t]{2,}\S", line) if indented else blank and (not furniture or ended)
        if starts and not glue and paragraphs[-1]:
            paragraphs.append([])
        s = line.strip()
        goes_on = i + 1 in splits
        if goes_on:
            s = s[:-1]
        if glue and paragraphs[-1]:
            paragraphs[-1][-1] += s
        elif paragraphs[-1] and paragraphs[-1][-1].endswith("-") and paragraphs[-1][-1][-2:-1].isalnum():
            paragraphs[-1][-1] += s  # a compound broken at its own hyphen
        else:
            paragraphs[-1].append(s)
        glue, blank, furniture = goes_on, False, False
    fix = lambda m: _cased(fixes[m.group().lower()], m.group()) if m.group().lower() in fixes else m.group()
    return "\n\n".join(_TOKEN.sub(fix, re.sub(r"[ \t]+", " ", " ".join(p))) for p in paragraphs if p)


def _repaired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for s, d, title, text, acts in zip(pdf["version"], pdf["doc_id"], pdf["title"], pdf["full_text"], pdf["acts"]):
            if is_scanned(text, title):
                acts = list(acts) if acts is not None else []
                text = repaired(text, title, {a["line_no"] for a in acts if a["k"] == "s"}, {a["w"]: a["fix"] for a in acts if a["k"] == "m"})
            out.append((s, d, text))
        yield pd.DataFrame(out, columns=["version", "doc_id", "text"])
