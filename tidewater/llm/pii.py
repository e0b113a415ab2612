"""Personal information in free text: offset-preserving deobfuscation, detection, and masking.

A first transducer rewrites a text and remembers, for every character it writes, where in the source it came from:
invisible characters vanish, full-width and look-alike letters become plain ones, spelled-out digits become digits, and
`at`/`dot` disguises become `@` and `.`. Identifiers are found in the rewritten text by machines over fixed grammars;
each span is mapped back to source characters, so offsets hold in the original and everything outside stays as it was.

Names need a lexicon of given and family names, and what the corpus says about words: a family name that is mostly written in lower
case is a common word, which only counts beside a listed given name; a word that mostly stands before family names, wherever
it is capitalised, is a given name that the lexicon lacks. Parts that the lexicon's family names are composed of, as far as they recur, add
family names that it lacks. A name is a given name or initials with a family name, in either order.

What is known about words travels to the workers if it has at most LEXICON_ROWS rows. Beyond that, texts are worked off in blocks, and each
block is joined with what is known about its own words: the same result, at the price of shuffling the texts once.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import written

#: Most rows of what is known about words that travel to every worker, and most family names whose parts are learned (those with the least hashes).
LEXICON_ROWS = 100_000
#: Texts of a block, where more than that is known.
BLOCK_TEXTS = 2000
#: Share of a word's capitalised places that stand before a family name, from which on it is a given name.
GIVEN_SHARE = 0.5
KINDS = ("email", "phone", "id_number", "address", "name")

# --- deobfuscation ---------------------------------------------------------------------------------------------------

# Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKE = dict(zip("аеорсухіјѕԁһкмнтвԛԝѵгАЕОРСУХІЈЅКМНТВԌԚԜѴΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινρυκα", "aeopcyxijsdhkmhtbqwvrAEOPCYXIJSKMHTBGQWVABEZHIKMNOPTYXoivpuka"))
_INVISIBLE = set("​‌‍⁠﻿­‪‫‬‭‮‎‏")
_SPACES = set("       　")
# Digit words.
_DIGITS = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(words.split())
} | {"oh": "0"}
_DIGIT_WORD = "|".join(sorted(_DIGITS, key=len, reverse=True))
_TIMES = {"double": 2, "doppel": 2, "doble": 2, "triple": 3, "treble": 3}
_ONE = rf"(?:(?:{'|'.join(_TIMES)})[ \-]+)?(?:{_DIGIT_WORD})"
_SPELLED = re.compile(rf"(?<!\w){_ONE}(?:[ \-]+{_ONE}){{3,}}(?!\w)", re.I)
_ONE_DIGIT = re.compile(rf"(?:(?P<times>{'|'.join(_TIMES)})[ \-]+)?(?P<digit>{_DIGIT_WORD})", re.I)
_AT_WORD = r"(?:at|ät|arroba|arobase|chez)"
_DOT_WORD = r"(?:dot|punkt|point|punto)"
_BRACKETED = re.compile(rf"\s*(?:[\[({{<]\s*(?:(?P<at>{_AT_WORD}|@)|(?P<dot>{_DOT_WORD}|\.))\s*[\])}}>])\s*", re.I)
_BARE = re.compile(rf"(?<![\w.+-])[\w.+-]{{1,64}}(?:(?P<inner>\s+{_DOT_WORD}\s+)[\w.+-]{{1,64}}){{0,4}}(?P<at>\s+{_AT_WORD}\s+)[\w-]{{1,63}}(?:(?P<dot>\s+{_DOT_WORD}\s+)[\w-]{{1,63}})+(?!\w)", re.I)
_ODD = re.compile("[^\x00-\x7f]")


class Mapped:
    """A rewritten text; its i-th character stands for source[at[i]:to[i]]. Both are None while nothing was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.at: list[int] | None = None
        self.to: list[int] | None = None

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source span of text[a:b]."""
        return (a, b) if self.at is None else (self.at[a], self.to[b - 1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits (start, end, new) in order; each new character stands for all that it replaces."""
        if not edits:
            return
        n = len(self.text)
        old_at = self.at if self.at is not None else range(n)
        old_to = self.to if self.to is not None else range(1, n + 1)
        out, at, to, p = [], [], [], 0
        for start, end, new in edits:
            out += [self.text[p:start], new]
            at.extend(old_at[p:start])
            to.extend(old_to[p:start])
            at.extend([old_at[start]] * len(new))
            to.extend([old_to[end - 1]] * len(new))
            p = end
        out.append(self.text[p:])
        at.extend(old_at[p:])
        to.extend(old_to[p:])
        self.text, self.at, self.to = "".join(out), at, to


def _char(c: str) -> str | None:
    if c in _INVISIBLE:
        return ""
    if c in _SPACES:
        return " "
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    o = ord(c)
    if 0xFF01 <= o <= 0xFF5E or 0x1D400 <= o <= 0x1D7FF:
        return unicodedata.normalize("NFKC", c)
    return None


def deobfuscate(text: str) -> Mapped:
    m = Mapped(text)
    if not text.isascii():
        m.rewrite([(x.start(), x.end(), new) for x in _ODD.finditer(text) if (new := _char(x.group())) is not None])
        # a combining mark joins the letter before it, as readers see it
        if any(unicodedata.combining(c) for c in m.text):
            edits = []
            for x in re.finditer(r"\p{L}\p{M}+", m.text):
                new = unicodedata.normalize("NFC", x.group())
                if len(new) == 1:
                    edits.append((x.start(), x.end(), new))
            m.rewrite(edits)
    low = m.text.lower()
    if _SPELLED.search(m.text):
        m.rewrite([(x.start(), x.end(), "".join(_DIGITS[w.group("digit").lower()] * _TIMES.get((w.group("times") or "").lower(), 1) for w in _ONE_DIGIT.finditer(x.group()))) for x in _SPELLED.finditer(m.text)])
    if "[" in low or "(" in low or "{" in low or "<" in low:
        edits = []
        for x in _BRACKETED.finditer(m.text):
            if x.start() and x.end() < len(m.text) and re.match(r"[\w]", m.text[x.end()]) and re.match(r"[\w+]", m.text[x.start() - 1]):
                edits.append((x.start(), x.end(), "@" if x.group("at") else "."))
        m.rewrite(edits)
    if re.search(rf"\s{_DOT_WORD}\s", m.text, re.I):
        edits = []
        for x in _BARE.finditer(m.text):
            edits += [(a, b, ".") for a, b in x.spans("inner")]
            edits.append((*x.span("at"), "@"))
            edits += [(a, b, ".") for a, b in x.spans("dot")]
        m.rewrite(edits)
    return m


# --- machines --------------------------------------------------------------------------------------------------------

_EMAIL = re.compile(r"(?<![\w.+-])[\p{L}\p{N}_][\p{L}\p{N}_.+%'-]{0,63}@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?\.)+\p{L}{2,24}(?![\p{L}\p{N}@])")

_SEP = r"[ .\-–]"
_PHONE = re.compile(
    r"(?<![\w+/.-])(?:"
    rf"(?:\+|00)\d{{1,3}}(?:[ .\-]?\(0\))?(?:{_SEP}?\(\d{{1,4}}\))?(?:{_SEP}?\d{{1,5}}){{2,6}}"  # international
    rf"|\(\d{{2,5}}\){_SEP}?\d{{3,4}}{_SEP}?\d{{3,5}}"  # area in brackets
    rf"|\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{4}}"  # ten digits in three parts
    rf"|0\d{{2,4}}[ /\-]\d{{3,5}}(?:[ \-]\d{{2,4}})?"  # national, with trunk prefix
    r")(?:\s?(?:ext\.?|x|Durchwahl|poste)\s?\d{1,5})?(?![\w/-]|\.\d)",
    re.I,
)

#: A number in groups behind a label of telephones.
_LABELLED = re.compile(r"(?<!\w)(?:tel|telephone|phone|fax|mobile|cell|tél|téléphone|télécopie|telefon|handy|mobil|teléfono|móvil)\b[.:]*\s*(?P<phone>\(?\d{2,5}\)?(?:[ .\-–/]\d{2,5}){2,6})(?![\w/-]|\.\d)", re.I)

_NO = r"(?:no\.?|nr\.?|n[°º]|n\.º|num(?:ber|éro|ero)?\.?|nummer|#)"
_ID_LABEL = (
    r"(?:SSNs?|social security" + rf"(?: {_NO})?" + r"|national insurance" + rf"(?: {_NO})?" + r"|passport" + rf"(?: {_NO})?" + r"|patient(?: id)?" + rf"(?: {_NO})?"
    r"|personal identity" + rf"(?: {_NO})?" + r"|identity (?:card )?" + _NO + r"|ORCID(?: iD)?|reisepass" + rf"(?:[- ]?{_NO})?" + r"|versicherung(?:s)?(?:[- ]?" + _NO + r")|sozialversicherung(?:s)?(?:[- ]?" + _NO + r")"
    r"|personenkennzahl|personenkennziffer|patienten-?(?:" + _NO + r")|steuer(?:-?id|nummer)|numéro de sécurité sociale|" + _NO + r" de sécurité sociale|" + _NO + r" d[’']identité(?: personnelle)?|passeport(?: " + _NO + r")?|dossier patient(?: " + _NO + r")?"
    r"|" + _NO + r" de afiliación(?: a la seguridad social)?|pasaporte(?: " + _NO + r")?|documento de identidad(?: " + _NO + r")?|historia clínica(?: " + _NO + r")?|seguridad social(?: " + _NO + r")?|DNI|NIE|NIF|id(?=\s*[:=]))"
)
_ID_BODY = r"(?:\d{4}-\d{4}-\d{4}-\d{3}[\dX]|\d{3}-\d{2}-\d{4}|\d{6}[-+]\d{4}\p{L}?|\p{L}{2} ?\d{2} ?\d{2} ?\d{2} ?\p{L}|\p{L}{1,2}\d{6,9}|\d{6,12}\p{L}?)(?![\w-])"
_ID = re.compile(rf"(?<![\w])(?:{_ID_LABEL})\s*(?:[:=]\s*|\s)\s*(?:https?://[\w.]+/)?(?P<id>{_ID_BODY})", re.I)
_ID_PLAIN = re.compile(r"(?<![\w/-])(?:https?://orcid\.[\w.]+/)?(?P<id>\d{4}-\d{4}-\d{4}-\d{3}[\dX])(?![\w-])")

_CAP = r"\p{Lu}[\p{L}’'\-]+"
_NUM = r"\d{1,4}(?: ?[A-Za-z](?!\w))?"
_TOWN = rf"{_CAP}(?:[ \-](?:am |an der |sur |de |la )?{_CAP}){{0,2}}"
_EN_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Crescent|Cres|Blvd|Boulevard|Drive|Dr|Court|Ct|Way|Place|Pl|Square|Sq|Terrace|Row|Hill|Gardens|Park|Parade|Walk)\.?"
_C = r"(?:,\s*|\s*[\n\r]\s*)"
_ZIP = r"(?:[A-Z]{1,2}-)?\d{4,5}"
_ADDRESS = re.compile(
    r"(?<![\w/.-])(?:"
    # box
    rf"(?:P\.? ?O\.? ?Box|Post Office Box|Postfach|Apartado(?: de correos)?|Apdo\.?|B\.?P\.?|Boîte postale|Case postale)\s+\d{{1,6}}{_C}(?:{_ZIP}\s+)?{_TOWN}(?:(?:,?\s+[A-Z]{{2}})?,?\s+\d{{4,5}})?"
    # number first: flat, number, street, town, region, code
    rf"|(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s+\d{{1,4}}\w?{_C})?{_NUM}\s+{_CAP}(?:\s+{_CAP}){{0,2}}\s+{_EN_STREET}(?:{_C}(?:Apt\.?|Apartment|Flat|Unit|Suite|Room)\s+\d{{1,4}}\w?)?{_C}{_TOWN}(?:,?\s+[A-Z]{{2}})?(?:,?\s+\d{{4,5}})?"
    # number first, street kind first: rue, avenue, boulevard
    rf"|\d{{1,4}}(?:\s+(?:bis|ter|quater))?,?\s+(?:rue|avenue|boulevard|place|allée|chemin|impasse|quai|cours|route|square)(?:\s+(?:de la|de l[’']|des|du|de|d[’']))?\s+{_CAP}(?:\s+{_CAP}){{0,2}}{_C}(?:{_ZIP}\s+)?{_TOWN}(?:\s+Cedex(?:\s+\d+)?)?"
    # street kind first: Calle, Avda.
    rf"|(?:Calle|C/|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|Camino|Ronda)\s+(?:(?:de la|de los|del|de)\s+)?{_CAP}(?:\s+{_CAP}){{0,2}},?\s+(?:n\.º\s+)?\d{{1,4}}(?:,\s+\d{{1,2}}\.?[ºª]\.?(?:\s+[A-Z])?)?{_C}{_ZIP}\s+{_TOWN}"
    # street, number, code, town
    rf"|(?:{_CAP}(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm|steig)|(?:Am|An der|An den|Im|In der|Auf der|Zum|Zur|Unter den)\s+{_CAP}|{_CAP}\s+(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring|Damm))\s+\d{{1,4}}(?: ?[a-z](?!\w))?{_C}{_ZIP}\s+{_TOWN}"
    r")(?!\w)"
)

# --- names -----------------------------------------------------------------------------------------------------------

_TITLES = {"dr", "prof", "mr", "mrs", "ms", "miss", "herr", "frau", "mme", "mlle", "sr", "sra", "dra", "m", "sir", "dipl", "ing"}
#: Words that are no given name in any corpus: articles, pronouns, prepositions, conjunctions, labels of contact data.
_NOT_GIVEN = set(
    """the a an this that these those our their its his her in on at of for from by with and or as to but so yet if when while where after before see both
    der die das den dem des ein eine im am und oder nach von zu für mit bei gegen unter wir
    le la les l un une des du de et ou dans par pour selon nous
    el los las una unos en y o con por para según
    tel fax email mail phone contact""".split()
)
_PARTICLE = r"(?:(?:[Vv]an der|[Vv]an den|[Vv]an|[Vv]on der|[Vv]on|[Dd]e la|[Dd]e los|[Dd]el|[Dd]e|[Dd]i|[Dd]a|[Aa]l|[Ee]l|[Mm]c|[Ll]e|VAN DER|VAN|VON|DE LA|DE|DEL|AL|MC|DI|DA)[  ]?\s{0,2})"
_GAP = r"(?:[ \t]*(?:\r\n?|\n|\f)\f?[ \t]*|[ \t]+)"
_WORDS = re.compile(r"\p{Lu}[\p{L}’']*(?:-\p{Lu}[\p{L}’']*)*")
_INITIALS = r"\p{Lu}\.(?:[ ]?-?\p{Lu}\.){0,3}"
_GIVEN_BEFORE = re.compile(rf"(?<![\p{{L}}\p{{N}}.'’@-])(?P<first>\p{{Lu}}[\p{{L}}’']+(?:-\p{{Lu}}[\p{{L}}’']+)?|{_INITIALS})(?:{_GAP}(?:(?P<mid>{_INITIALS})|(?!(?:Van|Von|De|Del|Di|Da|Al|El|Mc|Le|La)(?!\w))(?P<second>\p{{Lu}}[\p{{L}}’']+(?:-\p{{Lu}}[\p{{L}}’']+)?)))?{_GAP}(?:{_PARTICLE})?$")
_PARTICLE_BEFORE = re.compile(rf"(?<![\p{{L}}\p{{N}}]){_PARTICLE}$")
_GIVEN_AFTER = re.compile(rf"[ \t]*,(?:{_GAP})?(?P<first>\p{{Lu}}\p{{Ll}}[\p{{L}}’']*(?:-\p{{Lu}}[\p{{L}}’']+)?|\p{{Lu}}{{2,}}(?:-\p{{Lu}}{{2,}})?|{_INITIALS})(?:{_GAP}{_INITIALS})?(?![\p{{L}}\p{{N}}@])")
_ROAD_AFTER = re.compile(rf"{_GAP}(?:Road|Street|Avenue|Lane|et al|test\b|method\b|model\b|index\b)")
#: Tokens before a family name in which its given names stand.
_TOKENS_BEFORE = 7


_SOLID = re.compile(r"\S+")


class Names:
    """What is known about words: rows (word, kind) of a lexicon (given, family) and of a corpus (common: a family name that is a common word; likely: a given name).

    Without a corpus, `likely` is None, and any capitalised word that isn't known to be something else may be a given name.
    """

    def __init__(self, rows: Iterable[tuple[str, str]], likely: bool | None = None, parts: tuple[set[str], set[str]] | None = None):
        rows = [(t.strip().lower(), k) for t, k in rows if t and t.strip() and k]
        self.given, family, common, found = ({t for t, k in rows if k == kind} for kind in ("given", "family", "common", "likely"))
        self.likely = found if likely else None
        self.heads, self.tails = self._parts(family) if parts is None else parts
        self.family, self.odd, self.common = family - common, family & common, common

    @staticmethod
    def _parts(family: set[str], recur: int = 5) -> tuple[set[str], set[str]]:
        """Heads and tails that recur with each other: a tail is kept if it ends words with `recur` heads that recur themselves, and so on."""
        cuts = [(f[:i], f[i:]) for f in family for i in range(2, len(f) - 2)]
        for _ in range(4):
            tails_of, heads_of = defaultdict(set), defaultdict(set)
            for h, t in cuts:
                tails_of[h].add(t)
                heads_of[t].add(h)
            kept = [(h, t) for h, t in cuts if len(tails_of[h]) >= recur and len(heads_of[t]) >= recur]
            if len(kept) == len(cuts):
                break
            cuts = kept
        return {h for h, _ in cuts}, {t for _, t in cuts}

    def _composed(self, word: str) -> bool:
        return any(word[:i] in self.heads and word[i:] in self.tails for i in range(2, len(word) - 2))

    def is_family(self, word: str) -> bool:
        """A family name, or several joined by hyphens."""
        parts = word.lower().split("-")
        return all(p in self.family or (len(p) > 4 and p not in self.common and self._composed(p)) for p in parts)

    def is_given(self, word: str) -> bool:
        """Known, or found to be one; without a corpus, at least nothing that is known not to be a given name."""
        low = word.lower()
        if low in self.given:
            return True
        if len(word) < 2 or low in _NOT_GIVEN or low in _TITLES:
            return False
        return not self.is_family(word) if self.likely is None else any(p in self.likely or p in self.given for p in (low, *low.split("-")))


def _names(text: str, names: Names) -> Iterator[tuple[int, int]]:
    begins: list[int] | None = None
    for m in _WORDS.finditer(text):
        word = m.group()
        if len(word) < 4 and word.lower() not in names.family:
            continue
        certain = True
        if not names.is_family(word):
            if word.lower() not in names.odd:
                continue
            certain = False
        start, end = m.span()
        if end < len(text) and (text[end] == "@" or text[end : end + 1] == "_") or start and text[start - 1] in "@._+-/":
            continue
        if begins is None:
            begins = [x.start() for x in _SOLID.finditer(text)]
        i = bisect_right(begins, start)
        before = text[begins[max(0, i - 1 - _TOKENS_BEFORE)] : start]
        g = _GIVEN_BEFORE.search(before)
        if g:
            first, second = g.group("first"), g.group("second")
            at = start - len(before) + g.start("first")
            initials = "." in first
            if g.group("mid") and not initials and (first.lower() in _TITLES or not names.is_given(first)):
                # initials behind a title
                at, first, initials = start - len(before) + g.start("mid"), g.group("mid"), True
            elif second and not names.is_given(second):
                second, first, at, initials = None, "", None, False
            elif second and not initials and (first.lower() in _TITLES or not names.is_given(first) or (first.lower() not in names.given and second.lower() in names.given)):
                # the word in front belongs to the sentence
                at = start - len(before) + g.start("second")
                first = second
            if first and first.lower() not in _TITLES and (initials or names.is_given(first)):
                if certain or (first.lower() in names.given and not _ROAD_AFTER.match(text, end)):
                    yield at, end
                    continue
        if not certain:
            continue
        a = _GIVEN_AFTER.match(text, end)
        if a and ("." in a.group("first") or names.is_given(a.group("first"))):
            p = _PARTICLE_BEFORE.search(before)
            yield (start - len(before) + p.start() if p else start), a.end()


def mentions(text: str | None, names: Names) -> list[tuple[str, int, int]]:
    """(kind, start, end) in source characters, from 0, in order and without overlaps. Null and empty texts have none."""
    if not text:
        return []
    m = deobfuscate(text)
    t = m.text
    found: list[tuple[int, int, str, int]] = []
    if "@" in t:
        found += [(x.start(), x.end(), "email", 0) for x in _EMAIL.finditer(t)]
    for x in _ID.finditer(t):
        found.append((*x.span("id"), "id_number", 1))
    for x in _ID_PLAIN.finditer(t):
        found.append((*x.span("id"), "id_number", 1))
    found += [(x.start(), x.end(), "address", 2) for x in _ADDRESS.finditer(t)]
    for x in _PHONE.finditer(t):
        if sum(c.isdigit() for c in x.group()) >= 7:
            found.append((x.start(), x.end(), "phone", 3))
    found += [(*x.span("phone"), "phone", 4) for x in _LABELLED.finditer(t) if sum(c.isdigit() for c in x.group()) >= 7]
    found += [(a, b, "name", 5) for a, b in _names(t, names)]
    taken: list[tuple[int, int, str]] = []  # in order, without overlaps
    for a, b, kind, _ in sorted(found, key=lambda x: (x[3], x[0], -x[1])):
        i = bisect_right(taken, (a, len(t) + 1, ""))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            insort(taken, (a, b, kind))
    return [(kind, *m.source(a, b)) for a, b, kind in taken]


def masked(text: str | None, names: Names) -> str | None:
    """The text with each mention replaced by a placeholder of its kind, otherwise unchanged."""
    if not text:
        return text
    out, p = [], 0
    for kind, a, b in mentions(text, names):
        out += [text[p:a], f"[{kind.upper()}]"]
        p = b
    return "".join([*out, text[p:]])


_LOWER = re.compile(r"(?<![\p{L}\p{N}@._/+'’-])\p{Ll}{2,}(?![\p{L}\p{N}@_/+'’-]|\.\p{L})")
_CAPITAL = re.compile(rf"(?<![\p{{L}}\p{{N}}@._/+'’-])(?P<word>\p{{Lu}}[\p{{L}}’']*(?:-\p{{Lu}}[\p{{L}}’']*)*)(?:{_GAP}{_INITIALS})?(?={_GAP}(?:{_PARTICLE})?(?P<next>\p{{Lu}}[\p{{L}}’']*(?:-\p{{Lu}}[\p{{L}}’']*)*))?")


def learned_parts(lexicon: DataFrame) -> tuple[set[str], set[str]]:
    """Heads and tails of family names, learned from LEXICON_ROWS of them at most."""
    family = lexicon.where("name_kind = 'family'").select(F.lower(F.trim("name_text")).alias("w")).where("w <> ''").distinct()
    return Names._parts({r.w for r in family.orderBy(F.xxhash64("w"), "w").limit(LEXICON_ROWS).collect()})


def word_knowledge(docs: DataFrame, lexicon: DataFrame, parts: tuple[set[str], set[str]]) -> DataFrame:
    """(word, kind): the lexicon in lower case, and what the texts say: common family words, likely given names. All in joins on words."""
    own = Names([], parts=parts)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            c: Counter = Counter()
            for t in pdf["text"]:
                c.update((w, None) for w in _LOWER.findall(t))
                for m in _CAPITAL.finditer(t):
                    c[m.group("word").lower(), (m.group("next") or "").lower().rpartition("-")[2]] += 1
            # seen: in lower case, capitalised, before the word f; whether w or f is composed like a family name
            yield pd.DataFrame([(w, f, n, len(w) > 4 and own._composed(w), bool(f) and len(f) > 4 and own._composed(f)) for (w, f), n in c.items()], columns=["w", "f", "n", "w_made", "f_made"])

    seen = docs.where("text <> ''").select("text").mapInPandas(count, "w string, f string, n long, w_made boolean, f_made boolean")
    seen = written(seen.groupBy("w", "f", "w_made", "f_made").agg(F.sum("n").alias("n")), "seen")
    lex = lexicon.select(F.lower(F.trim("name_text")).alias("word"), F.col("name_kind").alias("kind")).where("word <> '' and kind in ('given', 'family')").distinct()
    family = lex.where("kind = 'family'").select(F.col("word").alias("f"), F.lit(True).alias("listed"))
    before = seen.where("f is not null").join(family, "f", "left").groupBy("w").agg(F.sum("n").alias("n_capital"), F.sum(F.when(F.col("listed") | F.col("f_made"), F.col("n")).otherwise(0)).alias("n_before"))
    likely = before.where((F.col("n_before") > 0) & (F.col("n_before") >= GIVEN_SHARE * F.col("n_capital")) & (F.length("w") > 2)).select(F.col("w").alias("word"), F.lit("likely").alias("kind"))
    how = seen.groupBy("w").agg(F.max("w_made").alias("made"), F.sum(F.when(F.col("f").isNull(), F.col("n")).otherwise(0)).alias("n_lower"), F.sum(F.when(F.col("f").isNull(), 0).otherwise(F.col("n"))).alias("n_upper"))
    common = how.where("n_lower > 0 and n_lower >= n_upper").join(family.withColumnRenamed("f", "w"), "w", "left").where("listed or made").select(F.col("w").alias("word"), F.lit("common").alias("kind"))
    return written(lex.unionByName(likely).unionByName(common), "words")


def _with_names(docs: DataFrame, lexicon: DataFrame, work: Callable[[pd.DataFrame, Names], pd.DataFrame], schema: str) -> DataFrame:
    """work(pdf(doc_id, text), names) over all docs."""
    parts = learned_parts(lexicon)
    known = word_knowledge(docs, lexicon, parts)
    docs = docs.select("doc_id", "text")
    if known.count() <= LEXICON_ROWS:
        rows = [tuple(r) for r in known.collect()]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = Names(rows, True, parts)
            for pdf in frames:
                yield work(pdf, names)

        return docs.mapInPandas(run, schema)
    blocks = max(1, -(-docs.count() // BLOCK_TEXTS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = {(b, p) for b, t in zip(pdf["block"], pdf["text"]) if t for w in set(_WORDS.findall(deobfuscate(t).text)) for p in (w.lower(), *w.lower().split("-"))}
            yield pd.DataFrame(sorted(got), columns=["block", "word"])

    own = placed.mapInPandas(words, "block long, word string").distinct().join(known, "word")
    done = placed.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("block").cogroup(own.groupBy("block"))
    out = done.applyInPandas(lambda pdf, rows: work(pdf[["doc_id", "text"]], Names(zip(rows["word"], rows["kind"]), True, parts)), schema.replace(f"doc_id {kind}", "doc_id string", 1))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def find_mentions(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, kind, start_pos): one row per mention in docs(doc_id, text); start_pos counts Unicode code points from 1. Null and empty texts have none."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(pdf: pd.DataFrame, names: Names) -> pd.DataFrame:
        return pd.DataFrame([(d, k, a + 1) for d, t in zip(pdf["doc_id"], pdf["text"]) for k, a, _ in mentions(t, names)], columns=["doc_id", "kind", "start_pos"])

    return _with_names(docs.where("text is not null"), lexicon, work, f"doc_id {kind}, kind string, start_pos long").distinct()


def redact(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, text) with placeholders; null stays null."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_names(docs, lexicon, lambda pdf, names: pdf.assign(text=[masked(t, names) for t in pdf["text"]]), f"doc_id {kind}, text string")
