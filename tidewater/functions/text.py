"""Column-to-Column text functions; every one stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
BM25_TOKEN = r"[\p{L}\p{N}_]+"
CUE_TOKEN = r"[a-z0-9][a-z0-9-]*"


def strip(c: Column) -> Column:
    """Without surrounding Unicode white space; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def as_text(c: Column) -> Column:
    """Stripped text, null as ''."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def normalize_ws(c: Column) -> Column:
    """Each run of white space becomes one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def first_non_empty(*cs: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))


def join_non_empty(*cs: Column) -> Column:
    return normalize_ws(F.concat_ws(" ", *(F.nullif(as_text(c), F.lit("")) for c in cs)))


def text_view(mode: str, title: Column, abstract: Column, full_text: Column) -> Column:
    """The text that is indexed: `title_abstract`, `full_text` (falls back to title and abstract) or `all_text`."""
    ta = join_non_empty(title, abstract)
    if mode == "title_abstract":
        return ta
    if mode == "full_text":
        ft = normalize_ws(as_text(full_text))
        return F.when(ft != "", ft).otherwise(ta)
    if mode == "all_text":
        return join_non_empty(title, abstract, full_text)
    raise ValueError(f"unknown text mode: {mode}")


def bm25_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(BM25_TOKEN), F.lit(0))


def cue_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(CUE_TOKEN), F.lit(0))


def ws_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != "")


def words(c: Column) -> Column:
    """Longest runs of Unicode letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
