"""What the words of a query say about the evidence it asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.text import cue_tokens

# Cue words.
FOUNDATIONAL = "overview background history historical introduction fundamentals foundational classic seminal survey tutorial review".split()
CURRENT = "latest recent current new newest today state-of-the-art sota modern update updated".split()
EVOLVING = "trend trends emerging evolving compare comparison comparative versus vs development progress".split()
SURVEY = "survey review overview benchmark comparison comparative".split()
TEMPORAL = "latest recent current new newest updated update modern emerging trend trends progress".split()
CITATION = "seminal classic foundational influential impactful citation citations cited survey review benchmark".split()
MIXED = "compare comparison comparative versus vs evolving evolution development".split()
TEMPORAL_PHRASES = ("this year", "last year", "state of the art", "state-of-the-art")
CITATION_PHRASES = ("highly cited", "well cited", "most cited")
NOVELTY = "recent latest emerging novel state-of-the-art update updated current".split()
INTENTS = ("foundational", "current", "evolving", "survey")


def token_set(text: Column) -> Column:
    return F.array_distinct(cue_tokens(text))


def hits(tokens: Column, words: list[str]) -> Column:
    """How many of the words occur."""
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, words)))).cast("double")


def _any_phrase(low: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out


def intent_scores(text: Column) -> dict[str, Column]:
    """Raw score of each intent."""
    low = F.lower(F.coalesce(text, F.lit("")))
    t = token_set(low)
    plus = lambda cond, x: F.when(cond, x).otherwise(0.0)
    overviewing = hits(t, ["survey", "overview", "review"]) > 0
    return {
        "foundational": 0.2 + hits(t, FOUNDATIONAL),
        "current": 0.2 + hits(t, CURRENT) + plus(low.rlike("202[3-6]"), 1.0) + plus(low.contains("state of the art"), 1.5),
        "evolving": 0.2 + hits(t, EVOLVING) + plus(low.contains("how has") | low.contains("change"), 1.0),
        "survey": 0.2 + hits(t, SURVEY) + plus(low.contains("?"), 0.1) + plus(overviewing, 1.2),
    }


def intent_label(scores: dict[str, Column]) -> Column:
    """The best intent; ties go to the first in INTENTS."""
    best = F.greatest(*scores.values())
    out = F.lit(INTENTS[-1])
    for name in reversed(INTENTS[:-1]):
        out = F.when(scores[name] >= best, name).otherwise(out)
    return out


def softmax(scores: dict[str, Column]) -> dict[str, Column]:
    best = F.greatest(*scores.values())
    total = sum((F.exp(s - best) for s in scores.values()), F.lit(0.0))
    return {k: F.exp(s - best) / total for k, s in scores.items()}


def asks_time(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (hits(token_set(low), TEMPORAL) > 0) | _any_phrase(low, TEMPORAL_PHRASES) | low.rlike(r"\b20(2[4-9]|3[0-9])\b") | low.rlike(r"\b\d{4}-\d{1,2}(-\d{1,2})?\b")


def asks_citations(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (hits(token_set(low), CITATION) > 0) | _any_phrase(low, CITATION_PHRASES)


def evidence_route(text: Column) -> Column:
    """temporal, citation or mixed; temporal where nothing speaks for another."""
    low = F.lower(F.coalesce(text, F.lit("")))
    t = token_set(low)
    time = hits(t, TEMPORAL) + F.when(asks_time(text), 1).otherwise(0)
    cited = hits(t, CITATION) + F.when(asks_citations(text), 2).otherwise(0)
    return F.when((hits(t, MIXED) > 0) | ((time > 0) & (cited > 0)), "mixed").when(cited > 0, "citation").otherwise("temporal")


def novelty_words(d: Column) -> Column:
    """The novelty words of a text's token set."""
    return F.array_intersect(F.array(*map(F.lit, NOVELTY)), d)


def novelty(q: Column, d: Column, said: Column | None = None) -> Column:
    """lexical_novelty of the token sets of a query and a text. said: the text's novelty_words, where they are known."""
    new = F.size(F.array_except(novelty_words(d) if said is None else said, q))
    other = (F.size(d) - F.size(F.array_intersect(d, q))) / F.greatest(F.size(d), F.lit(1))
    return F.when(F.size(d) > 0, F.least(F.lit(1.0), 0.2 * new + 0.1 * other)).otherwise(0.0)


def lexical_novelty(query: Column, text: Column) -> Column:
    """Novelty words and other words that the text has and the query hasn't; 0 for a text without words."""
    return novelty(token_set(F.coalesce(query, F.lit(""))), token_set(F.coalesce(text, F.lit(""))))
