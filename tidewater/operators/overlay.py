"""The temporal and citation overlay on a ranked run, and the profile of a query's evidence."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.cues import INTENTS, asks_citations, asks_time, evidence_route, intent_label, intent_scores, novelty, novelty_words, token_set
from tidewater.functions.dates import age_days, parse_seconds
from tidewater.functions.scoring import decay, maturity, min_max
from tidewater.operators.citations import SIGNALS
from tidewater.session import bounded, written

# Base weight of each component, and its multiplier for each intent (foundational, current, evolving, survey).
WEIGHTS = {
    "base": (1.0, (1.0, 1.0, 1.0, 1.0)),
    "recency": (0.25, (-0.25, 1.6, 1.1, 0.3)),
    "update": (0.2, (-0.25, 1.5, 1.1, 0.3)),
    "foundation": (0.15, (1.8, -0.35, 0.8, 1.1)),
    "novelty": (0.1, (0.3, 1.2, 1.3, 0.5)),
    "c_total": (0.1, (1.4, 0.45, 0.9, 1.25)),
    "c_recent": (0.12, (0.35, 1.6, 1.15, 0.55)),
    "c_foundation": (0.1, (1.7, 0.35, 0.85, 1.2)),
    "c_emerging": (0.12, (0.35, 1.6, 1.25, 0.45)),
    "c_outbound": (0.02, (0.9, 0.5, 0.7, 1.1)),
}
MODES = ("direct", "citation_only", "router", "additive")


@dataclass(frozen=True)
class Settings:
    mode: str = "direct"
    head: int = 200
    candidates: int = 200
    gate: float = 0.05
    fresh_days: float = 90.0
    age_days: float = 365.0
    profile_top: int = 20
    entropy: float = 0.55
    share: float = 0.3
    cited: int = 10
    span: int = 5
    window: int = 5
    old_share: float = 0.5
    alpha: tuple[float, float, float] = (0.25, 0.15, 0.03)
    beta: tuple[float, float, float] = (0.25, 0.12, 0.03)
    use_intent: bool = True
    use_update: bool = True
    use_creation: bool = False
    tail: str = "raw"


def document_features(docs: DataFrame, at_s: int, s: Settings) -> DataFrame:
    """docs(doc_id, text, published_s, updated_s, ...[, created_s]) plus ages and the curves over them. use_creation takes created_s first."""
    pub = F.coalesce("created_s", "published_s") if s.use_creation else F.col("published_s")
    upd = F.coalesce(F.col("updated_s"), pub) if s.use_update else pub
    return docs.withColumns({"age": age_days(at_s, pub), "update_age": age_days(at_s, upd)}).withColumns(
        {"recency": decay(F.col("age"), s.fresh_days), "update": decay(F.col("update_age"), s.fresh_days) if s.use_update else F.lit(0.0), "foundation": maturity(F.col("age"), s.age_days)}
    )


def year_entropy(years: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, entropy, n_years): entropy of the years over ln(distinct years); 0 for one year, null for none."""
    n = years.where("year is not null").groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    e = n.withColumn("p", p).groupBy(*keys).agg(F.sum(-F.col("p") * F.log("p")).alias("h"), F.count(F.lit(1)).alias("n_years"))
    return e.select(*keys, F.when(F.col("n_years") > 1, F.col("h") / F.log(F.col("n_years").cast("double"))).otherwise(0.0).alias("entropy"), "n_years")


def query_profiles(run: DataFrame, topics: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """One row per query: cues, entropy and span of its top documents' years, shares of old and of much-cited ones, alpha and beta, and the route.

    docs(doc_id, year, total_in). A document that docs doesn't hold has no year and no citations; it counts in the share of cited ones, but that of old ones is of those with a year.
    """
    top = run.where(F.col("rank") <= s.profile_top).select("query_id", "doc_id").join(docs.select("doc_id", "year", "total_in"), "doc_id", "left")
    top = top.withColumn("last_year", F.max("year").over(Window.partitionBy("query_id")))
    facts = top.groupBy("query_id").agg(
        (F.max("year") - F.min("year")).alias("span"),
        (F.coalesce(F.try_divide(F.count_if(F.col("year") <= F.col("last_year") - max(s.window, 1)), F.count("year")), F.lit(0.0))).alias("old_share"),
        (F.count_if(F.col("total_in") >= s.cited) / F.count(F.lit(1))).alias("cited_share"),
    )
    q = topics.join(facts, "query_id", "left").join(year_entropy(top), "query_id", "left")
    text = F.col("text")
    q = q.withColumns({"time_cue": asks_time(text), "citation_cue": asks_citations(text), "text_route": evidence_route(text)})
    alpha = F.when(F.col("time_cue"), s.alpha[0]).when(F.col("entropy") <= s.entropy, s.alpha[1]).otherwise(s.alpha[2])
    old = (F.col("span") >= s.span) & (F.col("old_share") >= s.old_share)
    beta = F.when(F.col("citation_cue"), s.beta[0]).when((F.col("cited_share") >= s.share) | old, s.beta[1]).otherwise(s.beta[2])
    q = q.withColumns({"alpha": alpha, "beta": beta})
    time, cited = F.col("alpha") >= s.alpha[1], F.col("beta") >= s.beta[1]
    return q.withColumn("route", F.when(time & cited, "mixed").when(time, "temporal").when(cited, "citation").otherwise(F.col("text_route")))


def candidates(run: DataFrame, head: int) -> DataFrame:
    """(doc_id), distinct: documents in the head of any query, for which features are wanted."""
    return run.where(F.col("rank") <= head).select("doc_id").distinct()


#: When each snapshot was taken.
SNAPSHOT_TIMES = {"snapshot-1": "2025-05-31T23:59:59Z", "snapshot-2": "2025-08-31T23:59:59Z", "snapshot-3": "2025-11-30T23:59:59Z"}


def candidate_instants(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(at_s): dates of publication and update of docs(published_s, created_s, updated_s), as the settings take them."""
    pub = F.coalesce("created_s", "published_s") if s.use_creation else F.coalesce("published_s", "created_s")
    both = F.array(pub, F.coalesce("updated_s", pub)) if s.use_update else F.array(pub)
    return docs.select(F.explode(both).alias("at_s")).where("at_s is not null")


def evaluation_time(docs: DataFrame, snapshot: str | None = None, timestamp: str | None = None, s: Settings = Settings(), by: str = "snapshot") -> int:
    """Seconds since 1970 at which ages are taken: the bundle's timestamp, else when its snapshot was taken, else the latest date of docs, else now. by='latest' looks at the dates at once."""
    spark = docs.sparkSession
    if by == "snapshot":
        for text in (timestamp, SNAPSHOT_TIMES.get(snapshot or "")):
            if text and (got := spark.range(1).select(parse_seconds(F.lit(text))).first()[0]) is not None:
                return got
    last = candidate_instants(docs, s).agg(F.max("at_s")).first()[0]
    return int(time.time()) if last is None else last


def _weight(name: str) -> Column:
    base, per_intent = WEIGHTS[name]
    out = F.lit(None).cast("double")
    for intent, factor in zip(INTENTS, per_intent):
        out = F.when(F.col("intent") == intent, base * factor).otherwise(out)
    return out


def overlay(run: DataFrame, topics: DataFrame, docs: DataFrame, at_s: int, s: Settings = Settings(), top: int = 1000, hints: DataFrame | None = None, numbered: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank, mode): the head of a run scored again with temporal and citation evidence, then its tail.

    run(query_id, doc_id, score, rank); docs(doc_id, text, published_s, updated_s, year, total_in, sig_*). Head documents that docs
    doesn't hold keep their normalised relevance. The tail keeps its raw scores (tail='raw') or is scaled under the head ('rescale').
    Queries that topics doesn't hold are dropped. hints(query_id, doc_id, boost), one row per pair at most, adds to the temporal score of known head
    documents what history or clusters say in their favour, so it passes the same gate, weight and route. numbered: the run's ranks are 1, 2, ... in
    each query, so that its tail keeps its places and only heads are ranked again.
    """
    if s.mode not in MODES:
        raise ValueError(f"unknown overlay mode: {s.mode}")
    q = query_profiles(run, topics, docs, s)
    scores = intent_scores(F.col("text"))
    q = q.withColumn("intent", intent_label(scores) if s.use_intent else F.lit("evolving"))
    q = bounded(written(q.select("query_id", token_set(F.coalesce("text", F.lit(""))).alias("asked"), "alpha", "beta", "route", "intent"), "profiles"))
    whole = Window.partitionBy("query_id")
    # features of the heads' documents only; each text is split once, and no text or query goes with the pairs that are ranked
    known = document_features(docs.join(bounded(candidates(run, s.head)), "doc_id", "left_semi"), at_s, s)
    known = known.select("doc_id", token_set(F.coalesce("text", F.lit(""))).alias("words"), "recency", "update", "foundation", *(f"sig_{n}" for n in SIGNALS), F.lit(True).alias("known"))
    known = known.withColumn("said", novelty_words(F.col("words")))
    head = run.where(F.col("rank") <= s.head).select("query_id", "doc_id", "score", "rank").join(known, "doc_id", "left").join(q.select("query_id", "asked"), "query_id")
    head = head.withColumn("novelty", F.when(F.col("known"), novelty(F.col("asked"), F.col("words"), F.col("said")))).drop("asked", "words", "said")
    head = head.withColumn("rel", min_max(F.col("score"), whole))
    for name in SIGNALS:
        # null for unknown documents, so these take no part in the range
        head = head.withColumn(f"c_{name}", min_max(F.when(F.col("known"), F.col(f"sig_{name}")), whole, F.when(F.col(f"sig_{name}") > 0, 1.0).otherwise(0.0)))
    head = head.join(q.drop("asked"), "query_id")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    time = sum((_weight(c) * z(c) for c in ("recency", "update", "foundation", "novelty")), F.lit(0.0))
    cited = sum((_weight(f"c_{c}") * z(f"c_{c}") for c in SIGNALS), F.lit(0.0))
    if hints is not None:
        head = head.join(hints.select("query_id", "doc_id", "boost"), ["query_id", "doc_id"], "left")
        time = time + z("boost")
    base_score = _weight("base") * F.col("rel")
    if s.mode != "direct":
        open_ = (F.col("rank") <= s.candidates) & (F.col("rel") >= s.gate)
        time, cited = F.when(open_, F.col("alpha") * time).otherwise(0.0), F.when(open_, F.col("beta") * cited).otherwise(0.0)
    final = {
        "citation_only": base_score + cited,
        "router": base_score + F.when(F.col("route").isin("temporal", "mixed"), time).otherwise(0.0) + F.when(F.col("route").isin("citation", "mixed"), cited).otherwise(0.0),
    }.get(s.mode, base_score + time + cited)
    head = head.select("query_id", "doc_id", F.when(F.col("known"), final).otherwise(F.col("rel")).alias("score"), F.lit(0).alias("part"), F.col("rank").alias("pos"))
    tail = run.where(F.col("rank") > s.head).join(q.select("query_id"), "query_id", "left_semi").select("query_id", "doc_id", "score", F.lit(1).alias("part"), F.col("rank").alias("pos"))
    if s.tail == "rescale":
        low = head.groupBy("query_id").agg(F.min("score").alias("low"))
        tail = tail.join(low, "query_id").withColumn("score", F.col("low") - F.col("pos") / 1e6).drop("low")
    first = F.when(F.col("part") == 0, F.round("score", 8)).otherwise(0.0)
    w = Window.partitionBy("query_id").orderBy("part", first.desc(), "pos", "doc_id")
    if numbered:
        out = head.withColumn("rank", F.row_number().over(w)).unionByName(tail.withColumn("rank", F.coalesce(F.col("pos").cast("int"), F.lit(0))))
    else:
        out = head.unionByName(tail).withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= top).select("query_id", "doc_id", "score", "rank", F.lit(s.mode).alias("mode"))
