"""SQL of the retrieval queries, for DuckDB over the same tables."""

from __future__ import annotations

import re

from tidewater.functions import cues
from tidewater.operators.lexical import STOP_WORDS
from tidewater.operators.overlay import WEIGHTS
from tidewater.plans.retrieval_queries import AFTER, AT, BASELINE, CUT, FROZEN, WINDOW_END, WINDOW_START

_KEY = r"regexp_replace(doc_id, '^\s+|\s+$', '', 'g')"
_WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def _text(x: str) -> str:
    return _norm(f"coalesce({x}, '')")


def _seconds(x: str) -> str:
    return rf"""CASE WHEN regexp_full_match({x}, '\d{{4}}-\d{{2}}-\d{{2}}.*') THEN CAST(epoch(TRY_CAST(left(replace({x}, 'T', ' '), 19) AS TIMESTAMP)) AS BIGINT)
    WHEN regexp_full_match({x}, '\d{{4}}-\d{{2}}') THEN CAST(epoch(TRY_CAST({x} || '-01' AS TIMESTAMP)) AS BIGINT)
    WHEN regexp_full_match({x}, '\d{{4}}') THEN CAST(epoch(TRY_CAST({x} || '-01-01' AS TIMESTAMP)) AS BIGINT) END"""


_TA = _norm(f"{_text('title')} || ' ' || {_text('abstract')}")
_ALL = _norm(f"{_text('title')} || ' ' || {_text('abstract')} || ' ' || {_text('full_text')}")
_FT = f"CASE WHEN {_text('full_text')} <> '' THEN {_text('full_text')} ELSE {_TA} END"

#: Common tables, in the order in which they build on each other.
_CTE = {
    "corpus": rf"""SELECT doc_id, title, abstract, full_text, coalesce({_seconds('published_date')}, {_seconds('created_date')}) AS published_s, {_seconds('updated_date')} AS updated_s,
      CASE WHEN regexp_matches(published_date, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN CAST(substr(published_date, 6, 2) AS INT) END AS month
    FROM (SELECT doc_id, unnest(r) FROM (SELECT {_KEY} AS doc_id, arg_max(struct_pack(title := title, abstract := abstract, full_text := full_text, published_date := published_date, created_date := created_date, updated_date := updated_date), (snapshot_id, delivered_at)) AS r
      FROM document_snapshots WHERE {_KEY} <> '' GROUP BY 1))""",
    "dated": "SELECT doc_id, published_s, month FROM corpus",
    "ta": f"SELECT doc_id, {_TA} AS text FROM corpus",
    "ft": f"SELECT doc_id, {_FT} AS text FROM corpus",
    "early": f"SELECT doc_id, {_TA} AS text FROM corpus WHERE published_s <= {FROZEN}",
    "topics": r"SELECT query_id, max(text) AS text FROM queries WHERE TRY_CAST(regexp_extract(query_id, '(\d+)$', 1) AS BIGINT) % 20 = 0 AND trim(text) <> '' GROUP BY 1",
    "every_topic": "SELECT query_id, max(text) AS text FROM queries WHERE query_id IS NOT NULL AND trim(text) <> '' GROUP BY 1",
    "qr": f"SELECT query_id, {_KEY} AS doc_id, arg_max(coalesce(relevance, 0), (judged_at, coalesce(relevance, 0))) AS relevance FROM qrels WHERE query_id IS NOT NULL AND {_KEY} <> '' GROUP BY 1, 2",
    "runs": f"SELECT run_name, query_id, {_KEY} AS doc_id, max(score) AS score, min(CASE WHEN rank > 0 THEN rank END) AS rank FROM search_results WHERE query_id IS NOT NULL AND {_KEY} <> '' AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3",
    "snap_runs": f"SELECT run_name, snapshot_id, query_id, {_KEY} AS doc_id, max(score) AS score, min(CASE WHEN rank > 0 THEN rank END) AS rank FROM search_results WHERE query_id IS NOT NULL AND {_KEY} <> '' AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3, 4",
    "ranked": "SELECT * FROM (SELECT run_name, query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY run_name, query_id ORDER BY CASE WHEN rank > 0 THEN rank ELSE 1000000000 END, score DESC, doc_id) AS INT) AS rank FROM runs)",
    "counters": f"""SELECT doc_id, unnest(r) FROM (SELECT {_KEY} AS doc_id, arg_max(struct_pack(total_in := total_inbound_citations, recent_in := recent_inbound_citations, nonself_in := nonself_inbound_citations, nonself_recent_in := nonself_recent_inbound_citations, total_out := total_outbound_citations, foundational := foundational_signal, emerging := emerging_signal), (snapshot_id, computed_at)) AS r
      FROM citation_features WHERE {_KEY} <> '' GROUP BY 1)""",
}


def _with(parts: dict[str, str], body: str) -> str:
    """A query over the common tables that it names (directly or through others), and its own parts."""
    named = _CTE | parts
    text, used = body + " ".join(parts.values()), set()
    while True:
        new = {n for n in _CTE if n not in used and n not in parts and re.search(rf"\b{n}\b", text)}
        if not new:
            break
        used |= new
        text += " ".join(_CTE[n] for n in new)
    order = [n for n in named if n in used or n in parts]
    return "WITH " + ",\n".join(f"{n} AS ({named[n]})" for n in order) + "\n" + body


def _tokens(docs: str) -> dict[str, str]:
    return {
        "tok": rf"SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS tokens FROM {docs}",
        "st": "SELECT count(*) AS n_docs, avg(len(tokens)) AS mean_length, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens FROM tok",
        "po": "SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, unnest(tokens) AS term, CAST(len(tokens) AS BIGINT) AS length FROM tok) GROUP BY 1, 2",
        "dfs": "SELECT term, count(*) AS df FROM po GROUP BY 1",
    }


_OWN = {"own": r"SELECT query_id, term, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM topics) GROUP BY 1, 2"}


def _scores(weights: str, name: str = "sc") -> dict[str, str]:
    return {name: f"SELECT query_id, po.doc_id, sum(weight * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS score FROM {weights} JOIN po USING (term) JOIN dfs USING (term) CROSS JOIN st GROUP BY 1, 2 HAVING score > 0"}


def _top(source: str, k: int, tie: str = "doc_id", group: str = "query_id") -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {group} ORDER BY round(score, 8) DESC, {tie}) AS INT) AS rank FROM {source}) WHERE rank <= {k}"


def _bm25(docs: str, k: int) -> dict[str, str]:
    return _tokens(docs) | _OWN | _scores("own") | {"bm": _top("sc", k)}


_RUN = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM "
_RM3 = _tokens("ta") | _OWN | _scores("own") | {
    "fb": "SELECT query_id, doc_id, score / sum(score) OVER (PARTITION BY query_id) AS share FROM (" + _top("sc", 3) + ")",
    "rm": "SELECT query_id, term, sum(share * tf / length) AS score FROM fb JOIN po USING (doc_id) GROUP BY 1, 2",
    "rb": "SELECT query_id, term, score / sum(score) OVER (PARTITION BY query_id) AS p FROM (" + _top("rm", 10, "term") + ")",
    "ex": "SELECT query_id, term, sum(weight) AS weight FROM (SELECT query_id, term, 0.6::DOUBLE * weight / sum(weight) OVER (PARTITION BY query_id) AS weight FROM own UNION ALL SELECT query_id, term, (1 - 0.6::DOUBLE) * p FROM rb) GROUP BY 1, 2",
}

# --- evaluation

_METRICS = ("ndcg_cut_10", "map", "recall_100", "recip_rank_cut_10")


def _evaluated(runs: str, qr: str, keys: str, sliced: str = "", trec: bool = False) -> dict[str, str]:
    """pq(keys, query_id, metrics). sliced: those of the keys that the judgments have too."""
    gain = "relevance" if trec else "(pow(2, relevance) - 1)"
    tie = "doc_id DESC" if trec else "doc_id"
    on = ", ".join(x for x in (sliced, "query_id") if x)
    every = f"SELECT DISTINCT {keys}, query_id, n_rel, ideal FROM rk JOIN best USING ({on})" if trec else (f"SELECT * FROM best JOIN (SELECT DISTINCT {keys} FROM {runs}) USING ({sliced})" if sliced else f"SELECT * FROM best CROSS JOIN (SELECT DISTINCT {keys} FROM {runs})")
    return {
        "rk": f"SELECT * FROM (SELECT {keys}, query_id, doc_id, row_number() OVER (PARTITION BY {keys}, query_id ORDER BY round(score, 6) DESC, {tie}) AS r FROM {runs})",
        "hit": f"SELECT {keys}, query_id, r, relevance, row_number() OVER (PARTITION BY {keys}, query_id ORDER BY r) AS seen FROM rk JOIN {qr} USING ({on}, doc_id) WHERE relevance > 0",
        "got": f"SELECT {keys}, query_id, sum(CASE WHEN r <= 10 THEN {gain} / log2(r + 1) END) AS dcg, sum(seen / r) AS ap, count(*) FILTER (WHERE r <= 100) AS rec, min(CASE WHEN r <= 10 THEN r END) AS fr FROM hit GROUP BY ALL",
        "best": f"SELECT {on}, count(*) FILTER (WHERE relevance > 0) AS n_rel, sum(CASE WHEN i <= 10 THEN {gain} / log2(i + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY {on} ORDER BY relevance DESC, doc_id) AS i FROM {qr}) GROUP BY ALL",
        "pq": f"""SELECT {keys}, query_id, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0.0 END AS ndcg_cut_10, CASE WHEN n_rel > 0 THEN coalesce(ap, 0) / n_rel ELSE 0.0 END AS map,
          CASE WHEN n_rel > 0 THEN coalesce(rec, 0) / n_rel ELSE 0.0 END AS recall_100, coalesce(1.0::DOUBLE / fr, 0.0) AS recip_rank_cut_10 FROM ({every}) LEFT JOIN got USING ({keys}, query_id)""",
    }


def _means(keys: str, metrics: tuple[str, ...] = _METRICS, source: str = "pq") -> str:
    return f"SELECT {keys}, count(*) AS n_queries, {', '.join(f'round(avg({m}), 6) AS {m}' for m in metrics)} FROM {source} GROUP BY {keys}"


def _sliced(slices: str, counts: str, runs: str, qr: str, metrics: tuple[str, ...] = _METRICS) -> dict[str, str]:
    """sl(slice, run_name, n_queries, n_docs, metrics) over slices(slice), counts(slice, n_docs), and sliced runs and judgments."""
    rest = ", ".join(f"coalesce({m}, 0.0) AS {m}" for m in metrics)
    return {"sq": qr, "sr": f"SELECT * FROM ({runs}) SEMI JOIN sq USING (slice, query_id)"} | _evaluated("sr", "sq", "slice, run_name", "slice") | {
        "names": "SELECT DISTINCT run_name FROM sr",
        "filled": f"SELECT slice, run_name, query_id, {rest} FROM (SELECT DISTINCT slice, query_id FROM sq) CROSS JOIN names LEFT JOIN pq USING (slice, run_name, query_id)",
        "means": _means("slice, run_name", metrics, "filled"),
        "counts": counts,
        "sl": f"SELECT slice, run_name, coalesce(n_queries, 0) AS n_queries, CAST(coalesce(n_docs, 0) AS BIGINT) AS n_docs, {rest} FROM ({slices}) CROSS JOIN names LEFT JOIN means USING (slice, run_name) LEFT JOIN counts USING (slice)",
    }


_MONTHS = {"mon": "SELECT unnest(['march_only', 'march_april', 'march_april', 'march_april_may', 'march_april_may', 'march_april_may']) AS slice, unnest([3, 3, 4, 3, 4, 5]) AS month", "al": "SELECT slice, doc_id FROM dated JOIN mon USING (month)"}
_MONTHLY = _MONTHS | _sliced("SELECT DISTINCT slice FROM mon", "SELECT slice, count(*) AS n_docs FROM al GROUP BY 1", "SELECT runs.*, slice FROM runs JOIN al USING (doc_id)", "SELECT qr.*, slice FROM qr JOIN al USING (doc_id)")
def _points(start: int, step: int = 7 * 86400) -> dict[str, str]:
    first = start + step - 86400
    return {"pt": f"SELECT {first} + i * {step} AS cutoff_s, CAST(DATE '1970-01-01' + CAST(({first} + i * {step}) // 86400 AS INT) AS VARCHAR) AS slice FROM range(0, {(WINDOW_END - first) // step + 1}) AS g(i)"}


_POINTS = _points(WINDOW_START)
_COUNTS = "SELECT slice, count(*) AS n_docs FROM dated JOIN pt ON published_s <= cutoff_s GROUP BY 1"
_GROWN_RUNS = "SELECT runs.*, slice FROM runs JOIN dated USING (doc_id) JOIN pt ON published_s <= cutoff_s"
_GROWN_QR = "SELECT qr.*, slice FROM qr JOIN dated USING (doc_id) JOIN pt ON published_s <= cutoff_s"
_FIXED_QR = f"SELECT qr.* FROM qr SEMI JOIN (SELECT doc_id FROM dated WHERE published_s <= {WINDOW_END}) USING (doc_id)"


def _inner(parts: dict[str, str], last: str) -> str:
    """Parts as one subquery, so that their names don't meet those of others."""
    return "(WITH " + ", ".join(f"{n} AS ({q})" for n, q in parts.items()) + f" SELECT * FROM {last})"


_SCEN = {
    "grown": _inner(_sliced("SELECT slice FROM pt", _COUNTS, _GROWN_RUNS, f"SELECT f.*, slice FROM ({_FIXED_QR}) AS f CROSS JOIN pt"), "sl")[1:-1],
    "still": _inner(_sliced("SELECT 'none' AS slice", "SELECT 'none' AS slice, 0 AS n_docs", f"SELECT runs.*, 'none' AS slice FROM runs SEMI JOIN (SELECT doc_id FROM dated WHERE published_s <= {BASELINE}) USING (doc_id)", f"SELECT f.*, 'none' AS slice FROM ({_FIXED_QR}) AS f"), "sl")[1:-1],
}
_SNAP = _evaluated("snap_runs", "qr", "run_name, snapshot_id")
_SNAP_MEANS = {"ms": "SELECT run_name AS method, snapshot_id, n_queries, ndcg_cut_10, map FROM (" + _means("run_name, snapshot_id", ("ndcg_cut_10", "map")) + ")"}

# --- cues

_LOW = "lower(coalesce(text, ''))"
_CUES = f"list_distinct(regexp_extract_all({_LOW}, '[a-z0-9][a-z0-9-]*'))"


def _hits(words: list[str], tokens: str = "t") -> str:
    return f"len(list_intersect({tokens}, [{', '.join(repr(w) for w in words)}]))"


_TIME = f"({_hits(cues.TEMPORAL)} > 0 OR {' OR '.join(f'contains(low, {p!r})' for p in cues.TEMPORAL_PHRASES)} OR regexp_matches(low, '\\b20(2[4-9]|3[0-9])\\b') OR regexp_matches(low, '\\b\\d{{4}}-\\d{{1,2}}(-\\d{{1,2}})?\\b'))"
_CITED = f"({_hits(cues.CITATION)} > 0 OR {' OR '.join(f'contains(low, {p!r})' for p in cues.CITATION_PHRASES)})"


def _cue_tables(topics: str) -> dict[str, str]:
    return {
        "tq": f"SELECT query_id, text, {_LOW} AS low, {_CUES} AS t FROM {topics}",
        "cu": f"SELECT *, {_TIME} AS time_cue, {_CITED} AS citation_cue, {_hits(cues.TEMPORAL)} AS nt, {_hits(cues.CITATION)} AS nc, {_hits(cues.MIXED)} AS nm FROM tq",
        "ro": "SELECT *, CASE WHEN nm > 0 OR (nt + CASE WHEN time_cue THEN 1 ELSE 0 END > 0 AND nc + CASE WHEN citation_cue THEN 2 ELSE 0 END > 0) THEN 'mixed' WHEN nc + CASE WHEN citation_cue THEN 2 ELSE 0 END > 0 THEN 'citation' ELSE 'temporal' END AS text_route FROM cu",
        "ra": f"""SELECT *, 0.2::DOUBLE + {_hits(cues.FOUNDATIONAL)} AS s0,
          0.2::DOUBLE + {_hits(cues.CURRENT)} + CASE WHEN regexp_matches(low, '202[3-6]') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(low, 'state of the art') THEN 1.5 ELSE 0.0 END AS s1,
          0.2::DOUBLE + {_hits(cues.EVOLVING)} + CASE WHEN contains(low, 'how has') OR contains(low, 'change') THEN 1.0 ELSE 0.0 END AS s2,
          0.2::DOUBLE + {_hits(cues.SURVEY)} + CASE WHEN contains(low, '?') THEN 0.1::DOUBLE ELSE 0.0 END + CASE WHEN {_hits(['survey', 'overview', 'review'])} > 0 THEN 1.2::DOUBLE ELSE 0.0 END AS s3 FROM ro""",
        "it": "SELECT *, greatest(s0, s1, s2, s3) AS s, CASE WHEN s0 >= greatest(s0, s1, s2, s3) THEN 'foundational' WHEN s1 >= greatest(s0, s1, s2, s3) THEN 'current' WHEN s2 >= greatest(s0, s1, s2, s3) THEN 'evolving' ELSE 'survey' END AS intent FROM ra",
    }


_SOFT = "(exp(s0 - s) + exp(s1 - s) + exp(s2 - s) + exp(s3 - s))"
_NOVEL = f"CASE WHEN len(d) > 0 THEN least(1.0, 0.2::DOUBLE * len(list_filter(list_intersect([{', '.join(repr(w) for w in dict.fromkeys(cues.NOVELTY))}], d), lambda x: NOT list_contains(q, x))) + 0.1::DOUBLE * len(list_filter(d, lambda x: NOT list_contains(q, x))) / greatest(len(d), 1)) ELSE 0.0 END"


def _age(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(({AT} - {x}) / 86400.0::DOUBLE, 0.0) END"


_DOCS = {
    "od": f"""SELECT c.doc_id, ta.text, c.published_s, c.updated_s, CAST(year(DATE '1970-01-01' + CAST(coalesce(c.published_s, c.updated_s) // 86400 AS INT)) AS INT) AS year, greatest(coalesce(total_in, 0), coalesce(nonself_in, 0)) AS total_in,
      {_age('c.published_s')} AS age, {_age('coalesce(c.updated_s, c.published_s)')} AS update_age,
      ln(1 + greatest(coalesce(nonself_in, 0), coalesce(total_in, 0))) AS sig_total, ln(1 + greatest(coalesce(nonself_recent_in, 0), coalesce(recent_in, 0))) AS sig_recent, coalesce(foundational, 0.0) AS sig_foundation, coalesce(emerging, 0.0) AS sig_emerging, ln(1 + coalesce(total_out, 0)) AS sig_outbound
      FROM corpus AS c JOIN ta USING (doc_id) LEFT JOIN counters USING (doc_id)""",
}
_PROFILE = _bm25("ta", 1000) | _cue_tables("topics") | _DOCS | {
    "tp": "SELECT query_id, year, total_in, max(year) OVER (PARTITION BY query_id) AS last_year FROM bm LEFT JOIN od USING (doc_id) WHERE rank <= 20",
    "fa": "SELECT query_id, max(year) - min(year) AS span, coalesce(count(*) FILTER (WHERE year <= last_year - 5) / nullif(count(year), 0), 0) AS old_share, count(*) FILTER (WHERE total_in >= 10) / count(*) AS cited_share FROM tp GROUP BY 1",
    "en": "SELECT query_id, CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0.0 END AS entropy FROM (SELECT query_id, n / sum(n) OVER (PARTITION BY query_id) AS p FROM (SELECT query_id, year, count(*) AS n FROM tp WHERE year IS NOT NULL GROUP BY 1, 2)) GROUP BY 1",
    "ab": """SELECT *, CASE WHEN time_cue THEN 0.25 WHEN entropy <= 0.55 THEN 0.15 ELSE 0.03 END::DOUBLE AS alpha, CASE WHEN citation_cue THEN 0.25 WHEN cited_share >= 0.3 OR (span >= 5 AND old_share >= 0.5) THEN 0.12 ELSE 0.03 END::DOUBLE AS beta
      FROM it LEFT JOIN fa USING (query_id) LEFT JOIN en USING (query_id)""",
    "pr": "SELECT *, CASE WHEN alpha >= 0.15::DOUBLE AND beta >= 0.12::DOUBLE THEN 'mixed' WHEN alpha >= 0.15::DOUBLE THEN 'temporal' WHEN beta >= 0.12::DOUBLE THEN 'citation' ELSE text_route END AS route FROM ab",
}


def _w(name: str) -> str:
    base, per = WEIGHTS[name]
    return "CASE intent " + " ".join(f"WHEN '{i}' THEN {base * f!r}::DOUBLE" for i, f in zip(cues.INTENTS, per)) + " END"


def _mm(x: str, flat: str) -> str:
    over = "OVER (PARTITION BY query_id)"
    return f"CASE WHEN max({x}) {over} > min({x}) {over} THEN ({x} - min({x}) {over}) / (max({x}) {over} - min({x}) {over}) WHEN {x} IS NOT NULL THEN {flat} END"


def _overlay(mode: str) -> str:
    sig = ("total", "recent", "foundation", "emerging", "outbound")
    comps = ", ".join(f"{_mm(f'sig_{c}', f'CASE WHEN sig_{c} > 0 THEN 1.0 ELSE 0.0 END')} AS c_{c}" for c in sig)
    time = f"{_w('recency')} * coalesce(exp(-age / 90), 0) + {_w('update')} * coalesce(exp(-update_age / 90), 0) + {_w('foundation')} * coalesce(1 - exp(-age / 365), 0) + {_w('novelty')} * coalesce(novelty, 0)"
    cited = " + ".join(f"{_w(f'c_{c}')} * coalesce(c_{c}, 0)" for c in sig)
    gate = "rel >= 0.05"
    t, c = (time, cited) if mode == "direct" else (f"CASE WHEN {gate} THEN alpha * ({time}) ELSE 0 END", f"CASE WHEN {gate} THEN beta * ({cited}) ELSE 0 END")
    final = {"citation_only": f"rel + {c}", "router": f"rel + CASE WHEN route IN ('temporal', 'mixed') THEN {t} ELSE 0 END + CASE WHEN route IN ('citation', 'mixed') THEN {c} ELSE 0 END"}.get(mode, f"rel + {t} + {c}")
    parts = _PROFILE | {
        "he": f"SELECT *, {_mm('score', '1.0')} AS rel, {comps} FROM (SELECT bm.query_id, bm.doc_id, bm.score, bm.rank, alpha, beta, route, intent, age, update_age, {', '.join(f'sig_{c}' for c in sig)}, t AS q, list_distinct(regexp_extract_all(lower(od.text), '[a-z0-9][a-z0-9-]*')) AS d FROM bm JOIN pr USING (query_id) JOIN od USING (doc_id) WHERE rank <= 200)",
        "hn": f"SELECT *, {_NOVEL} AS novelty FROM he",
        "fi": f"SELECT query_id, doc_id, {final} AS score, 0 AS part, rank AS pos FROM hn UNION ALL SELECT query_id, doc_id, score, 1, rank FROM bm WHERE rank > 200",
        "ov": "SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY part, CASE WHEN part = 0 THEN round(score, 8) ELSE 0 END DESC, pos, doc_id) AS INT) AS rank FROM fi",
    }
    return _with(parts, _RUN + "ov WHERE rank <= 1000")


# --- citations and drift

_EDGES = {
    "raw": "SELECT CAST(event_id AS VARCHAR) AS id, CAST(event_id % 1000 AS VARCHAR) AS citing, CAST((user_id * 31 + event_id) % 100 AS VARCHAR) AS cited, CAST(ts AS DATE) + CAST(event_id % 500 AS INT) AS day, event_id % 20 = 0 AS partial, event_id % 6 * 365.0::DOUBLE + event_id % 12 * 30 AS days, event_type IN ('view', 'click') AS is_self FROM events",
    "ed": f"SELECT *, epoch(day) >= {CUT} - 180 * 86400 AS recent FROM raw WHERE NOT partial AND epoch(day) <= {CUT}",
    "ci": """SELECT coalesce(i.cited, o.citing) AS doc_id, coalesce(total_in, 0) AS total_in, coalesce(recent_in, 0) AS recent_in, coalesce(nonself_in, 0) AS nonself_in, coalesce(nonself_recent_in, 0) AS nonself_recent_in, coalesce(total_out, 0) AS total_out, coalesce(recent_out, 0) AS recent_out, mean_lag
      FROM (SELECT cited, count(*) AS total_in, count(*) FILTER (WHERE recent) AS recent_in, count(*) FILTER (WHERE NOT is_self) AS nonself_in, count(*) FILTER (WHERE NOT is_self AND recent) AS nonself_recent_in, avg(days) AS mean_lag FROM ed GROUP BY 1) AS i
      FULL JOIN (SELECT citing, count(*) AS total_out, count(*) FILTER (WHERE recent) AS recent_out FROM ed GROUP BY 1) AS o ON i.cited = o.citing""",
}
_DAYS = "DATE '1970-01-01' + CAST(published_s // 86400 AS INT)"
_WEEKLY = {
    "dd": f"SELECT published_s, CAST(date_trunc('week', {_DAYS}) AS DATE) AS week FROM dated WHERE published_s IS NOT NULL",
    "ww": "SELECT week, count(*) AS new_docs, epoch(week + 6) AS cut FROM dd GROUP BY 1",
    "wk": f"""SELECT CAST(week AS VARCHAR) AS week_start, any_value(new_docs) AS new_docs, CAST(sum(any_value(new_docs)) OVER (ORDER BY week) AS BIGINT) AS cumulative_docs, count(d.published_s) AS total_docs, count(d.published_s) FILTER (WHERE d.published_s <= cut - 91 * 86400) AS stale_docs,
      CASE WHEN count(d.published_s) > 0 THEN round(count(d.published_s) FILTER (WHERE d.published_s <= cut - 91 * 86400) / count(d.published_s), 4) END AS staleness_rate,
      CASE WHEN count(d.published_s) > 0 THEN CAST(floor(({WINDOW_END} - sum(d.published_s) / count(d.published_s)) / 86400) AS BIGINT) END AS gap_days
      FROM ww LEFT JOIN (SELECT published_s FROM dd) AS d ON d.published_s <= cut GROUP BY week""",
}
_DECIDED = _WEEKLY | {
    "wn": "SELECT *, row_number() OVER (ORDER BY week_start) AS n FROM wk WHERE total_docs > 0",
    "ba": "SELECT greatest(max(cumulative_docs) FILTER (WHERE n = 1), 1) AS indexed, max(gap_days) FILTER (WHERE n = 1) AS base_gap, avg(new_docs / 7) FILTER (WHERE n <= 4) AS base_velocity FROM wn",
    "me": "SELECT *, greatest(cumulative_docs - indexed, 0) / indexed AS coverage_gap, new_docs / 7 AS velocity, gap_days - base_gap AS gap_growth FROM wn CROSS JOIN ba",
    "fl": "SELECT *, staleness_rate > 0.8 AND coverage_gap > 0.03 AS soft, gap_growth > 20 AS gap, base_velocity > 0 AND velocity > 1.5 * base_velocity AS fast FROM me",
    "de": """SELECT week_start, staleness_rate, round(coverage_gap, 6) AS coverage_gap, round(velocity, 6) AS velocity, gap_growth, false AS sustained_drop, CASE WHEN gap OR fast THEN 2 WHEN soft THEN 1 ELSE 0 END AS level,
      CASE WHEN gap OR fast THEN 'incremental_reindex' WHEN soft THEN 'soft_alert' ELSE 'none' END AS action,
      CASE WHEN NOT (gap OR fast OR soft) THEN 'within_thresholds' ELSE concat_ws('; ', CASE WHEN soft THEN 'stale_and_uncovered' END, CASE WHEN gap THEN 'gap_growth' END, CASE WHEN fast THEN 'velocity' END) END AS reason FROM fl""",
}
_VERSIONS = _DECIDED | {
    "kp": "SELECT CAST(CAST(week_start AS DATE) + 6 AS VARCHAR) AS cutoff, action, reason FROM de WHERE level >= 2",
    "kl": "SELECT *, sum(CASE WHEN cutoff > '2025-11-30' THEN 1 ELSE 0 END) OVER (ORDER BY cutoff) AS n_late FROM kp WHERE cutoff > '2025-03-31'",
    "ve": "SELECT cutoff, action, reason, CAST(row_number() OVER (ORDER BY cutoff) - 1 AS INT) AS index_no, lag(cutoff) OVER (ORDER BY cutoff) AS previous_cutoff FROM (SELECT '2025-03-31' AS cutoff, 'baseline' AS action, 'baseline' AS reason UNION ALL SELECT cutoff, action, reason FROM kl WHERE cutoff <= '2025-11-30' OR n_late <= 1)",
}

# --- fusion

_L, _D, _F = "'bm25_title_abstract'", "'dense_title_abstract'", "'bm25_full_text'"
_LISTED = f"SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((CASE run_name WHEN {_L} THEN 0 ELSE 1 END, rank)) AS seen FROM ranked WHERE run_name IN ({_L}, {_D}) GROUP BY 1, 2"


def _rrf(*names: str) -> str:
    return _with({"fu": f"SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ranked WHERE run_name IN ({', '.join(names)}) GROUP BY 1, 2", "tt": _top("fu", 1000)}, "SELECT query_id, doc_id, round(score, 8) AS score, rank FROM tt")


def _words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '{_WS}'), lambda x: x <> '')"


_OVER = "CAST(coalesce(list_sum(list_transform(list_distinct(q), lambda w: least(len(list_filter(q, lambda x: x = w)), len(list_filter(d, lambda y: y = w))))), 0) AS DOUBLE)"


def _reranked(cands: str, k: int, extra: str = "") -> dict[str, str]:
    return {
        "ca": cands,
        "pa": f"SELECT {extra} ca.query_id, ca.doc_id, ca.cand_rank, {_words('topics.text')} AS q, {_words('ta.text')} AS d FROM ca JOIN topics USING (query_id) JOIN ta USING (doc_id)",
        "os": f"SELECT * EXCLUDE (q, d), {_OVER} AS score FROM pa",
        "rr": _top("os", k, "cand_rank, doc_id", "candidate_k, query_id" if extra else "query_id"),
    }


def _hashed(source: str, key: str) -> str:
    return f"""SELECT {key}, bucket, w / greatest(sqrt(sum(w * w) OVER (PARTITION BY {key})), 1e-12) AS weight FROM (
      SELECT {key}, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 256 AS bucket, sum(CASE WHEN CAST('0x' || substr(md5(t), 9, 2) AS BIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END) AS w FROM (SELECT {key}, unnest({_words('text')}) AS t FROM {source}) GROUP BY 1, 2) WHERE w <> 0"""


_HASH = {"hd": _hashed("ta", "doc_id"), "hq": _hashed("topics", "query_id"), "hs": "SELECT query_id, doc_id, sum(hd.weight * hq.weight) AS score FROM hd JOIN hq USING (bucket) GROUP BY 1, 2"}
_HYBRID = _bm25("ta", 20) | _HASH | {"hr": _top("hs", 20), "li": "SELECT query_id, doc_id, rank, 0 AS list FROM bm UNION ALL SELECT query_id, doc_id, rank, 1 FROM hr"}

SQL = {
    "text_views": _with({}, f"SELECT doc_id, {_TA} AS title_abstract, {_FT} AS full_text, {_ALL} AS all_text FROM corpus"),
    "bm25_tokens": _with(_tokens("ta"), "SELECT doc_id, CAST(len(tokens) AS BIGINT) AS length, CAST(len(list_distinct(tokens)) AS BIGINT) AS n_terms FROM tok"),
    "bm25_postings": _with(_tokens("ta"), "SELECT doc_id, term, tf, length FROM po"),
    "bm25_doc_stats": _with(_tokens("ta"), "SELECT n_docs, n_tokens, round(mean_length, 6) AS mean_length FROM st"),
    "bm25_df_idf": _with(_tokens("ta"), "SELECT term, df, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs CROSS JOIN st"),
    "bm25_topk_ta": _with(_bm25("ta", 100), _RUN + "bm"),
    "bm25_topk_ft": _with(_bm25("ft", 100), _RUN + "bm"),
    "bm25_stopped_topk": _with({n: q.replace("unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term", f"unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x NOT IN {STOP_WORDS})) AS term").replace("regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS tokens", f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x NOT IN {STOP_WORDS}) AS tokens").replace("tf * 2.5 / (tf + 1.5 *", "tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE *") for n, q in _bm25("ta", 100).items()}, _RUN + "bm"),
    "bm25_stored_index": _with(_bm25("ta", 100), _RUN + "bm"),
    "bm25_frozen_cutoff": _with(_bm25("early", 100), _RUN + "bm"),
    "rm3_terms": _with(_RM3, "SELECT query_id, term, round(weight, 6) AS weight FROM ex"),
    "rm3_topk": _with(_RM3 | _scores("ex", "s2") | {"b2": _top("s2", 100)}, _RUN + "b2"),
    "delta_merge_stats": _with({"both_": f"SELECT doc_id, {_TA} AS text FROM corpus WHERE published_s <= {WINDOW_END}"} | _tokens("both_"), "SELECT term, df, n_docs, n_tokens FROM dfs CROSS JOIN st"),
    "eval_per_query": _with(_evaluated("runs", "qr", "run_name"), f"SELECT run_name, query_id, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM pq"),
    "eval_mean_builtin": _with(_evaluated("runs", "qr", "run_name"), _means("run_name")),
    "eval_mean_trec": _with(_evaluated("runs", "qr", "run_name", trec=True), _means("run_name")),
    "ranked_runs": _with({}, "SELECT run_name, query_id, doc_id, rank FROM ranked"),
    "rrf_two": _rrf(_L, _D),
    "rrf_three": _rrf(_L, _D, _F),
    "rrf_pairwise": _with({"fu": _LISTED, "tt": _top("fu", 100, "seen, doc_id")}, "SELECT query_id, doc_id, round(score, 8) AS score, rank FROM tt"),
    "union_candidates": _with({"fu": _LISTED}, "SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY seen, doc_id) AS INT) AS rank FROM fu) WHERE rank <= 200"),
    "overlap_rerank": _with(_bm25("ta", 20) | _reranked("SELECT query_id, doc_id, rank AS cand_rank FROM bm", 20), _RUN + "rr"),
    "rerank_head_tail": _with(
        _bm25("ta", 50) | _reranked("SELECT query_id, doc_id, rank AS cand_rank FROM bm WHERE rank <= 20", 20) | {"al": "SELECT query_id, doc_id, score, 0 AS part, rank AS pos FROM rr UNION ALL SELECT query_id, doc_id, score, 1, rank FROM bm ANTI JOIN rr USING (query_id, doc_id)"},
        "SELECT query_id, doc_id, round(score, 6) AS score, part, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY part, pos, doc_id) AS INT) AS rank FROM al) WHERE rank <= 50",
    ),
    "rerank_sweep": _with(_bm25("ta", 50) | _reranked("SELECT k AS candidate_k, query_id, doc_id, rank AS cand_rank FROM bm JOIN (SELECT unnest([10, 20, 50]) AS k) ON rank <= k", 10, "ca.candidate_k,"), "SELECT candidate_k, query_id, doc_id, round(score, 6) AS score, rank FROM rr"),
    "hash_embed": _with(_HASH, "SELECT doc_id, bucket, round(weight, 6) AS weight FROM hd"),
    "hash_dense_topk": _with(_HASH | {"tt": _top("hs", 20)}, _RUN + "tt"),
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings",
    "vector_topk": _with(
        {"vv": "SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings", "cs": "SELECT a.id AS query_id, b.id AS doc_id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS score FROM vv AS a JOIN vv AS b ON a.id <> b.id WHERE a.id % 20 = 0", "tt": _top("cs", 10)}, _RUN + "tt"
    ),
    "hybrid_rrf_rerank": _with(_HYBRID | {"fu": "SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((list, rank)) AS seen FROM li GROUP BY 1, 2", "po_": _top("fu", 40, "seen, doc_id")} | _reranked("SELECT query_id, doc_id, rank AS cand_rank FROM po_", 20), _RUN + "rr"),
    "hybrid_union_rerank": _with(_HYBRID | _reranked("SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min((list, rank)), doc_id) AS cand_rank FROM li GROUP BY 1, 2) WHERE cand_rank <= 40", 20), _RUN + "rr"),
    "evaluation_times": _with({"la": "SELECT max(greatest(published_s, coalesce(updated_s, published_s))) AS a, max(updated_s) AS u FROM corpus", "ns": "SELECT DISTINCT snapshot_id FROM document_snapshots WHERE snapshot_id IS NOT NULL UNION ALL SELECT NULL"}, "SELECT snapshot_id, coalesce(CAST(epoch(CASE snapshot_id WHEN 'snapshot-1' THEN TIMESTAMP '2025-05-31 23:59:59' WHEN 'snapshot-2' THEN TIMESTAMP '2025-08-31 23:59:59' WHEN 'snapshot-3' THEN TIMESTAMP '2025-11-30 23:59:59' END) AS BIGINT), greatest(a, u)) AS at_s FROM ns CROSS JOIN la"),
    "doc_ages": _with({"a": f"SELECT doc_id, {_age('published_s')} AS a, {_age('coalesce(updated_s, published_s)')} AS u FROM corpus"}, "SELECT doc_id, round(a, 6) AS age_days, round(u, 6) AS update_age_days, round(coalesce(exp(-a / 90), 0), 6) AS recency, round(coalesce(exp(-u / 90), 0), 6) AS update_score, round(coalesce(1 - exp(-a / 365), 0), 6) AS foundation FROM a"),
    "lexical_novelty": _with(_bm25("ta", 10) | {"x": "SELECT query_id, doc_id, list_distinct(regexp_extract_all(lower(topics.text), '[a-z0-9][a-z0-9-]*')) AS q, list_distinct(regexp_extract_all(lower(ta.text), '[a-z0-9][a-z0-9-]*')) AS d FROM bm JOIN topics USING (query_id) JOIN ta USING (doc_id)"}, f"SELECT query_id, doc_id, round({_NOVEL}, 6) AS novelty FROM x"),
    "intent_labels": _with(_cue_tables("every_topic"), f"SELECT query_id, intent, {', '.join(f'round(exp(s{i} - s) / {_SOFT}, 6) AS p_{n}' for i, n in enumerate(cues.INTENTS))} FROM it"),
    "evidence_route": _with(_cue_tables("every_topic"), "SELECT query_id, time_cue, citation_cue, text_route AS route FROM ro"),
    "query_profile": _with(_PROFILE, "SELECT query_id, round(entropy, 6) AS entropy, round(old_share, 6) AS old_share, round(cited_share, 6) AS cited_share, CAST(span AS INT) AS span, alpha, beta, route FROM pr"),
    "iso_duration": _with(_EDGES, "SELECT id, days FROM raw"),
    "citation_degrees": _with(_EDGES, "SELECT * EXCLUDE (mean_lag), round(mean_lag, 6) AS mean_lag FROM ci"),
    "citation_features": _with(_EDGES | {"cr": "SELECT *, recent_in / greatest(total_in, 1) AS ratio FROM ci"}, "SELECT doc_id, round(ratio, 6) AS recent_ratio, round(recent_in / 180, 6) AS velocity, round(ln(1 + greatest(nonself_in, total_in)) * (1 - ratio), 6) AS foundational, round(ln(1 + recent_in) * ratio, 6) AS emerging FROM cr"),
    **{f"overlay_{m}": _overlay(m) for m in ("direct", "citation_only", "router", "additive")},
    "month_split_eval": _with(_MONTHLY, "SELECT * FROM sl"),
    "cumulative_eval": _with(_POINTS | _sliced("SELECT slice FROM pt", _COUNTS, _GROWN_RUNS, _GROWN_QR), "SELECT * FROM sl"),
    "frozen_index_eval": _with(
        _points(AFTER) | _sliced("SELECT slice FROM pt", _COUNTS, f"SELECT runs.*, slice FROM runs SEMI JOIN (SELECT doc_id FROM dated WHERE published_s <= {FROZEN}) USING (doc_id) CROSS JOIN pt", _GROWN_QR) | {"fz": f"SELECT count(*) AS n_frozen FROM dated WHERE published_s <= {FROZEN}"},
        "SELECT *, greatest(n_docs - n_frozen, 0) AS n_new FROM sl CROSS JOIN fz",
    ),
    "reindex_scenarios": _with(
        _POINTS | _SCEN,
        "SELECT g.slice, run_name, " + ", ".join(f"round(s.{m}, 4) AS none_{m}" for m in ("ndcg_cut_10", "recall_100")) + ", " + ", ".join(f"round(g.{m}, 4) AS {k}_{m}" for k in ("append", "global") for m in ("ndcg_cut_10", "recall_100")) + " FROM grown AS g JOIN still AS s USING (run_name)",
    ),
    "snapshot_deltas": _with(
        _SNAP | _SNAP_MEANS | {"lo": "SELECT method, snapshot_id, 'ndcg_cut_10' AS metric, ndcg_cut_10 AS value FROM ms UNION ALL SELECT method, snapshot_id, 'map', map FROM ms", "pp": "SELECT unnest(['snapshot-2', 'snapshot-3', 'snapshot-3']) AS newer, unnest(['snapshot-1', 'snapshot-2', 'snapshot-1']) AS older"},
        "SELECT n.method, newer, older, metric, o.value AS old_value, n.value AS new_value, round(n.value - o.value, 6) AS delta, CASE WHEN o.value <> 0 THEN round((n.value - o.value) / o.value, 6) END AS pct FROM pp JOIN lo AS n ON n.snapshot_id = newer JOIN lo AS o USING (method, metric) WHERE o.snapshot_id = older",
    ),
    "method_snapshot_pivot": _with(_SNAP | _SNAP_MEANS, "SELECT method, " + ", ".join(f"max({m}) FILTER (WHERE snapshot_id = 'snapshot-{i}') AS s{i}_{m}" for i in (1, 2, 3, 4) for m in ("ndcg_cut_10", "map")) + " FROM ms GROUP BY 1"),
    "method_cube": _with(_SNAP | _SNAP_MEANS, "SELECT method, snapshot_id, round(avg(ndcg_cut_10), 6) AS mean_ndcg_cut_10, count(*) AS n_rows FROM ms GROUP BY CUBE (method, snapshot_id)"),
    "model_comparison": _with(_evaluated("runs", "qr", "run_name") | {"mm": _means("run_name")}, "SELECT run_name AS method, * EXCLUDE (run_name), 'all' AS qrels_variant, CAST(row_number() OVER (ORDER BY ndcg_cut_10 DESC, run_name) AS INT) AS place FROM mm"),
    "temporal_change": _with(
        _MONTHLY | {
            "stp": "SELECT unnest(['march_only', 'march_april', 'march_only']) AS es, unnest(['march_april', 'march_april_may', 'march_april_may']) AS ls",
            "bt": "SELECT es || '->' || ls AS transition, e.run_name AS model, e.ndcg_cut_10 AS e, l.ndcg_cut_10 AS l, CASE WHEN abs(e.ndcg_cut_10) < 1e-12 THEN 0.0 ELSE (e.ndcg_cut_10 - l.ndcg_cut_10) / e.ndcg_cut_10 END AS ri FROM stp JOIN sl AS e ON e.slice = es JOIN sl AS l ON l.slice = ls AND l.run_name = e.run_name",
        },
        f"SELECT transition, bt.model, round(e, 6) AS earlier_score, round(l, 6) AS later_score, round(l, 6) AS arp, round((e + l) / 2, 6) AS marp, round(ri, 6) AS ri, round(ri - b.base, 6) AS dri, round(ri / CASE WHEN abs(b.base) >= 1e-9 THEN b.base WHEN b.base < 0 THEN -1e-9 ELSE 1e-9 END, 6) AS er FROM bt JOIN (SELECT transition, ri AS base FROM bt WHERE model = {_L}) AS b USING (transition)",
    ),
    "rank_stability": _with(
        {
            "sn": f"SELECT snapshot_id, CAST(row_number() OVER (ORDER BY snapshot_id) AS INT) AS snapshot_no FROM (SELECT DISTINCT snapshot_id FROM document_snapshots)",
            "tr": "SELECT * FROM (SELECT run_name, snapshot_no, query_id, doc_id, row_number() OVER (PARTITION BY run_name, snapshot_no, query_id ORDER BY score DESC, doc_id) AS r FROM snap_runs JOIN sn USING (snapshot_id)) WHERE r <= 10",
            "bf": "SELECT run_name, snapshot_no + 1 AS snapshot_no, query_id, doc_id FROM tr",
            "aq": "SELECT DISTINCT run_name, snapshot_no, query_id FROM tr SEMI JOIN bf USING (run_name, snapshot_no, query_id)",
            "kk": "SELECT run_name, snapshot_no, query_id, count(*) AS k FROM tr JOIN bf USING (run_name, snapshot_no, query_id, doc_id) GROUP BY 1, 2, 3",
        },
        "SELECT run_name, snapshot_no, round(avg(1 - coalesce(k, 0) / 10), 6) AS rank_stability_drop, count(*) AS n_queries FROM aq LEFT JOIN kk USING (run_name, snapshot_no, query_id) GROUP BY 1, 2",
    ),
    "daily_counts_velocity": _with({"dy": f"SELECT {_DAYS} AS d, count(*) AS new_docs FROM dated WHERE published_s IS NOT NULL GROUP BY 1"}, "SELECT CAST(d AS VARCHAR) AS day, new_docs, CAST(sum(new_docs) OVER (ORDER BY d) AS BIGINT) AS cumulative_docs, round(avg(new_docs) OVER (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 1) AS velocity FROM dy"),
    "weekly_drift": _with(_WEEKLY, "SELECT * FROM wk"),
    "collection_summary": _with(
        _WEEKLY,
        f"SELECT count(*) AS n_docs, count(*) FILTER (WHERE published_s IS NULL) AS n_undated, CAST(min({_DAYS}) AS VARCHAR) AS first_day, CAST(max({_DAYS}) AS VARCHAR) AS last_day, CAST(DATE '1970-01-01' + CAST(floor(avg(published_s) / 86400) AS INT) AS VARCHAR) AS mean_day, CAST(max({_DAYS}) - min({_DAYS}) AS INT) AS span_days, (SELECT arg_max(staleness_rate, week_start) FROM wk) AS final_staleness FROM dated",
    ),
    "trigger_decisions": _with(_DECIDED, "SELECT * FROM de"),
    "latest_actionable": _with(_DECIDED, "SELECT * FROM de WHERE level > 0 ORDER BY week_start DESC LIMIT 1"),
    "index_versions": _with(_VERSIONS, "SELECT * FROM ve"),
    "index_membership": _with(
        _VERSIONS | {"iv": "SELECT index_no, epoch(CAST(cutoff AS DATE) + 1) - 1 AS hi, coalesce(epoch(CAST(previous_cutoff AS DATE) + 1) - 1, -1e15) AS lo FROM ve"},
        f"SELECT doc_id, CAST({_DAYS} AS VARCHAR) AS published_day, index_no, {_DAYS} <= DATE '2025-03-31' AS in_baseline, greatest(CAST({_DAYS} - DATE '2025-03-31' AS INT), 0) AS days_after FROM dated JOIN iv ON published_s > lo AND published_s <= hi WHERE published_s <= {AT}",
    ),
    "streaming_weekly_counts": "SELECT date_trunc('week', ts) AS week_start, count(*) AS n_events FROM events GROUP BY 1",
}
