"""Mixed timestamp texts to one UTC instant.

Every text is parsed under each format it fits (all of it in the JVM); a value can fit several: a slashed or dotted date
with month or day first, eight digits with the year first or last, bare digits of seconds or milliseconds, a wall clock
that occurs twice. A mixture over formats is fitted per source by expectation-maximisation: a value adds likelihood to
every format under which it is a valid instant, the format weights of its source give posteriors, and the posteriors choose.
A value whose best posterior stays under `certain` keeps a null instant and is marked ambiguous. The fit runs on counts per
source and set of valid formats, a table of a few rows per source, inside one task per source; the data are read once
and joined with the posteriors.

Documented rules enter as prior odds (`RULES`): a reading that breaks one has its likelihood divided by a large number. A value that
only a rule-breaking reading fits also has the reading `none` (noise, no instant), whose odds lie between, so that
it takes an impossible date for no instant before it takes it for another format. Without rules (odds={}) all readings start
alike and only the source's own mixture chooses.
"""

from __future__ import annotations

import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import strip
from tidewater.session import bounded, written

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,18}))?)?(?: ?([ap])\.?m\.?)?"
_ZONE = r"(?: ?(z|[a-z]{3,4}|[+-]\d{2}(?::?\d{2})?))?(?: ?\[([a-z0-9_+\-/]{1,60})\])?"
_WEEKDAY = r"(?:(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)(?:[a-z]{3,6})?,? )?"

#: Shape: (pattern, places of its three date fields). Groups 1-3 are the date, 4-8 time and half of day, 9-10 zone.
SHAPES = {
    "iso": rf"^(\d{{4}})([-/.])(\d{{2}})\2(\d{{2}})(?:[t ]{_TIME}{_ZONE})?$",
    "compact": rf"^(\d{{4}})()(\d{{2}})(\d{{2}})(?:t(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,18}}))?)?(){_ZONE})?$",
    "parted": rf"^(\d{{1,2}})([/.])(\d{{1,2}})\2(\d{{4}})(?:,?[t ]{_TIME}{_ZONE})?$",
    "day_month": rf"^{_WEEKDAY}(\d{{1,2}})( |-)([a-z]{{3,9}})\.?,?\2(\d{{4}})(?:,? {_TIME}{_ZONE})?$",
    "month_day": rf"^{_WEEKDAY}([a-z]{{3,9}})(\.?) (\d{{1,2}}),? (\d{{4}})(?:,? {_TIME}{_ZONE})?$",
    "year_month": r"^(\d{4})(-)(\d{2})$",
    "month_year": r"^([a-z]{3,9})(\.?) (\d{4})$",
    "year": r"^(\d{4})$",
    "epoch": r"^(\d{10,18})$",
}
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Fixed offsets of zone words, in minutes.
OFFSETS = {"z": 0, "utc": 0, "gmt": 0, "cet": 60, "cest": 120, "est": -300, "edt": -240}
#: From this size on, bare digits are milliseconds: as seconds they would lie past the year 5138.
EPOCH_MS = 100_000_000_000
#: Prior odds of readings that break a documented rule (slashes put the month first, dots the day, eight digits start with the year, fewer
#: than EPOCH_MS are seconds, of a repeated wall clock the first is meant), and of noise. All other readings have odds of 1.
RULES = {"slash_dmy": 1e-12, "dot_mdy": 1e-12, "compact_dmy": 1e-12, "epoch_ms_short": 1e-12, "repeated_second": 1e-12, "none": 1e-6}

_ZONES = sorted(zoneinfo.available_timezones())
_DAY = 86_400_000_000


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("long")


def _month(c: Column) -> Column:
    names = F.create_map(*(x for i, name in enumerate(_MONTHS, 1) for form in {name, name[:3], *(["sept"] if i == 9 else [])} for x in (F.lit(form), F.lit(i).cast("long"))))
    return F.try_element_at(names, c)


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a civil date, null if there is no such date."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= length)
    return F.when(ok, F.datediff(F.make_date(y.cast("int"), m.cast("int"), d.cast("int")), F.lit("1970-01-01").cast("date")).cast("long"))


def _zone_at(wall: Column, zone: Column) -> Column:
    """UTC microseconds of a wall clock: a repeated time is the first, a skipped one moves on by the gap."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))


#: Shape: (its format, the other format it may mean).
_FORMATS = {"iso": "iso", "compact": "compact_ymd", "day_month": "day_month_name", "month_day": "month_name_day", "year_month": "year_month", "month_year": "month_name_year", "year": "year"}


def with_candidates(values: DataFrame, noise: bool = True) -> DataFrame:
    """Adds cands, array<struct<fmt, utc_us>>: every valid reading of `text`, wall clocks without a zone read in `feed_zone` (null: UTC).

    A zone of the feed is known in any letter case. `noise` adds the reading `none` where the usual reading of a text is impossible but another isn't.
    Bare digits of 19 or more places, and milliseconds past the year 9999, mean no instant.

    The steps are columns of their own, so that each is evaluated once and the plan stays small.
    """
    out = values.withColumns({"_t": F.lower(F.regexp_replace(strip(F.col("text")), r"(?U)\s+", " ")), "_feed": F.nullif(strip(F.col("feed_zone")), F.lit(""))})
    t, feed = F.col("_t"), F.col("_feed")
    shape = F.lit(None).cast("string")
    groups = F.lit(None).cast("array<string>")
    for name, pattern in reversed(SHAPES.items()):
        n = {"iso": 11, "compact": 11, "parted": 11, "day_month": 11, "month_day": 11, "year_month": 3, "month_year": 3}.get(name, 1)
        shape = F.when(t.rlike(pattern), name).otherwise(shape)
        groups = F.when(F.col("_shape") == name, F.array(*(F.regexp_extract(t, pattern, i) for i in range(1, n + 1)))).otherwise(groups)
    out = out.withColumn("_shape", shape).withColumn("_g", groups)
    g = lambda i: F.try_element_at(F.col("_g"), F.lit(i))
    is_ = lambda *x: F.col("_shape").isin(*x)
    slash = g(2) == "/"
    one = F.lit(1).cast("long")
    bare8 = is_("compact") & t.rlike(r"^\d{8}$")
    out = out.withColumns(
        {
            "_y": F.when(is_("iso", "compact", "year_month", "year"), _int(g(1))).when(is_("parted", "day_month", "month_day"), _int(g(4))).when(is_("month_year"), _int(g(3))),
            "_m": F.when(is_("iso", "compact", "year_month"), _int(g(3))).when(is_("parted"), F.when(slash, _int(g(1))).otherwise(_int(g(3)))).when(is_("day_month"), _month(g(3))).when(is_("month_day", "month_year"), _month(g(1))).when(is_("year"), one),
            "_d": F.when(is_("iso", "compact"), _int(g(4))).when(is_("parted"), F.when(slash, _int(g(3))).otherwise(_int(g(1)))).when(is_("day_month"), _int(g(1))).when(is_("month_day"), _int(g(3))).otherwise(one),
            "_h": _int(g(5)),
            "_mi": _int(g(6)),
            "_s": F.coalesce(_int(g(7)), F.lit(0).cast("long")),
            "_frac": F.rpad(F.substring(F.coalesce(g(8), F.lit("")), 1, 6), 6, "0").cast("long"),
            "_zone": F.coalesce(g(10), F.lit("")),
            "_named": F.coalesce(g(11), F.lit("")),
            "_epoch": F.when(is_("epoch"), _int(g(1))),
            "_main": F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in _FORMATS.items() for x in kv)), F.col("_shape")), F.when(is_("parted"), F.when(slash, "slash_mdy").otherwise("dot_dmy"))),
            "_alt": F.when(is_("parted"), F.when(slash, "slash_dmy").otherwise("dot_mdy")).when(bare8, "compact_dmy"),
        }
    )
    half = g(9)
    hour = F.when(F.coalesce(half, F.lit("")) == "", F.col("_h")).when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(half == "p", 12).otherwise(0))
    known = F.create_map(*(x for z in _ZONES for x in (F.lit(z.lower()), F.lit(z))))
    sign = F.when(F.substring("_zone", 1, 1) == "-", -1).otherwise(1)
    offsets = F.create_map(*(x for k, v in OFFSETS.items() for x in (F.lit(k), F.lit(v).cast("long"))))
    out = out.withColumns(
        {
            "_day": _days(F.col("_y"), F.col("_m"), F.col("_d")),
            "_alt_day": F.when(F.col("_alt") == "compact_dmy", _days(F.substring("_t", 5, 4).cast("long"), F.substring("_t", 3, 2).cast("long"), F.substring("_t", 1, 2).cast("long"))).when(F.col("_alt").isNotNull(), _days(F.col("_y"), F.col("_d"), F.col("_m"))),
            "_hour": hour,
            "_hh": F.when(F.col("_zone").rlike("^[+-]"), _int(F.substring("_zone", 2, 2))),
            "_mm": F.when(F.col("_zone").rlike("^[+-]"), F.coalesce(_int(F.regexp_extract("_zone", r"^.\d\d:?(\d\d)$", 1)), F.lit(0).cast("long"))),
            "_iana": F.when(F.col("_zone") == "", F.when(F.col("_named") != "", F.try_element_at(known, F.col("_named"))).when(feed.isin(_ZONES), feed).otherwise(F.try_element_at(known, F.lower(feed)))),
        }
    )
    clock = F.when(F.col("_h").isNull(), F.lit(0).cast("long")).when((F.col("_hour") < 24) & (F.col("_mi") < 60) & (F.col("_s") < 60), ((F.col("_hour") * 60 + F.col("_mi")) * 60 + F.col("_s")) * 1_000_000 + F.col("_frac"))
    minutes = F.when(F.col("_zone").rlike("^[+-]"), F.when((F.col("_hh") <= 18) & (F.col("_mm") < 60), sign * (F.col("_hh") * 60 + F.col("_mm")))).when(F.col("_zone") != "", F.try_element_at(offsets, F.col("_zone")))
    out = out.withColumns({"_clock": clock, "_minutes": F.when((F.col("_zone") == "") & (F.col("_named") == "") & feed.isNull(), F.lit(0).cast("long")).otherwise(minutes)})
    out = out.withColumns({"_wall": F.col("_day") * _DAY + F.col("_clock"), "_alt_wall": F.col("_alt_day") * _DAY + F.col("_clock")})
    utc = lambda wall: F.when(F.col("_minutes").isNotNull(), F.col(wall) - F.col("_minutes") * 60_000_000).when(F.col("_iana").isNotNull(), _zone_at(F.col(wall), F.col("_iana")))
    epoch = F.col("_epoch")
    short = epoch < EPOCH_MS
    top = F.lit(253_402_300_800_000)  # the year 10000
    # a wall clock that a later offset shows again: the offset a day on, if it lies behind, gives the second time
    later = F.col("_wall") - (F.col("_wall") + _DAY - _zone_at(F.col("_wall") + _DAY, F.col("_iana")))
    out = out.withColumns(
        {
            "_main": F.when(short, "epoch_s").when(epoch.isNotNull(), "epoch_ms").otherwise(F.col("_main")),
            "_utc": F.when(short, epoch * 1_000_000).when(epoch < top, epoch * 1000).otherwise(utc("_wall")),
            "_alt": F.when(short, "epoch_ms_short").otherwise(F.col("_alt")),
            "_alt_utc": F.when(short, epoch * 1000).otherwise(utc("_alt_wall")),
            "_again": F.when(F.col("_minutes").isNull() & F.col("_iana").isNotNull() & F.col("_wall").isNotNull(), later),
        }
    )
    shown = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(F.col("_again")), F.col("_iana")))
    out = out.withColumn("_again", F.when(F.col("_again") > F.col("_utc"), F.when(shown == F.col("_wall"), F.col("_again"))))
    reading = lambda f, u: F.when(u.isNotNull(), F.struct(f.alias("fmt"), u.alias("utc_us")))
    cands = [reading(F.col("_main"), F.col("_utc")), reading(F.col("_alt"), F.col("_alt_utc")), reading(F.lit("repeated_second"), F.col("_again"))]
    if noise:
        cands.append(F.when(F.col("_utc").isNull() & F.col("_alt_utc").isNotNull(), F.struct(F.lit("none").alias("fmt"), F.lit(None).cast("long").alias("utc_us"))))
    return out.withColumn("cands", F.array_compact(F.array(*cands))).select(*values.columns, "cands")


def fit(pdf: pd.DataFrame, steps: int, prior: float, odds: dict[str, float]) -> pd.DataFrame:
    """EM for one source: rows (fmts, n) are counts per set of valid formats. Gives each set's best format and posterior.

    A valid reading has its prior odds as likelihood. `prior` is added to each format's count.
    """
    names = sorted({f for fs in pdf["fmts"] for f in fs})
    at = {f: i for i, f in enumerate(names)}
    valid = np.zeros((len(pdf), len(names)))
    for r, fs in enumerate(pdf["fmts"]):
        valid[r, [at[f] for f in fs]] = [odds.get(f, 1.0) for f in fs]
    n = pdf["n"].to_numpy(float)[:, None]
    weight = np.full(len(names), 1 / len(names))
    for _ in range(steps):
        post = valid * weight
        post /= post.sum(axis=1, keepdims=True)
        new = (post * n).sum(axis=0) + prior
        new /= new.sum()
        done = np.abs(new - weight).max() < 1e-12
        weight = new
        if done:
            break
    post = valid * weight
    post /= post.sum(axis=1, keepdims=True)
    best = np.round(post, 9).argmax(axis=1)
    return pd.DataFrame({"src": pdf["src"], "fmts": pdf["fmts"], "n": pdf["n"], "fmt": [names[b] for b in best], "posterior": post[np.arange(len(post)), best]})


_FIT = "src string, fmts array<string>, n long, fmt string, posterior double"


def posteriors(read: DataFrame, odds: dict[str, float], steps: int = 500, prior: float = 0.5) -> DataFrame:
    """read has src and cands; one row per source and set of valid formats."""
    sets = read.where("size(cands) > 0").groupBy("src", F.transform("cands", lambda c: c["fmt"]).alias("fmts")).agg(F.count(F.lit(1)).alias("n"))
    return sets.groupBy("src").applyInPandas(lambda pdf: fit(pdf, steps, prior, odds), _FIT)


def resolve(values: DataFrame, *, odds: dict[str, float] | None = None, certain: float = 0.95) -> DataFrame:
    """values(src, text, feed_zone, ...) plus fmt, posterior, utc_us and ambiguous. odds: prior odds of readings, RULES by default; {} for none.

    Null, blank and unreadable texts, impossible dates and unknown zones give a null utc_us that isn't ambiguous. Rows and other columns stay.
    An empty table gives an empty table. Surrounding white space and letter case don't matter; digits past microseconds are cut off.
    """
    odds = RULES if odds is None else odds
    read = with_candidates(values, "none" in odds)
    # Written before anything filters on it: a pushed-down filter would copy the whole parse into itself.
    read = written(read.withColumn("fmts", F.transform("cands", lambda c: c["fmt"])), "readings")
    post = written(posteriors(read, odds), "posteriors").select("src", "fmts", "fmt", "posterior")
    read = read.join(bounded(post), ["src", "fmts"], "left")
    sure = F.col("posterior") >= certain
    chosen = F.try_element_at(F.transform(F.filter("cands", lambda c: c["fmt"] == F.col("fmt")), lambda c: c["utc_us"]), F.lit(1))
    read = read.withColumn("utc_us", F.when(sure & (F.size("cands") > 0), chosen))
    return read.withColumn("ambiguous", F.coalesce(~sure, F.lit(False))).drop("cands", "fmts")


def timestamp_values(temporal: DataFrame, metadata: DataFrame) -> DataFrame:
    """(src, src_table, row_id, field_name, text, feed_zone) of the three timestamp fields; the source is table, field and zone."""
    fields = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in ("publication_datetime", "update_datetime")))
    a = temporal.select(F.lit("temporal_features").alias("src_table"), F.col("feature_id").alias("row_id"), "feed_zone", F.inline(fields))
    b = metadata.select(F.lit("dataset_metadata").alias("src_table"), F.col("load_id").alias("row_id"), "feed_zone", F.lit("timestamp").alias("field_name"), F.col("timestamp").alias("text"))
    return a.unionByName(b).where("text is not null").withColumn("src", F.concat_ws("|", "src_table", "field_name", F.coalesce("feed_zone", F.lit("-"))))


def instants(temporal: DataFrame, metadata: DataFrame) -> DataFrame:
    """(src_table, row_id, field_name, utc_us), distinct, of every value that means an instant."""
    return resolve(timestamp_values(temporal, metadata)).where("utc_us is not null").select("src_table", "row_id", "field_name", "utc_us").distinct()


def format_mixture(temporal: DataFrame, metadata: DataFrame) -> DataFrame:
    """Per source and chosen format: values, and how many stay ambiguous, when no rule is given but what the data show."""
    got = resolve(timestamp_values(temporal, metadata), odds={})
    return got.where("fmt is not null").groupBy("src_table", "field_name", "feed_zone", "fmt").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("ambiguous").alias("n_ambiguous"))
