"""Date texts to UTC seconds, and calendar arithmetic that doesn't depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.text import strip

DAY = 86_400


def parse_seconds(c: Column, mode: str = "lenient") -> Column:
    """Seconds since 1970 UTC, null where the text is no date.

    `iso`: full dates with or without a time and offset, and yyyymmdd; `edge`: the same without yyyymmdd; `lenient`: year-month and year too.
    """
    s = strip(c)
    full = s.rlike(r"^\d{4}-\d{2}-\d{2}([T ].+)?$")
    zoned = s.rlike(r"[T ].*([Zz]|[+-]\d{2}:?\d{2})$")
    text = F.when(full, F.when(F.length(s) == 10, F.concat(s, F.lit("T00:00:00Z"))).when(zoned, s).otherwise(F.concat(s, F.lit("Z"))))
    if mode != "edge":
        text = F.when(s.rlike(r"^\d{8}$"), F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2), F.lit("-"), F.substring(s, 7, 2), F.lit("T00:00:00Z"))).otherwise(text)
    if mode == "lenient":
        text = F.when(s.rlike(r"^\d{4}-\d{2}$"), F.concat(s, F.lit("-01T00:00:00Z"))).when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01T00:00:00Z"))).otherwise(text)
    elif mode not in ("iso", "edge"):
        raise ValueError(f"unknown date mode: {mode}")
    return F.unix_seconds(text.try_cast("timestamp"))


def day_number(seconds: Column) -> Column:
    """Days since 1970-01-01 UTC."""
    return F.floor(seconds / DAY).cast("int")


def week_start(day: Column) -> Column:
    """Day number of the Monday of the week."""
    return (day - F.pmod(day + 3, F.lit(7))).cast("int")


def day_text(day: Column) -> Column:
    return F.date_from_unix_date(day).cast("string")


def age_days(at: int | Column, seconds: Column) -> Column:
    """Days from a date to `at`, never negative; null without a date."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(seconds.isNotNull(), F.greatest((at - seconds) / float(DAY), F.lit(0.0)))


def iso_duration_days(c: Column) -> Column:
    """PnYnMnD in days of 365, 30 and 1; a bare P is 0, anything else null."""
    s = strip(c)
    part = lambda u: F.coalesce(F.nullif(F.regexp_extract(s, rf"(\d+){u}", 1), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(s.rlike(r"^P(\d+Y)?(\d+M)?(\d+D)?$"), part("Y") * 365 + part("M") * 30 + part("D"))
