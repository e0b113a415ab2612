"""Snapshot differences, orphans and instants against brute force and by hand."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewater.functions.hashing import xxhash64_longs
from tidewater.operators import instants as ins
from tidewater.operators import orphans as orp
from tidewater.operators import snapshot_diff as sd

T0 = datetime(2025, 1, 1)
DOCS = "doc_id string, snapshot_id string, delivered_at timestamp_ntz, abstract string, title string"


def snaps(spark, data):
    return spark.createDataFrame([(d, s, None if h is None else T0 + timedelta(hours=h), a, "t") for d, s, h, a in data], DOCS)


def test_numpy_hash_equals_sparks(spark):
    df = spark.range(-50, 50).select("id", (F.col("id") * 7919 - 3).alias("b"))
    got = df.select("id", "b", F.xxhash64(F.lit(9).cast("long"), "id", "b").alias("h")).toPandas()
    assert (xxhash64_longs(9, got["id"].to_numpy(), got["b"].to_numpy()) == got["h"].to_numpy()).all()


def test_changes_by_hand(spark):
    data = [
        ("A", "snapshot-1", 1, "x  y"), ("A", "snapshot-2", 2, " x y\n"),  # re-spaced only
        ("B", "snapshot-1", 1, None), ("B", "snapshot-2", 2, ""),  # null is empty
        ("C", "snapshot-1", 1, "one"), (" C\t", "snapshot-2", 2, "One"),  # case counts, keys are trimmed
        ("D", "snapshot-1", 1, "gone"), ("E", "snapshot-2", 2, "new"),
        ("F", "snapshot-1", 1, "old"), ("F", "snapshot-1", 5, "same"), ("F", "snapshot-2", 2, "same"), ("F", "snapshot-2", 2, "same"),  # superseded, repeated
        (None, "snapshot-2", 2, "n"), ("  ", "snapshot-2", 2, "b"), ("G", None, 2, "no snapshot"),
    ]
    assert rows(sd.snapshot_changes(snaps(spark, data))) == [("snapshot-2", "C", "changed"), ("snapshot-2", "D", "removed"), ("snapshot-2", "E", "added")]


def test_empty_and_single_snapshot(spark):
    assert rows(sd.snapshot_changes(snaps(spark, []))) == []
    assert rows(sd.snapshot_changes(snaps(spark, [("A", "snapshot-1", 1, "x")]))) == []


def _brute(data):
    last = {}
    for d, s, h, a in data:
        if h >= last.get((s, d), (-1, ""))[0]:
            last[s, d] = (h, a)
    out = []
    for k in (2, 3):
        new, old = ({d: a for (s, d), (_, a) in last.items() if s == f"snapshot-{i}"} for i in (k, k - 1))
        for d in new.keys() | old.keys():
            kind = "added" if d not in old else "removed" if d not in new else "changed" if new[d] != old[d] else None
            if kind:
                out.append((f"snapshot-{k}", d, kind))
    return sorted(out)


@pytest.mark.parametrize("expected, rounds", [(0.1, 4), (0.005, 4), (0.005, 0)])
def test_changes_against_brute_force(spark, expected, rounds):
    """Tables of the right size, tables that must be enlarged, and tables that fail for good: the same result."""
    rng = np.random.default_rng(1)
    data = [(f"D{i}", f"snapshot-{s}", s, f"a{i % 7}{'x' * int(rng.random() < 0.3)}") for s in (1, 2, 3) for i in range(600) if rng.random() < 0.8]
    got = rows(sd.snapshot_changes(snaps(spark, data), bucket_rows=200, expected_change=expected, rounds=rounds))
    assert got == _brute(data)


def test_orphans_by_hand(spark):
    docs = snaps(spark, [("A", "snapshot-1", 1, ""), ("A", "snapshot-3", 1, ""), (" B", "snapshot-2", 1, ""), (None, "snapshot-1", 1, "")])
    sr = spark.createDataFrame([("A ", "snapshot-1"), ("A", "snapshot-2"), ("A", "snapshot-2"), ("B", "snapshot-1"), ("Z", "snapshot-2"), (None, "snapshot-1"), (" ", "snapshot-1"), ("B", None)], "doc_id string, snapshot_id string")
    cf = spark.createDataFrame([("B", "snapshot-3", 4), ("Z", "snapshot-1", 0), ("Z", "snapshot-1", None)], "doc_id string, snapshot_id string, total_inbound_citations long")
    assert rows(orp.orphans(docs, sr, cf)) == [
        ("citation_features", "snapshot-3", "B", "removed"), ("search_results", "snapshot-1", "B", "later"), ("search_results", "snapshot-2", "A", "removed"), ("search_results", "snapshot-2", "Z", "missing"),
    ]
    counts = {(r.ref_table, r.snapshot_id): (r.new_orphans, r.resolved, r.reopened, r.open_refs) for r in orp.orphan_counts(docs, sr, cf).collect()}
    assert counts["search_results", "snapshot-1"] == (1, 0, 0, 1)
    assert counts["search_results", "snapshot-2"] == (2, 1, 1, 3)  # B arrives; A goes; A and Z are asked for
    assert counts["search_results", "snapshot-3"] == (0, 2, 1, 2)  # A returns for both; B goes


def test_orphans_of_empty_tables(spark):
    sr, cf = spark.createDataFrame([], "doc_id string, snapshot_id string"), spark.createDataFrame([], "doc_id string, snapshot_id string, total_inbound_citations long")
    assert rows(orp.orphans(snaps(spark, []), sr, cf)) == []
    assert rows(orp.orphan_counts(snaps(spark, []), sr, cf)) == []


UTC = timezone.utc


def us(*a, tz=UTC, micro=0):
    return int((datetime(*a, tzinfo=tz) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000 + micro


NY, BERLIN = "America/New_York", "Europe/Berlin"
CASES = [
    ("2024-03-10T02:30:00", NY, us(2024, 3, 10, 7, 30)),  # skipped: moves on by the gap
    ("2024-11-03 01:30:00", NY, us(2024, 11, 3, 5, 30)),  # twice: the first
    ("2024-07-01", BERLIN, us(2024, 6, 30, 22)),
    ("2024-07", None, us(2024, 7, 1)), ("2024", NY, us(2024, 1, 1, 5)), ("20240701", None, us(2024, 7, 1)),
    ("12/31/2020 11:59 PM", None, us(2020, 12, 31, 23, 59)), ("1/2/2020 12:05 am", None, us(2020, 1, 2, 0, 5)), ("31/12/2020 11:59 PM", None, None), ("13/01/2020 1:00 PM", None, None),
    ("31.12.2020 07:25", None, us(2020, 12, 31, 7, 25)), ("1.2.2020 07:25", None, us(2020, 2, 1, 7, 25)), ("12.31.2020 07:25", None, None),
    ("Mon, 05 Jun 2023 09:22:13 +0200", NY, us(2023, 6, 5, 7, 22, 13)), ("nov 18, 2024 5:39 am", None, us(2024, 11, 18, 5, 39)), ("5 October 2024", None, us(2024, 10, 5)),
    ("2021-01-18 16:26:02 CEST", NY, us(2021, 1, 18, 14, 26, 2)), ("2021-01-18 16:26:02 XYZ", None, None),
    (" 2016-07-15t15:24:41.1234567Z ", NY, us(2016, 7, 15, 15, 24, 41, micro=123456)), ("2018-10-31T18:42:54+11:00[Australia/Sydney]", None, us(2018, 10, 31, 7, 42, 54)), ("2018-10-31T18:42:54[australia/sydney]", None, us(2018, 10, 31, 7, 42, 54)),
    ("1714177323", NY, 1714177323_000000), ("1315160818553", NY, 1315160818553_000), ("20130101T101010", None, us(2013, 1, 1, 10, 10, 10)),
    ("2022-04-31T10:00:00Z", None, None), ("2020-11-05T25:10:00Z", None, None), ("2020-02-30", None, None), ("0000-00-00", None, None), ("12:45", None, None), ("spring 2016", None, None), ("", None, None), (" ", None, None), ("2018-06-1x", None, None), ("2024-01-01", "Nowhere/City", None), ("2020-01-01 10:61", None, None),
]


def test_instants_by_hand(spark):
    df = spark.createDataFrame([(i, "s", t, z) for i, (t, z, _) in enumerate(CASES)] + [(999, "s", None, None)], "row_id int, src string, text string, feed_zone string")
    got = {r.row_id: (r.utc_us, r.ambiguous) for r in ins.resolve(df).collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if got[i] != (c[2], False)]
    assert not wrong
    assert got[999] == (None, False)


def test_instants_against_zoneinfo(spark):
    rng = np.random.default_rng(3)
    zones = [NY, BERLIN, "Europe/London", "Australia/Sydney", "Asia/Kolkata"]
    base = datetime(2009, 1, 1)
    pts = [(i, base + timedelta(minutes=int(rng.integers(0, 9_000_000))), zones[i % 5]) for i in range(400)]
    pts += [(1000 + i, datetime(2023, 3, 26, 1, 0) + timedelta(minutes=10 * i), zones[i % 5]) for i in range(60)] + [(2000 + i, datetime(2023, 10, 29, 0, 0) + timedelta(minutes=10 * i), zones[i % 5]) for i in range(60)]
    df = spark.createDataFrame([(i, "s", t.strftime("%Y-%m-%dT%H:%M"), z) for i, t, z in pts], "row_id int, src string, text string, feed_zone string")
    got = {r.row_id: r.utc_us for r in ins.resolve(df).collect()}
    for i, t, z in pts:
        assert got[i] == round((t.replace(tzinfo=ZoneInfo(z)) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000, (t, z)


def test_mixture_learns_the_order_of_a_source(spark):
    """Without rules, a source whose clear values put the day first reads its unclear ones that way; a source without clear values stays ambiguous."""
    clear = [("a", f"{d}/03/2020 08:00 AM") for d in range(13, 29)]
    df = spark.createDataFrame([(s, t, None) for s, t in [*clear, ("a", "04/03/2020 08:00 AM"), ("b", "04/03/2020 08:00 AM")]], "src string, text string, feed_zone string")
    got = {(r.src, r.text): (r.fmt, r.ambiguous, r.utc_us) for r in ins.resolve(df, odds={}).collect()}
    assert got["a", "04/03/2020 08:00 AM"] == ("slash_dmy", False, us(2020, 3, 4, 8))
    assert got["b", "04/03/2020 08:00 AM"][1:] == (True, None)


def _chosen(spark, texts, **kw):
    df = spark.createDataFrame([(s, t, z) for s, t, z in texts], "src string, text string, feed_zone string")
    return {(r.src, r.text): (r.fmt, r.utc_us) for r in ins.resolve(df, **kw).collect()}


def test_choices_flip_with_the_mixture(spark):
    """The same text is read by what its source's other values show: order of day and month, seconds or milliseconds."""
    days = [("a", f"{d}.03.2020 08:00", None) for d in range(13, 29)] + [("b", f"03.{d}.2020 08:00", None) for d in range(13, 29)]
    ms = [("a", str(1_600_000_000_000 + i), None) for i in range(40)] + [("b", str(1_600_000_000 + i), None) for i in range(2)]
    asked = [(s, t, None) for s in "ab" for t in ("04.05.2020 08:00",)] + [("a", "1234567890", None)]
    free = _chosen(spark, [*days, *ms, *asked], odds={})
    assert free["a", "04.05.2020 08:00"] == ("dot_dmy", us(2020, 5, 4, 8)) and free["b", "04.05.2020 08:00"] == ("dot_mdy", us(2020, 4, 5, 8))
    ruled = _chosen(spark, [*days, *ms, *asked])
    assert ruled["a", "04.05.2020 08:00"] == ruled["b", "04.05.2020 08:00"] == ("dot_dmy", us(2020, 5, 4, 8))
    assert ruled["b", "03.20.2020 08:00"] == ("none", None)  # an impossible date stays one, however often it is sent
    assert ruled["a", "1234567890"] == ("epoch_s", 1234567890_000000)
    # weaker odds than the rules': a source that shows the other order often enough turns them
    weak = _chosen(spark, [*days, *ms, *asked], odds={"dot_mdy": 0.9})
    assert weak["b", "04.05.2020 08:00"] == ("dot_mdy", us(2020, 4, 5, 8)) and weak["a", "04.05.2020 08:00"] == ("dot_dmy", us(2020, 5, 4, 8))


def test_second_showing_of_a_wall_clock(spark):
    clear = [("a", f"2020-06-{d:02d} 01:30", "America/New_York") for d in range(1, 29)]
    got = _chosen(spark, [*clear, ("a", "2024-11-03 01:30", "america/new_york"), ("b", "2024-11-03 01:30", NY)], odds={})
    assert got["a", "2024-11-03 01:30"] == ("iso", us(2024, 11, 3, 5, 30))
    assert got["b", "2024-11-03 01:30"][1] is None  # nothing tells the two apart
    assert _chosen(spark, [("b", "2024-11-03 01:30", NY)])["b", "2024-11-03 01:30"] == ("iso", us(2024, 11, 3, 5, 30))


def test_instants_of_nothing(spark):
    df = spark.createDataFrame([], "row_id int, src string, text string, feed_zone string")
    assert rows(ins.resolve(df)) == []
