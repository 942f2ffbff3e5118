import datetime as dt
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewrack.operators.timestamps import _zone_years, found_timestamps, normalise_timestamps

CASES = [
    ("Sun, 12 Oct 2025 14:39:05 +0900", None, "2025-10-12T05:39:05Z", "offset"),
    ("Sun, 26 Oct 2025 22:22:13 +0000 (UTC)", None, "2025-10-26T22:22:13Z", "offset"),
    ("2025-04-28T02:16:23.987Z", None, "2025-04-28T02:16:23Z", "offset"),
    ("2025-10-15 02:57:06+11", None, "2025-10-14T15:57:06Z", "offset"),
    ("2024-08-30T13:20:53+09:00[Asia/Tokyo]", None, "2024-08-30T04:20:53Z", "offset"),
    ("2025-04-01 23:51:05 Asia/Tokyo", "Europe/Paris", "2025-04-01T14:51:05Z", "direct"),
    ("20250217T024528Z", None, "2025-02-17T02:45:28Z", "offset"),
    ("20241018", None, "2024-10-18", "day"),
    ("1744957470", None, "2025-04-18T06:24:30Z", "offset"),
    ("1755472708394", None, "2025-08-17T23:18:28Z", "offset"),
    ("June 30, 2025 2:39 AM", None, "2025-06-30T02:39:00Z", "direct"),
    ("July 4, 2025 12:05 AM", "America/New_York", "2025-07-04T04:05:00Z", "direct"),
    ("Jul 24, 2025 18:05 PDT", None, "2025-07-25T01:05:00Z", "offset"),
    ("9/19/2025 5:15 PM", None, "2025-09-19T17:15:00Z", "direct"),
    ("21.02.2025 22:21:49", None, "2025-02-21T22:21:49Z", "direct"),
    ("1er août 2025 à 21h17", None, "2025-08-01T21:17:00Z", "direct"),
    ("25 de diciembre de 2024", None, "2024-12-25", "day"),
    ("30. September 2024, 02:40 Uhr", "Europe/Berlin", "2024-09-30T00:40:00Z", "direct"),
    ("\t2025/03/04 ", None, "2025-03-04", "day"),
    ("2025-03-30 02:30", "Europe/Berlin", "2025-03-30T01:30:00Z", "nonexistent"),
    ("2025-10-26 02:30", "Europe/Berlin", "2025-10-26T00:30:00Z", "ambiguous"),
    ("2025-06-01 12:00", "No/Where", "2025-06-01T12:00:00Z", "direct"),
    ("2025-02-30", None, None, None),
    ("2025-13-40", None, None, None),
    ("0000-00-00 00:00:00", None, None, None),
    ("2025-01-01 25:00", None, None, None),
    ("yesterday", None, None, None),
    ("", None, None, None),
    (None, "Asia/Tokyo", None, None),
    ("x" * 20000, None, None, None),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(CASES)], "i int, w string, z string")
    got = {r.i: (r.utc, r.time_case) for r in normalise_timestamps(df, F.col("w"), F.col("z")).collect()}
    assert {i: got[i] for i in got} == {i: (c, k) for i, (_, _, c, k) in enumerate(CASES)}


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([("2025-01-02", "x", "y")], "date string, utc string, time_case string")
    assert normalise_timestamps(df, F.col("date")).collect()[0].asDict() == {"date": "2025-01-02", "utc": "2025-01-02", "time_case": "day"}
    assert normalise_timestamps(df.limit(0), F.col("date")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.datetimes(dt.datetime(1960, 1, 1), dt.datetime(2049, 12, 31)), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "America/Sao_Paulo", "Asia/Kolkata", "Pacific/Apia"]))
def test_intervals_agree_with_the_tz_database(t, zone):
    local = int((t - dt.datetime(1970, 1, 1)).total_seconds())
    spans = next(r[2] for r in _zone_years(zone, 1950, 2050) if r[1] == t.year)
    hits = [off for lo, hi, off in spans if lo <= local < hi]
    offsets = {int(t.replace(tzinfo=ZoneInfo(zone), fold=f).utcoffset().total_seconds()) for f in (0, 1)}
    back = {o for o in offsets if (t - dt.timedelta(seconds=o)).replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None) == t}
    assert set(hits) == back


def test_short_changes_are_seen(spark):
    """Ramadan 2024 in Morocco lies between two months' firsts: 10 March to 14 April."""
    rows = [(1, "2024-03-20 12:00", "2024-03-20T12:00:00Z", "direct"), (2, "2024-03-01 12:00", "2024-03-01T11:00:00Z", "direct"), (3, "2024-05-01 12:00", "2024-05-01T11:00:00Z", "direct"), (4, "2024-03-10 02:30", "2024-03-10T01:30:00Z", "ambiguous"), (5, "2024-04-14 02:30", "2024-04-14T02:30:00Z", "nonexistent")]
    for zone in ("Africa/Casablanca", "Africa/El_Aaiun"):
        df = spark.createDataFrame([r[:2] for r in rows], "i int, w string").withColumn("z", F.lit(zone))
        got = {(r.i, r.utc, r.time_case) for r in normalise_timestamps(df, F.col("w"), F.col("z")).collect()}
        assert got == {(i, utc, case) for i, _, utc, case in rows}


def test_every_zone_agrees_at_every_listed_change():
    # the zones with the most changes a year, and one of each kind of file
    for zone in ("Africa/Casablanca", "Africa/Cairo", "Asia/Gaza", "America/Scoresbysund", "America/Santiago", "Europe/Dublin", "Antarctica/Troll", "UTC", "Etc/GMT+5", "Asia/Kathmandu"):
        years = {r[1]: r[2] for r in _zone_years(zone, 1950, 2050)}
        for hour in range(0, 101 * 8766, 37):
            at = dt.datetime(1950, 1, 2, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hour)
            local = at.astimezone(ZoneInfo(zone))
            t = int((local.replace(tzinfo=None) - dt.datetime(1970, 1, 1)).total_seconds())
            if local.year <= 2050:
                assert int(local.utcoffset().total_seconds()) in {off for lo, hi, off in years[local.year] if lo <= t < hi}, (zone, at)


def test_found(spark):
    feeds = spark.createDataFrame([(1, "Asia/Tokyo")], "feed_id bigint, tz string")
    items = spark.createDataFrame([(1, 1, "2025-01-01 09:00"), (2, None, "2025-01-01 09:00"), (3, 1, None), (4, 1, "n/a")], "item_id bigint, feed_id bigint, date string")
    results = spark.createDataFrame([(7, 1, "2025-01-01")], "result_id bigint, feed_id bigint, date string")
    mail = spark.createDataFrame([(9, {"X-Origin-Zone": "Europe/Paris"}, "2025-01-01 09:00"), (10, None, "2025-01-01 09:00")], "delivery_id bigint, headers map<string,string>, date string")
    got = {tuple(r) for r in found_timestamps(items, results, mail, feeds).collect()}
    assert got == {("items", 1, "2025-01-01T00:00:00Z"), ("items", 2, "2025-01-01T09:00:00Z"), ("feed_results", 7, "2025-01-01"), ("messages", 9, "2025-01-01T08:00:00Z"), ("messages", 10, "2025-01-01T09:00:00Z")}
