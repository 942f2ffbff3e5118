"""Problem 7: mixed timestamp formats and time zones.

A wall-clock time becomes an instant by an as-of lookup in the intervals
during which each zone kept one offset. On the wall clock these intervals
overlap where clocks go back and leave a gap where they go forward, so the
number of intervals that hold a local time says which case it is: one gives
the offset directly, two mean that the time is ambiguous, none that it does
not exist.

The interval table has one row per zone in use and year (bounded by the tz
database: about 600 names times the years covered, some MB), so the lookup is
one broadcast equi-join and no row of the data is shuffled.
"""

from __future__ import annotations

import struct
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from importlib import resources
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.dates import iso_instant, parse_written_date

YEARS = (1950, 2050)
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _offset(zone: ZoneInfo, at: int) -> int:
    return int((_EPOCH + timedelta(seconds=at)).astimezone(zone).utcoffset().total_seconds())


def _transitions(name: str) -> list[int]:
    """The instants at which the tz database's file of a zone lists a change, in order."""
    path = next((p for p in (Path(d) / name for d in TZPATH) if p.is_file()), None)
    data = (path or resources.files("tzdata").joinpath("zoneinfo", *name.split("/"))).read_bytes()
    # two blocks, of 32-bit times and then, from version 2 on, of 64-bit ones
    at, width = 0, 4
    if data[4:5] >= b"2":
        isut, isstd, leap, times, types, chars = struct.unpack(">6l", data[20:44])
        at, width = 44 + times * 5 + types * 6 + chars + leap * 8 + isstd + isut, 8
    times = struct.unpack(">l", data[at + 32 : at + 36])[0]
    return list(struct.unpack(f">{times}{'q' if width == 8 else 'l'}", data[at + 44 : at + 44 + times * width]))


@lru_cache(maxsize=1024)
def _zone_years(name: str, first: int, last: int) -> list[tuple]:
    """(zone, year, [(local start, local end, offset)]) of one zone for every year."""
    begin, end = (int((datetime(y, m, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds()) for y, m in ((first - 1, 1), (last + 1, 11)))
    listed = _transitions(name)
    # every listed change is a point; beyond the last one the file has a rule, which is looked at day by day
    rule = range(max(begin, listed[-1] if listed else begin) + 86400, end, 86400)
    points = [begin, *[t for t in listed if begin < t < end], *rule, end]
    years = {y: int((datetime(y, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds()) for y in range(first, last + 2)}
    zone, rows = ZoneInfo(name), []
    pieces, start, off = [], begin, _offset(zone, begin)
    for a, b in zip(points, points[1:]):
        if _offset(zone, b) != off:
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if _offset(zone, mid) == off else (a, mid)
            pieces.append((start + off, b + off, off))
            start, off = b, _offset(zone, b)
    pieces.append((start + off, end + off, off))
    for y in range(first, last + 1):
        # pieces that end shortly before the year or start shortly after it keep a gap at its edge apart from missing data
        rows.append((name, y, [p for p in pieces if p[1] > years[y] - 172800 and p[0] < years[y + 1] + 172800]))
    return rows


def zone_intervals(spark: SparkSession, zones: list[str], years: tuple[int, int] = YEARS) -> DataFrame:
    """zone STRING, year INT, spans ARRAY<STRUCT<lo BIGINT, hi BIGINT, off INT>> in local seconds."""
    rows = [r for z in sorted({*zones, "UTC"}) for r in _zone_years(z, *years)]
    return spark.createDataFrame(rows, "zone string, year int, spans array<struct<lo:bigint,hi:bigint,off:int>>")


def zones_in_use(df: DataFrame, written: Column, default_zone: Column) -> list[str]:
    """Names of the tz database among the default zones and the region names written in dates.

    One narrow aggregation; at most as many names as the tz database has come
    to the driver.
    """
    names = F.array(F.trim(default_zone), F.nullif(F.regexp_extract(written, r"([A-Za-z_]+(?:/[A-Za-z_+-]+)+)\]?\s*$", 1), F.lit("")))
    known = df.select(F.explode(names).alias("zone")).filter("zone in (" + ", ".join(f"'{z}'" for z in sorted(available_timezones())) + ")").distinct()
    return sorted(r.zone for r in known.collect())


def normalise_timestamps(df: DataFrame, written: Column, default_zone: Column | None = None, years: tuple[int, int] = YEARS, drop_invalid: bool = False, zones: list[str] | None = None) -> DataFrame:
    """Add ``utc`` STRING and ``time_case`` STRING to ``df``.

    ``utc`` is ``yyyy-MM-ddTHH:mm:ssZ`` where the string has a time of day and
    the day as written where it has none; null where it names no valid day.
    ``time_case`` is ``day``, ``offset`` (written with one, or an epoch),
    ``direct``, ``ambiguous``, ``nonexistent``, or null with ``utc``.

    A time without offset is in its own zone name, else in ``default_zone``,
    else in UTC; a name that the tz database lacks counts as UTC. ``zones``
    names the zones to expect; without it one aggregation finds them. An ambiguous
    time takes the first of its two instants; one that does not exist takes
    the offset in force before the gap, which moves it forward by the gap.
    Local times outside ``years`` count with the offset of the zone's nearest
    covered year. Columns of ``df`` keep their names and values; its own
    columns ``utc`` and ``time_case``, if any, are replaced. Null, empty and
    repeated rows stay one row each, unless ``drop_invalid`` leaves out rows
    without a valid day.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c not in ("utc", "time_case")]
    zone = default_zone if default_zone is not None else F.lit(None).cast("string")
    keep_cols = [F.col(f"`{c}`") for c in keep]
    # a generator binds the parsed parts: no rule copies the parse into filters or later projections
    x = df.select(*keep_cols, zone.alias("__z"), parse_written_date(written).alias("__p"))
    x = x.select(*keep_cols, "__z", F.inline_outer(F.array("__p")).alias("__day", "__has_time", "__t", "__off", "__named"))
    if drop_invalid:
        x = x.filter(F.col("__day").isNotNull())
    t, has_time, off = F.col("__t"), F.col("__has_time"), F.col("__off")
    looked_up = F.when(has_time & off.isNull(), F.coalesce("__named", F.nullif(F.trim("__z"), F.lit(""))))
    x = x.withColumn("__zone", looked_up).withColumn("__year", F.when(F.col("__zone").isNotNull(), F.least(F.greatest(F.year("__day"), F.lit(years[0])), F.lit(years[1]))))
    spans = zone_intervals(spark, zones_in_use(df, written, zone) if zones is None else zones, years).select(F.col("zone").alias("__zone"), F.col("year").alias("__year"), F.col("spans").alias("__spans"))
    x = x.join(F.broadcast(spans), ["__zone", "__year"], "left")
    spans = F.col("__spans")
    # spans are in time order: the first hit is the earlier instant, the last one before a gap has the old offset
    x = x.withColumn("__hit", F.filter(spans, lambda s: (s.lo <= t) & (t < s.hi)))
    hit = F.col("__hit")
    before = F.filter(spans, lambda s: s.hi <= t)
    found = F.coalesce(F.try_element_at(hit, F.lit(1)).off, F.try_element_at(before, F.lit(-1)).off, F.try_element_at(spans, F.lit(1)).off)
    case = (
        F.when(t.isNull(), F.lit(None))
        .when(~has_time, F.lit("day"))
        .when(off.isNotNull(), F.lit("offset"))
        .when(spans.isNull() | (F.size(hit) == 1), F.lit("direct"))
        .when(F.size(hit) > 1, F.lit("ambiguous"))
        .otherwise(F.lit("nonexistent"))
    )
    x = x.select(*keep_cols, "__day", "__has_time", case.alias("time_case"), (t - F.coalesce(off, found, F.lit(0))).alias("__utc"))
    return x.select(*keep_cols, F.when(has_time, iso_instant(F.col("__utc"))).otherwise(F.col("__day").cast("string")).alias("utc"), "time_case")


def found_timestamps(items: DataFrame, feed_results: DataFrame, messages: DataFrame, feeds: DataFrame) -> DataFrame:
    """tbl, rec_id, utc: one row per date of the three tables that names a valid day.

    ``feeds`` is joined without a hint: Spark broadcasts it while its size is
    under the session's threshold and shuffles on the key beyond that.
    """
    tz = feeds.groupBy("feed_id").agg(F.min("tz").alias("zone"))
    parts = [
        df.select(F.lit(name).alias("tbl"), F.col(key).alias("rec_id"), "feed_id", "date").join(tz, "feed_id", "left").select("tbl", "rec_id", "date", "zone")
        for name, df, key in (("items", items, "item_id"), ("feed_results", feed_results, "result_id"))
    ]
    header = F.try_element_at("headers", F.lit("X-Origin-Zone"))
    parts.append(messages.select(F.lit("messages").alias("tbl"), F.col("delivery_id").alias("rec_id"), "date", header.alias("zone")))
    x = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.col("date").isNotNull())
    return normalise_timestamps(x, F.col("date"), F.col("zone"), drop_invalid=True).select("tbl", "rec_id", "utc")
