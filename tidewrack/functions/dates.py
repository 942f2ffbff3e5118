"""Written dates to wall-clock parts, natively.

Nine written forms are recognised by one regular expression each; the first
that matches rewrites the string to ``y|mo|d|h|mi|s|half|offset|zone`` so that
a row costs one match and one replacement, all inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in English, German, French and Spanish.
MONTHS = {
    1: "jan january januar janvier enero jänner",
    2: "feb february februar février fevrier febrero",
    3: "mar march märz maerz mars marzo",
    4: "apr april avril abril",
    5: "may mai mayo",
    6: "jun june juni juin junio",
    7: "jul july juli juillet julio",
    8: "aug august août aout agosto",
    9: "sep sept september septembre septiembre setiembre",
    10: "oct october oktober octobre octubre okt",
    11: "nov november novembre noviembre",
    12: "dec december dezember décembre decembre diciembre dez",
}
# Offsets in minutes of zone abbreviations that have one meaning in mail and feeds.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}

_ZONE = r"(?:([+-]\d{2}:?\d{0,2})(?:\[[A-Za-z_/+-]+\])?|([A-Za-z][A-Za-z_]*(?:/[A-Za-z_+-]+)*))"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_WORD = r"([\p{L}]+)"
#: (pattern, replacement) in order of trial; a group that took no part leaves an empty field.
FORMS = [
    # 2025-04-28T02:16:23.5+02:00, 2025/04/29 05:07, 2025-04-01 23:51:05 Asia/Tokyo
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[Tt ]\s*{_TIME}\s*{_ZONE}?)?$", "$1|$2|$3|$4|$5|$6||$7|$8"),
    # 20250217T024528Z, 20241229203300Z, 20241018
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})?\s*{_ZONE}?)?$", "$1|$2|$3|$4|$5|$6||$7|$8"),
    # Sun, 12 Oct 2025 14:39:05 +0900 (JST); 28 April 2025, 03:34; 25 de diciembre de 2024; 1er août 2025 à 21h17; 30. September 2024, 02:40 Uhr
    (
        rf"^(?:\p{{L}}{{2,}}\.?,?\s+)?(\d{{1,2}})(?:er|\.)?\s+(?:de\s+)?{_WORD}\.?\s+(?:de\s+)?(\d{{4}})(?:,?(?:\s+(?:at|à|um|a las))?\s+(\d{{1,2}})[:h](\d{{2}})(?::(\d{{2}})(?:[.,]\d+)?)?(?:\s*Uhr)?\s*{_ZONE}?(?:\s*\([^)]*\))?)?$",
        "$3|$2|$1|$4|$5|$6||$7|$8",
    ),
    # May 14, 2025 08:33 CEST; June 30, 2025 2:39 AM; November 16, 2024 at 5:26 AM
    (
        rf"^(?:\p{{L}}{{2,}}\.?,\s+)?{_WORD}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?(?:\s+at)?\s+{_TIME}\s*(?:([AaPp])\.?[Mm]\.?)?\s*{_ZONE}?)?$",
        "$3|$1|$2|$4|$5|$6|$7|$8|$9",
    ),
    # 21.02.2025 22:21:49
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{_TIME}(?:\s*Uhr)?\s*{_ZONE}?)?$", "$3|$2|$1|$4|$5|$6||$7|$8"),
    # 25/12/2024: a first number above 12 can only be the day
    (rf"^(1[3-9]|2\d|3[01])/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_TIME}\s*(?:([AaPp])\.?[Mm]\.?)?\s*{_ZONE}?)?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    # 9/19/2025 5:15 PM
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_TIME}\s*(?:([AaPp])\.?[Mm]\.?)?\s*{_ZONE}?)?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
]


def _clean(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[\s  ]+", " "))


def parse_written_date(written: Column) -> Column:
    """Parse a written date to a struct, null where it names no valid day.

    Fields: ``day`` DATE as written; ``has_time``; ``local_s``, seconds of the
    wall clock since 1970-01-01T00:00 (day and time as written); ``offset_s``,
    the offset written or implied by a zone abbreviation or by an epoch
    number, else null; ``zone``, a region name such as Asia/Tokyo, else null.

    Weekday names and comments in brackets are ignored, fractions are dropped,
    missing seconds are 0, ``-0000`` is UTC. 10, 13 and 16 digits are an epoch
    in seconds, milliseconds and microseconds. 24:00 is the next day's 00:00.
    An impossible day or time, a relative word, an empty or a null string all
    give null.
    """
    return _let(_clean(written), lambda s: F.when(s.rlike(r"^\d{10}(\.\d+)?$|^\d{13}$|^\d{16}$"), _epoch(s)).otherwise(_let(F.split(_rewritten(s), r"\|", -1), _from_parts)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: bound by a lambda, so that no rule copies it to each of its uses."""
    return F.transform(F.array(value), body)[0]


def _literal_map(values: dict[str, int]) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")")


def _struct(day: Column, has_time: Column, local_s: Column, offset_s: Column, zone: Column) -> Column:
    return F.struct(day.alias("day"), has_time.alias("has_time"), local_s.cast("bigint").alias("local_s"), offset_s.cast("int").alias("offset_s"), zone.cast("string").alias("zone"))


def _epoch(s: Column) -> Column:
    digits = F.regexp_replace(s, r"\..*$", "")
    n = digits.try_cast("bigint")
    sec = F.when(F.length(digits) == 10, n).when(F.length(digits) == 13, F.floor(n / 1000)).otherwise(F.floor(n / 1000000))
    return _let(sec.cast("bigint"), lambda t: _struct(F.date_from_unix_date(F.floor(t / 86400).cast("int")), F.lit(True), t, F.lit(0), F.lit(None)))


def _rewritten(s: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, to in reversed(FORMS):
        out = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, to)).otherwise(out)
    return out


def _from_parts(p: Column) -> Column:
    number = lambda k: F.nullif(p[k], F.lit("")).try_cast("int")
    names = _literal_map({w: m for m, ws in MONTHS.items() for w in ws.split()})
    month = F.coalesce(p[1].try_cast("int"), F.try_element_at(names, F.lower(p[1])))
    written_day = F.concat_ws("-", p[0], F.lpad(month.cast("string"), 2, "0"), F.lpad(p[2], 2, "0")).try_cast("date")
    half = F.lower(p[6])
    hour = F.when(half == "p", number(3) % 12 + 12).when(half == "a", number(3) % 12).otherwise(number(3))
    sign = F.when(p[7].startswith("-"), -1).otherwise(1)
    off = F.regexp_replace(F.substring(p[7], 2, 6), ":", "")
    off_s = sign * (F.substring(off, 1, 2).try_cast("int") * 3600 + F.coalesce(F.nullif(F.substring(off, 3, 2), F.lit("")).try_cast("int"), F.lit(0)) * 60)
    short = _literal_map({k: v * 60 for k, v in ABBREVIATIONS.items()})
    return _let(
        F.struct(written_day.alias("day"), hour.alias("h"), number(4).alias("mi"), F.coalesce(number(5), F.lit(0)).alias("s"), F.coalesce(off_s, F.try_element_at(short, F.lower(p[8]))).alias("off")),
        lambda x: F.when(
            x.day.isNotNull() & ((p[3] == "") | (((half == "") | number(3).between(1, 12)) & (x.mi <= 59) & (x.s <= 60) & ((x.h <= 23) | ((x.h == 24) & (x.mi == 0) & (x.s == 0))))),
            _struct(
                x.day,
                p[3] != "",
                F.unix_date(x.day).cast("bigint") * 86400 + F.when(p[3] != "", x.h * 3600 + x.mi * 60 + F.least(x.s, F.lit(59))).otherwise(0),
                x.off,
                F.when((p[8] != "") & x.off.isNull(), p[8]),
            ),
        ),
    )


def iso_instant(utc_s: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of seconds since the epoch, whatever the session's zone."""
    day = F.date_from_unix_date(F.floor(utc_s / 86400).cast("int")).cast("string")
    s = F.pmod(utc_s, F.lit(86400))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), two(s / 3600), F.lit(":"), two(F.pmod(s, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(s, F.lit(60))), F.lit("Z"))
