"""The pN_ queries of the core: problems tagged general."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewrack.operators.timestamps import found_timestamps
from tidewrack.operators.upsert import repeated_deliveries
from tidewrack.tables import table


def p6_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return repeated_deliveries(table(spark, data_dir, "messages"))


def p7_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return found_timestamps(*(table(spark, data_dir, t) for t in ("items", "feed_results", "messages", "feeds")))


#: Days and times found piece by piece, with its own months and zones: it shares nothing with the operator.
_P7 = r"""
    WITH r AS (SELECT 'items' AS tbl, item_id AS rec_id, date, tz AS zone FROM items LEFT JOIN feeds USING (feed_id)
      UNION ALL SELECT 'feed_results', result_id, date, tz FROM feed_results LEFT JOIN feeds USING (feed_id)
      UNION ALL SELECT 'messages', delivery_id, date, headers['X-Origin-Zone'] FROM messages),
    c AS (SELECT tbl, rec_id, zone, trim(regexp_replace(regexp_replace(date, '\([^)]*\)', '', 'g'), '[\s\x{a0}\x{202f}]+', ' ', 'g')) AS s FROM r WHERE date IS NOT NULL),
    -- digits only: an epoch, or a day with or without a time
    n AS (SELECT *, regexp_matches(s, '^(\d{10}|\d{13}|\d{16})$') AS epoch, regexp_matches(s, '^\d{8}([Tt ]?\d{4}(\d{2})?)?(\D.*)?$') AND NOT regexp_matches(s, '^(\d{10}|\d{13}|\d{16})$') AS packed FROM c),
    -- a packed day and time is spelled out, so that one set of rules reads all
    w AS (SELECT *, CASE WHEN packed THEN regexp_replace(regexp_replace(s, '^(\d{4})(\d{2})(\d{2})[Tt ]?', '\1-\2-\3 '), '^(\S+) (\d{2})(\d{2})(\d{2})?', '\1 \2:\3:\4') ELSE s END AS x FROM n WHERE NOT epoch),
    p AS (SELECT *,
        regexp_extract(x, '^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:\D|$)', ['y', 'm', 'd']) AS ymd,
        regexp_extract(x, '^(\d{1,2})([./])(\d{1,2})[./](\d{4})(?:\D|$)', ['a', 'sep', 'b', 'y']) AS nums,
        regexp_extract(x, '^(?:\pL+\.?,? )?(\d{1,2})(?:er|\.)? (?:de )?(\pL+)\.? (?:de )?(\d{4})(?:\D|$)', ['d', 'm', 'y']) AS dmy,
        regexp_extract(x, '^(?:\pL+\.?, )?(\pL+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(?:\D|$)', ['m', 'd', 'y']) AS mdy,
        regexp_extract(x, '(?:^|\D)(\d{1,2})[:h](\d{2})(?::(\d{2}))?', ['h', 'mi', 's']) AS t,
        lower(regexp_extract(x, '\d ?([AaPp])\.?[Mm]\.?(?: |$)', 1)) AS half,
        regexp_extract(x, '[:h]\d{2}[^+-]*?([+-])(\d{2}):?(\d{2})?(?:\[.*)?$', ['sign', 'h', 'm']) AS o,
        regexp_extract(regexp_replace(x, '(?i) ?(uhr|[ap]\.?m\.?)( |$)', ' ', 'g'), '[:h]\d{2}(?:[:.,]\d+)* ?([A-Za-z]+(?:/[A-Za-z_+-]+)*) ?$', 1) AS name FROM w),
    d AS (SELECT *, CASE WHEN ymd.y <> '' THEN ymd.y WHEN nums.y <> '' THEN nums.y WHEN dmy.y <> '' THEN dmy.y ELSE mdy.y END AS yy,
        CASE WHEN ymd.y <> '' THEN ymd.m WHEN nums.y <> '' THEN CASE WHEN nums.sep = '.' OR try_cast(nums.a AS INT) > 12 THEN nums.b ELSE nums.a END
             ELSE (SELECT CAST(min(k) AS VARCHAR) FROM (VALUES ('jan', 1), ('jan', 1), ('ene', 1), ('feb', 2), ('fev', 2), ('mar', 3), ('apr', 4), ('avr', 4), ('abr', 4), ('may', 5), ('mai', 5), ('jun', 6), ('juin', 6), ('jul', 7), ('juil', 7), ('aug', 8), ('aou', 8), ('ago', 8), ('sep', 9), ('set', 9), ('oct', 10), ('okt', 10), ('nov', 11), ('dec', 12), ('dez', 12), ('dic', 12)) v(b, k)
                   WHERE starts_with(strip_accents(lower(CASE WHEN dmy.y <> '' THEN dmy.m ELSE mdy.m END)), b)) END AS mm,
        CASE WHEN ymd.y <> '' THEN ymd.d WHEN nums.y <> '' THEN CASE WHEN nums.sep = '.' OR try_cast(nums.a AS INT) > 12 THEN nums.a ELSE nums.b END WHEN dmy.y <> '' THEN dmy.d ELSE mdy.d END AS dd FROM p),
    q AS (SELECT *, CAST(try_strptime(yy || '-' || mm || '-' || dd, '%Y-%m-%d') AS TIMESTAMP) AS day, t.h <> '' AS timed,
        CASE half WHEN 'p' THEN try_cast(t.h AS INT) % 12 + 12 WHEN 'a' THEN try_cast(t.h AS INT) % 12 ELSE try_cast(t.h AS INT) END AS h, try_cast(t.mi AS INT) AS mi, coalesce(try_cast(t.s AS INT), 0) AS sec,
        CASE WHEN o.h <> '' THEN (CASE o.sign WHEN '-' THEN -60 ELSE 60 END) * (try_cast(o.h AS INT) * 60 + coalesce(try_cast(o.m AS INT), 0))
             ELSE 3600 * CASE upper(name) WHEN 'Z' THEN 0 WHEN 'UT' THEN 0 WHEN 'UTC' THEN 0 WHEN 'GMT' THEN 0 WHEN 'WET' THEN 0 WHEN 'WEST' THEN 1 WHEN 'BST' THEN 1 WHEN 'CET' THEN 1 WHEN 'MEZ' THEN 1 WHEN 'CEST' THEN 2 WHEN 'MESZ' THEN 2 WHEN 'EET' THEN 2 WHEN 'EEST' THEN 3 WHEN 'MSK' THEN 3
               WHEN 'EST' THEN -5 WHEN 'EDT' THEN -4 WHEN 'CST' THEN -6 WHEN 'CDT' THEN -5 WHEN 'MST' THEN -7 WHEN 'MDT' THEN -6 WHEN 'PST' THEN -8 WHEN 'PDT' THEN -7 WHEN 'AKST' THEN -9 WHEN 'AKDT' THEN -8 WHEN 'HST' THEN -10 WHEN 'JST' THEN 9 WHEN 'KST' THEN 9 WHEN 'AEST' THEN 10 WHEN 'AEDT' THEN 11 WHEN 'NZST' THEN 12 WHEN 'NZDT' THEN 13 END END AS off FROM d),
    l AS (SELECT *, day + to_seconds(h * 3600 + mi * 60 + sec) AS local, CASE WHEN contains(name, '/') THEN name ELSE coalesce(zone, 'UTC') END AS place FROM q WHERE day IS NOT NULL AND (NOT timed OR (h <= 23 AND mi <= 59 AND sec <= 59)))
    SELECT tbl, rec_id, CASE WHEN NOT timed THEN strftime(day, '%Y-%m-%d') WHEN off IS NOT NULL THEN strftime(local - to_seconds(off), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(timezone('UTC', timezone(place, local)), '%Y-%m-%dT%H:%M:%SZ') END AS utc FROM l
    UNION ALL SELECT tbl, rec_id, strftime(make_timestamp(try_cast(s[1:10] AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') FROM n WHERE epoch
"""

QUERIES = {"p6_found": p6_found, "p7_found": p7_found}

ORACLE = {
    "p6_found": r"""
        WITH ids AS (
          SELECT delivery_id, received_at,
                 regexp_replace(regexp_replace(regexp_replace(message_id, '\([^()]*\)', '', 'g'), '\s+', '', 'g'), '^<+|>+$', '', 'g') AS bare
          FROM messages),
        norm AS (
          SELECT delivery_id, received_at,
                 nullif(regexp_extract(bare, '^(.*@)[^@]*$', 1) || lower(regexp_replace(bare, '^.*@', '')), '') AS mid
          FROM ids WHERE bare IS NOT NULL),
        ranked AS (
          SELECT delivery_id, mid, row_number() OVER (PARTITION BY mid ORDER BY received_at NULLS LAST, delivery_id) AS k FROM norm WHERE mid IS NOT NULL)
        SELECT delivery_id FROM ranked WHERE k > 1
    """,
    "p7_found": _P7,
}
