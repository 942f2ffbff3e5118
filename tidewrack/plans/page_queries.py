"""Queries over pages and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.functions import html as h
from tidewrack.functions import urls as u
from tidewrack.plans.registry import query, table
from tidewrack.plans.sync_queries import _STREAK
from tidewrack.streaming import sync_stream as st


@query("article_extract")
def article_extract(spark, d):
    """Every projection of the newsletters' pages from one parse each."""
    m = table(spark, d, "messages").filter("html_body is not null").select("delivery_id", "html_body", F.concat(F.lit("https://"), F.regexp_extract("sender", r"@([^\s>]+)", 1), F.lit("/")).alias("url"))
    x = h.extract(m, "html_body", "url")
    return x.select("delivery_id", "page.title", F.length("page.markdown").alias("markdown_chars"), F.length("page.content").alias("content_chars"), F.size("page.links").alias("links"), "page.words", h.post_confidence(u.post_score(F.col("url")), F.col("page")).alias("confidence"))


@query("stream_dedupe", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedupe(spark, d):
    return st.dedupe_stream(st.file_stream(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), "event_id", "ts", "31 days").select("event_id", "user_id", "event_type")


@query("stream_failure_streak", _STREAK)
def stream_failure_streak(spark, d):
    return st.streak_stream(st.file_stream(spark, d, "events"), "user_id", "ts", "event_type", "error", "click")


@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    return st.windowed_counts(st.file_stream(spark, d, "events"), "ts", "event_type")
