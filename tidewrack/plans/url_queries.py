"""Queries over addresses, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.functions import text as t
from tidewrack.functions import urls as u
from tidewrack.plans.registry import query, table

# SQL restatements, independent of the columns they check.
_TRACK = "('utm_source','utm_medium','utm_campaign','utm_term','utm_content','ref','source','fbclid','gclid')"
_DEC = "url_decode(replace({x}, '+', ' '))"
_ENC = "replace(replace(replace(url_encode({x}), '%20', '+'), '%7E', '~'), '*', '%2A')"


def sql_host(c: str) -> str:
    return f"regexp_replace(lower(regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)), '^www\\.', '')"


def sql_path(c: str) -> str:
    return f"regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def sql_norm(c: str) -> str:
    q = f"regexp_extract({c}, '^[^?#]*\\?([^#]*)', 1)"
    pairs = f"list_filter(list_transform(list_filter(string_split({q}, '&'), lambda kv: kv <> ''), lambda kv: {{'k': {_DEC.format(x="split_part(kv, '=', 1)")}, 'v': {_DEC.format(x="regexp_extract(kv, '^[^=]*=(.*)$', 1)")}}}), lambda p: lower(p.k) NOT IN {_TRACK})"
    keys = f"list_transform({pairs}, lambda p: p.k)"
    # stable sort by the first place of the key groups repeated keys
    shown = f"list_transform(list_sort(list_transform({pairs}, lambda p, i: {{'g': list_position({keys}, p.k), 'i': i, 's': {_ENC.format(x='p.k')} || '=' || {_ENC.format(x='p.v')}}})), lambda p: p.s)"
    port = f"regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:(\\d+)', 1)"
    frag = f"regexp_extract({c}, '#(.*)$', 1)"
    return (
        f"lower(regexp_extract({c}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {sql_host(c)} || CASE WHEN {port} IN ('', '80', '443') THEN '' ELSE ':' || {port} END"
        f" || rtrim(regexp_replace({sql_path(c)}, ';[^/]*$', ''), '/') || CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string({shown}, '&') ELSE '' END || CASE WHEN {frag} <> '' THEN '#' || {frag} ELSE '' END"
    )


def sql_type(c: str) -> str:
    p = f"lower({sql_path(c)})"
    ext = f"regexp_extract({p}, '[^/.][^/]*\\.([^./]*)$', 1)"
    return (
        f"CASE WHEN regexp_matches({c}, 'youtu\\.be/|youtube\\.com/(live|playlist|shorts|watch)') THEN 'youtube' WHEN regexp_matches({c}, 'youtube\\.com/(?:@[0-9A-Za-z_.-]+|(?:c|user)/[0-9A-Za-z_.-]+|channel/[0-9A-Za-z_-]+)(?:/|$)') THEN 'youtube_channel'"
        f" WHEN {ext} IN ('mp3','wav','m4a','ogg','flac','aac','wma') THEN 'audio_file' WHEN (contains({sql_host(c)}, 'vimeo.com') OR contains({sql_host(c)}, 'loom.com')) OR {ext} IN ('mp4','mkv','avi','mov','webm') THEN 'video'"
        f" WHEN {ext} IN ('xml','rss','atom') OR contains({p}, '/feed') OR contains({p}, '/rss') OR contains({p}, '/atom.xml') THEN 'rss' ELSE 'blog' END"
    )


def sql_words(c: str) -> str:
    return f"coalesce(len(list_filter(regexp_split_to_array({c}, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')), 0)"


def _sql_first(patterns: list[tuple[str, float]], c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i){p}') THEN {w}" for p, w in patterns) + " ELSE 0.0 END"


def sql_score(c: str) -> str:
    return f"round(CAST({_sql_first(u.POST_PATTERNS, c)} AS DOUBLE) + CAST({_sql_first(u.OTHER_PATTERNS, c)} AS DOUBLE), 6)"


@query("page_profile", f"""
    WITH x AS (SELECT result_id, {sql_norm('url')} AS norm, {sql_host('url')} AS host, {sql_type('url')} AS kind, {sql_words('content')} AS words, {sql_score('url')} AS score, title FROM feed_results WHERE url IS NOT NULL),
    one AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY norm ORDER BY result_id) = 1)
    SELECT host, count(*) AS pages, count(DISTINCT kind) AS kinds, CAST(sum(words) AS BIGINT) AS words, round(avg(score), 6) AS mean_score, arg_min(title, result_id) FILTER (WHERE title IS NOT NULL) AS first_title FROM one GROUP BY host""")  # fmt: skip
def page_profile(spark, d):
    """Flagship: normalise, type, count, score, keep one row per page, profile each host."""
    x = table(spark, d, "feed_results").filter("url is not null")
    x = x.select("result_id", u.normalize_url(F.col("url")).alias("norm"), u.host(F.col("url")).alias("host"), u.url_type(F.col("url")).alias("kind"), t.word_count(F.col("content")).alias("words"), u.post_score(F.col("url")).alias("score"), "title")
    # first row of a page by a partial aggregation, not by a window over a hot page
    one = x.groupBy("norm").agg(F.min_by(F.struct("result_id", "host", "kind", "words", "score", "title"), "result_id").alias("r")).select("r.*")
    named = F.when(F.col("title").isNotNull(), F.col("result_id"))
    return one.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("kind").alias("kinds"), F.sum("words").alias("words"), F.round(F.avg("score"), 6).alias("mean_score"), F.min_by("title", named).alias("first_title"))


@query("url_normalize", f"SELECT result_id, {sql_norm('url')} AS norm_url FROM feed_results WHERE url IS NOT NULL")
def url_normalize(spark, d):
    return table(spark, d, "feed_results").filter("url is not null").select("result_id", u.normalize_url(F.col("url")).alias("norm_url"))


@query("url_dedupe", f"SELECT min(result_id) AS result_id, {sql_norm('url')} AS norm_url, count(*) AS copies FROM feed_results WHERE url IS NOT NULL GROUP BY 2")
def url_dedupe(spark, d):
    x = table(spark, d, "feed_results").filter("url is not null").select("result_id", u.normalize_url(F.col("url")).alias("norm_url"))
    return x.groupBy("norm_url").agg(F.min("result_id").alias("result_id"), F.count(F.lit(1)).alias("copies"))


@query("url_type_counts", f"SELECT {sql_type('url')} AS kind, count(*) AS n FROM (SELECT url FROM feed_results UNION ALL SELECT source_url FROM items UNION ALL SELECT url FROM feeds UNION ALL SELECT audio_url FROM feed_results) WHERE url IS NOT NULL GROUP BY 1")
def url_type_counts(spark, d):
    r = table(spark, d, "feed_results")
    x = r.select("url").unionAll(table(spark, d, "items").select("source_url")).unionAll(table(spark, d, "feeds").select("url")).unionAll(r.select("audio_url"))
    return x.filter("url is not null").groupBy(u.url_type(F.col("url")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_LITERALS = [
    "https://www.youtube.com/watch?v=abc123&t=9", "https://youtu.be/Zx9", "https://m.youtube.com/shorts/sh0rt-1", "https://www.youtube.com/live/Live_7?x=1", "https://www.youtube.com/channel/UCx", "https://www.youtube.com/@name", "https://vimeo.com/12", "https://player.loom.com/a",
    "https://h.example/a/b.MP3", "https://h.example/a.webm?x", "https://h.example/feed/", "https://h.example/x.atom", "https://h.example/podcast/e1", "https://h.example/my-blog/2", "https://h.example/", "https://sites.google.com/view/name/page", "https://h.example/2024/02/30/x", "https://h.example/2024/02/29/x", "https://h.example/2023-07-04-note", "https://h.example/2022/11/late",
]
_VALUES = ", ".join(f"('{x}')" for x in _LITERALS)


def _literals(spark):
    return spark.createDataFrame([(x,) for x in _LITERALS], "url string")


@query("url_kinds_of_literals", f"SELECT url, {sql_type('url')} AS kind FROM (VALUES {_VALUES}) v(url)")
def url_kinds_of_literals(spark, d):
    return _literals(spark).select("url", u.url_type(F.col("url")).alias("kind"))


@query("youtube_video_id", f"""SELECT url, coalesce(nullif(CASE WHEN regexp_matches({sql_host('url')}, '(^|\\.)youtube\\.com$') AND {sql_path('url')} = '/watch' THEN regexp_extract(url, '[?&]v=([^&#]+)', 1) END, ''),
    nullif(CASE WHEN {sql_host('url')} = 'youtu.be' THEN regexp_extract({sql_path('url')}, '^/([^/]+)', 1) END, ''), nullif(regexp_extract(url, 'youtube\\.com/(?:shorts|live)/([A-Za-z0-9_-]+)', 1), '')) AS video FROM (VALUES {_VALUES}) v(url)""")  # fmt: skip
def youtube_video_id(spark, d):
    return _literals(spark).select("url", u.video_id(F.col("url")).alias("video"))


def _sql_mode(c: str) -> str:
    p = f"lower({sql_path(c)})"
    ext = f"regexp_extract({p}, '[^/.][^/]*\\.([^./]*)$', 1)"
    return f"CASE WHEN regexp_matches({c}, 'youtube\\.com/(?:@[0-9A-Za-z_.-]+|(?:c|user)/[0-9A-Za-z_.-]+|channel/[0-9A-Za-z_-]+)(?:/|$)') THEN 'rss' WHEN {ext} IN ('xml','rss','atom') OR contains({p}, '/feed') OR contains({p}, '/rss') OR contains({p}, '/atom') THEN 'rss' WHEN list_contains(string_split({p}, '/'), 'podcast') THEN 'podcast' WHEN contains({p}, '/blog') THEN 'blog' ELSE 'site' END"


@query("crawl_mode_detect", f"SELECT url, {_sql_mode('url')} AS mode FROM (SELECT url FROM feeds UNION SELECT url FROM (VALUES {_VALUES}) v(url))")
def crawl_mode_detect(spark, d):
    return table(spark, d, "feeds").select("url").unionAll(_literals(spark)).distinct().select("url", u.crawl_mode(F.col("url")).alias("mode"))


_SEG = "list_filter(string_split({p}, '/'), lambda x: x <> '')"


def _sql_prefix(c: str) -> str:
    s = _SEG.format(p=sql_path(c))
    return f"regexp_extract({c}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/' || array_to_string({s}[1:CASE WHEN {sql_host(c)} = 'sites.google.com' AND len({s}) >= 2 THEN 2 WHEN len({s}) >= 2 THEN len({s}) - 1 ELSE len({s}) END], '/')"


@query("site_prefix", f"SELECT prefix, count(*) AS n FROM (SELECT {_sql_prefix('url')} AS prefix FROM (SELECT source_url AS url FROM items WHERE source_url IS NOT NULL UNION ALL SELECT url FROM (VALUES {_VALUES}) v(url))) GROUP BY 1")
def site_prefix(spark, d):
    x = table(spark, d, "items").select(F.col("source_url").alias("url")).filter("url is not null").unionAll(_literals(spark))
    return x.groupBy(u.site_prefix(F.col("url")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query("same_domain_links", f"SELECT r.feed_id, count(*) FILTER (WHERE {sql_host('r.url')} = {sql_host('f.url')}) AS same, count(*) AS links FROM feed_results r JOIN feeds f USING (feed_id) WHERE r.url IS NOT NULL GROUP BY 1")
def same_domain_links(spark, d):
    f = table(spark, d, "feeds").select("feed_id", u.host(F.col("url")).alias("home"))
    r = table(spark, d, "feed_results").filter("url is not null").select("feed_id", u.host(F.col("url")).alias("host"))
    return r.join(f, "feed_id").groupBy("feed_id").agg(F.count_if(F.col("host") == F.col("home")).alias("same"), F.count(F.lit(1)).alias("links"))


@query("url_clean_key", "SELECT result_id, rtrim(regexp_replace(url, '[#?].*$', ''), '/') AS k FROM feed_results WHERE url IS NOT NULL")
def url_clean_key(spark, d):
    return table(spark, d, "feed_results").filter("url is not null").select("result_id", u.clean_key(F.col("url")).alias("k"))


@query("ensure_scheme", "SELECT name, CASE WHEN regexp_matches(name, '^https?://') THEN name ELSE 'https://' || name END AS url FROM (SELECT DISTINCT regexp_replace(url, '^https://', '') AS name FROM feeds UNION SELECT DISTINCT url FROM feeds)")
def ensure_scheme(spark, d):
    f = table(spark, d, "feeds").select("url")
    x = f.select(F.regexp_replace("url", "^https://", "").alias("name")).unionAll(f.select("url")).distinct()
    return x.select("name", u.ensure_scheme(F.col("name")).alias("url"))


@query("blog_url_score", f"SELECT result_id, {sql_score('url')} AS score FROM feed_results WHERE url IS NOT NULL")
def blog_url_score(spark, d):
    return table(spark, d, "feed_results").filter("url is not null").select("result_id", u.post_score(F.col("url")).alias("score"))


@query("candidate_posts", f"SELECT DISTINCT {sql_norm('url')} AS url FROM feed_results WHERE url IS NOT NULL AND {sql_score('url')} > -0.3")
def candidate_posts(spark, d):
    x = table(spark, d, "feed_results").filter("url is not null").filter(u.post_score(F.col("url")) > -0.3)
    return x.select(u.normalize_url(F.col("url")).alias("url")).distinct()


_DAY = "coalesce(try_strptime(nullif(regexp_replace(regexp_extract({c}, '/\\d{{4}}/\\d{{2}}/\\d{{2}}(?:/|$)'), '[^0-9]', '', 'g'), ''), '%Y%m%d'), try_strptime(nullif(regexp_replace(regexp_extract({c}, '/\\d{{4}}-\\d{{2}}-\\d{{2}}'), '[^0-9]', '', 'g'), ''), '%Y%m%d'), try_strptime(nullif(replace(regexp_extract({c}, '/(\\d{{4}}/\\d{{2}})/', 1), '/', ''), '') || '01', '%Y%m%d'))"


@query("date_from_url", f"SELECT url, CAST({_DAY.format(c='url')} AS DATE) AS day FROM (SELECT DISTINCT source_url AS url FROM items WHERE source_url IS NOT NULL UNION SELECT url FROM (VALUES {_VALUES}) v(url))")
def date_from_url(spark, d):
    x = table(spark, d, "items").select(F.col("source_url").alias("url")).filter("url is not null").unionAll(_literals(spark)).distinct()
    return x.select("url", u.date_from_url(F.col("url")).alias("day"))
