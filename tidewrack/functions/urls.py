"""URL columns: normalisation, typing, keys, scopes and scores, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracking keys, file kinds, hosts and path marks.
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid"]
AUDIO_EXTENSIONS = ["mp3", "wav", "m4a", "ogg", "flac", "aac", "wma"]
VIDEO_EXTENSIONS = ["mp4", "mkv", "avi", "mov", "webm"]
FEED_EXTENSIONS = ["xml", "rss", "atom"]
VIDEO_ID = r"(youtube\.com/(watch|shorts|live)|youtu\.be/|youtube\.com/playlist)"
VIDEO_CHANNEL = r"youtube\.com/(@[\w.-]+|channel/[\w-]+|c/[\w.-]+|user/[\w.-]+)(/|$)"
VIDEO_HOSTS = r"(vimeo\.com|loom\.com)"
# Address patterns and their scores, in order of trial.
POST_PATTERNS = [(r"/blog/[^/]+", 0.2), (r"/post/", 0.2), (r"/posts/[^/]+", 0.2), (r"/article/", 0.2), (r"/articles/[^/]+", 0.2), (r"/\d{4}/\d{2}/\d{2}/", 0.3), (r"/\d{4}/\d{2}/[^/]+", 0.25), (r"/\d{4}-\d{2}-\d{2}", 0.25), (r"/news/[^/]+", 0.15)]
OTHER_PATTERNS = [
    (r"/about/?$", -0.5), (r"/contact/?$", -0.5), (r"/privacy/?$", -0.5), (r"/terms/?$", -0.5), (r"/legal/?$", -0.5), (r"/login/?$", -0.8), (r"/signup/?$", -0.8), (r"/register/?$", -0.8), (r"/category/[^/]*/?$", -0.3), (r"/tag/[^/]*/?$", -0.3), (r"/tags/?$", -0.3),
    (r"/categories/?$", -0.3), (r"/page/\d+/?$", -0.3), (r"/search", -0.5), (r"/feed/?$", -0.5), (r"/rss/?$", -0.5), (r"/wp-admin", -0.8), (r"/wp-login", -0.8), (r"/author/[^/]*/?$", -0.2), (r"/archive/?$", -0.3), (r"/#[^/]*$", -0.1),
]
SKIPPED_FILES = r"(?i)\.(?:pdf|png|jpe?g|gif|svg|zip|csv|xlsx?)$"


def _part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty where absent."""
    return F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", group)


def ensure_scheme(url: Column) -> Column:
    """``https://`` in front of what has neither http nor https."""
    return F.when(url.rlike(r"^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def host(url: Column) -> Column:
    """Lower-cased host without user, port and a leading ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(_part(url, 2), r"^(?:.*@)?([^:]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return _part(url, 3)


def same_domain(a: Column, b: Column) -> Column:
    """Whether two addresses have one host, whatever their case and ``www.``."""
    return host(a) == host(b)


def normalize_url(url: Column) -> Column:
    """One spelling per address: lower-cased scheme and host, no ``www.``, user, default port, trailing slashes, path parameters or tracking keys.

    Parameters are decoded and encoded again, repeated keys grouped where they
    first occur; the fragment stays. An address without scheme counts as https.
    Null gives null and the empty string itself.
    """
    u = F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    port = F.regexp_extract(_part(u, 2), r":(\d+)$", 1)
    shown_port = F.when((port == "") | port.isin("80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    clean_path = F.regexp_replace(F.regexp_replace(_part(u, 3), r";[^/]*$", ""), r"/+$", "")
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    encode = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    pair = lambda kv: F.struct(decode(F.regexp_extract(kv, r"^([^=]*)", 1)).alias("k"), decode(F.regexp_extract(kv, r"^[^=]*=(.*)$", 1)).alias("v"))
    pairs = F.transform(F.filter(F.split(_part(u, 4), "&"), lambda kv: kv != ""), pair)
    pairs = F.filter(pairs, lambda x: ~F.lower(x.k).isin(*TRACKING_KEYS))
    keys = F.array_distinct(F.transform(pairs, lambda x: x.k))
    grouped = F.flatten(F.transform(keys, lambda k: F.filter(pairs, lambda x: x.k == k)))
    query = F.array_join(F.transform(grouped, lambda x: F.concat(encode(x.k), F.lit("="), encode(x.v))), "&")
    fragment = _part(u, 5)
    whole = F.concat(
        F.lower(_part(u, 1)), F.lit("://"), host(u), shown_port, clean_path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise("")
    )
    return F.when(url == "", url).otherwise(whole)


def clean_key(url: Column) -> Column:
    """Address without fragment, query and trailing slashes: the key of a crawl's visited set."""
    return F.regexp_replace(F.regexp_replace(url, r"[#?].*$", ""), r"/+$", "")


def extension(p: Column) -> Column:
    """Lower-cased file extension of a path, without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(p, r"[^/.][^/]*\.([^./]*)$", 1))


def url_type(url: Column) -> Column:
    """Kind of source: audio_file, video, local_file, youtube, youtube_channel, rss or blog; the first match wins."""
    p = F.lower(path(url))
    remote = F.instr(url, "://") > 0
    local = F.when(extension(url).isin(*AUDIO_EXTENSIONS), "audio_file").when(extension(url).isin(*VIDEO_EXTENSIONS), "video").otherwise("local_file")
    return (
        F.when(~remote, local)
        .when(url.rlike(VIDEO_ID), "youtube")
        .when(url.rlike(VIDEO_CHANNEL), "youtube_channel")
        .when(extension(p).isin(*AUDIO_EXTENSIONS), "audio_file")
        .when(host(url).rlike(VIDEO_HOSTS) | extension(p).isin(*VIDEO_EXTENSIONS), "video")
        .when(extension(p).isin(*FEED_EXTENSIONS) | p.contains("/feed") | p.contains("/rss") | p.contains("/atom.xml"), "rss")
        .otherwise("blog")
    )


def video_id(url: Column) -> Column:
    """Identifier in a watch, short, live or short-host address; null where there is none."""
    watch = F.when((host(url).rlike(r"(?:^|\.)youtube\.com$")) & (path(url) == "/watch"), F.regexp_extract(_part(url, 4), r"(?:^|&)v=([^&]+)", 1))
    short = F.when(host(url) == "youtu.be", F.regexp_extract(path(url), r"^/([^/]+)", 1))
    other = F.regexp_extract(url, r"youtube\.com/(?:shorts|live)/([A-Za-z0-9_-]+)", 1)
    return F.coalesce(F.nullif(watch, F.lit("")), F.nullif(short, F.lit("")), F.nullif(other, F.lit("")))


def crawl_mode(url: Column) -> Column:
    """How to crawl an address: rss, podcast, blog or site."""
    p = F.lower(path(url))
    return (
        F.when(url.rlike(VIDEO_CHANNEL), "rss")
        .when(extension(p).isin(*FEED_EXTENSIONS) | p.contains("/feed") | p.contains("/rss") | p.contains("/atom"), "rss")
        .when(F.array_contains(F.split(p, "/"), "podcast"), "podcast")
        .when(p.contains("/blog"), "blog")
        .otherwise("site")
    )


def site_prefix(url: Column, scope: str = "prefix") -> Column:
    """Address that a crawl of ``url`` stays under: its folder, or with scope ``domain`` its host."""
    base = F.concat(_part(url, 1), F.lit("://"), _part(url, 2))
    if scope == "domain":
        return base
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    keep = F.when((host(url) == "sites.google.com") & (F.size(segments) >= 2), F.lit(2)).when(F.size(segments) >= 2, F.size(segments) - 1).otherwise(F.size(segments))
    return F.concat(base, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), keep), "/"))


def post_score(url: Column) -> Column:
    """Score of an address as a post: the first matching good pattern plus the first matching bad one."""
    good = bad = F.lit(0.0)
    for pattern, weight in reversed(POST_PATTERNS):
        good = F.when(url.rlike(f"(?i){pattern}"), F.lit(weight)).otherwise(good)
    for pattern, weight in reversed(OTHER_PATTERNS):
        bad = F.when(url.rlike(f"(?i){pattern}"), F.lit(weight)).otherwise(bad)
    return F.round(good + bad, 6)


def date_from_url(url: Column) -> Column:
    """Day named by an address: /yyyy/mm/dd/, /yyyy-mm-dd, or /yyyy/mm/ as the month's first; null otherwise."""
    ymd = lambda p: F.regexp_replace(F.regexp_extract(url, p, 0), r"[^0-9]+", "")
    day = lambda s: F.try_to_date(F.nullif(s, F.lit("")), "yyyyMMdd")
    month = F.regexp_extract(url, r"/(\d{4}/\d{2})/", 1)
    first = F.when(month != "", F.concat(F.replace(month, F.lit("/")), F.lit("01")))
    return F.coalesce(day(ymd(r"/\d{4}/\d{2}/\d{2}(?:/|$)")), day(ymd(r"/\d{4}-\d{2}-\d{2}")), day(first))
