"""Finding feeds and channels in pages, all native: link tags, conventional paths, channel ids and channel pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import urls as u

# Where a channel's page names its id, in order of trial; types of feed links; conventional feed paths.
CHANNEL_ID = [r'"externalId"\s*:\s*"(UC[A-Za-z0-9_-]+)"', r'"channelId"\s*:\s*"(UC[A-Za-z0-9_-]+)"', r"youtube\.com/channel/(UC[A-Za-z0-9_-]+)"]
CHANNEL_FEED = "https://www.youtube.com/feeds/videos.xml?channel_id="
FEED_TYPES = ["application/rss+xml", "application/atom+xml"]
FEED_PATHS = ["/feed", "/feed.xml", "/rss", "/rss.xml", "/atom.xml"]
PODCAST_PATH = "/podcast/feed"
PODCAST_WORDS = ["podcast", "audio"]
#: What of a channel page's data is read; all else is skipped by the parser.
CHANNEL_DATA = (
    "metadata STRUCT<channelMetadataRenderer: STRUCT<title: STRING>>, contents STRUCT<twoColumnBrowseResultsRenderer: STRUCT<tabs: ARRAY<STRUCT<tabRenderer: STRUCT<content: STRUCT<richGridRenderer: STRUCT<contents: ARRAY<"
    "STRUCT<richItemRenderer: STRUCT<content: STRUCT<lockupViewModel: STRUCT<contentId: STRING, metadata: STRUCT<lockupMetadataViewModel: STRUCT<title: STRUCT<content: STRING>>>>>>>>>>>>>>>"
)


def channel_id(page: Column) -> Column:
    """Id of the channel that a page is about; null where it names none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(page, p, 1), F.lit("")) for p in CHANNEL_ID])


def channel_feed(page: Column) -> Column:
    """Feed address of the channel that a page is about; null where it names none."""
    return F.concat(F.lit(CHANNEL_FEED), channel_id(page))


def channel_videos(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, channel_title, pos, url, title: the videos of channel pages, of the first tab that has any.

    Pages without data, or with data that is no JSON, have no rows.
    """
    data = F.regexp_extract(html, r"(?s)ytInitialData\s*=\s*(\{.+?\})\s*;\s*</script>", 1)
    x = pages.select(key, F.from_json(F.nullif(data, F.lit("")), CHANNEL_DATA).alias("d"))
    videos = lambda t: F.filter(F.transform(t["tabRenderer"]["content"]["richGridRenderer"]["contents"], lambda c: c["richItemRenderer"]["content"]["lockupViewModel"]), lambda v: v["contentId"] != "")
    tabs = F.transform(F.col("d")["contents"]["twoColumnBrowseResultsRenderer"]["tabs"], videos)
    first = F.try_element_at(F.filter(tabs, lambda v: F.size(v) > 0), F.lit(1))
    x = x.select(key, F.col("d")["metadata"]["channelMetadataRenderer"]["title"].alias("channel_title"), F.posexplode(first).alias("pos", "v"))
    title = F.coalesce(F.col("v")["metadata"]["lockupMetadataViewModel"]["title"]["content"], F.lit(""))
    return x.select(key, "channel_title", "pos", F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("v")["contentId"]).alias("url"), title.alias("title"))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, entities decoded; empty where absent."""
    quoted = F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    v = F.regexp_replace(F.regexp_replace(quoted, r"(?i)^\s[a-z]+\s*=\s*", ""), r"""^["']|["']$""", "")
    return reduce(lambda s, e: F.replace(s, F.lit(e[0]), F.lit(e[1])), [("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")], v)


def feed_candidates(pages: DataFrame, key: str, url: str = "url", html: str = "html", prefer: list[str] | None = None) -> DataFrame:
    """key, rank, candidate: where the feed of a page may be, best first.

    Feed links of the page come first, RSS before Atom, those with a preferred
    word in their title before all others; then the conventional paths of the
    host. An address that is a feed itself is the one candidate. A null page
    has the conventional paths only.
    """
    prefer = prefer or []
    tags = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)(<link\b[^>]*>)"), 1)
    links = F.transform(tags, lambda t: F.struct(F.lower(_attribute(t, "rel")).alias("rel"), F.lower(_attribute(t, "type")).alias("type"), _attribute(t, "href").alias("href"), F.lower(_attribute(t, "title")).alias("title")))
    links = F.filter(links, lambda x: F.array_contains(F.split(x.rel, r"\s+"), "alternate") & (x.href != ""))
    of = lambda kind: F.filter(links, lambda x: x.type == kind)
    of_type = F.concat(*map(of, FEED_TYPES))
    wanted = lambda x: reduce(lambda a, b: a | b, [F.contains(x.title, F.lit(w)) for w in prefer], F.lit(False))
    ordered = F.concat(F.filter(of_type, wanted), F.filter(of_type, lambda x: ~wanted(x)))
    base = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    named = F.transform(ordered, lambda x: F.when(x.href.startswith("/"), F.concat(base, x.href)).otherwise(x.href))
    paths = [FEED_PATHS[0], *([PODCAST_PATH] if "podcast" in prefer else []), *FEED_PATHS[1:]]
    every = F.array_distinct(F.concat(named, F.array(*[F.concat(base, F.lit(p)) for p in paths])))
    every = F.when(u.url_type(F.col(url)) == "rss", F.array(F.col(url))).otherwise(every)
    return pages.select(key, F.posexplode(every).alias("rank", "candidate"))


def discover_feeds(candidates: DataFrame, key: str, filled: DataFrame, feed: str = "url") -> DataFrame:
    """key, feed: the best candidate that is among the feeds with entries; keys without one have no row."""
    x = candidates.join(filled.select(F.col(feed).alias("candidate")).distinct(), "candidate", "left_semi")
    return x.groupBy(key).agg(F.min_by("candidate", "rank").alias("feed"))


def feed_kind(url: Column, podcast_feed: Column, rss_feed: Column) -> Column:
    """Kind of a new subscription: youtube for a channel, rss for a feed, podcast where a podcast feed was found, else rss."""
    kind = u.url_type(url)
    return F.when(kind == "youtube_channel", "youtube").when(kind == "rss", "rss").when(podcast_feed.isNotNull(), "podcast").otherwise("rss")
