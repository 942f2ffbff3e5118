"""Which extractor a source goes to, and the texts to take from what the extractors gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import urls as u

#: An article shorter than this is taken for a failed extraction.
LEAST_ARTICLE = 200


def route(url: Column) -> Column:
    """captions, speech, feed, page or file: the extractor of a source by its type."""
    kind = u.url_type(url)
    return F.when(kind == "youtube", "captions").when(kind.isin("audio_file", "video"), "speech").when(kind.isin("rss", "youtube_channel"), "feed").when(kind == "local_file", "file").otherwise("page")


def article_first(article: Column, page: Column, least: int = LEAST_ARTICLE) -> Column:
    """The article's text, or the page's where the article failed or is shorter than ``least`` characters."""
    shown = F.regexp_replace(article, r"^\s+|\s+$", "")
    return F.when(article.isNotNull() & (F.length(shown) >= least), article).otherwise(page)


def expand_feeds(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """url, via, extractor: sources with feeds replaced by their entries, each routed by itself.

    ``entries`` have feed (the feed's address) and url. An entry that is a feed
    again is not opened; feeds without entries have no row.
    """
    x = sources.select("url").distinct().withColumn("extractor", route(F.col("url")))
    opened = x.filter("extractor = 'feed'").select(F.col("url").alias("via")).join(entries.select(F.col("feed").alias("via"), "url").filter("url is not null").distinct(), "via")
    direct = x.filter("extractor <> 'feed'").select("url", F.lit(None).cast("string").alias("via"), "extractor")
    return direct.unionByName(opened.withColumn("extractor", route(F.col("url"))).filter("extractor <> 'feed'"))
