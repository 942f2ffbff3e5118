"""Feed, sitemap and robots parsing with explicit schemas, and feed projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.dates import parse_written_date
from tidewrack.functions.text import strip_html

#: Declared, never inferred: inference takes durations for times and one link for a struct.
RSS_ITEM = "title STRING, link STRING, description STRING, pubDate STRING, author STRING, guid STRING, enclosure ARRAY<STRUCT<_url: STRING, _type: STRING>>, `itunes:duration` STRING"
ATOM_ENTRY = "title STRING, link ARRAY<STRUCT<_href: STRING, _rel: STRING>>, id STRING, published STRING, updated STRING, summary STRING, content STRUCT<_VALUE: STRING, _type: STRING>, author STRUCT<name: STRING>"
AUDIO_SUFFIX = r"\.(mp3|m4a|ogg|wav)$"


def _items(xml: Column, tag: str) -> Column:
    """The elements ``tag`` of a document as strings; an element left open is not one."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)(<{tag}[ >].*?</{tag}>)"), 1)


def feed_entries(feeds: DataFrame, xml: str = "xml", key: str = "feed_id") -> DataFrame:
    """key, pos, title, url, day, author, type, audio_url, duration, description: one row per RSS item or Atom entry.

    ``url`` is the page, or the audio where there is no page; the first audio
    enclosure (by type or file name) is ``audio_url``. Entries without either
    drop out. Malformed items drop out singly, so a broken feed keeps its good
    ones. Positions count from 0 in document order, RSS before Atom.
    """
    rss = feeds.select(key, F.posexplode(_items(F.col(xml), "item")).alias("pos", "x"))
    rss = rss.withColumn("e", F.from_xml("x", RSS_ITEM, {"mode": "PERMISSIVE"}))
    audio = F.filter("e.enclosure", lambda c: F.coalesce(c["_type"].startswith("audio/"), F.lit(False)) | F.coalesce(c["_url"].rlike(AUDIO_SUFFIX), F.lit(False)))
    rss = rss.select(key, "pos", F.col("e.title"), F.nullif(F.trim("e.link"), F.lit("")).alias("page"), F.try_element_at(audio, F.lit(1))["_url"].alias("audio_url"), F.col("e.pubDate").alias("written"), "e.author", F.col("e.`itunes:duration`").alias("duration"), F.col("e.description").alias("about"))
    atom = feeds.select(key, F.posexplode(_items(F.col(xml), "entry")).alias("pos", "x"))
    atom = atom.withColumn("e", F.from_xml("x", ATOM_ENTRY, {"mode": "PERMISSIVE"}))
    rel = lambda r: F.try_element_at(F.filter("e.link", lambda c: F.coalesce(c["_rel"], F.lit("alternate")) == r), F.lit(1))["_href"]
    sound = F.try_element_at(F.filter("e.link", lambda c: (c["_rel"] == "enclosure") & c["_href"].rlike(AUDIO_SUFFIX)), F.lit(1))["_href"]
    atom = atom.select(key, "pos", F.col("e.title"), rel("alternate").alias("page"), sound.alias("audio_url"), F.coalesce("e.published", "e.updated").alias("written"), F.col("e.author.name").alias("author"), F.lit(None).cast("string").alias("duration"), F.coalesce("e.summary", "e.content._VALUE").alias("about"))
    x = rss.unionByName(atom).withColumn("url", F.coalesce("page", "audio_url")).filter("url is not null")
    kind = F.when(F.col("audio_url").isNotNull(), "audio").otherwise("article")
    return x.select(key, "pos", F.coalesce("title", F.lit("Untitled")).alias("title"), "url", parse_written_date(F.col("written")).day.alias("day"), "author", kind.alias("type"), "audio_url", "duration", strip_html(F.coalesce("about", F.lit(""))).alias("description"))


def newest_first(entries: DataFrame, recent: int | None = None) -> DataFrame:
    """Entries newest first, undated last, ties in feed order; at most ``recent`` of them."""
    x = entries.orderBy(F.col("day").desc_nulls_last(), "pos")
    return x if recent is None else x.limit(recent)


def sitemap_urls(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """url of every ``<loc>``, without outer white space, entities decoded."""
    x = pages.select(F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), 1)).alias("url")).filter("url <> ''")
    return x.select(reduce(lambda s, e: F.replace(s, F.lit(e[0]), F.lit(e[1])), [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")], F.col("url")).alias("url"))


def robots_rules(files: DataFrame, host: str = "host", text: str = "text", agent: str = "*") -> DataFrame:
    """host, rules: the rules (allow, prefix) of a robots file for ``agent``, or for all where it names the agent nowhere.

    A group is a run of agent lines and the rules below it; several agents may
    share one. An empty Disallow allows all and makes no rule.
    """
    lines = F.transform(F.split(F.regexp_replace(text, r"[ \t]*#[^\n]*", ""), r"\r?\n|\r"), lambda l: F.struct(F.lower(F.trim(F.substring_index(l, ":", 1))).alias("k"), F.trim(F.regexp_extract(l, r"^[^:]*:(.*)$", 1)).alias("v")))
    known = F.filter(lines, lambda x: x.k.isin("user-agent", "allow", "disallow"))
    # an agent line below a rule opens a new group
    mark = lambda x, i: F.when((x.k == "user-agent") & (i > 0) & (F.col("l")[F.greatest(i - 1, F.lit(0))].k != "user-agent"), 1).otherwise(0)
    x = files.select(host, F.explode(F.array(known)).alias("l"))
    x = x.withColumn("g", F.transform("l", lambda y, i: F.struct(y.k.alias("k"), y.v.alias("v"), mark(y, i).alias("m"))))
    x = x.select(host, F.posexplode("g").alias("pos", "y"))
    w = Window.partitionBy(host).orderBy("pos")  # a robots file is one bounded text
    x = x.select(host, "y.k", "y.v", F.sum("y.m").over(w).alias("group"))
    rule = F.when(F.col("k").isin("allow", "disallow") & (F.col("v") != ""), F.struct((F.col("k") == "allow").alias("allow"), F.col("v").alias("prefix")))
    groups = x.groupBy(host, "group").agg(F.collect_set(F.when(F.col("k") == "user-agent", F.lower("v"))).alias("agents"), F.collect_list(rule).alias("rules"))
    groups = groups.select(host, F.explode("agents").alias("who"), "rules").filter(F.col("who").isin(agent.lower(), "*"))
    named = groups.groupBy(host).agg(F.flatten(F.collect_list(F.when(F.col("who") == agent.lower(), F.col("rules")))).alias("own"), F.flatten(F.collect_list(F.when(F.col("who") == "*", F.col("rules")))).alias("all"), F.bool_or(F.col("who") == agent.lower()).alias("has"))
    return named.select(host, F.when(F.col("has"), F.col("own")).otherwise(F.col("all")).alias("rules"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` with ``allowed``: the longest matching prefix decides, allow wins a tie, no rule allows.

    Rules are one array a host, joined once; each row is decided by itself, so
    repeated addresses stay repeated.
    """
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    p = F.when(path == "", "/").otherwise(path)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    x = urls.withColumns({"__host": host, "__path": p}).join(rules.select(F.col("host").alias("__host"), F.col("rules").alias("__rules")), "__host", "left")
    hits = F.transform(F.filter("__rules", lambda r: F.col("__path").startswith(r.prefix)), lambda r: F.struct(F.length(r.prefix).alias("n"), r.allow.alias("allow")))
    return x.withColumn("allowed", F.coalesce(F.array_max(hits)["allow"], F.lit(True))).select(*urls.columns, "allowed")
