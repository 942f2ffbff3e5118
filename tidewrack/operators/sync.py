"""Incremental collection: seen sets, caps, retention, priority unions, streaks, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.text import domain_suffixes, preview, sender_domain, strip_fence
from tidewrack.session import staged


def newest_per_key(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key in ``order``; a group limit runs before the shuffle, so a hot key sends k rows per map task."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_sync_cap(entries: DataFrame, seen: DataFrame, key: str, order: list[Column], cap: int = 20) -> DataFrame:
    """Entries of keys that are new (not in ``seen``) are cut to the newest ``cap``; others pass whole."""
    known = seen.select(key).distinct()
    old = entries.join(known, key, "left_semi").withColumn("rank", F.lit(None).cast("int"))
    return old.unionByName(newest_per_key(entries.join(known, key, "left_anti"), key, order, cap))


def unseen(entries: DataFrame, seen: DataFrame, saved: DataFrame, seen_on: list[str], saved_on: list[str]) -> DataFrame:
    """Entries that are not both seen and saved."""
    both = entries.join(seen, seen_on, "left_semi").join(saved, saved_on, "left_semi")
    return entries.exceptAll(both)


def union_prefer_first(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """All rows of ``first``, and of ``second`` the first row by ``order`` of each key that ``first`` lacks."""
    fresh = second.join(first.select(key).distinct(), key, "left_anti")
    kept = fresh.groupBy(key).agg(F.min_by(F.struct(*fresh.columns), order).alias("r")).select("r.*")
    return first.unionByName(kept)


def failure_streaks(log: DataFrame, key: str, at: str, kind: str, failure: str, success: str) -> DataFrame:
    """key, streak: failures since the last success. Ties in time count as before it."""
    last = log.filter(F.col(kind) == success).groupBy(key).agg(F.max(at).alias("last"))
    x = log.filter(F.col(kind) == failure).select(key, at).join(last, key, "left")
    n = x.groupBy(key).agg(F.count_if(F.col("last").isNull() | (F.col(at) > F.col("last"))).alias("streak"))
    return log.select(key).distinct().join(n, key, "left").select(key, F.coalesce("streak", F.lit(0)).alias("streak"))


def topic_groups(items: DataFrame, assignment: DataFrame, most: int = 5) -> DataFrame:
    """topic, size, first_number: the ``most`` largest topics; numbers out of range and empty topics drop out, ties keep the order of first mention."""
    x = assignment.join(items, "number", "inner")
    return x.groupBy("topic").agg(F.count(F.lit(1)).alias("size"), F.min("pos").alias("first_pos")).orderBy(F.desc("size"), "first_pos", "topic").limit(most)


def numbered(df: DataFrame, group: str, order: str) -> DataFrame:
    """``df`` with ``number``: 1, 2, ... within each ``group`` (null is one) in ``order``.

    Two-level: rows are split by range, counted per group and slice, and
    numbered within a slice, so no task holds a group.
    """
    x = staged(df.repartitionByRange(group, order).withColumn("__slice", F.spark_partition_id()), "numbered")
    n = x.groupBy(group, "__slice").agg(F.count(F.lit(1)).alias("n"))
    before = n.select(F.col(group).alias("__group"), F.col("__slice").alias("__at"), (F.sum("n").over(Window.partitionBy(group).orderBy("__slice")) - F.col("n")).alias("__before"))
    x = x.withColumn("__here", F.row_number().over(Window.partitionBy(group, "__slice").orderBy(order)))
    x = x.join(before, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__slice") == F.col("__at")))
    return x.select(*df.columns, (F.col("__before") + F.col("__here")).cast("int").alias("number"))


def digest_bodies(items: DataFrame) -> DataFrame:
    """batch_id, items, body: one numbered digest a batch; a digest is one text."""
    x = numbered(items.select("batch_id", "item_id", "content_type", F.coalesce("title", F.lit("Untitled")).alias("title")), "batch_id", "item_id")
    line = F.concat(F.col("number").cast("string"), F.lit(". "), "title", F.lit(" ("), "content_type", F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("number", line.alias("line"))))
    return x.groupBy("batch_id").agg(F.count(F.lit(1)).alias("items"), F.array_join(F.transform(rows, lambda r: r.line), "\n").alias("body"))


def batch_topics(items: DataFrame, most: int = 5) -> DataFrame:
    """batch_id, topic, size, rank: the topics with most items of every batch; of equal ones the one that comes first, then by name."""
    x = items.select("batch_id", "item_id", F.explode("tags").alias("topic")).groupBy("batch_id", "topic").agg(F.count(F.lit(1)).alias("size"), F.min("item_id").alias("first"))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("size"), "first", "topic")))
    return x.filter(F.col("rank") <= most).select("batch_id", "topic", "size", "rank")


def first_sync_rest(entries: DataFrame, seen: DataFrame, key: str, order: list[Column], cap: int = 20) -> DataFrame:
    """The other output of ``first_sync_cap``: entries of new keys beyond the newest ``cap``, to be marked as seen."""
    fresh = entries.join(seen.select(key).distinct(), key, "left_anti")
    kept = newest_per_key(fresh, key, order, cap).select(*entries.columns)
    return fresh.exceptAll(kept)


def default_cap(kind: Column, recent: int | None = None) -> Column:
    """How many entries of a feed are listed: ``recent``, else 15 for youtube and 50 for others."""
    return F.lit(recent) if recent is not None else F.when(kind == "youtube", 15).otherwise(50)


def entry_type(kind: Column, audio: Column) -> Column:
    """Content type of an entry by the kind of its feed and whether it has audio."""
    return F.when(kind == "youtube", "youtube").when(audio.isNotNull(), "podcast").otherwise("article")


def check_feeds(feeds: DataFrame, entries: DataFrame, seen: DataFrame, saved: DataFrame, order: list[Column], cap: int = 20) -> tuple[DataFrame, DataFrame]:
    """(results, marks) of looking at all feeds that are not disabled.

    ``entries`` have feed_id, entry_id, url, norm_url and audio_url; ``seen``
    feed_id and url; ``saved`` norm_url. Feeds that nothing was seen of give
    their newest ``cap`` entries only. An entry is left out if its address was
    seen in the feed and its page is saved. ``marks`` are the addresses that
    are seen from now on, those beyond the cap among them.
    """
    live = feeds.filter(~F.coalesce("disabled", F.lit(False))).select("feed_id", "kind")
    x = staged(entries.filter("url is not null").join(live, "feed_id"), "feed-entries")
    capped = first_sync_cap(x, seen, "feed_id", order, cap).drop("rank")
    old = x.select("entry_id", "feed_id", "url", "norm_url").join(seen.select("feed_id", "url").distinct(), ["feed_id", "url"], "left_semi").join(saved.select("norm_url").distinct(), "norm_url", "left_semi")
    results = capped.join(old.select("entry_id"), "entry_id", "left_anti").withColumn("content_type", entry_type(F.col("kind"), F.col("audio_url")))
    marks = results.select("feed_id", "url").unionByName(first_sync_rest(x.select("feed_id", "entry_id", "url", *_names(order, x)), seen, "feed_id", order, cap).select("feed_id", "url")).distinct()
    return results, marks


def _names(order: list[Column], df: DataFrame) -> list[str]:
    """Columns of ``df`` that an order may need, besides the keys of an entry."""
    return [c for c in df.columns if c not in ("feed_id", "entry_id", "url", "kind", "norm_url", "audio_url")]


# Mail beyond this size is not read; text beyond this length makes a newsletter; addresses taken from one mail.
MAX_MAIL, LONG_TEXT, MAIL_URLS = 5 * 1024 * 1024, 500, 3


def mail_status(size: Column, trusted: Column, html: Column, text: Column, urls: Column, listed: Column) -> Column:
    """What a message gives: skipped:..., url, newsletter or newsletter_text."""
    html, text = F.coalesce(html, F.lit("")), F.coalesce(text, F.lit(""))
    news = (F.length(html) > LONG_TEXT) | (F.length(text) > LONG_TEXT) | F.coalesce(listed, F.lit(False))
    links = F.coalesce(F.size(urls), F.lit(0)) > 0
    return (
        F.when(size > MAX_MAIL, "skipped:too_large").when(~F.coalesce(trusted, F.lit(False)), "skipped:unknown_sender").when(~news & links, "url").when(news & (html != ""), "newsletter")
        .when((text != "") & links, "url").when(news & (text != ""), "newsletter_text").otherwise("skipped:empty")
    )


def message_items(messages: DataFrame, status: str, urls: str, skip_senders: list[str] | None = None) -> DataFrame:
    """delivery_id, kind, url, skip_synthesis: what each message gives, the first three addresses or the mail itself.

    Mail itself has no address. ``skip_senders`` are addresses, in lower case,
    whose items are set aside.
    """
    address = F.lower(F.regexp_extract(F.regexp_replace("sender", r"^.*<([^<>]*)>.*$", "$1"), r"(\S+@\S+)", 1))
    targets = F.when(F.col(status) == "url", F.slice(urls, 1, MAIL_URLS)).otherwise(F.array(F.lit(None).cast("string")))
    skip = address.isin(*skip_senders) if skip_senders else F.lit(False)
    return messages.filter(~F.col(status).startswith("skipped:")).select("delivery_id", F.col(status).alias("kind"), F.explode(targets).alias("url"), skip.alias("skip_synthesis"))


def match_replies(messages: DataFrame, digests: DataFrame, sender: Column) -> DataFrame:
    """delivery_id, digest_id: messages of the expected ``sender`` with the digest they answer.

    The identifier in In-Reply-To decides (``reply_to`` against ``mid``); else
    the first digest whose subject the message's subject contains, apart from
    reply marks. ``digests`` is the bounded history of what was sent
    (digest_id, mid, subject).
    """
    x = messages.filter(sender).select("delivery_id", "reply_to", F.regexp_replace(F.lower(F.coalesce("subject", F.lit(""))), r"re: ?", "").alias("__subject"))
    by_id = x.join(digests.filter("mid is not null").groupBy(F.col("mid").alias("reply_to")).agg(F.min("digest_id").alias("digest_id")), "reply_to").select("delivery_id", "digest_id")
    rest = x.join(by_id, "delivery_id", "left_anti")
    # a history of a few digests in every row, rather than a join of all with all
    history = digests.filter("subject <> ''").agg(F.array_sort(F.collect_list(F.struct("digest_id", F.lower("subject").alias("subject")))).alias("h")).first().h  # ROLLING rows at most
    known = F.array(*[F.struct(F.lit(r.digest_id).alias("digest_id"), F.lit(r.subject).alias("subject")) for r in history]) if history else None
    if known is None:
        return by_id
    hit = F.try_element_at(F.filter(known, lambda d: F.contains(F.col("__subject"), d["subject"])), F.lit(1))["digest_id"]
    return by_id.unionByName(rest.select("delivery_id", hit.alias("digest_id")).filter("digest_id is not null"))


ACTIONS = "array<struct<type: string, items: array<string>, url: string, name: string, kind: string>>"


def decode_actions(replies: DataFrame, key: str, response: str = "response", item_map: str = "item_map") -> DataFrame:
    """key, pos, type, path, url, name, kind: the actions of replies, one row per item of a list.

    ``response`` is JSON, with or without a code fence around it; what is no
    JSON has no actions. Numbers become paths through ``item_map``; unknown
    ones drop out, and so do lists without a known one and types not known.
    """
    x = replies.select(key, item_map, F.posexplode(F.from_json(strip_fence(F.col(response)), ACTIONS)).alias("pos", "a"))
    lists = x.filter(F.col("a.type").isin("synthesize", "skip")).select(key, "pos", "a.type", F.explode("a.items").alias("number"), item_map)
    lists = lists.select(key, "pos", "type", F.try_element_at(item_map, F.col("number")).alias("path")).filter("path is not null")
    none = lambda c: F.lit(None).cast("string").alias(c)
    feeds = x.filter(F.col("a.type").isin("add_feed", "remove_feed"))
    empty = lambda c, other="": F.coalesce(F.col(f"a.{c}"), F.lit(other)).alias(c)
    feeds = feeds.select(key, "pos", "a.type", none("path"), empty("url"), empty("name"), F.when(F.col("a.type") == "add_feed", F.coalesce("a.kind", F.lit("rss"))).alias("kind"))
    return lists.select(key, "pos", "type", "path", none("url"), none("name"), none("kind")).unionByName(feeds)


def resolve_actions(actions: DataFrame, key: str) -> DataFrame:
    """key, type, path: items to synthesize and to skip; what is in both is synthesized only. One row per item."""
    x = actions.filter("path is not null").groupBy(key, "path").agg(F.bool_or(F.col("type") == "synthesize").alias("chosen"))
    return x.select(key, F.when(F.col("chosen"), "synthesize").otherwise("skip").alias("type"), "path")


def digest_entry(head: Column, url: Column, kind: Column, words: Column, preview: Column) -> Column:
    """An entry of a digest file."""
    shown = F.when(preview != "", F.concat(F.lit("- Preview: "), preview))
    return F.concat_ws("\n", F.concat(F.lit("## "), head), F.concat(F.lit("- Source: "), F.coalesce(url, F.lit(""))), F.concat(F.lit("- Type: "), kind, F.lit(" | Words: "), words.cast("string")), shown, F.lit(""))


def digest_files(items: DataFrame, most: int = 5, few: int = 2) -> DataFrame:
    """batch_id, file, place, entry: the files of every digest as their entries in order.

    A batch of at most ``few`` items has one file, its items numbered; others
    have a file for each of their ``most`` largest topics. An item is in the
    file of each of its topics.
    """
    x = items.select("batch_id", "item_id", F.coalesce("title", F.lit("Untitled")).alias("title"), "source_url", "content_type", "word_count", preview(F.col("text")).alias("preview"), "tags")
    size = x.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    sized = x.join(size, "batch_id")
    entry = lambda head: digest_entry(head, F.col("source_url"), F.col("content_type"), F.col("word_count"), F.col("preview")).alias("entry")
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("item_id"))  # few items
    flat = sized.filter(F.col("n") <= few).withColumn("place", place).select("batch_id", F.lit("digest.md").alias("file"), "place", entry(F.concat(F.col("place").cast("string"), F.lit(". "), "title")))
    many = sized.filter(F.col("n") > few)
    topics = batch_topics(many, most).select("batch_id", "topic")
    listed = many.withColumn("topic", F.explode("tags")).join(topics, ["batch_id", "topic"])
    listed = numbered(listed.select("item_id", F.concat_ws("\u0001", F.col("batch_id").cast("string"), "topic").alias("__file"), "batch_id", "topic", entry(F.col("title"))), "__file", "item_id")
    name = F.concat(F.substring(F.replace(F.lower("topic"), F.lit(" "), F.lit("-")), 1, 30), F.lit(".md"))
    return flat.unionByName(listed.select("batch_id", name.alias("file"), F.col("number").alias("place"), "entry"))


def trusted_messages(messages: DataFrame, hosts: DataFrame, skip_senders: list[str] | None = None) -> DataFrame:
    """delivery_id of messages whose sender's domain is in ``hosts`` (column host) or below one, or whose address is in ``skip_senders``.

    Domains are exploded to their suffixes and equi-joined.
    """
    x = messages.select("delivery_id", F.explode(domain_suffixes(sender_domain(F.col("sender")))).alias("host"))
    found = x.join(hosts.select("host").distinct(), "host", "left_semi").select("delivery_id")
    if skip_senders:
        address = F.lower(F.regexp_extract(F.regexp_replace("sender", r"^.*<([^<>]*)>.*$", "$1"), r"(\S+@\S+)", 1))
        found = found.unionByName(messages.filter(address.isin(*[s.lower() for s in skip_senders])).select("delivery_id"))
    return found.distinct()


def not_older_than(df: DataFrame, at: str, days: int) -> DataFrame:
    """Rows at most ``days`` before the latest of all: the bound on late data of a batch run."""
    latest = df.agg(F.max(at)).first()[0]  # one value
    return df.filter(F.col(at) >= F.lit(latest) - F.expr(f"interval {days} days")) if latest is not None else df
