"""Queries over feeds, mail and logs, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.functions import text as t
from tidewrack.functions import urls as u
from tidewrack.operators import crawl, feeds, store, sync
from tidewrack.operators.upsert import canonical_message_id
from tidewrack.plans.registry import query, table
from tidewrack.plans.text_queries import _DOMAIN, _URLS
from tidewrack.plans.url_queries import sql_norm

# Platforms that send newsletters for others.
PLATFORMS = ["substack.com", "beehiiv.com", "convertkit.com", "buttondown.email", "mailchimp.com", "sendinblue.com", "mailerlite.com", "ghost.org", "revue.email", "getrevue.co"]
_HOSTS = "(SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/]*)', 1)), '^www\\.', '') AS host FROM feeds)"


def _trusted(messages, feed_table):
    """Messages whose sender's domain is a feed's host or below it: domains are exploded to suffixes and equi-joined."""
    hosts = feed_table.select(u.host(F.col("url")).alias("host")).unionByName(feed_table.sparkSession.createDataFrame([(p,) for p in PLATFORMS], "host string"))
    return sync.trusted_messages(messages, hosts)


_TRUST = f"SELECT DISTINCT delivery_id FROM messages, (SELECT host FROM {_HOSTS} UNION SELECT unnest({PLATFORMS!r})) h WHERE {_DOMAIN} = h.host OR ends_with({_DOMAIN}, '.' || h.host)"


@query("trusted_senders", _TRUST)
def trusted_senders(spark, d):
    return _trusted(table(spark, d, "messages"), table(spark, d, "feeds"))


_NEWS = "(length(coalesce(html_body, '')) > 500 OR length(coalesce(text_body, '')) > 500 OR coalesce(map_contains(headers, 'List-Unsubscribe'), false))"


@query("message_classify", f"""WITH tr AS ({_TRUST}), x AS (SELECT m.*, t.delivery_id IS NOT NULL AS trusted, {_NEWS} AS news, len(coalesce({_URLS}, [])) AS n_urls FROM messages m LEFT JOIN tr t USING (delivery_id))
    SELECT CASE WHEN raw_size > 5242880 THEN 'skipped:too_large' WHEN NOT trusted THEN 'skipped:unknown_sender' WHEN NOT news AND n_urls > 0 THEN 'url' WHEN news AND coalesce(html_body, '') <> '' THEN 'newsletter' WHEN coalesce(text_body, '') <> '' AND n_urls > 0 THEN 'url' WHEN news AND coalesce(text_body, '') <> '' THEN 'newsletter_text' ELSE 'skipped:empty' END AS status, count(*) AS n FROM x GROUP BY 1""")  # fmt: skip
def message_classify(spark, d):
    m = table(spark, d, "messages")
    x = m.join(_trusted(m, table(spark, d, "feeds")).withColumn("trusted", F.lit(True)), "delivery_id", "left")
    html, text = F.coalesce("html_body", F.lit("")), F.coalesce("text_body", F.lit(""))
    news = (F.length(html) > 500) | (F.length(text) > 500) | F.coalesce(F.map_contains_key("headers", "List-Unsubscribe"), F.lit(False))
    links = F.coalesce(F.size(t.extract_urls(F.col("text_body"))), F.lit(0)) > 0
    status = (
        F.when(F.col("raw_size") > 5 * 1024 * 1024, "skipped:too_large").when(F.col("trusted").isNull(), "skipped:unknown_sender").when(~news & links, "url").when(news & (html != ""), "newsletter")
        .when((text != "") & links, "url").when(news & (text != ""), "newsletter_text").otherwise("skipped:empty")
    )
    return x.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


_MID = "nullif(trim(regexp_replace(regexp_replace({c}, '\\s', '', 'g'), '^<|>$', '', 'g')), '')"


@query("reply_match", f"SELECT a.delivery_id AS reply_id, min(b.delivery_id) AS delivery_id FROM messages a JOIN messages b ON {_MID.format(c="a.headers['In-Reply-To']")} = {_MID.format(c='b.message_id')} GROUP BY 1")
def reply_match(spark, d):
    """Replies joined to the first delivery of the message they answer."""
    m = table(spark, d, "messages")
    a = m.select(F.col("delivery_id").alias("reply_id"), canonical_message_id(F.try_element_at("headers", F.lit("In-Reply-To"))).alias("mid")).filter("mid is not null")
    b = m.select(canonical_message_id(F.col("message_id")).alias("mid"), "delivery_id").filter("mid is not null").groupBy("mid").agg(F.min("delivery_id").alias("delivery_id"))
    return a.join(b, "mid").select("reply_id", "delivery_id")


@query("page_links", """SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html_body, '(?i)<a\\s[^>]*href="([^"#][^"]*)"', 1)) AS href FROM messages WHERE html_body IS NOT NULL) WHERE NOT regexp_matches(href, '^(?i)(javascript|mailto|tel):') GROUP BY 1""")
def page_links(spark, d):
    x = table(spark, d, "messages").filter("html_body is not null").select(F.explode(F.regexp_extract_all("html_body", F.lit(r'(?i)<a\s[^>]*href="([^"#][^"]*)"'), 1)).alias("href"))
    return x.filter(~F.col("href").rlike("(?i)^(javascript|mailto|tel):")).groupBy("href").agg(F.count(F.lit(1)).alias("n"))


@query("recent_per_feed", "SELECT feed_id, result_id, CAST(k AS INT) AS rank FROM (SELECT feed_id, result_id, row_number() OVER (PARTITION BY feed_id ORDER BY found_at DESC, result_id) AS k FROM feed_results) WHERE k <= 3")
def recent_per_feed(spark, d):
    return sync.newest_per_key(table(spark, d, "feed_results").select("feed_id", "result_id", "found_at"), "feed_id", [F.desc("found_at"), F.asc("result_id")], 3).select("feed_id", "result_id", "rank")


@query("recent_entries", "SELECT result_id, title FROM feed_results ORDER BY found_at DESC, result_id LIMIT 50")
def recent_entries(spark, d):
    return table(spark, d, "feed_results").orderBy(F.desc("found_at"), "result_id").limit(50).select("result_id", "title")


@query("feed_summary", "SELECT f.feed_id, f.name, count(r.result_id) AS entries, count(r.audio_url) AS audio, count(r.content) AS with_content FROM feeds f LEFT JOIN feed_results r USING (feed_id) GROUP BY 1, 2")
def feed_summary(spark, d):
    n = table(spark, d, "feed_results").groupBy("feed_id").agg(F.count(F.lit(1)).alias("entries"), F.count("audio_url").alias("audio"), F.count("content").alias("with_content"))
    x = table(spark, d, "feeds").select("feed_id", "name").join(n, "feed_id", "left")
    return x.na.fill(0, ["entries", "audio", "with_content"])


@query("entry_content_type", "SELECT CASE WHEN f.kind = 'youtube' THEN 'youtube' WHEN r.audio_url IS NOT NULL THEN 'podcast' ELSE 'article' END AS kind, count(*) AS n FROM feed_results r JOIN feeds f USING (feed_id) GROUP BY 1")
def entry_content_type(spark, d):
    x = table(spark, d, "feed_results").select("feed_id", "audio_url").join(table(spark, d, "feeds").select("feed_id", "kind"), "feed_id")
    return x.groupBy(F.when(F.col("kind") == "youtube", "youtube").when(F.col("audio_url").isNotNull(), "podcast").otherwise("article").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("first_sync_cap", """WITH seen AS (SELECT DISTINCT feed_id FROM items WHERE feed_id IS NOT NULL AND batch_id <= 8), r AS (SELECT feed_id, result_id, row_number() OVER (PARTITION BY feed_id ORDER BY found_at DESC, result_id) AS k FROM feed_results)
    SELECT feed_id, result_id FROM r WHERE feed_id IN (SELECT feed_id FROM seen) OR k <= 20""")  # fmt: skip
def first_sync_cap(spark, d):
    """All entries, against the state after eight runs: the feeds of the items stored by then."""
    seen = table(spark, d, "items").filter("feed_id is not null and batch_id <= 8")
    x = table(spark, d, "feed_results").select("feed_id", "result_id", "found_at")
    return sync.first_sync_cap(x, seen, "feed_id", [F.desc("found_at"), F.asc("result_id")]).select("feed_id", "result_id")


@query("seen_and_saved_filter", f"""SELECT result_id FROM feed_results r WHERE url IS NOT NULL AND NOT (EXISTS (SELECT 1 FROM feed_results o WHERE o.batch_id <= 32 AND o.feed_id = r.feed_id AND o.url = r.url)
    AND {sql_norm('r.url')} IN (SELECT {sql_norm('source_url')} FROM items WHERE source_url IS NOT NULL))""")  # fmt: skip
def seen_and_saved_filter(spark, d):
    """All entries, against the state after 32 runs: the addresses seen by then, and all stored items."""
    r = table(spark, d, "feed_results").filter("url is not null")
    x = r.select("result_id", "feed_id", "url", u.normalize_url(F.col("url")).alias("norm"))
    saved = table(spark, d, "items").filter("source_url is not null").select(u.normalize_url(F.col("source_url")).alias("norm")).distinct()
    both = x.join(r.filter("batch_id <= 32").select("feed_id", "url").distinct(), ["feed_id", "url"], "left_semi").join(saved, "norm", "left_semi")
    return x.select("result_id").join(both.select("result_id"), "result_id", "left_anti")


@query("union_prefer_first", f"""WITH a AS (SELECT 'items' AS src, item_id AS id, {sql_norm('source_url')} AS norm FROM items WHERE source_url IS NOT NULL), b AS (SELECT 'feed' AS src, result_id AS id, {sql_norm('url')} AS norm FROM feed_results WHERE url IS NOT NULL)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE norm NOT IN (SELECT norm FROM a) QUALIFY row_number() OVER (PARTITION BY norm ORDER BY id) = 1""")  # fmt: skip
def union_prefer_first(spark, d):
    a = table(spark, d, "items").filter("source_url is not null").select(F.lit("items").alias("src"), F.col("item_id").alias("id"), u.normalize_url(F.col("source_url")).alias("norm"))
    b = table(spark, d, "feed_results").filter("url is not null").select(F.lit("feed").alias("src"), F.col("result_id").alias("id"), u.normalize_url(F.col("url")).alias("norm"))
    return sync.union_prefer_first(a, b, "norm", "id")


_LAST = "(SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'click' GROUP BY 1)"
_STREAK = f"SELECT u.user_id, count(e.user_id) FILTER (WHERE l.last IS NULL OR e.ts > l.last) AS streak FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN {_LAST} l USING (user_id) LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'error') e ON e.user_id = u.user_id GROUP BY 1"


@query("failure_streak", _STREAK)
def failure_streak(spark, d):
    return sync.failure_streaks(table(spark, d, "events"), "user_id", "ts", "event_type", "error", "click")


@query("auto_disable", f"SELECT user_id FROM ({_STREAK}) WHERE streak >= 2")
def auto_disable(spark, d):
    return failure_streak(spark, d).filter("streak >= 2").select("user_id")


@query("evict_last_n", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 50")
def evict_last_n(spark, d):
    return sync.newest_per_key(table(spark, d, "events").select("user_id", "event_id"), "user_id", [F.desc("event_id")], 50).select("user_id", "event_id")


@query("ttl_cleanup", "SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def ttl_cleanup(spark, d):
    return table(spark, d, "events").filter("ts > timestamp_ntz'2024-01-20 00:00:00'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("sync_status", f"SELECT f.feed_id, f.name, CASE WHEN f.disabled THEN 'disabled' WHEN coalesce(s.streak, 0) > 0 THEN 'failing(' || s.streak || ')' ELSE 'OK' END AS health FROM feeds f LEFT JOIN ({_STREAK}) s ON s.user_id = f.feed_id")
def sync_status(spark, d):
    x = table(spark, d, "feeds").join(failure_streak(spark, d).withColumnRenamed("user_id", "feed_id"), "feed_id", "left")
    return x.select("feed_id", "name", F.when(F.col("disabled"), "disabled").when(F.coalesce("streak", F.lit(0)) > 0, F.format_string("failing(%d)", "streak")).otherwise("OK").alias("health"))


_EDGES = "(SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS dst FROM lineitem)"


@query("bfs_reachable", f"""WITH RECURSIVE e AS MATERIALIZED {_EDGES}, r(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 4)
    SELECT node, min(depth) AS depth FROM r GROUP BY 1""")  # fmt: skip
def bfs_reachable(spark, d):
    """Suppliers within four links of the first, over every edge."""
    n = table(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0]
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n + 1).alias("dst")).distinct()
    return crawl.reach(links, spark.createDataFrame([(1,)], "node bigint"), 4)


@query("digest_topics", """SELECT batch_id, topic, count(*) AS size, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY count(*) DESC, min(item_id), topic) AS INT) AS rank FROM (SELECT batch_id, item_id, unnest(tags) AS topic FROM items WHERE tags IS NOT NULL)
    GROUP BY 1, 2 QUALIFY rank <= 5""")  # fmt: skip
def digest_topics(spark, d):
    """The five topics with most items of every batch."""
    return sync.batch_topics(table(spark, d, "items"))


@query("reply_conflicts", "SELECT coalesce(a.sender, b.sender) AS sender, a.ids AS chosen, b.ids AS skipped FROM (SELECT sender, list_sort(list(DISTINCT batch_id)) AS ids FROM messages WHERE raw_size % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT m.sender, list_sort(list(DISTINCT m.batch_id)) AS ids FROM messages m WHERE raw_size % 2 = 1 AND NOT EXISTS (SELECT 1 FROM messages o WHERE o.sender = m.sender AND o.batch_id = m.batch_id AND o.raw_size % 2 = 0) GROUP BY 1) b ON a.sender = b.sender")
def reply_conflicts(spark, d):
    """Set union per key, and the other set less the first."""
    m = table(spark, d, "messages").select("sender", "batch_id", "raw_size")
    both = m.groupBy("sender", "batch_id").agg(F.bool_or(F.col("raw_size") % 2 == 0).alias("chosen"))
    pick = lambda c: F.nullif(F.array_sort(F.collect_set(F.when(c, F.col("batch_id")))), F.array().cast("array<int>"))
    return both.groupBy("sender").agg(pick(F.col("chosen")).alias("chosen"), pick(~F.col("chosen")).alias("skipped"))


@query("log_recent", "SELECT user_id, count(*) AS entries, CAST(max(event_id) AS BIGINT) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5 GROUP BY 1")
def log_recent(spark, d):
    x = sync.newest_per_key(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 5)
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("entries"), F.max("event_id").alias("last_id"))


_RSS = """<rss><channel><title>t</title><item><title>Old</title><link>https://a.example/1</link><description>&lt;p&gt;Plain &lt;b&gt;text&lt;/b&gt;&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>Talk</title><enclosure url="https://a.example/2.mp3" type="audio/mpeg"/><pubDate>Wed, 03 Jan 2024 10:00:00 GMT</pubDate><itunes:duration>00:30:00</itunes:duration></item><item><title>No link</title></item></channel></rss>"""
_ATOM = """<feed><entry><title>Note</title><link href="https://b.example/n" rel="alternate"/><published>2024-02-29T08:00:00Z</published><summary>short</summary></entry><entry><link href="https://b.example/m"/></entry></feed>"""
_ENTRIES = "(VALUES (1, 0, 'Old', 'https://a.example/1', DATE '2024-01-02', 'article', 'Plain text'), (1, 1, 'Talk', 'https://a.example/2.mp3', DATE '2024-01-03', 'audio', ''), (2, 0, 'Note', 'https://b.example/n', DATE '2024-02-29', 'article', 'short'), (2, 1, 'Untitled', 'https://b.example/m', NULL, 'article', '')) v(feed_id, pos, title, url, day, type, description)"


@query("feed_entries", f"SELECT * FROM {_ENTRIES}")
def feed_entries(spark, d):
    x = spark.createDataFrame([(1, _RSS), (2, _ATOM)], "feed_id int, xml string")
    return feeds.newest_first(feeds.feed_entries(x)).select("feed_id", "pos", "title", "url", "day", "type", "description")


@query("audio_entries", f"SELECT feed_id, url FROM {_ENTRIES} WHERE type = 'audio'")
def audio_entries(spark, d):
    return feed_entries(spark, d).filter("type = 'audio'").select("feed_id", "url")


@query("sitemap_urls", "SELECT * FROM (VALUES ('https://a.example/x'), ('https://a.example/y?z=1')) v(url)")
def sitemap_urls(spark, d):
    return feeds.sitemap_urls(spark.createDataFrame([("<urlset><url><loc> https://a.example/x </loc></url><url><loc>https://a.example/y?z=1</loc></url><loc></loc></urlset>",)], "xml string"))


@query("robots_allowed", "SELECT * FROM (VALUES ('https://a.example/private/x', false), ('https://a.example/private/open/y', true), ('https://a.example/', true), ('https://b.example/private', true)) v(url, allowed)")
def robots_allowed(spark, d):
    rules = feeds.robots_rules(spark.createDataFrame([("a.example", "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private # not for robots\nAllow: /private/open\nDisallow:\n")], "host string, text string"))
    urls = spark.createDataFrame([("https://a.example/private/x",), ("https://a.example/private/open/y",), ("https://a.example/",), ("https://b.example/private",)], "url string")
    return feeds.robots_allowed(urls, rules)


@query("log_tail", "SELECT 'h' || chr(10) || '## [2] b' || chr(10) || '## [3] c' AS tail")
def log_tail(spark, d):
    return store.log_tail(spark.createDataFrame([("h\n## [1] a\n## [2] b\n## [3] c",)], "text string"), 2).select("tail")
