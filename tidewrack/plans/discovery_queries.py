"""Queries over feed discovery, crawls and routing. Pages are put together from the rows of tables, so the SQL knows what is in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.functions import urls as u
from tidewrack.operators import crawl, discovery, feeds, routing
from tidewrack.plans.registry import query, table
from tidewrack.plans.url_queries import _sql_prefix, sql_score, sql_type

_UC = "'UC' || feed_id || '_x'"


@query("channel_feeds", f"SELECT feed_id, CASE WHEN feed_id % 4 < 3 THEN {_UC} END AS channel, CASE WHEN feed_id % 4 < 3 THEN 'https://www.youtube.com/feeds/videos.xml?channel_id=' || {_UC} END AS feed FROM feeds")
def channel_feeds(spark, d):
    """Channel pages that name their id in each of the usual ways, or not at all."""
    uc = F.concat(F.lit("UC"), F.col("feed_id").cast("string"), F.lit("_x"))
    ways = [('<script>{"externalId": "', '", "channelId":"UCother"}</script>'), ('<a href="https://www.youtube.com/channel/UCother"></a>{"channelId" : "', '"}'), ('<link rel="canonical" href="https://www.youtube.com/channel/', '">')]
    page = F.lit("<title>no id</title>")
    for k, (a, b) in enumerate(ways):
        page = F.when(F.col("feed_id") % 4 == k, F.concat(F.lit(a), uc, F.lit(b))).otherwise(page)
    return table(spark, d, "feeds").select("feed_id", discovery.channel_id(page).alias("channel"), discovery.channel_feed(page).alias("feed"))


@query("channel_videos", """SELECT result_id % 997 AS page, 'https://www.youtube.com/watch?v=v' || result_id AS url, coalesce(title, '') AS title FROM feed_results""")
def channel_videos(spark, d):
    """Channel pages made of the rows of feed_results; the first tab has no videos, and the third is not read."""
    video = lambda i, title: F.struct(F.struct(F.struct(F.struct(i.alias("contentId"), F.struct(F.struct(F.struct(title.alias("content")).alias("title")).alias("lockupMetadataViewModel")).alias("metadata")).alias("lockupViewModel")).alias("content")).alias("richItemRenderer"))
    r = table(spark, d, "feed_results").select((F.col("result_id") % 997).alias("page"), video(F.concat(F.lit("v"), F.col("result_id").cast("string")), F.col("title")).alias("x"))
    tab = lambda xs: F.struct(F.struct(F.struct(F.struct(xs.alias("contents")).alias("richGridRenderer")).alias("content")).alias("tabRenderer"))
    # 997 pages of some rows each
    p = r.groupBy("page").agg(F.collect_list("x").alias("xs"))
    p = p.select("page", F.to_json(F.struct(F.struct(F.struct(F.array(tab(F.slice("xs", 1, 0)), tab(F.col("xs")), tab(F.slice("xs", 1, 1))).alias("tabs")).alias("twoColumnBrowseResultsRenderer")).alias("contents"))).alias("j"))
    p = p.select("page", F.concat(F.lit("<script>var ytInitialData = "), "j", F.lit(";</script>")).alias("html"))
    return discovery.channel_videos(p, "page").select("page", "url", "title")


_BASE = "regexp_extract(url, '^([a-z]+://[^/]*)', 1)"


@query("feed_discovery", f"""WITH f AS (SELECT feed_id, {_BASE} || '/about' AS page, {_BASE} AS base FROM feeds), full_ AS (SELECT DISTINCT feed_id FROM feed_results)
    SELECT feed_id, CASE WHEN feed_id % 3 = 0 THEN base || '/shows/' || feed_id WHEN feed_id % 3 = 1 THEN base || '/atom/' || feed_id ELSE base || '/rss.xml' END AS feed FROM f WHERE feed_id IN (SELECT feed_id FROM full_)""")  # fmt: skip
def feed_discovery(spark, d):
    """The feed of every page: a preferred link, a link that others beat only by being empty, or a conventional path."""
    f = table(spark, d, "feeds").select("feed_id", F.regexp_extract("url", r"^([a-z]+://[^/]*)", 1).alias("base"))
    link = lambda kind, href, title: F.concat(F.lit(f"<link title='{title}' rel=\"alternate\" type=\"application/{kind}+xml\" href=\""), href, F.lit('">'))
    n = F.col("feed_id").cast("string")
    both = F.concat(link("atom", F.concat(F.lit("/atom/"), n), "Notes"), link("rss", F.concat(F.lit("/empty/"), n), "All"))
    html = F.when(F.col("feed_id") % 3 == 0, F.concat(both, link("rss", F.concat("base", F.lit("/shows/"), n), "The Podcast"))).when(F.col("feed_id") % 3 == 1, both)
    pages = f.select("feed_id", "base", F.concat("base", F.lit("/about")).alias("url"), html.alias("html"))
    filled = F.when(F.col("feed_id") % 3 == 0, F.array(F.concat("base", F.lit("/atom/"), n), F.concat("base", F.lit("/shows/"), n))).when(F.col("feed_id") % 3 == 1, F.array(F.concat("base", F.lit("/atom/"), n))).otherwise(F.array(F.concat("base", F.lit("/rss.xml"))))
    # feeds that have entries
    have = table(spark, d, "feed_results").select("feed_id").distinct()
    filled = f.join(have, "feed_id", "left_semi").select("feed_id", F.explode(filled).alias("url"))
    found = discovery.feed_candidates(pages, "feed_id", prefer=discovery.PODCAST_WORDS)
    # the host of a page is shared by feeds in the data, so a feed counts for its own page only
    mine = found.join(filled.select("feed_id", F.col("url").alias("candidate")), ["feed_id", "candidate"], "left_semi")
    return discovery.discover_feeds(mine, "feed_id", filled)


@query("source_routes", f"""WITH s AS (SELECT url FROM feed_results UNION ALL SELECT audio_url FROM feed_results UNION ALL SELECT url FROM feeds)
    SELECT extractor, count(*) AS n FROM (SELECT CASE {sql_type('url')} WHEN 'youtube' THEN 'captions' WHEN 'audio_file' THEN 'speech' WHEN 'video' THEN 'speech' WHEN 'rss' THEN 'feed' WHEN 'youtube_channel' THEN 'feed' ELSE 'page' END AS extractor FROM s WHERE url IS NOT NULL) GROUP BY 1""")  # fmt: skip
def source_routes(spark, d):
    r = table(spark, d, "feed_results")
    s = r.select("url").unionAll(r.select("audio_url")).unionAll(table(spark, d, "feeds").select("url")).filter("url is not null")
    return s.groupBy(routing.route(F.col("url")).alias("extractor")).agg(F.count(F.lit(1)).alias("n"))


_EXTRACTOR = f"CASE {sql_type('url')} WHEN 'youtube' THEN 'captions' WHEN 'audio_file' THEN 'speech' WHEN 'video' THEN 'speech' WHEN 'rss' THEN 'feed' WHEN 'youtube_channel' THEN 'feed' ELSE 'page' END"


@query("feed_recursion", f"""WITH s AS (SELECT DISTINCT url, {_EXTRACTOR} AS extractor FROM (SELECT url FROM feeds UNION SELECT source_url AS url FROM items WHERE source_url IS NOT NULL)),
    e AS (SELECT DISTINCT f.url AS via, r.url FROM feed_results r JOIN feeds f USING (feed_id) WHERE r.url IS NOT NULL), o AS (SELECT e.url, e.via, {_EXTRACTOR.replace("url", "e.url")} AS extractor FROM e JOIN s ON s.url = e.via AND s.extractor = 'feed')
    SELECT extractor, via IS NOT NULL AS opened, count(*) AS n, count(DISTINCT url) AS urls FROM (SELECT url, NULL AS via, extractor FROM s WHERE extractor <> 'feed' UNION ALL SELECT url, via, extractor FROM o WHERE extractor <> 'feed') GROUP BY 1, 2""")  # fmt: skip
def feed_recursion(spark, d):
    f = table(spark, d, "feeds").select("feed_id", F.col("url").alias("feed"))
    sources = f.select(F.col("feed").alias("url")).unionAll(table(spark, d, "items").select("source_url").filter("source_url is not null"))
    x = routing.expand_feeds(sources, table(spark, d, "feed_results").select("feed_id", "url").join(f, "feed_id"))
    return x.groupBy("extractor", F.col("via").isNotNull().alias("opened")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("urls"))


@query("article_first", "SELECT item_id, CASE WHEN length(trim(text, ' ' || chr(9) || chr(10))) >= 200 THEN text ELSE coalesce(title, '') || chr(10) || text END AS text FROM items")
def article_first(spark, d):
    page = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), "text")
    return table(spark, d, "items").select("item_id", routing.article_first(F.col("text"), page).alias("text"))




@query("site_crawl", f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (ORDER BY result_id) AS k FROM feed_results WHERE url IS NOT NULL),
    p AS (SELECT 'https://site.example/a/' || (k % 500) AS src, 'https://site.example/' || CASE WHEN k % 7 = 0 THEN 'b/' ELSE 'a/' END || ((k * 3 + 1) % 500) || CASE WHEN k % 11 = 0 THEN '.pdf' ELSE '' END AS dst FROM n),
    e AS (SELECT DISTINCT src, dst FROM p WHERE starts_with(dst, 'https://site.example/a') AND NOT regexp_matches(dst, '(?i)\\.pdf$')),
    r(url, depth) AS (SELECT 'https://site.example/a/1', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < 6)
    SELECT url, depth FROM (SELECT url, min(depth) AS depth FROM r GROUP BY 1) ORDER BY depth, url LIMIT 200""")  # fmt: skip
def site_crawl(spark, d):
    """Pages under a start within six links, the nearest 200 of them."""
    from tidewrack.operators.sync import numbered

    n = numbered(table(spark, d, "feed_results").filter("url is not null").select(F.lit(1).alias("site"), "result_id"), "site", "result_id").withColumnRenamed("number", "k")
    folder = F.when(F.col("k") % 7 == 0, "b/").otherwise("a/")
    links = n.select(
        F.concat(F.lit("https://site.example/a/"), (F.col("k") % 500).cast("string"), F.lit("?ref=x")).alias("src"),
        F.concat(F.lit("https://site.example/"), folder, ((F.col("k") * 3 + 1) % 500).cast("string"), F.when(F.col("k") % 11 == 0, ".pdf").otherwise("/#top")).alias("dst"),
    )
    return crawl.site_crawl(links, "https://site.example/a/1", max_depth=6, max_pages=200)


@query("sitemap_scope", f"""WITH m AS (SELECT DISTINCT regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS site, source_url AS url FROM items WHERE source_url IS NOT NULL),
    s AS (SELECT DISTINCT {_sql_prefix('source_url')} AS start FROM items WHERE source_url IS NOT NULL AND regexp_matches(source_url, '^https?://[^/?#]+/'))
    SELECT start, url FROM (SELECT start, url, row_number() OVER (PARTITION BY start ORDER BY url) AS k FROM s JOIN m ON m.site = regexp_extract(start, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AND starts_with(m.url, regexp_replace(start, '/+$', ''))) WHERE k <= 25""")  # fmt: skip
def sitemap_scope(spark, d):
    """For every folder that stored items come from, the first 25 addresses of its host's sitemap below it."""
    i = table(spark, d, "items").filter("source_url is not null").select(F.col("source_url").alias("url"))
    sitemap = i.select(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1).alias("site"), "url")
    starts = i.filter(F.col("url").rlike(r"^https?://[^/?#]+/")).select(u.site_prefix(F.col("url")).alias("start")).distinct()
    return crawl.from_sitemaps(starts, sitemap, 25)


@query("sitemap_round_trip", "SELECT DISTINCT trim(source_url, ' ' || chr(9) || chr(10) || chr(13)) AS url FROM items WHERE trim(source_url, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def sitemap_round_trip(spark, d):
    """Addresses of stored items written as sitemap entries and read back."""
    i = table(spark, d, "items").filter("source_url is not null").select("source_url").distinct()
    esc = F.replace(F.replace(F.replace("source_url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return feeds.sitemap_urls(i.select(F.concat(F.lit("<urlset><url><loc>\n "), esc, F.lit(" </loc></url></urlset>")).alias("xml"))).distinct()


@query("next_page_chains", """WITH RECURSIVE n AS (SELECT feed_id, result_id, lead(result_id) OVER (PARTITION BY feed_id ORDER BY result_id) AS next FROM feed_results), s AS (SELECT feed_id, min(result_id) AS first FROM feed_results GROUP BY 1),
    c(start, step, url) AS (SELECT first, 0, first FROM s UNION ALL SELECT c.start, c.step + 1, n.next FROM c JOIN n ON n.result_id = c.url WHERE n.next IS NOT NULL AND c.step < 50)
    SELECT start, step, url FROM c WHERE step > 0""")  # fmt: skip
def next_page_chains(spark, d):
    """Entries of a feed as pages that lead to the next, followed from the first for 50 pages at most."""
    from tidewrack.operators.sync import numbered

    x = numbered(table(spark, d, "feed_results").select("feed_id", "result_id"), "feed_id", "result_id")
    to = x.select("feed_id", (F.col("number") - 1).alias("number"), F.col("result_id").alias("next"))
    links = x.join(to, ["feed_id", "number"]).select(F.col("result_id").alias("url"), "next")
    return crawl.next_chains(links, x.filter("number = 1").select(F.col("result_id").alias("start")))


@query("blog_candidates", f"""WITH l AS (SELECT f.url AS start, r.url FROM feed_results r JOIN feeds f USING (feed_id) WHERE r.url IS NOT NULL), m AS (SELECT f.url AS start, i.source_url AS url FROM items i JOIN feeds f USING (feed_id) WHERE i.source_url IS NOT NULL AND f.feed_id % 5 = 0),
    x AS (SELECT start, url FROM m UNION SELECT start, url FROM l WHERE start NOT IN (SELECT start FROM m)), k AS (SELECT DISTINCT start, url FROM x WHERE url <> start AND {sql_score('url')} > -0.3 UNION SELECT url, url FROM feeds WHERE kind = 'podcast')
    SELECT start, url FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY url) AS k FROM k) WHERE k <= 40""")  # fmt: skip
def blog_candidates(spark, d):
    """Candidate posts of every feed's site: of the sitemap where it has one, else of its links; 40 a site."""
    f = table(spark, d, "feeds").select("feed_id", F.col("url").alias("start"), "kind")
    links = table(spark, d, "feed_results").select("feed_id", "url").filter("url is not null").join(f, "feed_id")
    sitemap = table(spark, d, "items").select("feed_id", F.col("source_url").alias("url")).filter("url is not null").join(f.filter("feed_id % 5 = 0"), "feed_id")
    return crawl.blog_candidates(links, sitemap, f.filter("kind = 'podcast'").select("start"), 40)


@query("robots_of_hosts", """WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM feed_results WHERE url IS NOT NULL),
    x AS (SELECT result_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS p FROM feed_results WHERE url IS NOT NULL)
    SELECT result_id, CASE WHEN host = '' THEN true WHEN length(host) % 3 = 0 THEN NOT starts_with(p, '/a') OR starts_with(p, '/ar') WHEN length(host) % 3 = 1 THEN NOT (starts_with(p, '/2') OR starts_with(p, '/p')) ELSE true END AS allowed FROM x""")  # fmt: skip
def robots_of_hosts(spark, d):
    """Addresses of entries against robots files of their hosts, with groups that agents share."""
    r = table(spark, d, "feed_results").filter("url is not null").select("result_id", "url")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    shared = "User-agent: *\nUser-agent: other\nDisallow: /a # shared\nAllow: /ar\nDisallow:\n\nUser-agent: mine\nDisallow: /\n"
    own = "User-agent: *\nDisallow: /\n\nUser-agent: reader\nDisallow: /2\nDisallow: /p\n"
    files = r.select(host.alias("host")).filter("host <> ''").distinct()
    text = F.when(F.length("host") % 3 == 0, shared).when(F.length("host") % 3 == 1, own).otherwise("User-agent: other\nDisallow: /\n")
    rules = feeds.robots_rules(files.select("host", text.alias("text")), agent="reader")
    return feeds.robots_allowed(r, rules).select("result_id", "allowed")


@query("feed_kinds", f"SELECT feed_id, CASE {sql_type('url')} WHEN 'youtube_channel' THEN 'youtube' WHEN 'rss' THEN 'rss' ELSE CASE WHEN feed_id % 2 = 0 THEN 'podcast' ELSE 'rss' END END AS kind FROM feeds")
def feed_kinds(spark, d):
    found = F.when(F.col("feed_id") % 2 == 0, F.concat("url", F.lit("/podcast/feed")))
    return table(spark, d, "feeds").select("feed_id", discovery.feed_kind(F.col("url"), found, F.col("url")).alias("kind"))




@query("feed_documents", """SELECT result_id, coalesce(nullif(trim(title, ' ' || chr(9) || chr(10) || chr(13)), ''), 'Untitled') AS title, trim(url, ' ' || chr(9) || chr(10) || chr(13)) AS url, CAST(found_at AS DATE) AS day, CASE WHEN audio_url IS NOT NULL THEN 'audio' ELSE 'article' END AS type FROM feed_results
    WHERE trim(url, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")  # fmt: skip
def feed_documents(spark, d):
    """Every entry written as an item of a feed document and parsed again."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    r = table(spark, d, "feed_results").filter("url is not null")
    title = F.when(F.col("title").rlike(r"\S"), F.concat(F.lit("<title>"), esc("title"), F.lit("</title>"))).otherwise("")
    sound = F.when(F.col("audio_url").isNotNull(), F.concat(F.lit('<enclosure type="audio/mpeg" url="'), esc("audio_url"), F.lit('"/>'))).otherwise("")
    xml = F.concat(F.lit("<rss><channel><item>"), title, F.lit("<link>"), esc("url"), F.lit("</link>"), sound, F.lit("<pubDate>"), F.date_format("found_at", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item></channel></rss>"))
    return feeds.feed_entries(r.select("result_id", xml.alias("xml")), key="result_id").select("result_id", "title", "url", "day", "type")


