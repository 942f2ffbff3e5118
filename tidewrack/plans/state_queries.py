"""Queries over page stores, digests, replies and state, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.functions import html as h
from tidewrack.functions import text as t
from tidewrack.functions import urls as u
from tidewrack.operators import state, store, sync, transcripts
from tidewrack.operators.upsert import canonical_message_id
from tidewrack.plans.registry import query, table
from tidewrack.plans.sync_queries import _MID, _NEWS, _TRUST, PLATFORMS, _trusted
from tidewrack.plans.text_queries import _GOOD, _SQL_SLUG, _URLS
from tidewrack.plans.url_queries import sql_norm
from tidewrack.sources import sinks

_DAY = "CAST(ingested AS DATE)"


@query("page_round_trip", f"""SELECT doc_id, trim(title) AS title, doc_kind AS category, list_filter([source, lang], lambda x: x IS NOT NULL) AS tags, [CAST(doc_id AS VARCHAR) || ': "a" # ''b'''] AS sources, CASE WHEN doc_id % 2 = 0 THEN {_DAY} END AS source_date, {_DAY} AS ingested
    FROM documents WHERE trim(title) <> '' AND NOT regexp_matches(title, '[\\n\\r]')""")  # fmt: skip
def page_round_trip(spark, d):
    """Documents rendered as pages with front matter, and read back."""
    x = table(spark, d, "documents").filter(F.trim("title") != "").filter(~F.col("title").rlike(r"[\n\r]"))
    day = F.to_date("ingested")
    tags = F.filter(F.array("source", "lang"), lambda v: v.isNotNull())
    sources = F.array(F.concat(F.col("doc_id").cast("string"), F.lit(": \"a\" # 'b'")))
    page = store.render_page(F.trim("title"), F.col("doc_kind"), tags, sources, F.array().cast("array<string>"), F.when(F.col("doc_id") % 2 == 0, day), day, day, F.col("text"))
    p = x.select("doc_id", F.explode(F.array(store.read_front_matter(page))).alias("p"))
    return p.select("doc_id", "p.title", "p.category", "p.tags", "p.sources", "p.source_date", "p.ingested")


@query("page_reads", """WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'doc-' || doc_id || '.md' WHEN 1 THEN 'doc-' || doc_id WHEN 2 THEN 'sources/doc-' || doc_id WHEN 3 THEN '../doc-' || doc_id ELSE 'index' END AS name FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 5 < 2 AND doc_id % 7 > 0 THEN length(text) WHEN doc_id % 5 = 2 THEN length(text) WHEN doc_id % 5 = 4 THEN 7 END AS chars,
      CASE WHEN doc_id % 5 = 3 THEN 'Invalid path: ' || name WHEN doc_id % 5 < 2 AND doc_id % 7 = 0 THEN 'Page not found: ' || name END AS error FROM r JOIN documents USING (doc_id)""")  # fmt: skip
def page_reads(spark, d):
    """Point reads of every document by the forms a name may have; every seventh page is missing."""
    x = table(spark, d, "documents").select("doc_id", "text")
    n = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    k = F.col("doc_id") % 5
    name = F.when(k == 0, F.concat(n, F.lit(".md"))).when(k == 1, n).when(k == 2, F.concat(F.lit("sources/"), n)).when(k == 3, F.concat(F.lit("../"), n)).otherwise("index")
    stored = x.select(n.alias("name"), "text", "doc_id")
    views = spark.createDataFrame([("index", "# Index")], "name string, text string")
    got = store.read_pages(x.select("doc_id", name.alias("name")), stored.filter("doc_id % 7 > 0"), stored, views)
    return got.select("doc_id", F.length("text").cast("bigint").alias("chars"), "error")


@query("list_lines", f"SELECT doc_id, doc_id || ' — ' || title || ' [' || category || ']' AS line FROM {_GOOD}")
def list_lines(spark, d):
    return store.list_lines(store.parse_pages(table(spark, d, "documents")))


@query("saved_file_names", f"""WITH x AS (SELECT item_id, concat_ws('_', strftime(collected_at, '%Y%m%d'), nullif(rtrim(substr({_SQL_SLUG.format(c='author')}, 1, 30), '-'), ''), {_SQL_SLUG.format(c='title')}) AS name FROM items),
    n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY item_id) AS k FROM x) SELECT item_id, name || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.md' AS file FROM n""")  # fmt: skip
def saved_file_names(spark, d):
    """Names of the files that all items are saved under, with day, author and title."""
    x = table(spark, d, "items").select("item_id", sinks.file_name(F.col("collected_at"), F.col("author"), F.col("title"), "YYYYMMDD").alias("name"))
    return sinks.unique_names(x, "name", "item_id").select("item_id", "file")


@query("first_sync_rest", """WITH seen AS (SELECT DISTINCT feed_id FROM items WHERE feed_id IS NOT NULL AND batch_id <= 8), r AS (SELECT feed_id, result_id, row_number() OVER (PARTITION BY feed_id ORDER BY found_at DESC, result_id) AS k FROM feed_results)
    SELECT feed_id, result_id FROM r WHERE feed_id NOT IN (SELECT feed_id FROM seen) AND k > 20""")  # fmt: skip
def first_sync_rest(spark, d):
    """Entries of feeds that were not in the state after eight runs, beyond the newest twenty."""
    seen = table(spark, d, "items").filter("feed_id is not null and batch_id <= 8")
    x = table(spark, d, "feed_results").select("feed_id", "result_id", "found_at")
    return sync.first_sync_rest(x, seen, "feed_id", [F.desc("found_at"), F.asc("result_id")]).select("feed_id", "result_id")


@query("listed_entries", "SELECT feed_id, result_id FROM (SELECT r.feed_id, result_id, kind, row_number() OVER (PARTITION BY r.feed_id ORDER BY found_at DESC, result_id) AS k FROM feed_results r JOIN feeds USING (feed_id)) WHERE k <= CASE kind WHEN 'youtube' THEN 15 ELSE 50 END")
def listed_entries(spark, d):
    x = sync.newest_per_key(table(spark, d, "feed_results").select("feed_id", "result_id", "found_at"), "feed_id", [F.desc("found_at"), F.asc("result_id")], 50)
    x = x.join(F.broadcast(table(spark, d, "feeds").select("feed_id", "kind")), "feed_id")  # 120 rows, a table that never grows
    return x.filter(F.col("rank") <= sync.default_cap(F.col("kind"))).select("feed_id", "result_id")


_CHECK = f"""WITH e AS (SELECT r.feed_id, r.result_id, r.url, {sql_norm('r.url')} AS norm, r.audio_url, f.kind, r.found_at FROM feed_results r JOIN feeds f USING (feed_id) WHERE NOT coalesce(f.disabled, false) AND r.url IS NOT NULL),
    seen AS (SELECT DISTINCT feed_id, url FROM feed_results WHERE batch_id <= 20 AND feed_id % 3 > 0 AND url IS NOT NULL), saved AS (SELECT DISTINCT {sql_norm('source_url')} AS norm FROM items WHERE source_url IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY found_at DESC, result_id) AS k, feed_id IN (SELECT feed_id FROM seen) AS known FROM e),
    out AS (SELECT * FROM k WHERE (known OR k <= 20) AND NOT ((feed_id, url) IN (SELECT feed_id, url FROM seen) AND norm IN (SELECT norm FROM saved)))"""


def _checked(spark, d):
    r = table(spark, d, "feed_results")
    entries = r.select("feed_id", F.col("result_id").alias("entry_id"), "url", u.normalize_url(F.col("url")).alias("norm_url"), "audio_url", "found_at")
    seen = r.filter("batch_id <= 20 and feed_id % 3 > 0 and url is not null")  # the state after twenty runs
    saved = table(spark, d, "items").filter("source_url is not null").select(u.normalize_url(F.col("source_url")).alias("norm_url"))
    return sync.check_feeds(table(spark, d, "feeds"), entries, seen, saved, [F.desc("found_at"), F.asc("entry_id")])


@query("check_feeds", f"{_CHECK} SELECT result_id, CASE WHEN kind = 'youtube' THEN 'youtube' WHEN audio_url IS NOT NULL THEN 'podcast' ELSE 'article' END AS content_type FROM out")
def check_feeds(spark, d):
    return _checked(spark, d)[0].select(F.col("entry_id").alias("result_id"), "content_type")


@query("check_feeds_marks", f"{_CHECK} SELECT feed_id, url FROM out UNION SELECT feed_id, url FROM k WHERE NOT known AND k > 20")
def check_feeds_marks(spark, d):
    return _checked(spark, d)[1]


_STATUS = "CASE WHEN raw_size > 5242880 THEN 'skipped:too_large' WHEN NOT trusted THEN 'skipped:unknown_sender' WHEN NOT news AND n_urls > 0 THEN 'url' WHEN news AND coalesce(html_body, '') <> '' THEN 'newsletter' WHEN coalesce(text_body, '') <> '' AND n_urls > 0 THEN 'url' WHEN news AND coalesce(text_body, '') <> '' THEN 'newsletter_text' ELSE 'skipped:empty' END"
_FIRST_URLS = f"list_transform(list_sort(list_transform(list_distinct(coalesce({_URLS}, [])), lambda u: {{'at': list_position(coalesce({_URLS}, []), u), 'u': u}})), lambda p: p.u)"


@query("message_items", f"""WITH tr AS ({_TRUST}), x AS (SELECT m.*, t.delivery_id IS NOT NULL AS trusted, {_NEWS} AS news, {_FIRST_URLS} AS urls, len(coalesce({_URLS}, [])) AS n_urls FROM messages m LEFT JOIN tr t USING (delivery_id)), s AS (SELECT *, {_STATUS} AS kind FROM x)
    SELECT delivery_id, kind, unnest(CASE WHEN kind = 'url' THEN urls[1:3] ELSE [NULL] END) AS url, lower(sender) LIKE '%news@%' AS skip_synthesis FROM s WHERE NOT starts_with(kind, 'skipped:')""")  # fmt: skip
def message_items(spark, d):
    """What every message gives: its first three addresses, or itself."""
    m = table(spark, d, "messages")
    x = m.join(_trusted(m, table(spark, d, "feeds")).withColumn("trusted", F.lit(True)), "delivery_id", "left").withColumn("urls", t.extract_urls(F.col("text_body")))
    status = sync.mail_status(F.col("raw_size"), F.col("trusted"), F.col("html_body"), F.col("text_body"), F.col("urls"), F.map_contains_key("headers", "List-Unsubscribe"))
    # senders that are set aside: those of the sort news@
    got = sync.message_items(x.withColumn("status", status), "status", "urls")
    return got.drop("skip_synthesis").join(m.select("delivery_id", F.lower("sender").contains("news@").alias("skip_synthesis")), "delivery_id").select("delivery_id", "kind", "url", "skip_synthesis")


_HISTORY = f"(SELECT delivery_id AS digest_id, {_MID.format(c='message_id')} AS mid, lower(subject) AS subject FROM messages WHERE subject IS NOT NULL AND subject <> '' AND NOT regexp_matches(lower(subject), '^(re|aw|fwd?|wg|tr|rv):') ORDER BY received_at, delivery_id LIMIT 7)"


@query("reply_digests", f"""WITH h AS MATERIALIZED {_HISTORY}, m AS (SELECT delivery_id, {_MID.format(c="headers['In-Reply-To']")} AS reply_to, regexp_replace(lower(coalesce(subject, '')), 're: ?', '', 'g') AS s FROM messages),
    a AS (SELECT m.delivery_id, min(h.digest_id) AS digest_id FROM m JOIN h ON h.mid = m.reply_to GROUP BY 1), b AS (SELECT m.delivery_id, min(h.digest_id) AS digest_id FROM m JOIN h ON contains(m.s, h.subject) WHERE m.delivery_id NOT IN (SELECT delivery_id FROM a) GROUP BY 1)
    SELECT * FROM a UNION ALL SELECT * FROM b""")  # fmt: skip
def reply_digests(spark, d):
    """Messages that answer one of the seven oldest subjects (a rolling history), by identifier or by subject."""
    m = table(spark, d, "messages")
    h = m.filter("subject <> '' and not (lower(subject) rlike '^(re|aw|fwd?|wg|tr|rv):')").orderBy("received_at", "delivery_id").limit(7)
    digests = h.select(F.col("delivery_id").alias("digest_id"), canonical_message_id(F.col("message_id")).alias("mid"), "subject")
    x = m.select("delivery_id", "subject", canonical_message_id(F.try_element_at("headers", F.lit("In-Reply-To"))).alias("reply_to"))
    return sync.match_replies(x, digests, F.lit(True))


@query("reply_actions", """WITH m AS (SELECT delivery_id, batch_id, raw_size % 5 AS a, raw_size % 3 AS b FROM messages), x AS (SELECT delivery_id, 'synthesize' AS type, 'sources/' || batch_id || '-' || n AS path FROM m, (VALUES (1), (2)) v(k), LATERAL (SELECT a + k AS n) WHERE n <= 4
    UNION SELECT delivery_id, 'skip', 'sources/' || batch_id || '-' || (b + 1) FROM m), s AS (SELECT delivery_id, path, bool_or(type = 'synthesize') AS c FROM x GROUP BY 1, 2)
    SELECT delivery_id, CASE WHEN c THEN 'synthesize' ELSE 'skip' END AS type, path FROM s""")  # fmt: skip
def reply_actions(spark, d):
    """Replies in JSON with numbers of a digest's items, decoded, mapped to paths and freed of conflicts."""
    m = table(spark, d, "messages").select("delivery_id", "batch_id", (F.col("raw_size") % 5).alias("a"), (F.col("raw_size") % 3).alias("b"))
    path = lambda n: F.concat(F.lit("sources/"), F.col("batch_id").cast("string"), F.lit(f"-{n}"))
    items = F.create_map(*[x for n in range(1, 5) for x in (F.lit(str(n)), path(n))])
    body = F.format_string('```json\n[{"type": "synthesize", "items": [%d, %d, 99]}, {"type": "skip", "items": ["%d"]}, {"type": "dance"}]\n```', F.col("a") + 1, F.col("a") + 2, F.col("b") + 1)
    return sync.resolve_actions(sync.decode_actions(m.select("delivery_id", body.alias("response"), items.alias("item_map")), "delivery_id"), "delivery_id")


@query("digest_files", """WITH n AS (SELECT batch_id, count(*) AS n FROM items GROUP BY 1), i AS (SELECT batch_id, item_id, n, tags, coalesce(title, 'Untitled') AS title, chr(10) || '- Source: ' || coalesce(source_url, '') || chr(10) || '- Type: ' || content_type || ' | Words: ' || word_count || chr(10) || CASE WHEN text <> '' THEN '- Preview: ' || substr(text, 1, 200) || chr(10) ELSE '' END AS rest FROM items JOIN n USING (batch_id)),
    t AS (SELECT batch_id, topic, count(*) AS size, min(item_id) AS first FROM (SELECT batch_id, item_id, unnest(tags) AS topic FROM i WHERE n > 2) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY size DESC, first, topic) <= 5)
    SELECT batch_id, 'digest.md' AS file, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY item_id) AS INT) AS place, '## ' || row_number() OVER (PARTITION BY batch_id ORDER BY item_id) || '. ' || title || rest AS entry FROM i WHERE n <= 2
    UNION ALL SELECT batch_id, substr(replace(lower(topic), ' ', '-'), 1, 30) || '.md', CAST(row_number() OVER (PARTITION BY batch_id, topic ORDER BY item_id) AS INT), '## ' || title || rest FROM (SELECT batch_id, item_id, title, rest, unnest(tags) AS topic FROM i WHERE n > 2) x JOIN t USING (batch_id, topic)""")  # fmt: skip
def digest_files(spark, d):
    return sync.digest_files(table(spark, d, "items"))


@query("registry_changes", """WITH f AS (SELECT feed_id, 'f' || feed_id AS name, url, kind, synthesize, coalesce(disabled, false) AS disabled FROM feeds)
    SELECT name, CASE WHEN feed_id % 6 = 3 THEN url || '/moved' ELSE url END AS url, CASE WHEN feed_id % 6 = 4 THEN 'podcast' ELSE kind END AS kind, CASE WHEN feed_id % 6 = 4 THEN true ELSE synthesize END AS synthesize,
      CASE feed_id % 6 WHEN 1 THEN true WHEN 2 THEN false WHEN 4 THEN false ELSE disabled END AS disabled FROM f WHERE feed_id % 6 <> 0 UNION ALL SELECT 'new', 'https://new.example/feed', 'rss', true, true""")  # fmt: skip
def registry_changes(spark, d):
    """Subscriptions after removals, switches, moves and additions, several of one name among them."""
    f = table(spark, d, "feeds").select("feed_id", F.concat(F.lit("f"), F.col("feed_id").cast("string")).alias("name"), "url", "kind", "synthesize", F.coalesce("disabled", F.lit(False)).alias("disabled"))
    none = F.lit(None).cast("string")
    act = lambda k, what, url=none, kind=none, seq=1: f.filter(F.col("feed_id") % 6 == k).select(F.lit(seq).alias("seq"), F.lit(what).alias("action"), "name", url.alias("url"), kind.alias("kind"))
    c = act(0, "remove").unionByName(act(0, "enable", seq=2)).unionByName(act(1, "enable")).unionByName(act(1, "disable", seq=2)).unionByName(act(2, "enable")).unionByName(act(3, "update_url", F.concat("url", F.lit("/moved"))))
    c = c.unionByName(act(4, "remove")).unionByName(act(4, "add", F.col("url"), F.lit("podcast"), 2))
    c = c.unionByName(spark.createDataFrame([(2, "disable", "new", None, None), (1, "add", "new", "https://new.example/feed", None), (3, "disable", "nobody", None, None)], c.schema))
    return state.change_feeds(f.drop("feed_id"), c)


@query("state_documents", """SELECT item_id, item_id % 4 = 3 AS broken, CASE WHEN item_id % 4 < 3 AND source_url IS NOT NULL THEN source_url ELSE '' END AS saved, CASE WHEN item_id % 4 IN (0, 1) THEN 1 ELSE 0 END AS pending FROM items""")
def state_documents(spark, d):
    """A state document with the address of each item, written as JSON and read: whole, in parts, and cut off."""
    k = F.col("item_id") % 4
    urls = F.to_json(F.filter(F.array("source_url"), lambda x: x.isNotNull()))
    whole = F.concat(F.lit('{"version": 1, "saved_urls": '), urls, F.lit(', "synthesis": {"pending": {"a": "2024-01-01"}}}'))
    text = F.when(k == 3, F.substring(whole, 1, 30)).when(k == 2, F.concat(F.lit('{"saved_urls": '), urls, F.lit("}"))).otherwise(whole)
    s = state.parse_state(table(spark, d, "items").select("item_id", text.alias("text")))
    return s.select("item_id", "broken", F.array_join("state.saved_urls", " ").alias("saved"), F.size("state.pending").alias("pending"))


@query("recovered_urls", f"SELECT DISTINCT {sql_norm('url')} AS url FROM (SELECT trim(source_url) AS url FROM items WHERE source_url IS NOT NULL AND trim(source_url) <> '' AND NOT regexp_matches(source_url, '\\n'))")
def recovered_urls(spark, d):
    """Addresses that the headers of all stored items name."""
    c = F.col
    text = F.concat(t.header(c("title"), c("source_url"), c("content_type"), c("date"), c("author"), c("tags"), c("duration"), c("channel"), c("word_count")), F.lit("\n\nsource_url of the text\n"), c("text"))
    return state.recovered_urls(table(spark, d, "items").filter("trim(source_url) <> '' and not (source_url rlike '\\n')").select(text.alias("text")))


@query("trusted_with_list", f"""SELECT delivery_id FROM ({_TRUST}) UNION SELECT delivery_id FROM messages WHERE lower(regexp_extract(regexp_replace(sender, '^.*<([^<>]*)>.*$', '\\1'), '(\\S+@\\S+)', 1)) IN (SELECT 'me' || feed_id || '@mail.example' FROM feeds UNION ALL SELECT DISTINCT 'ann@' || regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/]*)', 1) FROM feeds)""")
def trusted_with_list(spark, d):
    """Trusted senders by domain, and those of a list of addresses."""
    f = table(spark, d, "feeds").select("feed_id", u.host(F.col("url")).alias("host"))
    listed = [f"me{r.feed_id}@mail.example" for r in f.collect()] + [f"ann@{r.host}" for r in f.collect()]  # 120 rows, a table that never grows
    hosts = f.select("host").unionByName(spark.createDataFrame([(p,) for p in PLATFORMS], "host string"))
    return sync.trusted_messages(table(spark, d, "messages"), hosts, listed)


@query("recent_messages", "SELECT delivery_id FROM messages WHERE received_at >= (SELECT max(received_at) FROM messages) - INTERVAL 7 DAY")
def recent_messages(spark, d):
    return sync.not_older_than(table(spark, d, "messages"), "received_at", 7).select("delivery_id")


@query("rolling_history", "SELECT sender, delivery_id FROM (SELECT sender, delivery_id, row_number() OVER (PARTITION BY sender ORDER BY received_at DESC, delivery_id DESC) AS k FROM messages) WHERE k <= 7")
def rolling_history(spark, d):
    x = table(spark, d, "messages").select("sender", "delivery_id", "received_at")
    return sync.newest_per_key(x, "sender", [F.desc("received_at"), F.desc("delivery_id")], 7).select("sender", "delivery_id")


@query("segment_lines", """WITH w AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) AS s, generate_subscripts(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> ''), 1) AS i FROM documents WHERE doc_kind = 'transcript')
    SELECT doc_id, string_agg(printf('[%02d:%02d:%02d] ', i * 7 // 3600, i * 7 % 3600 // 60, i * 7 % 60) || CASE WHEN i % 3 > 0 THEN 'Speaker ' || (i % 3 + 1) || ': ' ELSE '' END || trim(s, ' '), chr(10) ORDER BY i) AS lines FROM w GROUP BY 1""")  # fmt: skip
def segment_lines(spark, d):
    """Lines of transcripts as timed segments of speakers, rendered."""
    x = table(spark, d, "documents").filter("doc_kind = 'transcript'").select("doc_id", F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "").alias("l")).filter(F.size("l") > 0)
    seg = F.transform("l", lambda s, i: F.struct(((i + 1) * 7).cast("double").alias("start"), F.when((i + 1) % 3 > 0, F.format_string("SPEAKER_%02d", (i + 1) % 3)).alias("speaker"), s.alias("text")))
    return x.select("doc_id", transcripts.segments_text(seg).alias("lines"))


_CLEAN = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query("page_metadata", f"""SELECT item_id, coalesce(nullif({_CLEAN.format(c='title')}, ''), 'Untitled') AS title, nullif({_CLEAN.format(c='date')}, '') AS written_date, nullif({_CLEAN.format(c='author')}, '') AS author,
    list_sort(list_distinct(list_filter(list_transform(coalesce(tags, []), lambda x: trim(lower(x))), lambda x: x <> '' AND length(x) < 50))) AS tags, 'https://h.example/p/' || item_id AS next_page, CASE WHEN item_id % 3 = 0 THEN 'https://www.youtube.com/embed/v' || item_id END AS media FROM items""")  # fmt: skip
def page_metadata(spark, d):
    """The fields of every item written into a page, in one of two ways each, and read back by one parse."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    meta = lambda key, name, v: F.when(v != "", F.concat(F.lit(f'<meta {key}="{name}" content="'), v, F.lit('">'))).otherwise("")
    even = F.col("item_id") % 2 == 0
    n = F.col("item_id").cast("string")
    title, date, author = esc("title"), esc("date"), esc("author")
    tagged = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    page = F.concat(
        F.when(even, meta("property", "og:title", title)).otherwise(F.when(title != "", F.concat(F.lit("<main><h1>"), title, F.lit("</h1></main>"))).otherwise("")),
        F.when(even, meta("property", "article:published_time", date)).otherwise(F.when(date != "", F.concat(F.lit('<time datetime="'), date, F.lit('"></time>'))).otherwise("")),
        F.when(even, meta("name", "author", author)).otherwise(F.when(author != "", F.concat(F.lit('<p class="byline">By '), author, F.lit("</p>"))).otherwise("")),
        F.when(even, meta("name", "keywords", F.array_join(tagged, ","))).otherwise(F.array_join(F.transform(tagged, lambda x: F.concat(F.lit('<a rel="tag" href="/t">'), x, F.lit("</a>"))), "")),
        F.when(even, F.concat(F.lit('<a rel="next" href="/p/'), n, F.lit('/">x</a>'))).otherwise(F.concat(F.lit('<a href="p/'), n, F.lit('#c">Older posts</a>'))),
        F.when(F.col("item_id") % 3 == 0, F.concat(F.lit('<iframe src="https://www.youtube.com/embed/v'), n, F.lit('"></iframe>'))).otherwise(""),
    )
    x = h.extract(table(spark, d, "items").select("item_id", page.alias("html"), F.lit("https://h.example/list").alias("url")), "html", "url")
    return x.select("item_id", "page.title", "page.written_date", "page.author", "page.tags", "page.next_page", "page.media")
