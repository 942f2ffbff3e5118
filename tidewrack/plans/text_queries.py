"""Queries over texts, documents and mail, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.functions import text as t
from tidewrack.operators import store, transcripts
from tidewrack.plans.registry import query, table
from tidewrack.plans.url_queries import sql_words

_SQL_SLUG = "rtrim(substr(trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 \\-]', '', 'g'), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '-'), 1, 80), '-')"


@query("word_count", f"SELECT doc_id, CAST({sql_words('text')} AS INT) AS words FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", t.word_count(F.col("text")).alias("words"))


@query("preview_200", "SELECT doc_id, substr(text, 1, 200) AS preview, array_to_string(list_filter(regexp_split_to_array(title, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')[1:10], ' ') AS short_title FROM documents")
def preview_200(spark, d):
    return table(spark, d, "documents").select("doc_id", t.preview(F.col("text")).alias("preview"), t.first_words(F.col("title"), 10).alias("short_title"))


@query("slugify_titles", f"SELECT doc_id, CASE WHEN {_SQL_SLUG.format(c='title')} = '' THEN 'page-' || substr(md5(title), 1, 8) ELSE {_SQL_SLUG.format(c='title')} END AS slug FROM documents WHERE title IS NOT NULL")
def slugify_titles(spark, d):
    return table(spark, d, "documents").filter("title is not null").select("doc_id", t.page_slug(F.col("title")).alias("slug"))


@query("filename_dedupe", f"""WITH x AS (SELECT doc_id, strftime(ingested, '%Y-%m-%d') || '_' || {_SQL_SLUG.format(c='title')} AS name FROM documents WHERE title IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS k FROM x) SELECT doc_id, name || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.md' AS file FROM r""")  # fmt: skip
def filename_dedupe(spark, d):
    from pyspark.sql import Window

    x = table(spark, d, "documents").filter("title is not null").select("doc_id", F.concat_ws("_", F.substring(F.col("ingested").cast("string"), 1, 10), t.slug(F.col("title"))).alias("name"))
    k = F.row_number().over(Window.partitionBy("name").orderBy("doc_id"))
    return x.select("doc_id", F.concat("name", F.when(k > 1, F.concat(F.lit("_"), k)).otherwise(""), F.lit(".md")).alias("file"))


@query("yaml_header_render", """SELECT item_id, '---' || chr(10) || CASE WHEN title <> '' THEN 'title: "' || title || '"' || chr(10) ELSE '' END || CASE WHEN source_url <> '' THEN 'source_url: ' || source_url || chr(10) ELSE '' END
    || 'content_type: ' || content_type || chr(10) || CASE WHEN date <> '' THEN 'date: ' || date || chr(10) ELSE '' END || CASE WHEN author <> '' THEN 'author: "' || author || '"' || chr(10) ELSE '' END
    || CASE WHEN len(tags) > 0 THEN 'tags: [' || array_to_string(tags, ', ') || ']' || chr(10) ELSE '' END || CASE WHEN duration <> '' THEN 'duration: "' || duration || '"' || chr(10) ELSE '' END
    || CASE WHEN channel <> '' THEN 'channel: "' || channel || '"' || chr(10) ELSE '' END || CASE WHEN word_count > 0 THEN 'word_count: ' || word_count || chr(10) ELSE '' END || '---' AS header FROM items""")  # fmt: skip
def yaml_header_render(spark, d):
    c = F.col
    return table(spark, d, "items").select("item_id", t.header(c("title"), c("source_url"), c("content_type"), c("date"), c("author"), c("tags"), c("duration"), c("channel"), c("word_count")).alias("header"))


_FM = "regexp_extract(text, '^---\\n([\\s\\S]*?)\\n---(?:\\n|$)', 1)"
_FIELD = "nullif(regexp_replace(trim(regexp_extract(chr(10) || " + _FM + " || chr(10), '\\n{k}:[ \\t]*([^\\n]*)\\n', 1)), '^\"(.*)\"$', '\\1'), '')"
_PAGES = f"SELECT doc_id, {_FIELD.format(k='title')} AS title, {_FIELD.format(k='category')} AS category, list_filter(list_transform(string_split(regexp_replace(coalesce({_FIELD.format(k='tags')}, ''), '^\\[|\\]$', '', 'g'), ','), lambda s: trim(s)), lambda s: s <> '') AS tags, CAST(try_strptime({_FIELD.format(k='ingested')}, '%Y-%m-%d') AS DATE) AS ingested FROM documents WHERE starts_with(text, '---' || chr(10))"
_GOOD = f"(SELECT * FROM ({_PAGES}) WHERE title IS NOT NULL AND category IS NOT NULL AND ingested IS NOT NULL)"


@query("list_pages", f"SELECT * FROM {_GOOD}")
def list_pages(spark, d):
    return store.list_pages(store.parse_pages(table(spark, d, "documents")).drop("body"))


@query("list_pages_category", f"SELECT doc_id, title FROM {_GOOD} WHERE category = 'concept'")
def list_pages_category(spark, d):
    return store.list_pages(store.parse_pages(table(spark, d, "documents")), "concept").select("doc_id", "title")


_HEAD = "CASE category WHEN 'concept' THEN 'Concepts' WHEN 'entity' THEN 'Entities' WHEN 'summary' THEN 'Summaries' WHEN 'comparison' THEN 'Comparisons' WHEN 'exploration' THEN 'Explorations' WHEN 'reference' THEN 'References' ELSE upper(category[1]) || substr(category, 2) || 's' END"


@query("build_index", f"SELECT coalesce(nullif(coalesce(list_position(['concept','entity','summary','comparison','exploration','reference'], category), 0), 0), 7) AS place, {_HEAD} AS heading, '- [' || title || '](pages/' || doc_id || '.md) [' || category || ']' AS entry FROM {_GOOD}")
def build_index(spark, d):
    return store.index_lines(store.parse_pages(table(spark, d, "documents")))


@query("index_counts", f"SELECT {_HEAD} AS heading, count(*) AS pages, min(ingested) AS first_day, max(ingested) AS last_day FROM {_GOOD} GROUP BY 1")
def index_counts(spark, d):
    x = store.parse_pages(table(spark, d, "documents"))
    return x.groupBy(store.heading(F.col("category")).alias("heading")).agg(F.count(F.lit(1)).alias("pages"), F.min("ingested").alias("first_day"), F.max("ingested").alias("last_day"))


@query("batch_split", "SELECT doc_id, i AS part, trim(s, chr(10)) AS body FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS s, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents) WHERE trim(s, chr(10)) <> ''")
def batch_split(spark, d):
    """Join the blocks of a text to a batch, and split it again at the batch mark."""
    batch = F.regexp_replace("text", "\n\n", f"\n\n{t.BATCH_MARK}\n\n")
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(batch, f"\n\n{t.BATCH_MARK}\n\n", -1)).alias("pos", "s"))
    return x.select("doc_id", (F.col("pos") + 1).alias("part"), F.regexp_replace("s", r"^\n+|\n+$", "").alias("body")).filter("body <> ''")


@query("strip_html_300", "SELECT result_id, substr(trim(regexp_replace(content, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)), 1, 300) AS description FROM feed_results WHERE content IS NOT NULL")
def strip_html_300(spark, d):
    return table(spark, d, "feed_results").filter("content is not null").select("result_id", t.strip_html(F.col("content")).alias("description"))


_URLS = """list_filter(list_transform(regexp_extract_all(text_body, 'https?://[^\\s<>"'')\\]]+'), lambda u: regexp_replace(u, '[.,;:!?)]+$', '')), lambda u: NOT contains(lower(u), 'unsubscribe') AND NOT contains(lower(u), 'mailto:'))"""


@query("extract_urls", f"SELECT delivery_id, list_sort(list_distinct({_URLS})) AS urls FROM messages WHERE text_body IS NOT NULL")
def extract_urls(spark, d):
    return table(spark, d, "messages").filter("text_body is not null").select("delivery_id", F.array_sort(t.extract_urls(F.col("text_body"))).alias("urls"))


_DOMAIN = "lower(regexp_extract(regexp_replace(sender, '^.*<([^<>]*)>.*$', '\\1'), '@([^\\s@<>]+)\\s*$', 1))"


@query("sender_domain", f"SELECT {_DOMAIN} AS domain, count(*) AS n FROM messages GROUP BY 1")
def sender_domain(spark, d):
    return table(spark, d, "messages").groupBy(t.sender_domain(F.col("sender")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("duration_format", """SELECT l_orderkey, l_linenumber, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS shown,
    printf('[%02d:%02d:%02d]', s // 3600, s % 3600 // 60, s % 60) AS mark, 'Speaker ' || (l_linenumber + 1) AS speaker FROM (SELECT *, CAST(l_partkey * 7 % 20000 AS BIGINT) AS s FROM lineitem)""")  # fmt: skip
def duration_format(spark, d):
    s = F.col("l_partkey") * 7 % 20000
    label = F.format_string("SPEAKER_%02d", F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.duration(s).alias("shown"), t.timestamp_mark(s + 0.7).alias("mark"), t.speaker_label(label).alias("speaker"))


@query("webpage_title_clean", "SELECT doc_id, CASE WHEN regexp_matches(title, '^.+ [-|—–] .{0,40}$') AND length(regexp_extract(title, '^.* [-|—–] (.*)$', 1)) <= 40 THEN regexp_extract(title, '^(.*) [-|—–] .*$', 1) ELSE title END AS title FROM documents WHERE title IS NOT NULL")
def webpage_title_clean(spark, d):
    return table(spark, d, "documents").filter("title is not null").select("doc_id", t.clean_title(F.col("title")).alias("title"))


@query("markdown_clean", """SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '(?i)</?(?:div|span|section|header|footer|aside)[^>]*>', '', 'g'), '\\[([^\\]]*)\\]\\(\\s*([^)\\s]*)\\s*\\)', '[\\1](\\2)', 'g'), '(?m)[ \\t]+$', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM items""")
def markdown_clean(spark, d):
    return table(spark, d, "items").select("item_id", t.clean_markdown(F.col("text")).alias("text"))


@query("article_quality_gate", "SELECT content_type, count(*) FILTER (WHERE length(trim(text, ' ' || chr(9) || chr(10))) < 200) AS short, count(*) AS n FROM items GROUP BY 1")
def article_quality_gate(spark, d):
    short = F.length(F.regexp_replace("text", r"^[ \t\n]+|[ \t\n]+$", "")) < 200
    return table(spark, d, "items").groupBy("content_type").agg(F.count_if(short).alias("short"), F.count(F.lit(1)).alias("n"))


def _sql_search(q: str, title: str = "coalesce(title, CAST(doc_id AS VARCHAR))") -> str:
    return f"""WITH l AS (SELECT doc_id AS name, {title} AS title, coalesce(source, '') AS tags, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS line, generate_subscripts(string_split(rtrim(text, chr(10)), chr(10)), 1) AS i, string_split(rtrim(text, chr(10)), chr(10)) AS ls FROM documents),
      m AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY i) AS k FROM l WHERE contains(lower(line), '{q}')),
      hit AS (SELECT name, title, CAST(i AS INT) AS line_number, array_to_string(ls[greatest(i - 2, 1):i + 2], chr(10)) AS context FROM m WHERE k <= 20),
      rest AS (SELECT doc_id AS name, {title} AS title, 0 AS line_number, CASE WHEN contains(lower({title}), '{q}') THEN 'Title match: ' || {title} ELSE 'Tag match: ' || source END AS context FROM documents
               WHERE doc_id NOT IN (SELECT name FROM hit) AND (contains(lower({title}), '{q}') OR contains(lower(coalesce(source, '')), '{q}'))),
      al AS (SELECT * FROM hit UNION ALL SELECT * FROM rest), c AS (SELECT name, count(*) AS n FROM al GROUP BY 1),
      b AS (SELECT name, coalesce(sum(n) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
      SELECT name, title, line_number, context FROM al JOIN b USING (name) WHERE before < 50"""


@query("search_pages", _sql_search("compare the"))
def search_pages(spark, d):
    return store.search(table(spark, d, "documents"), "compare the", tags="source")


@query("search_title_fallback", _sql_search("lighthouse of"))
def search_title_fallback(spark, d):
    return store.search(table(spark, d, "documents"), "Lighthouse of", tags="source")


# a word of many titles: where no line has it, the title counts
@query("search_title_hits", _sql_search("notes on a"))
def search_title_hits(spark, d):
    return store.search(table(spark, d, "documents"), "Notes on a", tags="source")


@query("search_tag_fallback", _sql_search("rare-ess"))
def search_tag_fallback(spark, d):
    return store.search(table(spark, d, "documents"), "rare-ess", tags="source")


_CUE = "regexp_extract_all(text, '(?m)^[ \\t]*(\\d{1,2}:\\d{2}:\\d{2})[.,]\\d{3}[ \\t]*-->[^\\n]*\\n((?:[^\\n]*\\S[^\\n]*(?:\\n|$))*)', {g})"


@query("transcript_cues", f"""WITH c AS (SELECT doc_id, unnest({_CUE.replace("{g}", "1")}) AS cue_at, unnest({_CUE.replace("{g}", "2")}) AS said, generate_subscripts({_CUE.replace("{g}", "1")}, 1) AS i FROM documents WHERE doc_kind = 'caption'),
    s AS (SELECT doc_id, i, '[' || lpad(cue_at, 8, '0') || ']' AS cue_at, trim(replace(rtrim(said, chr(10)), chr(10), ' ')) AS said FROM c), k AS (SELECT * FROM s WHERE said <> ''), w AS (SELECT *, lag(said) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM k)
    SELECT doc_id, count(*) AS cues, count(*) FILTER (WHERE prev IS NULL OR prev <> said) AS kept, min(cue_at) AS first_at, CAST(sum(length(said)) AS BIGINT) AS chars FROM w GROUP BY 1""")  # fmt: skip
def transcript_cues(spark, d):
    x = table(spark, d, "documents").filter("doc_kind = 'caption'").select("doc_id", transcripts.cues(F.col("text")).alias("c")).filter(F.size("c") > 0)
    return x.select("doc_id", F.size("c").cast("bigint").alias("cues"), F.size(transcripts.without_repeats(F.col("c"))).cast("bigint").alias("kept"), F.array_min(F.transform("c", lambda e: e["at"])).alias("first_at"), F.aggregate("c", F.lit(0).cast("bigint"), lambda a, e: a + F.length(e.text)).alias("chars"))


@query("cue_texts", f"""WITH c AS (SELECT doc_id, unnest({_CUE.replace("{g}", "1")}) AS cue_at, unnest({_CUE.replace("{g}", "2")}) AS said, generate_subscripts({_CUE.replace("{g}", "1")}, 1) AS i FROM documents WHERE doc_kind = 'caption'),
    s AS (SELECT doc_id, i, '[' || lpad(cue_at, 8, '0') || ']' AS cue_at, trim(replace(rtrim(said, chr(10)), chr(10), ' ')) AS said FROM c), k AS (SELECT *, lag(said) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM s WHERE said <> '')
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS place, cue_at, said FROM k WHERE prev IS NULL OR prev <> said""")  # fmt: skip
def cue_texts(spark, d):
    """Every cue's time and text, without repeats."""
    x = table(spark, d, "documents").filter("doc_kind = 'caption'").select("doc_id", F.posexplode(transcripts.without_repeats(transcripts.cues(F.col("text")))).alias("pos", "c"))
    return x.select("doc_id", (F.col("pos") + 1).alias("place"), F.col("c")["at"].alias("cue_at"), F.col("c")["text"].alias("said"))


@query("transcript_paragraphs", """WITH l AS (SELECT doc_id, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS line, generate_subscripts(string_split(rtrim(text, chr(10)), chr(10)), 1) AS i FROM documents WHERE doc_kind = 'transcript'),
    p AS (SELECT doc_id, (i - 1) // 5 AS k, string_agg(line, ' ' ORDER BY i) AS para FROM l GROUP BY 1, 2) SELECT doc_id, string_agg(para, chr(10) || chr(10) ORDER BY k) AS paragraphs FROM p GROUP BY 1""")  # fmt: skip
def transcript_paragraphs(spark, d):
    return table(spark, d, "documents").filter("doc_kind = 'transcript'").select("doc_id", transcripts.paragraphs(t.lines(F.col("text"))).alias("paragraphs"))
