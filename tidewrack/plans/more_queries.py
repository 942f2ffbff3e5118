"""Queries over literal pages, digests and the page store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.functions import html as h
from tidewrack.functions import text as t
from tidewrack.functions.dates import parse_written_date
from tidewrack.operators import store, sync
from tidewrack.plans.registry import query, table

_PAGES = [
    (1, "https://a.example/1", '<title>Piece - Site</title><meta name="author" content="Ann"><meta name="keywords" content="B, a"><article><h1>Piece</h1><p>Text <b>bold</b></p></article><a rel="next" href="/2/">x</a><audio src="/s.mp3"></audio>'),
    (2, "https://b.example/", '<meta property="og:title" content="Graph title"><script type="application/ld+json">{"@type":"Article","author":[{"name":"Bob"}],"datePublished":"2024-03-01","keywords":["K"]}</script><body><a href="/n">Older posts</a><iframe src="https://www.youtube.com/embed/v1"></iframe></body>'),
    (3, "https://c.example/x", '<time datetime="2024-05-06">May</time><div class="byline">by Cid</div><a href="/t" aria-label="Next step">z</a>'),
    (4, "https://d.example/", ""),
]


@query("page_fields", """SELECT * FROM (VALUES (1, 'Piece', NULL, 'Ann', '[a, b]', 'https://a.example/2', '/s.mp3'), (2, 'Graph title', '2024-03-01', 'Bob', '[k]', 'https://b.example/n', 'https://www.youtube.com/embed/v1'),
    (3, 'Untitled', '2024-05-06', 'Cid', '[]', 'https://c.example/t', NULL), (4, 'Untitled', NULL, NULL, '[]', NULL, NULL)) v(page_id, title, written_date, author, tags, next_page, media)""")  # fmt: skip
def page_fields(spark, d):
    x = h.extract(spark.createDataFrame(_PAGES, "page_id int, url string, html string"), "html", "url")
    return x.select("page_id", "page.title", "page.written_date", "page.author", F.concat(F.lit("["), F.array_join("page.tags", ", "), F.lit("]")).alias("tags"), "page.next_page", "page.media")


@query("page_markdown", "SELECT * FROM (VALUES (1, '# Piece' || chr(10) || chr(10) || 'Text **bold**')) v(page_id, markdown)")
def page_markdown(spark, d):
    return h.extract(spark.createDataFrame(_PAGES[:1], "page_id int, url string, html string"), "html", "url").select("page_id", "page.markdown")


_DATES = [("2024-02-29T10:00:00+02:00", "2024-02-29"), ("2024-02-29T10:00:00.5-0700", "2024-02-29"), ("2024-02-29T23:59:59", "2024-02-29"), ("2024/2/9", "2024-02-09"), ("February 3, 2024", "2024-02-03"), ("Feb 3, 2024", "2024-02-03"), ("3 February 2024", "2024-02-03"), ("3 Feb 2024", "2024-02-03"), ("02/03/2024", "2024-02-03"), ("2024-02-29T10:00:00Z", "2024-02-29"), ("2024-02-30", None), ("soon", None)]


@query("parse_date_string", "SELECT written, CAST(day AS DATE) AS day FROM (VALUES " + ", ".join(f"('{a}', {b!r})" if b else f"('{a}', NULL)" for a, b in _DATES) + ") v(written, day)")
def parse_date_string(spark, d):
    return spark.createDataFrame([(a,) for a, _ in _DATES], "written string").select("written", parse_written_date(F.col("written"))["day"].alias("day"))


@query("fence_strip", """SELECT * FROM (VALUES ('{"a": 1}'), ('plain'), ('x' || chr(10) || 'y')) v(reply)""")
def fence_strip(spark, d):
    x = spark.createDataFrame([('```json\n{"a": 1}\n```\n',), ("plain",), ("```\nx\ny\n```",)], "s string")
    return x.select(t.strip_fence(F.col("s")).alias("reply"))


@query("safe_paths", "SELECT doc_id, NOT (starts_with(p, '/') OR contains(p, '..')) AS safe FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '' END || coalesce(source, 'none') || CASE WHEN doc_id % 5 = 0 THEN '/../x' ELSE '/x' END AS p FROM documents)")
def safe_paths(spark, d):
    p = F.concat(F.when(F.col("doc_id") % 3 == 0, "/").otherwise(""), F.coalesce("source", F.lit("none")), F.when(F.col("doc_id") % 5 == 0, "/../x").otherwise("/x"))
    return table(spark, d, "documents").select("doc_id", t.safe_path(p).alias("safe"))


@query("page_upsert", "SELECT title AS name, max(doc_id) AS version, arg_max(source, doc_id) AS source FROM (SELECT title, doc_id, coalesce(source, '') AS source FROM documents WHERE title IS NOT NULL) GROUP BY 1")
def page_upsert(spark, d):
    x = table(spark, d, "documents").filter("title is not null").select(F.col("title").alias("name"), F.col("doc_id").alias("version"), F.coalesce("source", F.lit("")).alias("source"))
    old = x.filter("version % 2 = 0").groupBy("name").agg(F.max_by(F.struct("version", "source"), "version").alias("r")).select("name", "r.*")
    return store.upsert_pages(old, x.filter("version % 2 = 1"), at="version")


@query("page_delete", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc_labels)")
def page_delete(spark, d):
    return store.delete_pages(table(spark, d, "documents").select("doc_id"), table(spark, d, "doc_labels"), key="doc_id")


@query("related_top5", """WITH q AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS phrase FROM eval_items),
    h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS k FROM q JOIN documents ON contains(lower(text), lower(phrase))) SELECT query_id, doc_id, CAST(k AS INT) AS rank FROM h WHERE k <= 5""")  # fmt: skip
def related_top5(spark, d):
    q = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("phrase"))
    return store.related(q, table(spark, d, "documents"))


@query("digest_body", """SELECT batch_id, count(*) AS items, string_agg(number || '. ' || coalesce(title, 'Untitled') || ' (' || content_type || ')', chr(10) ORDER BY number) AS body
    FROM (SELECT batch_id, title, content_type, row_number() OVER (PARTITION BY batch_id ORDER BY item_id) AS number FROM items) GROUP BY 1""")  # fmt: skip
def digest_body(spark, d):
    """Numbered digests of every run."""
    return sync.digest_bodies(table(spark, d, "items"))
