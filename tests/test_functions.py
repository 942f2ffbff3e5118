import pytest
from pyspark.sql import functions as F

from tidewrack.functions import text as t
from tidewrack.functions import urls as u
from tidewrack.functions.html import parse
from tidewrack.functions import html as h
from tidewrack.operators import crawl, store, transcripts


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


URLS = [
    ("HTTP://WWW.Example.com:443/A/b/?utm_source=x&b=1&a=&b=2#f", "http://example.com/A/b?b=1&b=2&a=#f"),
    ("example.com/x/", "https://example.com/x"),
    ("https://u:p@h.example:8080/;s?q=a%20b~*", "https://h.example:8080?q=a+b~%2A"),
    ("https://h.example", "https://h.example"),
    ("https://h.example/a?FBCLID=1&REF=2", "https://h.example/a"),
    ("", ""),
    (None, None),
]


@pytest.mark.parametrize("url,want", URLS)
def test_normalize(spark, url, want):
    assert one(spark, u.normalize_url, url) == want


def test_kinds(spark):
    for url, kind in [("talk.MP3", "audio_file"), ("a/b.mkv", "video"), ("notes", "local_file"), ("https://youtu.be/x", "youtube"), ("https://www.youtube.com/@n", "youtube_channel"), ("https://h.example/feed/podcast/e.mp3", "audio_file"), ("https://player.vimeo.com/1", "video"), ("https://h.example/atom.xml", "rss"), ("https://h.example/", "blog")]:
        assert one(spark, u.url_type, url) == kind, url


def test_text(spark):
    assert one(spark, t.slug, "  Hello, World_again -- 2!  ") == "hello-worldagain-2"
    assert one(spark, t.page_slug, "日本") .startswith("page-")
    assert one(spark, t.word_count, None) == 0 and one(spark, t.word_count, " a\tb\nc ") == 3
    assert one(spark, t.extract_urls, "see https://a.example/x), https://a.example/x and http://b.example/unsubscribe.") == ["https://a.example/x"]
    assert one(spark, t.sender_domain, "A B <x@Sub.Example>") == "sub.example" and one(spark, t.sender_domain, "nobody") == ""
    assert one(spark, t.cue_mark, "02:03.5") == "[00:02:03]" and one(spark, t.speaker_label, "SPEAKER_03") == "Speaker 4"
    assert one(spark, t.clean_title, "My piece - part two | Site") == "My piece - part two"


VTT = "WEBVTT\nKind: captions\n\n1\n00:00:01.000 --> 00:00:02.000\n<b>one</b>\ntwo\n\n00:00:03.000 --> 00:00:04.000\none two\n\n00:00:05.000 --> 00:00:06.000\nthree\n"


def test_transcripts(spark):
    got = spark.createDataFrame([(VTT,)], "x string").select(transcripts.cues(F.col("x")).alias("c")).select("c", transcripts.without_repeats(F.col("c")).alias("k")).first()
    assert [tuple(c) for c in got.c] == [("[00:00:01]", "one two"), ("[00:00:03]", "one two"), ("[00:00:05]", "three")]
    assert [c.text for c in got.k] == ["one two", "three"]


def test_search_budget(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "", "hit\n" * (1 + 30 * (i == 0))) for i in range(60)] + [(99, "HIT in title", "", "none"), (98, None, None, None)], "doc_id bigint, title string, tags string, text string")
    rows = store.search(docs, "Hit").collect()
    assert len(rows) == 50 and sum(r.name == 0 for r in rows) == 20
    assert rows[0].context == "hit\nhit\nhit"
    assert [r.context for r in store.search(docs.filter("doc_id > 90"), "hit").collect()] == ["Title match: HIT in title"]


def test_reach(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (9, 1), (None, 2)], "src bigint, dst bigint")
    start = spark.createDataFrame([(1,)], "node bigint")
    assert {tuple(r) for r in crawl.reach(links, start, 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert crawl.reach(links.limit(0), start).count() == 1


PAGE = """<html><head><title>Piece | Site</title><meta name="keywords" content="B, a"><script type="application/ld+json">{"@type":"BlogPosting","author":{"name":"Ann"},"datePublished":"2024-02-03"}</script></head>
<body><nav><a href="/x?y=1#z">x</a><a href="http://other.example/">o</a><a rel="next" href="/p/2/">more</a></nav><article><h1>Piece</h1><p>One <b>two<p>Three <a href="/q/">q</a><ul><li>i<li>j</ul><script>var a = "</p>";</script></article></body></html>"""


def test_page():
    root = parse(PAGE)
    assert h.title_of(root) == "Piece" and h.author_of(root) == "Ann" and h.written_date_of(root) == "2024-02-03" and h.tags_of(root) == ["a", "b"]
    assert h.links_of(root, "https://www.site.example/p/1") == ["https://www.site.example/p/2", "https://www.site.example/q", "https://www.site.example/x?y=1"]
    assert h.next_page_of(root, "https://site.example/p/1") == "https://site.example/p/2"
    assert h.markdown(h.main_of(root)) == "# Piece\n\nOne **two**\n\nThree [q](/q/)\n\n- i\n- j"
    assert "var a" not in h.content_text(root)
    assert h.title_of(parse("")) == "Untitled" and h.title_of(parse("<title>A - B</title><p")) == "A"


def test_extract_nulls(spark):
    df = spark.createDataFrame([(None, "u"), ("", None), (PAGE, "https://site.example/")], "h string, u string")
    got = h.extract(df, "h", "u").collect()
    assert [r.page.title if r.page else None for r in got] == [None, "Untitled", "Piece"]


def test_main_content_is_scored():
    from tidewrack.functions.html import main_of, parse, scored_main

    para = "The harbour was quiet, the boats were in, and nobody on the quay had anything to say about the weather."
    page = f"<body><div class='nav-menu'><ul>{'<li><a href=x>A rather long link to another page of this site</a></li>' * 9}</ul></div><div class='wrap'><div id='story'><p>{para}</p><p>{para}</p><p>{para}</p></div><div class='comments'><p>{para}</p></div></div><div class='footer'><p>All about this site, its makers, its rights, and its many friends.</p></div></body>"
    assert main_of(parse(page)).attrs.get("id") == "story"
    assert scored_main(parse("<main>short</main>")) is None and main_of(parse("<main>short</main>")).tag == "main"
    assert scored_main(parse("")) is None and main_of(parse("")).tag == "#root"
    deep = "<div>" * 300 + f"<p>{para}</p>" + "</div>" * 300
    assert main_of(parse(deep)).text() == para
