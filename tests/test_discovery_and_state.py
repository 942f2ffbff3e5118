import datetime as dt
import os

import pytest
import yaml
from pyspark.sql import functions as F

from tidewrack.operators import crawl, discovery, feeds, routing, state, store, sync
from tidewrack.sources import files, providers, sinks


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_feed_candidates(spark):
    page = """<LINK rel='Alternate' type=application/atom+xml href=/a title=x><link href="/r?a=1&amp;b" type="application/rss+xml" rel="alternate feed"><link rel="alternate" type="text/html" href="/no"><link rel=alternate type="application/rss+xml" title="Our Podcast" href="https://p.example/f">"""
    df = spark.createDataFrame([(1, "https://h.example/x/y", page), (2, "https://h.example", None), (3, "https://h.example/feed.xml", page)], "k int, url string, html string")
    got = {(r.k, r["rank"]): r.candidate for r in discovery.feed_candidates(df, "k").collect()}
    assert [got[1, i] for i in range(4)] == ["https://h.example/r?a=1&b", "https://p.example/f", "https://h.example/a", "https://h.example/feed"]
    assert got[2, 0] == "https://h.example/feed" and (2, 5) not in got and got[3, 0] == "https://h.example/feed.xml" and (3, 1) not in got
    best = discovery.feed_candidates(df, "k", prefer=discovery.PODCAST_WORDS)
    assert best.filter("k = 1 and rank = 0").first().candidate == "https://p.example/f" and best.filter("k = 2 and rank = 1").first().candidate == "https://h.example/podcast/feed"
    filled = spark.createDataFrame([("https://h.example/rss",), ("https://h.example/a",)], "url string")
    assert rows(discovery.discover_feeds(discovery.feed_candidates(df, "k"), "k", filled)) == {(1, "https://h.example/a"), (2, "https://h.example/rss")}


def test_channel_pages_that_are_broken(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ytInitialData = {oops};</script>"), (4, 'ytInitialData = {"contents": 3};</script>')], "k int, html string")
    assert discovery.channel_videos(df, "k").count() == 0
    assert {r[0] for r in df.select(discovery.channel_id(F.col("html"))).collect()} == {None}


def test_site_crawl_stays_in_scope(spark):
    h = "https://h.example"
    links = spark.createDataFrame([(f"{h}/a/x", f"{h}/a/y?z=1"), (f"{h}/a/y/", f"{h}/a/w#t"), (f"{h}/a/y", f"{h}/b/v"), (f"{h}/a/x", f"{h}/a/doc.PDF"), (f"{h}/a/w", f"{h}/a/x"), (f"{h}/a/x", None), (f"{h}/b/v", f"{h}/a/q")], "src string, dst string")
    assert rows(crawl.site_crawl(links, f"{h}/a/x")) == {(f"{h}/a/x", 0), (f"{h}/a/y", 1), (f"{h}/a/w", 2)}
    assert {r[0] for r in crawl.site_crawl(links, f"{h}/a/x", scope="domain").collect()} == {f"{h}/a/x", f"{h}/a/y", f"{h}/a/w", f"{h}/b/v", f"{h}/a/q"}
    assert rows(crawl.site_crawl(links, f"{h}/a/x", max_depth=None, max_pages=2)) == {(f"{h}/a/x", 0), (f"{h}/a/y", 1)}
    blocked = spark.createDataFrame([(f"{h}/a/y/",)], "url string")
    assert rows(crawl.site_crawl(links, f"{h}/a/x", blocked=blocked)) == {(f"{h}/a/x", 0)}
    assert rows(crawl.site_crawl(links.limit(0), f"{h}/a/x", scope="path")) == {(f"{h}/a/x", 0)}


def test_next_chains_stop_at_a_cycle_and_at_the_most(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("z", "c"), (None, "q"), ("q", None)] + [(f"n{k}", f"n{k + 1}") for k in range(80)]
    df = spark.createDataFrame(links + links[:3], "url string, next string")
    got = crawl.next_chains(df, spark.createDataFrame([("a",), ("z",), ("n0",), ("nowhere",), (None,)], "start string"), 50)
    want = {("a", 1, "b"), ("a", 2, "c"), ("z", 1, "c"), ("z", 2, "a"), ("z", 3, "b")} | {("n0", k, f"n{k}") for k in range(1, 51)}
    assert rows(got) == want


def test_robots_groups(spark):
    text = "User-agent: *\nUser-agent: other\nDisallow: /x\n# note\nUser-agent: me\nUser-agent: you\nDisallow: /\nAllow: /open\n\nSitemap: https://h/s.xml\n"
    df = spark.createDataFrame([("h.example", text), ("none.example", None), ("e.example", "")], "host string, text string")
    urls = spark.createDataFrame([(k, u) for k, u in enumerate(["https://h.example/x/1", "https://H.example/open/1", "https://h.example", "https://e.example/x", "https://q.example/x", "https://h.example/x/1"])], "k int, url string")
    check = lambda agent: [r.allowed for r in feeds.robots_allowed(urls, feeds.robots_rules(df, agent=agent)).orderBy("k").collect()]
    assert check("*") == [False, True, True, True, True, False]
    assert check("Other") == [False, True, True, True, True, False]
    assert check("you") == [False, True, False, True, True, False]
    assert check("unheard") == check("*")


def test_related_finds_phrases_inside_words(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a LIGHT housed here", "light house", "nothing", None, "lighthouse", "light  house", *["light house again"] * 6])], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "light house"), (2, "Housed"), (3, ""), (4, None), (5, "light house"), (6, "absent")], "query_id int, phrase string")
    want = {(q, i, k) for q in (1, 5) for k, i in enumerate((0, 1, 6, 7, 8), 1)} | {(2, 0, 1)}
    for block in (50_000, 1):
        assert rows(store.related(queries, docs, block=block).select("query_id", "doc_id", "rank")) == want
    assert store.related(queries.limit(0), docs).count() == 0 and store.related(queries, docs.limit(0)).count() == 0


def test_pages_are_yaml(spark):
    titles = ["Plain title", "A: b # c", "it's", 'say "x"', "true", "123", "- dash", "two\nlines", "[x]", "Ünïcode – ok", "trailing:", "back\\slash\nnew"]
    day = dt.date(2024, 2, 29)
    df = spark.createDataFrame([(k, t, ["a b", "c: d", "'q'"], [], ["x.md"], day, day, day, "Body\n\n---\nmore") for k, t in enumerate(titles)], "k int, title string, tags array<string>, sources array<string>, related array<string>, source_date date, ingested date, updated date, body string")
    c = F.col
    df = df.withColumn("page", store.render_page(c("title"), F.lit("concept"), c("tags"), c("sources"), c("related"), c("source_date"), c("ingested"), c("updated"), c("body")))
    for r in df.withColumn("p", store.read_front_matter(c("page"))).collect():
        front = yaml.safe_load(r.page.split("\n---\n")[0])
        assert front == {"title": r.title, "category": "concept", "tags": r.tags, "related": r.related, "source_date": "2024-02-29", "ingested": "2024-02-29", "updated": "2024-02-29"}
        assert (r.p.title, r.p.tags, r.p.sources, r.p.related, r.p.source_date, r.p.body) == (r.title, r.tags, [], r.related, day, r.body)
    inline = spark.createDataFrame([("---\ntitle: T\ntags: [a, 'b c']\nsources: one.md\nupdated: 2024-01-02\n---\nx",), (None,), ("no front matter",)], "t string").select(store.read_front_matter(c("t")).alias("p")).collect()
    assert (inline[0].p.title, inline[0].p.tags, inline[0].p.sources, inline[0].p.updated, inline[0].p.body) == ("T", ["a", "b c"], ["one.md"], dt.date(2024, 1, 2), "x")
    assert inline[1].p.title is None and inline[2].p.title is None


def test_state_documents(spark):
    one = '{"version": 1, "feeds": {"u": {"seen_urls": ["x"], "consecutive_failures": 2}}, "synthesis": {"failed": {"p": {"timestamp": "t", "error": "e"}}}, "digest": {"history": [{"subject": "s", "item_map": {"1": "p"}}]}}'
    df = spark.createDataFrame([(1, one), (2, "{cut"), (3, None), (4, "{}"), (5, '{"version": 9}')], "k int, text string")
    got = {r.k: r for r in state.parse_state(df.filter("k < 5")).collect()}
    assert got[1].state.feeds["u"].consecutive_failures == 2 and got[1].state.failed["p"].error == "e" and got[1].state.history[0].item_map == {"1": "p"}
    assert [got[k].broken for k in (1, 2, 3, 4)] == [False, True, True, False] and got[2].state.saved_urls == [] == got[4].state.seen_ids
    with pytest.raises(Exception, match="newer"):
        state.parse_state(df.filter("k = 5")).collect()
    again = state.parse_state(state.state_json(state.parse_state(df.filter("k = 1"))).select("k", "text")).first()
    assert again.state == got[1].state
    reset = state.reset_state(df.filter("k = 1"), only_feeds=True).first().state
    assert reset.feeds == {} and reset.failed["p"].error == "e" and state.reset_state(df.filter("k = 1")).first().state.failed == {}


def test_feed_registry_and_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "feeds.toml").write_text('[[feeds]]\nname = "A"\nurl = "https://a.example/f"\n[[feeds]]\nname = "B"\nurl = "u"\nkind = "podcast"\nsynthesize = false\ndisabled = true\n')
    got = state.feed_registry(spark, f"file://{tmp_path}/feeds.toml")
    assert rows(got) == {("A", "https://a.example/f", "rss", True, False), ("B", "u", "podcast", False, True)}
    assert state.feed_registry(spark, f"file://{tmp_path}/none.toml").count() == 0
    changes = spark.createDataFrame([(1, "enable", "B", None, None), (1, "remove", "C", None, None)], "seq int, action string, name string, url string, kind string")
    assert rows(state.unknown_feeds(got, changes).select("name")) == {("C",)} and state.change_feeds(got, changes).filter("disabled").count() == 0
    (tmp_path / "c.toml").write_text('[a]\nx = 2\n[a.b]\ny = "file"\n[own]\nk = 1\n')
    monkeypatch.setenv("TW_TEST", "env")
    s = state.load_settings(spark, f"file://{tmp_path}/c.toml", {"a": {"x": 1, "b": {"y": "default", "z": 0}}}, {"TW_TEST": ("a", "b", "y"), "TW_UNSET": ("q",)}, {"a": {"x": 3}})
    assert s == {"a": {"x": 3, "b": {"y": "env", "z": 0}}, "own": {"k": 1}}


def test_versions(spark, tmp_path):
    v = state.Versions(spark, f"file://{tmp_path}/t")
    assert v.read() is None
    v.commit(spark.range(3).toDF("id"))
    for _ in range(3):
        v.commit(v.read().selectExpr("id + 1 as id"))
    (tmp_path / "t" / "v=9").mkdir()  # cut short
    assert v.numbers() == [3, 4] and {r[0] for r in state.Versions(spark, f"file://{tmp_path}/t").read().collect()} == {3, 4, 5}


def test_sinks(spark, tmp_path):
    x = spark.createDataFrame([(1, "n"), (2, "n"), (3, "n_2"), (4, "n"), (5, "m"), (6, "n_3"), (7, "n_2")], "i int, name string")
    got = {r.i: r.file for r in sinks.unique_names(x, "name", "i").collect()}
    assert got == {1: "n.md", 2: "n_4.md", 3: "n_2.md", 4: "n_5.md", 5: "m.md", 6: "n_3.md", 7: "n_2_2.md"}
    sinks.write_texts(x.withColumn("file", F.concat("name", F.lit("-"), "i", F.lit(".md"))).withColumn("text", F.when(F.col("i") > 1, "text ü")), f"file://{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"{n}-{i}.md" for i, n in [(1, "n"), (2, "n"), (3, "n_2"), (4, "n"), (5, "m"), (6, "n_3"), (7, "n_2")])
    assert (tmp_path / "out" / "n-2.md").read_text() == "text ü" and (tmp_path / "out" / "n-1.md").read_text() == ""
    at = sinks.init_store(spark, f"file://{tmp_path}/store")
    for day, entry in (("2024-01-02", "second"), ("2024-01-01", "first")):
        sinks.append_log(spark, at["log"], spark.createDataFrame([(day, entry)], "day string, entry string"))
    assert [r.line for r in sinks.log_lines(spark.read.parquet(at["log"])).collect()] == ["\n## [2024-01-01] first\n", "\n## [2024-01-02] second\n"]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.init_store(spark, f"file://{tmp_path}/store")


def test_mail_provider_filters_at_the_source(spark, tmp_path):
    providers.register(spark)
    for label, n in (("INBOX", 3), ("Other", 2)):
        (tmp_path / label).mkdir()
        for k in range(n):
            p = tmp_path / label / f"{k}.eml"
            p.write_bytes(f"Message-ID: <{label}{k}@h>\nSubject: s{k}\nFrom: a@h\n\nbody {k}".encode())
            os.utime(p, (1_700_000_000 + k * 1000,) * 2)
    x = spark.read.format("mail_folder").load(f"file://{tmp_path}")
    assert x.count() == 5
    some = x.filter("label = 'INBOX' and received_at >= timestamp_seconds(1700001000)")
    assert {r.file for r in some.collect()} == {"1.eml", "2.eml"} and {r.file for r in x.filter("received_at > timestamp_seconds(1700001000)").collect()} == {"2.eml"}
    assert {(r.message_id, r.text_body) for r in files.parsed_mail(some, "raw").collect()} == {("<INBOX1@h>", "body 1"), ("<INBOX2@h>", "body 2")}
    assert x.filter("label = 'None'").count() == 0


def test_routes_and_fallback(spark):
    df = spark.createDataFrame([("https://youtu.be/a",), ("notes.txt",), ("https://h.example/a.mp3",), ("https://h.example/feed",), ("https://h.example/post",)], "url string")
    assert [r[0] for r in df.select(routing.route(F.col("url"))).collect()] == ["captions", "file", "speech", "feed", "page"]
    x = spark.createDataFrame([(None, "p"), ("short", "p"), ("y" * 200, "p"), (" " * 300, "p")], "a string, p string")
    assert [r[0] for r in x.select(routing.article_first(F.col("a"), F.col("p"))).collect()] == ["p", "p", "y" * 200, "p"]


def test_replies(spark):
    m = spark.createDataFrame([(1, "<d1>", "anything"), (2, None, "Re: RE: Weekly digest"), (3, "<other>", "x"), (4, None, None)], "delivery_id int, reply_to string, subject string")
    h = spark.createDataFrame([(10, "<d1>", "Daily"), (11, None, "weekly digest"), (12, None, "digest"), (13, None, "")], "digest_id int, mid string, subject string")
    assert rows(sync.match_replies(m, h, F.lit(True))) == {(1, 10), (2, 11)}
    assert rows(sync.match_replies(m, h.limit(0), F.lit(True))) == set()
    r = spark.createDataFrame([(1, '[{"type": "add_feed", "url": "u"}, {"type": "remove_feed", "name": "n"}, {"type": "skip", "items": [7]}]'), (2, "no json"), (3, None)], "k int, response string").withColumn("item_map", F.create_map(F.lit("1"), F.lit("p")))
    assert rows(sync.decode_actions(r, "k").select("k", "type", "url", "name", "kind")) == {(1, "add_feed", "u", "", "rss"), (1, "remove_feed", "", "n", None)}


def test_settings_round_trip():
    import tomllib

    s = {"a": 1, "list": ["x", 'q"\\\n\x01', True], "deep": {"b c": 2.5, "more": {"on": False}, "empty": {}}, "none": None}
    assert tomllib.loads(state.settings_text(s)) == {k: v for k, v in s.items() if k != "none"}
    assert tomllib.loads(state.settings_text({})) == {}
