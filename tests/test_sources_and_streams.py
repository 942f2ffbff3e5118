import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import text as t
from tidewrack.operators import feeds, store, sync
from tidewrack.sources import files
from tidewrack.streaming import sync_stream as st


def test_files(spark, tmp_path):
    (tmp_path / "a.b.md").write_text("one\ntwo")
    (tmp_path / "urls.txt").write_text("https://a.example/\n\n # note\n https://b.example/x \n")
    (tmp_path / "batch.txt").write_text('---\ntitle: "A: b"\nsource_url: https://a.example\ncontent_type: article\ndate: 2024-02-29\ntags: [x, y]\nword_count: 3\n---\none two three\n---CONTENT_ITEM---\n---\ntitle: "B"\ndate: nope\n---\nx\n')
    assert [tuple(r) for r in files.whole_texts(spark, str(tmp_path / "*.md")).collect()] == [("a.b", "one\ntwo")]
    assert sorted(r.url for r in files.address_list(spark, str(tmp_path / "urls.txt")).collect()) == ["https://a.example/", "https://b.example/x"]
    got = {r.title: r for r in files.record_batch(spark, str(tmp_path / "batch.txt")).collect()}
    assert got["A: b"].tags == ["x", "y"] and got["A: b"].word_count == 3 and got["A: b"].text == "one two three" and str(got["A: b"].date) == "2024-02-29"
    assert got["B"].date is None and got["B"].word_count == 0


def test_mail_files(spark, tmp_path):
    (tmp_path / "m.eml").write_bytes(b'From: A <a@h.example>\r\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\r\nMessage-ID: <1@h.example>\r\nList-Unsubscribe: <https://h.example/u>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary="x"\r\n\r\n--x\r\nContent-Type: text/plain\r\n\r\nhello\r\n--x\r\nContent-Type: text/html\r\n\r\n<p>hello</p>\r\n--x--\r\n')
    r = files.mail_files(spark, str(tmp_path)).first()
    assert r.subject == "Grüße" and r.text_body.strip() == "hello" and "<p>hello</p>" in r.html_body and r.headers["List-Unsubscribe"] == "<https://h.example/u>" and r.message_id == "<1@h.example>"


def test_header_round_trip(spark):
    df = spark.createDataFrame([("T, it is", "https://a.example", "article", "2024-01-02", "Ann", ["x", "y"], None, "", 5), (None, "", "audio", None, None, [], "1:02", None, 0)], "title string, url string, kind string, day string, author string, tags array<string>, length string, channel string, n int")
    c = F.col
    head = t.header(c("title"), c("url"), c("kind"), c("day"), c("author"), c("tags"), c("length"), c("channel"), c("n"))
    x = df.select(F.concat(head, F.lit("\nbody\n---\nmore")).alias("t"))
    got = x.select(*[t.header_field(c("t"), k).alias(k) for k in ("title", "source_url", "content_type", "date", "author", "tags", "duration", "word_count")], t.body(c("t")).alias("b")).collect()
    assert tuple(got[0]) == ("T, it is", "https://a.example", "article", "2024-01-02", "Ann", "[x, y]", None, "5", "body\n---\nmore")
    assert got[1].title is None and got[1].content_type == "audio" and got[1].duration == "1:02"


def test_broken_feed_keeps_good_items(spark):
    xml = "<rss><item><title>ok</title><link>https://a.example/1</link><pubDate>not a date</pubDate></item><item><title>open<link>x</item><item><title>last</title><link>https://a.example/2</link><pubDate>Mon, 05 Feb 2024 01:00:00 GMT</pubDate></item>"
    df = spark.createDataFrame([(1, xml), (2, None), (3, "")], "feed_id int, xml string")
    got = feeds.newest_first(feeds.feed_entries(df)).collect()
    assert [r.title for r in got] == ["last", "ok"] and got[1].day is None
    assert [r.title for r in feeds.newest_first(feeds.feed_entries(df), 1).collect()] == ["last"]


def test_priority_union_and_caps(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2)], "k string, i int")
    b = spark.createDataFrame([("x", 3), ("y", 5), ("y", 4)], "k string, i int")
    assert sorted(map(tuple, sync.union_prefer_first(a, b, "k", "i").collect())) == [("x", 1), ("x", 2), ("y", 4)]
    seen = spark.createDataFrame([("y",)], "k string")
    e = spark.range(50).selectExpr("if(id % 2 = 0, 'x', 'y') as k", "id as i")
    got = sync.first_sync_cap(e, seen, "k", [F.desc("i")], 3).collect()
    assert sorted(r.i for r in got if r.k == "x") == [44, 46, 48] and sum(r.k == "y" for r in got) == 25


def test_pages(spark):
    old = spark.createDataFrame([("a", 1, "o"), ("b", 9, "o")], "name string, updated int, body string")
    new = spark.createDataFrame([("a", 1, "n"), ("b", 2, "n"), ("index", 9, "n"), ("../x", 9, "n"), ("c", 1, "n")], "name string, updated int, body string")
    assert sorted((r.name, r.body) for r in store.upsert_pages(old, new).collect()) == [("a", "n"), ("b", "o"), ("c", "n")]
    log = spark.createDataFrame([("h\n## [1] a\n## [2] b",)], "text string")
    assert [store.log_tail(log, k).first().tail for k in (0, 1, 5)] == ["h\n## [1] a\n## [2] b", "h\n## [2] b", "h\n## [1] a\n## [2] b"]


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, i % 4, ["click", "error", "view"][(i * 7 + i // 5) % 3], 1000 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, s bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for k in range(3):  # three files, and the last one again
        df.filter(f"event_id >= {min(k, 2) * 70} and event_id < {min(k, 2) * 70 + 70}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    df.filter("event_id >= 140").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = st.file_stream(spark, str(tmp_path), "events")
    assert st.dedupe_stream(stream, "event_id", "ts").count() == 200
    want = {r.user_id: r.streak for r in sync.failure_streaks(df, "user_id", "ts", "event_type", "error", "click").collect()}
    one = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events.parquet")).filter("event_id < 140")
    batch = {r.user_id: r.streak for r in sync.failure_streaks(df.filter("event_id < 140"), "user_id", "ts", "event_type", "error", "click").collect()}
    got = {r.user_id: r.streak for r in st.streak_stream(one, "user_id", "ts", "event_type", "error", "click").collect()}
    assert got == batch and set(want) == set(got)


@pytest.mark.parametrize("text,want", [("---\ntitle: A: b\nx: 1\n---\nt", '---\ntitle: "A: b"\nx: 1\n---\nt'), ('---\ntitle: "ok"\n---\n', '---\ntitle: "ok"\n---\n'), ("no header\ntitle: x", "no header\ntitle: x")])
def test_repair(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(t.repair_header(F.col("x"))).first()[0] == want


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    """New files in the folder, the same output and checkpoint: the results are those of all files."""
    src, schema = f"{tmp_path}/in", "user_id int, ts timestamp_ntz, event_type string"
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    first = [(1, at(0), "error"), (1, at(1), "error"), (2, at(0), "error"), (2, at(0), "click"), (3, at(5), "view")]
    second = [(1, at(30), "error"), (2, at(31), "error"), (4, at(32), "error"), (4, at(33), "click"), (4, at(34), "error")]
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = lambda: spark.readStream.schema(schema).parquet(src)
        streaks = st.streak_stream(stream(), "user_id", "ts", "event_type", "error", "click", f"{tmp_path}/s", f"{tmp_path}/sc")
        counts = st.windowed_counts(stream(), "ts", "event_type", out=f"{tmp_path}/w", checkpoint=f"{tmp_path}/wc")
    assert {(r.user_id, r.streak) for r in streaks.collect()} == {(1, 3), (2, 1), (3, 0), (4, 1)}
    assert {(r.start.day, r.event_type, r.n) for r in counts.collect()} == {(1, "error", 3), (1, "click", 1), (1, "view", 1), (2, "error", 4), (2, "click", 1)}
