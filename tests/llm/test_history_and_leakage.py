import random

import pytest
from pyspark.sql import functions as F

from tidewrack.llm.history import HistoryIndex, page_parts, seen_pages
from tidewrack.llm.leakage import leaked_items, spoken_words

SAME = [
    ["https://a.example/p/1/x-y", "http://www.A.example:80/p//1/x%2Dy/", "https://m.a.example/p/1/x-y/index.html?utm_source=z#top", "https://a.example:443/p/1/x-y/amp?fbclid=1&ref=9"],
    ["https://a.example/read?id=1&lang=en", "https://a.example/read/?lang=en&id=1&mc_eid=4"],
    ["https://a.example/read?id=2&lang=en"],
    ["https://a.example/p/1/x-y?page=2"],
    ["https://a.example/p/1/x-y/comments"],
    ["https://news.a.example/p/1/x-y"],
    ["https://a.example/P/1/x-y"],
]


def test_pages_of_addresses(spark):
    rows = [(k, u) for k, us in enumerate(SAME) for u in us]
    got = spark.createDataFrame(rows, "k int, u string").select("k", page_parts(F.col("u")).alias("p")).collect()
    by = {}
    for r in got:
        by.setdefault(tuple(r.p), set()).add(r.k)
    assert sorted(map(sorted, by.values())) == [[k] for k in range(len(SAME))]
    blank = spark.createDataFrame([("",), ("  ",), (None,)], "u string").select(page_parts(F.col("u")).alias("p")).collect()
    assert [r.p for r in blank] == [None] * 3


def test_seen_pages_across_batches_and_tables(spark):
    items = spark.createDataFrame([(1, 2, "https://a.example/x", "clash"), (2, 1, None, ""), (3, 3, "http://a.example/x/", ""), (4, None, "https://b.example/", "")], "item_id bigint, batch_id int, source_url string, url string")
    feeds = spark.createDataFrame([(1, 2, "https://www.a.example/x?utm_id=1"), (2, 1, "https://a.example/y"), (3, 1, "https://a.example/y"), (4, 9, ""), (5, 9, "https://b.example/#f")], "result_id bigint, batch_id int, url string")
    for steps in (1, 2, 3):
        assert {tuple(r) for r in seen_pages(items, feeds, steps).collect()} == {("feed_results", 1), ("items", 3), ("feed_results", 3), ("feed_results", 5)}
    assert seen_pages(items.limit(0), feeds.limit(0)).count() == 0


def test_probe_finds_near_addresses_by_bands(spark):
    old = spark.createDataFrame([(i, f"https://h{i}.example/a/b/c/d/e/f/g/h") for i in range(20)], "id bigint, u string")
    new = spark.createDataFrame([(100, "https://h3.example/a/b/c/d/e/f/g/i"), (101, "https://z.example/q")], "id bigint, u string")
    exact = HistoryIndex(spark)
    exact.ingest(old, "u", ["id"], ["id"])
    assert exact.probe(new, "u", ["id"]).count() == 0
    near = HistoryIndex(spark, slots=32, bands=16, min_similarity=1.0)
    near.ingest(old, "u", ["id"], ["id"])
    near.min_similarity = 0.6
    assert [r.id for r in near.probe(new, "u", ["id"]).collect()] == [100]


def test_history_outlives_its_object(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    one = spark.createDataFrame([(1, "https://a.example/x"), (2, "https://a.example/y"), (3, "https://a.example/x#f")], "id bigint, u string")
    two = spark.createDataFrame([(4, "http://www.a.example/y/"), (5, "https://a.example/z")], "id bigint, u string")
    found = lambda index, df: {r.id for r in index.ingest(df, "u", ["id"], ["id"]).collect()}
    assert found(HistoryIndex(spark, path=path), one) == {3}
    spark.conf.set("spark.sql.shuffle.partitions", "23")  # the next application may have another number
    try:
        again = HistoryIndex(spark, path=path)
        assert again.history().count() == 2 and {r.id for r in again.probe(two, "u", ["id"]).collect()} == {4}
        assert found(again, two) == {4}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    (tmp_path / "store" / "run=2").mkdir()  # a run that was broken off
    assert found(HistoryIndex(spark, path=path), one.unionByName(two)) == {1, 2, 3, 4, 5}
    assert HistoryIndex(spark, path=path).runs() == [0, 1, 3]
    with pytest.raises(ValueError):
        HistoryIndex(spark, slots=8, path=path)


def test_seen_pages_with_a_history(spark, tmp_path):
    items = spark.createDataFrame([(1, 1, "https://a.example/x"), (2, 2, "https://a.example/x/"), (3, 2, "https://a.example/q")], "item_id bigint, batch_id int, source_url string")
    feeds = spark.createDataFrame([(1, 1, "https://a.example/y"), (2, 2, "https://a.example/y")], "result_id bigint, batch_id int, url string")
    for batch, want in ((1, set()), (2, {("items", 2), ("feed_results", 2)})):
        index = HistoryIndex(spark, path=f"file://{tmp_path}/store")
        got = seen_pages(items.filter(F.col("batch_id") == batch), feeds.filter(F.col("batch_id") == batch), index=index)
        assert {tuple(r) for r in got.collect()} == want


def test_near_addresses_are_ingested_in_order(spark, tmp_path):
    r = random.Random(2)
    rows = []
    for k in range(12):
        parts = [f"{k}-{j}" for j in range(10)]
        for _ in range(6):
            parts = [f"v{r.randint(0, 99)}" if r.random() < 0.15 else s for s in parts]
            rows.append((len(rows), f"https://h.example/{'/'.join(parts)}"))
    r.shuffle(rows)
    rows = [(i, u) for i, (_, u) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id bigint, u string")
    open_ = lambda: HistoryIndex(spark, slots=16, bands=8, min_similarity=0.6, path=f"file://{tmp_path}/near")
    sig = {x.id: x.sig for x in open_().keys(df, "u").select("id", "sig").distinct().collect()}
    accepted, want = [], set()
    for i, _ in rows:
        if any(sum(a == b for a, b in zip(sig[i], sig[j])) >= 0.6 * 16 for j in accepted):
            want.add(i)
        else:
            accepted.append(i)
    got = [x.id for half in (df.filter("id < 40"), df.filter("id >= 40")) for x in open_().ingest(half, "u", ["id"], ["id"]).collect()]
    assert 10 < len(want) < 60 and sorted(got) == sorted(want)
    with pytest.raises(ValueError):
        HistoryIndex(spark, slots=16, bands=2, min_similarity=0.6).ingest(df, "u", ["id"], ["id"])


def _brute(docs, items):
    out = set()
    for d, text in docs:
        w = spoken_words(text)
        grams = set(zip(*[w[i:] for i in range(5)]))
        for i, t in items:
            v = spoken_words(t)
            covered = {j for k in range(len(v) - 4) if tuple(v[k : k + 5]) in grams for j in range(k, k + 5)}
            if v and len(v) >= 5 and 2 * len(covered) >= len(v):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(3, 40)))) for i in range(25)] + [(90, ""), (91, None)]
    docs = []
    for d in range(120):
        parts = [" ".join(r.choices(vocabulary, k=20))]
        for i, t in r.sample(items[:25], 3):
            w = t.split()
            a = r.randint(0, len(w) // 2)
            parts.append(" ".join(w[a : a + r.randint(1, len(w))]))
        docs.append((d, "\n[00:01:02] Speaker 1: ".join(parts)))
    docs += [(900, None), (901, ""), (902, "x " * 50000 + items[0][1]), (903, items[1][1])]
    ddf = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(5))
    idf = spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(x) for x in leaked_items(ddf, idf).collect()} == _brute(docs, items)
    assert leaked_items(ddf.limit(0), idf).count() == 0
    assert leaked_items(ddf, idf.limit(0)).count() == 0


def test_arrows_keep_their_line():
    assert spoken_words("it went a --> b here <!-- c --> on\n00:04.5 --> 00:06,3 align:start line:0% the hill\n1:00:04 --> 1:00:06\nx --> 00:01:02") == "it went a b here c on the hill x 00 01 02".split()


def test_marks_are_no_text():
    assert spoken_words("WEBVTT\n\n00:00:04.5 --> 00:00:06.3\nOn the [00:00:34] Speaker 2: hill") == ["webvtt", "on", "the", "hill"]
