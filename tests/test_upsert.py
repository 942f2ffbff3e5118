import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewrack.operators.upsert import UpsertStore, canonical_message_id, repeated_deliveries

SCHEMA = "delivery_id bigint, batch_id int, message_id string, received_at timestamp, mid string"


def t(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(minutes=n)


def test_identifiers(spark):
    rows = [("<A.b@Host.Example>", "A.b@host.example"), (" a@h \n", "a@h"), ('<"a.b"@h>', "a.b@h"), ("<a@h> (note)", "a@h"), ("<a\r\n @h>", "a@h"), ("", None), (" ", None), (None, None)]
    got = spark.createDataFrame(rows, "raw string, want string").select(canonical_message_id(F.col("raw")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_first_delivery_stays(spark):
    rows = [(1, 1, "<x@h>", t(5), "clash"), (2, 2, " x@H ", t(3), None), (3, 2, "<X@h>", t(0), None), (4, 3, None, t(0), None), (5, 3, None, t(0), None), (6, 4, "<y@h>", None, None), (7, 4, "<y@h>", t(9), None), (8, 5, "<z@h>", t(1), None), (9, None, "<z@h>", t(1), None), (10, 1, "", t(1), None), (11, 1, "", t(1), None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for steps in (1, 3):
        assert sorted(r[0] for r in repeated_deliveries(df, steps).collect()) == [1, 6, 9]
    assert repeated_deliveries(df.limit(0)).count() == 0


def test_upsert_is_idempotent_and_compacts(spark):
    a = spark.createDataFrame([("k", 2), ("k", 1), ("l", 5), (None, 0)], "key string, v int")
    b = spark.createDataFrame([("k", 0), ("m", 7)], "key string, v int")
    s = UpsertStore(spark, "key", ["v"], 4)
    s.upsert(a, "1")
    s.upsert(a, "1")
    s.upsert(b, "2")
    want = {("k", 0), ("l", 5), ("m", 7)}
    assert {(r.key, r.v) for r in s.read().collect()} == want
    s.compact()
    assert len(s.runs) == 1 and {(r.key, r.v) for r in s.read().collect()} == want


def test_hot_identifier(spark):
    df = spark.range(3000).selectExpr("id as delivery_id", "cast(id % 5 as int) as batch_id", "if(id % 3 = 0, '<hot@h>', concat('<', id, '@h>')) as message_id", "timestamp_seconds(10000 - id) as received_at", "'' as mid")
    got = {r[0] for r in repeated_deliveries(df).collect()}
    assert got == {i for i in range(0, 3000, 3)} - {2997}


def test_store_is_reopened_and_keeps_whole_rows(spark, tmp_path):
    path, order = f"file://{tmp_path}/store", ["v"]
    rows = lambda s: sorted((r.key, r.v, r.body) for r in s.read().collect())
    a = spark.createDataFrame([("k", 2, "late"), ("l", 5, None), ("k", 1, "early")], "key string, v int, body string")
    b = spark.createDataFrame([("k", 0, "first"), ("m", 7, "new")], "key string, v int, body string")
    UpsertStore(spark, "key", order, 4, path).upsert(a, "1")
    s = UpsertStore(spark, "key", order, path=path)
    assert s.buckets == 4 and s.runs == ["1"] and rows(s) == [("k", 1, "early"), ("l", 5, None)]
    s.upsert(b, "2")
    s.upsert(a, "1")  # a replay
    (tmp_path / "store" / "run-cut-short").mkdir()  # a run that was not committed
    want = [("k", 0, "first"), ("l", 5, None), ("m", 7, "new")]
    s = UpsertStore(spark, "key", order, path=path)
    assert sorted(s.runs) == ["1", "2"] and rows(s) == want
    s.compact()
    s = UpsertStore(spark, "key", order, path=path)
    assert len(s.runs) == 1 and rows(s) == want
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("run-")]) == 1
    s.upsert(b, "3")
    assert rows(UpsertStore(spark, "key", order, path=path)) == want
    with pytest.raises(ValueError):
        UpsertStore(spark, "body", order, path=path)


def test_compaction_neither_shuffles_nor_sorts(spark):
    s = UpsertStore(spark, "key", ["v"], 4)
    for k in range(2):
        s.upsert(spark.range(k, 2000, 2).selectExpr("concat('m', id % 900) as key", "id as v", "'x' as body"), str(k))
    with s._in_order():
        plan = s.read()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan, plan
