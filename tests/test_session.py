import os

import pytest

from tidewrack import session
from tidewrack.session import drop_stages, shared_dir, spread, staged


class Unset:
    """A session without the setting."""

    class sparkContext:
        applicationId = "app-x"
        master = "local[4]"

        @staticmethod
        def getConf():
            return {}

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_own_folder_only_where_unset(spark):
    at = shared_dir(Unset)
    assert at.startswith("file:///") and os.path.isdir(at.removeprefix("file://")) and shared_dir(Unset) == at
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        assert shared_dir(spark) == told.rstrip("/")


def test_cluster_must_name_a_folder(monkeypatch):
    for master in ("spark://h:7077", "yarn", "local-cluster[3,4,1024]", "k8s://h"):
        monkeypatch.setattr(Unset.sparkContext, "master", master)
        with pytest.raises(RuntimeError):
            shared_dir(Unset)
    for master in ("local", "local[*]", "local[8]", "local[4,2]"):
        monkeypatch.setattr(Unset.sparkContext, "master", master)
        assert shared_dir(Unset)


def test_only_small_scans_are_spread(spark, tmp_path):
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    many, few = f"{tmp_path}/many", f"{tmp_path}/few"
    spark.range(0, 900_000, 1, 9).selectExpr("id", "uuid() as s").write.parquet(many)
    spark.range(9).write.parquet(few)
    assert "Exchange" in plan(spread(spark.read.parquet(few).coalesce(1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        assert "Exchange" not in plan(spread(spark.read.parquet(many).filter("id > 5")))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stage_tables_and_cleanup(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda s: f"file://{tmp_path}")
    df = spark.createDataFrame([(1, "a", None), (2, None, [1.5])], "i int, s string, x array<double>")
    got = staged(df, "t")
    assert got.schema == df.schema and {r.i for r in got.collect()} == {1, 2}
    assert staged(df.limit(0), "empty").count() == 0
    at = tmp_path / "tidewrack" / spark.sparkContext.applicationId
    assert at.is_dir()
    drop_stages(spark)
    assert not at.exists()


def test_freed_stages(spark):
    """A freed write leaves the session's setting as it was, and a stage can be deleted."""
    from tidewrack import session as module

    before = spark.conf.get(module._FREE, None)
    df = module.staged(spark.range(10).repartition(3, "id"), "freed", free=True)
    assert spark.conf.get(module._FREE, None) == before and df.count() == 10
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    module.unstaged(df)
    assert not os.path.exists(folder)
