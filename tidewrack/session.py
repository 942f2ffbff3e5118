"""Session defaults and the one place that knows where stage tables live."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidewrack", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE and Arrow."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and all tasks run on this machine (tests)
    a temporary folder is made, once for the application; on a cluster a
    missing setting is an error.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tidewrack-")
        at = _own_dirs[app]
    return at.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for a stage table called ``name``."""
    return f"{shared_dir(spark)}/tidewrack/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Setting under which a query deletes its shuffle files when it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None, free: bool = False) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of the files and nothing
    that came before them. With ``free`` the shuffle files of the write are
    deleted at its end and not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    before = spark.conf.get(_FREE, None)
    if free:
        spark.conf.set(_FREE, "true")
    try:
        w = df.write.mode("errorifexists")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
    finally:
        if free:
            spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a stage table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unstaged(df: DataFrame) -> None:
    """Delete the stage table that ``df`` reads; nothing may read it afterwards."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)


def work_slots(spark: SparkSession, per_core: int = 2) -> int:
    """Partitions to aim for where a stage runs Python on few large rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), per_core * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """A scan (with filters, projections and unions) as it is where it keeps all cores busy, else spread over ``work_slots``.

    Large inputs have many splits and are not shuffled.
    """
    spark = df.sparkSession
    return df if df._jdf.rdd().getNumPartitions() >= spark.sparkContext.defaultParallelism else df.repartition(work_slots(spark, per_core))


def tokenizer_dir() -> str:
    """Folder with the public vocabulary files; ``TIDEWRACK_TOKENIZERS`` overrides it."""
    return os.environ.get("TIDEWRACK_TOKENIZERS", "/opt/tokenizers")


def drop_stages(spark: SparkSession) -> None:
    """Delete all stage tables of this application; call it when its results are written."""
    drop_path(spark, f"{shared_dir(spark)}/tidewrack/{spark.sparkContext.applicationId}")
