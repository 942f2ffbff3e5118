"""The live path: the batch operators' results from Structured Streaming.

Results go to a folder and state to a checkpoint beside it. Given both again, a
stream goes on where it stopped; without them it starts anew.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewrack.operators.state import Versions
from tidewrack.session import stage_path


def _appended(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is available now, its rows appended to a table."""
    w = df.writeStream.format("parquet").option("path", out).outputMode("append")
    w.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(StructType(df.schema.fields)).parquet(out)


def _merged(df: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is available now; its rows replace those of equal keys in a table of versions, one for each batch."""
    table = Versions(df.sparkSession, out)

    def merge(batch: DataFrame, epoch: int) -> None:
        done = table.numbers()
        if done and done[-1] > epoch:
            return  # a batch that is run again after its version was written
        old = table.read()
        table.commit(batch if old is None else batch.unionByName(old.join(batch.select(*keys), keys, "left_anti")))

    df.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.read()


def file_stream(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream, whether it is one file or a folder."""
    at = f"{data_dir}/{name}.parquet"
    schema = spark.read.parquet(at).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(at)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(data_dir)


def _places(spark: SparkSession, name: str, out: str | None, checkpoint: str | None) -> tuple[str, str]:
    return out or stage_path(spark, name), checkpoint or stage_path(spark, f"{name}-state")


def dedupe_stream(stream: DataFrame, key: str, at: str, delay: str = "7 days", out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """One row per key; state older than ``delay`` is dropped, as late rows beyond it are."""
    x = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", delay)
    return _appended(x.dropDuplicatesWithinWatermark([key]).drop("__at"), *_places(stream.sparkSession, "stream-dedupe", out, checkpoint))


def streak_stream(stream: DataFrame, key: str, at: str, kind: str, failure: str, success: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """key, streak: failures since the last success, from keyed state of two numbers.

    Within a micro-batch a key's rows count whatever their order: the last
    success is the latest, and a failure of the same instant comes before it,
    as the batch operator has it. Rows older than the key's last success change
    nothing.
    """
    x = stream.select(F.col(key).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.when(F.col(kind) == success, 1).when(F.col(kind) == failure, 2).otherwise(0).alias("what"))

    def fold(k, batches, state):
        last, n = state.get if state.exists else (None, 0)
        parts = [(b["t"].to_numpy(np.int64), b["what"].to_numpy()) for b in batches]
        t, what = (np.concatenate(x) for x in zip(*parts))
        new = int(t[what == 1].max()) if (what == 1).any() else None
        if new is not None and (last is None or new >= last):
            last, n = new, 0
        failures = t[what == 2]
        n += len(failures) if last is None else int((failures > last).sum())
        state.update((last, n))
        yield pd.DataFrame({"k": [k[0]], "streak": [n]})

    kind_of_key = dict(stream.dtypes)[key]
    counted = x.groupBy("k").applyInPandasWithState(fold, f"k {kind_of_key}, streak bigint", "last bigint, n bigint", "update", "NoTimeout")
    return _merged(counted.select(F.col("k").alias(key), "streak"), [key], *_places(stream.sparkSession, "stream-streaks", out, checkpoint))


def windowed_counts(stream: DataFrame, at: str, kind: str, width: str = "1 day", delay: str = "1 day", out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Extension: counts per kind in event-time windows. State holds the windows within ``delay``; closed ones are in the table only."""
    x = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", delay)
    g = x.groupBy(F.window("__at", width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return _merged(g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), kind, "n"), ["start", kind], *_places(stream.sparkSession, "stream-windows", out, checkpoint))
