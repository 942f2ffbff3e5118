"""Readers for the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``data_dir``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")
