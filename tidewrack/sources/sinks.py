"""Sinks: records as text files with unique names, an append-only log, an empty store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.functions import text as t

DATE_TOKENS = {"YYYY": "yyyy", "MM": "MM", "DD": "dd"}


def file_name(day: Column, author: Column, title: Column, date_format: str = "YYYY-MM-DD", max_length: int = 80) -> Column:
    """Name of a record's file without its ending: day, author (30 characters at most) and title as slugs."""
    for token, pattern in DATE_TOKENS.items():
        date_format = date_format.replace(token, pattern)
    a = F.nullif(t.slug(author, 30), F.lit(""))
    return F.concat_ws("_", F.date_format(day, date_format), a, t.slug(title, max_length))


def unique_names(records: DataFrame, name: str, order: str) -> DataFrame:
    """``records`` with ``file``: of equal names all but the first by ``order`` get _2, _3, ..., skipping names that others have by themselves.

    Numbers are given in two levels (``numbered``), so a name that a third of
    all records share is no one task's work.
    """
    from tidewrack.operators.sync import numbered

    x = numbered(records, name, order)
    # how many of the numbered forms of a name are taken as they stand
    taken = records.select(F.col(name).alias("__taken")).distinct()
    taken = taken.select(F.regexp_extract("__taken", r"^(.*)_(\d+)$", 1).alias("__base"), F.regexp_extract("__taken", r"^(.*)_(\d+)$", 2).alias("__digits"))
    taken = taken.filter("__digits rlike '^[1-9][0-9]{0,8}$' and __digits <> '1'").groupBy("__base").agg(F.array_sort(F.collect_set(F.col("__digits").cast("int"))).alias("__gone"))
    x = x.join(taken, F.col(name) == F.col("__base"), "left")
    # each taken number at or below the running one moves it on by one
    number = F.aggregate(F.coalesce("__gone", F.array().cast("array<int>")), F.col("number"), lambda n, gone: F.when(gone <= n, n + 1).otherwise(n))
    shown = F.when(F.col("number") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), number.cast("string")))
    return x.select(*records.columns, F.concat(shown, F.lit(".md")).alias("file"))


def write_texts(records: DataFrame, folder: str, file: str = "file", text: str = "text") -> None:
    """Write each record as a file of its own; a task writes its records one by one, so nothing is gathered."""

    def run(rows) -> None:
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(folder)
        where.create_dir(at, recursive=True)
        for r in rows:
            # a name is made whole before it is seen, so a repeated task leaves no half file
            part = f"{at}/.{r[0]}.part"
            with where.open_output_stream(part) as out:
                out.write((r[1] or "").encode())
            where.move(part, f"{at}/{r[0]}")

    records.select(file, text).filter(F.col(file).isNotNull() & t.safe_path(F.col(file))).foreachPartition(run)


def append_log(spark: SparkSession, folder: str, entries: DataFrame) -> None:
    """Append ``entries`` (day DATE, entry STRING) to a log table."""
    entries.select(F.col("day").cast("date").alias("day"), F.col("entry").cast("string").alias("entry")).withColumn("at", F.current_timestamp()).write.mode("append").parquet(folder)


def log_lines(log: DataFrame) -> DataFrame:
    """day, line: the entries of a log as headed lines, oldest first."""
    return log.orderBy("day", "at", "entry").select("day", F.concat(F.lit("\n## ["), F.col("day").cast("string"), F.lit("] "), F.col("entry"), F.lit("\n")).alias("line"))


def init_store(spark: SparkSession, folder: str) -> dict[str, str]:
    """Paths of the empty tables (pages, sources, log) of a new store; an error where there is one already."""
    schemas = {
        "pages": "name string, title string, category string, tags array<string>, sources array<string>, related array<string>, source_date date, ingested date, updated date, body string",
        "sources": "file string, text string",
        "log": "day date, entry string, at timestamp",
    }
    out = {}
    for name, schema in schemas.items():
        out[name] = f"{folder}/{name}"
        spark.createDataFrame([], schema).write.mode("errorifexists").parquet(out[name])
    return out
