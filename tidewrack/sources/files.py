"""Sources that are files: whole texts, address lists, batches of records, mail."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.text import BATCH_MARK, body, header_field


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """name, text: one row per file; the name is the file's without its last extension."""
    x = spark.read.text(path, wholetext=True)
    return x.select(F.regexp_replace(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1), r"\.[^.]*$", "").alias("name"), F.col("value").alias("text"))


def address_list(spark: SparkSession, path: str) -> DataFrame:
    """url of every line that is neither blank nor a comment."""
    x = spark.read.text(path).select(F.trim("value").alias("url"))
    return x.filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def record_batch(spark: SparkSession, path: str) -> DataFrame:
    """Records of a batch file: front matter fields and text, one row per record."""
    x = spark.read.option("lineSep", BATCH_MARK).text(path).select(F.regexp_replace("value", r"^\s+", "").alias("t")).filter("t <> ''")
    f = lambda k: header_field(F.col("t"), k)
    tags = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(f("tags"), F.lit("")), r"^\[|\]$", ""), ","), lambda s: F.trim(s)), lambda s: s != "")
    return x.select(
        f("title").alias("title"), f("source_url").alias("source_url"), f("content_type").alias("content_type"), F.try_to_date(f("date"), "yyyy-MM-dd").alias("date"), f("author").alias("author"), tags.alias("tags"), f("duration").alias("duration"), f("channel").alias("channel"),
        F.coalesce(f("word_count").try_cast("int"), F.lit(0)).alias("word_count"), F.regexp_replace(body(F.col("t")), r"^\s+|\s+$", "").alias("text"),
    )


MAIL = "message_id string, subject string, sender string, date string, html_body string, text_body string, headers map<string,string>, raw_size int"


def mail_files(spark: SparkSession, path: str) -> DataFrame:
    """Messages of files in the mail format."""
    return parsed_mail(spark.read.format("binaryFile").load(path), "content")


def parsed_mail(files: DataFrame, raw: str) -> DataFrame:
    """Messages of mail in a binary column: first HTML and first plain part, four headers kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from email import policy
        from email.parser import BytesParser

        for b in batches:
            rows = []
            for mail in b[raw]:
                m = BytesParser(policy=policy.default).parsebytes(bytes(mail))
                parts = {"text/html": None, "text/plain": None}
                for p in m.walk():
                    kind = p.get_content_type()
                    if kind in parts and parts[kind] is None and p.get_content_disposition() != "attachment":
                        try:
                            parts[kind] = p.get_content()
                        except (LookupError, ValueError):
                            parts[kind] = bytes(p.get_payload(decode=True) or b"").decode("utf-8", "replace")
                kept = {k: str(m[k]) for k in ("From", "In-Reply-To", "List-Unsubscribe", "X-Origin-Zone") if m[k]}
                rows.append((m["Message-ID"], m["Subject"], m["From"], m["Date"], parts["text/html"], parts["text/plain"], kept, len(mail)))
            yield pd.DataFrame([[None if v is None else str(v) if k < 6 else v for k, v in enumerate(r)] for r in rows], columns=[c.split()[0] for c in MAIL.replace("map<string,string>", "m").split(", ")])

    return files.select(raw).mapInPandas(run, MAIL)
