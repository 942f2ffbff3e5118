"""Durable state as tables: subscriptions, state documents with recovery, versions of a folder, settings."""

from __future__ import annotations

import os
import re
import tomllib
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import urls as u
from tidewrack.session import drop_path

FEEDS = "name string, url string, kind string, synthesize boolean, disabled boolean"
#: The state document, version 1; parts that a text lacks are empty.
STATE_VERSION = 1
STATE = (
    "version INT, last_sync STRING, email STRUCT<seen_ids: ARRAY<STRING>>, feeds MAP<STRING, STRUCT<seen_urls: ARRAY<STRING>, consecutive_failures: INT>>, saved_urls ARRAY<STRING>, "
    "synthesis STRUCT<pending: MAP<STRING, STRING>, synthesized: MAP<STRING, STRING>, skipped: MAP<STRING, STRING>, failed: MAP<STRING, STRUCT<timestamp: STRING, error: STRING>>>, "
    "digest STRUCT<history: ARRAY<STRUCT<subject: STRING, message_id: STRING, date: STRING, item_map: MAP<STRING, STRING>>>>"
)


def _text(spark: SparkSession, path: str) -> str | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def feed_registry(spark: SparkSession, path: str) -> DataFrame:
    """Subscriptions of a TOML file with [[feeds]] tables; missing fields have their defaults, a missing file gives none."""
    feeds = tomllib.loads(_text(spark, path) or "").get("feeds", [])
    return spark.createDataFrame([(f.get("name", ""), f.get("url", ""), f.get("kind", "rss"), f.get("synthesize", True), f.get("disabled", False)) for f in feeds], FEEDS)


def change_feeds(feeds: DataFrame, changes: DataFrame) -> DataFrame:
    """Subscriptions after ``changes`` (seq, action, name, url, kind), applied in order of seq.

    Actions are add, remove, enable, disable and update_url. A name that is
    added again is replaced; changes of names that do not exist do nothing
    (``unknown_feeds`` lists them).
    """
    c = changes.select("name", F.struct("seq", "action", "url", "kind").alias("c")).groupBy("name").agg(F.array_sort(F.collect_list("c")).alias("log"))
    now = F.struct(*[F.col(x) for x in ("url", "kind", "synthesize", "disabled")], F.col("name").isNotNull().alias("exists"))
    x = feeds.join(c.withColumnRenamed("name", "__name"), F.col("name") == F.col("__name"), "full")

    def step(s, c):
        put = lambda url, kind, synthesize, disabled, exists: F.struct(url.alias("url"), kind.alias("kind"), synthesize.alias("synthesize"), disabled.alias("disabled"), exists.alias("exists"))
        there = lambda **k: put(k.get("url", s.url), s.kind, s.synthesize, k.get("disabled", s.disabled), k.get("exists", s.exists))
        return (
            F.when(c.action == "add", put(c.url, F.coalesce(c.kind, F.lit("rss")), F.lit(True), F.lit(False), F.lit(True)))
            .when((c.action == "remove") & s.exists, there(exists=F.lit(False)))
            .when((c.action == "enable") & s.exists, there(disabled=F.lit(False)))
            .when((c.action == "disable") & s.exists, there(disabled=F.lit(True)))
            .when((c.action == "update_url") & s.exists, there(url=c.url))
            .otherwise(there())
        )

    x = x.select(F.coalesce("name", "__name").alias("name"), F.aggregate(F.coalesce("log", F.array().cast(dict(c.dtypes)["log"])), now, step).alias("s"))
    return x.filter("s.exists").select("name", "s.url", "s.kind", "s.synthesize", "s.disabled")


def unknown_feeds(feeds: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes other than additions of names that are neither subscribed nor added."""
    named = feeds.select("name").unionByName(changes.filter("action = 'add'").select("name")).distinct()
    return changes.filter("action <> 'add'").join(named, "name", "left_anti")


def parse_state(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``state`` of a state document in JSON, and ``broken`` where it is none.

    A broken or null text has an empty state. Parts that an older document
    lacks are empty; a newer version is an error when it is read.
    """
    x = docs.withColumn("__s", F.from_json(F.col(text), f"{STATE}, __bad STRING", {"columnNameOfCorruptRecord": "__bad"}))
    broken = F.col("__s").isNull() | F.col("__s.__bad").isNotNull()
    empty = lambda c, kind: F.coalesce(F.when(~broken, F.col(f"__s.{c}")), F.from_json(F.lit("[]" if kind.startswith("array") else "{}"), kind))
    maps = "map<string,string>"
    newer = F.when(~broken & (F.col("__s.version") > STATE_VERSION), F.raise_error(F.concat(F.lit("state version "), F.col("__s.version").cast("string"), F.lit(" is newer than this reader"))).cast("int"))
    state = F.struct(
        F.coalesce(newer, F.lit(STATE_VERSION)).alias("version"),
        F.when(~broken, F.col("__s.last_sync")).alias("last_sync"),
        empty("email.seen_ids", "array<string>").alias("seen_ids"),
        empty("feeds", "map<string,struct<seen_urls:array<string>,consecutive_failures:int>>").alias("feeds"),
        empty("saved_urls", "array<string>").alias("saved_urls"),
        *[empty(f"synthesis.{b}", maps).alias(b) for b in ("pending", "synthesized", "skipped")],
        empty("synthesis.failed", "map<string,struct<timestamp:string,error:string>>").alias("failed"),
        empty("digest.history", "array<struct<subject:string,message_id:string,date:string,item_map:map<string,string>>>").alias("history"),
    )
    return x.withColumn("state", state).withColumn("broken", broken).drop("__s")


def recovered_urls(sources: DataFrame, text: str = "text") -> DataFrame:
    """url: the normalised source addresses that stored sources name, for a state that was lost."""
    found = F.trim(F.regexp_extract(text, r"(?m)^source_url:[ \t]*(\S.*)$", 1))
    return sources.select(u.normalize_url(F.nullif(found, F.lit(""))).alias("url")).filter("url is not null").distinct()


def reset_state(docs: DataFrame, only_feeds: bool = False, text: str = "text") -> DataFrame:
    """State documents without their feeds, or empty."""
    x = parse_state(docs, text)
    if only_feeds:
        return x.withColumn("state", F.col("state").withField("feeds", F.from_json(F.lit("{}"), "map<string,struct<seen_urls:array<string>,consecutive_failures:int>>")))
    return parse_state(docs.withColumn(text, F.lit(None).cast("string")), text)


class Versions:
    """A table as numbered versions in a folder; a reader sees a whole version or the one before."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path, keep

    def numbers(self) -> list[int]:
        """Versions that were written to their end."""
        fs, p = self._fs("")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(k for k in (int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()) if (f := self._fs(f"v={k}/_SUCCESS"))[0].exists(f[1]))

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def commit(self, df: DataFrame) -> int:
        """Write ``df``, which may be computed from the latest version, as the next one; drop those beyond ``keep``."""
        old = self.numbers()
        n = (old[-1] if old else 0) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={n}")
        for k in old[: -(self.keep - 1)] if self.keep > 1 else old:
            drop_path(self.spark, f"{self.path}/v={k}")
        return n

    def read(self) -> DataFrame | None:
        """The latest version; None before the first."""
        n = self.numbers()
        return self.spark.read.parquet(f"{self.path}/v={n[-1]}") if n else None


def merged_settings(*layers: dict[str, Any]) -> dict[str, Any]:
    """Nested settings of ``layers``, later ones over earlier ones; unknown parts are kept."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged_settings(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else (merged_settings(v) if isinstance(v, dict) else v)
    return out


def load_settings(spark: SparkSession, path: str, defaults: dict[str, Any], variables: dict[str, tuple[str, ...]] | None = None, overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """Settings from defaults, a TOML file, environment variables (name to path of the setting) and overrides, the last over all."""
    from_env: dict[str, Any] = {}
    for name, at in (variables or {}).items():
        if name in os.environ:
            node = from_env
            for part in at[:-1]:
                node = node.setdefault(part, {})
            node[at[-1]] = os.environ[name]
    return merged_settings(defaults, tomllib.loads(_text(spark, path) or ""), from_env, overrides or {})


def state_json(states: DataFrame, state: str = "state") -> DataFrame:
    """``states`` with ``text``: the state documents that ``parse_state`` reads."""
    s = F.col(state)
    whole = F.struct(
        s["version"].alias("version"), s["last_sync"].alias("last_sync"), F.struct(s["seen_ids"].alias("seen_ids")).alias("email"), s["feeds"].alias("feeds"), s["saved_urls"].alias("saved_urls"),
        F.struct(*[s[b].alias(b) for b in ("pending", "synthesized", "skipped", "failed")]).alias("synthesis"), F.struct(s["history"].alias("history")).alias("digest"),
    )
    return states.withColumn("text", F.to_json(whole))




def settings_text(settings: dict[str, Any], at: tuple[str, ...] = ()) -> str:
    """Settings as TOML that ``load_settings`` reads: values first, then tables; None is left out."""

    def value(v: Any) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(value, v)) + "]"
        return '"' + "".join({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, c if c >= " " else f"\\u{ord(c):04x}") for c in str(v)) + '"'

    def name(k: str) -> str:
        return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else value(k)

    lines = [f"{name(k)} = {value(v)}" for k, v in settings.items() if v is not None and not isinstance(v, dict)]
    if at and (lines or not settings):
        lines.insert(0, f"[{'.'.join(map(name, at))}]")
    parts = ["\n".join(lines) + "\n"] if lines else []
    return "\n".join(parts + [settings_text(v, (*at, k)) for k, v in settings.items() if isinstance(v, dict)])
