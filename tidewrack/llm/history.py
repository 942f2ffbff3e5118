"""Problem 5: new batches against everything accepted before.

``HistoryIndex`` keeps, for every accepted page, the band keys of a minwise
signature of its address, partitioned by hash in the shared folder. A batch
probes only the partitions its own keys fall into, verifies the hits, and then
appends the keys of what it accepted; earlier runs are never processed again.

An address is first reduced to the parts that say which page it names; the
signature is taken over these parts. Two addresses of one page have the same
parts, hence the same signature, so every band hits and one band is enough to
find them; with ``min_similarity`` below 1 all bands are used and the share of
equal signature slots is tested.

The folder is the whole state: an index opened on it, in this application or a
later one, has the pages of every run that was written to its end. A run is
never overwritten, and the settings that keys depend on are kept beside the
runs.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.session import stage_path, staged

# Query parameters that serve to measure visits, and prefixes of such parameters.
VISIT_KEYS = [
    "ref", "source", "fbclid", "gclid", "gclsrc", "dclid", "wbraid", "gbraid", "msclkid", "yclid", "twclid", "ttclid", "igshid", "igsh", "mc_eid", "mc_cid", "_hsenc", "_hsmi", "mkt_tok", "vero_id", "s_cid", "cmpid", "ref_src", "ref_url", "spm", "_ga", "_gl",
]
VISIT_PREFIXES = ["utm_", "pk_", "mtm_", "hsa_", "at_"]
# Parameters and path segments that name a format or device.
FORMAT_KEYS = ["amp", "outputtype", "output"]
FORMAT_SEGMENTS = ["amp", "amp.html"]
# A path's default documents.
DEFAULT_DOCUMENTS = r"(index|default)\.(html?|php|aspx?|jsp)"
# Customary host prefixes, and hosts of the mobile form.
HOST_PREFIX = r"^((www\d?|m|mobile|amp)\.)+"


def page_parts(url: Column) -> Column:
    """The parts of an address that say which page it names, as ARRAY<STRING>; null for null or blank.

    Left out: scheme, user, host prefixes (www, m, mobile, amp), default ports,
    a path's default document, format segments (amp), repeated, trailing and
    dot slashes, fragments, parameters that measure visits or name a format,
    and repeated parameters. Percent escapes of ordinary characters are
    decoded, hosts are lower-cased and parameters sorted; the path and the
    remaining parameters keep their case, numbers and values.
    """
    s = F.regexp_replace(F.trim(url), r"[\s]+", "")
    s = F.regexp_replace(s, r"#.*$", "")
    s = F.regexp_replace(s, r"^(?i:https?:)?//", "")
    host = F.lower(F.regexp_extract(s, r"^(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"\.$", "")
    host = F.regexp_replace(host, HOST_PREFIX, "")
    path = F.regexp_extract(s, r"^[^/?]*(/[^?]*)?", 1)
    segments = F.transform(F.split(path, "/"), _decoded)
    segments = F.filter(segments, lambda x: (x != "") & (x != "."))
    segments = F.filter(segments, lambda x: ~F.lower(x).isin(*FORMAT_SEGMENTS))
    last = F.try_element_at(segments, F.lit(-1))
    segments = F.when(last.rlike(f"^(?i:{DEFAULT_DOCUMENTS})$"), F.slice(segments, 1, F.size(segments) - 1)).otherwise(segments)
    query = F.regexp_extract(s, r"\?(.*)$", 1)
    pairs = F.filter(F.transform(F.split(F.regexp_replace(query, r"\?|&amp;", "&"), "&"), _decoded), lambda kv: kv != "")
    key = lambda kv: F.lower(F.substring_index(kv, "=", 1))
    measured = lambda kv: reduce(lambda a, b: a | b, [key(kv).startswith(p) for p in VISIT_PREFIXES], key(kv).isin(*VISIT_KEYS, *FORMAT_KEYS))
    pairs = F.array_sort(F.array_distinct(F.filter(pairs, lambda kv: ~measured(kv))))
    numbered = F.transform(segments, lambda x, i: F.concat((i + 1).cast("string"), F.lit("/"), x))
    parts = F.concat(F.array(F.concat(F.lit("//"), host)), numbered, F.transform(pairs, lambda kv: F.concat(F.lit("?"), kv)))
    return F.when(F.length(s) > 0, parts)


def _decoded(x: Column) -> Column:
    # a plus stays a plus; escapes that do not decode stay as written
    return F.coalesce(F.try_url_decode(F.regexp_replace(x, r"\+", "%2B")), x)


def signature(parts: Column, slots: int) -> Column:
    """Minwise signature of an array of strings: ``slots`` least hashes."""
    return F.array(*[F.array_min(F.transform(parts, lambda p: F.xxhash64(p, F.lit(k)))) for k in range(slots)])


class HistoryIndex:
    """Band keys of accepted pages, partitioned by hash under one folder.

    ``min_similarity`` 1 means the same page; below 1, near-duplicate
    addresses by the share of equal signature slots. ``rows`` per band is
    ``slots`` / ``bands``. On a ``path`` that has runs, ``partitions`` is as
    it was when they were written, and other ``slots`` or ``bands`` are an
    error.
    """

    def __init__(self, spark: SparkSession, slots: int = 4, bands: int = 1, min_similarity: float = 1.0, partitions: int | None = None, path: str | None = None):
        self.spark, self.slots, self.bands, self.min_similarity = spark, slots, bands, min_similarity
        self.path = path or stage_path(spark, "history")
        kept = self._settings()
        self.partitions = partitions or kept.get("partitions") or max(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
        if kept and kept != self._own():
            raise ValueError(f"{self.path} was written with {kept}, not with {self._own()}")
        if not kept and self._folders():
            raise ValueError(f"{self.path} has runs without settings.json")

    def _own(self) -> dict[str, int]:
        return {"slots": self.slots, "bands": self.bands, "partitions": self.partitions}

    def _fs(self, name: str = ""):
        """The file system and the path of a file of the store."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _settings(self) -> dict[str, int]:
        fs, p = self._fs("settings.json")
        return json.loads(self.spark.read.text(f"{self.path}/settings.json", wholetext=True).first()[0]) if fs.exists(p) else {}

    def _folders(self) -> list[int]:
        """Numbers of all run folders, finished or not."""
        fs, p = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(m[1]) for m in map(re.compile(r"run=(\d+)$").match, names) if m)

    def runs(self) -> list[int]:
        """Numbers of the runs that were written to their end."""
        return [k for k in self._folders() if (x := self._fs(f"run={k}/_SUCCESS"))[0].exists(x[1])]

    SCHEMA = "band_key bigint, page bigint, page2 bigint, sig array<bigint>, part int"

    def keys(self, df: DataFrame, url: str) -> DataFrame:
        """One row per row and band; rows with a null address have none.

        ``page`` and ``page2`` are two hashes of the whole page identity, 128
        bits together: equality of pages is tested on them.
        """
        whole = F.array_join("__parts", "\n")
        x = df.withColumn("__parts", page_parts(F.col(url))).filter(F.col("__parts").isNotNull())
        x = x.withColumn("sig", signature(F.col("__parts"), self.slots)).withColumn("page", F.xxhash64(whole)).withColumn("page2", F.xxhash64(F.lit("second"), whole)).drop("__parts")
        step = self.slots // self.bands
        bands = F.array(*[F.xxhash64(F.lit(b), *[F.col("sig")[b * step + i] for i in range(step)]) for b in range(self.bands)])
        x = x.withColumn("band_key", F.explode(bands) if self.bands > 1 else bands[0])
        return x.withColumn("part", F.pmod(F.col("band_key"), F.lit(self.partitions)).cast("int"))

    def history(self, batch: DataFrame | None = None) -> DataFrame:
        """All band keys appended so far, one row per page and band; with ``batch`` (its keys), only the partitions it falls into."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], self.SCHEMA)
        x = self.spark.read.option("basePath", self.path).schema(self.SCHEMA).parquet(*[f"{self.path}/run={k}" for k in runs])
        if batch is None:
            return x
        # at most as many numbers as there are partitions; files of the others are not opened
        return x.filter(F.col("part").isin(*[r.part for r in batch.select("part").distinct().collect()]))

    def _same(self, a: str, b: str) -> Column:
        c = lambda t, n: F.col(f"{t}.{n}")
        if self.min_similarity >= 1:
            return (c(a, "sig") == c(b, "sig")) & (c(a, "page") == c(b, "page")) & (c(a, "page2") == c(b, "page2"))
        equal = F.size(F.filter(F.zip_with(c(a, "sig"), c(b, "sig"), lambda x, y: x == y), lambda t: t))
        return equal / self.slots >= self.min_similarity

    def ingest(self, batch: DataFrame, url: str, ids: list[str], order: list[str]) -> DataFrame:
        """Rows of ``batch`` (their ``ids``) whose page was accepted before; then append the rest.

        "Before" is in the history, or earlier in the batch by ``order``. A hot
        page costs one row per map task: the first row of each page is found by
        a partial aggregation, and repeats are known by not being it.
        """
        # addresses are read and parsed once
        x = staged(self.keys(batch.select(*ids, *[c for c in order if c not in ids], url), url).drop(url), "history-keys")
        first = x.groupBy("band_key", "page", "page2").agg(F.min(F.struct(*order)).alias("__first"), F.min("sig").alias("sig"), F.min("part").alias("part"))
        if self.min_similarity < 1:
            fresh = self._unlike(first)
        else:
            # probe by band key within the matching partitions, verify the signature and then the page itself
            on = (F.col("a.part") == F.col("b.part")) & (F.col("a.band_key") == F.col("b.band_key")) & self._same("a", "b")
            fresh = first.alias("a").join(self.history(first).alias("b"), on, "left_anti")
        if not self._settings():
            fs, p = self._fs("settings.json")
            out = fs.create(p, False)
            out.writeBytes(json.dumps(self._own()))
            out.close()
        run = f"{self.path}/run={max(self._folders(), default=-1) + 1}"
        fresh = fresh.select("band_key", "page", "page2", "sig", "__first", "part")
        fresh.repartition("part").write.mode("errorifexists").partitionBy("part").parquet(run)
        kept = self.spark.read.schema(fresh.schema).parquet(run).select("__first.*")
        if self.bands > 1:
            kept = kept.distinct()
        # one row per accepted page; the anti-join is on the unique order key, so no hot page meets in one task
        x = x.select(*ids, *[c for c in order if c not in ids])
        return (x.distinct() if self.bands > 1 else x).join(kept, order, "left_anti").select(*ids)

    def _all_bands(self) -> None:
        """Raise where a pair can pass the similarity test without an equal band."""
        unequal = self.slots - math.ceil(self.min_similarity * self.slots - 1e-9)
        if self.min_similarity < 1 and self.bands <= unequal:
            raise ValueError(f"{self.bands} bands can miss pairs with {unequal} unequal slots of {self.slots}; take more than {unequal} bands")

    def _unlike(self, first: DataFrame) -> DataFrame:
        """Keys of the pages that are like no page accepted before, in the history or earlier in the batch.

        A page that is itself left out leaves no other out. Pages are decided
        from the earliest on: one with no earlier page alike is accepted and
        leaves out its later ones, until no two that are left are alike.
        """
        self._all_bands()
        first = staged(first, "history-batch")
        page = ["page", "page2"]
        on = (F.col("a.part") == F.col("b.part")) & (F.col("a.band_key") == F.col("b.band_key")) & self._same("a", "b")
        seen = first.alias("a").join(self.history(first).alias("b"), on, "left_semi").select(*page).distinct()
        first = staged(first.join(seen, page, "left_anti"), "history-new")
        links = first.alias("a").join(first.alias("b"), on & (F.col("a.__first") < F.col("b.__first")))
        links = staged(links.selectExpr("a.page as p", "a.page2 as p2", "b.page as page", "b.page2 as page2").distinct(), "history-links")
        out = None
        while not links.isEmpty():
            later = links.select(F.col("page").alias("p"), F.col("page2").alias("p2")).distinct()
            new = staged(links.join(later, ["p", "p2"], "left_anti").select(*page).distinct(), "history-out")
            out = new if out is None else out.unionByName(new)
            links = links.join(new, page, "left_anti").join(new.select(F.col("page").alias("p"), F.col("page2").alias("p2")), ["p", "p2"], "left_anti")
            links = staged(links, "history-links")
        return first if out is None else first.join(out, page, "left_anti")

    def probe(self, batch: DataFrame, url: str, ids: list[str]) -> DataFrame:
        """Rows of ``batch`` (their ``ids``) with a page in the history that passes the similarity test."""
        self._all_bands()
        x = self.keys(batch.select(*ids, url), url)
        old = self.history(x).alias("b")
        x = x.alias("a")
        hit = x.join(old, (F.col("a.part") == F.col("b.part")) & (F.col("a.band_key") == F.col("b.band_key")) & self._same("a", "b"), "left_semi")
        return hit.select(*ids).distinct()


def seen_pages(items: DataFrame, feed_results: DataFrame, steps: int = 2, index: HistoryIndex | None = None) -> DataFrame:
    """tbl, rec_id of rows whose page occurs in an earlier row of either table.

    Order: batch_id (nulls first), items before feed_results, the key. Rows
    enter a ``HistoryIndex`` in ``steps`` ingests of consecutive batches, as
    sync runs would bring them. Null and blank addresses are no cases. With an
    ``index``, its pages count as earlier and the new ones are added to it, so
    a later call brings only the rows of later batches.
    """
    spark = items.sparkSession
    a = items.select(F.lit("items").alias("tbl"), F.lit(0).alias("side"), F.col("item_id").alias("rec_id"), F.coalesce("batch_id", F.lit(-1)).alias("batch_id"), F.col("source_url").alias("url"))
    b = feed_results.select(F.lit("feed_results").alias("tbl"), F.lit(1).alias("side"), F.col("result_id").alias("rec_id"), F.coalesce("batch_id", F.lit(-1)).alias("batch_id"), "url")
    both = a.unionByName(b)
    if steps > 1:
        cuts = both.agg(F.percentile_approx("batch_id", [k / steps for k in range(1, steps)]).alias("c")).first().c or []
    else:
        cuts = []
    index, out = index or HistoryIndex(spark), None
    edges = [None, *sorted(set(cuts)), None]
    for lo, hi in zip(edges, edges[1:]):
        part = both
        if lo is not None:
            part = part.filter(F.col("batch_id") > lo)
        if hi is not None:
            part = part.filter(F.col("batch_id") <= hi)
        found = index.ingest(part, "url", ["tbl", "rec_id"], ["batch_id", "side", "rec_id"])
        out = found if out is None else out.unionByName(found)
    return out
