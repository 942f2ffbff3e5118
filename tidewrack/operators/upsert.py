"""Problem 6: messages delivered more than once.

``UpsertStore`` is an idempotent upsert keyed by identifier. A run is one
upserted batch, collapsed to one row per identifier (partial aggregation
before the shuffle, so a hot identifier costs one row per map task), laid out
in hash buckets, one sorted file each. Compaction merges sorted runs bucket by
bucket, without a shuffle or a sort, so that equal identifiers collapse to
one. Writing the same batch again changes nothing.

The folder is the whole state. A manifest names the runs that count; it is
written last and never changed, so a store opened on the folder, at any time
and by any application, has the rows of every upsert that ended.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewrack.session import drop_path, stage_path


def canonical_message_id(raw: Column) -> Column:
    """The identifier itself, as mail standards mean it.

    White space, folding, comments in parentheses and the angle brackets are
    not part of it; the part after ``@`` is a domain and case-insensitive, the
    part before it is not; a quoted left part equals the same text unquoted.
    Null, empty or blank identifiers give null.
    """
    bare = F.regexp_replace(F.regexp_replace(raw, r"\([^()]*\)", ""), r"[\s\x00]+", "")
    bare = F.regexp_replace(bare, r"^<+|>+$", "")
    bare = F.regexp_replace(bare, r'^"([^"\\]*)"@', "$1@")
    left, right = F.regexp_extract(bare, r"^(.*)@([^@]*)$", 1), F.regexp_extract(bare, r"^(.*)@([^@]*)$", 2)
    return F.nullif(F.when(right == "", bare).otherwise(F.concat(left, F.lit("@"), F.lower(right))), F.lit(""))


class UpsertStore:
    """Hash-bucketed sorted runs of whole rows under one folder; one winner per identifier.

    ``order`` names the columns whose least value (in this order) wins. Ties on
    all of them are the same delivery, and one of them stays. Without
    ``buckets`` there are as many as shuffle partitions, 16 at least; a store
    that has runs keeps their number. Batches must have the columns of the
    first one.
    """

    def __init__(self, spark: SparkSession, key: str, order: list[str], buckets: int | None = None, path: str | None = None):
        self.spark, self.key, self.order = spark, key, order
        self.path = path or stage_path(spark, "upsert")
        self.state = self._manifest()
        if self.state and [self.state["key"], self.state["order"]] != [key, order]:
            raise ValueError(f"{self.path} was written with key {self.state['key']} and order {self.state['order']}")
        self.buckets = self.state.get("buckets") or buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

    @property
    def runs(self) -> list[str]:
        """Names of the runs that count, oldest first."""
        return [name for name, _ in self.state.get("runs", [])]

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def _manifest(self) -> dict:
        """The latest manifest; empty where nothing was upserted."""
        numbers = [int(m[1]) for m in map(re.compile(r"(\d+)\.json$").match, self._names("manifest")) if m]
        self.version = max(numbers, default=0)
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{self.version}.json", wholetext=True).first()[0]) if numbers else {}

    def _commit(self, runs: list[list[str]], schema: str) -> None:
        """Make ``runs`` (name, folder) the ones that count. Two writers cannot commit the same version."""
        self.state = {"key": self.key, "order": self.order, "buckets": self.buckets, "schema": schema, "runs": runs}
        fs, p = self._fs(f"manifest/.{uuid.uuid4().hex}")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(self.state), "utf-8"))
        out.close()
        to = self._fs(f"manifest/{self.version + 1}.json")[1]
        if fs.exists(to) or not fs.rename(p, to):
            raise RuntimeError(f"{to} was written by another writer")
        self.version += 1

    def _write(self, x: DataFrame) -> str:
        """Write rows that are partitioned by bucket as a bucketed, sorted folder; gives its name."""
        folder = f"run-{uuid.uuid4().hex[:12]}"
        name = f"tidewrack_{folder.replace('-', '_')}"
        x.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.path}/{folder}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay: a table with a path is external
        return folder

    def _run(self, folder: str) -> DataFrame:
        """A run as a bucketed, sorted relation."""
        name = f"tidewrack_{uuid.uuid4().hex[:12]}"
        schema = self.spark.sparkContext._jvm.org.apache.spark.sql.types.StructType.fromDDL(self.state["schema"]).toDDL()
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'")
        x = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return x

    def upsert(self, batch: DataFrame, run: str) -> None:
        """Add ``batch`` as run ``run``; a run of that name is replaced. Rows with a null key are ignored."""
        x = batch.filter(F.col(self.key).isNotNull())
        whole = F.struct(*[F.col(f"`{c}`") for c in x.columns])
        x = x.groupBy(F.col(self.key).alias("__key")).agg(F.min_by(whole, F.struct(*self.order)).alias("__row")).select("__row.*")
        folder = self._write(x.repartition(self.buckets, self.key))
        self._commit([r for r in self.state.get("runs", []) if r[0] != run] + [[run, folder]], self.state.get("schema") or x._jdf.schema().toDDL())

    def read(self) -> DataFrame:
        """All runs merged: exactly one row per identifier."""
        if not self.runs:
            raise ValueError("nothing was upserted")
        return reduce(self._merged, [self._run(folder) for _, folder in self.state["runs"]])

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two sets of rows, each with one row per identifier, as one: a full merge join of sorted buckets."""
        x = a.alias("a").join(b.alias("b"), F.col(f"a.{self.key}") == F.col(f"b.{self.key}"), "full")
        rank = lambda t: F.struct(*[F.col(f"{t}.{c}") for c in self.order])
        first = F.col(f"b.{self.key}").isNull() | (F.col(f"a.{self.key}").isNotNull() & (rank("a") <= rank("b")))
        return x.select(*[F.when(first, F.col(f"a.`{c}`")).otherwise(F.col(f"b.`{c}`")).alias(c) for c in a.columns])

    @contextmanager
    def _in_order(self) -> Iterator[None]:
        """Let scans of one sorted file a bucket count as sorted."""
        name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(name, "false")
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def compact(self) -> None:
        """Merge the sorted runs into one, then remove what no longer counts."""
        if len(self.runs) > 1:
            with self._in_order():
                # the two oldest first: each step is a merge of sorted buckets into sorted buckets
                while len(self.runs) > 1:
                    (name, a), (_, b), *rest = self.state["runs"]
                    self._commit([[name, self._write(self._merged(self._run(a), self._run(b)))], *rest], self.state["schema"])
        live = {folder for _, folder in self.state.get("runs", [])}
        for folder in self._names(""):
            if folder.startswith("run-") and folder not in live:
                drop_path(self.spark, f"{self.path}/{folder}")
        for name in self._names("manifest"):
            if name != f"{self.version}.json":
                drop_path(self.spark, f"{self.path}/manifest/{name}")


def repeated_deliveries(messages: DataFrame, steps: int = 2, buckets: int | None = None, store: UpsertStore | None = None) -> DataFrame:
    """delivery_id of every delivery to drop: all of a message but its first.

    The first has the lowest received_at, then delivery_id (a null
    received_at counts as latest). A null or empty identifier equals no other,
    so its delivery stays. Whole messages enter the store in ``steps`` runs of
    consecutive batches (nulls first), which are then compacted. With a
    ``store`` (key ``mid``), its deliveries count too. Columns called mid or
    late are put aside.
    """
    spark = messages.sparkSession
    x = messages.drop("mid", "late").withColumns({"mid": canonical_message_id(F.col("message_id")), "late": F.col("received_at").isNull()})
    store = store or UpsertStore(spark, "mid", ["late", "received_at", "delivery_id"], buckets)
    batch = F.coalesce(F.col("batch_id"), F.lit(-1))
    cuts = sorted(set(x.agg(F.percentile_approx(batch, [k / steps for k in range(1, steps)])).first()[0] or [])) if steps > 1 else []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = x if lo is None else x.filter(batch > lo)
        part = part if hi is None else part.filter(batch <= hi)
        store.upsert(part, f"upto-{'end' if hi is None else hi}")
    store.compact()
    kept = store.read().select("delivery_id")
    # the anti-join is on the delivery, which is unique: no hot identifier meets in one task
    return x.filter(F.col("mid").isNotNull()).select("delivery_id").join(kept, "delivery_id", "left_anti")
