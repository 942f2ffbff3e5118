"""Problem 9: mixing sources to target weights.

Weighted fair queueing over documents: each source is shuffled (by a hash of
its documents) and used up to its cap of passes; a document's virtual finish
time is the cumulative token count of its source divided by the source's
target share. Reading all documents by finish time keeps the sources' shares
on target at every moment, so the mixture is a global range sort cut at the
total budget.

The cumulative sums are two-level: sums per (source, pass, slice of the hash
order) first, then a running sum within a slice. No task holds a source.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.session import spread, staged, tokenizer_dir


#: Parts of time whose tokens are summed at once, documents ordered in one task, documents of a slice on average.
TICKS, EDGE, SLICE = 4096, 20_000, 20_000


def token_counts(df: DataFrame, text: str, vocabulary: str | None = None) -> DataFrame:
    """``df`` with ``tokens`` INT, the number of byte-level BPE tokens of ``text``; 0 for null and empty.

    ``vocabulary`` is the path of a ``.tiktoken`` rank file on every worker.
    """
    path = vocabulary or os.path.join(tokenizer_dir(), "byte_bpe_50k.tiktoken")

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        enc = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for s in batches:
            yield s.map(lambda t: len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0).astype("int32")

    return df.withColumn("tokens", count(F.col(text)))


def _slices(order_hash: Column, n: int) -> Column:
    """Slice 0 .. n-1 of a 64-bit hash, in hash order."""
    return F.floor((F.shiftrightunsigned(order_hash, 1) / F.lit(2.0**63)) * n).cast("int")


def _clock(plan: list[tuple[int, int, float, int]], limit: int) -> float:
    """A virtual time after which no document fits ``limit`` any more, or the last finish time where all may.

    ``plan`` has tokens, cap, share and longest document of every source. By
    time t a source has given min(share * t, cap * size) tokens, less at most
    one document; the sum over the sources is linear between the times at
    which sources are used up.
    """
    wanted = limit + sum(longest for *_, longest in plan)
    ends = sorted((size * cap / share, share, size * cap) for size, cap, share, _ in plan)
    rate, given = sum(share for _, share, _ in ends), 0
    for end, share, whole in ends:
        if given + rate * end >= wanted:
            return (wanted - given) / rate
        rate, given = rate - share, given + whole
    return ends[-1][0] if ends else 0.0


def mix_sources(documents: DataFrame, targets: DataFrame, seed: int = 7, budget: int | None = None, slices: int | None = None) -> DataFrame:
    """The mixture: doc_id, source, pass_no, tokens, finish; ordered by range on (finish, source, doc_id).

    ``targets`` has source, target_share, max_repeats (times a document may be
    used). Shares are taken relative to their sum. ``budget`` is the total of
    tokens; without it, the largest total that every source can serve at its
    share. A smaller source than its share needs is used up to its cap, and
    the shares reached show it. A document is in the mixture when its finish
    time is at most the cut, the last time at which the total fits the budget.

    Sources without a target, null sources, null ids and texts without tokens
    take no part; a target below or equal to 0, or a cap below 1, takes its
    source out. Repeated ids are documents of their own.
    """
    goal = targets.filter("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    all_shares = goal.agg(F.sum("share")).first()[0] or 1.0  # one number
    goal = goal.select("source", (F.col("share") / all_shares).alias("share"), "cap")
    docs = spread(documents.filter("source is not null and doc_id is not null").select("doc_id", "source", "text"))
    docs = docs.join(goal, "source", "left_semi")
    docs = token_counts(docs, "text").select("doc_id", "source", "tokens").filter("tokens > 0")
    docs = staged(docs, "mix-tokens")
    size = docs.groupBy("source").agg(F.sum("tokens").alias("size"), F.max("tokens").alias("longest"))
    plan = goal.join(size, "source")
    # one number: the total that every source can serve
    limit = plan.agg(F.floor(F.min(F.col("size") * F.col("cap") / F.col("share"))).cast("bigint")).first()[0] if budget is None else budget
    limit = int(limit or 0)
    slices = slices or max(16, -(-docs.count() // SLICE))
    used = docs.join(plan.drop("size", "longest"), "source").withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.col("cap").cast("int"))))
    used = used.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "pass_no")).withColumn("slice", _slices(F.col("h"), slices))
    # running tokens: whole passes before, whole slices before, then documents before within the slice
    by_slice = used.groupBy("source", "pass_no", "slice").agg(F.sum("tokens").alias("t"))
    w = Window.partitionBy("source").orderBy("pass_no", "slice").rowsBetween(Window.unboundedPreceding, -1)
    before = by_slice.select("source", "pass_no", "slice", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "pass_no", "slice").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    used = used.withColumn("here", F.sum("tokens").over(inside)).join(before, ["source", "pass_no", "slice"])
    used = used.withColumn("finish", (F.col("before") + F.col("here")) / F.col("share")).select("doc_id", "source", "pass_no", "tokens", "finish")
    # one row per source
    last_time = _clock([tuple(r) for r in plan.select("size", F.col("cap").cast("bigint"), "share", "longest").collect()], limit) * (1 + 1e-9)
    used = staged(used.filter(F.col("finish") <= last_time + 1), "mix-finish")
    low, high, spent = _crossing(used, 0.0, last_time + 1, limit)
    # only the documents between the two times are ordered by themselves, EDGE of them or fewer
    at = used.filter(F.col("finish").between(low, high)).withColumn("upto", F.sum("tokens").over(Window.orderBy("finish", "source", "doc_id", "pass_no")) + F.lit(spent)).filter(F.col("upto") <= limit)
    chosen = used.filter(F.col("finish") < low).unionByName(at.drop("upto"))
    return chosen.repartitionByRange("finish", "source", "doc_id").sortWithinPartitions("finish", "source", "doc_id", "pass_no")


def _crossing(used: DataFrame, low: float, high: float, limit: int) -> tuple[float, float, int]:
    """Two finish times between which the running tokens pass ``limit``, and the tokens before the first.

    The time is cut into TICKS parts, and the part that passes the limit into
    as many again, until it has no more than EDGE documents or one finish time.
    """
    spent = 0
    while True:
        tick = F.floor((F.col("finish") - F.lit(low)) / F.lit(max(high - low, 1e-300) / TICKS))
        x = used.filter(F.col("finish").between(low, high)).groupBy(tick.alias("tick")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high"))
        for r in sorted(x.collect(), key=lambda r: r.tick):  # TICKS + 1 rows at most
            if spent + r.t > limit:
                break
            spent += r.t
        else:
            return math.nextafter(high, math.inf), math.inf, spent
        if r.n <= EDGE or r.low == r.high:
            return r.low, r.high, spent
        low, high = r.low, r.high


def reached_shares(mixture: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, docs_used, uses, tokens, actual_share, most_uses: one row per target source."""
    per_doc = mixture.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    s = per_doc.groupBy("source").agg(F.count(F.lit(1)).alias("docs_used"), F.sum("n").alias("uses"), F.sum("t").alias("tokens"), F.max("n").alias("most_uses"))
    s = staged(s, "mix-report")  # one row per source
    all_tokens = s.agg(F.sum("tokens")).first()[0] or 1
    x = targets.filter("source is not null").join(s, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return x.select("source", "target_share", "max_repeats", zero("docs_used"), zero("uses"), zero("tokens"), zero("most_uses"), F.round(F.coalesce("tokens", F.lit(0)) / F.lit(all_tokens), 6).alias("actual_share"))


def share_bounds(mixture: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """source, within_cap, on_target: whether a mixture keeps its promises, from its rows and a count of its own.

    A source is on target if its tokens differ from its share of all by no more
    than its longest document, and its part of the longest ones of all, can
    bring about.
    """
    longest = token_counts(documents.filter("source is not null and doc_id is not null").select("source", "text"), "text").groupBy("source").agg(F.max("tokens").alias("longest"))
    x = targets.filter("source is not null").join(longest, "source", "left").fillna(0, ["longest"])
    used = mixture.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).groupBy("source").agg(F.max("n").alias("most"), F.sum("t").alias("t"))
    x = staged(x.join(used, "source", "left").fillna(0, ["most", "t"]), "mix-bounds")  # one row per source
    whole = x.agg(F.sum("t"), F.sum("longest")).first()
    gap = F.abs(F.col("t") - F.col("target_share") * F.lit(whole[0] or 0))
    return x.select("source", (F.col("most") <= F.col("max_repeats")).alias("within_cap"), (gap <= F.col("longest") + F.col("target_share") * F.lit(whole[1] or 0)).alias("on_target"))
