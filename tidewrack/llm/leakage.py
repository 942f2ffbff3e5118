"""Problem 8: evaluation texts leaking into training text.

A prefix-filtered set join between documents and held-out items on shingles of
five words:

1. Items become rows of (item, shingle, positions), and all their shingles a
   bitmap of bounded size. Documents are read once, whole; only shingles that
   are in the bitmap leave the batch.
2. Shingles are ordered by rarity, the number of documents that have them. An
   item of w words needs ceil(w/2) covered words, hence at least
   need = ceil(ceil(w/2)/5) matching shingle positions. Of its
   positions - need + m rarest ones m must match: only these prefix shingles
   are joined, with m = MATCHES where need is as much.
3. Bounds and verification: pairs with fewer than m matches among the prefix
   positions drop out at once. The others get all their matching shingles; the
   length bound (at least ``need`` positions) goes first, then the exact test
   that the words under matching positions are at least half.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.bitmaps import in_bitmap, key_bitmap
from tidewrack.llm.words import WordHash, shingles, words_of
from tidewrack.session import spread, staged, work_slots

WIDTH = 5
#: Matches that a pair must have among the prefix positions, where it needs as many in all.
MATCHES = 2
# What is not part of a text.
_TIME = r"(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.,]\d+)?"
_SETTINGS = r"(?:[ \t]+(?:align|line|position|region|size|vertical):\S+)*"
MARKS = re.compile(rf"(?<![\w:.,]){_TIME}[ \t]*-->[ \t]*{_TIME}(?![\w:]){_SETTINGS}|\[\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?:[.,]\d+)?\]|\bSpeaker\s+\d+\s*:")


def spoken_words(text: str | None) -> list[str]:
    """Words of ``text`` without cue times, ``[hh:mm:ss]`` marks and ``Speaker n:`` labels."""
    return words_of(MARKS.sub(" ", text)) if text else []


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, n_words, shingle, pos: one row per position. Items of fewer than five words cannot leak and have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHash()
        for b in batches:
            out = []
            for i, t in zip(b["item_id"], b["text"]):
                w = spoken_words(t)
                if len(w) >= WIDTH:
                    s = shingles(hashed(w), WIDTH).view(np.int64)
                    out.append(pd.DataFrame({"item_id": i, "n_words": len(w), "shingle": s, "pos": np.arange(len(s), dtype=np.int32)}))
            if out:
                yield pd.concat(out)

    return items.filter(F.col("item_id").isNotNull()).select("item_id", "text").mapInPandas(run, "item_id bigint, n_words int, shingle bigint, pos int")


def document_shingles(documents: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """doc_id, shingle: the distinct shingles of each document that may be in ``bitmap``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHash()
        for b in batches:
            ids, found = [], []
            for i, t in zip(b["doc_id"], b["text"]):
                w = spoken_words(t)
                if len(w) >= WIDTH:
                    s = shingles(hashed(w), WIDTH)
                    ids.append(i)
                    found.append(np.unique(s[in_bitmap(bitmap, s)]))
            if ids:
                yield pd.DataFrame({"doc_id": np.repeat(np.array(ids, np.int64), [len(s) for s in found]), "shingle": np.concatenate(found).view(np.int64)})

    return documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(run, "doc_id bigint, shingle bigint")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id where at least half of the item's words lie in stretches of five or more words that the document has too.

    Null, empty and short texts match nothing; a key that occurs in several
    rows counts once for each of its texts' matches together (one output row).
    Other columns are not read.
    """
    spark = documents.sparkSession
    it = staged(item_shingles(items.repartition(max(1, min(16, work_slots(spark))))), "leak-items")
    bitmap = key_bitmap(it, "shingle", it.count())
    found = staged(document_shingles(spread(documents.select("doc_id", "text")), bitmap).distinct(), "leak-found")
    rarity = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    per_item = staged(it.groupBy("item_id", "n_words", "shingle").agg(F.sort_array(F.collect_list("pos")).alias("at")), "leak-positions")
    need = F.ceil(F.ceil(F.col("n_words") / 2) / WIDTH)
    # windows are over one item, and an item is one text
    ranked = per_item.select("item_id", "n_words", "shingle", F.size("at").alias("k")).join(rarity, "shingle", "left").fillna(0, ["df"])
    w = Window.partitionBy("item_id", "n_words")
    ranked = ranked.withColumn("total", F.sum("k").over(w)).withColumn("before", F.sum("k").over(w.orderBy("df", "shingle").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k"))
    least = F.least(F.lit(MATCHES), need)
    prefix = ranked.filter(F.col("before") < F.col("total") - need + least).select("item_id", "n_words", "shingle", "k")
    pairs = found.join(prefix, "shingle").groupBy("doc_id", "item_id", "n_words").agg(F.sum("k").alias("k")).filter(F.col("k") >= least).select("doc_id", "item_id", "n_words")
    hits = pairs.join(per_item, ["item_id", "n_words"]).join(found, ["doc_id", "shingle"])
    hits = hits.groupBy("doc_id", "item_id", "n_words").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at"))
    hits = hits.filter(F.size("at") >= need)
    # words covered: each matching position adds the words it does not share with the position before it
    gaps = F.transform("at", lambda p, i: F.when(i == 0, F.lit(WIDTH)).otherwise(F.least(F.lit(WIDTH), p - F.col("at")[F.greatest(i - 1, F.lit(0))])))
    covered = F.aggregate(gaps, F.lit(0), lambda a, g: a + g)
    return hits.filter(covered * 2 >= F.col("n_words")).select("doc_id", "item_id").distinct()
