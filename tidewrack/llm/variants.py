"""Problem 4: near-duplicate records with small edits.

Deletion-variant signatures. A record's word sequences become a signature of
SLOTS minwise symbols, cut into segments of WIDTH symbols. Two records of
similarity s agree in a symbol with probability s, so among the segments of a
similar pair one differs in at most one symbol nearly surely, with far fewer
and wider segments than if one had to agree entirely. Every segment is
indexed under each of its one-wildcard variants (one symbol deleted); records
that share a variant meet in the partition of its key, pass a test of 128
symbols of their signatures, and are verified on their whole sets.

The symbols are minwise hashes, not single bits: at a similarity of 0.5 two
64-bit fingerprints differ in about 16 bits, and segments short enough to
differ in one would no longer select anything.

Pairs of unlike records that meet grow with the square of the records, so a
variant must be selective: at a similarity of 0.07, two records share a given
one with probability 0.07 ^ (WIDTH - 1). Keys are moved in packed blocks of
some 8 bytes a key, not as rows, and not of all segments at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.bitmaps import in_bitmap, key_bitmap
from tidewrack.llm.words import WordHash, mix, shingles, words_of
from tidewrack.session import spread, staged, unstaged

SHINGLE = 3
WIDTH = 5
#: 44 segments: a pair of similarity 0.5 shares a variant with probability 1 - (1 - 0.1875)^44 = 0.9999, one of 0.6 with 0.9999999.
SEGMENTS = 44
#: Segments are looked up in so many rounds; the disk that a round takes is free for the next.
ROUNDS = 4
SLOTS = WIDTH * SEGMENTS
#: Variant keys, or pairs, to a partition of their join, at most on average.
KEYS_A_PART = 500_000
#: Bytes of a variant key that are kept within its partition.
KEY_BYTES = 5
#: Pairs that leave a partition of keys in one go.
PAIRS_A_BATCH = 200_000
#: Members of a class that are paired with as many others in one go.
BLOCK = 1000
#: Symbols of the sketch, two bits each: 32 to a BIGINT.
SKETCH = 128
#: Sketch symbols in which a candidate pair may differ: 48 +- 5.5 at similarity 0.5 (more than 72 with probability 6e-6), 87 +- 5 at 0.07.
SKETCH_APART = 72


def _family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(n, dtype=np.uint64)
    return mix(k, seed) | np.uint64(1), mix(k, seed + 1)


_A, _B = _family(SLOTS, 901)


def least_hashes(g: np.ndarray) -> np.ndarray:
    """The least of each of SLOTS linear hashes over a set of mixed 64-bit values; long sets go in pieces."""
    out = np.full(len(_A), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for k in range(0, len(g), 2048):
            out = np.minimum(out, (g[k : k + 2048, None] * _A + _B).min(axis=0))
    return out


_SKETCHES = [f"s{k}" for k in range(SKETCH // 32)]


def _signed(ids: list[int], sets: list[np.ndarray]) -> pd.DataFrame:
    """item_id, same1, same2, symbols (16 bits each) and the sketch of records with these sets, none of them empty."""
    if not ids:
        return pd.DataFrame({c: pd.Series([], dtype=object if c == "symbols" else "int64") for c in ("item_id", "same1", "same2", "symbols", *_SKETCHES)})
    starts = np.cumsum([0, *map(len, sets)])
    every = np.concatenate(sets)
    symbols = (mix(np.stack([least_hashes(g) for g in sets]), 7) >> np.uint64(48)).astype("<u2")
    with np.errstate(over="ignore"):
        same1 = np.add.reduceat(mix(every, 1), starts[:-1])
    same2 = np.bitwise_xor.reduceat(mix(every, 2), starts[:-1])
    two = (symbols[:, :SKETCH] & 3).astype(np.uint8).reshape(len(ids), -1, 4) << np.array([0, 2, 4, 6], np.uint8)
    sketch = np.bitwise_or.reduce(two, axis=2).view("<i8")
    out = {"item_id": ids, "same1": same1.view(np.int64), "same2": same2.view(np.int64), "symbols": [x.tobytes() for x in symbols]}
    return pd.DataFrame(out | {c: sketch[:, k] for k, c in enumerate(_SKETCHES)})


def signatures(items: DataFrame, min_words: int) -> DataFrame:
    """item_id, same (128-bit identity of the set, as two longs), symbols and sketch for records of enough words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHash()
        for b in batches:
            ids, sets = [], []
            for i, title, text in zip(b["item_id"], b["title"], b["text"]):
                w = words_of(text)
                if len(w) >= min_words:
                    ids.append(i)
                    sets.append(np.unique(shingles(hashed(words_of(title) + w), SHINGLE)))
            yield _signed(ids, sets)

    schema = "item_id bigint, same1 bigint, same2 bigint, symbols binary, " + ", ".join(f"{c} bigint" for c in _SKETCHES)
    x = spread(items.filter("item_id is not null and text is not null").select("item_id", "title", "text"), 4)
    return x.mapInPandas(run, schema)


def variant_keys(symbols: np.ndarray, turn: int) -> np.ndarray:
    """Hashes of the one-wildcard variants of a round's segments, SLOTS / ROUNDS to a row of symbols."""
    place, segment = np.arange(WIDTH, dtype=np.uint64), np.arange(turn, SEGMENTS, ROUNDS)
    with np.errstate(over="ignore"):
        each = mix(symbols.reshape(-1, SEGMENTS, WIDTH)[:, segment].astype(np.uint64) * np.uint64(31) + place, 11)  # a symbol at its place
        whole = each.sum(axis=2, dtype=np.uint64)[:, :, None]
        keys = mix((whole - each) * np.uint64(31) + place + np.uint64(WIDTH) * segment.astype(np.uint64)[:, None], 13)
    return keys.reshape(len(symbols), -1)


def _packed(sig: DataFrame, parts: int, turn: int) -> DataFrame:
    """part, least, wide, packed: for each batch of records, its variant keys of a round that belong to a part.

    A key is KEY_BYTES bytes of its hash, the rest of which tells the part,
    and as many bytes as the batch needs to tell its item_id from the least
    one. Bytes of one place lie together, so that those alike compress.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            keys = variant_keys(np.frombuffer(b"".join(b["symbols"]), "<u2").reshape(len(b), SLOTS), turn)
            each, keys = keys.shape[1], keys.reshape(-1)
            ids = b["item_id"].to_numpy(np.int64)
            least = ids.min()
            beyond = ids.view(np.uint64) - least.view(np.uint64)
            wide = max(1, -(-int(beyond.max()).bit_length() // 8))
            part = ((keys >> np.uint64(8 * KEY_BYTES)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part = part[order]
            low = keys[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            rec = beyond[order // each].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]
            both = np.concatenate([low, rec], axis=1)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            yield pd.DataFrame({"part": part[cuts[:-1]], "least": least, "wide": np.int32(wide), "packed": [both[i:j].T.tobytes() for i, j in zip(cuts, cuts[1:])]})

    return sig.select("item_id", "symbols").mapInPandas(run, "part int, least bigint, wide int, packed binary")


def _unpacked(least: int, wide: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The keys and the item_ids of a row of ``_packed``."""
    both = np.frombuffer(packed, np.uint8).reshape(KEY_BYTES + wide, -1)
    out = np.zeros((2, both.shape[1], 8), np.uint8)
    out[0, :, :KEY_BYTES], out[1, :, :wide] = both[:KEY_BYTES].T, both[KEY_BYTES:].T
    keys, beyond = out.view("<u8")[:, :, 0]
    return keys, (beyond + np.array([least], np.int64).view(np.uint64)).view(np.int64)


def _meeting(keys: np.ndarray, ids: np.ndarray) -> Iterator[pd.DataFrame]:
    """a < b of all records with an equal key; a pair that shares several keys comes once in a batch."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    ids, pos = np.unique(ids[order], return_inverse=True)
    held, n, apart = [], 0, 1
    while len(starts):
        starts, sizes = starts[sizes > apart], sizes[sizes > apart]
        many = np.cumsum(sizes - apart)
        # of a key with many records, at most so many pairs in one go
        cuts = np.searchsorted(many, np.arange(0, many[-1] if len(many) else 0, PAIRS_A_BATCH), side="right")
        for i, j in zip(cuts, [*cuts[1:], len(starts)]):
            m = sizes[i:j] - apart
            x = np.repeat(starts[i:j] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum()) if j > i else np.zeros(0, np.int64)
            a, b = pos[x], pos[x + apart]
            held.append((np.minimum(a, b) * len(ids) + np.maximum(a, b))[a != b])
            n += len(x)
            if n >= PAIRS_A_BATCH:
                yield _pairs_of(held, ids)
                held, n = [], 0
        apart += 1
    yield _pairs_of(held, ids)


def _pairs_of(codes: list[np.ndarray], ids: np.ndarray) -> pd.DataFrame:
    x = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]))
    return pd.DataFrame({"a": ids[x // len(ids)], "b": ids[x % len(ids)]})


def _met(packed: DataFrame) -> DataFrame:
    """a < b: records that share a key; rows of ``packed`` come in order of part, and all of a part together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for b in batches:
            for part, *row in zip(b["part"], b["least"], b["wide"], b["packed"]):
                if part != at and held:
                    yield from _meeting(*map(np.concatenate, zip(*held)))
                    held = []
                at = part
                held.append(_unpacked(*row))
        if held:
            yield from _meeting(*map(np.concatenate, zip(*held)))

    return packed.mapInPandas(run, "a bigint, b bigint")


def similar_classes(items: DataFrame, threshold: float = 0.5, min_words: int = 50) -> tuple[DataFrame, DataFrame]:
    """(members, links): item_id -> rep, and rep_a < rep_b for classes alike enough.

    A class is the records with equal sets of word sequences; its
    representative is the least item_id. Copies are never paired here.
    """
    spark = items.sparkSession
    sig = staged(signatures(items, min_words), "variant-signatures", free=True)
    # sides that grow with the data are merged, not broadcast
    first = sig.groupBy("same1", "same2").agg(F.min("item_id").alias("rep"))  # a hot class costs one row per map task
    members = sig.select("same1", "same2", "item_id").hint("merge").join(first, ["same1", "same2"]).groupBy("item_id").agg(F.min("rep").alias("rep"))
    members = staged(members, "variant-members", free=True)
    # the other members are few where most records are no copies; the planner decides by their size at run time
    reps = sig.drop("same1", "same2").join(members.filter("item_id <> rep").select("item_id"), "item_id", "left_anti")
    reps = staged(reps, "variant-reps", free=True)
    unstaged(sig)
    parts = _parts(spark, reps.count() * SLOTS // ROUNDS)
    found = []
    for turn in range(ROUNDS):
        met = staged(_met(_packed(reps, parts, turn).repartitionById(parts, "part").sortWithinPartitions("part")), "variant-pairs", free=True)
        found.append(staged(_promising(met, reps), "variant-promising", free=True))
        unstaged(met)
    unstaged(reps)
    pairs = staged(reduce(DataFrame.unionByName, found).distinct(), "variant-candidates", free=True)
    for x in found:
        unstaged(x)
    # whole sets only of records that have a candidate, and of some that a full bitmap takes for such
    ids = pairs.select(F.col("a").alias("item_id")).unionByName(pairs.select(F.col("b").alias("item_id"))).distinct()
    ids = staged(ids.select(F.xxhash64("item_id").alias("h")), "variant-ids", free=True)
    grams = staged(_sets(items, key_bitmap(ids, "h", ids.count())), "variant-sets", free=True).dropDuplicates(["item_id"])
    pairs = pairs.hint("merge").join(grams.selectExpr("item_id as a", "grams as ga"), "a").hint("merge").join(grams.selectExpr("item_id as b", "grams as gb"), "b")
    both, na, nb = F.size(F.array_intersect("ga", "gb")), F.size("ga"), F.size("gb")
    links = pairs.filter(both >= threshold * (na + nb - both)).selectExpr("a as rep_a", "b as rep_b").distinct()
    return members, links


def _promising(met: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs a, b of ``met``, once each, whose sketches do not differ too much."""
    # both the removal of repeats and the first join use the partitions by a record
    pairs = met.repartition(_parts(met.sparkSession, met.count()), "a").dropDuplicates(["a", "b"])
    sketch = reps.select("item_id", *_SKETCHES).dropDuplicates(["item_id"])
    side = lambda t: sketch.select(F.col("item_id").alias(t), *[F.col(c).alias(f"{t}{c}") for c in _SKETCHES])
    pairs = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    apart = " + ".join(f"bit_count(((a{c} ^ b{c}) | shiftrightunsigned(a{c} ^ b{c}, 1)) & {0x5555555555555555}L)" for c in _SKETCHES)
    return pairs.filter(F.expr(apart) <= SKETCH_APART).select("a", "b")


def _parts(spark, rows: int) -> int:
    """Partitions for so many short rows: the session's number, or more where one would get over KEYS_A_PART."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // KEYS_A_PART))


def _sets(items: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """item_id, grams: the set of word sequences of each record whose id may be in ``bitmap``; texts are not moved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHash()
        for b in batches:
            b = b[in_bitmap(bitmap, b["h"].to_numpy(np.int64).view(np.uint64))]
            grams = [np.unique(shingles(hashed(words_of(title) + words_of(text)), SHINGLE)).view(np.int64) for title, text in zip(b["title"], b["text"])]
            yield pd.DataFrame({"item_id": b["item_id"].to_numpy(np.int64), "grams": pd.Series(grams, dtype=object)})

    x = items.filter("item_id is not null and text is not null").select("item_id", "title", "text", F.xxhash64("item_id").alias("h"))
    return spread(x, 4).mapInPandas(run, "item_id bigint, grams array<bigint>")


def similar_pairs(items: DataFrame, threshold: float = 0.5, min_words: int = 50) -> DataFrame:
    """item_id_a < item_id_b for all pairs of records of at least ``min_words`` words whose similarity reaches ``threshold``.

    Similarity: Jaccard of the sets of three consecutive words of title (empty
    if null), a line break and text. Null or short texts are in no pair.
    item_id is a key: of rows that repeat one, one text counts, and a record is
    no pair with itself. Columns other than item_id, title and text are not read.
    """
    members, links = similar_classes(items, threshold, min_words)
    links = staged(links, "variant-links")
    size = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    size = staged(size, "variant-sizes")
    block = F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int").alias("block")
    # a block has about BLOCK members, whatever the size of its class
    lists = staged(members.hint("merge").join(size, "rep").groupBy("rep", block).agg(F.collect_list("item_id").alias("ids")), "variant-blocks")
    within = size.filter("n > 1").selectExpr("rep as rep_a", "rep as rep_b")
    of = lambda t: size.selectExpr(f"rep as rep_{t}", f"blocks as blocks_{t}")
    x = links.unionByName(within).hint("merge").join(of("a"), "rep_a").hint("merge").join(of("b"), "rep_b")
    to = lambda t: F.explode(F.sequence(F.lit(0), F.col(f"blocks_{t}") - 1)).alias(f"block_{t}")
    x = x.select("rep_a", "rep_b", "blocks_b", to("a")).select("rep_a", "rep_b", "block_a", to("b"))
    x = x.filter("rep_a <> rep_b or block_a <= block_b")
    side = lambda t: lists.selectExpr(f"rep as rep_{t}", f"block as block_{t}", f"ids as ids_{t}")
    x = x.hint("merge").join(side("a"), ["rep_a", "block_a"]).hint("merge").join(side("b"), ["rep_b", "block_b"])
    # pairs of blocks are spread before they are expanded, so that no task has all pairs of a class
    x = x.select((F.col("rep_a") == F.col("rep_b")).alias("own"), (F.col("block_a") == F.col("block_b")).alias("one"), "ids_a", "ids_b").repartition(_parts(items.sparkSession, 0))
    x = x.select("own", "one", F.explode("ids_a").alias("x"), "ids_b").select("own", "one", "x", F.explode("ids_b").alias("y"))
    return x.filter("not (own and one) or x < y").select(F.least("x", "y").alias("item_id_a"), F.greatest("x", "y").alias("item_id_b"))
