"""Sets of 64-bit keys as bitmaps of bounded size, to test keys in Arrow batches before they are shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap at most, 16 MB.
MAX_BITS = 1 << 27


def key_bitmap(keys: DataFrame, key: str, n: int) -> np.ndarray:
    """The ``n`` keys (BIGINT) as a bitmap in words of 64 bits: at least 128 bits a key, but MAX_BITS at most.

    Keys should be hashes: their low bits are the places. A key that is not in
    the set is taken for one that is with probability n / bits.
    """
    size = min(MAX_BITS, 1 << max(12, (128 * n).bit_length()))
    place = keys.select(F.col(key).bitwiseAND(F.lit(size - 1)).alias("p"))
    words = place.groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toPandas()
    out = np.zeros(size // 64, np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of the uint64 keys may be in the set."""
    place = keys & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
