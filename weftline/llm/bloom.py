"""A Bloom filter of bounded size over 64-bit hashes: built by an aggregation, tested in numpy on the workers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size that a filter never exceeds. With more hashes than it has room for, more others pass; none is ever lost.
MOST_BYTES = 16 << 20
_PROBES = 3


class BloomFilter:
    """Bits of a filter, sent to each worker once."""

    def __init__(self, spark, words: np.ndarray):
        self.bits = spark.sparkContext.broadcast(words)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key (unsigned) may be among those the filter was built of: always true for them."""
        words = self.bits.value
        most = np.uint64(64 * len(words) - 1)
        low, high = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32) | np.uint64(1)
        at = np.arange(len(keys))
        for i in range(_PROBES):  # only what passed so far is looked at again
            place = low[at] + np.uint64(i) * high[at] & most
            at = at[words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) != 0]
        out = np.zeros(len(keys), bool)
        out[at] = True
        return out


def bloom_filter(keys: DataFrame, key: str, most_bytes: int = MOST_BYTES) -> BloomFilter:
    """The filter of a column of well mixed 64-bit hashes (NULLs are ignored): at least 12 bits for each, at most ``most_bytes`` in all.

    Bits are or-ed map-side, and the driver gets only the filter's words.
    """
    known = keys.select(F.col(key).alias("k")).filter("k is not null")
    n = known.count()
    bits = 1 << max(6, min(max(12 * n, 1 << 12).bit_length(), most_bytes.bit_length() + 2))
    low, high = F.col("k").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("k", 32).bitwiseOR(F.lit(1))
    place = F.explode(F.array(*[(low + i * high).bitwiseAND(F.lit(bits - 1)) for i in range(_PROBES)]))
    words = known.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return BloomFilter(keys.sparkSession, out)
