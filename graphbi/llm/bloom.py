"""Blocked Bloom filter: built by a Spark aggregation, probed with numpy.

A key's 64-bit hash picks one block of eight 64-bit words and one bit in each
word, so a probe touches a single cache line.  The bits are gathered as
``bit_or`` per word (pre-aggregated before the shuffle); the filter has a fixed
largest size, whatever the number of keys.  Beyond the size that this allows,
the share of false positives grows, and callers check hits exactly anyway.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
#: Largest filter in bytes (a multiple of the block size, a power of two).
MAX_BYTES = 1 << 24
BITS_PER_KEY = 16


def n_blocks_for(n_keys: int, max_bytes: int = MAX_BYTES) -> int:
    """Power of two, at least one block; never beyond ``max_bytes``."""
    need = max(1, n_keys * BITS_PER_KEY // (64 * WORDS))
    return min(1 << (need - 1).bit_length(), max_bytes // (8 * WORDS))


def build(keys: DataFrame, hash_col: Column, n_keys: int, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """The filter's words, shape (blocks, 8), of the rows' 64-bit hashes (bigint)."""
    blocks = n_blocks_for(n_keys, max_bytes)
    h = keys.select(hash_col.alias("h"))
    # the block comes from the upper bits, the bit in word i from six lower bits each
    block = F.shiftrightunsigned("h", 48).bitwiseXOR(F.shiftrightunsigned("h", 20)).bitwiseAND(F.lit(blocks - 1))
    bits = [_bit(i).alias(f"w{i}") for i in range(WORDS)]
    rows = (h.select(block.alias("block"), *bits).groupBy("block")
             .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]).toPandas())
    words = np.zeros((blocks, WORDS), dtype=np.uint64)
    if len(rows):
        words[rows["block"].to_numpy(dtype=np.int64)] = rows[[f"w{i}" for i in range(WORDS)]].to_numpy(dtype=np.int64).view(np.uint64)
    return words




def _bit(i: int) -> Column:
    # six bits of the hash rotated by 7 * i
    return F.expr(f"shiftleft(1L, cast((shiftrightunsigned(h, {7 * i + 3}) & 63) as int))")


def probe(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Booleans: may the key be in the filter? hashes: int64 or uint64."""
    h = hashes.astype(np.int64, copy=False).view(np.uint64)
    block = ((h >> np.uint64(48)) ^ (h >> np.uint64(20))) & np.uint64(len(words) - 1)
    rows, hit = words[block.astype(np.int64)], np.ones(len(h), dtype=bool)
    for i in range(WORDS):
        hit &= (rows[:, i] >> ((h >> np.uint64(7 * i + 3)) & np.uint64(63))) & np.uint64(1) == 1
    return hit
