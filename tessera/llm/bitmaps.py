"""Bit maps over 64-bit keys, of a size that is bounded and follows the keys: small enough for every
task to have one, and loose (they may hold more), so that a join always follows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import signed

#: Bits of a map, at least and at most (16 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def sized_map(keys: DataFrame) -> np.ndarray:
    """A map in which those of ``keys(key)`` are set, with some 16 bits for each of them, counted before;
    beyond ``MOST_BITS`` a map only lets more pass. At most a row for each 64 bits comes to the driver."""
    bits, wanted = LEAST_BITS, min(16 * keys.count(), MOST_BITS)
    while bits < wanted:
        bits *= 2
    place = F.pmod("key", F.lit(bits))
    rows = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, int(pmod(key, {bits}) & 63)))").alias("mask"))
    words, found = np.zeros(bits // 64, np.int64), rows.toArrow()
    words[found["word"].to_numpy()] = found["mask"].to_numpy()
    return words


def in_map(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of unsigned keys whether the map may hold them."""
    place = np.mod(signed(keys), len(words) * 64)
    return (words[place >> 6] >> (place & 63)) & 1 == 1
