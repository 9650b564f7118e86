"""Bloom filters of ids as bit sets: what keeps rows out of a shuffle that would find nothing there.

Tasks turn ids into bits, bits into 64-bit words, and the words are OR-ed over all tasks; the driver
gets one bit set whose size follows from the number of ids. Rows whose id is surely not among them are
told apart where they are read, and only the others are shuffled to the exact join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits per id and hashes per id: about one in a hundred other ids passes.
BITS, HASHES = 10, 7

# Larger bit sets are not sent to the executors; the join then shuffles both sides whole.
FILTER_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class BloomFilter:
    bits: int
    words: Broadcast

    def may_hold(self, id_col: Column) -> Column:
        """Whether an id may be among those of the filter; no id among them is ever told away."""
        bits, shared = self.bits, self.words

        @F.arrow_udf("boolean")
        def test(first: pa.Array, second: pa.Array) -> pa.Array:
            words = shared.value
            a = first.to_numpy(zero_copy_only=False).view(np.uint64)
            b = second.to_numpy(zero_copy_only=False).view(np.uint64) | np.uint64(1)
            found = np.ones(len(a), bool)
            with np.errstate(over="ignore"):
                for number in range(HASHES):
                    place = (a + np.uint64(number) * b) % np.uint64(bits)
                    found &= (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            return pa.array(found)

        return test(*hashes(id_col))


def hashes(id_col: Column) -> tuple[Column, Column]:
    """Two independent hashes of an id; a NULL id hashes like an empty one."""
    id_ = F.coalesce(id_col, F.lit(""))
    return F.xxhash64(id_), F.xxhash64(F.concat(F.lit("#"), id_))


def bits_of(n_ids: int) -> int:
    return max(64, 64 * math.ceil(n_ids * BITS / 64))


def bloom_filter(ids: DataFrame, n_ids: int) -> BloomFilter | None:
    """The filter of the ``id`` column of ``n_ids`` rows, or None if it would be too large."""
    bits = bits_of(n_ids)
    if bits // 8 > FILTER_BYTES:
        return None

    def set_bits(batches):
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            a = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            b = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) | np.uint64(1)
            with np.errstate(over="ignore"):
                for number in range(HASHES):
                    place = (a + np.uint64(number) * b) % np.uint64(bits)
                    np.bitwise_or.at(words, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(words[used].view(np.int64))], names=["place", "word"]
        )

    first, second = hashes(F.col("id"))
    parts = ids.select(first.alias("a"), second.alias("b")).mapInArrow(set_bits, "place long, word long")
    words = np.zeros(bits // 64, np.int64)
    found = parts.groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()
    words[found.column("place").to_numpy()] = found.column("word").to_numpy()
    return BloomFilter(bits, ids.sparkSession.sparkContext.broadcast(words.view(np.uint64)))
