"""Bloom filters of keys, so that joins need not move rows that have no partner.

A key sets four bits of one 64-bit word.  Words are added up by ``bit_or``, with
partial aggregation, and sent to all tasks: 16 bits a key, at most ``MAX_WORDS``
words.  Beyond that more rows pass that need not; what passes is always joined
exactly, so results don't depend on it.

Null keys are in no filter.  A filter of no keys lets nothing pass.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.batches import fresh_name, quoted
from threatloom.session import stored

MAX_WORDS = 1 << 20
KEYS_PER_WORD = 4
_SHIFTS = (0, 6, 12, 18)


def key_hash(*columns: Column | str, seed: int = 0) -> Column:
    """The hash of a key, null where one of its columns is null; another one for each seed.

    Types count: compare keys of one type only.
    """
    keys = [F.col(quoted(c)) if isinstance(c, str) else c for c in columns]
    missing = keys[0].isNull()
    for key in keys[1:]:
        missing = missing | key.isNull()
    return F.when(~missing, F.xxhash64(F.lit(0xB10 + seed), *keys))


def _bits(h: Column) -> Column:
    one = F.lit(1).cast("bigint")
    parts = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int")) for s in _SHIFTS]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])


class Bloom:
    """A written table (word, bits) of ``size`` words, and how to ask it."""

    def __init__(self, table: DataFrame, size: int, seed: int = 0) -> None:
        self.table, self.size, self.seed = table, size, seed

    @classmethod
    def of(cls, keys: DataFrame, *columns: Column | str, seed: int = 0) -> Bloom:
        """The filter of all keys of a table."""
        hashed = keys.select(key_hash(*columns, seed=seed).alias("h")).where("h IS NOT NULL")
        size = max(1, min(MAX_WORDS, hashed.count() // KEYS_PER_WORD + 1))
        h = F.col("h")
        rows = hashed.select((F.shiftrightunsigned(h, 24) % size).alias("word"), _bits(h).alias("bits"))
        return cls(stored(rows.groupBy("word").agg(F.bit_or("bits").alias("bits")), "bloom"), size, seed)

    @cached_property
    def words(self) -> np.ndarray:
        """The words as an array."""
        found = self.table.toArrow()
        words = np.zeros(self.size, np.uint64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return words

    def split(self, df: DataFrame, *columns: Column | str) -> tuple[DataFrame, DataFrame]:
        """Rows of ``df`` whose key may be in the filter, and all others; rows with null keys are among the others."""
        word, bits, other, theirs = (fresh_name(df, n) for n in ("bloom_word", "bloom_bits", "bloom_other", "bloom_theirs"))
        h = key_hash(*columns, seed=self.seed)
        marked = df.withColumns({word: F.shiftrightunsigned(h, 24) % self.size, bits: _bits(h)})
        # at most MAX_WORDS rows
        sent = F.broadcast(self.table.toDF(other, theirs))
        met = marked.join(sent, F.col(word) == F.col(other), "left")
        passes = F.coalesce(F.col(theirs).bitwiseAND(F.col(bits)) == F.col(bits), F.lit(False))
        own = [F.col(quoted(c)) for c in df.columns]
        return met.where(passes).select(*own), met.where(~passes).select(*own)


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for hashes of keys that are not in the filter of these words."""
    h = hashes.astype(np.int64).view(np.uint64)
    bits = np.zeros(len(h), np.uint64)
    for shift in _SHIFTS:
        bits |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
    return (words[(h >> np.uint64(24)) % np.uint64(len(words))] & bits) == bits
