"""Benchmark decontamination by SimHash over item-sized windows.

A document's words are read in windows as long as each benchmark item; one that
is shorter than an item is a single window for it, the whole text.  A window and
an item have a SimHash of their weighted shingles.  Fingerprints are cut into four
blocks of 16 bits; of two that differ in at most 15 bits, some block differs in at
most 3.  An item is filed under all values of its blocks within one bit, a window
looks up all values within two, so every fingerprint within the radius is found,
and of random ones 4 in 100.  What is found is verified by the exact weighted
Jaccard similarity of both bags of shingles.  Windows that hold too little of the
benchmark's shingles to pass that test get no fingerprint: what they share bounds
their similarity.

A shingle weighs ln(1 + items / items that have it); one that no item has weighs
as much as the rarest.  Words are compared in lower case and without ASCII
punctuation.  Items that have it are counted once over the whole benchmark, so a
match does not depend on which items are looked up together.  Items shorter than a shingle are one shingle; items without words
match nothing.  Null and empty texts match nothing; repeated rows match alike;
repeated items match under each id; an empty benchmark or table gives no
matches.  The benchmark is taken in blocks of a bounded number of items, each
sent to all tasks, so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.batches import Texts, byte_texts, fresh_name, quoted, with_struct
from threatloom.session import stored

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MATCH = "item_id bigint, start_word bigint, n_words bigint, hamming bigint, similarity double"
_GATE = 1 << 22


@dataclass(frozen=True)
class LeakParams:
    """Windows at least ``similarity`` alike an item are leaks; fingerprints may differ by ``radius`` bits."""

    words: int = 5
    similarity: float = 0.8
    radius: int = 15
    items_per_block: int = 20_000


def folded_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def shingles(words: list[bytes], wide: int) -> np.ndarray:
    """64-bit hash of every run of ``wide`` words; of all words, if they are fewer."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    wide = min(wide, n)
    made = np.full(n - wide + 1, wide, np.uint64)
    for i in range(wide):
        made = made * np.uint64(0x9E3779B97F4A7C15) + hashed[i : n - wide + 1 + i]
        made = (made ^ (made >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return made ^ (made >> np.uint64(32))


def _votes(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Votes of each shingle for the 64 bits; whole numbers, so sums in any order are the same."""
    bits = np.unpackbits(np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.rint(weights * (1 << 20)).astype(np.int64)[:, None] * (2 * bits.astype(np.int64) - 1)


def fingerprint(hashes: np.ndarray, weights: np.ndarray) -> int:
    """SimHash of 64 bits: the sign of each bit's weighted vote."""
    votes = _votes(hashes, weights).sum(axis=0)
    return int.from_bytes(np.packbits(votes > 0, bitorder="little").tobytes(), "little")


def window_marks(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Fingerprints of windows of ``span`` shingles, from running sums of their votes."""
    votes = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(_votes(hashes, weights), axis=0)])
    return np.packbits(votes[starts + span] - votes[starts] > 0, axis=1, bitorder="little").view("<u8").ravel()


BLOCKS, WIDTH = 4, 16
# windows looked up together begin within so many shingles
_TOGETHER = 256


@lru_cache
def _flips(bits: int) -> tuple[int, ...]:
    """All changes of at most so many bits of a block."""
    return tuple(sum(1 << b for b in some) for n in range(bits + 1) for some in combinations(range(WIDTH), n))


def looked_up(radius: int) -> int:
    """Bits of a block by which a window looks around; items are filed around for the rest."""
    return radius // BLOCKS - radius // BLOCKS // 2


def blocks_of(value: int, radius: int, filed: bool = False) -> Iterator[int]:
    """Keys under which a fingerprint is looked up, or ``filed``.

    Of two values within the radius, one's keys and the other's filed ones meet.
    """
    flips = _flips(radius // BLOCKS - looked_up(radius) if filed else looked_up(radius))
    for block in range(BLOCKS):
        key = block << WIDTH | (value >> (WIDTH * block)) & ((1 << WIDTH) - 1)
        yield from map(key.__xor__, flips)


@dataclass(frozen=True)
class ShingleCounts:
    """Shingles in order, how many items of the whole benchmark have each, and the number of items."""

    known: np.ndarray
    having: np.ndarray
    items: int


@dataclass
class BenchmarkIndex:
    """What a task needs of one block of items."""

    params: LeakParams
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rarest: float = 1.0
    gate: np.ndarray = field(default_factory=lambda: np.zeros(_GATE // 8, np.uint8))
    items: list[tuple] = field(default_factory=list)  # id, words, hashes, fingerprint
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each item
    marks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # of each item
    first: np.ndarray = field(default_factory=lambda: np.zeros(BLOCKS * (1 << WIDTH) + 1, np.int64))  # of each key's items
    filed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    lightest: dict[int, float] = field(default_factory=dict)  # by length: least weight of an item's shingles

    @classmethod
    def of(cls, items: list[tuple[int, bytes]], params: LeakParams, counts: ShingleCounts | None = None) -> BenchmarkIndex:
        """The index of some items; without ``counts`` they are the whole benchmark."""
        index = cls(params)
        read = [(i, len(w), shingles(w, params.words)) for i, w in ((i, folded_words(t)) for i, t in items) if w]
        if not read:
            return index
        if counts is None:
            counts = ShingleCounts(*np.unique(np.concatenate([np.unique(h) for _, _, h in read]), return_counts=True), len(read))
        index.known, having = counts.known, counts.having
        index.weight = np.log1p(counts.items / having)
        index.rarest = float(np.log1p(counts.items))
        slot = (index.known & np.uint64(_GATE - 1)).astype(np.int64)
        flags = np.zeros(_GATE, np.uint8)
        flags[slot] = 1
        index.gate = np.packbits(flags)
        for item, length, hashes in read:
            weight = index.weights(hashes)[0]
            index.lightest[length] = min(float(weight.sum()), index.lightest.get(length, np.inf))
            index.items.append((item, length, hashes, fingerprint(hashes, weight)))
        index.lengths = np.array([i[1] for i in index.items], np.int64)
        index.marks = np.array([i[3] for i in index.items], np.uint64)
        keys = [np.fromiter(blocks_of(i[3], params.radius, filed=True), np.int64) for i in index.items]
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
        keys = np.concatenate(keys)
        index.filed = owner[np.argsort(keys, kind="stable")]
        index.first = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=len(index.first) - 1))])
        return index

    def may_know(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes & np.uint64(_GATE - 1)).astype(np.int64)
        return (self.gate[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1

    def weights(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each shingle, and whether some item has it."""
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = self.known[at] == hashes
        return np.where(hit, self.weight[at], self.rarest), hit

    def similarity(self, one: np.ndarray, two: np.ndarray) -> float:
        """Weighted Jaccard similarity of two bags of shingles."""
        keys, place = np.unique(np.concatenate([one, two]), return_inverse=True)
        a = np.bincount(place[: len(one)], minlength=len(keys))
        b = np.bincount(place[len(one) :], minlength=len(keys))
        w = self.weights(keys)[0]
        return float((w * np.minimum(a, b)).sum() / (w * np.maximum(a, b)).sum())

    def matches(self, text: bytes) -> list[tuple]:
        """(item, first word, words, differing bits, similarity): the best window for each item that leaked."""
        if not self.items:
            return []
        words = folded_words(text)
        best: dict[int, tuple] = {}
        shared: dict[int, tuple] = {}
        for length in self.lightest:
            wide = min(self.params.words, length)
            if wide > len(words):  # too short to share a shingle
                continue
            if wide not in shared:
                hashes = shingles(words, wide)
                maybe = np.flatnonzero(self.may_know(hashes))
                if self.weights(hashes[maybe])[1].any():
                    weight, hit = self.weights(hashes)
                    sums = np.concatenate([[0.0], np.cumsum(weight)])
                    hits = np.concatenate([[0.0], np.cumsum(weight * hit)])
                    shared[wide] = hashes, weight, sums, hits
                else:
                    shared[wide] = ()
            if not shared[wide]:
                continue
            hashes, weight, sums, hits = shared[wide]
            long = min(length, len(words))
            # what a window shares is at most what the text holds of the benchmark, and the union at least the item
            if hits[-1] < (self.params.similarity - 1e-9) * self.lightest[length]:
                continue
            span = long - wide + 1
            enough = hits[span:] - hits[:-span] >= (self.params.similarity - 1e-9) * (sums[span:] - sums[:-span])
            starts = np.flatnonzero(enough)
            while len(starts):
                near = starts[: np.searchsorted(starts, starts[0] + _TOGETHER)]
                self._look_up(hashes, weight, near, span, length, long, best)
                starts = starts[len(near) :]
        return [best[k] for k in sorted(best)]

    def _look_up(self, hashes, weight, starts: np.ndarray, span: int, length: int, long: int, best: dict) -> None:
        """Windows that begin at ``starts``, within a bounded stretch of the text, all at once."""
        low, high = starts[0], starts[-1] + span
        marks = window_marks(hashes[low:high], weight[low:high], starts - low, span)
        block = np.arange(BLOCKS, dtype=np.uint64)
        own = (marks[:, None] >> (block * np.uint64(WIDTH))) & np.uint64((1 << WIDTH) - 1) | block << np.uint64(WIDTH)
        flips = np.array(_flips(looked_up(self.params.radius)), np.int64)
        keys = (own.astype(np.int64)[:, :, None] ^ flips).reshape(len(starts), -1)
        begin = self.first[keys]
        size = self.first[keys + 1] - begin
        window, at = np.nonzero(size)
        begin, size = begin[window, at], size[window, at]
        met = self.filed[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        pairs = np.unique(np.repeat(window, size) * len(self.items) + met)
        window, met = pairs // len(self.items), pairs % len(self.items)
        bits = np.bitwise_count(marks[window] ^ self.marks[met])
        for w, n, apart in zip(*(x[(self.lengths[met] == length) & (bits <= self.params.radius)].tolist() for x in (window, met, bits)), strict=True):
            start = int(starts[w])
            alike = self.similarity(hashes[start : start + span], self.items[n][2])
            if alike >= self.params.similarity and (n not in best or alike > best[n][4]):
                best[n] = (self.items[n][0], start, long, apart, alike)


def item_blocks(benchmark: DataFrame, params: LeakParams) -> Iterator[BenchmarkIndex]:
    """The benchmark, a bounded number of items at a time, with weights of the whole."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    count = max(1, -(-items.count() // params.items_per_block))
    # blocks by hash: sizes differ a little, none is unbounded
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, found = [], []
            for text, number in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own = np.unique(shingles(folded_words(text), params.words))
                found.append(own.view(np.int64))
                numbers.append(np.full(len(own), number, np.int32))
            made = [np.concatenate([np.zeros(0, k), *x]) for k, x in ((np.int32, numbers), (np.int64, found))]
            yield pa.RecordBatch.from_arrays([pa.array(m) for m in made], names=["block", "h"])

    held = stored(items.select("text", "block").mapInArrow(run, "block int, h bigint"), "item-shingles")
    having = stored(held.groupBy("h").agg(F.count(F.lit(1)).alias("having")), "shingle-counts")
    total = items.where(F.regexp_count("text", F.lit(r"[^\x00-\x7F]|[0-9A-Za-z]")) > 0).count()
    for i in range(count):
        # those of other blocks weigh like unknown ones, unless several items have them
        mine = held.where(F.col("block") == i).select("h").distinct().withColumn("mine", F.lit(True))
        own = having.join(mine, "h", "left").where(F.col("mine") | (F.col("having") > 1)).select("h", "having").toArrow()
        known = own.column("h").to_numpy().view(np.uint64)
        order = np.argsort(known)
        counts = ShingleCounts(known[order], own.column("having").to_numpy()[order], total)
        rows = items.where(F.col("block") == i).select("item_id", "text").collect()
        yield BenchmarkIndex.of(sorted(((r[0], (r[1] or "").encode()) for r in rows), key=repr), params, counts)


def with_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> tuple[DataFrame, str]:
    """``docs`` with an array of matches; the name of that column."""
    columns = docs.columns
    names = []
    for index in item_blocks(benchmark, params):

        def find(texts: Texts, index: BenchmarkIndex = index) -> list:
            fields = ("item_id", "start_word", "n_words", "hamming", "similarity")
            return [[[dict(zip(fields, m, strict=True)) for m in index.matches(t)] for t in texts]]

        docs, name = with_struct(docs, "text", f"m array<struct<{_types()}>>", lambda find=find: find, [*columns, *names])
        names.append(name)
    found = fresh_name(docs, "leaks")
    none = F.array().cast(f"array<struct<{_types()}>>")
    lists = [F.col(f"{quoted(n)}.m") for n in names]
    return docs.select(*map(quoted, columns), (F.concat(*lists) if lists else none).alias(found)), found


def _types() -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(MATCH))


def leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): every item that leaked into a document."""
    found, name = with_leaks(docs.select("doc_id", "text"), benchmark, params)
    return found.select("doc_id", F.explode(name).alias("leak")).select("doc_id", "leak.*")
