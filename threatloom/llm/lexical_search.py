"""Ranked lexical search by deduplicated bags of words.

Only the items' vocabulary can give a score, so every document is reduced to its
bag: how often it has each term of the vocabulary, and a length class ``m`` made
from all its terms.  Documents with the same bag and the same ``m`` score alike
for every item.  Bags are grouped by a hash and told apart by their bytes, each
class is scored once, and its members follow by ascending id.  A list of ten
never needs more than ten members of a class, and those past the tenth are cut
before the shuffle, so a class that holds a third of all rows sends ten rows a
task.

Scores are sums of integers.  An inverted index of the items gives, for each
term, the items that have it; a class adds its terms' scores up over these lists.
Each task keeps the best of every item, and the lists of all tasks are merged.
Items are taken in blocks of bounded length, each sent to all tasks; a block
reads the documents again, so any number of items is searched exactly.

Null and empty texts have no terms, are in no list and count for nothing.  Items
without terms, and items none of whose terms a document has, have no rows.
Repeated documents are ranked as documents of their own, null ids after all
others; repeated items are answered under each id, and equal ids as often as
they occur.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.batches import byte_texts, quoted
from threatloom.session import stored

# fixed values: bytes that are no part of a term, and the folding of A-Z
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_EXACT = 1 << 53  # sums of doubles are exact below


@dataclass(frozen=True)
class SearchParams:
    """The ``top`` best documents; items are sent to the tasks ``block_bytes`` of text at a time."""

    top: int = 10
    block_bytes: int = 16 << 20
    percent_fixed: int = 10
    percent_length: int = 90


def terms(text: bytes) -> list[bytes]:
    """All terms of a text in order."""
    return text.translate(_FOLD).split()


class Index:
    """Which items have which term."""

    def __init__(self, texts: list[bytes]) -> None:
        self.number: dict[bytes, int] = {}
        lists: list[list[int]] = []
        self.longest = 0
        for item, text in enumerate(texts):
            found = dict.fromkeys(terms(text))
            self.longest = max(self.longest, len(found))
            for term in found:
                if term not in self.number:
                    self.number[term] = len(lists)
                    lists.append([])
                lists[self.number[term]].append(item)
        self.starts = np.cumsum([0, *map(len, lists)])
        self.items = np.fromiter((i for found in lists for i in found), np.int32, self.starts[-1])
        self.n_items = len(texts)

    def bag(self, text: bytes) -> tuple[int, bytes]:
        """Number of terms, and the bag: (term, occurrences) pairs of 32 bits, by term."""
        found = terms(text)
        # a word is looked up once for all its occurrences
        pairs = sorted((self.number[t], n) for t, n in Counter(found).items() if t in self.number)
        return len(found), np.array(pairs, "<u4").tobytes()


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of the items, about ``block_bytes`` at a time; the driver holds one block."""
    ids, texts, size = [], [], 0
    for item, text in items.select("item_id", F.col("text").cast("string").cast("binary")).toLocalIterator():
        ids.append(item)
        texts.append(bytes(text or b""))
        size += len(texts[-1]) + 100
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def bags(docs: DataFrame, index: Index, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, bag) of every document that has a term."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T.StructType.fromDDL("n bigint, bag binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.bag(t) for t in byte_texts(batch.column(1))]
            n = pa.array([f[0] for f in found], pa.int64())
            made = pa.RecordBatch.from_arrays([batch.column(0), n, pa.array([f[1] for f in found], pa.binary())], names=schema.names)
            yield made.filter(pa.array([f[0] > 0 for f in found], pa.bool_()))

    rows = docs.select(F.col(quoted(doc_id)), F.col(quoted(text)).cast("string"))
    return rows.mapInArrow(run, schema)


def frequencies(rows: DataFrame, index: Index) -> np.ndarray:
    """Documents that have each term; every task sends one row a term at most."""
    size = len(index.starts) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.zeros(size, np.int64)
        for batch in batches:
            joined = b"".join(batch.column(0).to_pylist())
            counted += np.bincount(np.frombuffer(joined, "<u4")[::2], minlength=size)
        seen = np.flatnonzero(counted)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counted[seen], pa.int64())], names=["term", "df"])

    found = np.zeros(size, np.int64)
    for term, df in rows.select("bag").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect():
        found[term] = df
    return found


def classes(rows: DataFrame, n_docs: int, n_terms: int, params: SearchParams) -> DataFrame:
    """(h, m, bag, doc_id): the first members of every class, in order of their ids.

    The hash deals the classes over tasks; rows of a class are those whose bag
    and ``m`` are the same, not only their hash.
    """
    length = f"{100 - params.percent_length} + (({params.percent_length} * n * {n_docs}L) div {n_terms}L)"
    keyed = rows.where("length(bag) > 0").withColumn("m", F.expr(length))
    keyed = keyed.withColumn("h", F.xxhash64("bag", "m"))
    order = Window.partitionBy("h", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    ranked = keyed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= params.top)
    return ranked.select("h", "m", "bag", "doc_id")


def best_of_tasks(members: DataFrame, index: Index, weights: np.ndarray, params: SearchParams) -> DataFrame:
    """(item, score, doc_id): the best of every item among the classes of each task.

    Members of a class come one after another, so a class is scored when its
    first one is met.
    """
    id_field = T.StructField("doc_id", members.schema["doc_id"].dataType)
    schema = T.StructType([*T.StructType.fromDDL("item int, score bigint"), id_field])
    # the largest sum an item can have: each of its terms gives less than weight * 10^6
    exact = index.longest * int(weights.max(initial=0)) * 1_000_000 < _EXACT

    def scores(bag: bytes, m: int) -> np.ndarray:
        pairs = np.frombuffer(bag, "<u4").reshape(-1, 2).astype(np.int64)
        term, tf = pairs[:, 0], pairs[:, 1]
        each = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        lengths = index.starts[term + 1] - index.starts[term]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(index.starts[term] - ends + lengths, lengths)
        if exact:
            return np.bincount(index.items[at], np.repeat(each, lengths), index.n_items).astype(np.int64)
        found = np.zeros(index.n_items, np.int64)
        np.add.at(found, index.items[at], np.repeat(each, lengths))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # heaps of (score, descending id, id), the worst first; null ids are the last
        best: list[list[tuple]] = [[] for _ in range(index.n_items)]
        least = np.ones(index.n_items, np.int64)
        kind, last, score, wanted = None, None, None, None
        for batch in batches:
            kind = batch.schema.field(2).type
            for m, bag, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (m, bag) != last:
                    last, score = (m, bag), scores(bag, m)
                    wanted = np.flatnonzero(score >= least)
                for item in wanted:
                    heap, row = best[item], (int(score[item]), _Descending(doc), doc)
                    if len(heap) < params.top:
                        heapq.heappush(heap, row)
                    elif heap[0][:2] < row[:2]:
                        heapq.heapreplace(heap, row)
                    if len(heap) == params.top:
                        least[item] = heap[0][0]
        rows = [(item, row[0], row[2]) for item, heap in enumerate(best) for row in heap]
        if rows:
            items, found, docs = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(found, pa.int64()), pa.array(docs, kind)], names=schema.names)

    return members.select("m", "bag", "doc_id").mapInArrow(run, schema)


class _Descending:
    """An id that counts for more the smaller it is; null counts least."""

    __slots__ = ("value",)

    def __init__(self, value) -> None:
        self.value = value

    def __eq__(self, other) -> bool:
        return self.value == other.value

    def __lt__(self, other) -> bool:
        if self.value is None or other.value is None:
            return self.value is None and other.value is not None
        return self.value > other.value


def term_weights(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)


def ranked_search(docs: DataFrame, items: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item, the highest score first."""
    spark = docs.sparkSession
    id_field = T.StructField("item_id", items.schema["item_id"].dataType)
    found = None
    for ids, texts in item_blocks(items, params.block_bytes):
        index = Index(texts)
        rows = stored(bags(docs, index), "bags")
        n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_terms:
            continue
        weights = term_weights(frequencies(rows, index), n_docs)
        members = classes(rows, n_docs, n_terms, params)
        best = best_of_tasks(members, index, weights, params)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.top)
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.IntegerType()), id_field]))
        part = top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        schema = T.StructType([id_field, T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
        found = spark.createDataFrame([], schema)
    return found
