"""Line deduplication by range-partitioned hashes.

Lines become (hash, document, position) rows, which are range-partitioned and
sorted by all three, so that a very common line is spread over as many
partitions as it needs.  One streaming pass over each partition decides the
lines of every run of equal hashes; runs that touch a partition's edge, at most
two for each partition, are decided afterwards from one row of sums for each, and
the decision goes back to where their lines lie.  The result
is one compressed keep bitmap per document, not text.

A document is told from others by its id and a fingerprint of its text, so
repeated rows count once and are cleaned alike, and a null id is allowed.  Null
and empty texts are one empty line.  Keys shorter than ``min_chars`` are never
dropped.  An empty table gives no bitmaps.  Ties cannot occur: the order of
first occurrence is (id, fingerprint, position), null ids first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.batches import CONTINUATION, WHITE_SPACE, byte_texts, quoted
from threatloom.session import stored

DOCUMENT = ["doc_id", "text_hash"]
HASH = ["h1", "h2"]


@dataclass(frozen=True)
class LineParams:
    """Lines in at least ``min_docs`` documents go: all of them, or all but the first."""

    min_docs: int = 10
    min_chars: int = 1
    keep_first: bool = False


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE_SPACE).lower()


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2): a 128-bit hash of every line's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            pos: list[int] = []
            digests: list[bytes] = []
            for row, text in enumerate(byte_texts(batch.column(2))):
                for at, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and len(key.translate(None, CONTINUATION)) >= min_chars:
                        owner.append(row)
                        pos.append(at)
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            rows = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(pos, pa.int32()),
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                ],
                names=[*DOCUMENT, "pos", *HASH],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, pos int, h1 bigint, h2 bigint")


class _Runs:
    """Walks sorted rows and tells which lines go; remembers at most ``min_docs`` documents of a run.

    A run that touches the edge of the partition may go on in the next one, so
    its rows are passed on as ``edge`` without a decision, and ``sums`` tells of
    its documents: how many, the first row, and the last document.
    """

    def __init__(self, params: LineParams) -> None:
        self.params = params
        self.key: tuple | None = None
        self.open_run = True
        self.pending: list[tuple] = []
        self.docs = 0
        self.first: tuple | None = None
        self.last_doc: tuple | None = None
        self.sums: list[tuple] = []

    def feed(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Rows are (h1, h2, doc_id, text_hash, pos); yields them with an edge mark."""
        least = self.params.min_docs
        for row in rows:
            key, doc = row[:2], row[2:4]
            if key != self.key:
                yield from self._close()
                self.open_run = self.key is None
                self.key, self.docs, self.first, self.last_doc = key, 0, row, None
            if doc != self.last_doc:
                self.docs += 1
                self.last_doc = doc
            if self.open_run:
                yield (*row, True)
            else:
                self.pending.append(row)
                if self.docs >= least and len(self.pending) > 65_536:
                    # long enough to be decided, yet it may reach the edge: sums decide, as for edges
                    yield from ((*r, True) for r in self.pending)
                    self.pending = []
                    self.open_run = True

    def _close(self) -> Iterator[tuple]:
        if self.open_run and self.key is not None:
            self.sums.append((*self.first, self.docs, *self.last_doc))
        elif self.docs >= self.params.min_docs:
            gone = self.pending[1:] if self.params.keep_first else self.pending
            yield from ((*r, False) for r in gone)
        self.pending = []

    def end(self) -> Iterator[tuple]:
        """The last run may go on in the next partition."""
        self.open_run = True
        yield from ((*r, True) for r in self.pending)
        yield from self._close()


def dropped_lines(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """(doc_id, text_hash, pos) of every line that goes."""
    spark = docs.sparkSession
    lines = stored(line_hashes(docs, params.min_chars), "line-hashes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*HASH, *DOCUMENT, "pos"]
    # a repeated row is one document
    ranged = lines.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = "h1 bigint, h2 bigint, doc_id bigint, text_hash bigint, pos int, edge boolean, docs bigint, last_id bigint, last_hash bigint, part int"
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.bool_()] + [pa.int64()] * 3 + [pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, part = _Runs(params), TaskContext.get().partitionId()

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = [*zip(*rows, strict=True)] or [[]] * 6
            columns += [[None] * len(rows)] * 4
            arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[*order, "edge", "docs", "last_id", "last_hash", "part"])

        for batch in batches:
            yield packed(list(runs.feed(zip(*(c.to_pylist() for c in batch.columns), strict=True))))
        yield packed(list(runs.end()))
        sums = [(*s[:5], None, *s[5:], part) for s in runs.sums]
        arrays = [pa.array(c, type=k) for c, k in zip([*zip(*sums, strict=True)] or [[]] * 10, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*order, "edge", "docs", "last_id", "last_hash", "part"])

    decided = stored(ranged.mapInArrow(run, schema), "line-runs")
    edges = decided.where("edge").drop("edge", "docs", "last_id", "last_hash", "part")
    # a row for each run at an edge and partition; a document that goes on behind an edge counts once
    along = Window.partitionBy(*HASH).orderBy("part")
    goes_on = F.lag("part").over(along).isNotNull()
    for own, before in zip(DOCUMENT, ("last_id", "last_hash"), strict=True):
        goes_on = goes_on & F.col(own).eqNullSafe(F.lag(before).over(along))
    sums = decided.where("docs IS NOT NULL").withColumn("new", F.col("docs") - goes_on.cast("int"))
    totals = sums.groupBy(*HASH).agg(F.sum("new").alias("docs"), F.min(F.struct(*DOCUMENT, "pos")).alias("first"))
    common = totals.where(F.col("docs") >= params.min_docs).drop("docs")
    # two rows for each partition at most, and those of runs cut as too long
    late = edges.join(F.broadcast(common), HASH)
    if params.keep_first:
        late = late.where(~F.col("first").eqNullSafe(F.struct(*DOCUMENT, "pos")))
    columns = [*DOCUMENT, "pos"]
    return decided.where("NOT edge").select(*columns).unionByName(late.select(*columns))


def pack_bitmap(dropped: list[int]) -> bytes:
    """Compressed bits up to the last dropped line: 1 keeps the line, as does every line after them."""
    keep = np.ones(-(-(max(dropped) + 1) // 8) * 8, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def unpack_bitmap(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of ``n_lines`` lines stay; all, without a bitmap."""
    keep = np.ones(n_lines, bool)
    if bitmap:
        bits = _flags(bitmap)
        keep[: len(bits)] = bits[:n_lines]
    return keep


def keep_bitmaps(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """(doc_id, text_hash, n_dropped, bitmap) of every document that loses lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bitmaps = [pack_bitmap(p) for p in batch.column(2).to_pylist()]
            sizes = [len(p) for p in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(bitmaps, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*DOCUMENT, "n_dropped", "bitmap"])

    grouped = dropped_lines(docs, params).groupBy(*DOCUMENT).agg(F.collect_set("pos").alias("dropped"))
    return grouped.mapInArrow(run, "doc_id bigint, text_hash bigint, n_dropped bigint, bitmap binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` as a struct column ``row``, its fingerprint, and the bitmap if it has one."""
    rows = docs.select(
        F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("text_hash")
    )
    marks = bitmaps.select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash"), "bitmap")
    same = (F.col("text_hash") == F.col("other_hash")) & F.col("doc_id").eqNullSafe(F.col("other_id"))
    return rows.join(marks, same, "left").select("row", "bitmap")


def surviving(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """The kept lines joined again, lines before, lines dropped."""
    if bitmap is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    keep = unpack_bitmap(bitmap, len(lines))
    kept = [line for line, stays in zip(lines, keep, strict=True) if stays]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def cleaned_digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (hashlib.sha256(kept).hexdigest(), before, gone)
                for kept, before, gone in map(surviving, byte_texts(batch.column(1)), batch.column(2).to_pylist())
            ]
            sha, before, gone = zip(*rows, strict=True) if rows else ([], [], [])
            arrays = [batch.column(0), pa.array(before, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    joined = with_bitmaps(docs.select("doc_id", "text"), bitmaps)
    rows = joined.select(
        F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "bitmap"
    )
    return rows.mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


def cleaned_documents(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with only the kept lines in ``text``; ``n_chars`` follows where there is one.

    A document that loses lines and has no word left goes: what it said stays
    with the first document that said it.
    """

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_flags(mark) for mark in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(keep, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*DOCUMENT, "bitmap"])

    # only bitmaps go to Python, and texts are shuffled once
    rows = bitmaps.select(*DOCUMENT, "bitmap")
    unpacked = rows.mapInArrow(flags, "doc_id bigint, text_hash bigint, bitmap array<boolean>")
    joined = with_bitmaps(docs, unpacked)
    old, keep = F.col("row.text").cast("string"), F.col("bitmap")
    lines = F.filter(F.split(old, "\n", -1), lambda line, at: F.coalesce(F.get(keep, at), F.lit(True)))
    marked = joined.withColumn("shorter", F.when(keep.isNotNull(), F.array_join(lines, "\n")))
    left = marked.where(keep.isNull() | F.col("shorter").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("shorter"), "n_chars": F.length("shorter").cast("bigint")}

    def column(name: str) -> Column:
        before = F.col("row." + quoted(name))
        return (F.when(keep.isNotNull(), new[name]).otherwise(before) if name in new else before).alias(name)

    return left.select(*map(column, docs.columns))


def _flags(bitmap: bytes) -> np.ndarray:
    """Which lines stay, up to the last bit; lines after it stay."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little").astype(bool)
