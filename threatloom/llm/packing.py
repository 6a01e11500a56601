"""Best-fit packing of documents into sequences of several permitted lengths.

Texts are measured in tokens.  What is longer than the largest sequence is cut
into pieces of that length, nothing is lost.  Documents are dealt evenly over
shards by a hash; each shard packs its pieces by decreasing length:

* a piece goes into the open sequence with the least room that still fits;
* if none fits, a sequence opens whose length has the least cost for each token
  it may hold, of the lengths that can take the piece, counting the cost of
  room that the shard's remaining tokens could not fill;
* at the end every sequence shrinks to the shortest permitted length that holds
  its contents.

Null and empty texts have no tokens and take no room: they get one row without
a sequence.  Repeated rows are packed as often as they occur.  A null id is kept
as it is.  Ties go by id, then by piece.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.batches import byte_texts
from threatloom.session import stored

# fixed value: how the vocabulary's publisher splits a text before merging bytes
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SCHEMA = (
    "doc_id bigint, piece bigint, from_token bigint, n_tokens bigint, sequence string, capacity bigint, start bigint"
)


@dataclass(frozen=True)
class PackParams:
    """``overhead`` is the cost of a sequence besides its tokens, ``attention`` what a token costs per other token."""

    capacities: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    tokenizer: str = TOKENIZER
    shard_tokens: int = 2_000_000
    overhead: float = 64.0
    attention: float = 1 / 16_384

    def cost(self, capacity: int) -> float:
        return self.overhead + capacity * (1 + self.attention * capacity)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary at ``path``, once per process; it must lie there on every executor."""
    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.decode())) for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint")


def opening(size: int, left: int, params: PackParams) -> int:
    """The permitted length to open for a piece while ``left`` tokens, the piece included, wait to be packed."""
    fitting = [c for c in params.capacities if c >= size]
    return min(fitting, key=lambda c: (params.cost(c) / min(c, max(left, size)), c))


def best_fit(sizes: list[int], params: PackParams) -> tuple[list[int], list[int], list[int]]:
    """Sequence and start of every piece, sizes decreasing; and the final length of every sequence."""
    rooms: list[tuple[int, int]] = []  # (room left, sequence), ascending
    used: list[int] = []
    where, starts = [], []
    left = sum(sizes)
    for size in sizes:
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, sequence = rooms.pop(at)
        else:
            room, sequence = opening(size, left, params), len(used)
            used.append(0)
        where.append(sequence)
        starts.append(used[sequence])
        used[sequence] += size
        left -= size
        if room > size:
            insort(rooms, (room - size, sequence))
    shrunk = [min(c for c in params.capacities if c >= n) for n in used]
    return where, starts, shrunk


def packed(counts: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """A row for each piece of (doc_id, n_tokens): its sequence, that sequence's length, its place in it.

    The number of shards follows the number of tokens, so a shard is as large
    at any scale; pieces are dealt by a hash of id and piece.
    """
    longest = max(params.capacities)
    total = counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = max(1, -(-total // params.shard_tokens))
    # exact division: no piece is longer than the longest sequence
    last = F.floor((F.greatest(F.col("n_tokens"), F.lit(1)) - 1) / longest)
    pieces = counts.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    begin = F.col("piece") * longest
    pieces = pieces.select(
        "doc_id",
        "piece",
        begin.alias("from_token"),
        F.least(F.lit(longest).cast("bigint"), F.col("n_tokens") - begin).alias("n_tokens"),
    )
    shard = F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)).alias("shard")

    def pack(rows: pa.Table) -> pa.Table:
        order = [("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order))
        number = rows.column("shard")[0].as_py()
        where, starts, lengths = best_fit(rows.column("n_tokens").to_pylist(), params)
        rows = rows.drop_columns("shard")
        rows = rows.append_column("sequence", pa.array([f"{number}-{w}" for w in where], pa.string()))
        rows = rows.append_column("capacity", pa.array([lengths[w] for w in where], pa.int64()))
        return rows.append_column("start", pa.array(starts, pa.int64()))

    full = pieces.where("n_tokens > 0").select(shard, "*").groupBy("shard").applyInArrow(pack, SCHEMA)
    nothing = [F.lit(None).cast(k).alias(n) for n, k in (("sequence", "string"), ("capacity", "bigint"), ("start", "bigint"))]
    return full.unionByName(pieces.where("n_tokens <= 0").select("*", *nothing))


def pack_documents(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """Measure every whole text and pack it."""
    return packed(stored(token_counts(docs, params.tokenizer), "token-counts"), params)


