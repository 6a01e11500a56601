"""Chat formatting at token level.

Each turn is encoded on its own: reserved ids for its role and its end, and
between them the ids of its content, so no merge crosses a border and no content
can become a reserved id.  Control strings that occur in content are escaped,
reversibly, so that the rendered text cannot be misread either.  Turns are put
one after another by sums of the lengths before them, which also place the loss
mask: the contents of assistant turns.

Rows are turns.  Null text and null role are empty; a role without a marker of
its own gets the marker of "other" roles, with the role's name as content of a
header.  A null conversation id is a conversation of its own.  Turns go by turn
number, nulls first; ties by role, then text, so repeated rows follow each other.
An empty table gives no rows.  Other columns are not read.  A conversation of
any length is streamed: a task holds one batch of turns and a running sum.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.batches import byte_texts
from threatloom.llm.packing import TOKENIZER, tokenizer

# fixed values: control strings of common templates, of ours first
ROLE_MARKERS = {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"}
OTHER_ROLE, HEADER_END, TURN_END = "<|role|>", "<|header_end|>", "<|end|>"
FOREIGN = (
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<|startoftext|>",
    "<|eot_id|>",
    "<|start_header_id|>",
    "<|end_header_id|>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
    "<s>",
    "</s>",
)
ESCAPE = "␛"
RESERVED = [*ROLE_MARKERS.values(), OTHER_ROLE, HEADER_END, TURN_END]
_CONTROL = re.compile("|".join(map(re.escape, sorted((*RESERVED, *FOREIGN, ESCAPE), key=len, reverse=True))))
_ESCAPED = re.compile(f"{ESCAPE}([01])")

TURN = "conv_id bigint, turn bigint, role string, text string, ids array<int>, content_from int, rendered_chars bigint"
PLACED = (
    "conv_id bigint, turn bigint, ids array<int>, start bigint, mask_from bigint, mask_to bigint,"
    " rendered_chars bigint, first boolean"
)
DIGEST = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


@dataclass(frozen=True)
class ChatParams:
    """Reserved ids are numbered upwards from the end of the vocabulary at ``tokenizer``."""

    tokenizer: str = TOKENIZER


def escape(text: str) -> str:
    """Break every control string with a mark after its first character; double marks that were there."""
    return _CONTROL.sub(lambda m: f"{ESCAPE}0" if m[0] == ESCAPE else f"{m[0][0]}{ESCAPE}1{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE if m[1] == "0" else "", text)


class Template:
    """Encodes and decodes turns with one vocabulary."""

    def __init__(self, params: ChatParams) -> None:
        self.vocabulary = tokenizer(params.tokenizer)
        size = self.vocabulary.n_vocab
        self.reserved = {marker: size + i for i, marker in enumerate(RESERVED)}
        self.markers = {i: marker for marker, i in self.reserved.items()}

    def encode(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Ids of a turn, where its content begins, and how many characters it renders to."""
        content = escape(text)
        if role in ROLE_MARKERS:
            head, rendered = [self.reserved[ROLE_MARKERS[role]]], len(ROLE_MARKERS[role])
        else:
            name = escape(role)
            ends = self.reserved[OTHER_ROLE], self.reserved[HEADER_END]
            head = [ends[0], *self.vocabulary.encode_ordinary(name), ends[1]]
            rendered = len(OTHER_ROLE) + len(name) + len(HEADER_END)
        ids = [*head, *self.vocabulary.encode_ordinary(content), self.reserved[TURN_END]]
        return ids, len(head), rendered + len(content) + len(TURN_END)

    def plain(self, ids: list[int]) -> str:
        """Text of ordinary ids, unescaped."""
        return unescape(self.vocabulary.decode_bytes(ids).decode())

    def decode(self, ids: list[int]) -> tuple[str, str]:
        """Role and text of a turn's ids."""
        marker = self.markers[ids[0]]
        if marker == OTHER_ROLE:
            end = ids.index(self.reserved[HEADER_END])
            return self.plain(ids[1:end]), self.plain(ids[end + 1 : -1])
        return marker[2:-2], self.plain(ids[1:-1])

    def render(self, ids: list[int]) -> str:
        """A turn as text, markers and escapes included."""
        spans, pending = [], []
        for i in [*ids, None]:
            if i is None or i in self.markers:
                spans.append(self.vocabulary.decode_bytes(pending).decode())
                spans.append(self.markers[i] if i is not None else "")
                pending = []
            else:
                pending.append(i)
        return "".join(spans)


def encoded_turns(turns: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """Every turn's ids, still in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(params)
        for batch in batches:
            made = [
                template.encode(role.decode(), text.decode())
                for role, text in zip(byte_texts(batch.column(2)), byte_texts(batch.column(3)), strict=True)
            ]
            ids, begin, chars = zip(*made, strict=True) if made else ([], [], [])
            arrays = [*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(begin, pa.int32()), pa.array(chars, pa.int64())]
            names = [*batch.schema.names, "ids", "content_from", "rendered_chars"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(run, TURN)


def placed_turns(turns: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """Every turn with its place in its conversation's sequence, and the span of its loss mask.

    A conversation's rows lie together and in order within one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, offset, seen = None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            convs = batch.column(0).to_pylist()
            sizes = batch.column(4).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.array([not seen or convs[0] != conversation, *(a != b for a, b in zip(convs, convs[1:], strict=False))])
            ends = np.cumsum(sizes)
            begins = ends - sizes
            # what lies before a conversation's first turn does not count
            own = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
            start = np.where(own < 0, begins + offset, begins - begins[np.maximum(own, 0)])
            is_loss = np.array([r == "assistant" for r in batch.column(2).to_pylist()])
            begin = start + np.where(is_loss, batch.column(5).to_numpy(), 0)
            end = np.where(is_loss, start + sizes - 1, begin)
            conversation, offset, seen = convs[-1], int(start[-1] + sizes[-1]), True
            arrays = [batch.column(0), batch.column(1), batch.column(4), pa.array(start), pa.array(begin), pa.array(end)]
            names = ["conv_id", "turn", "ids", "start", "mask_from", "mask_to", "rendered_chars", "first"]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(6), pa.array(first)], names=names)

    encoded = encoded_turns(turns, params).repartition("conv_id")
    ordered = encoded.sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, PLACED)


def read_back(placed: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """One row per conversation, decoded from the ids and the mask alone; reads turns in the order they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(params)
        open_: _Conversation | None = None
        for batch in batches:
            done = []
            for conv, ids, start, low, high, first in zip(
                *(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 7)), strict=True
            ):
                if first:
                    done += [open_] if open_ else []
                    open_ = _Conversation(conv)
                open_.add(template, ids, low - start, high - start)
            yield _digests(done)
        yield _digests([open_] if open_ else [])

    return placed.mapInArrow(run, DIGEST)


class _Conversation:
    """Running digests of one conversation."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss_chars, self.rendered = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, template: Template, ids: list[int], low: int, high: int) -> None:
        role, text = template.decode(ids)
        self.turns += 1
        self.all.update(f"{role}\n{text}\n".encode())
        learned = template.plain(ids[low:high])
        self.loss_chars += len(learned)
        self.loss.update(learned.encode())
        self.rendered += len(template.render(ids))


def _digests(done: list[_Conversation]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rows = [(c.conv_id, c.turns, c.all.hexdigest(), c.loss_chars, c.loss.hexdigest(), c.rendered) for c in done]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
