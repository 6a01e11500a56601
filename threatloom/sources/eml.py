"""Raw message bytes to typed rows.

The worker only walks the message tree and decodes; every limit and policy is
then applied by DataFrame operators, where it shows in the plan.  A message
that cannot be read becomes a row with ``_corrupt`` set and is never dropped.
"""

from __future__ import annotations

import email
import re
from collections.abc import Callable, Iterator
from datetime import timezone
from email._encoded_words import decode_b
from email.header import decode_header, make_header
from email.message import Message
from email.utils import getaddresses, parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from threatloom.functions import constants as K
from threatloom.functions.identity import format_addresses
from threatloom.operators.shaping import attachments_of, body_of, cap_subject, header_map, part_kind
from threatloom.operators.scans import MAILBOX_KEY
from threatloom.params import DEFAULTS, Params

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()
_ADDRESSES = T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("addr", _S)]))
_HEADERS = T.ArrayType(
    T.StructType([T.StructField("pos", _I), T.StructField("name", _S), T.StructField("value", _S)])
)
_PARTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("pos", _I),
            T.StructField("content_type", _S),
            T.StructField("disposition", _S),
            T.StructField("filename", _S),
            T.StructField("is_multipart", T.BooleanType()),
            T.StructField("text", _S),
            T.StructField("size", _L),
            T.StructField("data", T.BinaryType()),
        ]
    )
)
DECODED_SCHEMA = T.StructType(
    [
        T.StructField("seq", _S),
        T.StructField("account_email", _S),
        T.StructField("folder", _S),
        T.StructField("message_id", _S),
        T.StructField("subject", _S),
        T.StructField("sender_list", _ADDRESSES),
        T.StructField("recipient_list", _ADDRESSES),
        T.StructField("sent_at", T.DoubleType()),
        T.StructField("header_list", _HEADERS),
        T.StructField("part_list", _PARTS),
        T.StructField("_corrupt", _S),
    ]
)

# decoded messages handed back at a time: bounded in bytes, whatever the batch
_FLUSH_BYTES = 16 * K.MIB
_FLUSH_ROWS = 2000
# rows of a batch turned to Python values at a time
_READ_ROWS = 100
# header values remembered by a worker
_MOST_READ = 20_000
_READ: dict = {}


def _known(read: Callable, *values: str | None) -> object:
    """``read`` of header values, which repeat from message to message: once for each, as far as there is room.

    A plain table, since functions go to the workers without their module.
    """
    key = (read.__name__, *values)
    if key not in _READ:
        if len(_READ) >= _MOST_READ:
            _READ.clear()
        _READ[key] = read(*values)
    return _READ[key]


def _header_text(value: object) -> str:
    raw = str(value)
    return _known(_decoded_words, raw) if "=?" in raw else raw


def _decoded_words(raw: str) -> str:
    try:
        return str(make_header(decode_header(raw)))
    except Exception:  # an unknown charset or bad token keeps the raw text
        return raw


def _addresses(value: object) -> list[dict]:
    return [{"name": _header_text(n), "addr": a} for n, a in _known(_pairs, str(value))] if value else []


_ATOMS = r"[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*"
# one address that reads as it stands, with or without a name of plain words
_PLAIN_ADDRESS = re.compile(rf"(?:(?P<bare>{_ATOMS}@{_ATOMS})|(?P<name>[A-Za-z0-9]+(?: [A-Za-z0-9]+)*) <(?P<addr>{_ATOMS}@{_ATOMS})>)")


def _pairs(value: str) -> list[tuple[str, str]]:
    plain = _PLAIN_ADDRESS.fullmatch(value)
    if plain:
        return [(plain["name"] or "", plain["bare"] or plain["addr"])]
    return getaddresses([value])


def _sent_at(value: str) -> float | None:
    try:
        when = parsedate_to_datetime(value)
        # "-0000" says that the zone is unknown: taken as UTC, wherever the worker runs
        return (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp()
    except Exception:  # any unreadable date falls back to the ingest time
        return None


def _typed(content_type: str | None, disposition: str | None, default: str) -> tuple[str, str | None, str | None, str | None]:
    """Content type, charset, file name and boundary that two headers give."""
    part = Message()
    part.set_default_type(default)
    for name, value in (("Content-Type", content_type), ("Content-Disposition", disposition)):
        if value is not None:
            part.set_raw(name, value)
    return Message.get_content_type(part), part.get_content_charset(), part.get_filename(), Message.get_boundary(part)


class _Part(Message):
    """A part whose typed headers are read once for each pair of values."""

    def _types(self) -> tuple[str, str | None, str | None, str | None]:
        kind = disposition = None
        for name, value in self.raw_items():
            low = name.lower()
            if low == "content-type" and kind is None:
                kind = value
            elif low == "content-disposition" and disposition is None:
                disposition = value
        return _known(_typed, kind, disposition, self.get_default_type())

    def get_content_type(self) -> str:
        return self._types()[0]

    def get_boundary(self, failobj: object = None) -> object:
        boundary = self._types()[3]
        return failobj if boundary is None else boundary


def _body_text(charset: str | None, payload: bytes) -> str:
    try:
        return payload.decode(charset or "utf-8", errors="replace")
    except LookupError:
        return payload.decode("utf-8", errors="replace")


def _part_row(pos: int, part: _Part) -> dict:
    multipart = part.is_multipart()
    payload = b"" if multipart else (part.get_payload(decode=True) or b"")
    kind, charset, filename, _ = part._types()
    return _part_values(pos, kind, charset, filename, str(part.get("Content-Disposition") or ""), multipart, payload)


def _part_values(
    pos: int, kind: str, charset: str | None, filename: str | None, disposition: str, multipart: bool, payload: bytes
) -> dict:
    readable = kind in ("text/plain", "text/html")
    return {
        "pos": pos,
        "content_type": kind,
        "disposition": disposition,
        "filename": _header_text(filename or ""),
        "is_multipart": multipart,
        "text": _body_text(charset, payload) if readable else None,
        "size": len(payload),
        "data": None if readable and not filename and not disposition else payload,
    }


# --- messages as most programs write them: their lines are told without a parser ---

_FIELD_NAME = re.compile(r"[!-9;-~]+")
_UNENCODED = ("", "7bit", "8bit", "binary")


def _head(lines: str) -> tuple[list[tuple[str, str]], tuple, str, str] | None:
    """Headers, typed headers, disposition and encoding of a head of unfolded lines; None for any other."""
    fields = lines.split("\r\n")
    if not lines.count("\r") == lines.count("\n") == len(fields) - 1:
        return None
    pairs, first = [], {}
    for field in fields:
        name, colon, value = field.partition(":")
        if not (colon and _FIELD_NAME.fullmatch(name)):
            return None
        value = value.lstrip(" \t")
        pairs.append((name, value))
        first.setdefault(name.lower(), value)
    kind, disposition = first.get("content-type"), first.get("content-disposition")
    types = _known(_typed, kind, disposition, "text/plain")
    return pairs, types, disposition or "", first.get("content-transfer-encoding", "").lower()


def _bytes_of(encoding: str, payload: bytes) -> bytes:
    return decode_b(b"".join(payload.splitlines()))[0] if encoding == "base64" else payload


def _plainly_built(raw: bytes) -> tuple[list[tuple[str, str]], list[dict]] | None:
    """Headers and parts of a message whose lines all end in CRLF, of one part or of parts side by side.

    None for any other: folded or odd headers, nested or broken parts, rarer encodings.  Those are parsed.
    """
    top, blank, body = raw.partition(b"\r\n\r\n")
    if not blank or not top.isascii():
        return None
    head = _head(top.decode("ascii"))
    if head is None:
        return None
    pairs, (kind, charset, filename, boundary), disposition, encoding = head
    group = kind.partition("/")[0]
    if group != "multipart":
        if group == "message" or encoding not in (*_UNENCODED, "base64"):
            return None
        return pairs, [_part_values(1, kind, charset, filename, disposition, False, _bytes_of(encoding, body))]
    if not boundary or not boundary.isascii() or kind == "multipart/digest" or encoding not in _UNENCODED:
        return None
    before, *pieces = body.split(b"--" + boundary.encode("ascii"))
    if before or len(pieces) < 2 or pieces.pop() not in (b"--", b"--\r\n"):
        return None
    rows = [_part_values(1, kind, charset, filename, disposition, True, b"")]
    for pos, piece in enumerate(pieces, start=2):
        # between two delimiters, each on a line of its own
        if len(piece) < 4 or not (piece.startswith(b"\r\n") and piece.endswith(b"\r\n")):
            return None
        top, blank, payload = piece[2:-2].partition(b"\r\n\r\n")
        if not blank or not top.isascii():
            return None
        head = _known(_head, top.decode("ascii"))
        if head is None:
            return None
        _, (kind, charset, filename, _), disposition, encoding = head
        if kind.partition("/")[0] in ("multipart", "message") or encoding not in (*_UNENCODED, "base64"):
            return None
        rows.append(_part_values(pos, kind, charset, filename, disposition, False, _bytes_of(encoding, payload)))
    return pairs, rows


def _decode_one(seq: str, raw: bytes) -> dict:
    found = _plainly_built(raw)
    if found is None:
        message = email.message_from_bytes(raw, _Part)
        pairs = message.raw_items()
        parts = [_part_row(pos, part) for pos, part in enumerate(message.walk(), start=1)]
    else:
        pairs, parts = found
        first = {}
        for name, value in pairs:
            first.setdefault(name.lower(), value)

    def header(name: str, other: str) -> object:
        return message.get(name, other) if found is None else first.get(name.lower(), other)

    return {
        "message_id": str(header("Message-ID", seq)),
        "subject": _header_text(header("Subject", "")),
        "sender_list": _addresses(header("From", "")),
        "recipient_list": _addresses(header("To", "")),
        "sent_at": _known(_sent_at, str(header("Date", ""))),
        "header_list": [
            {"pos": i, "name": k, "value": _header_text(v)} for i, (k, v) in enumerate(pairs, start=1)
        ],
        "part_list": parts,
        "_corrupt": None,
    }


def _decoded(row: dict) -> dict:
    try:
        if row["raw"] is None:
            raise ValueError("no message bytes")
        found = _decode_one(row["seq"], row["raw"])
    except Exception as error:  # isolation: one bad message never fails the batch
        found = {"_corrupt": f"{type(error).__name__}: {error}"}
    return {"seq": row["seq"], "account_email": row["account_email"], "folder": row["folder"], **found}


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(DECODED_SCHEMA)
    rows: list[dict] = []
    pending = 0
    for batch in batches:
        for at in range(0, batch.num_rows, _READ_ROWS):
            for row in batch.slice(at, _READ_ROWS).to_pylist():
                rows.append(_decoded(row))
                pending += len(row["raw"] or b"")
                if pending > _FLUSH_BYTES or len(rows) >= _FLUSH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, pending = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_eml_files(spark: SparkSession, path: str, params: Params = DEFAULTS) -> DataFrame:
    """Raw messages under ``path``; oversized files are skipped before being read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.eml")
        .load(path)
        .filter(F.col("length") <= params.max_message_bytes)
    )
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("seq"),
        F.lit("").alias("account_email"),
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        F.col("content").alias("raw"),
    )


def decode_messages(raw: DataFrame) -> DataFrame:
    """Header and part arrays of raw messages (seq, account_email, folder, raw)."""
    return raw.select("seq", "account_email", "folder", "raw").mapInArrow(_decode_batches, DECODED_SCHEMA)


def _kinds(parts: Column) -> Column:
    """Adds the kind; a message of one part is all body unless it is an attachment."""

    def one(p: Column) -> Column:
        kind = part_kind(p["content_type"], p["disposition"], p["filename"], p["is_multipart"])
        return p.withField("kind", kind)

    return F.transform(parts, one)


def shape_messages(decoded: DataFrame, ingest_time: Column, params: Params = DEFAULTS) -> DataFrame:
    """Typed message rows; rejected ones keep their ``_corrupt`` reason."""
    parts = F.col("part_list")
    if params.max_parts is not None:
        parts = F.filter(parts, lambda p: p["pos"] <= params.max_parts)
    staged = decoded.withColumn("_parts", _kinds(parts))
    staged = staged.withColumn("attachments", attachments_of(F.col("_parts"), F.col("message_id"), params))
    return staged.select(
        F.coalesce("message_id", "seq").alias("message_id"),
        cap_subject(F.col("subject"), params).alias("subject"),
        format_addresses(F.col("sender_list")).alias("sender"),
        format_addresses(F.col("recipient_list")).alias("recipient"),
        F.coalesce(F.timestamp_micros((F.col("sent_at") * 1000000).cast("bigint")), ingest_time).alias("date"),
        body_of(F.col("_parts"), "text", params.max_body_chars).alias("body_text"),
        body_of(F.col("_parts"), "html", params.max_body_chars).alias("body_html"),
        header_map(F.col("header_list")).alias("headers"),
        "attachments",
        "account_email",
        "folder",
        "_corrupt",
    )


def split_rejects(shaped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable messages, rejected messages)."""
    good = shaped.filter(F.col("_corrupt").isNull()).drop("_corrupt")
    bad = shaped.filter(F.col("_corrupt").isNotNull()).select("message_id", "account_email", "folder", "_corrupt")
    return good, bad


def attachment_rows(messages: DataFrame) -> DataFrame:
    """Long attachment table of shaped messages."""
    return messages.select(*MAILBOX_KEY, F.explode("attachments").alias("a")).select(*MAILBOX_KEY, "a.*")
