"""Archive bytes to member rows, one attachment to many members.

Listing needs the archive formats' own directories, which no built-in reads, so
it runs in Arrow workers; scoring the listed members is a DataFrame job.
Nothing is extracted to disk, and reads are cut off at fixed limits.
"""

from __future__ import annotations

import io
import re
import tarfile
import unicodedata
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from threatloom.functions import constants as K
from threatloom.functions.identity import sanitize_filename
from threatloom.functions.text import sanitize_log
from threatloom.operators.attachments import MESSAGE_KEY, is_tar, is_zip

_S, _L = T.StringType(), T.LongType()
LISTING_SCHEMA = T.StructType(
    [
        *[T.StructField(k, _S) for k in MESSAGE_KEY],
        T.StructField("pos", T.IntegerType()),
        T.StructField("container", _S),
        T.StructField("container_name", _S),
        T.StructField("depth", T.IntegerType()),
        T.StructField("kind", _S),
        T.StructField("member_count", _L),
        T.StructField("member_pos", T.IntegerType()),
        T.StructField("name", _S),
        T.StructField("size", _L),
        T.StructField("linkname", _S),
        T.StructField("nested", _S),
    ]
)

# member rows handed back at a time
_FLUSH_ROWS = 2000


class _TooBig(ValueError):
    """A nested archive unpacks to more than the limit."""


def _read_limited(stream) -> bytes:
    data = stream.read(K.MAX_NESTED_BYTES + 1)
    if len(data) > K.MAX_NESTED_BYTES:
        raise _TooBig
    return data


def _extension(name: str) -> str:
    """Extension of the name as it is scored: safe characters only, runs of dots made one."""
    last = unicodedata.normalize("NFKC", name).replace("\\", "/").rsplit("/", 1)[-1]
    safe = re.sub(r"\.{2,}", ".", re.sub(r"[^\w\s\-.]", "", last)).strip(". ")
    return safe.rpartition(".")[2].lower() if "." in safe else ""


def _open_members(kind: str, data: bytes):
    """(member count, iterator of (name, size, link, reader)) of one archive."""
    if kind == "zip":
        archive = zipfile.ZipFile(io.BytesIO(data))
        infos = archive.infolist()
        rows = [
            (i.filename, i.file_size, None, lambda n=i.filename: archive.open(n))
            for i in infos
        ]
        return len(infos), rows
    archive = tarfile.open(fileobj=io.BytesIO(data), mode="r:*")
    infos = archive.getmembers()
    rows = [
        (
            i.name,
            i.size,
            i.linkname if i.issym() or i.islnk() else None,
            lambda i=i: archive.extractfile(i),
        )
        for i in infos
    ]
    return len(infos), rows


def _look_inside(kind: str, depth: int, name: str, size: int, reader) -> tuple[str | None, bytes | None]:
    """(outcome, bytes) for a member that is itself an archive."""
    extension = _extension(name)
    if extension not in K.ARCHIVE_EXTENSIONS:
        return None, None
    listable = extension in K.LISTABLE_NESTED_EXTENSIONS and depth < K.MAX_ARCHIVE_DEPTH
    if not listable or size >= K.MAX_NESTED_BYTES:
        return "skipped", None
    try:
        stream = reader()
        return ("ok", _read_limited(stream)) if stream is not None else ("skipped", None)
    except _TooBig:
        return ("bomb" if kind == "zip" else "unreadable"), None
    except Exception:  # encrypted, damaged or unsupported members count as unreadable
        return "unreadable", None


def list_archive(kind: str, data: bytes, key: str, shown: str, depth: int = 0) -> Iterator[dict]:
    """Member rows of one archive and of the archives inside it."""
    try:
        count, members = _open_members(kind, data)
    except Exception:  # not an archive after all: no members
        return
    for pos, (name, size, link, reader) in enumerate(members, start=1):
        outcome, inner = _look_inside(kind, depth, name, size, reader)
        yield {
            "container": key,
            "container_name": shown,
            "depth": depth,
            "kind": kind,
            "member_count": count,
            "member_pos": pos,
            "name": name,
            "size": size,
            "linkname": link,
            "nested": outcome,
        }
        if inner is not None:
            inner_kind = "zip" if _extension(name) == "zip" else "tar"
            last = name.replace("\\", "/").rsplit("/", 1)[-1]
            yield from list_archive(inner_kind, inner, f"{key}/{pos}", f"{shown}/{last}", depth + 1)


def _list_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(LISTING_SCHEMA)
    found: list[dict] = []
    for batch in batches:
        for at in range(batch.num_rows):
            # one attachment's bytes at a time
            row = {name: column[at].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            if row["data"] is None:
                continue
            mailbox = {k: row[k] for k in (*MESSAGE_KEY, "pos")}
            for kind in ("zip", "tar"):
                if not row[f"as_{kind}"]:
                    continue
                key = ":".join([*(row[k] for k in MESSAGE_KEY), str(row["pos"]), kind])
                for member in list_archive(kind, row["data"], key, row["filename"]):
                    found.append({**mailbox, **member})
                    if len(found) >= _FLUSH_ROWS:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found = []
    if found:
        yield pa.RecordBatch.from_pylist(found, schema=schema)


def archive_members(attachments: DataFrame) -> DataFrame:
    """Member rows of all attachments that are archives (mailbox key, pos, filename, data).

    Attachments that are no archive are filtered out before their bytes go to
    a worker.
    """
    name, data = F.col("filename"), F.col("data")
    candidates = attachments.select(
        *MESSAGE_KEY,
        F.col("pos").cast("int").alias("pos"),
        "filename",
        "data",
        is_zip(name, data).alias("as_zip"),
        is_tar(name).alias("as_tar"),
    ).filter(F.col("as_zip") | F.col("as_tar"))
    listed = candidates.mapInArrow(_list_batches, LISTING_SCHEMA)
    return listed.withColumn("safe_name", sanitize_log(sanitize_filename(F.col("name"))))
