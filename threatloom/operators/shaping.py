"""From header and part rows to message columns.

Long tables are regrouped once, with the part cap, if any, applied before the shuffle;
everything else works on the row it is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions.identity import fallback_filename
from threatloom.functions.text import at_most, let, strip, text
from threatloom.operators.attachments import admit, truncation
from threatloom.params import DEFAULTS, Params


def _by_name(named: Column) -> Column:
    """``map<name, values>`` of a non-empty ``array<struct<name,i,value>>``, values by ``i``."""

    def runs(rows: Column) -> Column:
        def begins(i: Column) -> Column:
            return (i == 0) | (F.get(rows, i)["name"] != F.get(rows, i - 1)["name"])

        return let(F.filter(F.sequence(F.lit(0), F.size(rows) - 1), begins), lambda starts: from_runs(rows, starts))

    def from_runs(rows: Column, starts: Column) -> Column:
        def values(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(rows))
            return F.transform(F.slice(rows, start + 1, end - start), lambda e: e["value"])

        return F.map_from_arrays(F.transform(starts, lambda i: F.get(rows, i)["name"]), F.transform(starts, values))

    return let(F.array_sort(named), runs)


def header_map(entries: Column) -> Column:
    """``map<name, values>`` from an ordered ``array<struct<pos,name,value>>``; one message on its row.

    Entries are sorted by name once, and each name takes its run of them.
    """
    named = F.transform(entries, lambda e, i: F.struct(F.lower(e["name"]).alias("name"), i.alias("i"), e["value"].alias("value")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    return F.when(F.size(entries) == 0, none).otherwise(_by_name(named))


def header_multimap(headers: DataFrame, *keys: str) -> DataFrame:
    """(keys, headers): lower-cased names, repeated ones listed in order.

    A message's headers are put together where they lie, and are shuffled once, as
    one row; there they are sorted by name, and each name takes its run of them.
    """
    keys = keys or ("message_id",)
    entry = F.struct(F.lower("name").alias("name"), F.col("pos").alias("i"), F.col("value").alias("value"))
    rows = headers.groupBy(*keys).agg(F.collect_list(entry).alias("_entries"))
    return rows.select(*keys, _by_name(F.col("_entries")).alias("headers"))


def cap_subject(subject: Column, params: Params = DEFAULTS) -> Column:
    """The subject, cut where the parameters ask for it."""
    return at_most(text(subject), params.max_subject_chars)


def parse_date(raw: Column, fallback: Column) -> Column:
    """Timestamp of a mail date text, ``fallback`` when it does not parse."""
    day = F.regexp_replace(F.trim(raw), r"\A[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z")), fallback)


def is_attachment(
    content_type: Column, disposition: Column, filename: Column, is_multipart: Column
) -> Column:
    """Attachment, or part of the body?"""
    return (
        F.when(text(disposition).contains("attachment"), True)
        .when(strip(text(filename)) != "", True)
        .when(content_type.isin("text/plain", "text/html"), False)
        .when(is_multipart, False)
        .otherwise(True)
    )


def part_kind(content_type: Column, disposition: Column, filename: Column, is_multipart: Column) -> Column:
    """``attachment``, ``text``, ``html`` or ``other``."""
    attached = is_attachment(content_type, disposition, filename, is_multipart)
    return (
        F.when(attached, "attachment")
        .when(content_type == "text/plain", "text")
        .when(content_type == "text/html", "html")
        .otherwise("other")
    )


def cap_parts(parts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The first ``max_parts`` parts of each message, in walk order."""
    return parts if params.max_parts is None else parts.filter(F.col("pos") <= params.max_parts)


def body_of(parts: Column, kind: str, budget: int | None) -> Column:
    """Texts of one kind, joined in order and cut at ``budget`` characters.

    Cutting the joined text equals stopping at the budget part by part, because
    parts are appended whole until the one that reaches it.
    """
    texts = F.transform(F.filter(parts, lambda p: p["kind"] == kind), lambda p: text(p["text"]))
    return at_most(F.array_join(texts, ""), budget)


def gather_parts(parts: DataFrame, *fields: str, params: Params = DEFAULTS) -> DataFrame:
    """One row per message with ``parts`` in walk order.

    A message is one value of the result, so it is as large as the size guard lets in.
    """
    kind = part_kind(*(F.col(c) for c in ("content_type", "disposition", "filename", "is_multipart")))
    rows = cap_parts(parts, params).withColumn("kind", kind)
    item = F.struct("pos", "kind", *fields)
    return rows.groupBy("message_id").agg(F.array_sort(F.collect_list(item)).alias("parts"))


def assemble_bodies(parts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(message_id, body_text, body_html) from part rows."""
    grouped = gather_parts(parts, "text", params=params)
    return grouped.select(
        "message_id",
        body_of(F.col("parts"), "text", params.max_body_chars).alias("body_text"),
        body_of(F.col("parts"), "html", params.max_body_chars).alias("body_html"),
    )


def attachments_of(parts: Column, message_id: Column, params: Params = DEFAULTS) -> Column:
    """Admitted attachments of one message as an array of structs.

    ``parts`` must hold pos, kind, content_type, filename, size and data.
    """
    attached = F.filter(parts, lambda p: p["kind"] == "attachment")
    slim = F.transform(attached, lambda p: F.struct(p["pos"].alias("pos"), p["size"].alias("size")))
    kept = admit(slim, params)

    def shaped(p: Column) -> Column:
        data = p["data"]
        if params.max_attachment_bytes > 0:
            data = F.substring(data, 1, params.max_attachment_bytes)
        return F.struct(
            p["pos"].alias("pos"),
            fallback_filename(p["filename"], p["content_type"], message_id, p["pos"]).alias("filename"),
            p["content_type"].alias("content_type"),
            p["size"].alias("size"),
            F.substring(p["data"], 1, 12).alias("head"),
            data.alias("data"),
            truncation(p["size"], params).alias("truncated"),
        )

    return F.transform(F.filter(attached, lambda p: F.array_contains(kept, p["pos"])), shaped)
