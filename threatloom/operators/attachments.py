"""Layer 3: attachment features.

Attachments come as a long table, one row each, with the first bytes only
(``head``) for type detection.  Every check is a projection on that row; one
aggregation by message brings them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.functions import constants as K
from threatloom.functions.risk import risk_bucket
from threatloom.functions.text import count_of, strip, text
from threatloom.params import DEFAULTS, Params

MESSAGE_KEY = ["account_email", "folder", "message_id"]


def bare_name(filename: Column) -> Column:
    """Lower-cased name without outer blanks, NULs and trailing dots."""
    name = F.replace(strip(F.lower(text(filename))), F.lit("\0"), F.lit(""))
    return F.regexp_replace(name, r"\.+\z", "")


def last_extension(name: Column) -> Column:
    """Text after the last dot, empty without a dot."""
    return F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def is_among(value: Column, options: list[str]) -> Column:
    """Is the text one of ``options`` (which hold no commas)?"""
    return F.find_in_set(value, F.lit(",".join(options))) > 0


def has_extension(name: Column, extensions: list[str]) -> Column:
    """Does the name end in a dot and one of ``extensions``?"""
    single = [e for e in extensions if "." not in e]
    double = [e for e in extensions if "." in e]
    out = is_among(last_extension(name), single)
    if double:
        out = out | name.rlike(r"\.(?:" + "|".join(double).replace(".", r"\.") + r")\z")
    return out


# --- checks on one attachment -------------------------------------------------


def _line(flag: str, *parts: Column | str) -> Column:
    return F.when(F.col(flag), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise(F.lit(""))


def _points(flag: str, weight: float) -> Column:
    return F.when(F.col(flag), F.lit(weight)).otherwise(F.lit(0.0))


def extension_checks(df: DataFrame) -> DataFrame:
    """Adds ``ext_score``, ``ext_warnings``.

    Flags are a projection of their own: they are used twice, and small
    projections keep the generated methods within what the JIT compiles.
    """
    name, shown = F.col("_name"), text(F.col("filename"))
    return (
        df.withColumn("_name", bare_name(F.col("filename")))
        .withColumns(
            {
                "_dangerous": has_extension(name, K.DANGEROUS_EXTENSIONS),
                "_suspicious": has_extension(name, K.SUSPICIOUS_SUFFIXES),
                "_several": count_of(name, ".") > 1,
            }
        )
        .withColumns(
            {
                "ext_score": _points("_dangerous", 5.0) + _points("_suspicious", 3.0) + _points("_several", 1.5),
                "ext_warnings": F.array_remove(
                    F.array(
                        _line("_dangerous", "Dangerous file type: ", shown),
                        _line("_suspicious", "Suspicious file extension: ", shown),
                        _line("_several", "Multiple extensions detected: ", shown),
                    ),
                    "",
                ),
            }
        )
        .drop("_name", "_dangerous", "_suspicious", "_several")
    )


def magic_type(head: str = "head") -> Column:
    """File type by leading bytes of a column, null when unknown or shorter than four bytes.

    The bytes are read as hexadecimal text: one ordered alternation finds the
    prefix, a literal map names it.
    """

    def names(pairs: list[tuple[str, str]]) -> str:
        return "map(" + ", ".join(f"'{value}', '{name}'" for value, name in pairs) + ")"

    prefixes = "|".join(value for value, _ in K.MAGIC_PREFIXES)
    seen = f"hex({head})"
    return F.expr(
        f"CASE WHEN length({head}) < 4 THEN NULL"
        f" WHEN startswith({seen}, '{K.RIFF_HEX}') THEN"
        f" try_element_at({names(K.RIFF_FORMS)}, substring({seen}, 17, 8))"
        f" ELSE coalesce(try_element_at({names(K.MAGIC_PREFIXES)}, regexp_extract({seen}, '^({prefixes})', 1)),"
        f" CASE WHEN substring({seen}, 9, 8) = '{K.FTYP_HEX}' THEN 'mp4' END) END"
    )


def _type_mismatch(name: Column, kind: Column) -> Column:
    """Score of a known type under a wrong extension."""
    pairs = [f"{known}:{e}" for known, extensions in K.EXPECTED_EXTENSIONS.items() for e in extensions]
    expected = is_among(F.concat(kind, F.lit(":"), last_extension(name)), pairs)
    return F.when(expected, F.lit(0.0)).when(kind == "exe", F.lit(5.0)).otherwise(F.lit(2.0))


def mismatch_checks(df: DataFrame) -> DataFrame:
    """Adds ``detected_type``, ``type_score``, ``type_issue`` (empty when fine)."""
    staged = df.withColumns({"detected_type": magic_type("head"), "_name": bare_name(F.col("filename"))})
    name, kind = F.col("_name"), F.col("detected_type")
    wrong = _type_mismatch(name, kind)
    extension = last_extension(name)
    strict = dict(K.STRICT_SIGNATURES)
    critical = [e for e in strict if e in K.MEDIA_EXTENSIONS or e == "wav"]
    names = F.str_to_map(F.lit("|".join(f"{e}={d}" for e, d in strict.items())), F.lit("[|]"), F.lit("="))
    description = F.try_element_at(names, extension)
    unsigned = (
        F.when(is_among(extension, critical), F.lit(5.0))
        .when(is_among(extension, list(strict)), F.lit(2.0))
        .otherwise(F.lit(0.0))
    )
    staged = staged.withColumns(
        {"type_score": F.when(kind.isNotNull(), wrong).otherwise(unsigned), "_description": description}
    )
    issue = (
        F.when(F.col("type_score") == 0, F.lit(""))
        .when((kind == "exe"), F.lit("Executable disguised as another file type"))
        .when(
            kind.isNotNull(),
            F.concat(F.lit("File type mismatch: "), text(F.col("filename")), F.lit(" (detected "), kind, F.lit(")")),
        )
        .otherwise(
            F.concat(
                F.lit("Invalid file signature for ."),
                extension,
                F.lit(": expected "),
                F.coalesce("_description", F.lit("")),
                F.lit(" signature but none found"),
            )
        )
    )
    return staged.withColumn("type_issue", issue).drop("_name", "_description")


def size_checks(df: DataFrame) -> DataFrame:
    """Adds ``size_score``, ``size_issue`` (empty when fine)."""
    size, shown = F.col("size"), text(F.col("filename"))
    media = has_extension(F.lower(shown), K.MEDIA_EXTENSIONS)
    # one decimal, halves to even
    mib = F.format_string("%.1f", F.bround(size / F.lit(float(K.MIB)), 1))
    large = _line("_large", "Unusually large attachment: ", shown, " (", mib, "MB)")
    tiny = _line("_tiny", "Suspiciously small media file: ", shown, " (", size.cast("string"), " bytes)")
    return (
        df.withColumns(
            {
                "_large": size > K.LARGE_ATTACHMENT_BYTES,
                "_tiny": (size < K.TINY_MEDIA_BYTES) & media,
            }
        )
        .withColumns({"size_score": _points("_large", 1.5) + _points("_tiny", 1.0), "size_issue": F.concat(large, tiny)})
        .drop("_large", "_tiny")
    )


def small_video_score(filename: Column, scanned_bytes: Column) -> Column:
    """Half a point for a video whose scanned bytes are implausibly few."""
    video = has_extension(F.lower(text(filename)), K.SMALL_VIDEO_EXTENSIONS)
    return F.when(video & (scanned_bytes < K.SMALL_VIDEO_BYTES), F.lit(0.5)).otherwise(F.lit(0.0))


def is_zip(filename: Column, head: Column) -> Column:
    """Looked into as a zip?"""
    return F.coalesce(F.startswith(head, F.lit(bytes.fromhex("504B0304"))), F.lit(False)) | F.lower(text(filename)).endswith(".zip")


def is_tar(filename: Column) -> Column:
    """Looked into as a tar?"""
    return has_extension(F.lower(text(filename)), ["tar", "tgz", "gz"])


def attachment_checks(attachments: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """Adds ``meta_score`` and the three lists of findings to each attachment.

    ``archives`` holds one row (mailbox key, pos, archive_score,
    archive_warnings) per attachment that was looked into.
    """
    kept = [c for c in attachments.columns if c not in ("archive_score", "archive_warnings")]
    none = F.array().cast("array<string>")
    archive_score, archive_lines = F.lit(0.0), none
    if "archive_score" in attachments.columns:
        archive_score = F.coalesce("archive_score", F.lit(0.0))
        archive_lines = F.coalesce("archive_warnings", none)
    elif archives is not None:
        # joined first: the findings' texts are longer than the rows they are made of
        attachments = attachments.join(archives, [*MESSAGE_KEY, "pos"], "left")
        archive_score = F.coalesce("archive_score", F.lit(0.0))
        archive_lines = F.coalesce("archive_warnings", none)
    staged = size_checks(mismatch_checks(extension_checks(attachments)))
    shown = text(F.col("filename"))
    cut = F.when(
        F.coalesce("truncated", F.lit(False)), F.concat(F.lit("Attachment truncated for scanning: "), shown)
    ).otherwise(F.lit(""))
    mismatch = F.when(
        F.col("type_issue") != "", F.concat(shown, F.lit(": "), F.col("type_issue"))
    ).otherwise(F.lit(""))
    return staged.select(
        *kept,
        (F.col("ext_score") + F.col("type_score") + F.col("size_score") + archive_score).alias("meta_score"),
        F.concat(F.array_remove(F.array(mismatch), ""), archive_lines).alias("suspicious_attachments"),
        F.col("ext_warnings").alias("file_type_warnings"),
        F.array_remove(F.array(cut, F.col("size_issue")), "").alias("size_anomalies"),
    )


def with_archives(attachments: DataFrame, archives: DataFrame) -> DataFrame:
    """Adds ``archive_score`` and ``archive_warnings``, null where an attachment was not looked into.

    The left join on mailbox key and position, with rows dealt by message alone: findings,
    which are longer than the rows they are made of, are then gathered where they lie.
    """
    found = F.struct("archive_score", "archive_warnings")
    at = [*MESSAGE_KEY, "pos"]
    known = archives.dropna(subset=at).select(*at, found.alias("_archive"), F.lit(False).alias("_own"))
    rows = attachments.withColumn("_own", F.lit(True)).unionByName(known, allowMissingColumns=True).repartition(*MESSAGE_KEY)
    inside = F.collect_list("_archive").over(Window.partitionBy(*at))
    matched = rows.withColumn("_archives", inside).where("_own").withColumn("_archive", F.explode_outer("_archives"))
    return matched.select(*attachments.columns, "_archive.*")


# --- admission and the layer --------------------------------------------------


def admit(items: Column, params: Params = DEFAULTS) -> Column:
    """Positions admitted from an ordered array of structs with ``pos`` and ``size``.

    A walk with two budgets: at most so many attachments, and at most so many
    bytes in total.  One that does not fit is skipped and uses no budget, so a
    later, smaller one may still get in - not a running sum.
    """
    start = F.struct(
        F.lit(0).cast("bigint").alias("total"), F.array().cast("array<int>").alias("kept")
    )
    limit = params.max_total_attachment_bytes

    def step(state: Column, item: Column) -> Column:
        fits = F.size(state["kept"]) < params.max_attachment_count
        if limit > 0:
            fits = fits & (state["total"] + item["size"] <= limit)
        return F.when(
            fits,
            F.struct(
                (state["total"] + item["size"]).alias("total"),
                F.concat(state["kept"], F.array(item["pos"])).alias("kept"),
            ),
        ).otherwise(state)

    return F.aggregate(items, start, step, lambda s: s["kept"])


def truncation(size: Column, params: Params = DEFAULTS) -> Column:
    """Is the attachment cut for scanning?"""
    if params.max_attachment_bytes <= 0:
        return F.lit(False)
    return size > params.max_attachment_bytes


def scanned_bytes(size: Column, params: Params = DEFAULTS) -> Column:
    """Bytes left to scan after the per-attachment cut."""
    if params.max_attachment_bytes <= 0:
        return size
    return F.least(size, F.lit(params.max_attachment_bytes).cast("bigint"))


def with_admission(attachments: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds ``admitted``: does the walk over the message's attachments take this one?

    The walk of ``admit``, streamed: attachments are dealt by message and sorted,
    and a task carries two numbers from one to the next.  So a message may have any
    number of attachments; most messages take all of theirs, which is seen from
    sums of whole batches.  Attachments of unknown size are not taken if bytes are
    limited; ties of position are walked by size, then name.
    """
    most, limit = params.max_attachment_count, params.max_total_attachment_bytes
    names = attachments.columns
    schema = T.StructType(
        [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(attachments.schema)] + [T.StructField("admitted", T.BooleanType())]
    )
    key = [names.index(c) for c in MESSAGE_KEY]
    size_at = names.index("size")
    order = ["pos", "size", *(c for c in ("filename",) if c in names)]
    # numbered, so that rows which lie by message and in order already are not moved again
    place = F.row_number().over(Window.partitionBy(*MESSAGE_KEY).orderBy(*order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, total = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy() for i in key]
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], batch.num_rows)
            sizes = batch.column(size_at).cast(pa.int64())
            # what is beyond the limit, or unknown, never fits
            known = np.minimum(sizes.fill_null(limit + 1).to_numpy(), limit + 1) if limit > 0 else np.zeros(batch.num_rows, np.int64)
            whole = (ends - starts <= most) & (np.add.reduceat(known, starts) <= limit if limit > 0 else True)
            taken = np.repeat(whole, ends - starts)
            first = tuple(batch.column(i)[0].as_py() for i in key)
            goes_on = first == last
            for group in sorted({0, len(starts) - 1, *np.flatnonzero(~whole).tolist()}):
                if not (group == 0 and goes_on):
                    count, total = 0, 0
                for at in range(starts[group], ends[group]):
                    taken[at] = fits = count < most and (limit <= 0 or total + known[at] <= limit)
                    count, total = count + bool(fits), total + int(known[at]) * bool(fits)
            last = tuple(batch.column(i)[batch.num_rows - 1].as_py() for i in key)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(taken, pa.bool_())], names=schema.names)

    # Spark looks its input up by name, and a name may hold dots
    rows = attachments.withColumn("_place", place).toDF(*schema.names[:-1], "place")
    return rows.mapInArrow(run, schema).toDF(*names, "admitted")


def gather(attachments: DataFrame, *fields: str, params: Params = DEFAULTS) -> DataFrame:
    """One row per message with ``items``, those of its attachments that are admitted, in walk order.

    A part cap, if there is one, is applied before the shuffle.  Needs ``admitted``,
    or takes all.
    """
    item = F.struct("pos", *[f for f in fields if f != "pos"])
    if "admitted" in attachments.columns:
        item = F.when(F.col("admitted"), item)
    rows = attachments if params.max_parts is None else attachments.filter(F.col("pos") <= params.max_parts)
    return rows.groupBy(*MESSAGE_KEY).agg(F.array_sort(F.collect_list(item)).alias("items"))


def _up_to_cap(attachments: DataFrame, params: Params) -> DataFrame:
    return attachments if params.max_parts is None else attachments.filter(F.col("pos") <= params.max_parts)


def admitted_attachments(attachments: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds ``admitted`` (array of positions) per message."""
    marked = with_admission(_up_to_cap(attachments.select(*MESSAGE_KEY, "pos", "size"), params), params)
    return gather(marked).select(*MESSAGE_KEY, F.col("items.pos").alias("admitted"))


def gated_fold(items: Column, params: Params = DEFAULTS) -> Column:
    """Message score over attachments in order, with the small-video check gated.

    The check is taken only while the score, this attachment's own included, is
    below the stop score; what was taken is part of the running score.
    """
    start = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("flagged"))

    def step(state: Column, item: Column) -> Column:
        score = state["score"] + item["meta_score"]
        taken = (score < K.STOP_SCORE) & (item["video_score"] > 0)
        return F.struct(
            (score + F.when(taken, item["video_score"]).otherwise(F.lit(0.0))).alias("score"),
            F.when(
                taken,
                F.concat(state["flagged"], F.array(F.concat(F.lit("Suspicious video size: "), item["filename"]))),
            )
            .otherwise(state["flagged"])
            .alias("flagged"),
        )

    return F.aggregate(items, start, step)


def media_scores(
    attachments: DataFrame, params: Params = DEFAULTS, archives: DataFrame | None = None
) -> DataFrame:
    """One row per message that has admitted attachments: its key and ``media``.

    Admission is decided on sorted rows, checks run on rows, and only findings
    of admitted attachments are brought together.
    """
    video = small_video_score(F.col("filename"), scanned_bytes(F.col("size"), params))
    seen = attachments.select(*MESSAGE_KEY, "pos", "filename", "size", "head", "truncated")
    marked = with_admission(_up_to_cap(seen, params), params)
    if archives is not None:
        marked = with_archives(marked, archives)
    checked = attachment_checks(marked).withColumn(
        "video_score", video if params.small_video_check else F.lit(0.0)
    )
    lists = ("suspicious_attachments", "file_type_warnings", "size_anomalies")
    grouped = gather(checked, "size", "filename", "meta_score", "video_score", *lists)
    folded = grouped.withColumn("_fold", gated_fold(F.col("items"), params))
    score = F.col("_fold")["score"]

    def joined(name: str) -> Column:
        return F.flatten(F.transform("items", lambda x: x[name])).alias(name)

    return folded.select(
        *MESSAGE_KEY,
        F.struct(
            score.alias("score"),
            risk_bucket(score, params.media_medium, params.media_high).alias("risk_level"),
            *[joined(n) for n in lists],
            F.col("_fold")["flagged"].alias("potential_deepfakes"),
        ).alias("media"),
    )


def no_media() -> Column:
    """Result for a message without attachments."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(0.0).alias("score"),
        F.lit("low").alias("risk_level"),
        none.alias("suspicious_attachments"),
        none.alias("file_type_warnings"),
        none.alias("size_anomalies"),
        none.alias("potential_deepfakes"),
    )


def media_layer(
    emails: DataFrame,
    attachments: DataFrame,
    params: Params = DEFAULTS,
    archives: DataFrame | None = None,
) -> DataFrame:
    """Adds ``media`` to each message; without attachments it is 0 and low."""
    if not params.check_attachments:
        return emails.withColumn("media", no_media())
    joined = emails.join(media_scores(attachments, params, archives), MESSAGE_KEY, "left")
    return joined.withColumn("media", F.coalesce("media", no_media()))
