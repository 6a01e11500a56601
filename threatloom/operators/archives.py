"""Scoring of archive members.

``members`` is a long table, one row per listed member::

    account_email, folder, message_id, pos   the attachment
    container, depth       unique key of the archive the member is in, 0 = the attachment
    container_name         display path of that archive
    kind                   'zip' or 'tar'
    member_count           members the archive says it has
    member_pos             1, 2, ... in archive order
    name, safe_name        as stored, and sanitised
    linkname               link target, null for plain members
    nested                 null, or what became of looking into a nested archive:
                           'ok', 'unreadable', 'bomb', 'skipped'
    reason                 why it could not be read, or was taken for a bomb; may be missing or null

The container key of a nested archive is its parent's key, a slash and the
member position, so sums move up one level by an equi-join per level.

Looking into an archive stops once its score has reached the stop score, and no
finding adds less than two points: whatever its size, an archive is settled by its
first three members with a finding.  Those of all archives at all depths are taken
by one ranked limit, applied before the shuffle, so an archive that holds a third
of all members sends three rows a task, and the levels are folded on what is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.functions import constants as K
from threatloom.functions.identity import path_traversal
from threatloom.operators.attachments import MESSAGE_KEY, has_extension
from threatloom.params import DEFAULTS, Params
from threatloom.session import stored

# the least that a member with a finding adds: a nested archive of which nothing is known
LEAST_SCORE = 2.0
# members with a finding that can be reached below the stop score
REACHED = math.ceil(K.STOP_SCORE / LEAST_SCORE)


def nested_score() -> Column:
    """Score of what a nested archive held, by what became of reading it."""
    return (
        F.when(F.col("nested") == "ok", F.coalesce("nested_total", F.lit(0.0)))
        .when(F.col("nested") == "bomb", F.lit(5.0))
        .when(F.col("nested") == "unreadable", F.lit(3.0))
        .otherwise(F.lit(0.0))
    )


def score_members(members: DataFrame, nested_totals: DataFrame | None = None) -> DataFrame:
    """Adds ``member_score`` and ``member_warnings`` to member rows.

    ``nested_totals`` holds (container, total, warnings) of the level below.
    """
    none = F.array().cast("array<string>")
    staged = members.withColumn("_child", F.concat_ws("/", "container", F.col("member_pos").cast("string")))
    if nested_totals is None:
        staged = staged.withColumns(
            {"nested_total": F.lit(None).cast("double"), "_nested_warnings": none}
        )
    else:
        below = nested_totals.select(
            F.col("container").alias("_child"),
            F.col("total").alias("nested_total"),
            F.col("warnings").alias("_nested_warnings"),
        )
        staged = staged.join(below, "_child", "left")
    why = F.col("reason") if "reason" in members.columns else F.lit(None).cast("string")
    low, safe, inside = F.lower("safe_name"), F.col("safe_name"), F.col("container_name")
    staged = staged.withColumns(
        {
            "_tar": F.col("kind") == "tar",
            "_dangerous": has_extension(low, K.DANGEROUS_EXTENSIONS),
            "_archive": has_extension(low, K.ARCHIVE_EXTENSIONS),
            "_suspicious": has_extension(low, K.SUSPICIOUS_SUFFIXES),
            "_escapes": path_traversal(F.col("name")),
            "_link": F.coalesce(path_traversal(F.col("linkname")), F.lit(False)),
            "_below": nested_score(),
        }
    )
    tar, dangerous, escapes, link = (F.col(c) for c in ("_tar", "_dangerous", "_escapes", "_link"))
    # a tar member is settled by the first finding, a zip member adds them up
    settled = tar & ~dangerous & (escapes | link)
    archive = F.col("_archive") & ~dangerous & ~settled
    at_archive = F.when(archive, F.lit(2.0) + F.col("_below")).otherwise(F.lit(0.0))
    suspicious = F.col("_suspicious") & ~dangerous & ~settled & (at_archive < K.STOP_SCORE)
    score = (
        F.when(dangerous, F.lit(5.0)).otherwise(at_archive)
        + F.when(suspicious, F.lit(3.0)).otherwise(F.lit(0.0))
        + F.when(settled | (~tar & escapes), F.lit(5.0)).otherwise(F.lit(0.0))
    )

    def line(flag: Column, *parts: Column | str) -> Column:
        texts = [F.lit(p) if isinstance(p, str) else p for p in parts]
        return F.when(flag, F.concat(*texts)).otherwise(F.lit(""))

    own_nested = (
        F.when(archive & (F.col("nested") == "ok"), F.coalesce("_nested_warnings", none))
        .when(
            archive & (F.col("nested") == "bomb"),
            F.array(F.concat(F.lit("Zip bomb detected: "), inside, F.lit("/"), safe, _if_known(" (", why, ")"))),
        )
        .when(
            archive & (F.col("nested") == "unreadable"),
            F.array(F.concat(F.lit("Failed to inspect nested archive "), safe, _if_known(": ", why, ""))),
        )
        .otherwise(none)
    )
    first = F.array(
        line(~tar & escapes, "Zip file ", inside, " contains path traversal attempt: ", safe),
        line(dangerous, "Archive ", inside, " contains dangerous file: ", safe),
        line(settled & escapes, "Tar file ", inside, " contains path traversal attempt: ", safe),
        line(settled & ~escapes, "Tar file ", inside, " contains link with path traversal attempt: ", safe),
        line(archive, "Archive ", inside, " contains nested archive: ", safe),
    )
    last = F.array(line(suspicious, "Archive ", inside, " contains suspicious file: ", safe))
    return staged.withColumns(
        {
            "member_score": score,
            "member_warnings": F.concat(F.array_remove(first, ""), own_nested, F.array_remove(last, "")),
        }
    ).select(*members.columns, "member_score", "member_warnings")


def count_penalty() -> Column:
    """One point for an archive with more members than are looked at."""
    return F.when(F.col("member_count") > K.MAX_ARCHIVE_MEMBERS, F.lit(1.0)).otherwise(F.lit(0.0))


def _if_known(before: str, why: Column, behind: str) -> Column:
    return F.when(why.isNotNull(), F.concat(F.lit(before), why, F.lit(behind))).otherwise(F.lit(""))


def deciding_members(scored: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """At most three members of each container, the first with a finding; of one without any finding its first.

    A member without a finding adds nothing, so one is enough to name its container.
    The limit is applied on the map side and again behind the shuffle.
    """
    if params.max_archive_members is not None:
        scored = scored.filter(F.col("member_pos") <= params.max_archive_members)
    order = Window.partitionBy("container").orderBy(F.desc("_tells"), "member_pos")
    ranked = scored.withColumn("_tells", F.col("member_score") > 0).withColumn("_place", F.row_number().over(order))
    decides = (F.col("_place") <= REACHED) & (F.col("_tells") | (F.col("_place") == 1))
    return ranked.filter(decides).drop("_tells", "_place")


def container_totals(scored: DataFrame, *keys: str, params: Params = DEFAULTS) -> DataFrame:
    """(container, total, warnings): members in order until the stop score is reached.

    The member that crosses the line still counts.
    """
    return _folded(deciding_members(scored, params), *keys)


def _folded(decided: DataFrame, *keys: str) -> DataFrame:
    """``container_totals`` of members that are the deciding ones already."""
    member = F.struct("member_pos", "member_score", "member_warnings")
    many = F.max("member_count")
    too_many = F.when(
        many > K.MAX_ARCHIVE_MEMBERS,
        F.array(
            F.concat(
                F.lit("Archive "),
                F.any_value("container_name"),
                F.lit(" contains too many files ("),
                many.cast("string"),
                F.lit(")"),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))
    grouped = decided.groupBy("container", *keys).agg(
        F.max(count_penalty()).alias("total"), too_many.alias("warnings"), F.array_sort(F.collect_list(member)).alias("_members")
    )

    def step(state: Column, m: Column) -> Column:
        return F.when(
            state["total"] < K.STOP_SCORE,
            F.struct(
                (state["total"] + m["member_score"]).alias("total"),
                F.concat(state["warnings"], m["member_warnings"]).alias("warnings"),
            ),
        ).otherwise(state)

    folded = F.aggregate("_members", F.struct("total", "warnings"), step)
    return grouped.withColumn("_fold", folded).select("container", *keys, "_fold.total", "_fold.warnings")


def archive_scores(members: DataFrame, params: Params = DEFAULTS, deepest: int = K.MAX_ARCHIVE_DEPTH) -> DataFrame:
    """(mailbox key, pos, archive_score, archive_warnings) from the deepest level up.

    Members are read and shuffled once; what decides each container is written,
    and the levels are folded on that.
    """
    first = deciding_members(score_members(members), params).select(*members.columns)
    members, totals = stored(first, "deciding-members"), None
    for depth in range(deepest, -1, -1):
        level = score_members(members.filter(F.col("depth") == depth), totals)
        totals = _folded(level, *MESSAGE_KEY, "pos", "kind")
    # an attachment is looked into as a zip, as a tar, or as both, in that order
    ordered = F.array_sort(
        F.collect_list(F.struct((F.col("kind") == "tar").alias("second"), "warnings"))
    )
    return totals.groupBy(*MESSAGE_KEY, "pos").agg(
        F.sum("total").alias("archive_score"), F.flatten(ordered["warnings"]).alias("archive_warnings")
    )
