"""Structured JSON logs: reading, redacting, and the usual questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.functions import constants as K

# fixed values: fields every log line has
LOG_FIELDS = ["timestamp", "level", "logger", "message", "module", "function", "line"]


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed log rows from JSON lines; unknown fields go to ``extras``, bad lines to ``_corrupt``.

    A line is parsed once, to a map; the known fields are looked up in it.
    """
    raw = F.col(column)
    fields = F.from_json(raw, T.MapType(T.StringType(), T.StringType()))
    staged = lines.withColumn("_all", fields)
    known = {n: F.try_element_at("_all", F.lit(n)) for n in LOG_FIELDS}
    known["line"] = known["line"].try_cast("bigint")
    extras = F.map_filter("_all", lambda k, v: F.find_in_set(k, F.lit(",".join(LOG_FIELDS))) == 0)
    return staged.select(
        *[c for c in lines.columns if c != column],
        F.try_to_timestamp(known["timestamp"], F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
        *[value.alias(n) for n, value in known.items()],
        F.coalesce(extras, F.create_map().cast("map<string,string>")).alias("extras"),
        F.when(known["level"].isNull(), raw).alias("_corrupt"),
    )


def is_sensitive_field(name: Column) -> Column:
    """Does a field name contain one of the sensitive words?"""
    return F.lower(name).rlike("|".join(K.SENSITIVE_FIELD_PARTS))


def redact_fields(fields: Column) -> Column:
    """Map with the values of sensitive keys hidden."""
    return F.transform_values(
        fields, lambda k, v: F.when(is_sensitive_field(k), F.lit(K.REDACTED)).otherwise(v)
    )


def to_log_line(record: DataFrame) -> Column:
    """JSON line of a log row, its extras redacted and nested last."""
    plain = F.struct(*[F.col(n) for n in LOG_FIELDS if n in record.columns])
    head = F.to_json(plain)
    tail = F.to_json(redact_fields(F.col("extras")))
    merged = F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(","), F.substring(tail, 2, F.length(tail)))
    return F.when(F.size("extras") > 0, merged).otherwise(head)


def by_level(logs: DataFrame, level: str) -> DataFrame:
    """Lines of one level."""
    return logs.filter(F.col("level") == level)


def by_module(logs: DataFrame, module: str) -> DataFrame:
    """Lines of one module."""
    return logs.filter(F.col("module") == module)


def containing(logs: DataFrame, piece: str) -> DataFrame:
    """Lines whose message contains a text."""
    return logs.filter(F.col("message").contains(piece))


def level_counts(logs: DataFrame) -> DataFrame:
    """(level, n)."""
    return logs.groupBy("level").agg(F.count("*").alias("n"))


def previous_hour(logs: DataFrame, now: Column | None = None) -> DataFrame:
    """Lines of the clock hour before ``now``, by default before the last line.

    The default reads the newest time in a scalar subquery, so the answer does
    not depend on when the job runs.
    """
    if now is None:
        now = logs.agg(F.max("ts")).scalar()
    wanted = F.date_trunc("hour", now - F.expr("INTERVAL 1 HOUR"))
    return logs.filter(F.date_trunc("hour", "ts") == wanted)
