"""Dead letters: rows that cannot be read, each with the reason, beside those that can.

One bad row never holds up its batch.  Every reader here gives (kind, key, reason,
payload) for what it rejects and leaves the rest untouched, so the tables can be
joined by union, kept, and replayed through ``replay`` once the reader is mended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.operators.shaping import parse_date

LETTER = ["kind", "key", "reason", "payload"]
_TIME = "yyyy-MM-dd HH:mm:ss"


def _letters(df: DataFrame, kind: str, key: Column, reason: Column, payload: Column) -> DataFrame:
    found = df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), reason.alias("reason"), payload.cast("string").alias("payload"))
    return found.where(F.col("reason").isNotNull())


def log_reason(line: Column) -> Column:
    """Why a JSON log line cannot be used; null if it can."""
    fields = F.try_parse_json(line)

    def field(name: str) -> Column:
        return F.try_variant_get(fields, f"$.{name}", "string")

    return (
        F.when(line.isNull(), "no line")
        .when(fields.isNull(), "not JSON")
        .when(field("level").isNull(), "no level")
        .when(field("timestamp").isNull(), "no time")
        .when(F.try_to_timestamp(field("timestamp"), F.lit(_TIME)).isNull(), "time does not parse")
        .when(field("line").isNotNull() & F.try_variant_get(fields, "$.line", "bigint").isNull(), "line is no number")
    )


def bad_log_lines(lines: DataFrame, key: str, column: str = "value") -> DataFrame:
    """Dead letters of a table of JSON log lines."""
    return _letters(lines, "log", F.col(key), log_reason(F.col(column)), F.col(column))


def bad_dates(headers: DataFrame, key: str = "message_id") -> DataFrame:
    """Dead letters of date headers that cannot be read; the messages themselves go on with a fallback."""
    dates = headers.where(F.lower("name") == "date")
    missing = parse_date(F.col("value"), F.lit(None).cast("timestamp")).isNull()
    reason = F.when(F.col("value").isNull(), "no date").when(missing, "date does not parse")
    return _letters(dates, "date", F.col(key), reason, F.col("value"))


def faulty_accounts(accounts: DataFrame) -> DataFrame:
    """Dead letters of accounts that should be read and cannot."""
    on, there = F.coalesce("enabled", F.lit(False)), F.coalesce("connected", F.lit(False))
    return _letters(accounts, "account", F.col("account_email"), F.when(on & ~there, "not connected"), F.lit(None))


def dead_letters(*parts: DataFrame) -> DataFrame:
    """All dead letters in one table."""
    found = parts[0].select(*LETTER)
    for part in parts[1:]:
        found = found.unionByName(part.select(*LETTER))
    return found


def replay(
    letters: DataFrame, kind: str, mend: Callable[[Column], Column], reason: Callable[[Column], Column], columns: Sequence[str] = ("key", "value")
) -> tuple[DataFrame, DataFrame]:
    """Payloads of one kind that can be read once mended, as (key, value), and the letters that are left."""
    mine = letters.where(F.col("kind") == kind).withColumn("payload", mend(F.col("payload"))).withColumn("reason", reason(F.col("payload")))
    good = mine.where(F.col("reason").isNull()).select(F.col("key").alias(columns[0]), F.col("payload").alias(columns[1]))
    return good, mine.where(F.col("reason").isNotNull()).select(*LETTER).unionByName(letters.where(F.col("kind") != kind).select(*LETTER))
