"""A log store whose questions read a part of its files.

Parsed logs lie by day and module, sorted by time within a file, so that filters on
day and module choose folders and filters on time choose row groups.  Beside them
lies an index of words: which words occur in the messages of which day and module.
A text is looked for only where all its words occur; its first and last word may be
the end and the beginning of longer ones.

Lines without a time or module lie in folders of their own and are found by the
same questions.  A text without any word is looked for everywhere.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.functions.patterns import WORD

_DAY = "yyyy-MM-dd"


def _words(message: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(f"{WORD}+"), F.lit(0)))


def write_logs(logs: DataFrame, root: str, mode: str = "append") -> None:
    """Add parsed logs (``ts``, ``module``, ``message`` and others) to the store.

    The index is written after the lines: a store that was interrupted between both
    is completed by ``reindex``.
    """
    placed = logs.withColumn("day", F.date_format("ts", _DAY))
    dealt = placed.repartition("day", "module").sortWithinPartitions("day", "module", "ts")
    lines = dealt.withColumn("in_module", F.col("module"))
    lines.write.mode(mode).partitionBy("day", "in_module").parquet(f"{root}/lines")
    _word_rows(placed).write.mode(mode).parquet(f"{root}/words")


def _word_rows(placed: DataFrame) -> DataFrame:
    """(word, day, module), once each; added up before the shuffle, so a word of every line is no hot key."""
    words = placed.select(F.explode(_words(F.col("message"))).alias("word"), "day", "module").distinct()
    return words.repartition("word").sortWithinPartitions("word")


def reindex(spark: SparkSession, root: str) -> None:
    """Write the index anew from the lines."""
    _word_rows(read_logs(spark, root)).write.mode("overwrite").parquet(f"{root}/words")


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """All lines, with ``day`` and ``in_module`` to choose folders by."""
    return spark.read.option("mergeSchema", False).parquet(f"{root}/lines")


def by_module(spark: SparkSession, root: str, module: str) -> DataFrame:
    """Lines of one module, from its folders."""
    return read_logs(spark, root).where(F.col("in_module") == module)


def previous_hour(spark: SparkSession, root: str) -> DataFrame:
    """Lines of the clock hour before the last line; only the newest days' folders are read for the time."""
    logs = read_logs(spark, root)
    days = logs.select(F.max("day").alias("day"))
    newest = logs.where(F.col("day") == days.first()[0]).agg(F.max("ts")).first()[0]
    if newest is None:
        return logs.limit(0)
    begin = F.date_trunc("hour", F.lit(newest) - F.expr("INTERVAL 1 HOUR"))
    end = F.date_trunc("hour", F.lit(newest))
    on = F.col("day").cast("string").isin(*_days(spark, newest))
    return logs.where(on & (F.col("ts") >= begin) & (F.col("ts") < end))


def _days(spark: SparkSession, newest) -> list[str]:
    """The days on which the hour before a time may lie."""
    begin = F.date_trunc("hour", F.lit(newest) - F.expr("INTERVAL 1 HOUR"))
    row = spark.range(1).select(F.date_format(begin, _DAY), F.date_format(F.lit(newest), _DAY)).first()
    return sorted(set(row))


def places_of(spark: SparkSession, root: str, piece: str) -> DataFrame | None:
    """(day, module) of folders where all words of a text occur; None for a text without words."""
    found = [(m.group(), m.start() > 0, m.end() < len(piece)) for m in re.finditer(r"\w+", piece)]
    if not found:
        return None
    word = F.col("word")
    index = spark.read.parquet(f"{root}/words")
    places = None
    for text, begins, ends in found:
        # a word at an end of the text may go on beyond it
        if begins and ends:
            fits = word == text
        elif begins:
            fits = word.startswith(text)
        elif ends:
            fits = word.endswith(text)
        else:
            fits = word.contains(text)
        own = index.where(fits).select("day", "module").distinct()
        places = own if places is None else places.intersect(own)
    return places


def containing(spark: SparkSession, root: str, piece: str) -> DataFrame:
    """Lines whose message contains a text, from folders that have its words."""
    logs = read_logs(spark, root).where(F.col("message").contains(piece))
    places = places_of(spark, root, piece)
    if places is None:
        return logs
    # one row for each folder, as there are folders
    chosen = places.collect()
    days: dict[str | None, list[str | None]] = {}
    for day, module in chosen:
        days.setdefault(module, []).append(day)
    here = F.lit(False)
    for module, listed in days.items():
        on = F.col("day").cast("string").isin([d for d in listed if d is not None])
        on = on | F.col("day").isNull() if None in listed else on
        of = F.col("in_module").isNull() if module is None else F.col("in_module") == module
        here = here | (of & on)
    return logs.where(here)
