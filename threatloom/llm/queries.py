"""The registered queries of this package: ``opN_<name>(spark, folder)``, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm import (
    chat,
    decontaminate,
    jaccard_join,
    lexical_search,
    licenses,
    line_dedup,
    mixing,
    packing,
    quality_gam,
    quality_rules,
    toxicity,
    turn_repair,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]
# fixed value: what both turns of conversation -1 say
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_gam.quality_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role, F.lit(CONTROL_TEXT).alias("text"))
    return chat.read_back(chat.placed_turns(turns.unionByName(probe)))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_report(table(spark, folder, "documents"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, folder, "pages"), ["page_id"])


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return line_dedup.cleaned_digests(docs, line_dedup.keep_bitmaps(docs, line_dedup.LineParams()))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return jaccard_join.join_components(docs, jaccard_join.JoinParams(words=4, percent=85))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    judged, name = quality_rules.quality_verdicts(docs, table(spark, folder, "labels"), keep=["doc_id"])
    return judged.select("doc_id", f"{name}.*")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns, present = turn_repair.damaged(table(spark, folder, "conversations"))
    return turn_repair.repair_report(turns, present)


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    taken, sources = mixing.mixture(docs, F.array("source"))
    # as many rows as sources, which the operator bounds
    known = F.broadcast(sources.select("key", F.col("size").alias("source_size"), "target"))
    return taken.join(known, "key").select("doc_id", "size", "source_size", "target", "taken")


def registry() -> dict[str, Query]:
    """All queries by name."""
    found = (
        op1_quality_classifier,
        op2_decontaminate,
        op3_chat_format,
        op4_toxicity,
        op5_license_scan,
        op6_url_filter,
        op7_line_dedup,
        op8_jaccard_join,
        op9_packing,
        op10_quality_rules,
        op11_conversation_repair,
        op12_lexical_search,
        op13_source_mixing,
    )
    return {f.__name__: f for f in found}
