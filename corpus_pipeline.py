"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, folder) and works on all that the stage before
kept; its result is written as Parquet and reread as the next one's ``docs``.
All but the last return the columns of ``documents``, whatever they are.

Null and empty texts are rejected by the quality rules.  Repeated rows are
reduced to one by the near-duplicate stage; a row without an id is nobody's
duplicate and stays.  An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm import decontaminate, jaccard_join, line_dedup, packing, quality_rules
from threatloom.llm.batches import quoted
from threatloom.session import shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the language models keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged, name = quality_rules.quality_verdicts(docs, labels)
    return judged.where(f"{name}.kept").select(*map(quoted, docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have stay only where they occur first."""
    params = line_dedup.LineParams(min_docs=10, keep_first=True)
    return line_dedup.cleaned_documents(docs, line_dedup.keep_bitmaps(docs, params))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 of five-word shingles stays, the one with the smallest id."""
    return jaccard_join.without_near_duplicates(docs, jaccard_join.JoinParams())


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found, name = decontaminate.with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size(name) == 0).select(*map(quoted, docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", leak_stage),
    ("packing", packing_stage),
]

# trained models and token counts: not to be had in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
