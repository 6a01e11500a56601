"""The log store: the same lines as a scan, from a part of the files."""

import pytest
from pyspark.sql import functions as F

from threatloom.operators import log_store, logs


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    rows = [
        (
            None if i % 97 == 0 else 1704067200 + i * 600,
            ["main", "imap", "nlp", None][i % 4],
            f"Analysis complete for mail {i}" if i % 500 < 3 else f"fetched {i} messages, reAnalysis completed" if i % 333 == 0 else "idle",
        )
        for i in range(2000)
    ]
    table = spark.createDataFrame(rows, "epoch long, module string, message string")
    parsed = table.select(F.timestamp_seconds("epoch").alias("ts"), "module", "message")
    log_store.write_logs(parsed.where("ts < '2024-01-08' OR ts IS NULL"), root)
    log_store.write_logs(parsed.where("ts >= '2024-01-08'"), root)
    return root, parsed


def lines(df):
    return sorted(map(str, df.select("ts", "module", "message").collect()))


def share(spark, root, df):
    """Files that a question reads, of all."""
    return len(df.inputFiles()), len(log_store.read_logs(spark, root).inputFiles())


@pytest.mark.parametrize("piece", ["Analysis complete", "complete for", "mail 1001", "Analysis", " idle", "idle ", "for mail", ", ", "never said"])
def test_texts(spark, store, piece):
    root, parsed = store
    found = log_store.containing(spark, root, piece)
    assert lines(found) == lines(logs.containing(parsed, piece))


def test_rare_texts_read_few_files(spark, store):
    root, _ = store
    few, every = scanned(spark, log_store.containing(spark, root, "complete for mail")), share(spark, root, log_store.read_logs(spark, root))[1]
    assert 0 < few < every / 3


def scanned(spark, df):
    """Files that the scan of a plan reads after folders were chosen."""
    return df.select(F.input_file_name().alias("f")).distinct().count()


def test_module_and_hour(spark, store):
    root, parsed = store
    assert lines(log_store.by_module(spark, root, "imap")) == lines(logs.by_module(parsed, "imap"))
    assert lines(log_store.previous_hour(spark, root)) == lines(logs.previous_hour(parsed))
    plan = log_store.by_module(spark, root, "imap")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(in_module" in plan
    plan = log_store.previous_hour(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(ts" in plan


def test_index_written_anew(spark, store):
    root, parsed = store
    before = spark.read.parquet(f"{root}/words").count()
    log_store.reindex(spark, root)
    assert spark.read.parquet(f"{root}/words").count() <= before
    assert lines(log_store.containing(spark, root, "mail 1001")) == lines(logs.containing(parsed, "mail 1001"))
