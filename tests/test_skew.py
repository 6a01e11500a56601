"""One key holding a large share of all rows changes nothing but its own result."""

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import ATTACHMENT_SCHEMA
from threatloom.operators import archives, attachments, language, metrics, scans, shaping
from threatloom.params import Params


def test_hot_message_attachments(spark):
    rng = random.Random(1)
    sizes = [rng.randint(1, 60) for _ in range(3000)]
    box = ("a@example.com", "INBOX")
    rows = [(*box, "hot", i, f"f{i}.exe", s, None, False) for i, s in enumerate(sizes, start=1)]
    rows += [(*box, f"m{k}", 1, "a.txt", 5, None, False) for k in range(3000)]
    params = Params(max_total_attachment_bytes=200)
    table = spark.createDataFrame(rows, ATTACHMENT_SCHEMA).repartition(7)
    kept, total = [], 0
    for pos, size in enumerate(sizes, start=1):
        if len(kept) < 10 and total + size <= 200:
            kept.append(pos)
            total += size
    got = {r.message_id: r.admitted for r in attachments.admitted_attachments(table, params).collect()}
    assert got["hot"] == kept
    assert len(got) == 3001
    scored = {r.message_id: r.media for r in attachments.media_scores(table, params).collect()}
    assert [w.split("f")[-1] for w in scored["hot"].file_type_warnings] == [f"{p}.exe" for p in kept]
    assert scored["m7"].score == 0.0


def test_hot_archive(spark):
    hot = spark.range(20_000).select(
        F.lit("hot").alias("container"),
        (F.col("id") + 1).cast("int").alias("member_pos"),
        F.lit(20_000).cast("long").alias("member_count"),
        F.when(F.col("id") == 999, 3.0).when(F.col("id") > 999, 5.0).otherwise(0.0).alias("member_score"),
        F.array().cast("array<string>").alias("member_warnings"),
        F.lit("hot.zip").alias("container_name"),
    )
    got = archives.container_totals(hot.repartition(5)).collect()
    assert [(r.container, r.total) for r in got] == [("hot", 1.0 + 3.0 + 5.0)]
    capped = archives.container_totals(hot.repartition(5), params=Params(max_archive_members=1000)).collect()
    assert [(r.container, r.total) for r in capped] == [("hot", 1.0 + 3.0)]
    assert got[0].warnings == ["Archive hot.zip contains too many files (20000)"]


def test_hot_folder_and_hot_sample_key(spark):
    mail = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), F.col("id").cast("string"))).alias("folder"),
        F.lit("a").alias("account_email"),
        F.col("id").cast("string").alias("message_id"),
        F.col("id").alias("seq"),
    )
    kept = scans.first_per_folder(mail.repartition(6), Params(max_per_folder=4))
    assert [r.seq for r in kept.filter("folder = 'hot'").orderBy("rank").collect()] == [0, 3, 6, 9]
    assert kept.count() == 6000 + 4
    sample = metrics.bounded_sample(
        mail.withColumnRenamed("seq", "ts"), keys=["folder"], params=Params(sample_size=10)
    )
    hot = sample.filter("folder = 'hot'").agg(F.min("ts"), F.count("*")).first()
    assert tuple(hot) == (8997 - 27, 10)


def test_hot_message_parts(spark):
    parts = spark.range(5000).select(
        F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("message_id"),
        F.when(F.col("id") < 2000, F.col("id") + 1).otherwise(1).cast("int").alias("pos"),
        F.lit("text/plain").alias("content_type"),
        F.lit("").alias("disposition"),
        F.lit("").alias("filename"),
        F.lit(False).alias("is_multipart"),
        F.concat(F.col("id").cast("string"), F.lit(";")).alias("text"),
    )
    bodies = shaping.assemble_bodies(parts.repartition(6), Params(max_body_chars=250))
    got = {r.message_id: r.body_text for r in bodies.collect()}
    assert got["hot"] == "".join(f"{i};" for i in range(100))[:250]
    assert len(got) == 3001


def test_hot_text_is_spread(spark):
    """95 % of the rows with one text: scores are right, and no task of the join gets most of the rows."""
    rows = spark.range(20_000).select(
        F.col("id"),
        F.when(F.col("id") % 20 == 0, F.col("id").cast("string")).otherwise("hot").alias("subject"),
        F.lit("").alias("body_text"),
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    # small partitions stay apart, so that a task's rows show
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scored = language.score_distinct_texts(rows.repartition(5), lambda t: F.length(t).cast("double"))
        tasks = scored.groupBy(F.spark_partition_id().alias("task")).count().orderBy(F.desc("count")).collect()
        assert tasks[0]["count"] < 12_000 and sum(r["count"] for r in tasks) == 20_000
        wrong = scored.where(F.col("probability") != F.length("subject") + 1)
        assert wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_key_of_exact_percentiles(spark):
    rng = random.Random(3)
    values = [float(rng.choice([1, 2, 2, 2, 50, 900]) + rng.randint(0, 3)) for _ in range(6000)]
    rows = [("hot" if i % 3 else f"k{i % 50}", i, v) for i, v in enumerate(values)] + [(None, 0, 7.0)]
    table = spark.createDataFrame(rows, "key string, ts long, processing_ms double")
    for r in metrics.latency_stats(table, ["key"]).collect():
        own = sorted(v for k, _, v in rows if k == r["key"])
        n = len(own)
        wanted = (n, own[0], own[-1], own[n // 2], own[min(int(n * 0.95), n - 1)], own[min(int(n * 0.99), n - 1)])
        assert (r["sample_count"], r["min_ms"], r["max_ms"], r["p50_ms"], r["p95_ms"], r["p99_ms"]) == wanted
    whole = metrics.latency_stats(table).collect()
    assert len(whole) == 1 and whole[0]["sample_count"] == 6001
    assert metrics.latency_stats(table.limit(0)).count() == 0


def test_hot_archives_send_three_members_a_task(spark):
    """Three archives hold all members; only what decides them is shuffled, at every depth at once."""
    members = spark.range(30_000).select(
        *[F.lit(v).alias(c) for c, v in (("account_email", "a"), ("folder", "f"))],
        F.concat(F.lit("hot"), F.col("id") % 3).alias("message_id"),
        F.lit(1).alias("pos"),
        F.concat(F.lit("hot"), F.col("id") % 3).alias("container"),
        F.lit("x.zip").alias("container_name"),
        F.lit(0).alias("depth"),
        F.lit("zip").alias("kind"),
        F.lit(10).cast("long").alias("member_count"),
        (F.col("id") + 1).cast("int").alias("member_pos"),
        F.when(F.col("id") >= 29_000, "a.docm").otherwise("a.txt").alias("name"),
        F.lit(None).cast("string").alias("linkname"),
        F.lit(None).cast("string").alias("nested"),
    )
    members = members.withColumn("safe_name", F.col("name")).repartition(4)
    scored = archives.score_members(members)
    kept = archives.deciding_members(scored)
    assert kept.groupBy("container").count().agg(F.max("count")).first()[0] == 3
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Final") < plan.index("Partial")
    got = archives.archive_scores(members).collect()
    assert sorted((r.message_id, r.archive_score, len(r.archive_warnings)) for r in got) == [(f"hot{i}", 6.0, 2) for i in range(3)]


def test_reasons_of_nested_archives(spark):
    rows = [("a", "f", "m", 1, "m", "x.zip", 0, "zip", 2, i, n, n, None, state, why) for i, n, state, why in (
        (1, "in.zip", "unreadable", "File is not a zip file"), (2, "big.zip", "bomb", None))]
    names = "account_email folder message_id pos container container_name depth kind member_count member_pos name safe_name linkname nested reason"
    kinds = "string string string int string string int string long int string string string string string".split()
    table = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names.split(), kinds, strict=True)))
    (got,) = archives.archive_scores(table).collect()
    assert got.archive_warnings == ["Archive x.zip contains nested archive: in.zip", "Failed to inspect nested archive in.zip: File is not a zip file"]
    second = archives.score_members(table).where("member_pos = 2").first()
    assert second.member_warnings[1] == "Zip bomb detected: x.zip/big.zip"


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_streamed_admission_is_the_walk(spark, batch):
    """Carried over batches of any size, equal to the fold over a message's array."""
    rng = random.Random(4)
    rows = [
        (f"a{m % 2}", "f", None if m == 7 else f"m{m}", p, None if rng.random() < 0.05 else rng.randint(1, 60), f"{p}.x")
        for m in range(40)
        for p in range(1, rng.choice([2, 3, 5, 15, 40]))
    ]
    table = spark.createDataFrame(rows, "account_email string, folder string, message_id string, pos int, size long, `file.name` string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for params in (Params(max_total_attachment_bytes=100), Params(max_total_attachment_bytes=0), Params(max_attachment_count=2)):
            marked = attachments.with_admission(table.repartition(3), params)
            assert marked.columns == [*table.columns, "admitted"]
            got = {}
            for r in marked.where("admitted").collect():
                got.setdefault((r.account_email, r.message_id), []).append(r.pos)
            items = F.array_sort(F.collect_list(F.struct("pos", "size")))
            walked = table.groupBy("account_email", "folder", "message_id").agg(attachments.admit(items, params).alias("kept"))
            wanted = {(r.account_email, r.message_id): r.kept for r in walked.collect() if r.kept}
            assert {k: sorted(v) for k, v in got.items()} == wanted
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
