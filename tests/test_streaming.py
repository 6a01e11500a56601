"""The monitoring loop on files that arrive one after another."""

from dataclasses import replace

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.helpers import attachments, emails
from threatloom.operators.language import model_indicator, model_score, score_distinct_texts
from threatloom.params import Params
from threatloom.streaming import monitor as stream
from threatloom.streaming.commits import Commits
from threatloom.streaming.monitor import Loop
from threatloom.streaming.outbox import DEAD, PENDING, SENT, deliver


def finish(running):
    running.awaitTermination()
    assert running.exception() is None


def ids(df):
    return sorted(r.message_id for r in df.collect())


def test_monitor_resumes_without_repeating(spark, tmp_path):
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    own = attachments(spark, ("m0", 1, "a.exe", 10, None))
    alerts = []
    loop = Loop(out, own, on_alerts=lambda df, n: alerts.append((n, ids(df))))
    store = Commits(spark, out)

    def cycle(*rows):
        emails(spark, *rows).write.mode("append").parquet(inbox)
        finish(stream.monitor(stream.file_stream(spark, inbox), loop, once=True))

    cycle({"message_id": "m0"}, {"message_id": "m1", "subject": "hello"})
    cycle({"message_id": "m2", "subject": "URGENT PRIZE LOTTERY !!!", "body_text": "click here, winner"})
    assert ids(store.read("reports", "message_id string")) == ["m0", "m1", "m2"]
    assert [names for _, names in alerts if names] == [["m0"], ["m2"]]
    threats = store.read("threats", stream.THREATS)
    assert {(r.message_id, r.threat_type) for r in threats.collect()} == {("m0", "malware"), ("m2", "spam")}
    assert store.read("processed", stream.KEYS).count() == 3
    totals = store.snapshot("totals", stream.TOTALS).groupBy("threat_type").sum("n").collect()
    assert dict(map(tuple, totals)) == {"malware": 1, "spam": 1}


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_streams_as_a_file_and_as_a_folder(spark, tmp_path, files):
    path = tmp_path / "tables" / "documents.parquet"
    spark.range(9).repartition(files).write.parquet(str(path))
    spark.range(5).write.parquet(str(tmp_path / "tables" / "other.parquet"))
    if files == 1:
        part = next(path.glob("part-*"))
        part.rename(tmp_path / "tables" / "part")
        path.rename(tmp_path / "folder")
        (tmp_path / "tables" / "part").rename(path)
    rows = stream.table_stream(spark, str(path))
    out = str(tmp_path / "out")
    finish(
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(9))


def test_replays_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    mail = emails(spark, {"message_id": "a"}, {"message_id": "b"}).withColumn("date", F.timestamp_seconds(F.lit(1000)))
    mail.write.parquet(source)
    mail.write.mode("append").parquet(source)
    kept = stream.first_deliveries(stream.file_stream(spark, source))
    running = (
        kept.writeStream.format("parquet")
        .option("path", str(tmp_path / "kept"))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2


def test_each_distinct_text_is_classified_once(spark):
    mail = emails(spark, *[{"subject": "s", "body_text": "same"}] * 5, {"subject": "s", "body_text": "other"})
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def classify(texts):
        seen.add(len(texts))
        return texts.str.len() / 10

    rows = score_distinct_texts(mail, classify).select("message_id", "probability").collect()
    assert len(rows) == 6
    assert seen.value == 2
    p = F.lit(0.75)
    assert spark.range(1).select(model_score(p)).first()[0] == 5.0
    assert spark.range(1).select(model_indicator(p)).first()[0].endswith("0.75")


def test_a_date_in_the_future_makes_nothing_late(spark, tmp_path):
    source = str(tmp_path / "in")
    for day, name in ((10**10, "future"), (1000, "honest"), (1000, "future")):
        dated = emails(spark, {"message_id": name}).withColumn("date", F.timestamp_seconds(F.lit(day)))
        dated.coalesce(1).write.mode("append").parquet(source)
    kept = stream.first_deliveries(stream.file_stream(spark, source, per_cycle=1))
    running = (
        kept.writeStream.format("parquet")
        .option("path", str(tmp_path / "kept"))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    assert sorted(r.message_id for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == ["future", "honest"]


def box():
    return [F.lit(n).cast("bigint").alias(c) for c, n in (("seq", 1), ("size", 10))]


def accounts(spark, **connected):
    rows = [("a@example.com", True, True), ("off@example.com", False, True)]
    rows += [(f"{k}@example.com", True, v) for k, v in connected.items()]
    return spark.createDataFrame(rows, "account_email string, enabled boolean, connected boolean")


def deliver_mail(spark, source, rows, first=1):
    numbered = emails(spark, *rows).select("*", (F.monotonically_increasing_id() + first).alias("seq"), F.lit(10).cast("bigint").alias("size"))
    numbered.coalesce(1).write.mode("append").parquet(source)


def test_failed_mail_is_tried_again(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    none = attachments(spark).limit(0)
    calls = []

    def own(batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("mailbox gone")
        return none

    loop = Loop(out, own, accounts=accounts(spark), go_on=True)
    store = Commits(spark, out)

    def run(*rows):
        emails(spark, *rows).select("*", *box()).coalesce(1).write.mode("append").parquet(source)
        finish(stream.monitor(stream.file_stream(spark, source), loop, once=True))

    run({"message_id": "m1"}, {"message_id": "x", "account_email": "off@example.com"})
    run({"message_id": "m2"})
    assert ids(store.read("processed", stream.KEYS)) == ["m1"]
    assert ids(store.snapshot("queue", stream.QUEUE)) == ["m2", "x"]
    run({"message_id": "m1"}, {"message_id": "m3"})
    assert ids(store.read("processed", stream.KEYS)) == ["m1", "m2", "m3"]
    failed = store.read("failed", stream.FAILED).collect()
    assert [(r.message_id, r.attempts, r.error) for r in failed] == [("m2", 1, "RuntimeError: mailbox gone")]
    # mail of an account that is off waits, and is read when it is on again
    on = replace(loop, accounts=accounts(spark).withColumn("enabled", F.lit(True)))
    schema = spark.read.parquet(source).schema
    assert not stream.idle_cycle(spark, on, schema)
    assert ids(store.read("processed", stream.KEYS)) == ["m1", "m2", "m3", "x"]


def test_mail_over_the_limit_waits(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    loop = Loop(out, attachments(spark).limit(0), accounts=accounts(spark))
    store = Commits(spark, out)
    deliver_mail(spark, source, [{"message_id": f"m{i:02}"} for i in range(60)])
    finish(stream.monitor(stream.file_stream(spark, source), loop, once=True))
    assert ids(store.read("processed", stream.KEYS)) == [f"m{i:02}" for i in range(50)]
    # after a restart the next cycle takes what waited, and what is new
    deliver_mail(spark, source, [{"message_id": "n0"}, {"message_id": "m03"}], first=100)
    finish(stream.monitor(stream.file_stream(spark, source), loop, once=True))
    wanted = [f"m{i:02}" for i in range(60)] + ["n0"]
    assert ids(store.read("processed", stream.KEYS)) == wanted
    assert ids(store.read("reports", "message_id string")) == wanted
    assert store.snapshot("queue", stream.QUEUE).isEmpty()


def test_too_large_mail_holds_nothing_up(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    loop = Loop(out, attachments(spark).limit(0), accounts=accounts(spark), params=Params(max_per_folder=2))
    large = emails(spark, *[{"message_id": f"m{i}"} for i in range(4)])
    size = F.when(F.col("message_id") < "m2", F.lit(1 << 40)).otherwise(F.lit(10)).cast("bigint")
    large.select("*", F.substring("message_id", 2, 9).cast("bigint").alias("seq"), size.alias("size")).write.parquet(source)
    finish(stream.monitor(stream.file_stream(spark, source), loop, once=True))
    assert not stream.idle_cycle(spark, loop, spark.read.parquet(source).schema)
    store = Commits(spark, out)
    assert ids(store.read("skipped", stream.SKIPPED)) == ["m0", "m1"]
    assert ids(store.read("processed", stream.KEYS)) == ["m2", "m3"]


@pytest.mark.parametrize("where", ["threats", "queue", "commit"])
def test_a_cycle_that_dies_anywhere_runs_again(spark, tmp_path, monkeypatch, where):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    own = attachments(spark, ("m0", 1, "a.exe", 10, None))
    loop = Loop(out, own, accounts=accounts(spark))
    deliver_mail(spark, source, [{"message_id": "m0"}, {"message_id": "m1"}])
    write, commit, died = Commits.write, Commits.commit, []

    def dying(self, df, table, **how):
        path = write(self, df, table, **how)
        if table == where and not died:
            died.append(table)
            raise RuntimeError("killed")
        return path

    def no_commit(self, *args, **how):
        if where == "commit" and not died:
            died.append("commit")
            raise RuntimeError("killed")
        return commit(self, *args, **how)

    monkeypatch.setattr(Commits, "write", dying)
    monkeypatch.setattr(Commits, "commit", no_commit)
    running = stream.monitor(stream.file_stream(spark, source), loop, once=True)
    with pytest.raises(StreamingQueryException):
        running.awaitTermination()
    store = Commits(spark, out)
    assert died and store.last() == -1
    finish(stream.monitor(stream.file_stream(spark, source), loop, once=True))
    for table in ("reports", "processed"):
        assert ids(store.read(table, stream.KEYS)) == ["m0", "m1"]
    for table in ("alerts", "threats"):
        assert ids(store.read(table, stream.KEYS)) == ["m0"]


def test_a_hook_that_fails_does_not_analyse_twice(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    deliver_mail(spark, source, [{"message_id": "m0"}])
    told = []

    def hook(alerts, n):
        told.append(ids(alerts))
        if len(told) == 1:
            raise RuntimeError("channel gone")

    loop = Loop(out, attachments(spark, ("m0", 1, "a.exe", 10, None)), on_alerts=hook)
    with pytest.raises(StreamingQueryException):
        stream.monitor(stream.file_stream(spark, source), loop, once=True).awaitTermination()
    finish(stream.monitor(stream.file_stream(spark, source), loop, once=True))
    store = Commits(spark, out)
    assert told == [["m0"], ["m0"]]
    assert store.last() == 0 and ids(store.read("reports", stream.KEYS)) == ["m0"]


def test_one_bad_message_is_found_and_given_up(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    none = attachments(spark).limit(0)

    def own(batch):
        if not batch.where("message_id = 'm7'").isEmpty():
            raise ValueError("cannot be read")
        return none

    rows = [{"message_id": f"m{i}", "account_email": f"{'ab'[i % 2]}@example.com"} for i in range(20)]
    loop = Loop(out, own, accounts=accounts(spark, b=True), go_on=True, max_attempts=2)
    deliver_mail(spark, source, rows)
    store = Commits(spark, out)
    finish(stream.monitor(stream.file_stream(spark, source), loop, once=True))
    good = sorted(r["message_id"] for r in rows if r["message_id"] != "m7")
    assert ids(store.read("processed", stream.KEYS)) == good
    assert not stream.idle_cycle(spark, loop, spark.read.parquet(source).schema)
    dead = store.read("dead", stream.FAILED).collect()
    assert [(r.message_id, r.attempts, r.error) for r in dead] == [("m7", 2, "ValueError: cannot be read")]
    assert ids(store.read("processed", stream.KEYS)) == good


def test_when_tries_run_out_the_rest_waits_uncounted(spark, tmp_path):
    out = str(tmp_path / "out")

    def own(batch):
        raise ValueError("all is broken")

    rows = emails(spark, *[{"message_id": f"m{i}"} for i in range(30)]).select("*", *box())
    loop = Loop(out, own, accounts=accounts(spark), go_on=True, tries=4)
    stream.run_cycle(rows, loop)
    queue = Commits(spark, out).snapshot("queue", stream.QUEUE).collect()
    assert len(queue) == 30 and all(r.attempts == 0 for r in queue)
    stream.run_cycle(rows, replace(loop, attachments=attachments(spark).limit(0)))
    assert len(ids(Commits(spark, out).read("reports", stream.KEYS))) == 30


def test_every_tenth_cycle_sums_up_all(spark, tmp_path, monkeypatch):
    assert stream.SUMMARY_EVERY == 10
    monkeypatch.setattr(stream, "SUMMARY_EVERY", 3)
    out, sums = str(tmp_path / "out"), []
    own = attachments(spark, *[(f"m{i}", 1, "a.exe", 10, None) for i in range(4)])
    loop = Loop(out, own, on_summary=lambda df, n: sums.append((n, sorted(map(tuple, df.collect())))))
    for i in range(4):
        stream.run_cycle(emails(spark, {"message_id": f"m{i}"}), loop)
    ((cycle, ((kind, _, n),)),) = sums
    assert (cycle, kind, n) == (2, "malware", 3)


def test_alerts_are_tried_three_times(spark, tmp_path):
    cycles, out = Commits(spark, str(tmp_path / "cycles")), Commits(spark, str(tmp_path / "out"))
    seen = []

    def commit(n, *names):
        rows = spark.createDataFrame([("a", "INBOX", m, f"{{{m}}}") for m in names], stream.ALERTS)
        cycles.commit(n, {"alerts": [cycles.write(rows, "alerts")]})

    def channel(due):
        seen.append(ids(due))
        if len(seen) == 1:
            raise ConnectionError("no route")
        ok = (F.col("message_id") != "bad") & ~((F.col("message_id") == "late") & F.lit(len(seen) == 2))
        return due.select("delivery_id", ok.alias("delivered"), F.lit("refused").alias("reason"))

    commit(0, "one", "bad", "late")
    assert deliver(cycles, out, channel, 100.0) == 3
    assert deliver(cycles, out, channel, 100.5) == 0  # all wait for a second
    commit(1, "two")
    assert deliver(cycles, out, channel, 101.0) == 4
    assert deliver(cycles, out, channel, 102.5) == 0  # now for two
    assert deliver(cycles, out, channel, 103.0) == 2
    assert deliver(cycles, out, channel, 200.0) == 0
    assert [s for s in seen if s] == [["bad", "late", "one"], ["bad", "late", "one", "two"], ["bad", "late"]]
    assert {(r.message_id, r.attempts) for r in out.read("sent", SENT).collect()} == {("one", 2), ("two", 1), ("late", 3)}
    assert [(r.message_id, r.attempts, r.reason) for r in out.read("dead", DEAD).collect()] == [("bad", 3, "refused")]
    assert out.snapshot("pending", PENDING).isEmpty()


def test_a_pass_that_dies_is_run_again(spark, tmp_path, monkeypatch):
    cycles, out = Commits(spark, str(tmp_path / "cycles")), Commits(spark, str(tmp_path / "out"))
    rows = spark.createDataFrame([("a", "INBOX", "m", "p")], stream.ALERTS)
    cycles.commit(0, {"alerts": [cycles.write(rows, "alerts")]})
    given = []

    def channel(due):
        given.append([r.delivery_id for r in due.collect()])
        return due.select("delivery_id", F.lit(True).alias("delivered"), F.lit(None).alias("reason"))

    with monkeypatch.context() as patch:
        patch.setattr(Commits, "commit", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            deliver(cycles, out, channel, 1.0)
    deliver(cycles, out, channel, 2.0)
    assert given[0] == given[1]  # the receiver can tell
    assert out.read("sent", SENT).count() == 1


def test_a_cycle_is_committed_once(spark, tmp_path):
    store = Commits(spark, str(tmp_path))
    path = store.write(spark.range(3), "numbers")
    store.write(spark.range(100), "numbers")  # never named
    assert store.last() == -1 and store.read("numbers", "id bigint").isEmpty()
    store.commit(0, {"numbers": [path]}, batch=7)
    assert store.holds(7) and not store.holds(8)
    assert store.read_numbered("numbers", "id bigint").where("cycle = 0").count() == 3
    with pytest.raises(FileExistsError):
        store.commit(0, {})


def test_cycles_run_ahead_are_those_run_one_by_one(spark, tmp_path, monkeypatch):
    rows = [{"message_id": f"m{i}", "subject": "URGENT PRIZE LOTTERY !!!", "body_text": "click here, winner" if i % 3 else ""} for i in range(6)]
    rows += [{"message_id": f"b{i}", "account_email": "b@example.com", "folder": "Junk"} for i in range(3)]
    numbered = emails(spark, *rows).select("*", F.monotonically_increasing_id().alias("seq"), F.lit(10).cast("bigint").alias("size"))
    large = F.when(F.col("message_id") == "m3", F.lit(1 << 40)).otherwise(F.col("size"))
    numbered.withColumn("size", large).coalesce(1).write.parquet(source := str(tmp_path / "in"))
    schema, plans, wrote = spark.read.parquet(source).schema, [], {}
    run, fault = stream._Cycle.run, []

    def counted(cycle, batch):
        plans.append(cycle.ahead)
        if fault and cycle.ahead > 1:
            raise RuntimeError("too much at once")
        run(cycle, batch)

    monkeypatch.setattr(stream._Cycle, "run", counted)
    for how in ("single", "ahead"):
        loop = Loop(str(tmp_path / how), attachments(spark).limit(0), accounts=accounts(spark, b=True), params=Params(max_per_folder=2))
        finish(stream.monitor(stream.file_stream(spark, source), loop, once=True))
        plans.clear()
        if how == "single":
            # what fails ahead is run one by one
            fault.append(True)
            assert stream.idle_cycle(spark, loop, schema, ahead=True)
            assert not stream.idle_cycle(spark, loop, schema)
            assert plans == [stream.AHEAD, 1, 1]
            fault.clear()
        else:
            stream.drain(spark, loop, schema)
            assert plans == [stream.AHEAD]
        store = Commits(spark, loop.out)
        told = {t: store.read_numbered(t, d) for t, d in (("reports", stream.KEYS), ("skipped", stream.SKIPPED), ("alerts", stream.ALERTS), ("threats", stream.THREATS))}
        wrote[how] = {t: sorted(map(tuple, d.collect())) for t, d in told.items()}
        wrote[how]["processed"] = sorted(map(tuple, store.read("processed", stream.KEYS).collect()))
        wrote[how]["totals"] = sorted(map(tuple, store.snapshot("totals", stream.TOTALS).collect()))
        wrote[how]["last"], wrote[how]["left"] = store.last(), store.snapshot("queue", stream.QUEUE).count()
    assert wrote["ahead"] == wrote["single"]
    assert (wrote["ahead"]["last"], wrote["ahead"]["left"], len(wrote["ahead"]["reports"])) == (2, 0, 8)
    assert wrote["ahead"]["alerts"] and wrote["ahead"]["totals"]
