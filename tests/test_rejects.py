"""Dead letters by row, and running metrics."""

from pyspark.sql import functions as F

from threatloom.operators import metrics, rejects
from threatloom.streaming import running
from threatloom.streaming.commits import Commits

GOOD = '{"timestamp": "2024-01-02 03:04:05", "level": "INFO", "line": 3}'
LINES = [
    (1, GOOD, None),
    (2, None, "no line"),
    (3, '{"timestamp": "2024', "not JSON"),
    (4, '{"timestamp": "2024-01-02 03:04:05"}', "no level"),
    (5, '{"level": "INFO"}', "no time"),
    (6, '{"timestamp": "yesterday", "level": "INFO"}', "time does not parse"),
    (7, GOOD.replace("3}", '"x"}'), "line is no number"),
    (8, "", "not JSON"),
]


def test_each_bad_line_has_its_reason(spark):
    lines = spark.createDataFrame([r[:2] for r in LINES], "id int, value string")
    found = {r.key: (r.kind, r.reason, r.payload) for r in rejects.bad_log_lines(lines, "id").collect()}
    assert found == {str(i): ("log", why, line) for i, line, why in LINES if why}


def test_replay_takes_up_what_is_mended(spark):
    lines = spark.createDataFrame([r[:2] for r in LINES], "id int, value string")
    accounts = spark.createDataFrame(
        [("a", True, False), ("b", True, True), ("c", False, False), ("d", True, None)], "account_email string, enabled boolean, connected boolean"
    )
    dates = spark.createDataFrame([("m", "Date", "Sat, 31 Feb 2024 10:00:00 +0000"), ("n", "date", None), ("o", "To", "x")], "message_id string, name string, value string")
    letters = rejects.dead_letters(rejects.bad_log_lines(lines, "id"), rejects.faulty_accounts(accounts), rejects.bad_dates(dates))
    assert {(r.kind, r.key, r.reason) for r in letters.where("kind <> 'log'").collect()} == {
        ("account", "a", "not connected"), ("account", "d", "not connected"), ("date", "m", "date does not parse"), ("date", "n", "no date"),
    }
    mend = lambda p: F.replace(p, F.lit("yesterday"), F.lit("2024-01-01 00:00:00"))
    good, left = rejects.replay(letters, "log", mend, rejects.log_reason)
    assert [r.key for r in good.collect()] == ["6"]
    assert left.count() == letters.count() - 1


def test_state_of_ten_cycles_sums_up_like_all_rows(spark, tmp_path):
    rows = [
        (float(i * 7919 % 501) / 2 if i % 13 else None, ["spam", "phishing", None][i % 3], "low" if i % 2 else "high", "imap" if i % 11 == 0 else None)
        for i in range(1000)
    ]
    table = spark.createDataFrame(rows, "processing_ms double, threat_type string, severity string, error_type string")
    store = Commits(spark, str(tmp_path))
    for n in range(10):
        part = table.where(F.pmod(F.hash("processing_ms", "severity"), F.lit(10)) == n)
        assert running.add_cycle(store, part, n) == n
        assert running.add_cycle(store, part, n) == n  # a batch that comes again adds nothing
    whole, summed = metrics.metrics_summary(table).first().asDict(True), running.summary(store).first().asDict(True)
    means = [r["processing_time_stats"].pop("avg_ms") for r in (whole, summed)]
    assert abs(means[0] - means[1]) < 1e-9
    assert summed == whole


def test_summary_of_nothing(spark, tmp_path):
    store = Commits(spark, str(tmp_path))
    empty = spark.createDataFrame([], "processing_ms double, threat_type string, severity string, error_type string")
    running.add_cycle(store, empty)
    assert running.summary(store).first().emails_processed == 0
