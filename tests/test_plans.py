"""What the plans must look like to hold at a thousand times the data."""

import re

import pytest

from tests.helpers import ATTACHMENT_SCHEMA
from threatloom.operators import archives, attachments, fusion, language, metrics, scans, shaping, spam
from threatloom.params import Params
from threatloom.plans.queries import registry
from threatloom.sources import sample_tables
from threatloom.sources.sample_tables import SampleTables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark):
    return SampleTables(spark, FOLDER)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> int:
    """Shuffles, not counting the one that deals small samples over the cores."""
    return len([x for x in re.findall(r"Exchange (\w+)", text) if x != "RoundRobinPartitioning"])


def test_text_layers_are_narrow(tables):
    scored = language.language_layer(spam.spam_layer(tables.emails()))
    text = plan(scored)
    assert exchanges(text) == 0
    assert "Python" not in text


def test_report_does_not_shuffle_bodies(tables):
    text = plan(fusion.threat_report(tables.emails(), tables.attachments()))
    for line in text.split("\n"):
        if "hashpartitioning(account_email" in line:
            assert "body_text" not in line
    assert "CartesianProduct" not in text
    assert "NestedLoop" not in text


def test_part_cap_is_taken_before_the_shuffle(tables):
    assert "Python" not in plan(attachments.media_scores(tables.attachments()))
    capped = plan(attachments.gather(tables.attachments(), "size", params=Params(max_parts=3)))
    assert "pos" in capped and "<= 3" in capped
    assert "<= " not in plan(attachments.gather(tables.attachments(), "size")).split("ReadSchema")[0]


def test_folder_ranks_are_cut_on_the_map_side(tables):
    assert plan(scans.first_per_folder(tables.mail())).count("WindowGroupLimit") == 2


def test_samples_are_bounded(tables):
    assert "TakeOrderedAndProject" in plan(metrics.bounded_sample(tables.observations()))
    per_key = metrics.bounded_sample(tables.observations(), keys=["event_type"])
    assert plan(per_key).count("WindowGroupLimit") == 2


def test_scans_read_only_what_they_need(tables):
    read = re.findall(r"ReadSchema: (struct<[^\n]*>)", plan(registry()["size_guard"](tables.spark, FOLDER)))
    assert all("text" not in schema or "o_" in schema for schema in read if "n_chars" in schema)
    log = plan(tables.observations().select("event_type"))
    assert "props" not in log


def test_no_query_collects_by_cross_join(spark):
    for name in ("spam_layer", "nlp_layer", "media_layer", "archive_early_stop", "fetch_cycle", "threat_report"):
        text = plan(registry()[name](spark, FOLDER))
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_headers_of_a_message_are_shuffled_once(spark):
    rows = [("m", 3, "received", "b"), ("m", 1, "Received", "a"), ("m", 2, "To", None), (None, 1, "X", "x"), ("m", 2, "RECEIVED", "c")]
    grouped = shaping.header_multimap(spark.createDataFrame(rows, "message_id string, pos int, name string, value string"))
    assert exchanges(plan(grouped)) == 1
    got = {r.message_id: r.headers for r in grouped.collect()}
    assert got == {"m": {"received": ["a", "c", "b"], "to": [None]}, None: {"x": ["x"]}}


@pytest.fixture
def line_items(spark, tmp_path):
    """Line items with null and repeated keys, and seventh lines in shared archives."""
    columns = (
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double,"
        " l_discount double, l_tax double, l_shipdate date, l_returnflag string, l_linestatus string"
    )
    flags = ["A", "R", None]
    rows = [
        (o if o % 9 else None, n if o % 7 else None, o * 11 + n, o + n, float(o % 50) if o % 5 else None, 100.0 * o + n, 0.0, 0.0, None, flags[o % 3], "F")
        for o in range(1, 60)
        for n in range(1, 8)
    ]
    spark.createDataFrame(rows + rows[:30], columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    return SampleTables(spark, str(tmp_path))


def test_members_are_shuffled_once(line_items):
    members = line_items.members()
    assert exchanges(plan(members)) == 1
    stated = line_items.sql(sample_tables.MEMBERS).join(line_items.sql(sample_tables.MEMBER_COUNTS), "container")
    assert members.columns == stated.columns
    assert sorted(map(repr, members.collect())) == sorted(map(repr, stated.collect()))


def test_a_container_without_findings_keeps_one_member(spark):
    rows = [("a", i, 0.0) for i in range(1, 6)] + [("b", i, 5.0 * (i > 2)) for i in range(1, 8)]
    kept = archives.deciding_members(spark.createDataFrame(rows, "container string, member_pos int, member_score double"))
    assert sorted((r.container, r.member_pos) for r in kept.collect()) == [("a", 1), ("b", 3), ("b", 4), ("b", 5)]


def test_attachments_lie_by_message_from_the_start(spark, line_items):
    marked = attachments.with_admission(line_items.attachments())
    assert exchanges(plan(marked)) == 1
    stated = attachments.with_admission(line_items.sql(sample_tables.ATTACHMENTS))
    assert sorted(map(repr, marked.collect())) == sorted(map(repr, stated.collect()))


def test_findings_are_made_behind_the_join_with_archives(spark):
    table = spark.createDataFrame([("a", "f", "m", 1, "a.b.txt", 5, None, False)], ATTACHMENT_SCHEMA)
    scores = spark.createDataFrame([("a", "f", "m", 1, 2.0, ["inside"])], "account_email string, folder string, message_id string, pos int, archive_score double, archive_warnings array<string>")
    checked = attachments.attachment_checks(table, scores)
    below = plan(checked.hint("merge")).split("Join", 1)[1]
    assert "Multiple extensions" not in below
    row = checked.first()
    assert row.meta_score == 3.5 and row.suspicious_attachments == ["inside"]
    assert row.file_type_warnings == ["Multiple extensions detected: a.b.txt"]


def test_findings_are_gathered_where_their_message_lies(spark):
    names = [("m0", 1, "a.zip"), ("m0", 2, "b.zip"), ("m1", 1, "c.zip"), (None, 1, "d.zip")]
    own = spark.createDataFrame([("a@example.com", "INBOX", *r, 10, None, False) for r in names], ATTACHMENT_SCHEMA)
    rows = [("m0", 2, 4.0, ["first"]), ("m0", 2, 1.0, ["again"]), ("m0", 3, 9.0, ["not there"]), (None, 1, 9.0, ["nobody's"]), ("m1", None, 9.0, ["nowhere"])]
    schema = "account_email string, folder string, message_id string, pos int, archive_score double, archive_warnings array<string>"
    inside = spark.createDataFrame([("a@example.com", "INBOX", *r) for r in rows], schema)
    at = [*attachments.MESSAGE_KEY, "pos"]
    wanted = own.join(inside, at, "left").select(*own.columns, "archive_score", "archive_warnings")
    found = attachments.with_archives(own, inside)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
    assert found.count() == 5
    with_lines = attachments.media_scores(own, archives=inside)
    lines = {r.message_id: [x for x in r.media.suspicious_attachments if "zip" not in x] for r in with_lines.collect()}
    assert sorted(lines["m0"]) == ["again", "first"] and not lines["m1"] and not lines[None]
    # attachments once to be walked, once with what was found in them; the findings' texts not at all
    assert sum("Exchange hashpartitioning" in line for line in plan(attachments.media_scores(own, archives=inside)).splitlines()) == 2
