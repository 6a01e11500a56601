"""Raw messages, archives, logs and rule tables."""

import io
import random
import re
import tarfile
import unicodedata
import zipfile
from email.message import EmailMessage
from email.utils import getaddresses

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threatloom.functions import constants as K
from threatloom.functions import text
from threatloom.operators import archives, fusion, language, logs, rules, scans
from threatloom.params import Params
from threatloom.plans import queries
from threatloom.sources import archive_members as listing
from threatloom.sources import eml
from threatloom.sources.sample_tables import SampleTables

RAW = "seq string, account_email string, folder string, raw binary"


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def tarred(entries, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data, link in entries:
            info = tarfile.TarInfo(name)
            if link:
                info.type, info.linkname = tarfile.SYMTYPE, link
            else:
                info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def archive_result(spark, filename, data):
    rows = spark.createDataFrame(
        [("a@b.c", "INBOX", "m", 1, filename, bytearray(data))],
        "account_email string, folder string, message_id string, pos int, filename string, data binary",
    )
    got = archives.archive_scores(listing.archive_members(rows)).collect()
    return (got[0]["archive_score"], got[0]["archive_warnings"]) if got else (0.0, [])


def test_nested_archive_counts_once(spark):
    score, lines = archive_result(spark, "archive.zip", zipped([("backup.tar.gz", b"not a tar")]))
    assert (score, lines) == (2.0, ["Archive archive.zip contains nested archive: backup.tar.gz"])


def test_dangerous_file_three_levels_down(spark):
    inner = zipped([("setup.exe", b"MZ")])
    middle = tarred([("inner.zip", inner, None)])
    score, lines = archive_result(spark, "a.zip", zipped([("m.tar.gz", middle), ("never.exe", b"")]))
    assert score == 2.0 + 2.0 + 5.0
    assert lines[-1] == "Archive a.zip/m.tar.gz/inner.zip contains dangerous file: setup.exe"


def test_tar_links_and_paths(spark):
    assert archive_result(spark, "a.tar", tarred([("ok", b"", "../../x")], "w"))[0] == 5.0
    assert archive_result(spark, "a.tgz", tarred([("/etc/x", b"1", None)]))[0] == 5.0
    assert archive_result(spark, "a.tar", tarred([("ok.txt", b"1", "fine")], "w"))[0] == 0.0


def test_zip_traversal_adds_to_the_member(spark):
    assert archive_result(spark, "a.zip", zipped([("../x.exe", b"")]))[0] == 10.0


def test_oversized_nested_archives(spark):
    declared = zipped([("big.zip", b"\0" * K.MAX_NESTED_BYTES)])
    assert archive_result(spark, "a.zip", declared)[0] == 2.0
    assert archive_result(spark, "broken.zip", b"PK\x03\x04 nothing here")[0] == 0.0


def test_too_many_members(spark):
    many = zipped([(f"f{i}.txt", b"") for i in range(K.MAX_ARCHIVE_MEMBERS + 5)])
    score, lines = archive_result(spark, "a.zip", many)
    assert (score, lines) == (1.0, [f"Archive a.zip contains too many files ({K.MAX_ARCHIVE_MEMBERS + 5})"])


@pytest.mark.parametrize("name", ["inner.zip", "inner.zip?", "inner.zi(p"])
def test_nested_archives_are_opened_by_their_scored_name(spark, name):
    nested = zipped([(name, zipped([("macro.docm", b"")]))])
    assert archive_result(spark, "a.zip", nested)[0] == 5.0


def test_every_nested_archive_is_listed(spark):
    inner = [(f"i{k}.zip", zipped([(f"f{k}.txt", b"x")])) for k in range(5)]
    files = spark.createDataFrame(
        [("a@b.c", "INBOX", "m", 1, "a.zip", bytearray(zipped(inner)))],
        "account_email string, folder string, message_id string, pos int, filename string, data binary",
    )
    assert {r["name"] for r in listing.archive_members(files).collect()} >= {f"f{k}.txt" for k in range(5)}


def test_full_width_extension_is_seen_through(spark):
    assert archive_result(spark, "a.zip", zipped([("x.ｅｘｅ", b"")]))[0] == 5.0


def test_early_stop_equals_a_walk(spark):
    rng = random.Random(5)
    names = ["a.txt", "b.docm", "c.rar", "d.exe", "../e.txt", "f.txt", "g.html"]
    rows, wanted = [], {}
    for i in range(60):
        listed = [rng.choice(names) for _ in range(rng.randint(1, 12))]
        total = 0.0
        for name in listed:
            points = {"b.docm": 3.0, "c.rar": 2.0, "d.exe": 5.0, "../e.txt": 5.0, "g.html": 3.0}.get(name, 0.0)
            total += points
            if total >= K.STOP_SCORE:
                break
        wanted[f"m{i}"] = total
        rows += [
            ("a@b.c", "INBOX", f"m{i}", 1, f"m{i}", "x.zip", 0, "zip", len(listed), k, n, n.split("/")[-1], 1, None, None)
            for k, n in enumerate(listed, start=1)
        ]
    schema = (
        "account_email string, folder string, message_id string, pos int, container string, container_name string, depth int, kind string,"
        " member_count long, member_pos int, name string, safe_name string, size long, linkname string, nested string"
    )
    got = archives.archive_scores(spark.createDataFrame(rows, schema)).collect()
    assert {r.message_id: r.archive_score for r in got} == wanted


def test_eml_shaping(spark):
    m = EmailMessage()
    m["From"] = "Zoë <zoe@example.com>, plain@example.com"
    m["To"] = "team@example.com"
    m["Subject"] = "Grüße " + "x" * 2000
    m["Date"] = "Mon, 1 Jan 2024 10:00:00 +0100"
    m["Received"] = "one"
    m["received"] = "two"
    m.set_content("hello body")
    m.add_alternative("<p>hello</p>", subtype="html")
    m.add_attachment(b"MZ" + b"0" * 60, maintype="application", subtype="pdf", filename="../x y.exe")
    m.add_attachment(b"1" * 50, maintype="image", subtype="png", filename="")
    m.add_attachment(b"2" * 30, maintype="text", subtype="csv", filename="CON")
    rows = [("1", "a@b.c", "INBOX", bytearray(m.as_bytes())), ("2", "a@b.c", "INBOX", None)]
    params = Params(max_total_attachment_bytes=100, max_attachment_bytes=40, max_body_chars=5, max_subject_chars=1024)
    shaped = eml.shape_messages(
        eml.decode_messages(spark.createDataFrame(rows, RAW)), F.timestamp_seconds(F.lit(7)), params
    )
    good, bad = eml.split_rejects(shaped)
    row = good.first()
    assert row.message_id == "1"
    assert row.sender == "Zoë <zoe@example.com>, plain@example.com"
    assert len(row.subject) == K.MAX_SUBJECT_CHARS
    assert row.subject.startswith("Grüße")
    assert (row.body_text, row.body_html) == ("hello", "<p>he")
    assert row.headers["received"] == ["one", "two"]
    assert row.date.timestamp() == 1704099600
    assert [(a.filename, a.size, a.truncated, len(a.data)) for a in row.attachments] == [
        ("x y.exe", 62, True, 40),
        ("_CON", 30, False, 30),
    ]
    assert bad.first()["_corrupt"] == "ValueError: no message bytes"
    assert eml.attachment_rows(good).count() == 2


def test_eml_files_over_the_limit_are_not_read(spark, tmp_path):
    folder = tmp_path / "INBOX"
    folder.mkdir()
    (folder / "a.eml").write_bytes(b"Subject: hi\n\nbody")
    (folder / "b.eml").write_bytes(b"Subject: big\n\n" + b"x" * (K.MESSAGE_OVERHEAD_BYTES + 10))
    (folder / "c.txt").write_bytes(b"no")

    def names(params):
        return sorted((r.seq, r.folder) for r in eml.read_eml_files(spark, str(tmp_path), params).collect())

    assert names(Params(max_total_attachment_bytes=1)) == [("a.eml", "INBOX")]
    assert names(Params(max_total_attachment_bytes=0)) == [("a.eml", "INBOX"), ("b.eml", "INBOX")]


def test_log_round_trip(spark):
    lines = [
        '{"timestamp": "2024-02-15 10:30:45", "level": "INFO", "message": "m", "line": 3, "api_key": "k", "n": {"a": 1}}',
        "{broken",
    ]
    parsed = logs.parse_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    good = parsed.filter(F.col("_corrupt").isNull()).select("*", logs.to_log_line(parsed).alias("out")).first()
    assert good.extras == {"api_key": "k", "n": '{"a":1}'}
    assert '"api_key":"[REDACTED]"' in good.out
    assert parsed.filter(F.col("_corrupt").isNotNull()).first()["_corrupt"] == "{broken"


def test_rule_table(spark):
    schema = "category string, pattern string, description string, position long"
    good = spark.createDataFrame([("UG", r"\bhurry\s+up\b", "Hurry", 1)], schema)
    extended = rules.load_rules(good)
    mail = spark.createDataFrame([("", "hurry up, urgent")], "subject string, body_text string")
    found = language.pattern_scan(mail, extended).first()["matches"]
    assert [(m.category, m.description) for m in found] == [("UG", "Hurry"), ("UG", "Urgency keyword")]
    with pytest.raises(ValueError, match="backtrack"):
        rules.load_rules(spark.createDataFrame([("UG", r"x(\w+)*y", "bad", 1)], schema))
    with pytest.raises(ValueError, match="category"):
        rules.load_rules(spark.createDataFrame([("ZZ", "x", "bad", 1)], schema))


def test_fetch_takes_the_limit_before_the_size_check(spark):
    box = "account_email string, folder string, message_id string, seq long, size long, body_text string"
    rows = [("a", "INBOX", f"m{i}", i, 10**10 if i == 0 else 5, "b") for i in range(5)]
    messages = spark.createDataFrame(rows, box)
    seen = spark.createDataFrame([("a", "INBOX", "m1")], "account_email string, folder string, message_id string")
    accounts = spark.createDataFrame([("a", True, True)], "account_email string, enabled boolean, connected boolean")
    got = scans.fetch(messages, seen, accounts, Params(max_per_folder=2))
    assert [r.message_id for r in got.collect()] == ["m2"]


def test_raw_bytes_to_report(spark):
    m = EmailMessage()
    m["From"] = "PayPal <service@evil.example>"
    m["To"] = "team@example.com"
    m["Subject"] = "URGENT: verify your account"
    m["Message-ID"] = "<1@evil.example>"
    m["Date"] = "Mon, 1 Jan 2024 10:00:00 +0000"
    m.set_content("your paypal access is blocked, act now: http://bit.ly/x")
    m.add_attachment(zipped([("setup.exe", b"MZ")]), maintype="application", subtype="zip", filename="docs.zip")
    rows = [("1", "a@b.c", "INBOX", bytearray(m.as_bytes()))]
    decoded = eml.decode_messages(spark.createDataFrame(rows, RAW))
    mail, _ = eml.split_rejects(eml.shape_messages(decoded, F.timestamp_seconds(F.lit(0))))
    files = eml.attachment_rows(mail)
    scores = archives.archive_scores(listing.archive_members(files))
    report = fusion.threat_report(mail, files, archives=scores).first()
    assert report.message_id == "<1@evil.example>"
    assert report.media.suspicious_attachments == ["Archive docs.zip contains dangerous file: setup.exe"]
    assert (report.media.score, report.media.risk_level, report.risk_level) == (5.0, "high", "high")
    assert report.nlp.authority_impersonation == ["Authority entity mention (domain mismatch)"]
    assert report.spam.suspicious_urls == ["http://bit.ly/x"]
    assert "Missing DKIM signature" in report.spam.header_issues


def test_characters_left_out_of_normalisation_are_stable():
    kept = re.compile(f"[{text._STABLE}]")
    for code in range(0x110000):
        ch = chr(code)
        if kept.match(ch):
            assert unicodedata.normalize("NFKC", ch) == ch
            assert unicodedata.combining(ch) == 0


def test_messages_are_decoded_and_archives_listed_in_bounded_batches():
    """One large batch in, several out; rows and the values in them are all there."""
    raw = b"Subject: s\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nbody"
    n = eml._FLUSH_ROWS + 10
    columns = {"seq": [str(i) for i in range(n)], "account_email": ["a"] * n, "folder": ["f"] * n, "raw": [raw if i % 2 else None for i in range(n)]}
    out = list(eml._decode_batches([pa.RecordBatch.from_pydict(columns)]))
    assert [b.num_rows for b in out] == [eml._FLUSH_ROWS, 10]
    assert [r["seq"] for b in out for r in b.to_pylist()] == columns["seq"]
    assert {r["_corrupt"] for r in out[1].to_pylist()} == {None, "ValueError: no message bytes"}

    data = zipped([(f"f{i}.txt", b"x") for i in range(100)])
    box = {"account_email": ["a"] * 50, "folder": ["f"] * 50, "message_id": [str(i) for i in range(50)], "pos": [1] * 50, "filename": ["a.zip"] * 50}
    batch = pa.RecordBatch.from_pydict({**box, "data": [data] * 50, "as_zip": [True] * 50, "as_tar": [False] * 50})
    listed = list(listing._list_batches([batch]))
    assert [b.num_rows for b in listed] == [2000, 2000, 1000]
    assert len({(r["message_id"], r["name"]) for b in listed for r in b.to_pylist()}) == 5000


_EDGES = [b"\r\n", b"\n", b"\r", b"--sep", b"--sep--", b"\r\n--sep\r\n", b"\r\n\r\n", b" ", b"\t", b":", b"X: y\r\n", b"From x\r\n", b"\xc3\xa9", b"=?utf-8?q?a?="]
_EDGES += [b"Content-Type: multipart/mixed; boundary=sep\r\n", b"Content-Type: message/rfc822\r\n", b"Content-Transfer-Encoding: quoted-printable\r\n"]


def test_messages_told_without_a_parser_are_as_the_parser_tells_them(monkeypatch):
    lines = [b'From: A B <a.b@c.example>', b"To: x@y.z, q@r", b"Subject: =?utf-8?b?w6k=?=", b'Content-Type: multipart/mixed; boundary="sep"', b""]
    lines += [b"--sep", b"Content-Type: text/plain; charset=latin-1", b"", b"caf\xe9 --sepal", b"--sep", b"Content-Type: text/html", b"", b"", b"--sep"]
    lines += [b'Content-Type: application/pdf; name="a.pdf"', b"Content-Transfer-Encoding: base64", b"", b"QUJD", b"--sep--", b""]
    plain = b"\r\n".join(lines).replace(b" --sepal", b"")
    cases = [plain, b"\r\n".join(lines), b"Subject: one part\r\n\r\nbody\n", b"Subject: cut", b"", plain.replace(b"--sep--", b"")]
    cases += [plain[:at] + edge + plain[at:] for edge in _EDGES for at in range(0, len(plain), 5)]
    cases += [plain[:at] + plain[at + n :] for n in (1, 2, 9) for at in range(0, len(plain), 2)]
    quick = [eml._decoded({"seq": "s", "account_email": "", "folder": "", "raw": raw}) for raw in cases]
    assert eml._plainly_built(plain) and not eml._plainly_built(cases[1])
    monkeypatch.setattr(eml, "_plainly_built", lambda raw: None)
    parsed = [eml._decoded({"seq": "s", "account_email": "", "folder": "", "raw": raw}) for raw in cases]
    assert quick == parsed


def test_plain_addresses_are_read_as_by_the_parser():
    values = ["a@b", "a.b@c.d", "A B <a@b.c>", "a..b@c", "A  B <a@b>", "a@b, c@d", "A.B <a@b>", "a b@c", ".a@b", "a@b.", "A <a@b> x", "_a+b-c@d-e"]
    for value in values:
        assert eml._pairs(value) == getaddresses([value]), value


def test_zips_are_made_in_bounded_batches():
    texts = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": ["x" * 400_000] * 40})
    out = list(queries._zip_up([texts]))
    assert sum(b.num_rows for b in out) == 40
    assert max(b.nbytes for b in out) < queries._ZIP_BYTES + 2_000_000


def test_messages_are_dealt_over_all_tasks(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for name, schema in {
        "pages": "page_id bigint, html string", "conversations": "conv_id bigint, turn int, role string, text string",
        "orders": "o_orderkey bigint, o_orderstatus string, o_orderpriority string, o_totalprice double",
    }.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    tables = SampleTables(spark, str(tmp_path))
    dealt = tables.mail(dealt=True)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(sizes) < 120
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, tables.mail().collect()))
