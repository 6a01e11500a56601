"""One query per operator, over the whole sample tables.

Results are flat (lists joined with `` | ``, scores rounded to four digits) so
that an independent SQL engine can be asked the same question.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from threatloom.functions import identity, risk, text, urls
from threatloom.functions import constants as K
from threatloom.operators import (
    archives,
    attachments,
    fusion,
    language,
    log_store,
    logs,
    metrics,
    payloads,
    rejects,
    rule_index,
    rules,
    scans,
    shaping,
    spam,
)
from threatloom.operators.scans import MAILBOX_KEY
from threatloom.params import DEFAULTS
from threatloom.session import shared_folder, stored
from threatloom.sources import archive_members as listing
from threatloom.sources import eml
from threatloom.sources.sample_tables import SampleTables
from threatloom.streaming import monitor as stream
from threatloom.streaming import running
from threatloom.streaming.commits import Commits
from threatloom.streaming.outbox import DEAD, SENT, deliver

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(build: Callable[[SampleTables], DataFrame]) -> Callable[[SampleTables], DataFrame]:
    """Register a query under its function's name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(SampleTables(spark, folder))

    _REGISTRY[build.__name__] = run
    return build


def registry() -> dict[str, Query]:
    """All queries by name."""
    return dict(_REGISTRY)


def joined(items: Column | str) -> Column:
    """List as one text."""
    return F.array_join(items, " | ")


def rounded(score: Column | str) -> Column:
    """Score to four digits."""
    return F.round(score, 4)


def _one(df: DataFrame, part: str, *keys: str) -> DataFrame:
    """(keys, score, findings) of one check."""
    keys = keys or ("message_id",)
    found = f"{part}_issues" if f"{part}_issues" in df.columns else f"{part}_indicators"
    return df.select(*keys, rounded(f"{part}_score").alias("score"), joined(found).alias("findings"))


# --- scans --------------------------------------------------------------------


@query
def scan_unseen(t: SampleTables) -> DataFrame:
    return scans.unseen(t.mail(), t.processed()).select("account_email", "folder", "message_id")


@query
def folder_topn(t: SampleTables) -> DataFrame:
    params = replace(DEFAULTS, max_per_folder=5)
    kept = scans.first_per_folder(t.mail().select("account_email", "folder", "seq", "message_id"), params)
    return kept.select("account_email", "folder", "message_id", F.col("rank").cast("bigint").alias("rank"))


@query
def size_guard(t: SampleTables) -> DataFrame:
    return scans.within_size(t.mail()).select("message_id", "size")


@query
def active_accounts_union(t: SampleTables) -> DataFrame:
    return scans.of_active_accounts(t.mail(), t.accounts()).select("account_email", "folder", "message_id")


@query
def fetch_cycle(t: SampleTables) -> DataFrame:
    fetched = scans.fetch(t.mail(), t.processed(), t.accounts())
    return fetched.select("account_email", "folder", "message_id", "size")


# --- shaping ------------------------------------------------------------------


def _raw_messages(t: SampleTables) -> DataFrame:
    """Message bytes put together from the mail table, one message a row."""
    m = F.col
    crlf = "\r\n"
    parts = F.concat(
        F.lit("--sep" + crlf + "Content-Type: text/plain; charset=utf-8" + crlf + crlf),
        m("body_text"),
        F.lit(crlf + "--sep" + crlf + "Content-Type: text/html; charset=utf-8" + crlf + crlf),
        m("body_html"),
        F.lit(crlf + "--sep" + crlf + 'Content-Type: application/pdf; name="../a b.pdf"' + crlf),
        F.lit("Content-Disposition: attachment" + crlf + "Content-Transfer-Encoding: base64" + crlf + crlf),
        F.base64(F.encode(m("message_id"), "utf-8")),
        F.lit(crlf + "--sep--" + crlf),
    )
    head = F.concat(
        F.lit("From: "),
        m("recipient"),
        F.lit(crlf + "To: Team <team@corp.example>" + crlf + "Message-ID: "),
        m("message_id"),
        F.lit(crlf + "Subject: =?utf-8?b?"),
        F.replace(F.base64(F.encode(m("subject"), "utf-8")), F.lit(crlf), F.lit("")),
        F.lit("?=" + crlf + "Date: Mon, 1 Jan 2024 10:00:00 +0000" + crlf),
        F.lit("Received: a" + crlf + "received: b" + crlf),
        F.lit("MIME-Version: 1.0" + crlf + 'Content-Type: multipart/mixed; boundary="sep"' + crlf + crlf),
    )
    raw = F.encode(F.concat(head, parts), "utf-8")
    # one mailbox in five has lost the bytes of its messages
    lost = F.col("seq") % 5 == 4
    return t.mail(dealt=True).select(
        F.col("message_id").alias("seq"), "account_email", "folder", F.when(~lost, raw).alias("raw")
    )


def _shaped(t: SampleTables) -> DataFrame:
    return eml.shape_messages(eml.decode_messages(_raw_messages(t)), F.timestamp_seconds(F.lit(0)))


@query
def eml_ingest(t: SampleTables) -> DataFrame:
    good, _ = eml.split_rejects(_shaped(t))
    first = F.get("attachments", F.lit(0))
    return good.select(
        "message_id",
        "subject",
        "sender",
        "recipient",
        F.unix_timestamp("date").alias("sent"),
        F.length("body_text").cast("bigint").alias("text_chars"),
        F.md5("body_html").alias("html_key"),
        joined(F.element_at("headers", F.lit("received"))).alias("received"),
        F.size("attachments").cast("bigint").alias("n_attachments"),
        first["filename"].alias("filename"),
        first["size"].alias("size"),
        first["head"].cast("string").alias("head"),
    )


@query
def rejects_split(t: SampleTables) -> DataFrame:
    _, bad = eml.split_rejects(_shaped(t))
    return bad.select("message_id", "account_email", "folder", F.col("_corrupt").alias("reason"))


@query
def header_multimap(t: SampleTables) -> DataFrame:
    grouped = shaping.header_multimap(t.headers())
    flat = F.transform(
        F.array_sort(F.map_entries("headers")),
        lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")),
    )
    return grouped.select("message_id", joined(flat).alias("headers"))


@query
def subject_cap(t: SampleTables) -> DataFrame:
    # documents as over-long subjects
    docs = t.source("documents")
    return docs.select("doc_id", shaping.cap_subject(F.col("text"), replace(DEFAULTS, max_subject_chars=K.MAX_SUBJECT_CHARS)).alias("subject"))


@query
def address_format(t: SampleTables) -> DataFrame:
    c = t.source("customer")

    def pair(name: Column, addr: Column) -> Column:
        return F.struct(name.alias("name"), addr.alias("addr"))

    named = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_name"))
    addr = F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(
        F.concat(F.lower("c_mktsegment"), F.lit("@example.com"))
    )
    people = F.array(pair(named, addr), pair(F.lit(""), F.lit("cc@example.com")))
    return c.select("c_custkey", identity.format_addresses(people).alias("recipient"))


@query
def date_fallback(t: SampleTables) -> DataFrame:
    dates = t.headers().filter(F.lower("name") == "date")
    when = shaping.parse_date(F.col("value"), F.timestamp_seconds(F.lit(0)))
    return dates.select("message_id", F.unix_timestamp(when).alias("sent"))


@query
def mime_part_cap(t: SampleTables) -> DataFrame:
    kept = shaping.cap_parts(t.parts(), replace(DEFAULTS, max_parts=K.MAX_MIME_PARTS))
    return kept.groupBy("message_id").agg(F.count("*").alias("parts"), F.sum("size").alias("size"))


_PART_COLUMNS = ("content_type", "disposition", "filename", "is_multipart")


@query
def part_classify(t: SampleTables) -> DataFrame:
    kind = shaping.part_kind(*(F.col(c) for c in _PART_COLUMNS))
    return t.parts().select("message_id", F.col("pos").cast("bigint").alias("pos"), kind.alias("kind"))


@query
def body_assemble(t: SampleTables) -> DataFrame:
    return shaping.assemble_bodies(t.parts())


@query
def attachment_budget(t: SampleTables) -> DataFrame:
    params = replace(DEFAULTS, max_attachment_count=4, max_total_attachment_bytes=60 * K.MIB)
    admitted = attachments.admitted_attachments(t.attachments(), params)
    return admitted.select("message_id", F.array_join(F.col("admitted").cast("array<string>"), ",").alias("admitted"))


@query
def attachment_truncate(t: SampleTables) -> DataFrame:
    size = F.col("size")
    return t.attachments().select(
        "message_id",
        F.col("pos").cast("bigint").alias("pos"),
        "size",
        attachments.scanned_bytes(size).alias("scanned"),
        attachments.truncation(size).alias("truncated"),
    )


@query
def filename_sanitize(t: SampleTables) -> DataFrame:
    named = t.member_names().union(t.source("pages").select("url"))
    longer = named.union(t.source("documents").select("text")).union(t.attachments().select("filename"))
    return longer.select("name", identity.sanitize_filename(F.col("name")).alias("safe_name"))


@query
def filename_fallback(t: SampleTables) -> DataFrame:
    p = t.parts()
    name = identity.fallback_filename(F.col("filename"), F.col("content_type"), F.col("message_id"), F.col("pos"))
    return p.select("message_id", F.col("pos").cast("bigint").alias("pos"), name.alias("filename"))


# --- layer 1 ------------------------------------------------------------------


@query
def subject_features(t: SampleTables) -> DataFrame:
    subject = F.col("subject")
    return t.mail().select(
        "message_id",
        spam.is_shouting(subject).alias("all_caps"),
        (text.count_of(subject, "!") > 2).alias("many_exclamations"),
        spam.mentions_money(F.lower(subject)).alias("money"),
    )


@query
def subject_keyword_groups(t: SampleTables) -> DataFrame:
    checked = spam.subject_checks(t.mail())
    return checked.select(
        "message_id", rounded("subject_score").alias("score"), joined("subject_indicators").alias("findings")
    )


def _bodies(t: SampleTables) -> DataFrame:
    return spam.with_lowered_bodies(t.mail())


@query
def body_keyword_count(t: SampleTables) -> DataFrame:
    n = spam.keyword_count(F.col("text_lower")) + spam.keyword_count(F.col("html_lower"))
    return _bodies(t).select("message_id", n.alias("matches"), (n * 0.5).alias("score"))


@query
def url_extract(t: SampleTables) -> DataFrame:
    return spam.with_urls(_bodies(t)).select("message_id", joined("urls").alias("urls"))


@query
def link_count(t: SampleTables) -> DataFrame:
    links = F.size("urls").cast("bigint")
    return spam.with_urls(_bodies(t)).select(
        "message_id", links.alias("links"), (links > K.EXCESSIVE_LINKS).alias("excessive")
    )


@query
def image_heavy(t: SampleTables) -> DataFrame:
    heavy = spam.is_image_heavy(F.col("text_lower"), F.col("html_lower"))
    return _bodies(t).select("message_id", heavy.alias("image_heavy"))


@query
def hidden_text(t: SampleTables) -> DataFrame:
    return _bodies(t).select("message_id", spam.has_hidden_text(F.col("html_lower")).alias("hidden_text"))


@query
def url_reputation(t: SampleTables) -> DataFrame:
    checked = spam.url_checks(spam.with_urls(_bodies(t)))
    return checked.select("message_id", rounded("url_score").alias("score"), joined("suspicious_urls").alias("urls"))


@query
def spf_check(t: SampleTables) -> DataFrame:
    return _one(spam.spf_checks(t.emails()), "spf")


@query
def auth_results(t: SampleTables) -> DataFrame:
    return _one(spam.auth_checks(spam.spf_checks(t.emails())), "auth")


@query
def dkim_presence(t: SampleTables) -> DataFrame:
    return _one(spam.dkim_checks(t.emails()), "dkim")


@query
def missing_headers(t: SampleTables) -> DataFrame:
    return _one(spam.missing_header_checks(t.emails()), "missing")


@query
def hop_count(t: SampleTables) -> DataFrame:
    return spam.hop_checks(t.emails()).select("message_id", "hops", rounded("hop_score").alias("score"))


@query
def forged_sender(t: SampleTables) -> DataFrame:
    return _one(spam.forged_sender_checks(t.emails()), "forged")


@query
def freemail_title(t: SampleTables) -> DataFrame:
    flag = spam.is_titled_freemail(F.lower("sender"))
    return t.mail().select("message_id", flag.alias("titled_freemail"))


@query
def display_name_check(t: SampleTables) -> DataFrame:
    flag = spam.has_odd_display_name(F.lower("sender"))
    return t.mail().select("message_id", flag.alias("odd_display_name"))


@query
def header_layer(t: SampleTables) -> DataFrame:
    return _one(spam.header_checks(t.emails()), "header")


def _spam_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "message_id",
        rounded("spam.score").alias("score"),
        F.col("spam.risk_level").alias("risk_level"),
        joined("spam.indicators").alias("indicators"),
        joined("spam.suspicious_urls").alias("suspicious_urls"),
        joined("spam.header_issues").alias("header_issues"),
    )


@query
def spam_layer(t: SampleTables) -> DataFrame:
    return _spam_columns(spam.spam_layer(t.emails()))


@query
def spam_layer_toggles(t: SampleTables) -> DataFrame:
    params = replace(DEFAULTS, check_urls=False, check_headers=False, spam_threshold=2.0)
    return _spam_columns(spam.spam_layer(t.emails(), params))


# --- layer 2 ------------------------------------------------------------------


@query
def nlp_pattern_scan(t: SampleTables) -> DataFrame:
    found = language.pattern_scan(t.mail()).select("message_id", F.explode("matches").alias("m"))
    return found.groupBy("message_id", F.col("m.category").alias("category"), F.col("m.description").alias("description")).agg(
        F.count("*").alias("n")
    )


@query
def nlp_counters(t: SampleTables) -> DataFrame:
    return language.counters(t.mail()).select("message_id", "exclamations", "caps_words")


def _scanned(t: SampleTables) -> DataFrame:
    return language.counters(language.pattern_scan(t.mail()))


@query
def nlp_social(t: SampleTables) -> DataFrame:
    return _one(language.social_checks(_scanned(t)), "social")


@query
def nlp_urgency(t: SampleTables) -> DataFrame:
    return _one(language.urgency_checks(_scanned(t)), "urgency")


@query
def nlp_authority(t: SampleTables) -> DataFrame:
    return _one(language.authority_checks(_scanned(t)), "authority")


@query
def nlp_psych(t: SampleTables) -> DataFrame:
    return _one(language.psychological_checks(_scanned(t)), "psych")


def _nlp_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "message_id",
        rounded("nlp.score").alias("score"),
        F.col("nlp.risk_level").alias("risk_level"),
        joined("nlp.social_engineering_indicators").alias("social"),
        joined("nlp.urgency_markers").alias("urgency"),
        joined("nlp.authority_impersonation").alias("authority"),
        joined("nlp.psychological_triggers").alias("psychological"),
    )


@query
def nlp_layer(t: SampleTables) -> DataFrame:
    return _nlp_columns(language.language_layer(t.mail()))


@query
def nlp_layer_toggles(t: SampleTables) -> DataFrame:
    params = replace(DEFAULTS, check_psychological=True, check_urgency=False, nlp_threshold=0.3)
    return _nlp_columns(language.language_layer(t.mail(), params))


@query
def custom_rules(t: SampleTables) -> DataFrame:
    # every rule of the table that the audit accepts
    safe = rules.audit(t.rules()).filter("accepted").drop("accepted", "unsafe_form")
    found = rule_index.scan_with_rules(t.sql(_PART_MAIL), safe, ["message_id"])
    return found.select("message_id", F.explode("matches").alias("m")).groupBy(
        F.col("m.category").alias("category"), F.col("m.description").alias("description")
    ).agg(F.count("*").alias("n"))


_PART_MAIL = "SELECT CAST(p_partkey AS STRING) AS message_id, p_name AS subject, p_type AS body_text FROM @part@"


@query
def model_text(t: SampleTables) -> DataFrame:
    prepared = language.model_text(F.col("subject"), F.col("body_text"))
    return t.mail().select("message_id", F.md5(prepared).alias("text_key"), F.length(prepared).cast("bigint").alias("chars"))


def _share_of_vowels(prepared: Column) -> Column:
    """Stand-in classifier made of built-ins: a probability from the text itself."""
    return F.round(F.regexp_count(prepared, F.lit("[aeiou]")) / F.length(prepared), 6)


@query
def text_hash_dedup(t: SampleTables) -> DataFrame:
    scored = language.score_distinct_texts(t.mail(), _share_of_vowels)
    return scored.select("message_id", "text_key", "probability")


@F.pandas_udf(T.DoubleType())
def _letter_share(prepared: pd.Series) -> pd.Series:
    """Stand-in for a text model: a batch of texts in, a probability each out."""
    share = prepared.str.count(r"[a-s]") / prepared.str.len().clip(lower=1)
    return (share * 100).floordiv(1) / 100


@query
def model_score_map(t: SampleTables) -> DataFrame:
    scored = language.score_distinct_texts(t.mail(), _letter_share)
    p = F.col("probability")
    return scored.select(
        "message_id", p.alias("probability"), rounded(language.model_score(p)).alias("score"),
        language.model_indicator(p).alias("indicator"),
    )


# --- layer 3 ------------------------------------------------------------------


def _att_keys() -> list[Column]:
    return [F.col("message_id"), F.col("pos").cast("bigint").alias("pos")]


@query
def attachment_extension(t: SampleTables) -> DataFrame:
    return attachments.extension_checks(t.attachments()).select(
        *_att_keys(), rounded("ext_score").alias("score"), joined("ext_warnings").alias("findings")
    )


@query
def magic_type(t: SampleTables) -> DataFrame:
    return t.attachments().select(*_att_keys(), attachments.magic_type("head").alias("detected_type"))


@query
def type_mismatch(t: SampleTables) -> DataFrame:
    checked = attachments.mismatch_checks(t.attachments()).filter(F.col("detected_type").isNotNull())
    return checked.select(*_att_keys(), "detected_type", rounded("type_score").alias("score"), F.col("type_issue").alias("finding"))


@query
def missing_signature(t: SampleTables) -> DataFrame:
    checked = attachments.mismatch_checks(t.attachments()).filter(F.col("detected_type").isNull())
    return checked.select(*_att_keys(), rounded("type_score").alias("score"), F.col("type_issue").alias("finding"))


@query
def size_anomaly(t: SampleTables) -> DataFrame:
    checked = attachments.size_checks(t.attachments())
    return checked.select(*_att_keys(), rounded("size_score").alias("score"), F.col("size_issue").alias("finding"))


@query
def attachment_metadata(t: SampleTables) -> DataFrame:
    checked = attachments.attachment_checks(t.attachments(), _archive_scores(t))
    return checked.select(
        *_att_keys(),
        rounded("meta_score").alias("score"),
        joined("suspicious_attachments").alias("suspicious_attachments"),
        joined("file_type_warnings").alias("file_type_warnings"),
        joined("size_anomalies").alias("size_anomalies"),
    )


@query
def media_gated_fold(t: SampleTables) -> DataFrame:
    scores = attachments.media_scores(t.attachments(), archives=_archive_scores(t))
    return scores.select("message_id", joined("media.potential_deepfakes").alias("flagged"))


def _media_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "message_id",
        rounded("media.score").alias("score"),
        F.col("media.risk_level").alias("risk_level"),
        joined("media.suspicious_attachments").alias("suspicious_attachments"),
        joined("media.file_type_warnings").alias("file_type_warnings"),
        joined("media.size_anomalies").alias("size_anomalies"),
    )


@query
def media_layer(t: SampleTables) -> DataFrame:
    mail = t.mail().select(*MAILBOX_KEY)
    return _media_columns(attachments.media_layer(mail, t.attachments(), archives=_archive_scores(t)))


@query
def media_layer_off(t: SampleTables) -> DataFrame:
    params = replace(DEFAULTS, check_attachments=False)
    return _media_columns(attachments.media_layer(t.mail().select(*MAILBOX_KEY), t.attachments(), params))


@query
def media_by_mailbox(t: SampleTables) -> DataFrame:
    # mail servers number each mailbox from one: the same ids in a hundred accounts
    numbered = F.floor(F.col("n") / 100).cast("bigint").cast("string")
    mail = t.sql(_ORDER_MAIL).withColumn("message_id", numbered)
    own = t.attachments().withColumn("n", F.expr("CAST(substr(message_id, 2) AS BIGINT)")).withColumn("message_id", numbered).drop("n")
    params = replace(DEFAULTS, max_attachment_count=1_000_000, max_total_attachment_bytes=0)
    scored = attachments.media_layer(mail.select(*MAILBOX_KEY), own, params)
    return scored.select(
        *MAILBOX_KEY,
        F.size("media.file_type_warnings").cast("bigint").alias("warnings"),
        F.size("media.size_anomalies").cast("bigint").alias("anomalies"),
        F.md5(joined("media.file_type_warnings")).alias("warnings_key"),
    )


_ORDER_MAIL = """
SELECT 'shop' || CAST(1 + o_orderkey % 100 AS STRING) || '@mail.example' AS account_email,
       CASE o_orderkey % 4 WHEN 0 THEN 'INBOX' WHEN 1 THEN 'Junk' WHEN 2 THEN 'Archive' ELSE 'Sent' END AS folder,
       o_orderkey AS n
FROM @orders@
"""


@query
def path_traversal(t: SampleTables) -> DataFrame:
    named = t.member_names().union(t.source("documents").select("text"))
    return named.select("name", identity.path_traversal(F.col("name")).alias("escapes"))


def _safe_members(t: SampleTables) -> DataFrame:
    return t.members().withColumn("safe_name", identity.sanitize_filename(F.col("name")))


@query
def archive_member_score(t: SampleTables) -> DataFrame:
    # nested archives are scored first, for what they add to the members above
    members = stored(_safe_members(t), "members")
    below = archives.score_members(members.filter("depth = 1"))
    above = archives.score_members(members.filter("depth = 0"), archives.container_totals(below))
    return below.unionByName(above).select(
        "container",
        F.col("member_pos").cast("bigint").alias("member_pos"),
        rounded("member_score").alias("score"),
        joined("member_warnings").alias("findings"),
    )


def _archive_scores(t: SampleTables, messages: DataFrame | None = None) -> DataFrame:
    """Scores of the sample's archives, which are nested once; of those in ``messages`` only, if given."""
    members = t.members() if messages is None else t.members().join(messages, "message_id", "left_semi")
    return archives.archive_scores(members.withColumn("safe_name", identity.sanitize_filename(F.col("name"))), deepest=1)


@query
def archive_early_stop(t: SampleTables) -> DataFrame:
    return _archive_scores(t).select(
        "message_id", rounded("archive_score").alias("score"), joined("archive_warnings").alias("findings")
    )


_ZIP_SCHEMA = T.StructType(
    [
        *[T.StructField(k, T.StringType()) for k in MAILBOX_KEY],
        T.StructField("pos", T.IntegerType()),
        T.StructField("filename", T.StringType()),
        T.StructField("data", T.BinaryType()),
    ]
)


# zipped bytes handed on at a time, whatever the batch
_ZIP_BYTES = 4 * K.MIB


def _zip_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Zip each text, with a nested zip and a few telling names by document number."""

    def zipped(entries: dict[str, bytes]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in entries.items():
                z.writestr(name, data)
        return out.getvalue()

    schema = to_arrow_schema(_ZIP_SCHEMA)
    rows, held = [], 0
    for batch in batches:
        for at in range(batch.num_rows):
            doc_id, body = batch.column("doc_id")[at].as_py(), batch.column("text")[at].as_py()
            entries = {"readme.txt": body.encode()}
            if doc_id % 2 == 0:
                entries["inner.zip"] = zipped({f"doc{doc_id}.txt": body.encode(), "form.html": b"x"})
            if doc_id % 3 == 0:
                entries["../up.txt"] = b"x"
            if doc_id % 5 == 0:
                entries["setup.exe"] = b"MZ"
            data = zipped(entries)
            rows.append(("docs@mail.example", "INBOX", f"d{doc_id}", 1, f"doc{doc_id}.zip", data))
            held += len(data)
            if held > _ZIP_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _zips(t: SampleTables) -> DataFrame:
    return t.source("documents").select("doc_id", "text").mapInArrow(_zip_up, _ZIP_SCHEMA)


@query
def archive_members(t: SampleTables) -> DataFrame:
    return listing.archive_members(_zips(t)).select(
        "container",
        F.col("depth").cast("bigint").alias("depth"),
        F.col("member_pos").cast("bigint").alias("member_pos"),
        "member_count",
        "name",
        "safe_name",
        "size",
        "nested",
    )


@query
def archive_total(t: SampleTables) -> DataFrame:
    # listed once: scoring reads the members level by level
    members = stored(listing.archive_members(_zips(t)), "members")
    totals = archives.archive_scores(members)
    return totals.select(
        "message_id", rounded("archive_score").alias("score"), joined("archive_warnings").alias("findings")
    )


# --- fusion -------------------------------------------------------------------


def _reports(t: SampleTables) -> DataFrame:
    return fusion.threat_report(t.emails(dealt=True), t.attachments(), archives=_archive_scores(t))


@query
def risk_bucket(t: SampleTables) -> DataFrame:
    return t.observations().select(
        "event_id", risk.risk_bucket(F.col("processing_ms"), 5.0, 10.0).alias("risk_level")
    )


@query
def threat_report(t: SampleTables) -> DataFrame:
    return _reports(t).select(
        "message_id",
        "subject",
        "sender",
        "recipient",
        F.unix_timestamp("date").alias("sent"),
        rounded("overall_threat_score").alias("overall_threat_score"),
        "risk_level",
        rounded("spam.score").alias("spam_score"),
        F.col("spam.risk_level").alias("spam_risk"),
        rounded("nlp.score").alias("nlp_score"),
        F.col("nlp.risk_level").alias("nlp_risk"),
        rounded("media.score").alias("media_score"),
        F.col("media.risk_level").alias("media_risk"),
        joined("recommendations").alias("recommendations"),
    )


@query
def recommendations(t: SampleTables) -> DataFrame:
    return _reports(t).select("message_id", F.posexplode("recommendations").alias("rank", "line")).select(
        "message_id", F.col("rank").cast("bigint").alias("rank"), "line"
    )


@query
def alert_route(t: SampleTables) -> DataFrame:
    return fusion.alerts(_reports(t)).select("message_id", "risk_level")


@query
def threat_type(t: SampleTables) -> DataFrame:
    return fusion.detected_threats(_reports(t)).select("message_id", "threat_type", "severity")


@query
def report_digest(t: SampleTables) -> DataFrame:
    digest = fusion.report_digest(_reports(t))
    lists = [c for c in digest.columns if c not in (*MAILBOX_KEY, "risk_level")]
    return digest.select("message_id", "risk_level", *[joined(c).alias(c) for c in lists])


@query
def clean_budget(t: SampleTables) -> DataFrame:
    score = F.col("processing_ms")
    ratio = fusion.clean_ratio(score)
    return t.observations().select(
        "event_id",
        fusion.alert_meter(score).alias("meter"),
        rounded(ratio).alias("ratio"),
        fusion.clean_bar(ratio).alias("bar"),
        F.when(ratio > 0.6, "YELLOW").otherwise("GREEN").alias("color"),
    )


@query
def recommendation_class(t: SampleTables) -> DataFrame:
    lines = _reports(t).select("message_id", F.explode("recommendations").alias("line"))
    doubled = F.concat(F.lit(K.REC_PREFIXES[1]), F.col("line"))
    return lines.select(
        "message_id",
        "line",
        fusion.recommendation_class(F.col("line")).alias("severity"),
        fusion.bare_recommendation(doubled).alias("bare"),
    )


@query
def alert_payload_json(t: SampleTables) -> DataFrame:
    sent = fusion.alerts(_reports(t)).withColumn("date", F.unix_timestamp("date"))
    # numbers print differently from engine to engine, so the payload is read back, once and whole
    read = payloads.json_payload(sent).select(F.from_json("payload", sent.schema).alias("p")).select("p.*")
    lists = {
        "spam": ("indicators", "header_issues", "suspicious_urls"),
        "nlp": ("social_engineering_indicators", "urgency_markers", "authority_impersonation", "psychological_triggers"),
        "media": ("file_type_warnings", "suspicious_attachments", "size_anomalies", "potential_deepfakes"),
    }
    return read.select(
        "message_id",
        *("subject", "sender", "recipient", F.col("date").alias("sent"), "risk_level"),
        rounded("overall_threat_score").alias("overall_threat_score"),
        *[rounded(f"{layer}.score").alias(f"{layer}_score") for layer in lists],
        *[F.col(f"{layer}.risk_level").alias(f"{layer}_risk") for layer in lists],
        *[joined(f"{layer}.{name}").alias(name) for layer, names in lists.items() for name in names],
        joined("recommendations").alias("recommendations"),
    )


@query
def alert_payload_chat(t: SampleTables) -> DataFrame:
    return payloads.chat_payload(fusion.alerts(_reports(t))).select("message_id", "payload")


# --- metrics ------------------------------------------------------------------


@query
def threat_counters(t: SampleTables) -> DataFrame:
    return metrics.threat_counters(t.observations().filter(F.col("threat_type").isNotNull()))


@query
def error_counters(t: SampleTables) -> DataFrame:
    return metrics.error_counters(t.observations())


@query
def bounded_sample(t: SampleTables) -> DataFrame:
    kept = metrics.bounded_sample(t.observations(), keys=["event_type"], order=("ts", "event_id"))
    return kept.select("event_type", "event_id", "processing_ms")


@query
def latency_percentiles(t: SampleTables) -> DataFrame:
    stats = metrics.latency_stats(t.observations(), ["event_type"])
    return stats.withColumn("avg_ms", rounded("avg_ms"))


def _summary_columns(summary: DataFrame) -> DataFrame:
    def flat(name: str) -> Column:
        pairs = F.transform(
            F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
        )
        return joined(pairs).alias(name)

    stats = [F.col(f"processing_time_stats.{c}") for c in ("min_ms", "max_ms", "p50_ms", "p95_ms", "p99_ms")]
    return summary.select(
        "emails_processed",
        flat("threats_detected"),
        F.col("threat_types").cast("bigint").alias("threat_types"),
        flat("errors"),
        "sample_count",
        rounded("processing_time_stats.avg_ms").alias("avg_ms"),
        *stats,
    )


@query
def metrics_summary(t: SampleTables) -> DataFrame:
    return _summary_columns(metrics.metrics_summary(t.observations()))


@query
def stream_summary(t: SampleTables) -> DataFrame:
    # ten cycles, the tenth of which sums up
    source, sums = shared_folder(t.spark, "observations"), shared_folder(t.spark, "summaries")
    t.observations().repartition(10).write.parquet(source)

    def keep(summary: DataFrame, cycle: int) -> None:
        summary.write.mode("overwrite").parquet(f"{sums}/cycle={cycle}")

    arriving = stream.file_stream(t.spark, source, "*.parquet", per_cycle=1)
    _finish(running.running_metrics(arriving, shared_folder(t.spark, "metrics"), keep, once=True))
    return _summary_columns(t.spark.read.parquet(sums).drop("cycle"))


# --- functions ----------------------------------------------------------------


@query
def sanitize_log(t: SampleTables) -> DataFrame:
    return t.texts().select(
        "conv_id",
        "turn",
        text.sanitize_log(F.col("text")).alias("line"),
        text.sanitize_log(F.col("text"), 255).alias("short"),
    )


@query
def sanitize_text(t: SampleTables) -> DataFrame:
    clean, guarded = text.sanitize_text(F.col("text")), text.sanitize_text(F.col("text"), csv_safe=True)
    return t.texts().select("conv_id", "turn", clean.alias("clean"), guarded.alias("guarded"))


@query
def csv_guard(t: SampleTables) -> DataFrame:
    return t.texts().select("conv_id", "turn", text.csv_guard(F.col("text")).alias("cell"))


@query
def redact_email(t: SampleTables) -> DataFrame:
    return t.addresses().select("c_custkey", identity.redact_email(F.col("address")).alias("shown"))


@query
def chat_escape(t: SampleTables) -> DataFrame:
    return t.texts().select("conv_id", "turn", text.chat_escape(F.col("text")).alias("escaped"))


@query
def redact_url_params(t: SampleTables) -> DataFrame:
    return t.urls().select("page_id", urls.redact_url_params(F.col("url")).alias("shown"))


@query
def redact_url_secrets(t: SampleTables) -> DataFrame:
    return t.urls().select("page_id", urls.redact_url_secrets(F.col("url")).alias("shown"))


@query
def url_for_display(t: SampleTables) -> DataFrame:
    return t.urls().select("page_id", urls.url_for_display(F.col("url")).alias("shown"))


@query
def redact_urls_in_text(t: SampleTables) -> DataFrame:
    return t.texts().select("conv_id", "turn", urls.redact_urls_in_text(F.col("text")).alias("shown"))


@query
def email_valid(t: SampleTables) -> DataFrame:
    return t.addresses().select("c_custkey", identity.email_valid(F.col("address")).alias("valid"))


@query
def url_host_audit(t: SampleTables) -> DataFrame:
    return t.urls().select("page_id", urls.outbound_verdict(F.col("url")).alias("verdict"))


@query
def truncate_text(t: SampleTables) -> DataFrame:
    return t.source("documents").select(
        "doc_id",
        text.truncate_text(F.col("text"), 40).alias("short"),
        text.truncate_text(F.col("text"), 2).alias("dots"),
    )


@query
def rule_audit(t: SampleTables) -> DataFrame:
    return rules.audit(t.rules()).select("position", "pattern", "unsafe_form", "accepted")


# --- logs ---------------------------------------------------------------------


def _logs(t: SampleTables) -> DataFrame:
    return logs.parse_log(t.log_lines())


@query
def log_parse(t: SampleTables) -> DataFrame:
    return _logs(t).select(
        "event_id",
        F.unix_timestamp("ts").alias("logged"),
        "level",
        "message",
        "module",
        "line",
        F.try_element_at("extras", F.lit("email_id")).alias("email_id"),
        F.size("extras").cast("bigint").alias("n_extras"),
        F.col("_corrupt").isNotNull().alias("corrupt"),
    )


@query
def redact_fields(t: SampleTables) -> DataFrame:
    shown = logs.redact_fields(F.col("extras"))
    return _logs(t).select(
        "event_id",
        F.try_element_at(shown, F.lit("User_Token")).alias("user_token"),
        F.try_element_at(shown, F.lit("email_id")).alias("email_id"),
    )


@query
def log_write(t: SampleTables) -> DataFrame:
    parsed = _logs(t).filter(F.col("_corrupt").isNull())
    return parsed.select("event_id", logs.to_log_line(parsed).alias("line"))


@query
def log_by_level(t: SampleTables) -> DataFrame:
    return logs.by_level(_logs(t), "ERROR").select("event_id", "message")


@query
def log_by_module(t: SampleTables) -> DataFrame:
    return logs.by_module(_logs(t), "main").select("event_id", "level", "message")


@query
def log_contains(t: SampleTables) -> DataFrame:
    return logs.containing(_logs(t), "Analysis complete").select("event_id", "message")


def _log_store(t: SampleTables) -> str:
    root = shared_folder(t.spark, "log-store")
    log_store.write_logs(_logs(t).where("_corrupt IS NULL").select("event_id", "ts", "level", "module", "message"), root)
    return root


@query
def log_store_contains(t: SampleTables) -> DataFrame:
    return log_store.containing(t.spark, _log_store(t), "Analysis complete").select("event_id", "message")


@query
def log_store_module(t: SampleTables) -> DataFrame:
    return log_store.by_module(t.spark, _log_store(t), "main").select("event_id", "level", "message")


@query
def log_store_recent(t: SampleTables) -> DataFrame:
    return log_store.previous_hour(t.spark, _log_store(t)).select("event_id", "level", "message")


@query
def dead_letters(t: SampleTables) -> DataFrame:
    found = rejects.dead_letters(
        rejects.bad_log_lines(t.log_lines(), "event_id"), rejects.bad_dates(t.headers()), rejects.faulty_accounts(t.accounts())
    )
    return found.select("kind", "key", "reason")


@query
def dead_letters_replayed(t: SampleTables) -> DataFrame:
    # lines that were cut off behind the time are closed again; what is still missing is the level
    letters = rejects.bad_log_lines(t.log_lines(), "event_id")
    good, left = rejects.replay(letters, "log", lambda p: F.concat(p, F.lit('"}')), rejects.log_reason)
    return left.select("key", "reason").unionByName(good.select("key", F.lit(None).cast("string").alias("reason")))


@query
def log_level_counts(t: SampleTables) -> DataFrame:
    return logs.level_counts(_logs(t).filter(F.col("_corrupt").isNull()))


@query
def log_recent(t: SampleTables) -> DataFrame:
    return logs.previous_hour(_logs(t)).select("event_id", "level", "message")


# --- streaming ----------------------------------------------------------------


def _event_stream(t: SampleTables) -> DataFrame:
    """The events table as a stream."""
    return stream.table_stream(t.spark, f"{t.folder}/events.parquet")


def _document_stream(t: SampleTables) -> DataFrame:
    """Documents as arriving messages, without headers."""
    docs = stream.table_stream(t.spark, f"{t.folder}/documents.parquet")
    doc = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    no_headers = F.create_map().cast("map<string,array<string>>")
    return docs.select(
        doc.alias("message_id"),
        F.substring_index("text", "\n", 1).alias("subject"),
        F.concat("source", F.lit("@mail.example")).alias("sender"),
        F.lit("team@corp.example").alias("recipient"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("date"),
        F.col("text").alias("body_text"),
        F.lit("").alias("body_html"),
        no_headers.alias("headers"),
        F.concat("source", F.lit("@mail.example")).alias("account_email"),
        F.lit("INBOX").alias("folder"),
        F.col("doc_id").alias("seq"),
        (F.col("n_chars") * 20000).alias("size"),
    )


def _finish(running) -> None:
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()


def _document_loop(t: SampleTables, **hooks) -> stream.Loop:
    """Document messages carry the line items of the order with their number."""
    docs = t.source("documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("message_id"),
        F.concat("source", F.lit("@mail.example")).alias("account_email"),
        F.lit("INBOX").alias("folder"),
    )

    def in_mailbox(rows: DataFrame) -> DataFrame:
        named = rows.drop("account_email", "folder")
        return named.withColumn("message_id", F.regexp_replace("message_id", "^o", "d")).join(docs, "message_id")

    # numbered and scored once, not once for each cycle
    own = stored(in_mailbox(t.attachments()), "attachments")
    orders = docs.select(F.regexp_replace("message_id", "^d", "o").alias("message_id"))
    inside = stored(in_mailbox(_archive_scores(t, orders)), "archives")
    return stream.Loop(shared_folder(t.spark, "monitor"), own, inside, **hooks)


def _monitored(t: SampleTables, **hooks) -> Commits:
    loop = _document_loop(t, **hooks)
    _finish(stream.monitor(_document_stream(t), loop, once=True))
    return Commits(t.spark, loop.out)


_SCORES = "message_id string, overall_threat_score double, risk_level string"


@query
def stream_monitor(t: SampleTables) -> DataFrame:
    reports = _monitored(t).read("reports", _SCORES)
    return reports.select("message_id", rounded("overall_threat_score").alias("overall_threat_score"), "risk_level")


@query
def stream_alerts(t: SampleTables) -> DataFrame:
    return _monitored(t).read("alerts", stream.ALERTS).select(
        "message_id", F.get_json_object("payload", "$.risk_level").alias("risk_level")
    )


@query
def stream_processed(t: SampleTables) -> DataFrame:
    return _monitored(t).read("processed", stream.KEYS).select(*MAILBOX_KEY)


@query
def stream_alert_channel(t: SampleTables) -> DataFrame:
    # the hook writes what a channel would be sent, one folder for each cycle
    sent = shared_folder(t.spark, "channel")

    def channel(alerts: DataFrame, cycle: int) -> None:
        alerts.select(*MAILBOX_KEY).write.mode("overwrite").parquet(f"{sent}/cycle={cycle}")

    _monitored(t, on_alerts=channel)
    return t.spark.read.parquet(sent).select(*MAILBOX_KEY)


def _plain_loop(t: SampleTables, **more) -> stream.Loop:
    """A loop over document messages without attachments."""
    none = t.attachments().where("false")
    return stream.Loop(shared_folder(t.spark, "monitor"), none, **more)


def _drained(t: SampleTables, loop: stream.Loop) -> Commits:
    """The loop over all documents, with further cycles until nothing waits that may go on."""
    messages = _document_stream(t)
    _finish(stream.monitor(messages, loop, once=True))
    stream.drain(t.spark, loop, messages.schema)
    return Commits(t.spark, loop.out)


# messages that one cycle takes from each folder; the others wait
_FETCH = 40


@query
def stream_fetch(t: SampleTables) -> DataFrame:
    loop = _plain_loop(t, accounts=t.accounts(), params=replace(DEFAULTS, max_per_folder=_FETCH))
    store = _drained(t, loop)
    told = [
        store.read_numbered(table, schema).select("message_id", F.lit(state).alias("state"), "cycle")
        for table, schema, state in (("reports", _SCORES, "reported"), ("skipped", stream.SKIPPED, "too large"))
    ]
    off = store.snapshot("queue", stream.QUEUE).select("message_id", F.lit("waiting").alias("state"), F.lit(None).cast("bigint").alias("cycle"))
    return told[0].unionByName(told[1]).unionByName(off)


@query
def stream_retry(t: SampleTables) -> DataFrame:
    # one message whose attachments cannot be read; the others are not held up by it
    none = t.attachments().where("false")

    def own(batch: DataFrame) -> DataFrame:
        broken = F.col("message_id") == "d5"
        told = F.when(broken, F.raise_error(F.lit("cannot be read")).cast("string")).otherwise("")
        return none.unionByName(
            batch.where(told != "").select(
                *[F.col(f.name) if f.name in MAILBOX_KEY else F.lit(None).cast(f.dataType).alias(f.name) for f in none.schema]
            )
        )

    store = _drained(t, stream.Loop(shared_folder(t.spark, "monitor"), own, go_on=True))
    reported = store.read("reports", _SCORES).select("message_id", F.lit("reported").alias("state"), F.lit(0).alias("failures"))
    dead = store.read("dead", stream.FAILED).select("message_id", F.lit("dead").alias("state"), F.col("attempts").alias("failures"))
    return reported.unionByName(dead)


@query
def stream_outbox(t: SampleTables) -> DataFrame:
    # a channel that refuses every third message once and every seventh always
    ticks = iter(range(0, 1000, 10))

    def channel(due: DataFrame) -> DataFrame:
        n = F.substring("message_id", 2, 20).cast("bigint")
        refused = (n % 7 == 0) | ((n % 3 == 0) & (F.col("attempts") == 0))
        return due.select("delivery_id", (~refused).alias("delivered"), F.when(refused, "refused").alias("reason"))

    loop = _plain_loop(t, channel=channel, clock=lambda: float(next(ticks)))
    store = _drained(t, loop)
    out = Commits(t.spark, f"{loop.out}/deliveries")
    while deliver(store, out, channel, loop.clock()):
        pass
    sent = out.read("sent", SENT).select("message_id", F.lit("sent").alias("state"), "attempts")
    return sent.unionByName(out.read("dead", DEAD).select("message_id", F.col("reason").alias("state"), "attempts"))


@query
def stream_dedup(t: SampleTables) -> DataFrame:
    events = _event_stream(t)
    # every event arrives twice, the second time under the same key
    twice = events.select(
        F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"),
        F.col("event_id").cast("string").alias("message_id"),
        F.col("event_type").alias("folder"),
        F.lit("a@mail.example").alias("account_email"),
        F.col("ts").cast("timestamp").alias("arrived"),
    )
    out = shared_folder(t.spark, "dedup")
    kept = stream.first_deliveries(twice, "arrived", "60 days").select("message_id", "folder", "account_email")
    running = (
        kept.writeStream.format("parquet")
        .option("path", f"{out}/kept")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    _finish(running)
    return t.spark.read.parquet(f"{out}/kept").groupBy("folder").agg(
        F.count("*").alias("deliveries"), F.countDistinct("message_id").alias("messages")
    )


@query
def stream_metrics(t: SampleTables) -> DataFrame:
    kind = F.expr(
        "CASE event_type WHEN 'click' THEN 'phishing' WHEN 'purchase' THEN 'malware' WHEN 'signup' THEN 'spam' END"
    )
    severity = F.expr("CASE user_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END")
    threats = _event_stream(t).select(kind.alias("threat_type"), severity.alias("severity")).dropna()
    out = shared_folder(t.spark, "metrics")
    _finish(stream.running_counts(threats, out, once=True))
    latest = t.spark.read.parquet(f"{out}/counts")
    last = latest.agg(F.max("batch")).scalar()
    return latest.filter(F.col("batch") == last).select("threat_type", "severity", "n")
