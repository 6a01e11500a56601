"""Small tables for tests."""

from pyspark.sql import types as T

EMAIL_SCHEMA = (
    "message_id string, subject string, sender string, recipient string, date timestamp, body_text string,"
    " body_html string, headers map<string,array<string>>, account_email string, folder string"
)
ATTACHMENT_SCHEMA = T.StructType(
    [
        T.StructField("account_email", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("filename", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("head", T.BinaryType()),
        T.StructField("truncated", T.BooleanType()),
    ]
)
FULL_HEADERS = {
    "from": ["sender@example.com"],
    "to": ["recipient@example.com"],
    "date": ["Mon, 1 Jan 2024 10:00:00 +0000"],
    "message-id": ["<1@example.com>"],
    "dkim-signature": ["v=1"],
    "received-spf": ["pass"],
}


def emails(spark, *rows):
    """Messages from dicts; anything left out is empty, headers are complete."""
    base = {
        "message_id": "m",
        "subject": "",
        "sender": "sender@example.com",
        "recipient": "recipient@example.com",
        "date": None,
        "body_text": "",
        "body_html": "",
        "headers": FULL_HEADERS,
        "account_email": "a@example.com",
        "folder": "INBOX",
    }
    filled = [{**base, "message_id": f"m{i}", **row} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in base) for r in filled], EMAIL_SCHEMA)


def attachments(spark, *rows):
    """(message_id, pos, filename, size, head) tuples."""
    return spark.createDataFrame([("a@example.com", "INBOX", *r, False) for r in rows], ATTACHMENT_SCHEMA)
