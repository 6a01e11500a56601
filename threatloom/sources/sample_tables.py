"""Mail-shaped tables derived from the sample star schema.

Every row of the source tables becomes one message, header set, attachment,
archive member or log line; nothing is sampled or filtered.  Subjects, senders
and lures are picked by the row's number, with pairwise coprime list lengths, so
that all combinations occur.

Each table is one SQL text in a form both Spark and an ANSI checker accept;
``@name@`` marks a source table and a few functions differ by dialect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SOURCES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def quote(value: str) -> str:
    """SQL text literal without backslashes or doubled quotes."""
    if "'" not in value and "\\" not in value:
        return f"'{value}'"
    pieces, current = [], ""
    for ch in value:
        if ch in "'\\":
            pieces += [f"'{current}'", f"chr({ord(ch)})"]
            current = ""
        else:
            current += ch
    return "(" + " || ".join([*pieces, f"'{current}'"]) + ")"


def pick(seed: str, options: list[str], raw: bool = False) -> str:
    """``CASE`` over ``seed`` modulo the number of options."""
    shown = options if raw else [quote(o) for o in options]
    arms = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(shown[:-1]))
    return f"CASE {seed} % {len(options)} {arms} ELSE {shown[-1]} END"


SUBJECTS = [
    "Meeting tomorrow",
    "URGENT: WINNER PRIZE !!!",
    "URGENT: Verify Your Account Now!!!",
    "FREE MONEY NOW",
    "Invoice $450 attached",
    "You won 200 euro, act now and click here",
    "GRÜSSE AUS KÖLN ÄÖÜ",
    "CONGRATULATIONS LOTTERY WINNER",
    "Security alert: unusual login activity",
    "limited time casino bonus! weight loss! pills! & <b>",
    "",
]
SENDERS = [
    "Alice Example <alice@example.com>",
    "CEO John <ceo.john@gmail.com>",
    "paypal.com <service@evil-host.biz>",
    "IT Manager <manager@mail.yahoo.com>",
    "no-reply@microsoft.com",
    "Bank <alerts@bank.example>",
    "undisclosed",
    "director@notgmail.com",
    "<bounce@lists.example.org>",
    "a@b <c@d.example>",
    "President <p@outlook.com>",
    "google <x@google.com>",
    "",
]
LURES = [
    "",
    "viagra pills available now. Click here http://bit.ly/abc and HTTP://BIT.LY/ABC or https://example.com/x",
    "Your suspended account is blocked. Verify your account within 24 hours! ASAP!!! http://192.168.0.1/login?token=s3",
    "IRS lawsuit: PayPal and the bank want a certified reply, final notice. LAST CHANCE HURRY WIRE MONEY TODAY",
    "@links@",
    "You have won a secret bonus, an exclusive limited offer, approved. Don't delay, it expires soon. éwin win",
    "see https://a-very-long-subdomain-name-used-for-tricks.example/p https://microsoft.com/ok goo.gl"
    " http://user:pw@tinyurl.com/z http://t.co/q https://[::1]/x http://bad[host/y http://t.co/q",
]
SNIPPETS = [
    "",
    '<p style="font-size: 0px">free money</p><img src=a><img src=b><IMG src=c>',
    "<a href='http://bit.ly/spam'>click now</a>",
    '<div style="COLOR:#fff; background:#FFF">x</div> nigerian prince, poker',
    "<img><img> https://example.org/ok",
]
FOLDERS = ["INBOX", "Junk", "Archive", "Sent"]

_LINKS = "repeat('https://site.example/a ', 12)"
_LURE = pick("n", [_LINKS if x == "@links@" else quote(x) for x in LURES], raw=True)

MAIL_SOURCE = """
SELECT 'd' || CAST(doc_id AS STRING) AS message_id, doc_id AS n, source || '@mail.example' AS account_email,
       text AS base_text, '' AS base_html, CAST(n_chars * 20000 AS BIGINT) AS size
FROM @documents@
UNION ALL
SELECT 'p' || CAST(page_id AS STRING), page_id, 'web' || CAST(page_id % 4 AS STRING) || '@mail.example', '', html,
       CAST(length(html) AS BIGINT) * 20000
FROM @pages@
UNION ALL
SELECT 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING), conv_id * 64 + turn,
       role || '@mail.example', text, '', CAST(length(text) AS BIGINT) * 20000
FROM @conversations@
UNION ALL
SELECT 'o' || CAST(o_orderkey AS STRING), o_orderkey, 'shop' || CAST(1 + o_orderkey % 100 AS STRING) || '@mail.example',
       'Order ' || CAST(o_orderkey AS STRING) || ' is ' || o_orderstatus || ' with priority ' || o_orderpriority,
       '', CAST(floor(o_totalprice * 400) AS BIGINT)
FROM @orders@
"""

MAIL_ROWS = f"""
SELECT message_id, n AS seq, {pick("n", SUBJECTS)} AS subject, {pick("n", SENDERS)} AS sender,
       'user' || CAST(n AS STRING) || '@corp.example' AS recipient,
       @ts:1704067200 + n * 60@ AS date,
       base_text || ' ' || {_LURE} AS body_text,
       base_html || {pick("n", SNIPPETS)} AS body_html,
       account_email, {pick("n", FOLDERS)} AS folder, size
FROM @mail_source@ AS src
"""
MAIL = MAIL_ROWS.replace("@mail_source@", f"({MAIL_SOURCE})")

# (name, value expression or NULL) in header order; ``n`` is the message number
_RECEIVED_SLOTS = 13
HEADER_SLOTS: list[tuple[str, str]] = [
    ("From", f"CASE WHEN n % 17 = 16 THEN NULL ELSE {pick('n', SENDERS)} END"),
    ("FROM", "CASE WHEN n % 19 = 0 THEN 'other@fake.example' END"),
    ("To", "CASE WHEN n % 23 = 0 THEN NULL ELSE 'user' || CAST(n AS STRING) || '@corp.example' END"),
    (
        "Date",
        pick(
            "n",
            [
                "NULL",
                "'not a date'",
                "'Mon, 1 Jan 2024 10:00:00 +0000'",
                "'15 Feb 2024 23:30:05 -0500'",
                "'Sat, 31 Feb 2024 10:00:00 +0000'",
                "'Tue, ' || CAST(1 + n % 28 AS STRING) || ' Mar 2024 08:15:30 +0200'",
            ],
            raw=True,
        ),
    ),
    ("Message-ID", "CASE WHEN n % 29 = 0 THEN NULL ELSE '<' || CAST(n AS STRING) || '@corp.example>' END"),
    (
        "Received-SPF",
        pick("n", ["'pass'", "'Fail (domain)'", "'softfail'", "NULL", "'pass'", "'neutral'"], raw=True),
    ),
    ("received-spf", pick("n", ["NULL", "'fail'", "'SoftFail, not a fail'", "NULL", "'none'"], raw=True)),
    (
        "Authentication-Results",
        pick(
            "n",
            [
                "'mx; dkim=pass spf=pass'",
                "'mx; DKIM=fail'",
                "'mx; SPF=Fail'",
                "'mx; dkim=neutral; spf=permerror'",
                "NULL",
                "'mx; dkim=none'",
                "'mx; dkim=permerror'",
            ],
            raw=True,
        ),
    ),
    ("DKIM-Signature", "CASE WHEN n % 3 <> 0 THEN 'v=1; a=rsa-sha256' END"),
    (
        "Return-Path",
        pick("n", ["NULL", "'<bounce@evil.example>'", pick("n", SENDERS), "'nobody'", pick("n", SENDERS)], raw=True),
    ),
    *[
        ("Received", f"CASE WHEN n % 14 >= {i} THEN 'by hop{i}.example' END")
        for i in range(1, _RECEIVED_SLOTS + 1)
    ],
]

EXTENSIONS = [
    ".pdf", ".exe", ".jpg", ".PDF.EXE", ".docm", ".mp4", ".zip", ".tar.gz", ".html", ". exe",
    ".exe.", ".png ", ".mkv", ".wav", ".avi", ".mov", ".webp", ".jpeg", ".gif", ".doc",
    ".js", ".svg", "", ".tgz", ".gz", ".tar", ".flac", ".7z", ".dll", ".ogg", ".v1.txt",
]
HEADS = [
    "255044462D312E370A000000", "4D5A90000300000004000000", "FFD8FFE000104A4649460001",
    "504B03041400000008000000", "89504E470D0A1A0A0000000D", "D0CF11E0A1B11AE100000000",
    "524946460000000041564920", "524946460000000057415645", "524946460000000057454250",
    "5249464600000000AAAAAAAA", "000000186674797069736F6D", "1A45DFA30000000000000000",
    "000000000000000000000000", "4944", "1F8B08000000000000030000", "4F67675300020000", "FFFB90",
    "3026B2758E66CF11A6D90000", "664C614300000022", "47494638396101000100", "494433030000", "52494646AA",
]

_LINE_ORDER = (
    "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate,"
    " l_returnflag, l_linestatus"
)

# the mailbox an order's message lies in
_ORDER_ACCOUNT = "'shop' || CAST(1 + l_orderkey % 100 AS STRING) || '@mail.example'"
_ATTACHMENT_KEY = f"""{_ORDER_ACCOUNT} AS account_email, {pick("l_orderkey", FOLDERS)} AS folder,
         'o' || CAST(l_orderkey AS STRING) AS message_id"""
ATTACHMENTS = f"""
SELECT account_email, folder, message_id, pos, filename, content_type, size, head, size > 26214400 AS truncated
FROM (
  SELECT {_ATTACHMENT_KEY},
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS INT) AS pos,
         'file' || CAST(l_partkey AS STRING) || {pick("l_partkey", EXTENSIONS)} AS filename,
         {pick("l_partkey", ["application/octet-stream", "image/png", "text/csv", "video/mp4"])} AS content_type,
         CAST(CASE WHEN l_linenumber = 3 THEN l_quantity * 30
                   ELSE floor(l_extendedprice * 400) END AS BIGINT) AS size,
         unhex({pick("l_suppkey + l_linenumber", HEADS)}) AS head
  FROM @lineitem@
) AS numbered
"""

MEMBER_NAMES = [
    "../../etc/passwd", "run.exe", "backup.zip", "macro.docm", "C:evil.txt", "/abs/path.txt",
    "inner.tar.gz", "page.html", "a..b.txt", "data.rar", "CON.txt", "dir\\tool.ps1", "disk.iso",
]
NESTED_STATES = ["'ok'", "'ok'", "'unreadable'", "'bomb'", "'skipped'", "NULL"]

# Each order's first attachment is an archive of its line items; seventh lines all lie in three very large
# archives of nobody's message.  One in 11 rows has a telling name.
_MEMBER_ROWS = f"""
SELECT CASE WHEN l_linenumber = 7 THEN 'hot' || l_returnflag ELSE 'o' || CAST(l_orderkey AS STRING) END AS archive,
       CASE WHEN l_linenumber IN (4, 5) THEN 1 + CAST(l_quantity AS BIGINT) % 3 ELSE 0 END AS parent_pos,
       CASE WHEN l_linenumber = 7 THEN 'hot@mail.example' ELSE {_ORDER_ACCOUNT} END AS account_email,
       CASE WHEN l_linenumber = 7 THEN 'INBOX' ELSE {pick("l_orderkey", FOLDERS)} END AS folder,
       CASE WHEN (l_partkey + l_linenumber) % 11 = 0 THEN {pick("l_suppkey + l_partkey", MEMBER_NAMES)}
            ELSE 'docs/file' || CAST(l_partkey AS STRING) || '.txt' END AS name,
       CAST(floor(l_extendedprice) AS BIGINT) AS size,
       {pick("l_suppkey + l_linenumber", NESTED_STATES, raw=True)} AS nested,
       CASE WHEN (l_partkey + l_suppkey) % 97 = 0 THEN '../target' END AS linkname,
       l_orderkey, {_LINE_ORDER}
FROM @lineitem@
"""
_CONTAINER = "CASE WHEN parent_pos = 0 THEN archive ELSE archive || '/' || CAST(parent_pos AS STRING) END"
_MEMBERS = f"""
SELECT account_email, folder, archive AS message_id, CAST(1 AS INT) AS pos,
       @container@ AS container,
       archive || CASE WHEN parent_pos = 0 THEN '.zip' ELSE '.zip/inner' END AS container_name,
       CAST(CASE WHEN parent_pos = 0 THEN 0 ELSE 1 END AS INT) AS depth,
       CASE WHEN archive LIKE '%1' OR archive LIKE '%R' THEN 'tar' ELSE 'zip' END AS kind,
       row_number() OVER (PARTITION BY @within@ ORDER BY {_LINE_ORDER})
         + CASE WHEN archive LIKE 'hot%' THEN l_orderkey * 64 ELSE 0 END AS member_pos,
       name, size, linkname, nested,
       CASE nested WHEN 'unreadable' THEN 'File is not a ' || CASE WHEN archive LIKE '%1' OR archive LIKE '%R' THEN 'tar' ELSE 'zip' END || ' file'
                   WHEN 'bomb' THEN 'ratio ' || CAST(size AS STRING) || ':1' END AS reason
FROM (@rows@) AS rows_of
"""
MEMBERS = (
    _MEMBERS.replace("@container@", _CONTAINER)
    .replace("@within@", "l_orderkey, archive, parent_pos")
    .replace("@rows@", _MEMBER_ROWS)
)
# the same rows from line items that are dealt by container already
_DEALT_MEMBERS = (
    _MEMBERS.replace("@container@", "container_key")
    .replace("@within@", "container_key, l_orderkey, archive, parent_pos")
    .replace("@rows@", _MEMBER_ROWS.replace("l_orderkey, l_linenumber", "container_key, l_orderkey, l_linenumber"))
)
MEMBER_COUNTS = f"""
SELECT CASE WHEN parent_pos = 0 THEN archive ELSE archive || '/' || CAST(parent_pos AS STRING) END AS container,
       count(*) AS member_count
FROM ({_MEMBER_ROWS}) AS rows_of GROUP BY 1
"""
MEMBER_NAMES_SQL = f"SELECT name FROM ({_MEMBER_ROWS}) AS rows_of"

_PART_TYPES = ["text/plain", "text/html", "application/pdf", "multipart/mixed", "text/plain"]
_DISPOSITIONS = ["", "inline", "attachment; x", "", "", "", ""]
_PART_NAMES = ["", "", "", " ", "a.pdf", "", "", "", "", "", ""]
PARTS = f"""
SELECT message_id, pos, {pick("n", _PART_TYPES)} AS content_type, {pick("n", _DISPOSITIONS)} AS disposition,
       {pick("n", _PART_NAMES)} AS filename, n % 5 = 3 AS is_multipart, text,
       CAST(length(text) AS BIGINT) AS size
FROM (
  SELECT 'conv' || CAST(conv_id AS STRING) AS message_id, CAST(turn + 1 AS INT) AS pos, conv_id + turn AS n, text
  FROM @conversations@
  UNION ALL
  SELECT 'digest-' || CAST(CAST(floor(doc_id / 120) AS BIGINT) AS STRING), CAST(1 + doc_id % 120 AS INT), doc_id, text
  FROM @documents@
) AS raw_parts
"""

OBSERVATIONS = """
SELECT event_id, ts, event_type, value AS processing_ms,
       CASE event_type WHEN 'click' THEN 'phishing' WHEN 'purchase' THEN 'malware' WHEN 'signup' THEN 'spam'
         END AS threat_type,
       CASE user_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity,
       CASE WHEN event_type = 'error' THEN
         CASE user_id % 3 WHEN 0 THEN 'imap_connection' WHEN 1 THEN 'analysis_error' ELSE 'analysis_timeout' END
         END AS error_type
FROM @events@
"""

_LEVEL = (
    "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"
)
_MODULE = pick("user_id", ["main", "spam_analyzer", "nlp_analyzer", "media_analyzer", "alert_system"])
_MESSAGE = (
    "CASE WHEN event_type = 'view' THEN 'Analysis complete: overall_score=' || CAST(user_id AS STRING)"
    " ELSE 'Analyzing email: ' || event_type END"
)
# one line in 50 is cut short, as a crashed writer leaves it
LOG_LINES = f"""
SELECT event_id,
       CASE WHEN event_id % 50 = 49 THEN chr(123) || '"timestamp": "' || @stamp:ts@
       ELSE chr(123) || '"timestamp": "' || @stamp:ts@ || '", "level": "' || {_LEVEL}
         || '", "logger": "MailWatch", "message": "' || {_MESSAGE} || '", "module": "' || {_MODULE}
         || '", "function": "run", "line": ' || CAST(user_id % 400 AS STRING)
         || ', "User_Token": "t' || CAST(user_id AS STRING) || '", "email_id": "' || CAST(event_id AS STRING)
         || '"' || chr(125) END AS value
FROM @events@
"""

URL_FORMS = [
    "url || '&token=abc&Token=x%20y'",
    "url",
    "'https://user:s3cr%40t@shop.example/p?x=1&sig=zz#frag'",
    "'https://hooks.slack.com/services/T000/B000/' || CAST(page_id AS STRING)",
    "'https://discord.com/api/webhooks/' || CAST(page_id AS STRING) || '/abcdef'",
    "'HTTPS://10.' || CAST(page_id % 300 AS STRING) || '.3.4/x?'",
    "'https://' || CAST(page_id % 256 AS STRING) || '.168.0.1:8443/'",
    "'https://[::1]/admin'",
    "'https://api.example/v1?a=1&b=~*&API_KEY=k&a=2&&c'",
    "'ftp://files.example/x'",
    "'https:///nohost'",
    "'https://[fe80::1]/x'",
    "replace(url, 'http://', 'https://')",
]
URLS = f"SELECT page_id, {pick('page_id', URL_FORMS, raw=True)} AS url FROM @pages@"

ACCOUNTS = """
SELECT 'shop' || CAST(c_custkey AS STRING) || '@mail.example' AS account_email,
       c_acctbal > 0 AS enabled, c_mktsegment <> 'MACHINERY' AS connected
FROM @customer@
UNION ALL
SELECT DISTINCT source || '@mail.example', true, source <> 'src3' FROM @documents@
"""

# what earlier cycles have fetched: mail of documents that carry a quality label, and of finished orders
PROCESSED = """
SELECT m.account_email, m.folder, m.message_id
FROM @mail@ AS m
WHERE m.message_id IN (SELECT 'd' || CAST(doc_id AS STRING) FROM @labels@)
   OR m.message_id IN (SELECT 'o' || CAST(o_orderkey AS STRING) FROM @orders@ WHERE o_orderstatus = 'F')
"""

# rule tables written by users, one rule per part; some are unsafe
RULES = """
SELECT CASE p_partkey % 4 WHEN 0 THEN 'SE' WHEN 1 THEN 'UG' WHEN 2 THEN 'AU' ELSE 'PS' END AS category,
       CASE p_partkey % 9
         WHEN 0 THEN '(a+)+' || p_name
         WHEN 4 THEN chr(92) || 'b(' || replace(p_name, ' ', '|') || ')(' || chr(92) || 'w+)*'
         WHEN 7 THEN '([a-zA-Z]+)*' || p_brand
         ELSE chr(92) || 'b(' || replace(p_name, ' ', '|') || ')' || chr(92) || 'b' END AS pattern,
       p_name AS description, p_partkey AS position
FROM @part@
"""

ADDRESSES = """
SELECT c_custkey, CASE c_custkey % 10
    WHEN 0 THEN replace(lower(c_name), '#', '') || '@example.com'
    WHEN 1 THEN '@example.com'
    WHEN 2 THEN c_name
    WHEN 3 THEN 'x@' || lower(c_mktsegment) || '.co'
    WHEN 4 THEN '.dot@example.com'
    WHEN 5 THEN 'a..b@example.com'
    WHEN 6 THEN 'ok+tag@sub-domain.example.org'
    WHEN 7 THEN 'bad@-edge.example.org'
    WHEN 8 THEN 'two@at@signs.example'
    ELSE repeat('l', CAST(200 + c_custkey % 100 AS INT)) || '@example.com' END AS address
FROM @customer@
"""

# texts with line breaks, tabs, terminal sequences, zero-width and formula openings
TEXTS = """
SELECT conv_id, turn, CASE (conv_id + turn) % 6
    WHEN 0 THEN '=1+1' || text
    WHEN 1 THEN text || chr(13) || chr(10) || chr(9) || 'tail' || chr(27) || '[31mred' || chr(27) || '[0m'
    WHEN 2 THEN '  @cmd ' || text || '\u200b\u202e' || chr(7)
    WHEN 3 THEN chr(9) || text || ' & <b>'
    WHEN 4 THEN 'See https://api.example/v1?token=abc, www.x.example/y?key=1. (https://u:p@h.example/z) ' || text
    ELSE text END AS text
FROM @conversations@
"""


def render(sql: str, dialect: str, tables: dict[str, str]) -> str:
    """SQL text of one dialect; ``tables`` maps source names to what to read."""
    forms = {
        "spark": {"ts": "timestamp_seconds({})", "stamp": "date_format({}, 'yyyy-MM-dd HH:mm:ss')"},
        "ansi": {"ts": "make_timestamp(({}) * 1000000)", "stamp": "strftime({}, '%Y-%m-%d %H:%M:%S')"},
    }[dialect]
    for marker, form in forms.items():
        opening = f"@{marker}:"
        while opening in sql:
            before, _, rest = sql.partition(opening)
            inner, _, after = rest.partition("@")
            sql = before + form.format(inner) + after
    for name, where in tables.items():
        sql = sql.replace(f"@{name}@", where)
    return sql


def header_map_sql() -> str:
    """Header map of one message: each name with its values in order, absent names left out."""
    by_name: dict[str, list[str]] = {}
    for name, value in HEADER_SLOTS:
        by_name.setdefault(name.lower(), []).append(value)
    items = []
    for name, values in by_name.items():
        listed = f"filter(array({', '.join(values)}), v -> v IS NOT NULL)"
        items.append(f"'{name}', {listed}")
    return f"map_filter(map({', '.join(items)}), (k, v) -> size(v) > 0)"


def header_entries_sql(dialect: str) -> str:
    """Array of (pos, name, value) of one message, absent headers included as nulls."""
    if dialect == "spark":
        items = [
            f"named_struct('pos', {i}, 'name', '{name}', 'value', {value})"
            for i, (name, value) in enumerate(HEADER_SLOTS, start=1)
        ]
        return f"array({', '.join(items)})"
    items = [
        f"{{'pos': {i}, 'name': '{name}', 'value': {value}}}"
        for i, (name, value) in enumerate(HEADER_SLOTS, start=1)
    ]
    return f"[{', '.join(items)}]"


@dataclass(frozen=True)
class SampleTables:
    """The derived tables of one data folder."""

    spark: SparkSession
    folder: str

    def _paths(self) -> dict[str, str]:
        return {name: f"parquet.`{self.folder}/{name}.parquet`" for name in SOURCES}

    def sql(self, text: str, **extra: str) -> DataFrame:
        """Run one derived-table text."""
        tables = {**extra, **self._paths()}
        return self.spark.sql(render(render(text, "spark", tables), "spark", self._paths()))

    def source(self, name: str) -> DataFrame:
        """A source table as it is."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def mail(self, dealt: bool = False) -> DataFrame:
        """Messages without headers; dealt over ``threatloom.samplePartitions`` tasks where that is set.

        Small rows lie many to a file, and a file is one task, which text scoring
        would wait for.  ``dealt`` spreads the rows, before texts are put together,
        over as many tasks as the session shuffles to; nothing depends on it.
        """
        source = self.sql(MAIL_SOURCE)
        tasks = self.spark.conf.get("threatloom.samplePartitions", None)
        if tasks:
            source = source.repartition(int(tasks))
        elif dealt:
            # by value, so that a task that runs again deals its rows as before
            source = source.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "message_id", "account_email", "size")
        return self.spark.sql(render(MAIL_ROWS, "spark", {"mail_source": "{src}"}), src=source)

    def emails(self, dealt: bool = False) -> DataFrame:
        """Messages with their header map, built on the row."""
        numbered = self.mail(dealt).withColumn("n", F.col("seq"))
        return numbered.withColumn("headers", F.expr(header_map_sql())).drop("n")

    def headers(self) -> DataFrame:
        """Long header table."""
        entries = F.expr(header_entries_sql("spark"))
        rows = self.sql(MAIL_SOURCE).select("message_id", F.explode(entries).alias("h"))
        return rows.select("message_id", "h.*").filter(F.col("value").isNotNull())

    def attachments(self) -> DataFrame:
        """Attachments of order messages."""
        # a message is an order: numbered by the message's key, attachments lie as the walk over them asks
        by_message = ATTACHMENTS.replace("PARTITION BY l_orderkey", "PARTITION BY account_email, folder, message_id")
        keyed = self.sql(f"SELECT {_ATTACHMENT_KEY}, l_orderkey, {_LINE_ORDER} FROM @lineitem@")
        return self.spark.sql(render(by_message.replace(_ATTACHMENT_KEY, "account_email, folder, message_id"), "spark", {"lineitem": "{src}"}), src=keyed)

    def members(self) -> DataFrame:
        """Archive members, numbered within their archive, with the archive's member count."""
        keyed = self.sql(f"SELECT l_orderkey, {_LINE_ORDER}, {_CONTAINER} AS container_key FROM ({_MEMBER_ROWS}) AS rows_of")
        # shuffled once, before texts are put together: places, counts and scores are all within a container
        dealt = keyed.where("container_key IS NOT NULL").repartition("container_key")
        rows = self.spark.sql(render(_DEALT_MEMBERS, "spark", {"lineitem": "{src}"}), src=dealt)
        counted = rows.withColumn("member_count", F.count(F.lit(1)).over(Window.partitionBy("container")))
        return counted.select("container", *[c for c in counted.columns if c != "container"])

    def member_names(self) -> DataFrame:
        """Names of all archive members."""
        return self.sql(MEMBER_NAMES_SQL)

    def parts(self) -> DataFrame:
        """MIME parts of conversations (one part a turn) and digests of 120 documents (one part each)."""
        return self.sql(PARTS)

    def observations(self) -> DataFrame:
        """Metric observations."""
        return self.sql(OBSERVATIONS)

    def log_lines(self) -> DataFrame:
        """JSON log lines."""
        return self.sql(LOG_LINES)

    def urls(self) -> DataFrame:
        """URLs with and without secrets."""
        return self.sql(URLS)

    def accounts(self) -> DataFrame:
        """Mail accounts."""
        return self.sql(ACCOUNTS)

    def processed(self) -> DataFrame:
        """Keys of messages fetched before."""
        return self.sql(PROCESSED, mail=f"({MAIL})")

    def rules(self) -> DataFrame:
        """User-written rules."""
        return self.sql(RULES)

    def addresses(self) -> DataFrame:
        """Addresses, good and bad."""
        return self.sql(ADDRESSES)

    def texts(self) -> DataFrame:
        """Texts with characters that need sanitising."""
        return self.sql(TEXTS)
