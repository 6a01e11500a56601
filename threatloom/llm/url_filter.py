"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names the tokens (runs of a-z and 0-9, in lower case) that any URL it
fits must hold whole.  How often these tokens occur is counted over all URLs,
and each rule is filed under the rarest of its own.  A URL's tokens fetch the
rules filed under them, and only those run their regular expressions.

Host and path rules come first: a rule fits its host and all subdomains if the
path starts with the rule's path, and the longest rule decides.  Other patterns
decide the rest, in their order; a URL that nothing fits is allowed.

A null URL, or one without ``://``, has an empty host and path and is allowed.
Ties between rules of equal length go by their text.  Repeated rows are judged
alike; an empty table gives no rows.  A rule without tokens is always tried.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.batches import byte_texts, quoted

TOKEN = rb"[a-z0-9]+"
SCHEMA = "host string, path string, rule string, pattern string, verdict string"


@dataclass(frozen=True)
class UrlRule:
    """A regular expression over host and path, from their start; of rules that fit, the highest ``rank`` decides."""

    text: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: int
    base: bool = False


def page_rule(verdict: str, host: str, path: str) -> UrlRule:
    """A host with its subdomains, and how its path starts."""
    text = host + path
    # the last piece of the path may go on in the URL, so it is no whole token
    whole = re.findall(r"[a-z0-9]+", host.lower()) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())
    regex = rf"(?:[^/?#]*\.)?{re.escape(host.lower())}{re.escape(path)}"
    return UrlRule(text, verdict, regex, tuple(whole), len(text), base=True)


# fixed values: the rules that decide first
PAGE_RULES = (
    page_rule("allow", "org", "/"),
    page_rule("block", "example.org", "/es/"),
    page_rule("block", "example.org", "/en/1"),
    page_rule("allow", "com", "/fr/"),
    page_rule("block", "com", "/de/"),
)

# fixed values: verdict, tokens that must occur, expression over host and path; earlier ones decide
PATTERNS = (
    ("allow", ("wiki",), r"(?:[^/]*[.-])?wiki\."),
    ("allow", ("edu",), r"[^/]*\.edu(?:\.[a-z]{2})?/"),
    ("allow", ("gov",), r"[^/]*\.gov(?:\.[a-z]{2})?/"),
    ("block", ("ads", "track"), r"(?:[^/]*\.)?ads-track\."),
    ("block", ("casino", "win"), r"(?:[^/]*\.)?casino-win\."),
    ("block", ("cheap", "pills"), r"(?:[^/]*\.)?cheap-pills\."),
    ("block", ("free", "bets"), r"(?:[^/]*\.)?free-bets\."),
    ("block", ("casino",), r"[^/]*\bcasino\b"),
    ("block", ("poker",), r"[^/]*\bpoker\b"),
    ("block", ("slots",), r"[^/]*\bslots\b"),
    ("block", ("bets",), r"[^/]*\bbets\b"),
    ("block", ("lottery",), r"[^/]*\blottery\b"),
    ("block", ("pills",), r"[^/]*\bpills\b"),
    ("block", ("viagra",), r"[^/]*\bviagra\b"),
    ("block", ("pharmacy", "cheap"), r"[^/]*\bcheap\b.*\bpharmacy\b|[^/]*\bpharmacy\b.*\bcheap\b"),
    ("block", ("xxx",), r"[^/]*\bxxx\b"),
    ("block", ("porn",), r"[^/]*\bporn\b"),
    ("block", ("adult",), r"(?:[^/]*[.-])?adult[.-]"),
    ("block", ("torrent",), r"[^/]*\btorrent\b"),
    ("block", ("warez",), r"[^/]*\bwarez\b"),
    ("block", ("doubleclick",), r"(?:[^/]*\.)?doubleclick\."),
    ("block", ("adserver",), r"[^/]*\badserver\b"),
    ("block", ("ads",), r"(?:[^/]*\.)?ads\."),
    ("block", ("banner",), r".*/banner/"),
    ("block", ("popunder",), r".*\bpopunder\b"),
    ("block", ("clickbait",), r"[^/]*\bclickbait\b"),
    ("block", ("wp", "login", "php"), r".*/wp-login\.php"),
    ("block", ("wp", "admin"), r".*/wp-admin/"),
    ("block", ("cgi", "bin"), r".*/cgi-bin/"),
    ("block", ("feed",), r".*/feed/?$"),
    ("block", ("login",), r".*/login(?:/|\.|$)"),
    ("block", ("signup",), r".*/signup(?:/|\.|$)"),
    ("block", ("cart",), r".*/cart(?:/|$)"),
    ("block", ("checkout",), r".*/checkout(?:/|$)"),
    ("block", ("tag",), r".*/tag/"),
    ("block", ("calendar",), r".*/calendar/\d{4}"),
    ("block", ("xn",), r"(?:[^/]*\.)?xn--"),
)


def method_rules() -> list[UrlRule]:
    """The patterns that decide what no page rule fits."""
    return [
        UrlRule(f"{verdict}:{regex}", verdict, regex, tokens, len(PATTERNS) - i)
        for i, (verdict, tokens, regex) in enumerate(PATTERNS)
    ]


def host_and_path(url: bytes) -> tuple[bytes, bytes]:
    head, found, rest = url.partition(b"://")
    if not found:
        return b"", b""
    host = re.split(rb"[/?#]", rest, maxsplit=1)[0]
    return host.lower(), re.split(rb"[?#]", rest[len(host) :], maxsplit=1)[0]


def token_counts(pages: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many URLs each wanted token occurs; as many rows as the rules have tokens reach the driver."""
    lower = F.lower(F.col("url").cast("string"))
    tokens = F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit("([a-z0-9]+)"), F.lit(1)))).alias("token")
    counted = pages.select(tokens).where(F.col("token").isin(wanted)).groupBy("token").count()
    return {r["token"]: r["count"] for r in counted.collect()}


class RuleIndex:
    """Rules by their rarest token."""

    def __init__(self, rules: list[UrlRule], counts: dict[str, int]) -> None:
        self.by_token: dict[bytes, list[tuple[UrlRule, re.Pattern[bytes]]]] = defaultdict(list)
        self.always: list[tuple[UrlRule, re.Pattern[bytes]]] = []
        for rule in rules:
            entry = (rule, re.compile(rule.regex.encode(), re.DOTALL))
            if rule.tokens:
                rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
                self.by_token[rarest.encode()].append(entry)
            else:
                self.always.append(entry)

    def fitting(self, page: bytes) -> list[UrlRule]:
        """Rules that fit, found through the URL's tokens."""
        tokens = set(re.findall(TOKEN, page.lower()))
        candidates = [e for t in tokens for e in self.by_token.get(t, ())] + self.always
        return [rule for rule, regex in candidates if regex.match(page)]


def judged(index: RuleIndex, url: bytes) -> tuple:
    """host, path, page rule, pattern, verdict."""
    host, path = host_and_path(url)
    fits = index.fitting(host + path)
    page = max((r for r in fits if r.base), key=lambda r: (r.rank, r.text), default=None)
    pattern = max((r for r in fits if not r.base), key=lambda r: (r.rank, r.text), default=None)
    decides = page or pattern
    return (
        host,
        path,
        page.text if page else None,
        pattern.text if pattern else None,
        decides.verdict if decides else "allow",
    )


def filter_urls(pages: DataFrame, keep: list[str], rules: list[UrlRule] | None = None) -> DataFrame:
    """Columns ``keep`` of ``pages`` and for each ``url`` its host, path, rule, pattern and verdict.

    ``rules`` are read by every task, so they should number some thousands at most.
    """
    rules = [*PAGE_RULES, *method_rules()] if rules is None else rules
    counts = token_counts(pages, sorted({t for r in rules for t in r.tokens}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, counts)
        for batch in batches:
            rows = [judged(index, url) for url in byte_texts(batch.column(batch.num_columns - 1))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            made = [pa.array(c, pa.binary()).cast(pa.string()) for c in columns[:2]]
            made += [pa.array(c, pa.string()) for c in columns[2:]]
            names = [*(f"kept_{i}" for i in range(len(keep))), "host", "path", "rule", "pattern", "verdict"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    kept = [F.col(quoted(c)).alias(f"kept_{i}") for i, c in enumerate(keep)]
    rows = pages.select(*kept, F.col("url").cast("string").alias("url"))
    kinds = ", ".join(f"kept_{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    found = rows.mapInArrow(run, f"{kinds}, {SCHEMA}" if keep else SCHEMA)
    names = [F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)]
    return found.select(*names, "host", "path", "rule", "pattern", "verdict")
