"""Layer 1: spam features of a message, as narrow projections.

Every check adds to a score and may add lines to an ordered list.  All of them
are column expressions over one row, so the whole layer is one scan with no
shuffle; the stages below exist only so that values used twice (lower-cased
bodies, extracted URLs) are computed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions import constants as K
from threatloom.functions.identity import first_address
from threatloom.functions.patterns import any_of, unicode_regex, whole
from threatloom.functions.risk import risk_bucket
from threatloom.functions.text import count_of, let, strip, text
from threatloom.functions.urls import is_suspicious_url
from threatloom.params import DEFAULTS, Params


def _points(flag: Column, weight: float) -> Column:
    return F.when(flag, F.lit(float(weight))).otherwise(F.lit(0.0))


def _line(flag: Column, message: Column | str) -> Column:
    return F.when(flag, F.lit(message) if isinstance(message, str) else message).otherwise(F.lit(""))


def _lines(*lines: Column) -> Column:
    """Non-empty lines, in order."""
    return F.array_remove(F.array(*lines), "")


# --- subject ------------------------------------------------------------------


def is_shouting(subject: Column) -> Column:
    """Some upper-case letter, no lower- or title-case letter, more than 10 characters."""
    cased = subject.rlike(r"\p{IsUppercase}") & ~subject.rlike(r"[\p{IsLowercase}\p{Lt}]")
    return cased & (F.length(subject) > 10)


def mentions_money(subject_lower: Column) -> Column:
    """A dollar amount, or a number followed by a currency word."""
    return subject_lower.rlike(unicode_regex(K.MONEY_PATTERN))


def keyword_groups(subject_lower: Column, groups: Sequence[str] = K.SPAM_KEYWORD_GROUPS) -> Column:
    """Patterns of the keyword groups found, each once, in first-seen order."""

    def group_of(token: Column) -> Column:
        out = F.when(token.rlike(whole(groups[0])), F.lit(groups[0]))
        for pattern in groups[1:]:
            out = out.when(token.rlike(whole(pattern)), F.lit(pattern))
        return out

    tokens = F.regexp_extract_all(subject_lower, F.lit(any_of(list(groups))), F.lit(0))
    return F.array_distinct(F.transform(tokens, group_of))


def subject_checks(df: DataFrame, groups: Sequence[str] = K.SPAM_KEYWORD_GROUPS) -> DataFrame:
    """Adds ``subject_score`` and ``subject_indicators``."""
    subject = text(F.col("subject"))
    staged = df.withColumns(
        {
            "_shouting": is_shouting(subject),
            "_bangs": count_of(subject, "!") > 2,
            "_groups": keyword_groups(F.lower(subject), groups),
            "_money": mentions_money(F.lower(subject)),
        }
    )
    shouting, bangs, money = F.col("_shouting"), F.col("_bangs"), F.col("_money")
    found = F.col("_groups")
    named = F.transform(found, lambda g: F.concat(F.lit("Spam keyword in subject: "), g))
    return staged.withColumns(
        {
            "subject_score": _points(shouting, 1.0)
            + _points(bangs, 0.5)
            + F.size(found) * F.lit(1.5)
            + _points(money, 0.5),
            "subject_indicators": F.concat(
                _lines(_line(shouting, "Subject in all caps"), _line(bangs, "Excessive exclamation marks")),
                named,
                _lines(_line(money, "Money mentioned in subject")),
            ),
        }
    ).drop("_shouting", "_bangs", "_groups", "_money")


# --- body ---------------------------------------------------------------------


def extract_urls(lowered: Column) -> Column:
    """Every http(s) URL in a lower-cased text, duplicates kept."""
    pattern = F.lit("(?U)" + K.URL_PATTERN)
    none = F.array().cast("array<string>")
    return F.when(lowered.contains("http"), F.regexp_extract_all(lowered, pattern, F.lit(0))).otherwise(none)


def keyword_count(lowered: Column, groups: Sequence[str] = K.SPAM_KEYWORD_GROUPS) -> Column:
    """Non-overlapping keyword matches."""
    return F.regexp_count(lowered, F.lit(any_of(list(groups)))).cast("bigint")


def with_lowered_bodies(df: DataFrame) -> DataFrame:
    """Adds ``text_lower``, ``html_lower``."""
    return df.withColumns(
        {"text_lower": F.lower(text(F.col("body_text"))), "html_lower": F.lower(text(F.col("body_html")))}
    )


def with_urls(df: DataFrame) -> DataFrame:
    """Adds ``urls``: those of the text, then those of the HTML.

    The URL column feeds three checks; building it in its own projection keeps
    the pattern scan from running once per check.
    """
    return df.withColumn("urls", F.concat(extract_urls(F.col("text_lower")), extract_urls(F.col("html_lower"))))


def is_image_heavy(text_lower: Column, html_lower: Column) -> Column:
    """HTML with more than two images and nearly no text."""
    little = F.length(strip(text_lower)) < K.SHORT_BODY_CHARS
    # a short text strips to a short text, so only near-empty bodies pay for it
    return (html_lower != "") & (F.regexp_count(html_lower, F.lit("<img")) > 2) & little


def has_hidden_text(html_lower: Column) -> Column:
    """Tiny fonts, or white text on white."""
    gate = html_lower.contains("font-size:") | html_lower.contains("color:")
    # the dot stops at a line feed only
    return gate & html_lower.rlike("(?Ud)" + K.HIDDEN_TEXT_PATTERN)


def body_checks(df: DataFrame, groups: Sequence[str] = K.SPAM_KEYWORD_GROUPS) -> DataFrame:
    """Adds ``keyword_matches``, ``body_score`` and ``body_indicators``."""
    low, html = F.col("text_lower"), F.col("html_lower")
    staged = df.withColumns(
        {
            "keyword_matches": keyword_count(low, groups) + keyword_count(html, groups),
            "_links": F.size("urls").cast("bigint"),
            "_images": is_image_heavy(low, html),
            "_hidden": has_hidden_text(html),
        }
    )
    matches, links = F.col("keyword_matches"), F.col("_links")
    images, hidden = F.col("_images"), F.col("_hidden")
    many = links > K.EXCESSIVE_LINKS
    return staged.withColumns(
        {
            "body_score": matches * F.lit(0.5) + _points(many, 1.0) + _points(images, 1.0) + _points(hidden, 2.0),
            "body_indicators": _lines(
                _line(matches > 0, F.concat(F.lit("Found "), matches, F.lit(" spam keyword matches"))),
                _line(many, F.concat(F.lit("Excessive links ("), links, F.lit(")"))),
                _line(images, "Image-heavy email with little text"),
                _line(hidden, "Hidden text detected"),
            ),
        }
    ).drop("_links", "_images", "_hidden")


# --- URLs ---------------------------------------------------------------------


def grouped_by_first_seen(items: Column) -> Column:
    """Same items, equal ones side by side, groups in first-seen order.

    Sort by (item, position), cut into runs, sort the runs by their first
    position: n log n, whatever the number of distinct items.
    """

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        heads = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda j: (j == 0)
            | (F.get(ordered, F.greatest(j - 1, F.lit(0)))["item"] != F.get(ordered, j)["item"]),
        )
        return let(
            heads,
            lambda h: F.transform(
                h,
                lambda start, k: F.struct(
                    F.get(ordered, start)["at"].alias("at"),
                    F.get(ordered, start)["item"].alias("item"),
                    (F.coalesce(F.get(h, k + 1), n) - start).alias("times"),
                ),
            ),
        )

    placed = F.transform(items, lambda x, i: F.struct(x.alias("item"), i.alias("at")))
    grouped = F.array_sort(let(F.array_sort(placed), runs))
    spread = F.flatten(F.transform(grouped, lambda g: F.array_repeat(g["item"], g["times"])))
    repeats = F.size(F.array_distinct(items)) < F.size(items)
    return F.when(repeats, spread).otherwise(items)


def url_checks(df: DataFrame) -> DataFrame:
    """Adds ``suspicious_urls`` and ``url_score`` from ``urls``.

    Each occurrence of a suspicious URL counts; a URL's verdict depends on its
    own text alone, so no dimension table, join or shuffle is needed.
    """
    none = F.array().cast("array<string>")
    flagged = F.when(F.size("urls") > 0, F.filter("urls", is_suspicious_url)).otherwise(none)
    return (
        df.withColumn("_flagged", flagged)
        .withColumns(
            {
                "suspicious_urls": F.when(
                    F.size("_flagged") > 1, grouped_by_first_seen(F.col("_flagged"))
                ).otherwise(F.col("_flagged")),
                "url_score": F.size("_flagged") * F.lit(0.5),
            }
        )
        .drop("_flagged")
    )


# --- headers ------------------------------------------------------------------


def header_values(name: str, headers: str = "headers") -> Column:
    """All values of one header, an empty array when it is absent."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.try_element_at(F.col(headers), F.lit(name)), none)


def spf_state(values: Column) -> Column:
    """``fail``, ``softfail`` or empty, over every Received-SPF value."""
    low = F.transform(values, F.lower)
    soft = F.exists(low, lambda v: v.contains("softfail"))
    hard = F.exists(low, lambda v: v.contains("fail") & ~v.contains("softfail"))
    # values joined by blanks cannot form a new "softfail", so per-value tests suffice
    return F.when(hard, "fail").when(soft, "softfail").otherwise("")


def spf_checks(df: DataFrame) -> DataFrame:
    """Adds ``spf_result``, ``spf_score``, ``spf_issues``."""
    out = df.withColumn("spf_result", spf_state(header_values("received-spf")))
    fail, soft = F.col("spf_result") == "fail", F.col("spf_result") == "softfail"
    return out.withColumns(
        {
            "spf_score": _points(fail, 2.0) + _points(soft, 1.0),
            "spf_issues": _lines(_line(fail, "SPF check failed"), _line(soft, "SPF soft fail")),
        }
    )


def auth_checks(df: DataFrame) -> DataFrame:
    """Adds ``auth_score``, ``auth_issues``; needs ``spf_result``."""
    joined = F.lower(F.array_join(header_values("authentication-results"), " "))
    staged = df.withColumn("_auth", joined)
    dkim = F.col("_auth").rlike("dkim=(?:fail|permerror|neutral)")
    spf = F.col("_auth").rlike("spf=(?:fail|permerror)") & (F.col("spf_result") != "fail")
    return staged.withColumns(
        {
            "auth_score": _points(dkim, 2.5) + _points(spf, 2.0),
            "auth_issues": _lines(
                _line(dkim, "DKIM verification failed (Authentication-Results)"),
                _line(spf, "SPF verification failed (Authentication-Results)"),
            ),
        }
    ).drop("_auth")


def dkim_checks(df: DataFrame) -> DataFrame:
    """Adds ``dkim_score``, ``dkim_issues``."""
    absent = F.size(header_values("dkim-signature")) == 0
    return df.withColumns(
        {"dkim_score": _points(absent, 0.5), "dkim_issues": _lines(_line(absent, "Missing DKIM signature"))}
    )


def missing_header_checks(df: DataFrame) -> DataFrame:
    """Adds ``missing_score``, ``missing_issues``."""
    gone = {h: ~F.map_contains_key("headers", F.lit(h.lower())) for h in K.REQUIRED_HEADERS}
    score = F.lit(0.0)
    for flag in gone.values():
        score = score + _points(flag, 0.5)
    issues = [_line(flag, f"Missing {h} header") for h, flag in gone.items()]
    return df.withColumns({"missing_score": score, "missing_issues": _lines(*issues)})


def hop_checks(df: DataFrame) -> DataFrame:
    """Adds ``hops``, ``hop_score``, ``hop_issues``."""
    out = df.withColumn("hops", F.size(header_values("received")).cast("bigint"))
    many = F.col("hops") > K.EXCESSIVE_HOPS
    return out.withColumns(
        {"hop_score": _points(many, 1.0), "hop_issues": _lines(_line(many, "Excessive hops in delivery path"))}
    )


def forged_sender_checks(df: DataFrame) -> DataFrame:
    """Adds ``forged_score``, ``forged_issues``."""
    senders, returns = header_values("from"), header_values("return-path")
    staged = df.withColumns(
        {
            "_several": F.size(senders) > 1,
            "_from": first_address(F.get(senders, F.lit(0))),
            "_return": first_address(F.get(returns, F.lit(0))),
        }
    )
    several = F.col("_several")
    differ = (F.col("_from") != "") & (F.col("_return") != "") & (F.col("_from") != F.col("_return"))
    return staged.withColumns(
        {
            "forged_score": _points(several, 2.0) + _points(differ, 1.5),
            "forged_issues": _lines(
                _line(several, "Multiple From headers detected"),
                _line(differ, "From and Return-Path mismatch"),
            ),
        }
    ).drop("_several", "_from", "_return")


_HEADER_PARTS = ("spf", "auth", "dkim", "missing", "hop", "forged")


def header_checks(df: DataFrame) -> DataFrame:
    """Adds ``header_score``, ``header_issues``: the six checks in fixed order."""
    staged = df
    for check in (
        spf_checks,
        auth_checks,
        dkim_checks,
        missing_header_checks,
        hop_checks,
        forged_sender_checks,
    ):
        staged = check(staged)
    score = F.lit(0.0)
    for part in _HEADER_PARTS:
        score = score + F.col(f"{part}_score")
    issues = F.concat(*[F.col(f"{part}_issues") for part in _HEADER_PARTS])
    helpers = [f"{p}_{kind}" for p in _HEADER_PARTS for kind in ("score", "issues")]
    return staged.withColumns({"header_score": score, "header_issues": issues}).drop(
        *helpers, "spf_result", "hops"
    )


# --- sender -------------------------------------------------------------------


def is_titled_freemail(sender_lower: Column) -> Column:
    """A corporate title in the sender, and a free-mail domain or sub-domain."""
    domain = F.regexp_extract(sender_lower, unicode_regex(K.ADDRESS_DOMAIN_PATTERN), 1)
    titled = sender_lower.rlike("|".join(K.CORPORATE_TITLES))
    free = domain.rlike(r"(?:\A|\.)(?:" + "|".join(K.FREEMAIL_DOMAINS).replace(".", r"\.") + r")\z")
    return titled & free


def has_odd_display_name(sender_lower: Column) -> Column:
    """The text before ``<`` holds an ``@`` or a dot."""
    name = F.substring_index(sender_lower, "<", 1)
    return (F.instr(sender_lower, "<") > 1) & (name.contains("@") | name.contains("."))


def sender_checks(df: DataFrame) -> DataFrame:
    """Adds ``sender_score``, ``sender_indicators``."""
    sender = F.lower(text(F.col("sender")))
    staged = df.withColumns({"_titled": is_titled_freemail(sender), "_odd": has_odd_display_name(sender)})
    titled, odd = F.col("_titled"), F.col("_odd")
    return staged.withColumns(
        {
            "sender_score": _points(titled, 1.5) + _points(odd, 1.0),
            "sender_indicators": _lines(
                _line(titled, "Corporate title with freemail provider"),
                _line(odd, "Suspicious display name format"),
            ),
        }
    ).drop("_titled", "_odd")


# --- layer --------------------------------------------------------------------


def spam_layer(
    emails: DataFrame, params: Params = DEFAULTS, groups: Sequence[str] = K.SPAM_KEYWORD_GROUPS
) -> DataFrame:
    """Adds ``spam``: score, risk level and the three lists of findings.

    A switched-off check is left out of the plan, not evaluated and ignored.
    """
    kept = emails.columns
    staged = subject_checks(emails, groups)
    staged = body_checks(with_urls(with_lowered_bodies(staged)), groups)
    none = F.array().cast("array<string>")
    score = F.col("subject_score") + F.col("body_score")
    urls, issues = none, none
    if params.check_urls:
        staged = url_checks(staged)
        score, urls = score + F.col("url_score"), F.col("suspicious_urls")
    if params.check_headers:
        staged = header_checks(staged)
        score, issues = score + F.col("header_score"), F.col("header_issues")
    staged = sender_checks(staged)
    score = score + F.col("sender_score")
    indicators = F.concat("subject_indicators", "body_indicators", "sender_indicators")
    staged = staged.withColumn("_score", score)
    return staged.select(
        *kept,
        F.struct(
            F.col("_score").alias("score"),
            risk_bucket(F.col("_score"), params.spam_threshold, params.spam_threshold * 2).alias("risk_level"),
            indicators.alias("indicators"),
            urls.alias("suspicious_urls"),
            issues.alias("header_issues"),
        ).alias("spam"),
    )
