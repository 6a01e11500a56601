"""URL expressions: parts, host reputation, redaction, outbound audit.

A URL is split by one anchored expression into scheme, authority, path, query
and fragment.  Texts with unbalanced brackets in the authority do not parse.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom.functions import constants as K
from threatloom.functions.patterns import unicode_regex
from threatloom.functions.text import let, text

_SPLIT = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_HAS_AUTHORITY = r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
_BRACKET_HOST = r"\A(?:[^\[\]]*@)?\[([0-9A-Fa-f:.]+)\](?::[^\[\]]*)?\z"


# characters that compatibility normalisation turns into a separator; an
# authority that holds one does not parse.  All of them lie in the first plane.
_LOOKALIKES = "".join(
    chr(c) for c in range(0x80, 0x10000) if set(unicodedata.normalize("NFKC", chr(c))) & set("/?#@:")
)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SPLIT, group)


def _authority_ok(authority: Column) -> Column:
    balanced = ~authority.rlike(r"[\[\]]") | authority.rlike(_BRACKET_HOST)
    return balanced & ~authority.rlike(f"[{_LOOKALIKES}]")


def _host(authority: Column) -> Column:
    """Lower-cased host of an authority, without user and port."""
    bare = F.regexp_replace(F.substring_index(authority, "@", -1), r"(?s):.*\z", "")
    bracketed = F.regexp_extract(authority, _BRACKET_HOST, 1)
    return F.lower(F.when(authority.contains("["), bracketed).otherwise(bare))


def url_host(url: Column) -> Column:
    """Lower-cased host; empty when absent, null when the URL does not parse."""
    return let(_part(url, 2), lambda authority: F.when(_authority_ok(authority), _host(authority)))


def is_suspicious_url(url: Column) -> Column:
    """Shortener, bare IPv4 or overlong label anywhere in the host."""
    pattern = "(?U)" + "|".join(f"(?:{unicode_regex(p)[4:]})" for p in K.SUSPICIOUS_HOST_PATTERNS)
    return F.coalesce(url_host(url).rlike(pattern), F.lit(False))


def _decode(col: Column) -> Column:
    """Percent-decode; a ``%`` that opens no escape stays as it is."""
    return F.url_decode(F.regexp_replace(col, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(col: Column) -> Column:
    return F.replace(F.replace(F.url_encode(col), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _key_is_sensitive(key: Column) -> Column:
    return F.find_in_set(F.lower(key), F.lit(",".join(K.SENSITIVE_URL_KEYS))) > 0


def _pairs(query: Column) -> Column:
    """``array<struct<k,v>>`` of decoded pairs, in order, blanks kept."""

    def pair(piece: Column) -> Column:
        key = F.substring_index(piece, "=", 1)
        value = F.substring(piece, F.length(key) + 2, F.length(piece))
        return F.struct(_decode(key).alias("k"), _decode(value).alias("v"))

    return F.transform(F.array_remove(F.split(query, "&", -1), ""), pair)


def _rewritten_query(pairs: Column) -> Column:
    """Pairs grouped by key in first-seen order, sensitive keys reduced to one marker."""

    def rewrite(found: Column) -> Column:
        def of_key(key: Column) -> Column:
            values = F.transform(
                F.filter(found, lambda p: p["k"] == key),
                lambda p: F.concat(_encode(key), F.lit("="), _encode(p["v"])),
            )
            hidden = F.array(F.concat(_encode(key), F.lit("=" + K.REDACTED_ENCODED)))
            return F.when(_key_is_sensitive(key), hidden).otherwise(values)

        keys = F.array_distinct(F.transform(found, lambda p: p["k"]))
        return F.array_join(F.flatten(F.transform(keys, of_key)), "&")

    return let(pairs, rewrite)


def _joined(url: Column, authority: Column, path: Column, query: Column) -> Column:
    scheme, fragment = F.lower(_part(url, 1)), _part(url, 5)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(url.rlike(_HAS_AUTHORITY), F.concat(F.lit("//"), authority)).otherwise(""),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def _has_sensitive_param(url: Column) -> Column:
    """Cheap test first: most URLs have no query at all."""
    return F.exists(_pairs(_part(url, 4)), lambda p: _key_is_sensitive(p["k"]))


def _redacted_query(url: Column) -> Column:
    """New query text when some key is sensitive, else the query as it is."""
    query = _part(url, 4)
    return F.when(
        url.contains("?") & _has_sensitive_param(url),
        _rewritten_query(_pairs(query)),
    ).otherwise(query)


def redact_url_params(url: Column) -> Column:
    """Hide the values of sensitive query keys; untouched URLs come back unchanged."""
    url = text(url)
    hide = url.contains("?") & _authority_ok(_part(url, 2)) & _has_sensitive_param(url)
    return F.when(hide, _joined(url, _part(url, 2), _part(url, 3), _redacted_query(url))).otherwise(url)


def _redacted_authority(authority: Column) -> Column:
    """Replace a non-empty password by a marker."""
    user_info = F.regexp_extract(authority, r"(?s)\A(.*)@[^@]*\z", 1)
    user = F.substring_index(user_info, ":", 1)
    host_port = F.substring_index(authority, "@", -1)
    has_password = user_info.rlike(r"(?s)\A[^:]*:.")
    shown = F.concat(user, F.lit(":" + K.REDACTED + "@"), host_port)
    return F.when(has_password, shown).otherwise(authority)


def _redacted_path(host: Column, path: Column) -> Column:
    """Hide the token of a chat webhook path: its last segment, if five or more."""

    def on(domain: str, prefix: str) -> Column:
        at_home = (host == "") | (host == domain) | host.endswith("." + domain)
        return path.startswith(prefix) & at_home

    hook = on("slack.com", "/services/") | on("discord.com", "/api/webhooks/")
    long_enough = F.size(F.split(path, "/", -1)) >= 5
    hidden = F.concat(F.regexp_replace(path, r"[^/]*\z", ""), F.lit(K.REDACTED))
    return F.when(hook & long_enough, hidden).otherwise(path)


def redact_url_secrets(url: Column) -> Column:
    """Hide sensitive parameters, passwords and chat webhook tokens."""
    url = text(url)

    def shown(authority: Column) -> Column:
        rebuilt = _joined(
            url,
            _redacted_authority(authority),
            let(_part(url, 3), lambda path: _redacted_path(_host(authority), path)),
            _redacted_query(url),
        )
        return F.when((url == "") | ~_authority_ok(authority), url).otherwise(rebuilt)

    return let(_part(url, 2), shown)


def url_for_display(url: Column) -> Column:
    """Secrets hidden as by ``redact_url_secrets``, the encoded marker shown in clear."""
    return F.regexp_replace(redact_url_secrets(url), "%5[bB]REDACTED%5[dD]", K.REDACTED)


def redact_urls_in_text(col: Column) -> Column:
    """Redact every URL-like span inside free text.

    The text is cut into what lies between the spans and the spans themselves,
    each is redacted by itself, and the pieces are joined: linear in the text.
    """
    pattern = "(?U)" + K.TEXT_URL_PATTERN

    def shown(found: Column, behind: Column) -> Column:
        url = F.regexp_replace(found, r"[.,;:)']+\z", "")
        return F.concat(redact_url_secrets(url), F.substring(found, F.length(url) + 1, F.length(found)), behind)

    def spliced(between: Column) -> Column:
        spans = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
        pieces = F.zip_with(spans, F.slice(between, F.lit(2), F.size(between) - 1), shown)
        return F.concat(F.get(between, F.lit(0)), F.array_join(pieces, ""))

    col = text(col)
    return F.when(col.rlike(pattern), let(F.split(col, pattern, -1), spliced)).otherwise(col)


# --- outbound audit -----------------------------------------------------------

# fixed values: IPv4 ranges (first address, last address, label), first match wins
_V4_RANGES = [
    ("127.0.0.0", "127.255.255.255", "loopback"),
    ("0.0.0.0", "0.255.255.255", "private IP"),
    ("10.0.0.0", "10.255.255.255", "private IP"),
    ("169.254.0.0", "169.254.255.255", "private IP"),
    ("172.16.0.0", "172.31.255.255", "private IP"),
    ("192.0.0.0", "192.0.0.8", "private IP"),
    ("192.0.0.11", "192.0.0.255", "private IP"),
    ("192.0.2.0", "192.0.2.255", "private IP"),
    ("192.168.0.0", "192.168.255.255", "private IP"),
    ("198.18.0.0", "198.19.255.255", "private IP"),
    ("198.51.100.0", "198.51.100.255", "private IP"),
    ("203.0.113.0", "203.0.113.255", "private IP"),
    ("240.0.0.0", "255.255.255.255", "private IP"),
    ("224.0.0.0", "239.255.255.255", "multicast"),
]
# fixed values: IPv6 prefixes by leading text of the literal (pattern, label)
_V6_FORMS = [
    (r"\A(?:0{0,4}:){1,7}0{0,3}1\z", "loopback"),
    (r"\A(?:0{0,4}:){1,7}0{0,4}\z", "private IP"),
    (r"\Af[cd][0-9a-f]{2}:", "private IP"),
    (r"\A2001:0?db8:", "private IP"),
    (r"\A0?100::", "private IP"),
    (r"\Afe[89ab][0-9a-f]:", "private IP"),
    (r"\Aff[0-9a-f]{2}:", "multicast"),
    (r"\A(?:::|0{1,4}:|[0-9a-f]{1,2}:)", "reserved"),
]
_V4 = r"\A(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\z"


def _v4_number(dotted: str) -> int:
    a, b, c, d = (int(x) for x in dotted.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def _v4_label(host: Column) -> Column:
    octets = F.transform(F.split(host, r"\."), lambda o: o.cast("bigint"))

    def judge(o: Column) -> Column:
        number = F.aggregate(o, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
        return let(number, lambda n: _in_ranges(n, F.array_max(o) > 255))

    return let(octets, judge)


def _in_ranges(number: Column, bad: Column) -> Column:
    out = F.when(bad, F.lit("invalid IP"))
    for low, high, label in _V4_RANGES:
        out = out.when(number.between(_v4_number(low), _v4_number(high)), F.lit(label))
    return out.otherwise(F.lit(""))


def _v6_label(host: Column) -> Column:
    mapped = F.regexp_extract(host, r"\A::ffff:(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\z", 1)
    out = F.when(mapped != "", _v4_label(mapped))
    for form, label in _V6_FORMS:
        out = out.when(host.rlike(form), F.lit(label))
    return out.otherwise(F.lit(""))


def outbound_verdict(url: Column) -> Column:
    """Empty when a URL may be called, otherwise the reason it may not.

    Only what the text itself says is judged: scheme, host and literal
    addresses.  Host names are not resolved.
    """

    def judge(authority: Column) -> Column:
        label = let(
            _host(authority),
            lambda host: F.when(host == "", F.lit("none"))
            .when(host.rlike(_V4), _v4_label(host))
            .when(authority.contains("["), _v6_label(host))
            .otherwise(F.lit("")),
        )
        named = let(
            label,
            lambda found: F.when(found == "none", F.lit("URL must contain a valid hostname"))
            .when(found != "", F.concat(F.lit("address is "), found))
            .otherwise(F.lit("")),
        )
        scheme = F.lower(_part(url, 1))
        return (
            F.when(~_authority_ok(authority), F.lit("URL does not parse"))
            .when(scheme != "https", F.concat(F.lit("scheme must be https, got: "), scheme))
            .otherwise(named)
        )

    url = text(url)
    return F.when(url == "", F.lit("URL is empty")).otherwise(let(_part(url, 2), judge))
