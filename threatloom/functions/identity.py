"""Address and file-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom.functions import constants as K
from threatloom.functions.patterns import unicode_regex
from threatloom.functions.text import at_most, sanitize_log, strip, text


def redact_email(col: Column, normalize: bool = True, max_chars: int | None = None) -> Column:
    """Keep the first letter and the domain of an address, star out the rest."""
    at = F.instr(col, "@")
    user = F.left(col, at - 1)
    rest = F.substring(col, at + 1, F.length(col))
    stars = (
        F.when(at == 1, F.lit("***"))
        .when(at == 2, F.lit("*"))
        .otherwise(F.concat(F.left(user, F.lit(1)), F.repeat(F.lit("*"), at - 2)))
    )
    shown = F.concat(stars, F.lit("@"), rest)
    return F.when(at == 0, col).otherwise(sanitize_log(shown, max_chars, normalize))


def email_valid(col: Column) -> Column:
    """Is this a plain, safe mailbox address?"""
    local = F.substring_index(col, "@", 1)
    domain = F.substring_index(col, "@", -1)
    labels = F.split(domain, r"\.", -1)
    shaped = (F.length(col) <= K.MAX_EMAIL_CHARS) & ~col.contains("..")
    shaped &= col.rlike("(?d)" + K.EMAIL_PATTERN)
    edges = ~local.rlike(r"\A[.\-]") & ~local.rlike(r"[.\-]\z")
    labelled = F.forall(labels, lambda x: (x != "") & ~x.rlike(r"\A[.\-]|[.\-]\z"))
    return F.coalesce(shaped & edges & labelled, F.lit(False))


def sanitize_filename(col: Column, max_chars: int | None = 255) -> Column:
    """Last path component, safe characters only, no hidden or reserved names.

    ``max_chars`` is what file systems take; None keeps names whole.
    """
    name = F.regexp_replace(text(col), r"(?s)\A.*[/\\]", "")
    name = F.regexp_replace(name, rf"(?U)[^\p{{L}}\p{{N}}_\s\x1C-\x1F\-.]", "")
    name = F.regexp_replace(name, r"\.{2,}", ".")
    name = F.btrim(name, F.lit(". "))
    base = F.upper(strip(F.substring_index(name, ".", 1)))
    name = F.when((F.find_in_set(base, F.lit(",".join(K.RESERVED_FILE_NAMES))) > 0), F.concat(F.lit("_"), name)).otherwise(name)
    return F.when(name == "", F.lit(K.UNNAMED_FILE)).otherwise(at_most(name, max_chars))


def type_extension(content_type: Column) -> Column:
    """Extension that fits a content type, ``.bin`` when none is known."""
    pairs = "|".join(f"{kind}={ext}" for kind, ext in K.TYPE_EXTENSIONS.items())
    known = F.str_to_map(F.lit(pairs), F.lit("[|]"), F.lit("="))
    return F.coalesce(F.try_element_at(known, content_type), F.lit(".bin"))


def fallback_filename(name: Column, content_type: Column, *key: Column) -> Column:
    """Sanitised name, or a generated one (stable per ``key``) when there is none."""
    clean = sanitize_filename(name)
    digest = F.left(F.sha2(F.concat_ws(":", *[k.cast("string") for k in key]), 256), F.lit(8))
    made = F.concat(F.lit(K.UNNAMED_FILE + "_"), digest, type_extension(content_type))
    usable = (strip(text(name)) != "") & (clean != K.UNNAMED_FILE)
    return F.when(usable, clean).otherwise(made)


def format_addresses(addresses: Column) -> Column:
    """Join ``array<struct<name,addr>>`` as ``Name <addr>, addr, ...``."""

    def one(a: Column) -> Column:
        name, addr = text(a["name"]), text(a["addr"])
        return (
            F.when((name != "") & (addr != ""), F.concat(name, F.lit(" <"), addr, F.lit(">")))
            .when(addr != "", addr)
            .otherwise(name)
        )

    return F.array_join(F.array_remove(F.transform(addresses, one), ""), ", ")


def sender_domain(sender: Column) -> Column:
    """Domain after the first ``@`` of a lower-cased sender, else empty."""
    return F.regexp_extract(F.lower(text(sender)), unicode_regex(K.SENDER_DOMAIN_PATTERN), 1)


def first_address(col: Column) -> Column:
    """First address-like token of a lower-cased text, else empty."""
    return F.regexp_extract(F.lower(text(col)), unicode_regex(K.ADDRESS_PATTERN), 0)


def path_traversal(path: Column) -> Column:
    """Absolute paths, parent references and drive letters."""
    return path.rlike(r"\A(?:[/\\]|\p{L}:)") | path.contains("..")

