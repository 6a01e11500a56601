"""Text expressions: counting, trimming, sanitising, truncating, escaping."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.functions import constants as K

# whitespace as a text strip understands it, including the four separators
# U+001C..U+001F that the JVM leaves out of \s
SPACE = r"[\s\x1C-\x1F]"
# everything that is neither printable, nor a tab, nor a space separator
UNPRINTABLE = r"(?!\t)[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}]"
# letters and punctuation that compatibility normalisation leaves alone
_STABLE = r"\x00-\x7F¡-§©«¬®°±¶·»¿-ıĴ-ľŁ-ňŊ-ž–—‘-„†‡•‰‹›€"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text(col: Column) -> Column:
    """Null-safe text: null becomes the empty text."""
    return F.coalesce(col, F.lit(""))


def count_of(col: Column, piece: str) -> Column:
    """Occurrences of a one-character ``piece``."""
    return (F.length(col) - F.length(F.replace(col, F.lit(piece), F.lit("")))).cast("bigint")


def strip(col: Column) -> Column:
    """Remove whitespace on both ends."""
    return F.regexp_replace(col, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def truncate_text(col: Column, width: int) -> Column:
    """Cut to ``width`` characters, the last three being dots."""
    if width <= 3:
        short = F.lit("." * max(width, 0))
    else:
        short = F.concat(F.left(col, F.lit(width - 3)), F.lit("..."))
    col = text(col)
    return F.when(F.length(col) > width, short).otherwise(col)


def strip_ansi(col: Column) -> Column:
    """Drop terminal escape sequences."""
    return F.when(col.contains("\x1b"), F.regexp_replace(col, K.ANSI_PATTERN, "")).otherwise(col)


def drop_unprintable(col: Column) -> Column:
    """Drop control, format, private, unassigned and line-separator characters; keep tabs."""
    return F.regexp_replace(col, UNPRINTABLE, "")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def normalize_compat(col: Column) -> Column:
    """Compatibility-normalised text.

    Spark has no such built-in.  Only texts holding a character that could
    change are handed to the Arrow worker; all others pass as nulls.
    """
    changed = F.when(col.rlike(f"[^{_STABLE}]"), col)
    return F.coalesce(_nfkc(changed), col)


def clean_log_text(col: Column) -> Column:
    """Escape line breaks, drop terminal sequences and unprintable characters."""
    one_line = F.replace(F.replace(col, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return drop_unprintable(strip_ansi(one_line))


def at_most(value: Column, chars: int | None) -> Column:
    """The first ``chars`` characters; all of them for None."""
    return value if chars is None else F.left(value, F.lit(chars))


def cut_log_text(col: Column, max_chars: int | None) -> Column:
    """Cut to ``max_chars`` and mark the cut with dots."""
    if max_chars is None:
        return col
    if max_chars <= 0:
        return F.when(col == "", F.lit("")).otherwise(F.lit("..."))
    cut = F.concat(F.left(col, F.lit(max_chars)), F.lit("..."))
    return F.when(F.length(col) > max_chars, cut).otherwise(col)


def sanitize_log(col: Column, max_chars: int | None = None, normalize: bool = True) -> Column:
    """Safe single-line log text: normalise, escape breaks, drop unprintables, cut."""
    col = text(col)
    base = normalize_compat(col) if normalize else col
    out = cut_log_text(clean_log_text(base), max_chars)
    return F.when(col == "", F.lit("")).otherwise(out) if max_chars is not None and max_chars <= 0 else out


def sanitize_text(col: Column, csv_safe: bool = False) -> Column:
    """Safe display text: breaks and tabs become blanks, unprintables go."""
    flat = F.translate(text(col), "\n\r\t", "   ")
    clean = drop_unprintable(strip_ansi(flat))
    return csv_guard(clean) if csv_safe else clean


def csv_guard(col: Column) -> Column:
    """Prefix a quote to text a spreadsheet would run as a formula."""
    col = text(col)
    risky = col.rlike(rf"(?U)\A{SPACE}*[=+\-@%|]") | col.rlike(r"\A[\t\r]")
    return F.when(risky, F.concat(F.lit("'"), col)).otherwise(col)


def chat_escape(col: Column) -> Column:
    """Display text with the three markup characters escaped."""
    out = sanitize_text(col)
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out
