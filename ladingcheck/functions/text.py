"""Text canonicalisation as Column expressions (no Python in the data path).

Compatibility normalisation (NFKC) and full case folding are reached through
Spark's SQL function ``reflect`` on the ICU library that ships with Spark. The
call sits in the non-ASCII branch only, so plain text never pays for it.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ladingcheck import constants as K

#: White space within ASCII, one by one: a class that is looked up, not searched.
_ASCII_WS = r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f]+"
_ASCII_WS_CHARS = "".join(c for c in K.WS_CHARS if c.isascii())

_DIGITS = [
    (chr(c), str(unicodedata.decimal(chr(c))))
    for c in range(0x80, sys.maxunicode + 1)
    if unicodedata.decimal(chr(c), None) is not None
]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, not once per mention.

    A fold over nothing: unlike the element of an array, its result is not copied.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def non_ascii(text: Column) -> Column:
    """Some character takes more than one byte."""
    return F.length(text) < F.octet_length(text)


def literal_map(mapping: dict[str, str]) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a small fixed mapping, NULL when absent."""
    if not mapping:
        return F.lit(None).cast("string")
    return F.try_element_at(literal_map(mapping), key)


def nfkc(c: Column) -> Column:
    def composed(x):
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    return let(c, lambda x: F.when(non_ascii(x), composed(x)).otherwise(x))


def casefold(c: Column) -> Column:
    def folded(x):
        return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))

    return let(c, lambda x: F.when(non_ascii(x), folded(x)).otherwise(F.lower(x)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(K.WS_CHARS))


def trimmed(c: Column) -> Column:
    """``strip`` within a row's folds: a trim looks each end up in all its characters, of which ASCII text needs few."""
    return let(c, lambda x: F.when(non_ascii(x), strip(x)).otherwise(F.btrim(x, F.lit(_ASCII_WS_CHARS))))


def collapse(c: Column) -> Column:
    return let(c, lambda x: F.when(non_ascii(x), F.regexp_replace(x, f"[{K.WS}]+", " ")).otherwise(
        F.regexp_replace(x, _ASCII_WS, " ")))


def fold_digits(c: Column) -> Column:
    """Decimal digits of other scripts become ASCII digits."""
    digits, values = "".join(d for d, _ in _DIGITS), "".join(v for _, v in _DIGITS)
    return let(c, lambda x: F.when(non_ascii(x), F.translate(x, digits, values)).otherwise(x))


def fold_quotes(c: Column) -> Column:
    return F.translate(c, K.QUOTE_VARIANTS, "'" * len(K.QUOTE_VARIANTS))


def line_ends(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def strip_html(c: Column) -> Column:
    """Tags to blanks, white space collapsed, trimmed."""
    return strip(collapse(F.regexp_replace(c, "<[^>]+>", " ")))


def is_missing(c: Column) -> Column:
    """NULL, blank, a run of filler characters or a placeholder word."""
    return c.isNull() | let(trimmed(nfkc(c)), lambda text: (
        (text == "") | text.rlike(K.PLACEHOLDER_RUN) | casefold(text).isin(*K.PLACEHOLDERS)))


def normalize_party(c: Column) -> Column:
    return F.btrim(casefold(trimmed(collapse(nfkc(c)))), F.lit(" ,;."))


def normalize_port(c: Column) -> Column:
    if not K.PORT_ALIASES:
        return normalize_party(c)
    return let(normalize_party(c), lambda place: F.coalesce(lookup(K.PORT_ALIASES, place), place))


def base_name(path: Column) -> Column:
    """Last component of a path; trailing separators are ignored."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def safe_filename(name: Column) -> Column:
    return let(F.regexp_replace(base_name(name), "[^a-zA-Z0-9_.-]", "_"), lambda clean: F.when(
        (clean == "") | clean.startswith("."),
        F.concat(F.lit("attachment_"), F.regexp_replace(clean, r"^\.+", "")),
    ).otherwise(clean))


def media_type(filename: Column) -> Column:
    suffix = F.lower(F.regexp_extract(filename, r"[^/.](\.[^./]+)$", 1))
    return F.coalesce(lookup(K.MEDIA_TYPES, suffix), F.lit(K.OCTET_STREAM))


def same_as_consignee(c: Column) -> Column:
    return strip(c).rlike(K.SAME_AS_CONSIGNEE)
