"""Small regular-expression helpers whose positions are counted in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ladingcheck import constants as K
from ladingcheck.functions.text import non_ascii


def is_plain(text: Column) -> Column:
    """Only ASCII characters."""
    return ~non_ascii(text)


def plain_form(pattern: str) -> str:
    """The pattern without Unicode classes: the same matches on ASCII text, and faster."""
    flags, rest = pattern[2:].split(")", 1)
    return f"(?{flags.replace('U', '')}){rest}"


def found(text: Column, pattern: str, plain: Column) -> Column:
    """The pattern occurs in the text; ``plain`` says that the text is ASCII."""
    return F.when(plain, text.rlike(plain_form(pattern))).otherwise(text.rlike(pattern))


def around_first(text: Column, pattern: str, part: int) -> Column:
    """What precedes (1), makes up (2) or follows (3) the first match; '' without one.

    ``pattern`` must have no capturing groups. An extraction keeps its compiled
    pattern from row to row, which a split by a regular expression does not.
    """
    return F.regexp_extract(text, rf"\A([\s\S]*?)({pattern})([\s\S]*)\z", part)


def before_first(text: Column, pattern: str) -> Column:
    """Text before the first match (the whole text without one)."""
    return F.when(text.rlike(pattern), around_first(text, pattern, 1)).otherwise(text)


def quote_around(text: Column, pattern: str, width: int = 40) -> Column:
    """The first match with up to ``width`` characters on either side."""
    return F.btrim(F.concat(
        F.right(around_first(text, pattern, 1), F.lit(width)),
        around_first(text, pattern, 2),
        F.left(around_first(text, pattern, 3), F.lit(width)),
    ), F.lit(K.WS_CHARS))


def count_not_negated(text: Column, pattern: str) -> Column:
    """Number of matches that no negation precedes within the sentence.

    Without a negation word in the text this is a plain count. Otherwise the
    matches are walked in order with the characters before each of them.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
    start = F.struct(F.lit("").alias("seen"), F.lit(0).alias("n"))

    def step(acc, s):
        before = F.right(F.concat(acc["seen"], s["gap"]), F.lit(K.NEGATION_WINDOW))
        return F.struct(
            F.right(F.concat(before, s["hit"]), F.lit(K.NEGATION_WINDOW)).alias("seen"),
            (acc["n"] + F.when(before.rlike(K.NEGATED), 0).otherwise(1)).alias("n"),
        )

    walked = F.aggregate(steps, start, step, lambda acc: acc["n"])
    return (
        F.when(~text.rlike(pattern), 0)
        .when(~text.rlike(K.NEGATION_WORD), F.regexp_count(text, F.lit(pattern)))
        .otherwise(walked)
    )
