"""From a label as written to one of the seven canonical fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ladingcheck import constants as K
from ladingcheck.functions.text import casefold, collapse, let, literal_map, nfkc, non_ascii, trimmed

_ALIASES = {alias: field for field, aliases in K.FIELD_ALIASES.items() for alias in aliases}
# Words at least one of which occurs in every alias.
_ALIAS_HINT = r"shipper|exporter|consignee|order of|notify|port|pol|pod|container|gross"
_QUALIFIER = rf"[(]|{K.CJK}"


def normalize_label(c: Column) -> Column:
    return F.btrim(collapse(trimmed(casefold(nfkc(c)))), F.lit(" .:;-"))


def _derived(base: Column) -> Column:
    """All forms of a normalised label that carries a qualifier."""
    def without_qualifiers(v: Column) -> Column:
        return normalize_label(F.regexp_replace(v, rf"[{K.WS}]*\([^)]*\)", ""))

    def spaced(v: Column) -> Column:
        return normalize_label(F.replace(v, F.lit("("), F.lit(" (")))

    scripts = F.array(base, normalize_label(F.regexp_replace(base, K.CJK, "")))
    bare = F.flatten(F.transform(scripts, lambda v: F.array(v, without_qualifiers(v))))
    forms = F.flatten(F.transform(bare, lambda v: F.array(v, spaced(v))))
    return F.filter(F.array_distinct(forms), lambda v: v != "")


def _variants_of(base: Column) -> Column:
    """Most labels have no qualifier and stand for themselves."""
    return (
        F.when(base.rlike(_QUALIFIER), _derived(base))
        .when(base == "", F.array().cast("array<string>")).otherwise(F.array(base))
    )


def label_variants(label: Column) -> Column:
    """The normalised label and the forms left after dropping its qualifiers."""
    return let(normalize_label(F.coalesce(label, F.lit(""))), _variants_of)


def match_variants(variants: Column) -> Column:
    """Field of the longest alias among the variants, or NULL."""
    table = literal_map(_ALIASES)
    hits = F.filter(
        F.transform(
            variants,
            lambda v: F.struct(F.length(v).alias("n"), F.try_element_at(table, v).alias("field")),
        ),
        lambda h: h["field"].isNotNull(),
    )
    return F.array_max(hits)["field"]


def match_field(label: Column) -> Column:
    """Canonical field named by a label, or NULL.

    A label that is an alias as it stands needs no variants: dropping qualifiers
    from any listed alias leads to the same field. Labels without any alias word
    cannot match and are not normalised at all, nor are ASCII labels that are an
    alias but for their case.
    """
    def decide(base):
        own = F.try_element_at(literal_map(_ALIASES), base)
        return F.coalesce(own, F.when(base.rlike(_QUALIFIER), match_variants(_derived(base))))

    possible = label.rlike(rf"(?i)[^\x00-\x7F]|{_ALIAS_HINT}")
    written = F.when(~non_ascii(label), F.try_element_at(literal_map(_ALIASES), F.lower(label)))
    return F.when(possible, F.coalesce(written, let(normalize_label(label), decide)))


def contains_any(variants: Column, words: tuple[str, ...]) -> Column:
    pattern = "|".join(re.escape(w) for w in words)
    return F.exists(variants, lambda v: v.rlike(pattern))


def negative_for(field: Column, variants: Column) -> Column:
    """The label is a known wrong source for the field and no alias of it."""
    out = F.lit(False)
    for name, words in K.NEGATIVE_LABELS.items():
        negative = contains_any(variants, words)
        own = F.arrays_overlap(variants, F.array(*[F.lit(a) for a in K.FIELD_ALIASES[name]]))
        out = F.when(field == name, negative & ~own).otherwise(out)
    return out


def is_ambiguous_count(variants: Column) -> Column:
    return F.arrays_overlap(variants, F.array(*[F.lit(x) for x in K.AMBIGUOUS_COUNT_LABELS]))


def is_total(variants: Column) -> Column:
    return contains_any(variants, K.TOTAL_MARKERS)


def declares_kg(variants: Column) -> Column:
    return F.exists(variants, lambda v: v.rlike(K.LABEL_KG))


def declares_tonnes(variants: Column) -> Column:
    return F.exists(variants, lambda v: v.rlike(K.LABEL_TONNES))
