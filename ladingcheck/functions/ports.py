"""Port values: codes, alternatives, countries, and equality under the code policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ladingcheck import constants as K
from ladingcheck.functions.text import let, literal_map, lookup, nfkc, normalize_party, strip


def port_alternatives(c: Column) -> Column:
    return F.coalesce(c.rlike(K.PORT_ALTERNATIVES), F.lit(False))


def port_code(c: Column) -> Column:
    """Five letters in parentheses, upper-cased, or NULL."""
    return F.upper(F.nullif(F.regexp_extract(nfkc(c), K.PORT_CODE, 1), F.lit("")))


def place_without_code(c: Column) -> Column:
    return normalize_party(F.regexp_replace(c, K.PORT_CODE, " "))


def port_code_state(c: Column) -> Column:
    def compare(known):
        return (
            F.when(known["code"].isNull(), "absent")
            .when(known["expected"].isNull(), "unestablished")
            .when(known["code"] == known["expected"], "corpus_convention")
            .otherwise("contradicted")
        )

    expected = lookup(K.PORT_CODES, place_without_code(c))
    return let(F.struct(port_code(c).alias("code"), expected.alias("expected")), compare)


def port_key(c: Column, approved: bool = K.PORT_TABLE_APPROVED) -> Column:
    """Place text two values may be compared on; NULL when the code is significant."""
    if not approved:
        return F.when(port_code(c).isNull(), normalize_party(c))
    return let(port_code_state(c), lambda state: (
        F.when(state == "absent", normalize_party(c))
        .when(state == "corpus_convention", place_without_code(c))))


def port_equal(left: Column, right: Column, approved: bool = K.PORT_TABLE_APPROVED) -> Column:
    left_code, right_code = port_code(left), port_code(right)
    same_text = normalize_party(left) == normalize_party(right)
    same_place = port_key(left, approved) == port_key(right, approved)
    codes_differ = F.coalesce(left_code != right_code, F.lit(False))
    return same_text | F.coalesce(same_place & ~codes_differ, F.lit(False))


def countries(c: Column) -> Column:
    """Sorted alpha-2 codes of country names that are whole tokens of the value."""
    tokens = F.transform(F.split(normalize_party(c), "[,/()]"), strip)
    names = F.array(*[F.lit(n) for n in K.COUNTRY_ALPHA2])
    table = literal_map(K.COUNTRY_ALPHA2)
    found = F.transform(F.array_intersect(tokens, names), lambda n: table[n])
    return F.array_sort(F.array_distinct(found))
