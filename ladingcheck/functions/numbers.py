"""Numbers, container counts and weights, read exactly or refused with a reason.

Results are canonical decimal *text* (no leading or trailing zeros), so equality
is exact at any precision; a DECIMAL or DOUBLE is made only for output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ladingcheck import constants as K
from ladingcheck.functions.matching import around_first
from ladingcheck.functions.text import (
    casefold, fold_digits, fold_quotes, let, nfkc, normalize_party, normalize_port, strip, trimmed,
)


def canonical(literal: Column) -> Column:
    def signed(source, digits):
        negative = source.startswith("-") & (digits != "0")
        return F.when(negative, F.concat(F.lit("-"), digits)).otherwise(digits)

    def digits_of(x):
        bare = F.regexp_replace(x, r"^[+-]?0*(?=\d)", "")
        return F.regexp_replace(F.regexp_replace(bare, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    return let(literal, lambda x: let(digits_of(x), lambda d: signed(x, d)))


def times_thousand(number: Column) -> Column:
    """Shift the decimal point of a canonical number three places to the right."""
    return let(number, _shift_point)


def _shift_point(number: Column) -> Column:
    whole = F.substring_index(number, ".", 1)
    part = F.when(number.contains("."), F.substring_index(number, ".", -1)).otherwise("")
    return canonical(F.concat(whole, F.rpad(F.substring(part, 1, 3), 3, "0"),
                              F.lit("."), F.substring(part, F.lit(4), F.length(part)), F.lit("0")))


def as_decimal(number: Column) -> Column:
    return number.try_cast("decimal(28,12)")


def _reading(number, reason=None, ambiguous=False) -> Column:
    return F.struct(
        (number if number is not None else F.lit(None)).cast("string").alias("number"),
        F.lit(reason).cast("string").alias("reason"),
        F.lit(ambiguous).alias("ambiguous"),
    )


def clean_number(token: Column) -> Column:
    text = fold_digits(trimmed(nfkc(token)))
    return F.regexp_replace(text, "[\\xa0' ]", "")


def parse_number(token: Column, policy: Column, convention: Column) -> Column:
    """struct(number, reason, ambiguous) of one numeric token.

    ``policy`` is auto, en, eu or ambiguous; ``convention`` is en, eu or ''.
    """
    return let(clean_number(token), lambda t: _parse_clean(t, policy, convention))


def _parse_clean(t: Column, policy: Column, convention: Column) -> Column:
    effective = F.when(policy == "auto", F.when(convention == "", "ambiguous").otherwise(convention)) \
        .otherwise(policy)
    # One separator and three digits after it: which of the two marks it is.
    grouping = F.when(effective == "en", ",").otherwise(".")
    lone = F.when(
        t.contains(grouping), F.regexp_replace(t, "[.,]", "")
    ).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    number = (
        F.when(t.rlike(r"^[+-]?\d+$"), t)
        .when(t.rlike(r"^[+-]?\d{1,3}(?:,\d{3})+\.\d+$"), F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike(r"^[+-]?\d{1,3}(?:\.\d{3})+,\d+$"), F.translate(t, ",.", "."))
        .when(t.rlike(r"^[+-]?\d{1,3}(?:(?:,\d{3}){2,}|(?:\.\d{3}){2,})$"),
              F.regexp_replace(t, "[.,]", ""))
        .when(t.rlike(r"^[+-]?\d+[.,](?!\d{3}$)\d+$"), F.replace(t, F.lit(","), F.lit(".")))
        .when(t.rlike(r"^[+-]?\d+[.,]\d{3}$") & (effective != "ambiguous"), lone)
    )
    return (
        F.when(F.coalesce(t, F.lit("")) == "", _reading(None, "EMPTY"))
        .when(~t.rlike(r"^[+-]?[\d.,]+$"), _reading(None, "NOT_NUMERIC"))
        .when(t.rlike(r"^[+-]?\d+[.,]\d{3}$") & (effective == "ambiguous"),
              _reading(None, "LONE_SEPARATOR_AMBIGUOUS", True))
        .when(number.isNull(), _reading(None, "MALFORMED_SEPARATORS"))
        .otherwise(_reading(canonical(number)))
    )


def parse_count(raw: Column, label_is_ambiguous: Column) -> Column:
    """struct(number, reason, ambiguous, terms) of a container count."""
    text = fold_digits(trimmed(fold_quotes(nfkc(F.coalesce(raw, F.lit(""))))))
    return let(text, lambda t: _parse_count(t, label_is_ambiguous))


def _parse_count(text: Column, label_is_ambiguous: Column) -> Column:
    counts = F.transform(F.regexp_extract_all(text, F.lit(K.COUNT_TERM), F.lit(1)),
                         lambda n: n.cast("bigint"))
    terms = F.regexp_extract_all(text, F.lit(K.COUNT_TERM), F.lit(0))
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n)
    bare = F.regexp_extract(text, K.COUNT_BARE, 1)
    one = F.array(text)

    def result(number, reason=None, ambiguous=False, used=None):
        return F.struct(
            (number if number is not None else F.lit(None)).cast("string").alias("number"),
            F.lit(reason).cast("string").alias("reason"),
            F.lit(ambiguous).alias("ambiguous"),
            (used if used is not None else F.array().cast("array<string>")).alias("terms"),
        )

    return (
        F.when(text == "", result(None, "EMPTY"))
        .when(F.exists(counts, lambda n: n <= 0), result(None, "NON_POSITIVE"))
        .when(F.size(counts) > 0, F.when(total > K.MAX_SAFE_INTEGER, result(None, "OUT_OF_RANGE"))
              .otherwise(result(total, used=terms)))
        .when((bare != "") & label_is_ambiguous & ~text.rlike(K.CONTAINER_TYPE),
              result(None, "NO_CONTAINER_CONTEXT", True))
        .when((bare != "") & (bare.cast("bigint") <= 0), result(None, "NON_POSITIVE"))
        .when(bare != "", result(bare.cast("bigint"), used=one))
        .otherwise(result(None, "UNRECOGNIZED_COUNT_FORMAT", True))
    )


def out_of_range(number: Column) -> Column:
    """Above the largest integer a JSON number carries exactly."""
    whole = F.substring_index(number, ".", 1)
    exact = whole.try_cast("decimal(20,0)")
    limit = F.lit(K.MAX_SAFE_INTEGER).cast("decimal(20,0)")
    return (F.length(whole) > 16) | (exact > limit) | ((exact == limit) & number.contains("."))


def parse_weight(raw: Column, label_kg: Column, label_tonnes: Column,
                 policy: Column, convention: Column) -> Column:
    """struct(number, unit, unit_from_label, reason, ambiguous); number in kilograms."""
    def parts(text):
        token = around_first(text, K.NUMBER_TOKEN, 2)
        rest = trimmed(F.concat(
            around_first(text, K.NUMBER_TOKEN, 1), F.lit(" "), around_first(text, K.NUMBER_TOKEN, 3)))
        unit = F.regexp_replace(F.regexp_extract(rest, K.UNIT_TOKEN, 0), f"[.{K.WS}]", "")
        return F.struct(
            text.alias("text"), token.alias("token"), casefold(unit).alias("unit"),
            parse_number(token, policy, convention).alias("reading"),
        )

    def with_kilograms(p):
        tonnes = p["unit"].isin(*K.TONNE_UNITS) | ((p["unit"] == "") & ~label_kg & label_tonnes)
        number = p["reading"]["number"]
        kilograms = F.when(tonnes, times_thousand(number)).otherwise(number)
        return let(kilograms, lambda kg: _weighed(p, kg, label_kg, label_tonnes))

    text = fold_digits(trimmed(nfkc(F.coalesce(raw, F.lit("")))))
    return let(let(text, parts), with_kilograms)


def _weighed(p: Column, kilograms: Column, label_kg: Column, label_tonnes: Column) -> Column:
    text, token, unit, reading = p["text"], p["token"], p["unit"], p["reading"]
    from_label = (unit == "") & (label_kg | label_tonnes)

    def result(reason, ambiguous=False, with_unit=False):
        return F.struct(
            F.lit(None).cast("string").alias("number"),
            (unit if with_unit else F.lit("")).alias("unit"),
            F.lit(False).alias("unit_from_label"),
            (reason if isinstance(reason, Column) else F.lit(reason)).cast("string").alias("reason"),
            (ambiguous if isinstance(ambiguous, Column) else F.lit(ambiguous)).alias("ambiguous"),
        )

    known = unit.isin(*K.KILOGRAM_UNITS, *K.TONNE_UNITS)
    return (
        F.when(text == "", result("EMPTY"))
        .when(token == "", result("NO_NUMBER"))
        .when(reading["number"].isNull(), result(reading["reason"], reading["ambiguous"]))
        .when(unit.isin(*K.AMBIGUOUS_UNITS), result("AMBIGUOUS_UNIT", True, True))
        .when((unit != "") & ~known, result("UNKNOWN_UNIT", True, True))
        .when((unit == "") & ~from_label, result("MISSING_UNIT", True))
        .when(kilograms.startswith("-") | (kilograms == "0"), result("NON_POSITIVE"))
        .when(out_of_range(kilograms), result("OUT_OF_RANGE"))
        .otherwise(F.struct(
            kilograms.alias("number"),
            F.when(from_label, F.when(label_kg, "kg").otherwise("mt")).otherwise(unit).alias("unit"),
            from_label.alias("unit_from_label"),
            F.lit(None).cast("string").alias("reason"),
            F.lit(False).alias("ambiguous"),
        ))
    )


#: Part of every grouped number.
_GROUP = r"[.,]\d{3}"


def grouped_tokens(text: Column) -> Column:
    """struct(en, eu): the unambiguous grouped numbers of a text, by notation."""
    def all_of(sample, patterns):
        return F.array_distinct(F.concat(
            *[F.regexp_extract_all(sample, F.lit(p), F.lit(0)) for p in patterns]))

    def tokens(sample):
        none = F.array().cast("array<string>")
        return F.when(sample.rlike(_GROUP), F.struct(
            all_of(sample, K.GROUPED_EN).alias("en"), all_of(sample, K.GROUPED_EU).alias("eu"),
        )).otherwise(F.struct(none.alias("en"), none.alias("eu")))

    return let(nfkc(F.coalesce(text, F.lit(""))), tokens)


def document_convention(text: Column) -> Column:
    """en, eu or '' from the document's own unambiguous numbers."""
    def verdict(sample):
        en = sample.rlike("|".join(K.GROUPED_EN))
        eu = sample.rlike("|".join(K.GROUPED_EU))
        return F.when(~sample.rlike(_GROUP), "").when(en & ~eu, "en").when(eu & ~en, "eu").otherwise("")

    return let(nfkc(F.coalesce(text, F.lit(""))), verdict)


def wire_ok(number: Column) -> Column:
    """The number survives the trip through a JSON number unchanged."""
    return let(number, _round_trips)


def _round_trips(number: Column) -> Column:
    integral = ~number.contains(".") & ~out_of_range(F.regexp_replace(number, "^-", ""))
    double = number.try_cast("double")
    back = double.cast("decimal(38,18)")
    return integral | F.coalesce(
        (back == number.try_cast("decimal(38,18)"))
        & (F.length(F.regexp_replace(number, r"[-.]|^-?0\.0*", "")) <= 17), F.lit(False))


def parse_user_value(field: Column, value: Column) -> Column:
    """struct(norm_kind, norm_key, error_code) of a value typed by a person."""
    text = F.when(field.isin(*K.PORT_FIELDS), normalize_port(value)).otherwise(normalize_party(value))
    number = parse_number(strip(value), F.lit("en"), F.lit(""))["number"]
    return let(text, lambda t: let(number, lambda n: _checked_user_value(field, value, t, n)))


def _checked_user_value(field: Column, value: Column, text: Column, number: Column) -> Column:
    positive = number.isNotNull() & ~number.startswith("-") & (number != "0") & ~out_of_range(number)
    is_text = field.isin(*K.PARTY_FIELDS, *K.PORT_FIELDS)
    ok = (
        F.when(is_text, (strip(value) != "") & (text != ""))
        .when(field == "container_count", positive & ~number.contains("."))
        .when(field == "gross_weight_kg", positive & wire_ok(number))
        .otherwise(False)
    )
    ok = F.coalesce(ok, F.lit(False))
    kind = F.when(is_text, "TEXT").when(field == "container_count", "INTEGER").otherwise("DECIMAL")
    return F.struct(
        F.when(ok, kind).alias("norm_kind"),
        F.when(ok, F.when(is_text, text).otherwise(number)).alias("norm_key"),
        F.when(~ok, "INVALID_VALUE").alias("error_code"),
    )


def interpretations(field: Column, raw: Column, label_ambiguous: Column, label_kg: Column,
                    label_tonnes: Column, convention: Column) -> Column:
    """Every canonical value (norm_key) the written value genuinely admits."""
    false, true = F.lit(False), F.lit(True)
    text = F.when(field.isin(*K.PORT_FIELDS), normalize_port(raw)).otherwise(normalize_party(raw))
    counts = F.array(parse_count(raw, label_ambiguous)["number"], parse_count(raw, false)["number"])

    def weight(policy, kg, tonnes):
        return parse_weight(raw, kg, tonnes, F.lit(policy), convention)["number"]

    def with_tonnes(kilograms):
        return F.flatten(F.transform(kilograms, lambda kg: F.array(kg, times_thousand(kg))))

    declared = F.array_compact(F.array(*[weight(p, label_kg, label_tonnes) for p in ("auto", "en", "eu")]))
    assumed = with_tonnes(F.array_compact(F.array(*[weight(p, true, false) for p in ("en", "eu")])))
    readings = (
        F.when(field.isin(*K.PARTY_FIELDS, *K.PORT_FIELDS), F.array(F.nullif(text, F.lit(""))))
        .when(field == "container_count", counts)
        .when(field == "gross_weight_kg",
              let(declared, lambda d: F.when(F.size(d) > 0, d).otherwise(assumed)))
    )
    return F.array_distinct(F.array_compact(readings))
