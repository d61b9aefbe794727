"""Table-driven checks of the scalar functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from ladingcheck import constants as K
from ladingcheck.functions import labels, matching, numbers, ports, text


def rows(spark, values, **columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.asDict() for r in df.select("i", "x", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()]


def test_nfkc_and_casefold_match_unicode(spark):
    values = ["Ｇross Ｗt", "ß Ştraße", "①②", "é", "ﬁne", "plain", "½ kg", "毛重（KGS）", " x y"]
    got = rows(spark, values, n=text.nfkc(F.col("x")), c=text.casefold(text.nfkc(F.col("x"))))
    assert [r["n"] for r in got] == [unicodedata.normalize("NFKC", v) for v in values]
    assert [r["c"] for r in got] == [unicodedata.normalize("NFKC", v).casefold() for v in values]


@pytest.mark.parametrize("token,policy,convention,number,reason", [
    ("21577", "auto", "", "21577", None),
    ("1,234.50", "auto", "", "1234.5", None),
    ("1.234,5", "auto", "", "1234.5", None),
    ("1,234", "auto", "", None, "LONE_SEPARATOR_AMBIGUOUS"),
    ("1,234", "auto", "en", "1234", None),
    ("1,234", "auto", "eu", "1.234", None),
    ("1.234", "eu", "", "1234", None),
    ("1.234", "ambiguous", "en", None, "LONE_SEPARATOR_AMBIGUOUS"),
    ("12,34", "auto", "", "12.34", None),
    ("1,2,3", "auto", "", None, "MALFORMED_SEPARATORS"),
    ("1,234,567", "auto", "", "1234567", None),
    ("1,23.4", "auto", "", None, "MALFORMED_SEPARATORS"),
    ("-5", "auto", "", "-5", None),
    ("+007.50", "auto", "", "7.5", None),
    ("１２", "auto", "", "12", None),
    ("12 345", "auto", "", "12345", None),
    ("", "auto", "", None, "EMPTY"),
    ("12a", "auto", "", None, "NOT_NUMERIC"),
    (".5", "auto", "", None, "MALFORMED_SEPARATORS"),
])
def test_parse_number(spark, token, policy, convention, number, reason):
    got = rows(spark, [token], p=numbers.parse_number(F.col("x"), F.lit(policy), F.lit(convention)))[0]["p"]
    assert (got["number"], got["reason"]) == (number, reason)


def test_parse_weight(spark):
    values = ["21577 KG", "22 MT", "22.5 tonnes", "500 lbs", "100", "3 foo", "0 kg", "abc", "", "Gross 12 kg", "12 kg\n more"]
    p = numbers.parse_weight(F.col("x"), F.lit(False), F.lit(False), F.lit("auto"), F.lit(""))
    assert [(r["p"]["number"], r["p"]["reason"]) for r in rows(spark, values, p=p)] == [
        ("21577", None), ("22000", None), ("22500", None), (None, "AMBIGUOUS_UNIT"), (None, "MISSING_UNIT"),
        (None, "UNKNOWN_UNIT"), (None, "NON_POSITIVE"), (None, "NO_NUMBER"), (None, "EMPTY"), (None, "UNKNOWN_UNIT"),
        (None, "UNKNOWN_UNIT")]


def test_parse_count(spark):
    values = ["3 x 40'HC", "2 x 20GP + 1 x 40HC", "500", "3x40’HC", "0 x 40HC", "40’HC", "", "4 units"]
    loose = numbers.parse_count(F.col("x"), F.lit(False))
    strict = numbers.parse_count(F.col("x"), F.lit(True))
    got = rows(spark, values, p=loose, s=strict)
    assert [r["p"]["number"] for r in got] == ["3", "3", "500", "3", None, None, None, "4"]
    assert [r["s"]["reason"] for r in got] == [
        None, None, "NO_CONTAINER_CONTEXT", None, "NON_POSITIVE", "UNRECOGNIZED_COUNT_FORMAT", "EMPTY",
        "NO_CONTAINER_CONTEXT"]


def test_missing_values(spark):
    values = ["", "  ", "N/A", "____", "—", "TBD", "TO ORDER", "0", "unknown", ". - ."]
    assert [r["m"] for r in rows(spark, values, m=text.is_missing(F.col("x")))] == [
        True, True, True, True, True, True, False, False, True, True]


def test_every_alias_maps_to_its_field_and_so_do_its_variants(spark):
    pairs = [(a, f) for f, aliases in K.FIELD_ALIASES.items() for a in aliases]
    got = rows(spark, [a for a, _ in pairs], m=labels.match_field(F.col("x")),
               v=labels.match_variants(labels.label_variants(F.col("x"))))
    assert [r["m"] for r in got] == [f for _, f in pairs]
    # The short cut for labels that are aliases as they stand is exact.
    assert [r["v"] for r in got] == [f for _, f in pairs]


def test_labels(spark):
    values = ["Gross Weight毛重(KGS) (毛重 KGS)", "NOTIFY PARTY/INTERMEDIATE CONSIGNEE", "Net Weight", "Consignee Ref", "Pod."]
    assert [r["m"] for r in rows(spark, values, m=labels.match_field(F.col("x")))] == [
        "gross_weight_kg", "notify_party", None, None, "port_of_discharge"]


def test_ports(spark):
    values = ["SINGAPORE (SGSIN)", "singapore", "PORT KLANG, MALAYSIA (MYZZZ)", "RUGAO/NANTONG"]
    one = F.lit("Singapore")
    got = rows(spark, values, s=ports.port_code_state(F.col("x")), e=ports.port_equal(F.col("x"), one),
               a=ports.port_equal(F.col("x"), one, True), alt=ports.port_alternatives(F.col("x")))
    assert [r["s"] for r in got] == ["corpus_convention", "absent", "unestablished", "absent"]
    assert [r["e"] for r in got] == [False, True, False, False]
    assert [r["a"] for r in got] == [True, True, False, False]
    assert [r["alt"] for r in got] == [False, False, False, True]


def test_user_values_and_wire_numbers(spark):
    v = numbers.parse_user_value(F.lit("gross_weight_kg"), F.col("x"))
    got = rows(spark, ["12.5", "1,500", "0", "-1", "x", "0.12345678901234567891"], v=v)
    assert [(r["v"]["norm_key"], r["v"]["error_code"]) for r in got] == [
        ("12.5", None), ("1500", None), (None, "INVALID_VALUE"), (None, "INVALID_VALUE"), (None, "INVALID_VALUE"),
        (None, "INVALID_VALUE")]


def test_interpretations(spark):
    f = F.lit(False)
    i = numbers.interpretations(F.lit("gross_weight_kg"), F.col("x"), f, f, f, F.lit(""))
    assert [r["i"] for r in rows(spark, ["21,577 KG", "100", "5 lbs"], i=i)] == [
        ["21577", "21.577"], ["100", "100000"], []]


def test_negated_hits(spark):
    values = ["This is NOT a shipping instruction", "not it. Shipping instruction", "shipping instruction, never a shipping instruction"]
    got = rows(spark, values, n=matching.count_not_negated(F.col("x"), K.SI_HEADING))
    assert [r["n"] for r in got] == [0, 1, 1]


def test_safe_filename_and_media_type(spark):
    values = ["a/b c.TXT", ".hidden", "x/..", "ü.pdf"]
    got = rows(spark, values, s=text.safe_filename(F.col("x")), m=text.media_type(F.col("x")))
    assert [r["s"] for r in got] == ["b_c.TXT", "attachment_hidden", "attachment_", "_.pdf"]
    assert got[0]["m"] == "text/plain" and got[3]["m"] == "application/pdf"
