"""Work that a plan may hold once only: costly expressions must not be written out again in filters."""

import pytest
from pyspark.sql import functions as F

from ladingcheck.operators import blocks, ground
from ladingcheck.functions import matching, numbers, text


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _filters(df):
    return [line for line in _plan(df).split("\n") if "Filter " in line]


def test_page_blocks_cut_a_page_once(spark):
    pages = spark.createDataFrame(
        [("d", 1, "Shipper      ACME\nPOL: Here"), ("e", 1, "nothing to see")], "document_id string, page int, text string")
    b = blocks.page_blocks(pages)
    assert [(r.document_id, r.label, r.value) for r in b.orderBy("ord").collect()] == [
        ("d", "Shipper", "ACME"), ("d", "POL", "Here")]
    assert not any("regexp_extract_all" in line for line in _filters(b))


def test_grid_blocks_take_one_pass(spark):
    cells = spark.createDataFrame(
        [("d", "sheet", "S", 1, 1, "Shipper"), ("d", "sheet", "S", 1, 2, "ACME"), ("d", "sheet", "S", 1, 3, "more"),
         ("d", "sheet", "S", 2, 1, "POL: Here\nPOD: There"), ("d", "sheet", "S", 3, 1, ":"), ("d", "sheet", "S", 3, 2, "x"),
         ("d", "table", "T", 1, 1, "Notify"), ("d", "table", "T", 1, 2, "A"), ("d", "table", "T", 1, 3, "B"),
         ("d", "table", "T", 1, 4, "C")],
        "document_id string, kind string, container string, row int, col int, text string")
    g = blocks.grid_blocks(cells)
    assert g.columns == ["document_id", "container", "row", "col", "i", "label", "value", "value_col", "extra"]
    assert [tuple(r)[1:] for r in g.orderBy("container", "row", "col", "i").collect()] == [
        ("S", 1, 1, 0, "Shipper", "ACME", 2, ["more"]), ("S", 1, 2, 0, "ACME", "more", 3, []),
        ("S", 2, 1, 0, "POL", "Here", 1, []), ("S", 2, 1, 1, "POD", "There", 1, []),
        ("T", 1, 1, 0, "Notify", "A", 2, ["B", "C"]), ("T", 1, 2, 0, "A", "B", 3, ["C"]), ("T", 1, 3, 0, "B", "C", 4, [])]
    assert "Union" not in _plan(g) and not any("regexp_extract_all" in line for line in _filters(g))


def test_a_column_made_once_is_not_repeated_by_a_filter(spark):
    rows = spark.createDataFrame([("a",), ("bb",), (None,)], "v string")
    made = ground.once(rows, "n", F.transform(F.split("v", ""), lambda c: F.upper(c))).filter("size(n) = 2")
    assert [r.n for r in made.collect()] == [["B", "B"]]
    assert not any("lambda" in line for line in _filters(made))


def test_let_and_white_space(spark):
    rows = spark.createDataFrame([("a \t b",), ("ä 　 b",), ("",), (None,)], "v string")
    got = rows.select(text.collapse(F.col("v")).alias("c"), text.non_ascii(F.col("v")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("a b", False), ("ä b", True), ("", False), (None, None)]
    # The value that is bound is not copied into an array first.
    assert "transform(" not in _plan(rows.select(text.let(F.upper("v"), lambda x: F.concat(x, x)).alias("x")))


def test_inventory_reads_no_blocks(spark, sf_dir):
    from ladingcheck.plans import queries

    plan = _plan(queries.all_queries()["a06_inventory"](spark, sf_dir))
    assert "InMemoryRelation" not in plan and "label_locator" not in plan


def _kept(spark, sf_dir, name):
    """Columns of the tables that a query keeps, by table."""
    from ladingcheck.plans import queries

    queries.release()
    queries.all_queries()[name](spark, sf_dir)
    kept = {key[2]: df.columns for key, df in queries._SHARED.items()}
    queries.release()
    return kept


@pytest.mark.parametrize("name", [
    "a02_counts_by", "a04_validation_report", "c02_compare", "c03_confidence", "c08_review_requirement", "c09_review_text",
    "c10_verify", "d20_emit_history", "d21_pending_work"])
def test_one_reading_of_the_cases_keeps_no_rows(spark, sf_dir, name):
    assert _kept(spark, sf_dir, name) == {}


@pytest.mark.parametrize("name", ["c05_roll_up", "d01_validate_decisions", "e01_confusion", "e02_prf", "e05_reliability"])
def test_two_readings_keep_only_what_they_need(spark, sf_dir, name):
    kept = _kept(spark, sf_dir, name)
    assert len(kept) == 1 and not {"si_outcomes", "listed", "documents"} & set(*kept.values())


@pytest.mark.parametrize("name", ["d06_override_values", "d07_operational_roles"])
def test_applied_decisions_keep_no_documents(spark, sf_dir, name):
    assert not {"documents", "applied"} & set(_kept(spark, sf_dir, name))


def test_words_of_a_pattern_are_in_its_matches(spark):
    texts = [
        "SHIPPING INSTRUCTION", "Shipment\tinstructions", "BL instruction", "B/L Instructions", "bill of lading instructions",
        "booking instruction", "Draft Bill of Lading", "BL draft", "b/l\tDRAFT", "Sea Waybill", "house bill of lading",
        "COMMERCIAL INVOICE", "proforma invoice", "Packing\x0bList", "certificate of origin", "insurance certificate",
        "Debit note", "credit note", "delivery order", "B/L No", "blnumber", "bill of lading no 4", "Export Carrier",
        "on board date", "freight prepaid", "Booking Ref", "OC NO", "oc\tno", "oc\fno", "shipping mark", "kinds of packages",
        "This is not a shipping instruction", "nothing of the kind", "", "dock", "oc\n\nno"]
    form = blocks.matching.plain_form
    row = spark.createDataFrame([(t,) for t in texts + ["a\n" + t + "\nb" for t in texts]], "t string")
    plain = {f"p{i}": blocks.matching.count_not_negated(F.col("t"), form(p)) for i, p in enumerate(blocks._HINTS)}
    for i, (pattern, words) in enumerate(blocks._HINTS.items()):
        held = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("t"), w))
        assert not row.filter((plain[f"p{i}"] > 0) & ~held).count(), pattern
    # The same scores as the form for other texts, which searches for every pattern.
    scored = row.select(blocks.role_scores(F.col("t")).alias("a"), blocks.role_scores(F.concat("t", F.lit("\n毛"))).alias("b"))
    assert [r for r in scored.collect() if r.a != r.b] == []


def test_blocks_are_cut_without_a_second_search(spark):
    texts = ["", "\n\nA: b\n  c\n\nplain\n====\nDé : f:g\xa0\n", "no label\n\n", "x: \n" * 3, "Ship\xa0: y\n---\nz"]
    spans = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", blocks.label_spans(F.col("text")).alias("s"))
    assert "locate(" not in _plan(spans)
    got = {r["text"]: r["s"] for r in spans.collect()}
    assert [[(s["label"], s["value"]) for s in got[t]] for t in texts] == [
        [], [("A", "b\n  c"), ("Dé", "f:g\xa0")], [], [("x", "")] * 3, [("Ship", "y")]]
    for t in texts:
        for s in got[t]:
            assert t[s["value_start"]:s["value_end"]] == s["value"]
            assert t[s["label_start"]:s["label_end"]].strip() == s["label"]


def test_a_quote_is_looked_for_without_an_exception(spark):
    rows = spark.createDataFrame(
        [("a", ["b", "a"]), ("a", ["b"]), ("a", ["b", None]), (None, ["a"]), ("a", None), (None, [])], "q string, t array<string>")
    said = rows.select(ground.quote_supported(F.col("q"), F.lit("text_range"), F.col("t")).alias("s"))
    assert "array_contains" not in _plan(said)
    assert [r["s"] for r in said.collect()] == [True, False, None, None, None, None]


def test_first_letters_are_those_of_the_patterns(spark):
    texts = ["Shipping Instructions", "shipment instruction", "B/L instructions", "bl instruction", "Booking instruction",
             "draft Bill of Lading", "bl draft", "Ocean bill of lading", "house bill of lading", "sea waybill",
             "Commercial invoice", "packing list", "Insurance certificate", "Debit note", "delivery order", "booking ref",
             "oc no", "shipping mark", "Kinds of packages", "B/L no", "export carrier", "On board date", "freight collect",
             "never a sea waybill", "NOTIFY of a sea waybill", "isn't a packing list"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for pattern, first in blocks._FIRST.items():
        same = frame.filter(F.regexp_count("text", F.lit(matching.plain_form(pattern)))
                            != F.regexp_count("text", F.lit(blocks._plain_search(pattern, first))))
        assert same.count() == 0
    scored = frame.select(blocks.role_scores(F.col("text")).alias("s"))
    assert [tuple(r["s"]) for r in scored.collect()][-3:] == [(0.0, 0.0, 0.0), (0.0, 4.0, 0.0), (0.0, 0.0, 0.0)]


def test_grouped_numbers_are_found_as_before(spark):
    values = ["1,234.5 x 1.234,5", "1,234,567", "１,234,567", "12.345.678", "1,23", "", None]
    got = spark.createDataFrame([(v,) for v in values], "x string").select(
        numbers.grouped_tokens(F.col("x")).alias("t"), numbers.document_convention(F.col("x")).alias("c")).collect()
    assert [(list(r["t"]["en"]), list(r["t"]["eu"]), r["c"]) for r in got] == [
        (["1,234.5"], ["1.234,5"], ""), (["1,234,567"], [], "en"), (["1,234,567"], [], "en"), ([], ["12.345.678"], "eu"),
        ([], [], ""), ([], [], ""), ([], [], "")]
