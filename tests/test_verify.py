"""Documents to assessments, on texts built in the test."""

import pytest
from pyspark.sql import functions as F

from ladingcheck.operators import blocks
from ladingcheck.plans import verify

SI = (
    "SHIPPING INSTRUCTION\n\nShipper: NORTH PAPER PTE LTD\n  1 Dock Road\nConsignee: MERIDIAN GMBH\n"
    "Notify Party: MERIDIAN GMBH\nPort of Loading (POL): SINGAPORE (SGSIN)\nPort of Discharge (POD): HAMBURG (DEHAM)\n"
    "Total Containers: 4 x 40'HC\nGross Weight (KG): 18500 KG\n"
)


def bl(**changes):
    v = {"head": "BILL OF LADING (DRAFT)", "shipper": "NORTH PAPER PTE LTD\n  1 Dock Road", "consignee": "MERIDIAN GMBH",
         "notify": "MERIDIAN GMBH", "pol": "SINGAPORE (SGSIN)", "pod": "HAMBURG (DEHAM)", "count": "4 x 40'HC",
         "weight": "Gross Wt (kgs): 18500 KG", **changes}
    return (f"{v['head']}\nSHIPPER: {v['shipper']}\nConsignee (Non-Negotiable): {v['consignee']}\nNOTIFY PARTY: {v['notify']}\n"
            f"Load Port: {v['pol']}\nDischarge Port: {v['pod']}\nContainer Count: {v['count']}\n{v['weight']}\n")


CASES = {
    # name: (attachments, expected status, reason, defects)
    "same": ([("a_SI.txt", SI), ("a_BL.txt", bl())], "OK", None, []),
    "swapped_names": ([("a_BL.txt", SI), ("a_SI.txt", bl())], "OK", None, []),
    "consignee": ([("s.txt", SI), ("b.txt", bl(consignee="OTHER"))], "MISMATCH", None, ["consignee"]),
    "two_defects": ([("s.txt", SI), ("b.txt", bl(shipper="X", weight="Gross Wt: 18501 KG"))], "MISMATCH", None,
                    ["shipper", "gross_weight_kg"]),
    "code_dropped": ([("s.txt", SI), ("b.txt", bl(pol="SINGAPORE"))], "MISMATCH", None, ["port_of_loading"]),
    "tonnes": ([("s.txt", SI), ("b.txt", bl(weight="Gross Weight: 18.5 MT"))], "NEEDS_REVIEW", None, []),
    "no_weight": ([("s.txt", SI), ("b.txt", bl(weight="Gross Wt (kgs): ____"))], "NEEDS_REVIEW", "missing_value", []),
    "no_unit": ([("s.txt", SI), ("b.txt", bl(weight="Gross Wt: 18500"))], "NEEDS_REVIEW", "unreadable", []),
    "reference": ([("s.txt", SI), ("b.txt", bl(notify="Same as consignee"))], "OK", None, []),
    # Two equal readings with different wording cannot vouch for each other.
    "unproven": ([("s.txt", SI), ("b.txt", bl(weight="Gross Wt (kgs): 18500 KG\nGross Weight: 18500 KGS"))],
                 "NEEDS_REVIEW", "unreadable", []),
    "total_wins": ([("s.txt", SI), ("b.txt", bl(weight="Gross Wt (kgs): 18500 KG\nTotal Gross Weight: 18500 KGS"))], "OK", None, []),
    "invoice": ([("s.txt", SI), ("a_BL.txt", "COMMERCIAL INVOICE\nSeller: X\n")], "NEEDS_REVIEW", "wrong_doc_type", []),
    "two_bls": ([("s.txt", SI), ("b.txt", bl()), ("c.txt", bl(consignee="OTHER"))], "NEEDS_REVIEW", "wrong_doc_type", []),
    "bl_absent": ([("s.txt", SI), ("gone.txt", None)], "NEEDS_REVIEW", "missing_attachment", []),
    "nothing": ([], "NEEDS_REVIEW", "missing_attachment", []),
    "unsafe": ([("s.txt", SI), ("../b.txt", bl())], "NEEDS_REVIEW", "missing_attachment", []),
}
CASES["tonnes"] = (CASES["tonnes"][0], "OK", None, [])


@pytest.fixture(scope="module")
def results(spark):
    mails, files = [], []
    for name, (attachments, *_rest) in CASES.items():
        paths = [p if p.startswith("..") else f"attachments/{name}/{p}" for p, _ in attachments]
        mails.append(("EVAL", "participant", name, "x@y", "Shipment", "Please compare the SI and draft BL.", paths, None))
        files += [("participant", p, bytearray(t.encode())) for p, (_, t) in zip(paths, attachments) if t is not None]
    e = spark.createDataFrame(mails, "run_kind string, registry string, email_id string, from_addr string, subject string, "
                                     "body string, attachments array<string>, received_at timestamp")
    f = spark.createDataFrame(files, "registry string, path string, content binary")
    out = verify.verify(e, f).select("case_id", "assessment", "review", "fields", "documents", "workflow_status").collect()
    return {r["case_id"]: r for r in out}


@pytest.mark.parametrize("name", CASES)
def test_assessment(results, name):
    _, status, reason, defects = CASES[name]
    a = results[name]["assessment"]
    assert (a["status"], a["review_reason"], a["defect_fields"]) == (status, reason, defects)


def test_review_of_two_revisions_offers_both(results):
    review = results["two_bls"]["review"]
    assert (review["ui_mode"], review["target_role"]) == ("CHOICE", "BL")
    assert [o["option_id"] for o in review["options"]] == ["doc_1", "doc_2", "NONE_OF_THESE"]


def test_unproven_value_is_reported_as_ungrounded(results):
    weight = results["unproven"]["fields"][6]
    assert (weight["result"], weight["not_comparable_cause"]) == ("NOT_COMPARABLE", "UNGROUNDED")


def test_seven_fields_and_roles(results):
    r = results["swapped_names"]
    assert len(r["fields"]) == 7
    assert {d["filename"]: d["role"] for d in r["documents"]} == {"a_BL.txt": "SI", "a_SI.txt": "BL"}


def test_blocks_have_exact_offsets_and_long_values_are_whole(spark):
    body = "Shipper: A 😀\n  line\n\nNotify:\n cont\n----\nPOD: X\n" + "Consignee: Y\n" + "more\n" * 20000
    df = spark.createDataFrame([("d", body)], "document_id string, text string")
    got = blocks.label_blocks(df).orderBy("ord").collect()
    assert [b["label"] for b in got] == ["Shipper", "Notify", "POD", "Consignee"]
    for b in got:
        assert body[b["value_start"]:b["value_end"]] == b["value"]
        assert body[b["label_start"]:b["label_end"]] == b["label"]
    assert got[3]["value"].count("more") == 20000


def test_column_layout(spark):
    page = "Shipper      ACME\n             ROAD 1\nConsignee    FOO\nPOL: X\n   more\n\nGross Weight   12 KG\n"
    df = spark.createDataFrame([("d", 1, page)], "document_id string, page int, text string")
    got = [(b["label"], b["value"]) for b in blocks.page_blocks(df).orderBy("ord").collect()]
    assert got == [("Shipper", "ACME\n             ROAD 1"), ("Consignee", "FOO"), ("POL", "X\n   more"), ("Gross Weight", "12 KG")]


def test_plan_shuffles_no_document_bytes(spark, sf_dir):
    from ladingcheck.plans import shipments

    e, f = shipments.inbox(spark, sf_dir)
    plan = verify.verify(e, f).select("case_id", "assessment.status")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan
