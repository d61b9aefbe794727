"""What queries keep between readings, and that rows are the same when less is kept."""

import pytest
from pyspark.sql import functions as F

from ladingcheck import schema
from ladingcheck.operators import extract
from ladingcheck.plans import queries, verify

_BLOCKS = (f"array<struct<ord:int,field:string,label:string,value:string,locator:{schema.LOCATOR},"
           f"label_locator:{schema.LOCATOR},extra:array<struct<locator:{schema.LOCATOR},text:string>>>>")
_PAYLOAD = f"struct<document_id:string,content_hash:string,status:string,convention:string,image_pages:boolean,blocks:{_BLOCKS}>"


def _kept(spark, sf_dir, name):
    queries.release()
    queries.all_queries()[name](spark, sf_dir)
    kept = {key[2].split(":")[0]: df.columns for key, df in queries._SHARED.items()}
    queries.release()
    return kept


@pytest.mark.parametrize("name", [
    "a03_bl_comparison", "f01_case_summary", "f04_demo_safe_only", "f06_search_cases", "f07_queue_group", "f09_only_mismatches",
    "n15_normalize_value", "q01_audit_comparisons", "q02_audit_assessments", "c01_values_equal", "c04_document_reason",
    "c06_follow_up", "c07_workflow_status", "r02_assess_role", "r04_resolve_roles", "g01_check_source", "g05_document_support"])
def test_nothing_is_kept(spark, sf_dir, name):
    assert _kept(spark, sf_dir, name) == {}


@pytest.mark.parametrize("name, tables", [
    ("d02_check_confirmation", {"cases"}), ("d06_override_values", {"payloads"}), ("d07_operational_roles", {"cases", "validated", "payloads"}),
    ("x07_judge_proposals", {"open_outcomes", "proposed_documents"})])
def test_only_what_is_read_twice_is_kept(spark, sf_dir, name, tables):
    kept = _kept(spark, sf_dir, name)
    assert set(kept) == tables
    assert not any({"si_payload", "si_outcomes", "listed"} & set(c) for c in kept.values())


def _document(name, *blocks):
    place = ("text_range", None, 0, 1)
    return (name, "h", "OK", "", False, [(i, field, field, value, place, place, []) for i, (field, value) in enumerate(blocks)])


def test_candidates_meet_all_consignees_and_conventions_of_their_case(spark, monkeypatch):
    # Two mails of one key with different conventions, a case without a consignee, one without documents.
    si = _document("d1", ("shipper", "Acme"), ("consignee", "Foo"), ("consignee", "Bar"), ("consignee", "n/a"))
    rows = [("EVAL", "a", "en", si, _document("d2", ("consignee", "Foo"))), ("EVAL", "a", None, si, _document("d2", ("consignee", "Foo"))),
            ("EVAL", "b", "eu", _document("d3", ("shipper", "Acme")), None), ("EVAL", "c", "", None, None)]
    cases = spark.createDataFrame(
        rows, f"run_kind string, case_id string, registry_convention string, si_payload {_PAYLOAD}, bl_payload {_PAYLOAD}")
    monkeypatch.setattr(queries, "case_plan", lambda spark, sf_dir: cases)
    got = queries._machine_candidates(spark, "")

    c = extract.candidate_rows(cases).filter("norm_key is not null")
    consignee = c.filter("field = 'consignee'").select(*schema.KEY, "side", F.col("norm_key").alias("consignee_key"))
    joined = c.join(consignee, [*schema.KEY, "side"], "left").join(cases.select(*schema.KEY, "registry_convention"), schema.KEY)
    columns = [*schema.KEY, "side", "field", "norm_key", "block_ord", "consignee_key", "registry_convention"]

    def sorted_rows(df):
        return sorted(map(str, df.select(*columns).collect()))

    assert sorted(got.columns) == sorted(joined.columns)
    assert sorted_rows(got) == sorted_rows(joined) and got.count() > 4


@pytest.fixture(scope="module")
def decided(spark):
    """Two revisions of a bill of lading, of which a person takes the first; and a case nobody decides on."""
    body = ("\n\nShipper: ACME\nConsignee: FOO\nNotify Party: BAR\nPort of Loading: A\nPort of Discharge: B\n"
            "Container Count: 2 x 40'HC\nGross Weight: {} KG\n")
    texts = {"e1_SI.txt": "SHIPPING INSTRUCTION" + body.format(5), "e1_BL.txt": "BILL OF LADING (DRAFT)" + body.format(5),
             "e1_BL2.txt": "BILL OF LADING (DRAFT)" + body.format(6), "e2_SI.txt": "SHIPPING INSTRUCTION" + body.format(5)}
    ask = "Please compare the SI and draft BL and confirm the shipment details agree."
    emails = spark.createDataFrame(
        [("EVAL", "participant", e, "x@y", "Shipment", ask, [n for n in texts if n.startswith(e)], None) for e in ("e1", "e2")],
        "run_kind string, registry string, email_id string, from_addr string, subject string, body string, attachments array<string>, "
        "received_at timestamp_ntz")
    files = spark.createDataFrame([("participant", n, bytearray(t, "utf-8")) for n, t in texts.items()],
                                  "registry string, path string, content binary")
    parsed = verify.case_documents(emails, files)
    chosen = parsed.filter("filename = 'e1_BL.txt'").select(
        *schema.KEY, F.lit(None).cast("string").alias("target_field"), F.lit(None).cast("string").alias("target_side"),
        F.lit(None).cast(extract.VALUE).alias("canonical"), F.lit(1).cast("bigint").alias("sequence"),
        F.lit(None).cast("string").alias("value_origin"), F.lit("BL").alias("choice_role"),
        F.col("document_id").alias("choice_document"), F.lit(False).alias("escape"), F.lit("SELECT_OPTION").alias("action"),
        F.lit("p").alias("actor"))
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(queries.shipments, "inbox", lambda spark, sf_dir: (emails, files))
        patched.setattr(queries, "_accepted", lambda spark, sf_dir: chosen)
        return queries._applied(spark, "decided").select(
            "case_id", F.col("machine_assessment.status").alias("machine"), "final_status", "workflow_status")


def test_a_chosen_document_is_read(decided):
    assert [tuple(r) for r in decided.collect()] == [("e1", "NEEDS_REVIEW", "OK", "COMPLETED")]


def test_cases_without_decisions_are_not_worked_out(decided):
    lines = decided._jdf.queryExecution().optimizedPlan().toString().split("\n")
    extraction = [i for i, line in enumerate(lines) if "a declared total conflicts" in line]
    semi = [i for i, line in enumerate(lines) if "Join LeftSemi" in line]
    # Twice: the machine's and the one after the decision, both above the join that leaves the others out.
    assert len(extraction) == 2 and semi and max(extraction) < min(semi)
