"""Seven field comparisons per case, their roll-up, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladingcheck import constants as K
from ladingcheck import schema
from ladingcheck.functions.ports import port_equal
from ladingcheck.functions.text import let, lookup
from ladingcheck.operators.extract import OUTCOME


def values_equal(field: Column, left: Column, right: Column) -> Column:
    """Exact and kind-aware; ports under the code policy; no tolerance."""
    text = (left["norm_kind"] == "TEXT") | (right["norm_kind"] == "TEXT")
    same_kind = ~text | (left["norm_kind"] == right["norm_kind"])
    plain = same_kind & (left["norm_key"] == right["norm_key"])
    return F.when(field.isin(*K.PORT_FIELDS), plain | port_equal(left["norm_key"], right["norm_key"])) \
        .otherwise(plain)


def _confidence(field, si, bl, result, cause, detail) -> Column:
    """struct(confidence, explanation)."""
    def said(score, *parts):
        return F.struct(F.lit(score).cast("double").alias("confidence"),
                        F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("explanation"))

    by_ai = (si["method"] == "AI") | (bl["method"] == "AI")
    flagged = (F.size(si["flags"]) > 0) | (F.size(bl["flags"]) > 0)
    match = (
        F.when(by_ai, said(0.88, "SI and Draft BL match for ", field, " with grounded AI assistance."))
        .when(flagged, said(0.94, "SI and Draft BL match for ", field, " after convention normalization."))
        .when(field.isin(*K.PORT_FIELDS),
              said(0.98, "SI and Draft BL port locations match for ", field, " under UN/LOCODE policy."))
        .otherwise(said(1.0, "SI and Draft BL match exactly for ", field, " with verified document evidence."))
    )
    differ = ("Discrepancy detected: SI specifies '", si["raw"], "' whereas Draft BL specifies '", bl["raw"],
              "'. Carrier correction required.")
    mismatch = F.when(by_ai, said(0.88, *differ)).otherwise(said(0.98, *differ))
    have_si, have_bl = si["norm_key"].isNotNull(), bl["norm_key"].isNotNull()
    where = F.when(have_si & ~have_bl, "Draft BL").when(have_bl & ~have_si, "SI").otherwise("both documents")
    cannot = ("Cannot verify ", field, ": ")
    open_ = (
        F.when(cause == "MISSING_VALUE", said(0.50, *cannot, "Value is missing in ", where, "."))
        .when(cause == "AMBIGUOUS", said(
            0.40, *cannot, "Multiple competing candidates or ambiguous numeric formatting in document."))
        .when(cause == "UNREADABLE", said(0.20, *cannot, "Document text or unit is unreadable / unparseable."))
        .when(cause == "UNGROUNDED", said(0.10, *cannot, "Candidate failed anti-hallucination grounding check."))
        .otherwise(said(0.30, *cannot, F.when(detail != "", detail).otherwise(cause), "."))
    )
    return F.when(result == "MATCH", match).when(result == "MISMATCH", mismatch).otherwise(open_)


def compare_outcomes(si: Column, bl: Column) -> Column:
    """One comparison struct of the two outcomes of a field."""
    def verdict(x):
        field = x["si"]["field"]
        left, right = x["si"]["value"], x["bl"]["value"]
        lacking_si = left["norm_key"].isNull()
        comparable = ~lacking_si & right["norm_key"].isNotNull()
        private = F.when(~comparable, F.coalesce(
            F.when(lacking_si, x["si"]["cause"]).otherwise(x["bl"]["cause"]), F.lit("MISSING_VALUE")))
        detail = F.when(comparable, "").when(lacking_si, x["si"]["detail"]).otherwise(x["bl"]["detail"])
        result = F.when(~comparable, "NOT_COMPARABLE").when(
            values_equal(field, left, right), "MATCH").otherwise("MISMATCH")
        return F.struct(x.alias("x"), field.alias("field"), private.alias("private"), detail.alias("detail"),
                        lookup(K.PUBLIC_CAUSE, private).alias("public"), result.alias("result"))

    def full(v):
        si_o, bl_o = v["x"]["si"], v["x"]["bl"]
        scored = _confidence(v["field"], si_o["value"], bl_o["value"], v["result"], v["public"], v["detail"])
        return let(scored, lambda s: F.struct(
            v["field"].alias("field"), si_o["value"].alias("si"), bl_o["value"].alias("bl"),
            v["result"].alias("result"), v["public"].alias("not_comparable_cause"),
            v["private"].alias("private_cause"), F.lit("DETERMINISTIC").alias("compared_by"),
            s["confidence"].alias("confidence"), s["explanation"].alias("explanation"),
            v["detail"].alias("detail")))

    return let(let(F.struct(si.alias("si"), bl.alias("bl")), verdict), full)


def compare_all(si_outcomes: Column, bl_outcomes: Column) -> Column:
    """array of seven comparisons from the outcomes of both sides."""
    pairs = F.arrays_zip(si_outcomes.alias("si"), bl_outcomes.alias("bl"))
    return F.transform(pairs, lambda p: compare_outcomes(p["si"], p["bl"]))


def compare(outcomes: DataFrame) -> DataFrame:
    """The same over a table of outcomes (key, side, field, value, cause, …)."""
    packed = F.struct("field", "side", "value", "cause", "detail", "alternatives").cast(OUTCOME)
    paired = outcomes.groupBy(*schema.KEY, "field").agg(
        F.any_value(F.when(F.col("side") == "SI", packed), True).alias("si"),
        F.any_value(F.when(F.col("side") == "BL", packed), True).alias("bl"),
    )
    return paired.select(*schema.KEY, compare_outcomes(F.col("si"), F.col("bl")).alias("c")).select(
        *schema.KEY, "c.*")


def document_reason(issues: Column) -> Column:
    """Most severe review reason among document issues, or NULL."""
    rank = {r: i for i, r in enumerate(K.REASON_PRIORITY)}

    def severity(issue):
        return (
            F.when(issue.endswith("_MISSING") | (issue == "SOURCE_MISSING"), rank["missing_attachment"])
            .when(issue.endswith("_WRONG_DOC_TYPE"), rank["wrong_doc_type"])
            .when(issue.endswith("_UNREADABLE") | (issue == "UNREADABLE_DOCUMENT"), rank["unreadable"])
            .when(issue.endswith("_ROLE_UNRESOLVED") | issue.endswith("_AMBIGUOUS_CANDIDATES"),
                  rank["wrong_doc_type"])
        )

    return _reason_of(F.array_min(F.transform(issues, severity)))


def _reason_of(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(r) for r in K.REASON_PRIORITY]), rank)


def field_reason(fields: Column) -> Column:
    """Most severe review reason among the comparisons that could not be made."""
    rank = {c: K.REASON_PRIORITY.index(r) for c, r in K.CAUSE_REASON.items()}
    table = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    return _reason_of(F.array_min(F.transform(fields, lambda f: F.try_element_at(table, f["private_cause"]))))


def roll_up(category: Column, fields: Column, issues: Column) -> Column:
    """struct(status, review_reason, has_defect, defect_fields, detail, overall_confidence, explanation)."""
    def said(status, confidence, explanation, reason=None, defects=None, detail=None):
        return F.struct(
            F.lit(status).alias("status"),
            (reason if reason is not None else F.lit(None)).cast("string").alias("review_reason"),
            F.lit(status == "MISMATCH").alias("has_defect"),
            (defects if defects is not None else F.array()).cast("array<string>").alias("defect_fields"),
            (detail if detail is not None else F.lit("")).alias("detail"),
            confidence.cast("double").alias("overall_confidence"),
            F.concat(*explanation).alias("explanation"),
        )

    def names(items):
        return F.array_join(F.transform(items, lambda f: f["field"]), ", ")

    def decide(x):
        total = F.aggregate(x["fields"], F.lit(0.0), lambda a, f: a + f["confidence"])
        mean = F.when(F.size(x["fields"]) > 0, F.bround(total / F.size(x["fields"]), 2)).otherwise(1.0)
        open_ = F.filter(x["fields"], lambda f: f["result"] == "NOT_COMPARABLE")
        differ = F.filter(x["fields"], lambda f: f["result"] == "MISMATCH")
        listed = F.array_join(x["issues"], ", ")
        return (
            F.when(x["category"] != "BL_COMPARISON", said("OK", F.lit(1.0), [
                F.lit("Email classified as "), x["category"],
                F.lit(". No Shipping Instruction / Bill of Lading comparison required.")]))
            .when(x["reason"].isNotNull(), said(
                "NEEDS_REVIEW", F.least(mean, F.lit(0.40)),
                [F.lit("Case requires manual review due to document-level issues ("), x["reason"], F.lit("): "),
                 listed, F.lit(".")],
                x["reason"], detail=F.concat(F.lit("document-level issues: "), listed)))
            .when(F.size(open_) > 0, said(
                "NEEDS_REVIEW", mean,
                [F.lit("Automated verification incomplete: "), F.size(open_).cast("string"),
                 F.lit(" field(s) require human attention ("), names(open_), F.lit(").")],
                field_reason(open_),
                detail=F.array_join(F.transform(open_, lambda f: F.concat(
                    f["field"], F.lit(": "), f["not_comparable_cause"])), "; ")))
            .when(F.size(differ) > 0, said(
                "MISMATCH", mean,
                [F.lit("Verified mismatch found in "), F.size(differ).cast("string"), F.lit(" field(s): "),
                 names(differ), F.lit(". Amendment notice generated.")],
                defects=F.transform(differ, lambda f: f["field"])))
            .otherwise(said("OK", mean, [
                F.lit("All 7 canonical shipping fields match verified document evidence exactly.")]))
        )

    return let(F.struct(
        category.alias("category"), fields.alias("fields"), issues.alias("issues"),
        document_reason(issues).alias("reason")), decide)


def roll_up_rows(cases: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Assessment per case from a table of comparisons.

    A case has seven comparisons, so what is gathered per key is bounded.
    """
    order = F.array_position(F.array(*[F.lit(f) for f in K.FIELDS]), F.col("field"))
    gathered = comparisons.groupBy(*schema.KEY).agg(F.sort_array(F.collect_list(
        F.struct(order.alias("place"), "field", "result", "not_comparable_cause", "private_cause",
                 "confidence"))).alias("fields"))
    joined = cases.select(*schema.KEY, "category", "document_issues").join(gathered, schema.KEY, "left")
    none = F.array().cast(
        "array<struct<place:bigint,field:string,result:string,not_comparable_cause:string,"
        "private_cause:string,confidence:double>>")
    return joined.select(*schema.KEY, roll_up(
        F.col("category"), F.coalesce("fields", none),
        F.coalesce("document_issues", F.array().cast("array<string>"))).alias("a")).select(*schema.KEY, "a.*")


def follow_up(workflow: Column, status: Column) -> Column:
    return (
        F.when(workflow == "BLOCKED_EXTERNAL", "AWAIT_EXTERNAL")
        .when((workflow == "COMPLETED") & (status == "MISMATCH"), "CORRECTION_REQUIRED").otherwise("NONE"))


def workflow_status(review: Column) -> Column:
    return (
        F.when(review.isNull(), "COMPLETED")
        .when(review["blocks_externally"], "BLOCKED_EXTERNAL").otherwise("AWAITING_HUMAN"))
