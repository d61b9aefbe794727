"""Invariants of the case tables. Each audit returns one row per violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladingcheck import constants as K
from ladingcheck import schema
from ladingcheck.operators.compare import values_equal


def _violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    broken = F.array_compact(F.array(*[
        F.when(F.coalesce(test, F.lit(False)), name) for name, test in rules.items()]))
    return rows.select(*keys, F.explode(broken).alias("rule"))


def audit_comparisons(comparisons: DataFrame) -> DataFrame:
    """comparisons: key, field, result, not_comparable_cause, si, bl."""
    open_ = F.col("result") == "NOT_COMPARABLE"
    si, bl = F.col("si"), F.col("bl")
    numeric = F.col("field").isin(*K.NUMERIC_FIELDS)

    def wrong_type(v):
        return v["norm_key"].isNotNull() & (numeric == (v["norm_kind"] == "TEXT"))

    def not_whole(v):
        return (F.col("field") == "container_count") & v["norm_key"].isNotNull() & ~v["norm_key"].rlike(r"^[1-9]\d{0,15}$")

    def unproven(v):
        override = F.array_contains(v["flags"], "MANUAL_OVERRIDE") \
            | F.array_contains(v["flags"], "INHERITED_MANUAL_OVERRIDE")
        return v["norm_key"].isNull() | (~F.coalesce(override, F.lit(False)) & (F.size(v["evidence"]) == 0))

    both = si["norm_key"].isNotNull() & bl["norm_key"].isNotNull()
    return _violations(comparisons, [*schema.KEY, "field"], {
        "cause must match NOT_COMPARABLE": open_ != F.col("not_comparable_cause").isNotNull(),
        "value has the wrong type": wrong_type(si) | wrong_type(bl),
        "count must be a positive safe integer": not_whole(si) | not_whole(bl),
        "comparable values need grounding or an override": ~open_ & (unproven(si) | unproven(bl)),
        "result must follow equality": ~open_ & both
        & (values_equal(F.col("field"), si, bl) != (F.col("result") == "MATCH")),
    })


def audit_assessments(cases: DataFrame) -> DataFrame:
    a = F.col("assessment")
    fields, reason, defect = a["defect_fields"], a["review_reason"], a["has_defect"]
    return _violations(cases, schema.KEY, {
        "duplicate defect field": F.size(F.array_distinct(fields)) != F.size(fields),
        "mismatch needs defect fields and no reason":
            (a["status"] == "MISMATCH") & (~defect | (F.size(fields) == 0) | reason.isNotNull()),
        "only a mismatch has defects": (a["status"] != "MISMATCH") & (defect | (F.size(fields) > 0)),
        "review needs a reason": (a["status"] == "NEEDS_REVIEW") & reason.isNull(),
        "only a review has a reason": (a["status"] == "OK") & reason.isNotNull(),
    })


def audit_reviews(reviews: DataFrame) -> DataFrame:
    """reviews: review_id, review_status, closed_at, close_reason and the review columns."""
    mode, scope = F.col("ui_mode"), F.col("scope")
    open_ = F.col("review_status") == "OPEN"
    expected = (
        F.when(mode == "CHOICE", F.array(F.lit("SELECT_OPTION")))
        .when(mode == "VALUE_INPUT", F.array(F.lit("ACKNOWLEDGE"), F.lit("PROVIDE_VALUE")))
        .otherwise(F.array(F.lit("ACKNOWLEDGE")))
    )
    options = F.col("options")
    candidates = F.filter(options, lambda o: o["kind"] != "ESCAPE")
    ids = F.transform(options, lambda o: o["option_id"])
    escapes = F.size(F.filter(options, lambda o: (o["option_id"] == K.NONE_OF_THESE) & (o["kind"] == "ESCAPE")))
    wanted = F.when(scope == "FIELD", "VALUE").otherwise("DOCUMENT")
    least = F.when(scope == "FIELD", 2).otherwise(1)
    field_target = (
        F.col("field").isNull() | F.col("side").isNull() | F.col("target_role").isNotNull() | (mode == "ACKNOWLEDGE"))
    document_target = (
        F.col("field").isNotNull() | F.col("side").isNotNull()
        | F.when(mode == "CHOICE", F.col("target_role").isNull()).otherwise(F.col("target_role").isNotNull()))
    return _violations(reviews, ["review_id"], {
        "closure disagrees with status": F.when(
            open_, F.col("closed_at").isNotNull() | F.col("close_reason").isNotNull()
        ).otherwise(F.col("closed_at").isNull() | F.col("close_reason").isNull()),
        "invalid target": F.when(scope == "FIELD", field_target).otherwise(document_target),
        "document review asks for a value": (scope == "DOCUMENT") & (mode == "VALUE_INPUT"),
        "actions disagree with mode": F.array_sort("allowed_actions") != expected,
        "choice needs unique options and one escape": (mode == "CHOICE") & (
            options.isNull() | (F.size(F.array_distinct(ids)) != F.size(options)) | (escapes != 1)),
        "candidates disagree with scope": (mode == "CHOICE") & (
            (F.size(candidates) < least) | F.exists(candidates, lambda o: o["kind"] != wanted)),
        "only a choice has options": (mode != "CHOICE") & options.isNotNull(),
    })


def audit_cases(cases: DataFrame) -> DataFrame:
    """Rules across the parts of a case; all within its row."""
    w, status = F.col("workflow_status"), F.col("machine_status")
    effective = F.coalesce("resolution_status", "machine_status")
    review, open_ = F.col("review"), F.coalesce(F.col("review_status") == "OPEN", F.lit(False))
    bl = F.col("category") == "BL_COMPARISON"
    names = F.transform("fields", lambda f: f["field"])
    ids = F.transform("documents", lambda d: d["document_id"])
    follow = F.when(w == "BLOCKED_EXTERNAL", "AWAIT_EXTERNAL").when(
        effective == "MISMATCH", "CORRECTION_REQUIRED").otherwise("NONE")
    cited = F.flatten(F.transform("fields", lambda f: F.flatten(F.filter(F.array(
        F.transform(f["si"]["evidence"], lambda e: e["document_id"]),
        F.transform(f["bl"]["evidence"], lambda e: e["document_id"])), lambda a: a.isNotNull()))))
    asked = F.coalesce(review["source_document_ids"], F.array().cast("array<string>"))
    offered = F.transform(F.filter(review["options"], lambda o: o["kind"] == "DOCUMENT"), lambda o: o["document_id"])
    results = F.transform("fields", lambda f: f["result"])
    expected = F.when(F.array_contains(results, "NOT_COMPARABLE"), "NEEDS_REVIEW").when(
        F.array_contains(results, "MISMATCH"), "MISMATCH").otherwise("OK")

    def held(role):
        return F.size(F.filter("documents", lambda d: d["role"] == role)) > 1

    rules = {
        "settled state needs an assessment": status.isNull() & ~w.isin("PROCESSING", "FAILED"),
        "assessment needs a classification":
            status.isNotNull() & (F.col("category").isNull() | F.col("classified_by").isNull()),
        "awaiting human needs an open question":
            (w == "AWAITING_HUMAN") & (review.isNull() | ~open_ | (review["ui_mode"] == "ACKNOWLEDGE")),
        "external block needs an acknowledgement":
            (w == "BLOCKED_EXTERNAL") & (review.isNull() | (open_ & (review["ui_mode"] != "ACKNOWLEDGE"))),
        "completed needs a settled outcome":
            (w == "COMPLETED") & (open_ | effective.isNull() | (effective == "NEEDS_REVIEW")),
        "failed has no open review": (w == "FAILED") & open_,
        "open review needs a waiting workflow": open_ & ~w.isin("AWAITING_HUMAN", "BLOCKED_EXTERNAL"),
        "duplicate field": F.size(F.array_distinct(names)) != F.size(names),
        "settled comparison needs seven fields": bl & ~w.isin("PROCESSING", "FAILED") & (F.size(names) != 7),
        "other categories are OK without fields": ~bl & ((F.size(names) > 0) | (status != "OK")),
        "completion time iff completed": (w == "COMPLETED") != F.col("completed_at").isNotNull(),
        "wrong follow-up": F.col("follow_up") != follow,
        "duplicate document": F.size(F.array_distinct(ids)) != F.size(ids),
        "two documents in one role": held("SI") | held("BL"),
        "evidence names an unknown document": F.size(F.array_except(cited, ids)) > 0,
        "review names an unknown document":
            (F.size(F.array_except(asked, ids)) > 0) | (F.size(F.array_except(offered, ids)) > 0),
        "outcome disagrees with fields": (w == "COMPLETED") & bl & (effective != expected),
    }
    return _violations(cases, schema.KEY, rules)


def audit_overrides(values: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Direct human overrides without a confirmation bound to run, field, side and value."""
    direct = values.filter((F.col("value_origin") == "MANUAL_OVERRIDE") & (F.col("resolved_by") == "HUMAN"))
    bound = confirmations.select("run_id", "field", "side", F.col("norm_key"))
    return direct.join(bound, ["run_id", "field", "side", "norm_key"], "left_anti").select(
        *schema.KEY, "field", "side", F.lit("override without confirmation").alias("rule"))


def audit_stats(stats: DataFrame, counts: DataFrame) -> DataFrame:
    """Checks of the one-row statistics against the zero-filled counts."""
    def total(dimension):
        return F.sum(F.when(F.col("dimension") == dimension, F.col("cases")).otherwise(0))

    def one(dimension, value):
        return F.sum(F.when((F.col("dimension") == dimension) & (F.col("value") == value), F.col("cases")).otherwise(0))

    sums = counts.agg(
        *[total(d).alias(f"sum_{d}") for d in ("workflow_status", "category", "machine_status", "effective_status")],
        one("workflow_status", "COMPLETED").alias("completed"),
        (one("workflow_status", "AWAITING_HUMAN") + one("workflow_status", "BLOCKED_EXTERNAL")).alias("waiting"))
    row = stats.crossJoin(sums).withColumn("scope", F.lit("stats"))
    t = F.col("total_cases")
    return _violations(row, ["scope"], {
        "workflow counts differ from total": F.col("sum_workflow_status") != t,
        "category counts differ from total": F.col("sum_category") + F.col("unclassified") != t,
        "more machine statuses than cases": F.col("sum_machine_status") > t,
        "more effective statuses than cases": F.col("sum_effective_status") > t,
        "comparison counts do not add up":
            F.col("bl_ok") + F.col("bl_mismatch") + F.col("bl_needs_review") != F.col("bl_total"),
        "more auto-completed than completed": F.col("auto_completed") > F.col("completed"),
        "more waiting than waiting states": F.col("awaiting_human_now") > F.col("waiting"),
        "more assisted than cases": F.col("ai_assisted_cases") > t,
    })


# --- export gate ------------------------------------------------------------------------------


class ExportRefused(RuntimeError):
    """The export would be incomplete; nothing was written."""


def export_problems(cases: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """Ids that stop an export: no assessment or category, or required but not there."""
    lacking = cases.filter(F.col("machine_status").isNull() | F.col("category").isNull()).select(
        "case_id", F.lit("NO_ASSESSMENT").alias("problem"))
    if required is None:
        return lacking
    ready = cases.filter(F.col("machine_status").isNotNull() & F.col("category").isNotNull()).select("case_id")
    absent = required.select(F.trim("case_id").alias("case_id")).filter("case_id != ''").distinct().join(
        ready, "case_id", "left_anti").select("case_id", F.lit("MISSING").alias("problem"))
    return lacking.unionByName(absent)


def export_gate(cases: DataFrame, run_kind: str = "EVAL", required: DataFrame | None = None) -> DataFrame:
    """The cases of one run kind, or ExportRefused with the number of problems and the first; export_problems has all."""
    selected = cases.filter(F.col("run_kind") == run_kind)
    bad = export_problems(selected, required).agg(
        F.count("*").alias("n"), F.min(F.struct("case_id", "problem")).alias("first")).first()
    if bad.n:
        raise ExportRefused(f"{bad.n} problems, the first in {bad.first.case_id}: {bad.first.problem}")
    return selected
