"""The case table: verified mails with run, review and metric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladingcheck import schema
from ladingcheck.functions.text import let

_ID = 32


def _digest(prefix: str, *parts):
    joined = F.concat_ws("\x00", *parts).cast("binary")
    return F.concat(F.lit(prefix), F.left(F.sha2(joined, 256), F.lit(_ID)))


def to_cases(verified: DataFrame) -> DataFrame:
    """Adds run_id, review_id, review_status, metrics and operational columns.

    Ids are derived from keys, so running the plan again gives the same rows.
    """
    run_id = _digest("run_", "run_kind", "case_id", F.lit("1"))
    with_run = verified.withColumn("run_id", run_id)
    return with_run.withColumns({
        "review_id": F.when(F.col("review").isNotNull(), _digest("rev_", "run_id")),
        "review_status": F.when(F.col("review").isNotNull(), "OPEN"),
        "notified_at": F.lit(None).cast("timestamp"),
        "machine_status": F.col("assessment.status"),
        "review_reason": F.col("assessment.review_reason"),
        "resolution_status": F.lit(None).cast("string"),
        "final_status": F.col("assessment.status"),
        "demo_safe": F.col("registry") == "synthetic_demo",
        "ai_calls": F.lit(0).cast("bigint"),
        "ai_assisted_fields": F.lit(0).cast("bigint"),
        "started_at": F.col("received_at"),
        "updated_at": F.col("received_at"),
        "completed_at": F.when(F.col("workflow_status") == "COMPLETED", F.col("received_at")),
        "had_review": F.col("review").isNotNull(),
    }).withColumn("processing_ms", F.unix_millis(F.col("completed_at").cast("timestamp"))
                  - F.unix_millis(F.col("started_at").cast("timestamp")))


def side_values(cases: DataFrame) -> DataFrame:
    """One row per value present on a side of a comparison, with its provenance."""
    def origin(v):
        return (
            F.when(F.array_contains(v["flags"], "MANUAL_OVERRIDE"), "MANUAL_OVERRIDE")
            .when(v["method"] == "HUMAN", "DOCUMENT_CONFIRMED").otherwise("DOCUMENT_EXTRACTED"))

    def row(f, side, v):
        return F.struct(
            f["field"].alias("field"), F.lit(side).alias("side"), v["document_id"].alias("document_id"),
            v["raw"].alias("raw"), v["norm_kind"].alias("norm_kind"), v["norm_key"].alias("norm_key"),
            F.when(v["method"] == "RULE", "DETERMINISTIC").otherwise(v["method"]).alias("resolved_by"),
            origin(v).alias("value_origin"), (origin(v) != "MANUAL_OVERRIDE").alias("grounded"),
            v["flags"].alias("flags"), F.array_distinct(v["evidence"]).alias("evidence"))

    both = F.flatten(F.transform("fields", lambda f: F.array(row(f, "SI", f["si"]), row(f, "BL", f["bl"]))))
    present = F.filter(both, lambda v: v["norm_key"].isNotNull())
    return cases.select(*schema.KEY, "run_id", F.explode(present).alias("v")).select(
        *schema.KEY, "run_id", "v.*")


def field_value(cases: DataFrame, confirmations: DataFrame | None = None) -> DataFrame:
    """``side_values`` with the override confirmations of applied decisions attached.

    confirmations: run_id, field, side, confirmation.
    """
    values = side_values(cases)
    if confirmations is None:
        return values
    gathered = confirmations.groupBy("run_id", "field", "side").agg(
        F.max_by("confirmation", "sequence").alias("override_confirmation"))
    return values.join(gathered, ["run_id", "field", "side"], "left")


def comparison_rows(cases: DataFrame) -> DataFrame:
    """One row per (case, field)."""
    return cases.select(*schema.KEY, "run_id", F.explode("fields").alias("f")).select(
        *schema.KEY, "run_id", "f.field", "f.result", "f.not_comparable_cause", "f.private_cause", "f.compared_by",
        "f.confidence", "f.explanation", F.col("f.si").alias("si"), F.col("f.bl").alias("bl"))


def first_document(documents, role: str):
    """First document of a role in the case's own order, or NULL."""
    return let(F.filter(documents, lambda d: d["role"] == role), lambda found: F.get(found, F.lit(0)))
