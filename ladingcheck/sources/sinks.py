"""Submission, manifest and case reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladingcheck import schema
from ladingcheck.functions.text import let


def submission_rows(cases: DataFrame) -> DataFrame:
    """case_id with the five exported attributes."""
    return cases.select(
        "case_id", "category", F.col("assessment.status").alias("status"), "review_reason",
        F.col("assessment.has_defect").alias("has_defect"), F.col("assessment.defect_fields").alias("defect_fields"))


def submission_lines(cases: DataFrame) -> DataFrame:
    """``"id": {…}`` entries in id order; keys inside an entry are sorted."""
    body = F.to_json(F.struct("category", "defect_fields", "has_defect", "review_reason", "status"),
                     {"ignoreNullFields": "false"})
    return submission_rows(cases).select("case_id", body.alias("body"))


def write_submission(cases: DataFrame, path: str) -> None:
    """JSON lines ``{"email_id": …, …}``, range-partitioned by id: part files in id order."""
    rows = submission_rows(cases).withColumnRenamed("case_id", "email_id")
    rows.orderBy("email_id").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_submission_object(cases: DataFrame, path: str) -> None:
    """The same as one JSON object, still written in parallel.

    Each line is one entry; the first and the last id carry the braces, so the part
    files read in order are one object and nothing is gathered.
    """
    lines = submission_lines(cases)
    ends = lines.agg(F.min("case_id").alias("lo"), F.max("case_id").alias("hi"))
    text = F.concat(
        F.when(F.col("case_id") == F.col("lo"), "{").otherwise(""), F.lit('"'), "case_id", F.lit('": '), "body",
        F.when(F.col("case_id") == F.col("hi"), "}").otherwise(","))
    lines.crossJoin(F.broadcast(ends)).orderBy("case_id").select(text.alias("value")).write.mode("overwrite").text(path)


#: Characters of an id that one level of the digest folds; a group is the ids that differ in these only.
DIGEST_STEP = 3


def payload_digest(cases: DataFrame, levels: int = 3) -> DataFrame:
    """One row: total and a SHA-256 over all entries in id order that does not depend on layout.

    Entries are hashed one by one; ids that share all but their last characters form a group whose hashes are hashed in id
    order, and so on, until nothing of the longest id is left. No task sees more than the ids that differ in
    DIGEST_STEP characters, however the ids are made. After ``levels`` levels a group of one keeps its hash.
    """
    hashed = submission_lines(cases).select(
        F.col("case_id").alias("id"), F.lit(1).cast("bigint").alias("n"),
        F.sha2(F.concat_ws("\n", "case_id", "body").cast("binary"), 256).alias("h"))

    longest = cases.agg(F.max(F.length("case_id"))).first()[0] or 0
    total, digest = _fold()
    return _groups(hashed, levels, longest).agg(total.alias("total_cases"), digest.alias("sha256"))


def _fold() -> tuple[Column, Column]:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "h"))), lambda e: e["h"])
    return F.sum("n").alias("n"), F.sha2(F.array_join(ordered, "").cast("binary"), 256).alias("h")


def _groups(hashed: DataFrame, levels: int, longest: int) -> DataFrame:
    """id, n, h of what is left when the characters of the longest id are folded, ``levels`` times at least."""
    for level in range(max(levels, -(-longest // DIGEST_STEP))):
        shorter = F.left("id", F.greatest(F.length("id") - DIGEST_STEP, F.lit(0)))
        total, digest = _fold()
        if level >= levels:
            digest = F.when(F.count(F.lit(1)) == 1, F.min("h")).otherwise(digest).alias("h")
        hashed = hashed.withColumn("group", shorter).groupBy("group").agg(total, digest).withColumnRenamed("group", "id")
    return hashed


def manifest(cases: DataFrame, run_kind: str, input_version: str = "v1", config_version: str = "v1") -> DataFrame:
    """One row describing an export; the run of each case is ``manifest_runs``."""
    return payload_digest(cases).select(
        F.lit("2.1.1").alias("schema_version"), F.lit(run_kind).alias("run_kind"),
        F.lit(input_version).alias("input_version"), F.lit(config_version).alias("config_version"),
        "total_cases", "sha256")


def manifest_runs(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", "run_id")


def write_manifest(cases: DataFrame, path: str, run_kind: str) -> None:
    manifest(cases, run_kind).write.mode("overwrite").json(f"{path}/manifest")
    manifest_runs(cases).write.mode("overwrite").json(f"{path}/selected_runs")


# --- reports ----------------------------------------------------------------------------------

REPORT_COLUMNS = (
    "Case ID", "Email Subject", "Email Sender", "Category", "Workflow Status", "Overall Machine Status",
    "Overall Confidence", "Follow Up Action", "Case Summary Explanation", "Document Hashes (SHA-256)", "Field Name",
    "Comparison Result", "Field Confidence", "Field Explanation", "SI Raw Value", "SI Normalized",
    "SI Evidence Quote", "BL Raw Value", "BL Normalized", "BL Evidence Quote", "Resolved By", "AI Calls Used",
)


def _percent(c: Column) -> Column:
    """Whole percent, cut off; an absent or zero confidence reads as 100."""
    whole = F.when(F.coalesce(c, F.lit(0.0)) == 0, 1.0).otherwise(c)
    return F.concat((whole * 100).cast("int").cast("string"), F.lit("%"))


def _quotes(value: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(value["evidence"], lambda e: e["text"]), " | "), F.lit(""))


def report_rows(cases: DataFrame) -> DataFrame:
    """22 columns, one row per compared field; one row for a case without fields."""
    hashes = F.transform(
        F.filter("documents", lambda d: d["content_hash"] != ""),
        lambda d: F.concat(d["filename"], F.lit(" (sha256:"), d["content_hash"], F.lit(")")))
    exploded = cases.withColumn("_hashes", F.when(
        F.size("documents") > 0, F.array_join(hashes, " | ")).otherwise("None")).select(
        "*", F.explode_outer("fields").alias("f"))
    f, a = F.col("f"), F.col("assessment")
    plain = f.isNull()

    def text(c):
        return F.coalesce(c, F.lit(""))

    values = (
        F.col("case_id"), text(F.col("subject")), text(F.col("from_addr")), text(F.col("category")),
        F.col("workflow_status"), text(a["status"]), _percent(a["overall_confidence"]), F.col("follow_up"),
        text(a["explanation"]), F.col("_hashes"),
        F.when(plain, "N/A").otherwise(f["field"]), F.when(plain, "N/A").otherwise(f["result"]),
        F.when(plain, "100%").otherwise(_percent(f["confidence"])),
        F.when(plain, text(a["explanation"])).otherwise(text(f["explanation"])),
        text(f["si"]["raw"]), text(f["si"]["norm_key"]), _quotes(f["si"]),
        text(f["bl"]["raw"]), text(f["bl"]["norm_key"]), _quotes(f["bl"]),
        F.when(plain, "DETERMINISTIC").otherwise(f["compared_by"]), F.col("ai_calls"),
    )
    return exploded.select(*[v.alias(n) for v, n in zip(values, REPORT_COLUMNS)])


def write_report_csv(cases: DataFrame, path: str) -> None:
    report_rows(cases).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def report_documents(cases: DataFrame) -> DataFrame:
    """One nested report per case."""
    def side(v):
        return F.when(v["norm_key"].isNotNull(), let(F.struct(v.alias("v")), lambda s: F.struct(
            s["v"]["raw"].alias("raw"), s["v"]["norm_key"].alias("normalized"),
            s["v"]["method"].alias("resolved_by"),
            (~F.array_contains(s["v"]["flags"], "MANUAL_OVERRIDE")).alias("grounded"),
            _quotes(s["v"]).alias("evidence_quote"))))

    fields = F.transform("fields", lambda f: F.struct(
        f["field"].alias("field"), f["result"].alias("result"),
        f["not_comparable_cause"].alias("not_comparable_cause"), f["compared_by"].alias("compared_by"),
        f["confidence"].alias("confidence"), f["explanation"].alias("explanation"),
        side(f["si"]).alias("si"), side(f["bl"]).alias("bl")))
    return cases.select(
        *schema.KEY, "run_id", "workflow_status", "follow_up", "completed_at",
        F.struct(F.col("from_addr").alias("from"), "subject", "category", "classified_by",
                 "classification_reason").alias("email"),
        F.col("assessment").alias("machine_assessment"), fields.alias("fields"), "documents",
        F.when(F.col("review").isNotNull(), F.struct(
            "review_id", F.col("review_status").alias("status"), "review.scope", "review.ui_mode",
            "review.question", "review.context_summary")).alias("review"),
        F.struct("ai_calls", "ai_assisted_fields").alias("metrics"))


def write_report_json(cases: DataFrame, path: str) -> None:
    report_documents(cases).write.mode("overwrite").json(path)
