"""Which attachment is the shipping instruction and which the bill of lading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladingcheck import schema
from ladingcheck.functions.text import let


def filename_hint(filename: Column) -> Column:
    upper = F.upper(F.coalesce(filename, F.lit("")))
    return F.when(upper.rlike(r"_SI(?:\.|\z)"), "SI").when(upper.rlike(r"_BL(?:\.|\z)"), "BL")


def assess_role(scores: Column, readable: Column) -> Column:
    """struct(role, score): the strictly best supported type, else UNKNOWN."""
    def verdict(role, score):
        return F.struct(F.lit(role).alias("role"), score.cast("double").alias("score"))

    si, bl, other = scores["si"], scores["bl"], scores["other"]
    return (
        F.when(~readable | (F.greatest(si, bl, other) <= 0), verdict("UNKNOWN", F.lit(0.0)))
        .when((si > bl) & (si > other), verdict("SI", si))
        .when((bl > si) & (bl > other), verdict("BL", bl))
        .when((other > si) & (other > bl), verdict("OTHER", other))
        .otherwise(verdict("UNKNOWN", F.greatest(si, bl, other)))
    )


def role_scores(case_documents: DataFrame) -> DataFrame:
    """Parsed case documents with role, score, readable and the file name hint."""
    readable = F.col("status") == "OK"
    return case_documents.withColumns({
        "readable": readable,
        "verdict": assess_role(F.col("scores"), readable),
        "hint": filename_hint(F.col("filename")),
    }).withColumns({"role": F.col("verdict.role"), "score": F.col("verdict.score")}).drop("verdict")


def _candidates(docs: Column, role: str) -> Column:
    """Documents of one role, strongest first."""
    mine = F.filter(docs, lambda d: d["role"] == role)
    keyed = F.transform(mine, lambda d: F.struct(
        (-d["score"]).alias("by_score"), (-d["field_labels"]).alias("by_labels"),
        (~d["hint"].eqNullSafe(role)).alias("by_hint"), d["document_id"].alias("document_id"),
        d["score"].alias("score")))
    return F.array_sort(keyed)


def _resolve(docs: Column) -> Column:
    """struct(si, bl, si_alternatives, bl_alternatives, issues) from a case's documents."""
    def tied(c):
        return (F.size(c) > 1) & (F.get(c, F.lit(0))["score"] == F.get(c, F.lit(1))["score"])

    def pick(c):
        return F.when(~tied(c), F.get(c, F.lit(0))["document_id"])

    def ids(c):
        return F.transform(c, lambda d: d["document_id"])

    def with_candidates(docs):
        return F.struct(
            docs.alias("docs"),
            _candidates(docs, "SI").alias("si_c"), _candidates(docs, "BL").alias("bl_c"))

    def with_picks(x):
        return F.struct(
            x["docs"].alias("docs"), x["si_c"].alias("si_c"), x["bl_c"].alias("bl_c"),
            pick(x["si_c"]).alias("si"), pick(x["bl_c"]).alias("bl"),
            ids(F.filter(x["docs"], lambda d: (d["role"] == "UNKNOWN") & d["readable"])).alias("unknown"),
            F.exists(x["docs"], lambda d: ~d["readable"]).alias("unreadable"),
            F.exists(x["docs"], lambda d: d["role"] == "OTHER").alias("other"))

    def gap(x, role, c):
        return F.when(
            (F.size(c) > 1) | (F.size(x["unknown"]) > 0), f"{role}_ROLE_UNRESOLVED"
        ).when(x["unreadable"], f"{role}_UNREADABLE").when(x["other"], f"{role}_WRONG_DOC_TYPE") \
            .otherwise(f"{role}_MISSING")

    def alternatives(x, chosen, c):
        rest = F.filter(ids(c), lambda d: ~d.eqNullSafe(chosen))
        unresolved = F.when(F.size(c) > 1, ids(c)).otherwise(x["unknown"])
        return F.when(chosen.isNull() & (F.size(unresolved) > 0), unresolved).otherwise(rest)

    def finish(x):
        issues = F.array(
            F.when(tied(x["si_c"]), "SI_AMBIGUOUS_CANDIDATES"),
            F.when(tied(x["bl_c"]), "BL_AMBIGUOUS_CANDIDATES"),
            F.when(x["si"].isNull(), gap(x, "SI", x["si_c"])),
            F.when(x["bl"].isNull(), gap(x, "BL", x["bl_c"])),
            F.when(x["unreadable"], "UNREADABLE_DOCUMENT"),
        )
        return F.struct(
            x["si"].alias("si"), x["bl"].alias("bl"),
            alternatives(x, x["si"], x["si_c"]).alias("si_alternatives"),
            alternatives(x, x["bl"], x["bl_c"]).alias("bl_alternatives"),
            F.array_distinct(F.array_compact(issues)).alias("issues"),
        )

    return let(let(let(docs, with_candidates), with_picks), finish)


def payload() -> Column:
    """What extraction needs of a document."""
    return F.struct(
        "document_id", "content_hash", "status", "convention",
        F.array_contains("diagnostics", "IMAGE_ONLY_PAGE").alias("image_pages"),
        F.col("field_blocks").alias("blocks"),
    )


def resolve_roles(case_documents: DataFrame) -> DataFrame:
    """One row per case with its documents, the two roles and what is wrong.

    The best document of a role is taken by a max_by that combines before the
    shuffle; of the other documents only a few small columns are collected, at
    most one entry per attachment the mail itself lists.
    """
    scored = role_scores(case_documents)
    parsed = F.col("present") & F.col("status").isNotNull()
    small = F.struct(
        "position", "document_id", "filename", "media_type", "size_bytes", "content_hash", "demo_safe",
        "present", "issue", F.coalesce("status", F.lit("NOT_PARSED")).alias("parse_status"),
        "role", "score", "field_labels", "hint", "readable",
        F.coalesce("diagnostics", F.array().cast("array<string>")).alias("diagnostics"),
    )

    def best(role):
        return F.max_by(payload(), F.when(parsed & (F.col("role") == role), F.col("score")))

    grouped = scored.groupBy(*schema.KEY).agg(
        F.array_sort(F.collect_list(small)).alias("listed"),
        best("SI").alias("_si"), best("BL").alias("_bl"),
    )
    return finish_roles(grouped)


def _unique_present(listed: Column) -> Column:
    """Present documents; a path listed twice is one document."""
    present = F.filter(listed, lambda d: d["present"] & d["readable"].isNotNull())
    return let(present, lambda p: let(
        F.transform(p, lambda d: d["document_id"]),
        lambda ids: F.filter(p, lambda d, i: F.array_position(ids, d["document_id"]) == i + 1)))


def finish_roles(grouped: DataFrame) -> DataFrame:
    resolved = grouped.withColumn("roles", _resolve(_unique_present(F.col("listed"))))
    missing = F.filter("listed", lambda d: ~d["present"])
    issues = F.concat(
        F.col("roles.issues"), F.transform(missing, lambda d: F.lit("SOURCE_MISSING")))
    return resolved.withColumns({
        "si_payload": F.when(F.col("roles.si").isNotNull(), F.col("_si")),
        "bl_payload": F.when(F.col("roles.bl").isNotNull(), F.col("_bl")),
        "document_issues": with_missing_bl(issues, F.size(missing) > 0),
    }).drop("_si", "_bl")


def with_missing_bl(issues: Column, missing: Column) -> Column:
    """A missing source without a missing-role issue is reported as a missing BL."""
    named = F.arrays_overlap(issues, F.array(F.lit("SI_MISSING"), F.lit("BL_MISSING")))
    return F.when(missing & ~F.coalesce(named, F.lit(False)),
                  F.concat(issues, F.array(F.lit("BL_MISSING")))).otherwise(issues)


def role_of(document: Column, si: Column, bl: Column) -> Column:
    """Role shown for one document of a case once the two roles are known."""
    own = document["role"]
    return (
        F.when(~document["present"] | own.isNull(), "UNKNOWN")
        .when(document["document_id"] == si, "SI")
        .when(document["document_id"] == bl, "BL")
        .when(own.isin("SI", "BL"), "OTHER")
        .otherwise(own)
    )


def documents_with_roles(listed: Column, si: Column, bl: Column, assigned: Column) -> Column:
    """Document references of a case; roles are shown only where they were assigned."""
    return F.transform(listed, lambda d: F.struct(
        d["document_id"].alias("document_id"),
        F.when(assigned, role_of(d, si, bl)).otherwise("UNKNOWN").alias("role"),
        d["filename"].alias("filename"), d["media_type"].alias("media_type"),
        d["size_bytes"].alias("size_bytes"), F.coalesce(d["content_hash"], F.lit("")).alias("content_hash"),
        d["demo_safe"].alias("demo_safe"),
        F.when(d["present"], d["parse_status"]).otherwise("NOT_PARSED").alias("parse_status"),
    ))
