"""Evidence checks: source, label, derivation. The first failing gate counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladingcheck import constants as K
from ladingcheck.functions import labels, numbers
from ladingcheck.functions.text import let, normalize_party, normalize_port, strip


def failure(gate: str, reason: str) -> Column:
    return F.struct(F.lit(gate).alias("gate"), F.lit(reason).alias("reason"))


def quote_supported(quote: Column, locator_kind: Column, texts: Column) -> Column:
    """The quote is the stored text; part of it where the locator is a container."""
    # Not array_contains: it leaves its loop by an exception where it finds something.
    whole = F.when(quote.isNotNull(), F.exists(texts, lambda t: t == quote))
    part = (strip(quote) != "") & F.exists(texts, lambda t: F.contains(t, quote))
    return F.when(locator_kind == "text_range", whole).otherwise(part)


# --- inside a case row -----------------------------------------------------------------


def machine_failure(value: Column) -> Column:
    """First failing gate of a value the extraction itself produced, or NULL.

    Such a value was read from its own block, so what can fail is a supporting
    quote of another block and a unit taken from a heading without its evidence;
    the derivation gate would repeat the identical computation.
    """
    primary = F.get(value["evidence"], F.lit(0))
    allowed = F.concat(value["texts"], value["reference_texts"])
    rest = F.slice(value["evidence"], F.lit(2), F.greatest(F.size(value["evidence"]) - 1, F.lit(0)))
    unit = (value["field"] == "gross_weight_kg") & F.array_contains(value["flags"], "UNIT_FROM_LABEL")
    return (
        F.when(F.size(value["evidence"]) == 0, failure("G1", "NO_EVIDENCE"))
        .when(~quote_supported(primary["text"], primary["locator"]["kind"], value["texts"]),
              failure("G1", "QUOTE_MISMATCH"))
        .when(F.exists(rest, lambda e: e["document_id"] != value["document_id"]),
              failure("G1", "EVIDENCE_OUTSIDE_DOCUMENT"))
        .when(F.exists(rest, lambda e: ~quote_supported(e["text"], e["locator"]["kind"], allowed)),
              failure("G1", "SUPPORTING_QUOTE_MISMATCH"))
        .when(unit & value["unit_evidence"].isNull(), failure("G2", "UNIT_EVIDENCE_MISSING"))
        .when(unit & ~value["unit_in_label"], failure("G2", "UNIT_NOT_IN_LABEL"))
    )


# --- over tables of supplied candidates ------------------------------------------------


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that filters and selections after it read and never repeat.

    A plain column is written out again wherever a later filter names it; one that a generator gives is not.
    """
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def attach_blocks(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidates with the document they name, their bound block and the referenced one.

    documents: document_id, content_hash, status, convention, field_blocks and the
    hash the run expects. Joined on document_id; blocks are looked up in the row.
    """
    named = documents.select(
        F.col("document_id").alias("doc_id"), "content_hash", "expected_hash", "status", "convention",
        F.col("all_blocks").alias("blocks"))
    joined = candidates.join(named, candidates.document_id == named.doc_id, "left")

    def block_at(ord_):
        return F.get(F.filter(F.col("blocks"), lambda b: b["ord"] == ord_), F.lit(0))

    found = F.struct(block_at(F.col("block_ord")).alias("block"), block_at(F.col("reference_ord")).alias("ref_block"))
    return once(joined, "_found", found).withColumns(
        {"block": F.col("_found.block"), "ref_block": F.col("_found.ref_block")}).drop("_found")


def _texts(block: Column) -> Column:
    return F.when(block.isNotNull(), F.concat(F.array(block["value"]), F.transform(block["extra"], lambda e: e["text"]))) \
        .otherwise(F.array().cast("array<string>"))


def check_source() -> Column:
    """Gate 1 over attached candidates."""
    block, evidence = F.col("block"), F.col("evidence")
    primary = F.get(evidence, F.lit(0))
    rest = F.slice(evidence, F.lit(2), F.greatest(F.size(evidence) - 1, F.lit(0)))
    locators = F.concat(F.array(block["locator"]), F.transform(block["extra"], lambda e: e["locator"]))
    allowed = F.concat(_texts(block), _texts(F.col("ref_block")))
    return (
        F.when(F.col("doc_id").isNull(), failure("G1", "WRONG_DOCUMENT"))
        .when(F.col("status") != "OK", failure("G1", "DOCUMENT_NOT_PARSED"))
        .when(F.col("expected_hash") != F.col("content_hash"), failure("G1", "STALE_ARTIFACT"))
        .when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, failure("G1", "NO_EVIDENCE"))
        .when(block.isNull(), failure("G1", "NO_BOUND_BLOCK"))
        .when(primary["document_id"] != F.col("doc_id"), failure("G1", "EVIDENCE_OUTSIDE_DOCUMENT"))
        .when(~F.array_contains(locators, primary["locator"]), failure("G1", "EVIDENCE_NOT_IN_BOUND_BLOCK"))
        .when(~quote_supported(primary["text"], primary["locator"]["kind"], _texts(block)),
              failure("G1", "QUOTE_MISMATCH"))
        .when(F.exists(rest, lambda e: e["document_id"] != F.col("doc_id")),
              failure("G1", "EVIDENCE_OUTSIDE_DOCUMENT"))
        .when(F.exists(rest, lambda e: ~quote_supported(e["text"], e["locator"]["kind"], allowed)),
              failure("G1", "SUPPORTING_QUOTE_MISMATCH"))
    )


def check_label() -> Column:
    """Gate 2 over attached candidates: the block's own label supports the field."""
    block, ref = F.col("block"), F.col("ref_block")
    field = F.col("field")
    unit = (field == "gross_weight_kg") & F.array_contains("flags", "UNIT_FROM_LABEL")

    def plain(variants):
        return (
            F.when(F.coalesce(block["label"], F.lit("")) == "", failure("G2", "NO_LABEL"))
            .when(labels.negative_for(field, variants), failure("G2", "NEGATIVE_LABEL"))
            .when(~labels.match_field(block["label"]).eqNullSafe(field),
                  failure("G2", "LABEL_DOES_NOT_SUPPORT_FIELD"))
            .when(unit & F.col("unit_evidence").isNull(), failure("G2", "UNIT_EVIDENCE_MISSING"))
            .when(unit & ~(labels.declares_kg(variants) | labels.declares_tonnes(variants)),
                  failure("G2", "UNIT_NOT_IN_LABEL"))
        )

    reference = (
        F.when(~F.col("reference_field").eqNullSafe("consignee"), failure("G2", "UNSUPPORTED_REFERENCE"))
        .when(~labels.match_field(block["label"]).eqNullSafe("notify_party"),
              failure("G2", "LABEL_DOES_NOT_SUPPORT_FIELD"))
        .when(ref.isNull(), failure("G2", "REFERENCE_BLOCK_MISSING"))
        .when(~labels.match_field(ref["label"]).eqNullSafe("consignee"),
              failure("G2", "REFERENCE_LABEL_MISMATCH"))
    )
    return (
        F.when(block.isNull(), failure("G2", "NO_BOUND_BLOCK"))
        .when(F.col("derivation") == "REFERENCE", reference)
        .otherwise(let(labels.label_variants(block["label"]), plain))
    )


def check_derivation(policy: str = "auto") -> Column:
    """Gate 3: the value recomputed from the stored block equals the proposed one.

    Needs ``consignee_key`` (the same side's consignee) and ``registry_convention``.
    """
    block, field, proposed = F.col("block"), F.col("field"), F.col("norm_key")
    convention = F.when(F.col("convention") != "", F.col("convention")).otherwise(
        F.coalesce("registry_convention", F.lit("")))

    def count(c):
        return F.when(c["number"].isNull(), failure("G3", "COUNT_NOT_DERIVABLE")).when(
            c["number"] != proposed, failure("G3", "COUNT_MISMATCH"))

    def weight(w):
        return F.when(w["number"].isNull(), failure("G3", "WEIGHT_NOT_DERIVABLE")).when(
            w["number"] != proposed, failure("G3", "WEIGHT_MISMATCH"))

    def numeric(variants):
        return F.when(field == "container_count", let(
            numbers.parse_count(block["value"], labels.is_ambiguous_count(variants)), count)
        ).when(field == "gross_weight_kg", let(
            numbers.parse_weight(block["value"], labels.declares_kg(variants), labels.declares_tonnes(variants),
                                 F.lit(policy), convention), weight))

    return (
        F.when(proposed.isNull(), failure("G3", "NO_NORMALIZED_VALUE"))
        .when(F.col("derivation") == "REFERENCE",
              F.when(F.col("consignee_key").isNull(), failure("G3", "REFERENCE_TARGET_MISSING"))
              .when(F.col("consignee_key") != proposed, failure("G3", "REFERENCE_MISMATCH")))
        .when(block.isNull(), failure("G3", "NO_BOUND_BLOCK"))
        .when(field.isin(*K.PARTY_FIELDS),
              F.when(normalize_party(block["value"]) != proposed, failure("G3", "PARTY_DERIVATION_MISMATCH")))
        .when(field.isin(*K.PORT_FIELDS),
              F.when(normalize_port(block["value"]) != proposed, failure("G3", "PORT_DERIVATION_MISMATCH")))
        .when(field.isin(*K.NUMERIC_FIELDS), let(labels.label_variants(block["label"]), numeric))
        .otherwise(failure("G3", "UNKNOWN_FIELD"))
    )


def ground(candidates: DataFrame, documents: DataFrame, policy: str = "auto") -> DataFrame:
    """Candidates with ``failed_gate`` and ``failure`` (both NULL when all gates pass)."""
    attached = attach_blocks(candidates, documents)
    # The gates run in order and only until one fails.
    failed = F.coalesce(check_source(), check_label(), check_derivation(policy))
    return once(attached, "_failed", failed).withColumns({
        "failed_gate": F.col("_failed.gate"), "failure": F.col("_failed.reason"),
    }).drop("_failed", "blocks", "block", "ref_block", "doc_id", "expected_hash",
            "content_hash", "status", "convention")


def document_support(proposals: DataFrame, documents: DataFrame) -> DataFrame:
    """Proposals (field, side, document_id, norm_key, …) with the first block that
    supports them: its label names the field and its readings contain the value.

    Adds ``supported`` and ``support`` (label, raw, block_ord, evidence).
    """
    named = documents.select(F.col("document_id").alias("doc_id"), F.col("status").alias("doc_status"),
                             F.col("convention").alias("doc_convention"), "field_blocks")
    joined = proposals.join(named, proposals.document_id == named.doc_id, "left")
    convention = F.when(F.col("doc_convention") != "", F.col("doc_convention")).otherwise(
        F.coalesce("registry_convention", F.lit("")))
    field, wanted = F.col("field"), F.col("norm_key")

    def admits(block):
        return let(labels.label_variants(block["label"]), lambda v: F.array_contains(
            numbers.interpretations(field, block["value"], labels.is_ambiguous_count(v), labels.declares_kg(v),
                                    labels.declares_tonnes(v), convention), wanted))

    fitting = F.filter(F.col("field_blocks"), lambda b: (b["field"] == field) & admits(b))
    ordered = F.array_sort(F.transform(fitting, lambda b: F.struct(
        b["ord"].alias("block_ord"), b["label"].alias("label"), b["value"].alias("raw"),
        b["locator"].alias("locator"), b["label_locator"].alias("label_locator"),
        F.concat(F.array(b["value"]), F.transform(b["extra"], lambda e: e["text"])).alias("texts"))))
    first = F.get(ordered, F.lit(0))
    return joined.withColumn("support", F.when(F.col("doc_status") == "OK", first)).withColumn(
        "supported", F.col("support").isNotNull()
    ).drop("doc_id", "doc_status", "doc_convention", "field_blocks")
