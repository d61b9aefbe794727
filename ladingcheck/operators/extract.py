"""Blocks to candidates, candidates to one value (or one cause) per side and field.

All of it is array work inside one row per case: a side has at most the blocks
of one document, so there is nothing to shuffle.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladingcheck import constants as K
from ladingcheck import schema
from ladingcheck.functions import labels, numbers, ports
from ladingcheck.functions.text import is_missing, let, normalize_party, normalize_port, same_as_consignee, strip

EVIDENCE = f"struct<document_id:string,locator:{schema.LOCATOR},text:string>"
CANDIDATE = (
    "struct<field:string,side:string,document_id:string,label:string,raw:string,norm_kind:string,"
    "norm_key:string,derivation:string,method:string,reference_field:string,components:array<string>,"
    f"flags:array<string>,issues:array<string>,evidence:array<{EVIDENCE}>,unit_evidence:{EVIDENCE},"
    "block_ord:int,reference_ord:int,texts:array<string>,reference_texts:array<string>,unit_in_label:boolean>"
)
# What is kept of a candidate once it has been chosen and checked.
VALUE = (
    "struct<field:string,side:string,document_id:string,label:string,raw:string,norm_kind:string,"
    f"norm_key:string,derivation:string,method:string,flags:array<string>,evidence:array<{EVIDENCE}>,"
    "block_ord:int>"
)
OUTCOME = (
    f"struct<field:string,side:string,value:{VALUE},cause:string,detail:string,alternatives:array<{VALUE}>>"
)


def _strings(*items: Column) -> Column:
    return F.array_compact(F.array(*items)).cast("array<string>")


def no_candidates() -> Column:
    return F.array().cast(f"array<{CANDIDATE}>")


def kept(c: Column) -> Column:
    """The VALUE of a candidate; the heading that gave its unit counts as evidence."""
    unit = c["unit_evidence"]
    proof = F.when(unit.isNull() | F.array_contains(c["evidence"], unit), c["evidence"]).otherwise(
        F.concat(c["evidence"], F.array(unit)))
    names = ("field", "side", "document_id", "label", "raw", "norm_kind", "norm_key", "derivation", "method",
             "flags")
    return F.when(c.isNotNull(), F.struct(
        *[c[n].alias(n) for n in names], proof.alias("evidence"), c["block_ord"].alias("block_ord")))


def evidence(document_id: Column, locator: Column, text: Column) -> Column:
    return F.struct(document_id.alias("document_id"), locator.alias("locator"), text.alias("text"))


def read_block(block: Column, side: Column, document_id: Column, policy: Column, convention: Column) -> Column:
    """One candidate out of one field block."""
    field, raw = block["field"], block["value"]
    numeric = field.isin(*K.NUMERIC_FIELDS)

    def facts(variants):
        kg, tonnes = labels.declares_kg(variants), labels.declares_tonnes(variants)
        return F.struct(
            is_missing(raw).alias("missing"),
            ((field == "notify_party") & same_as_consignee(raw)).alias("refers"),
            (numeric & labels.is_total(variants)).alias("total"),
            (kg | tonnes).alias("unit_in_label"),
            F.when(field.isin(*K.PARTY_FIELDS), normalize_party(raw))
            .when(field.isin(*K.PORT_FIELDS), normalize_port(raw)).alias("text"),
            F.when(field == "container_count",
                   numbers.parse_count(raw, labels.is_ambiguous_count(variants))).alias("count"),
            F.when(field == "gross_weight_kg",
                   numbers.parse_weight(raw, kg, tonnes, policy, convention)).alias("weight"),
        )

    def build(x):
        live = ~x["missing"]
        count, weight = x["count"], x["weight"]
        key = F.when(live & ~x["refers"], F.coalesce(
            F.nullif(x["text"], F.lit("")), count["number"], weight["number"]))
        reason = F.when(live, F.coalesce(count["reason"], weight["reason"]))
        ambiguous = F.coalesce(count["ambiguous"], weight["ambiguous"])
        unit_from_label = live & F.coalesce(weight["unit_from_label"], F.lit(False))
        number_issue = (
            F.when(~ambiguous, "INVALID_VALUE")
            .when(reason == "NO_CONTAINER_CONTEXT", "COMPETING_CANDIDATES")
            .when(field == "container_count", "AMBIGUOUS_SEPARATOR")
            .when(reason.isin("MISSING_UNIT", "AMBIGUOUS_UNIT", "UNKNOWN_UNIT"), "MISSING_UNIT")
            .when(reason == "LONE_SEPARATOR_AMBIGUOUS", "AMBIGUOUS_SEPARATOR")
            .otherwise("SEMANTIC_UNCERTAIN")
        )
        issue = (
            F.when(x["missing"], "MISSING_VALUE")
            .when(x["refers"], F.lit(None).cast("string"))
            .when(reason.isNotNull(), number_issue)
            .when(key.isNull(), "MISSING_VALUE")
        )
        several_ports = field.isin(*K.PORT_FIELDS) & key.isNotNull() & ports.port_alternatives(raw)
        derivation = (
            F.when(live & x["refers"], "REFERENCE")
            .when(key.isNotNull() & (F.size(count["terms"]) > 1), "SUM")
            .when(key.isNotNull() & x["total"], "TOTAL")
            .otherwise("DIRECT")
        )
        kind = F.when(~numeric, "TEXT").when(field == "container_count", "INTEGER").otherwise("DECIMAL")
        extra = block["extra"]
        return F.struct(
            field.alias("field"), side.alias("side"), document_id.alias("document_id"),
            block["label"].alias("label"), raw.alias("raw"),
            F.when(key.isNotNull(), kind).alias("norm_kind"), key.alias("norm_key"),
            derivation.alias("derivation"), F.lit("RULE").alias("method"),
            F.when(live & x["refers"], "consignee").alias("reference_field"),
            F.when(key.isNotNull(), count["terms"]).alias("components"),
            _strings(F.when(live & x["refers"], "SAME_AS_CONSIGNEE"),
                     F.when(several_ports, "PORT_ALTERNATIVES"),
                     F.when(unit_from_label, "UNIT_FROM_LABEL"), reason).alias("flags"),
            _strings(issue).alias("issues"),
            F.concat(F.array(evidence(document_id, block["locator"], raw)),
                     F.transform(extra, lambda e: evidence(document_id, e["locator"], e["text"]))).alias("evidence"),
            F.when(unit_from_label, evidence(document_id, block["label_locator"], block["label"]))
            .alias("unit_evidence"),
            block["ord"].alias("block_ord"), F.lit(None).cast("int").alias("reference_ord"),
            F.concat(F.array(raw), F.transform(extra, lambda e: e["text"])).alias("texts"),
            F.array().cast("array<string>").alias("reference_texts"),
            x["unit_in_label"].alias("unit_in_label"),
        )

    variants = F.when(numeric, labels.label_variants(block["label"])).otherwise(
        F.array().cast("array<string>"))
    return let(let(variants, facts), build)


def preferred(candidates: Column) -> Column:
    """The one usable candidate, or NULL when there is none or several differ."""
    def choose(usable):
        totals = F.filter(usable, lambda c: c["derivation"] == "TOTAL")
        first = F.get(usable, F.lit(0))
        same = F.forall(usable, lambda c: c["norm_key"] == first["norm_key"])
        return F.when(F.size(usable) == 1, first).when(F.size(totals) == 1, F.get(totals, F.lit(0))) \
            .when(same, first)

    return let(F.filter(candidates, lambda c: c["norm_key"].isNotNull()), choose)


def resolve_references(candidates: Column) -> Column:
    """"Same as consignee" takes the consignee of its own side, or stays open."""
    def point(c, target):
        found = (
            c.withField("norm_kind", target["norm_kind"])
            .withField("norm_key", target["norm_key"])
            .withField("evidence", F.array_distinct(F.concat(c["evidence"], target["evidence"])))
            .withField("reference_ord", target["block_ord"])
            .withField("reference_texts", target["texts"])
        )
        open_ = (
            c.withField("issues", F.array_distinct(F.concat(c["issues"], F.array(F.lit("SEMANTIC_UNCERTAIN")))))
            .withField("flags", F.array_distinct(
                F.concat(c["flags"], F.array(F.lit("REFERENCE_TARGET_UNRESOLVED")))))
        )
        return F.when(c["derivation"] != "REFERENCE", c).when(target.isNull(), open_).otherwise(found)

    consignees = F.filter(candidates, lambda c: c["field"] == "consignee")
    refers = F.exists(candidates, lambda c: c["derivation"] == "REFERENCE")
    resolved = let(preferred(consignees), lambda t: F.transform(candidates, lambda c: point(c, t)))
    return F.when(refers, resolved).otherwise(candidates)


def candidates(document: Column, side: Column, policy: Column, registry_convention: Column) -> Column:
    """All candidates a payload document supports, in the order of its blocks."""
    convention = F.when(document["convention"] != "", document["convention"]).otherwise(
        F.coalesce(registry_convention, F.lit("")))
    read = F.transform(
        document["blocks"],
        lambda b: read_block(b, side, document["document_id"], policy, convention))
    usable = document.isNotNull() & (document["status"] == "OK")
    return F.when(usable, let(read, resolve_references)).otherwise(no_candidates())


def quoted(c: Column) -> Column:
    """A text shown as a quoted literal."""
    escaped = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")),
                        F.lit("\t"), F.lit("\\t"))
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def outcome(field: Column, side: Column, value=None, cause=None, detail=None, alternatives=None) -> Column:
    return F.struct(
        field.alias("field"), side.alias("side"),
        (value if value is not None else F.lit(None).cast(VALUE)).alias("value"),
        (cause if cause is not None else F.lit(None).cast("string")).alias("cause"),
        (detail if detail is not None else F.lit("")).alias("detail"),
        (F.transform(alternatives, kept) if alternatives is not None
         else F.array().cast(f"array<{VALUE}>")).alias("alternatives"),
    )


def checked(field: Column, side: Column, gated: Column, c: Column, alternatives=None) -> Column:
    """Outcome with a value, provided the value passes the evidence gates (if gated)."""
    from ladingcheck.operators.ground import machine_failure

    return let(F.when(gated, machine_failure(c)), lambda failed: F.when(
        failed.isNull(), outcome(field, side, value=kept(c), alternatives=alternatives)
    ).otherwise(outcome(field, side, cause=F.lit("UNGROUNDED"),
                        detail=F.concat_ws(" ", failed["gate"], failed["reason"]), alternatives=alternatives)))


def resolve_field(field: Column, side: Column, document: Column, own: Column, gated: Column) -> Column:
    """Reduce one field's candidates to a value or a cause."""
    def text(s):
        return F.lit(s)

    def decide(x):
        own, usable = x["own"], x["usable"]
        first = F.get(usable, F.lit(0))
        totals = F.filter(usable, lambda c: c["derivation"] == "TOTAL")
        total = F.get(totals, F.lit(0))
        others = F.filter(usable, lambda c: c["block_ord"] != total["block_ord"])
        known = F.flatten(F.transform(own, lambda c: c["issues"]))
        merged = (
            first.withField("evidence", F.array_distinct(F.flatten(F.transform(usable, lambda c: c["evidence"]))))
            .withField("flags", F.array_distinct(F.flatten(F.transform(usable, lambda c: c["flags"]))))
        )
        lead = F.get(own, F.lit(0))
        uninterpreted = F.concat(
            F.lit("labelled "), quoted(lead["label"]), F.lit(" with raw value "), quoted(strip(lead["raw"])))
        return (
            F.when(F.size(usable) == 0, outcome(
                field, side, cause=F.coalesce(F.get(known, F.lit(0)), F.lit("MISSING_VALUE")),
                detail=uninterpreted, alternatives=own))
            .when((F.size(totals) == 1) & (F.size(usable) > 1), F.when(
                F.exists(others, lambda c: c["norm_key"] != total["norm_key"]),
                outcome(field, side, cause=text("COMPETING_CANDIDATES"),
                        detail=text("a declared total conflicts with another labelled value"),
                        alternatives=usable)
            ).otherwise(checked(field, side, gated, total, others)))
            .when(F.exists(usable, lambda c: c["norm_key"] != first["norm_key"]), outcome(
                field, side, cause=text("COMPETING_CANDIDATES"),
                detail=text("the document supports more than one value for this field"),
                alternatives=usable))
            .otherwise(let(merged, lambda m: checked(field, side, gated, m)))
        )

    status = F.lower(document["status"])
    scanned = F.coalesce(document["image_pages"], F.lit(False))
    resolved = let(
        F.struct(own.alias("own"), F.filter(own, lambda c: c["norm_key"].isNotNull()).alias("usable")), decide)
    return (
        F.when(document.isNull(), outcome(
            field, side, cause=text("DOCUMENT_LEVEL"), detail=text("no document is assigned to this side")))
        .when(document["status"] != "OK", outcome(
            field, side, cause=text("UNREADABLE_DOCUMENT"),
            detail=F.concat(F.lit("the source document is "), status)))
        .when(F.size(own) == 0, outcome(
            field, side, cause=F.when(scanned, "UNREADABLE_DOCUMENT").otherwise("MISSING_VALUE"),
            detail=F.when(scanned, "the document has pages with no text layer, so the value may be present "
                          "but unreadable")
            .otherwise("no labelled value for this field was found in the document")))
        .otherwise(resolved)
    )


def extract_side(document: Column, side: Column, policy: Column, registry_convention: Column,
                 gated: Column) -> Column:
    """Seven outcomes, in field order, for one side of a comparison."""
    fields = F.array(*[F.lit(f) for f in K.FIELDS])

    def per_field(found):
        return F.transform(fields, lambda f: resolve_field(
            f, side, document, F.filter(found, lambda c: c["field"] == f), gated))

    return let(candidates(document, side, policy, registry_convention), per_field)


def _both_documents() -> Column:
    return F.array(
        F.struct(F.lit("SI").alias("side"), F.col("si_payload").alias("document")),
        F.struct(F.lit("BL").alias("side"), F.col("bl_payload").alias("document")))


def _both_sides() -> Column:
    return F.array(
        F.struct(F.lit("SI").alias("side"), F.col("si_payload").alias("document"), F.col("si_gated").alias("gated")),
        F.struct(F.lit("BL").alias("side"), F.col("bl_payload").alias("document"), F.col("bl_gated").alias("gated")))


@lru_cache(maxsize=None)
def _outcomes_of_both(policy: str) -> Column:
    # Built once per process: the expression is large and does not depend on data.
    return F.transform(_both_sides(), lambda s: extract_side(
        s["document"], s["side"], F.lit(policy), F.col("registry_convention"), s["gated"]))


@lru_cache(maxsize=None)
def _candidates_of_both(policy: str) -> Column:
    return F.flatten(F.transform(_both_sides(), lambda s: candidates(
        s["document"], s["side"], F.lit(policy), F.col("registry_convention"))))


@lru_cache(maxsize=None)
def consignees(policy: str = "auto") -> Column:
    """array<struct(side, norm_key)>: the usable consignees of both sides; no other block is read."""
    def of_side(s):
        own = s["document"].withField("blocks", F.filter(s["document"]["blocks"], lambda b: b["field"] == "consignee"))
        return F.transform(candidates(own, s["side"], F.lit(policy), F.col("registry_convention")),
                           lambda c: F.struct(c["side"].alias("side"), c["norm_key"].alias("norm_key")))

    return F.filter(F.flatten(F.transform(_both_documents(), of_side)), lambda c: c["norm_key"].isNotNull())


def _gates(roles: DataFrame) -> DataFrame:
    return roles.withColumns({c: F.lit(True) for c in ("si_gated", "bl_gated") if c not in roles.columns})


def extract_sides(roles: DataFrame, policy: str = "auto") -> DataFrame:
    """Adds si_outcomes and bl_outcomes: seven outcomes in field order for each side.

    Needs si_payload, bl_payload and registry_convention. A side whose document a
    person chose (``si_gated`` / ``bl_gated`` false) is not checked a second time.
    """
    return _gates(roles).withColumn("_outcomes", _outcomes_of_both(policy)).withColumns({
        "si_outcomes": F.col("_outcomes")[0], "bl_outcomes": F.col("_outcomes")[1],
    }).drop("_outcomes", "si_gated", "bl_gated")


def candidate_rows(roles: DataFrame, policy: str = "auto") -> DataFrame:
    """One row per candidate of the chosen documents (key and the candidate's columns)."""
    return _gates(roles).select(*schema.KEY, F.explode(_candidates_of_both(policy)).alias("c")).select(
        *schema.KEY, "c.*")


def outcome_rows(cases: DataFrame) -> DataFrame:
    """One row per (case, side, field)."""
    both = F.concat("si_outcomes", "bl_outcomes")
    return cases.select(*schema.KEY, F.explode(both).alias("o")).select(
        *schema.KEY, "o.side", "o.field", "o.value", "o.cause", "o.detail", "o.alternatives")


def unresolved_targets(si_outcomes: Column, bl_outcomes: Column) -> Column:
    """array<struct(field, side, cause, outcome)> in field order, SI before BL."""
    both = F.arrays_zip(si_outcomes.alias("si"), bl_outcomes.alias("bl"))
    ordered = F.flatten(F.transform(both, lambda p: F.array(p["si"], p["bl"])))
    return F.filter(ordered, lambda o: o["value"]["norm_key"].isNull())
