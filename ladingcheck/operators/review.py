"""The one question a case in review puts to a person, or the block it records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ladingcheck import constants as K
from ladingcheck.functions.text import let, lookup, strip
from ladingcheck.operators.extract import VALUE, unresolved_targets

OPTION = f"struct<option_id:string,kind:string,label:string,document_id:string,value:{VALUE}>"
REVIEW = (
    "struct<scope:string,ui_mode:string,reason:string,field:string,side:string,target_role:string,"
    f"question:string,context_summary:string,allowed_actions:array<string>,options:array<{OPTION}>,"
    "source_document_ids:array<string>,blocks_externally:boolean>"
)
_ASK_OUTSIDE = "This case needs action outside the system. Please acknowledge."


def confirmed_note(fields: Column) -> Column:
    """Sentence about differences already established."""
    names = F.transform(F.filter(fields, lambda f: f["result"] == "MISMATCH"),
                        lambda f: lookup(K.FIELD_LABELS, f["field"]))
    return F.when(F.size(names) == 0, "").otherwise(F.concat(
        F.lit(" A difference has already been confirmed in "), F.array_join(names, ", "),
        F.lit("; that is recorded and is not what this question is about.")))


def mismatch_sentence(fields: Column) -> Column:
    """``field: SI x, BL y`` for every mismatch."""
    def one(f):
        return F.concat(lookup(K.FIELD_LABELS, f["field"]), F.lit(": SI "),
                        F.coalesce(f["si"]["norm_key"], F.lit("unknown")), F.lit(", BL "),
                        F.coalesce(f["bl"]["norm_key"], F.lit("unknown")))

    return F.array_join(F.transform(F.filter(fields, lambda f: f["result"] == "MISMATCH"), one), "; ")


def _block_summary(reason: Column, detail: Column, image_only: Column) -> Column:
    return (
        F.when(reason == "missing_attachment",
               "A document required for the comparison was not supplied with the email.")
        .when(reason == "wrong_doc_type",
              "An attachment that should be a shipping instruction or a draft bill of lading is a "
              "different kind of document.")
        .when((reason == "unreadable") & image_only,
              "A required document has no text layer — it is a scan. Text recognition is not enabled, "
              "so its contents were not read.")
        .when(reason == "unreadable", "A required document could not be read.")
        .when(detail != "", detail)
        .otherwise("The comparison could not be completed automatically.")
    )


def _option(option_id, kind, label, document_id=None, value=None) -> Column:
    return F.struct(
        option_id.alias("option_id"), F.lit(kind).alias("kind"), label.alias("label"),
        (document_id if document_id is not None else F.lit(None)).cast("string").alias("document_id"),
        (value if value is not None else F.lit(None).cast(VALUE)).alias("value"))


def _escape(label: str) -> Column:
    return F.array(_option(F.lit(K.NONE_OF_THESE), "ESCAPE", F.lit(label)))


def _review(scope, mode, reason, question, summary, actions, field=None, side=None, role=None,
            options=None, documents=None, blocks=False) -> Column:
    def text(c):
        return (c if isinstance(c, Column) else F.lit(c)).cast("string")

    return F.struct(
        F.lit(scope).alias("scope"), F.lit(mode).alias("ui_mode"), reason.alias("reason"),
        text(field).alias("field"), text(side).alias("side"), text(role).alias("target_role"),
        text(question).alias("question"), summary.alias("context_summary"),
        F.array(*[F.lit(a) for a in actions]).alias("allowed_actions"),
        (options if options is not None else F.lit(None).cast(f"array<{OPTION}>")).alias("options"),
        documents.alias("source_document_ids"), F.lit(blocks).alias("blocks_externally"))


def distinct_alternatives(alternatives: Column) -> Column:
    """Usable alternatives with different canonical values, first of each."""
    usable = F.filter(alternatives, lambda c: c["norm_key"].isNotNull())
    return let(usable, lambda u: let(F.transform(u, lambda c: c["norm_key"]), lambda keys: F.filter(
        u, lambda c, i: F.array_position(keys, c["norm_key"]) == i + 1)))


def review_requirement(assessment: Column, roles: Column, si_outcomes: Column, bl_outcomes: Column,
                       fields: Column, listed: Column, issues: Column,
                       prior_fields: Column | None = None) -> Column:
    """NULL unless the assessment is NEEDS_REVIEW; then exactly one requirement.

    Precedence: a document choice, a document-level block, the first field that
    a person can settle (two distinct fields at most), else a block.
    """
    prior = prior_fields if prior_fields is not None else F.array().cast("array<string>")
    reason = assessment["review_reason"]
    present = F.filter(listed, lambda d: d["present"])
    present_ids = F.array_distinct(F.transform(present, lambda d: d["document_id"]))
    image_only = F.exists(present, lambda d: F.arrays_overlap(
        d["diagnostics"], F.array(F.lit("IMAGE_ONLY_PAGE"), F.lit("IMAGE_ONLY_DOCUMENT"))))
    note = confirmed_note(fields)

    def document_choice(role, alternatives):
        def name_of(document_id):
            return F.coalesce(F.get(F.transform(
                F.filter(present, lambda d: d["document_id"] == document_id),
                lambda d: d["filename"]), F.lit(0)), document_id)

        options = F.concat(
            F.transform(alternatives, lambda a, i: _option(
                F.concat(F.lit("doc_"), (i + 1).cast("string")), "DOCUMENT", name_of(a), document_id=a)),
            _escape("None of these is the right document"))
        return _review(
            "DOCUMENT", "CHOICE", reason, f"Which attachment is the {role} for this shipment?",
            F.concat(F.lit(f"The {role} could not be identified from the document contents."), note),
            ["SELECT_OPTION"], role=role, options=options, documents=alternatives)

    def block(summary):
        return _review("DOCUMENT", "ACKNOWLEDGE", reason, _ASK_OUTSIDE, F.concat(summary, note),
                       ["ACKNOWLEDGE"], documents=present_ids, blocks=True)

    def field_question(target):
        field, side = target["field"], target["side"]
        label = lookup(K.FIELD_LABELS, field)
        why = lookup(K.CAUSE_EXPLANATION, F.coalesce(target["cause"], F.lit("MISSING_VALUE")))
        document = F.when(side == "SI", roles["si"]).otherwise(roles["bl"])
        documents = F.array_compact(F.array(document))

        def ask(values):
            options = F.concat(
                F.transform(values, lambda c, i: _option(
                    F.concat(F.lit("val_"), (i + 1).cast("string")), "VALUE",
                    strip(c["raw"]), value=c)),
                _escape("None of these is correct"))
            choice = _review(
                "FIELD", "CHOICE", reason,
                F.concat(F.lit("Which value is the "), label, F.lit(" on the "), side, F.lit("?")),
                F.concat(F.lit("The "), side, F.lit(" document supports more than one "), label, F.lit(". "),
                         why, F.lit("."), note),
                ["SELECT_OPTION"], field=field, side=side, options=options, documents=documents)
            typed = _review(
                "FIELD", "VALUE_INPUT", reason,
                F.concat(F.lit("What is the "), label, F.lit(" on the "), side, F.lit(" document?")),
                F.concat(
                    strip(F.concat(F.upper(F.left(why, F.lit(1))), F.substring(why, F.lit(2), F.length(why)),
                                   F.lit(". "), target["detail"])),
                    F.lit(" If the document does not show it, acknowledge instead of guessing."), note),
                ["PROVIDE_VALUE", "ACKNOWLEDGE"], field=field, side=side, documents=documents)
            return F.when(F.size(values) >= 2, choice).otherwise(typed)

        return let(distinct_alternatives(target["alternatives"]), ask)

    def decide(x):
        distinct = F.array_distinct(F.concat(prior, F.transform(x["actionable"], lambda o: o["field"])))
        summary = F.when(
            F.size(distinct) > K.MAX_REVIEW_FIELDS,
            F.concat(F.size(distinct).cast("string"),
                     F.lit(" distinct fields need human input, which exceeds the limit of "
                           f"{K.MAX_REVIEW_FIELDS} for one run."))
        ).otherwise(_block_summary(reason, assessment["detail"], image_only))
        return (
            F.when(roles["si"].isNull() & (F.size(roles["si_alternatives"]) > 0),
                   document_choice("SI", roles["si_alternatives"]))
            .when(roles["bl"].isNull() & (F.size(roles["bl_alternatives"]) > 0),
                  document_choice("BL", roles["bl_alternatives"]))
            .when(F.size(issues) > 0, block(_block_summary(reason, assessment["detail"], image_only)))
            .when((F.size(x["actionable"]) > 0) & (F.size(distinct) <= K.MAX_REVIEW_FIELDS),
                  field_question(F.get(x["actionable"], F.lit(0))))
            .otherwise(block(summary))
        )

    targets = unresolved_targets(si_outcomes, bl_outcomes)
    actionable = F.filter(targets, lambda o: ~F.coalesce(
        o["cause"].isin("DOCUMENT_LEVEL", "UNREADABLE_DOCUMENT"), F.lit(False)))
    return F.when(assessment["status"] == "NEEDS_REVIEW",
                  let(F.struct(actionable.alias("actionable")), decide))
