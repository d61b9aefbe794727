"""The whole automated pass as one plan: mails and attachments in, cases out.

Shape of the plan: attachments are parsed in place (no shuffle) and reduced to
their field blocks; the narrow result is joined with the listed attachments,
grouped once by case, and joined with the classified mails on the same key.
Everything after that is work inside one row per case.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladingcheck import constants as K
from ladingcheck import schema
from ladingcheck.operators.blocks import decode_files, parse_documents
from ladingcheck.operators.classify import classify
from ladingcheck.operators.compare import compare_all, follow_up, roll_up, workflow_status
from ladingcheck.operators.extract import OUTCOME, extract_sides, unresolved_targets
from ladingcheck.operators.review import review_requirement
from ladingcheck.operators.roles import documents_with_roles, resolve_roles
from ladingcheck.functions.numbers import grouped_tokens
from ladingcheck.sources.inbox import resolve_sources


def corpus_convention(texts: DataFrame, declared: dict[str, str] | None = None) -> DataFrame:
    """registry -> registry_convention, learned from all texts(registry, text).

    At least three distinct unambiguous numbers of one notation and none of the
    other. Tokens are made distinct before and after the shuffle, keyed by the
    token, so a registry with most of the data is still spread over all tasks.
    """
    declared = declared or {}
    known = F.create_map(*[F.lit(x) for r in K.REGISTRIES for x in (r, declared.get(r, ""))])
    tokens = texts.select("registry", grouped_tokens(F.col("text")).alias("t")).select(
        "registry", F.explode(F.concat(
            F.transform("t.en", lambda v: F.struct(F.lit("en").alias("kind"), v.alias("token"))),
            F.transform("t.eu", lambda v: F.struct(F.lit("eu").alias("kind"), v.alias("token"))),
        )).alias("x")).select("registry", "x.kind", "x.token").distinct()
    counted = tokens.groupBy("registry").agg(
        F.count_if(F.col("kind") == "en").alias("en"), F.count_if(F.col("kind") == "eu").alias("eu"))
    verdict = (
        F.when(F.coalesce(F.try_element_at(known, F.col("registry")), F.lit("")) != "",
               F.try_element_at(known, F.col("registry")))
        .when((F.col("en") > 0) & (F.col("eu") > 0), "")
        .when(F.col("en") >= K.CONVENTION_MIN_EVIDENCE, "en")
        .when(F.col("eu") >= K.CONVENTION_MIN_EVIDENCE, "eu")
        .otherwise("")
    )
    return counted.select("registry", verdict.alias("registry_convention"))


def registry_conventions(files: DataFrame, declared: dict[str, str] | None = None) -> DataFrame:
    """Conventions of the fixed set of registries; at most one row for each of them."""
    declared = {r: c for r, c in (declared or {}).items() if c}
    spark = files.sparkSession
    fixed = spark.createDataFrame([(r, declared.get(r, "")) for r in K.REGISTRIES],
                                  "registry string, declared string")
    if all(declared.get(r) for r in K.REGISTRIES):
        return fixed.withColumnRenamed("declared", "registry_convention")
    texts = decode_files(files.filter(F.col("registry").isin(*K.REGISTRIES))).filter("format = 'text'")
    learned = corpus_convention(texts)
    return fixed.join(learned, "registry", "left").select(
        "registry",
        F.when(F.col("declared") != "", F.col("declared"))
        .otherwise(F.coalesce("registry_convention", F.lit(""))).alias("registry_convention"))


def case_documents(emails: DataFrame, files: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """One row per listed attachment with its parsed form."""
    return resolve_sources(emails, parse_documents(files, decoded))


def case_roles(emails: DataFrame, files: DataFrame, conventions: DataFrame | None = None,
               decoded: DataFrame | None = None) -> DataFrame:
    """Comparison cases with documents, roles, payloads and registry convention."""
    classified = classify(emails)
    return _with_roles(classified, resolve_roles(case_documents(emails, files, decoded)),
                       conventions if conventions is not None else registry_conventions(files))


_NO_LISTED = (
    "array<struct<position:int,document_id:string,filename:string,media_type:string,size_bytes:bigint,"
    "content_hash:string,demo_safe:boolean,present:boolean,issue:string,parse_status:string,role:string,"
    "score:double,field_labels:int,hint:string,readable:boolean,diagnostics:array<string>>>"
)
_NO_ROLES = (
    "struct<si:string,bl:string,si_alternatives:array<string>,bl_alternatives:array<string>,issues:array<string>>"
)


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _with_roles(classified: DataFrame, roles: DataFrame, conventions: DataFrame) -> DataFrame:
    mails = classified.withColumn("case_id", F.col("email_id")).drop(
        "body", "attachments", "current_message", "quoted_history", "intent_text", "subject_text")
    joined = mails.join(roles, schema.KEY, "left")
    without = F.struct(
        F.lit(None).cast("string").alias("si"), F.lit(None).cast("string").alias("bl"),
        _strings().alias("si_alternatives"), _strings().alias("bl_alternatives"),
        _strings("SI_MISSING", "BL_MISSING").alias("issues"))
    return joined.withColumns({
        "listed": F.coalesce("listed", F.array().cast(_NO_LISTED)),
        "roles": F.coalesce("roles", without.cast(_NO_ROLES)),
        "document_issues": F.coalesce("document_issues", _strings("SI_MISSING", "BL_MISSING")),
    }).join(F.broadcast(conventions), "registry", "left")


@lru_cache(maxsize=None)
def _compared() -> Column:
    return compare_all(F.col("si_outcomes"), F.col("bl_outcomes"))


@lru_cache(maxsize=None)
def _rolled_up() -> Column:
    return roll_up(F.coalesce("category", F.lit("GENERAL")), F.col("fields"), F.col("_issues"))


@lru_cache(maxsize=None)
def _review() -> Column:
    return review_requirement(
        F.col("assessment"), F.col("roles"), F.col("si_outcomes"), F.col("bl_outcomes"), F.col("fields"),
        F.col("listed"), F.col("_issues"), F.col("_prior"))


def assess(cases: DataFrame, policy: str = "auto") -> DataFrame:
    """From roles and payloads to outcomes, comparisons, assessment and review.

    Mails of other categories carry no outcomes and no fields.
    """
    is_bl = F.col("category") == "BL_COMPARISON"
    none = F.array().cast(f"array<{OUTCOME}>")
    return conclude(extract_sides(cases, policy).withColumns({
        c: F.when(is_bl, F.col(c)).otherwise(none) for c in ("si_outcomes", "bl_outcomes")}))


def conclude(cases: DataFrame, prior_fields: Column | None = None) -> DataFrame:
    """Comparisons, roll-up, review, workflow and follow-up from given outcomes."""
    is_bl = F.col("category") == "BL_COMPARISON"
    prior = prior_fields if prior_fields is not None else _strings()
    compared = cases.withColumns({
        "fields": _compared(),
        "_issues": F.when(is_bl, F.col("document_issues")).otherwise(_strings()),
        "_prior": prior,
    })
    reviewed = compared.withColumn("assessment", _rolled_up()).withColumn("review", _review())
    flowing = reviewed.withColumn("workflow_status", workflow_status(F.col("review")))
    targets = F.transform(
        unresolved_targets(F.col("si_outcomes"), F.col("bl_outcomes")),
        lambda o: F.struct(o["field"].alias("field"), o["side"].alias("side"), o["cause"].alias("cause")))
    return flowing.withColumns({
        "follow_up": follow_up(F.col("workflow_status"), F.col("assessment.status")),
        "unresolved_targets": targets,
        "documents": documents_with_roles(F.col("listed"), F.col("roles.si"), F.col("roles.bl"), is_bl),
    }).drop("_issues", "_prior")


def verify(emails: DataFrame, files: DataFrame, policy: str = "auto",
           conventions: DataFrame | None = None, decoded: DataFrame | None = None) -> DataFrame:
    """One row per mail: category, documents, fields, assessment, review, workflow.

    emails: run_kind, registry, email_id, from_addr, subject, body, attachments.
    files: registry, path, content.
    """
    return assess(case_roles(emails, files, conventions, decoded), policy)
