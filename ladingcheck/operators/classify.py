"""Mail intent: the current message, ordered rules, relevance, supplied proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ladingcheck import constants as K
from ladingcheck.functions.matching import before_first, found, is_plain, plain_form, quote_around
from ladingcheck.functions.text import line_ends, lookup, strip

# rule -> (pattern, text it is searched in); order decides.
_RULE_TESTS = (
    ("R-SPAM-1", K.SPAM, "intent_text"),
    ("R-CMP-1", K.COMPARE_REQUEST, "intent_text"),
    ("R-CMP-2", K.CHECK_AND_CONFIRM, "intent_text"),
    ("R-SI-1", K.SI_REQUEST, "intent_text"),
    ("R-SI-2", K.INLINE_BLOCK, "current_message"),
    ("R-SI-3", K.DRAFT_REQUESTED, "intent_text"),
    ("R-INV-1", K.INVOICE_QUERY, "intent_text"),
    ("R-GEN-1", K.GENERAL_OPERATIONAL, "intent_text"),
)


def quote_view(emails: DataFrame) -> DataFrame:
    """Adds current_message, quoted_history and intent_text.

    Quoted history starts at the first boundary, unless the mail opens with one.
    Banners go, and so does everything from the signature on.
    """
    body = line_ends(F.coalesce("body", F.lit("")))
    staged = emails.withColumn("_body", body).withColumn("_ascii", is_plain(F.col("_body")))

    def start(c, pattern):
        return F.when(F.col("_ascii"), before_first(c, plain_form(pattern))).otherwise(before_first(c, pattern))

    before = start(F.col("_body"), K.QUOTE_BOUNDARY)
    staged = staged.withColumn("_before", before)
    staged = staged.withColumn("_current", F.when(F.col("_before") == "", F.col("_body")).otherwise(F.col("_before")))
    staged = staged.withColumn("_clean", F.when(
        F.col("_ascii"), F.regexp_replace("_current", plain_form(K.BANNER), "")
    ).otherwise(F.regexp_replace("_current", K.BANNER, "")))
    staged = staged.withColumn("_unsigned", start(F.col("_clean"), K.SIGNATURE))
    kept = (
        F.when(strip(F.col("_unsigned")) != "", F.col("_unsigned"))
        .when(strip(F.col("_clean")) != "", F.col("_clean"))
        .otherwise(F.col("_current"))
    )
    quoted = F.substring(F.col("_body"), F.length("_current") + 1, F.length("_body"))
    return staged.withColumns({
        "current_message": strip(kept),
        "quoted_history": strip(quoted),
        "subject_text": strip(F.coalesce("subject", F.lit(""))),
    }).withColumn(
        "intent_text", F.concat_ws("\n", "subject_text", "current_message")
    ).drop("_body", "_before", "_current", "_clean", "_unsigned", "_ascii")


def _rule_id() -> Column:
    plain = F.col("_plain")
    extra = {
        "R-CMP-2": lambda: found(F.col("intent_text"), K.SI_MENTION, plain)
        & found(F.col("intent_text"), K.BL_MENTION, plain),
        "R-SI-2": lambda: found(F.col("intent_text"), K.SI_MENTION, plain),
    }
    chain = None
    for rule, pattern, source in _RULE_TESTS:
        test = found(F.col(source), pattern, plain)
        if rule in extra:
            test = test & extra[rule]()
        chain = F.when(test, rule) if chain is None else chain.when(test, rule)
    return chain


def _quote() -> Column:
    chain = None
    for rule, pattern, source in _RULE_TESTS:
        quote = quote_around(F.col(source), pattern)
        fired = F.col("rule_id") == rule
        chain = F.when(fired, quote) if chain is None else chain.when(fired, quote)
    return chain


def classify_rules(viewed: DataFrame) -> DataFrame:
    """Adds rule_id, category, classified_by, reason, unresolved, evidence_quote.

    All are NULL (unresolved true) where no rule fires.
    """
    with_rule = viewed.withColumn("_plain", is_plain(F.col("intent_text"))).withColumn("rule_id", _rule_id())
    return with_rule.withColumns({
        "category": lookup({r: c for r, (c, _) in K.RULES.items()}, F.col("rule_id")),
        "classified_by": F.when(F.col("rule_id").isNotNull(), "DETERMINISTIC"),
        "classification_reason": lookup({r: t for r, (_, t) in K.RULES.items()}, F.col("rule_id")),
        "unresolved": F.coalesce(F.col("rule_id") == "R-SI-3", F.lit(True)),
        "evidence_quote": _quote(),
    }).drop("_plain")


def classify(emails: DataFrame) -> DataFrame:
    """Rules first; a mail no rule recognises is GENERAL, marked unresolved."""
    ruled = classify_rules(quote_view(emails))
    category, reason = K.RULES["R-GEN-DEFAULT"]
    return ruled.withColumns({
        "rule_id": F.coalesce("rule_id", F.lit("R-GEN-DEFAULT")),
        "category": F.coalesce("category", F.lit(category)),
        "classified_by": F.coalesce("classified_by", F.lit("DETERMINISTIC")),
        "classification_reason": F.coalesce("classification_reason", F.lit(reason)),
    })


def relevance(emails: DataFrame) -> DataFrame:
    """Adds relevant and relevance_reason for mail about to enter the inbox."""
    ruled = classify_rules(quote_view(emails))
    text = F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))
    ruled = ruled.withColumn("_text", text)
    names = F.coalesce("attachments", F.array().cast("array<string>"))
    hinted = F.filter(names, lambda a: a.rlike(K.ATTACHMENT_HINTS))
    automated = F.col("from_addr").rlike(K.IRRELEVANT_SENDERS) | F.col("subject").rlike(K.IRRELEVANT_SUBJECTS)
    keyword = F.nullif(F.regexp_extract("_text", K.SHIPPING_KEYWORDS, 0), F.lit(""))
    spam = F.regexp_extract("_text", K.SPAM, 0)
    stages = [
        (F.col("_text").rlike(K.SPAM), False,
         F.concat(F.lit("Unsolicited promotional / spam content ("), spam, F.lit(")"))),
        (automated & keyword.isNull() & (F.size(hinted) == 0), False,
         F.lit("Automated third-party service / non-shipping notification")),
        (F.col("category").isin("BL_COMPARISON", "SI_REQUEST", "INVOICE_QUERY"), True,
         F.concat(F.lit("Matched shipping intent: "), F.col("category"))),
        (F.col("category") == "GENERAL", True,
         F.lit("Matched operational maritime / shipping traffic")),
        (keyword.isNotNull(), True,
         F.concat(F.lit("Contains shipping domain keyword ("), keyword, F.lit(")"))),
        (F.size(hinted) > 0, True,
         F.concat(F.lit("Contains shipping document attachment: "), F.get(hinted, F.lit(0)))),
        (F.exists(names, lambda a: a.rlike(K.DOCUMENT_SUFFIX)) & F.col("_text").rlike(K.SHIPMENT_WORDS), True,
         F.lit("Document attachment with shipment reference")),
    ]
    verdict = F.struct(F.lit(False).alias("ok"),
                       F.lit("No shipping, freight, B/L, or SI relevance detected").alias("why"))
    for test, ok, why in reversed(stages):
        verdict = F.when(test, F.struct(F.lit(ok).alias("ok"), why.alias("why"))).otherwise(verdict)
    return ruled.withColumn("_verdict", verdict).withColumns({
        "relevant": F.col("_verdict.ok"), "relevance_reason": F.col("_verdict.why"),
    }).drop("_verdict", "_text")


# --- supplied model proposals -------------------------------------------------------


def proposal_problem() -> Column:
    """First reason a category proposal is refused, or NULL."""
    source = F.concat_ws("\n", "subject_text", "current_message", "quoted_history")
    quotes = F.coalesce("quotes", F.array().cast("array<string>"))
    return (
        F.when(~F.coalesce(F.col("proposed_category").isin(*K.CATEGORIES), F.lit(False)), "UNKNOWN_CATEGORY")
        .when(strip(F.coalesce("proposal_reason", F.lit(""))) == "", "NO_REASON")
        .when(F.exists(quotes, lambda q: q.isNull()), "QUOTE_NOT_TEXT")
        .when(F.exists(quotes, lambda q: (strip(q) != "") & ~F.contains(source, strip(q))), "FABRICATED_QUOTE")
        .when(F.col("confidence").isNotNull() & F.col("confidence").try_cast("double").isNull(),
              "BAD_CONFIDENCE")
    )


def classify_with_proposals(emails: DataFrame, proposals: DataFrame) -> DataFrame:
    """Rules first; where none fires, a valid proposal decides.

    proposals: email_id, proposed_category, proposal_reason, confidence, quotes.
    A refused or absent proposal leaves the category NULL, never GENERAL.
    """
    ruled = classify_rules(quote_view(emails)).join(proposals, "email_id", "left")
    ruled = ruled.withColumn(
        "proposal_problem",
        F.when(F.col("rule_id").isNull(), F.coalesce(proposal_problem(), F.lit(None).cast("string"))))
    usable = F.col("rule_id").isNull() & F.col("proposal_problem").isNull() & F.col("proposed_category").isNotNull()
    return ruled.withColumns({
        "category": F.coalesce("category", F.when(usable, F.col("proposed_category"))),
        "classified_by": F.coalesce("classified_by", F.when(usable, F.lit("AI"))),
        "classification_reason": F.coalesce("classification_reason", F.when(usable, strip(F.col("proposal_reason")))),
    })


def call_budget(calls: DataFrame, limit: int, bucket_size: int = 100_000) -> DataFrame:
    """Calls (run_id, call_no) with ``allowed``: at most ``limit`` per run, in call order.

    Places within a run are counted per range of call numbers and then carried
    over the ranges, so one run with very many calls is spread over many tasks.
    """
    bucketed = calls.withColumn("_bucket", F.floor(F.col("call_no") / bucket_size))
    sizes = bucketed.groupBy("run_id", "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("run_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("run_id", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("run_id", "_bucket").orderBy("call_no")
    return (
        bucketed.withColumn("_place", F.row_number().over(inside))
        .join(offsets, ["run_id", "_bucket"])
        .withColumn("allowed", F.col("_before") + F.col("_place") <= limit)
        .drop("_bucket", "_place", "_before")
    )


def consent_gate(proposals: DataFrame, emails: DataFrame, allow_participant: bool = False) -> DataFrame:
    """Proposals whose source content may leave the system."""
    kinds = emails.select("email_id", "registry")
    joined = proposals.join(kinds, "email_id")
    if allow_participant:
        return joined
    return joined.filter(~F.col("registry").isin(*K.CONSENT_REQUIRED_REGISTRIES))
