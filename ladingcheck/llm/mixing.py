"""Mixing sources to target weights by temperature.

Source shares of tokens are raised to an exponent and normalised. The exponent is the smallest on a grid of 2^-20 whose
weights meet the target: entropy at most a share of the largest possible, or no source repeated more than a limit. Both
grow as the exponent falls, so it is bisected: each pass over the table of sources tries 31 inner points of the open
interval, and four passes fix the 20 bits. Then each source gets whole blocks, a permutation of all its documents each,
and a last block that ends where its token budget ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ladingcheck.llm.shared import stored

BITS = 20
SECTION_BITS = 5
#: Hexadecimal digits of a document's place in a block that name its range; sums per range replace one long window.
RANGE_DIGITS = 3


def tokens(documents: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens: runs of anything but ASCII white space; documents without any are left out."""
    counted = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return documents.select("doc_id", "source", counted.alias("n_tokens")).where("n_tokens > 0 and doc_id is not null")


def exponent(sources: DataFrame, budget: int, max_repeats: float | None, entropy_share: float | None) -> float:
    """The smallest k / 2^20 in 0..1 that meets the target, 1 if none does. sources: tokens of each."""
    total = sources.agg(F.sum("tokens")).first()[0]
    low, high = -1, 1 << BITS  # low fails or is outside, high holds or is the end
    step = 1 << BITS
    while step > 1:
        step >>= SECTION_BITS
        points = [k for k in range(max(low, 0) if low < 0 else low + step, high, step)]
        grid = F.explode(F.array(*[F.lit(k) for k in points])).alias("k") if points else None
        if grid is None:
            continue
        power = F.pow(F.col("tokens") / F.lit(float(total)), F.col("k") / F.lit(float(1 << BITS)))
        sums = sources.select("tokens", grid).withColumn("w", power).groupBy("k").agg(
            F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"),
            F.max(F.col("w") / F.col("tokens")).alias("most"), F.count(F.lit(1)).alias("n"))
        if max_repeats is not None:
            holds = F.col("most") * F.lit(float(budget)) / F.col("z") <= F.lit(float(max_repeats))
        else:
            holds = F.log("z") - F.col("wl") / F.col("z") <= F.lit(float(entropy_share)) * F.log("n")
        good = sorted(r["k"] for r in sums.where(holds).select("k").collect())  # at most the points of a section
        high = min(good, default=high)
        low = max([k for k in points if k < high], default=low)
    return high / (1 << BITS)


def mix(documents: DataFrame, budget_share: float = 1.0, max_repeats: float | None = 4.0,
        entropy_share: float | None = None, seed: int = 17) -> DataFrame:
    """doc_id, source, block, place, n_tokens, weight: one row for each time a document is read.

    The budget is budget_share of all tokens; a source's part is the whole number below weight * budget. Within a block
    the order is that of `place` (hexadecimal). The last block takes documents while their tokens fit. Documents without
    words, without text or without doc_id are never read. A null source is a source of its own. Repeated rows are
    read as often as they stand there; equal places are ordered by doc_id. No documents give no rows. Only doc_id,
    source and text are read.
    """
    docs = stored(tokens(documents).withColumn("_key", F.when(F.col("source").isNull(), F.lit("-")).otherwise(
        F.concat(F.lit("+"), F.col("source").cast("string")))), "tokens")
    sources = stored(docs.groupBy("_key").agg(F.sum("n_tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = int(total * budget_share)
    a = exponent(sources, budget, max_repeats, entropy_share) if total else 1.0
    power = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    plan = sources.select("_key", (power / F.lit(z)).alias("weight"), "tokens")
    plan = plan.withColumn("_budget", F.floor(F.col("weight") * F.lit(budget)).cast("long"))
    plan = plan.select("_key", "weight", F.floor(F.col("_budget") / F.col("tokens")).cast("long").alias("_whole"),
                       (F.col("_budget") % F.col("tokens")).alias("_rest"))

    def place(block):
        return F.md5(F.concat_ws(":", F.lit(seed), block, F.col("doc_id")))

    rows = docs.join(plan, "_key")
    whole = rows.where("_whole > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole") - 1)))
    last = rows.withColumn("block", F.col("_whole")).withColumn("place", place(F.col("block")))
    last = last.withColumn("_range", F.substring("place", 1, RANGE_DIGITS))
    sums = stored(last.groupBy("_key", "_range").agg(F.sum("n_tokens").alias("_sum")), "ranges")
    # At most 16^RANGE_DIGITS rows of a source.
    before = sums.withColumn("_upto", F.sum("_sum").over(Window.partitionBy("_key").orderBy("_range")))
    placed = last.join(before, ["_key", "_range"])
    inside = placed.where("_upto <= _rest")
    edge = placed.where("_upto > _rest and _upto - _sum < _rest").withColumn("_run", F.sum("n_tokens").over(
        Window.partitionBy("_key", "_range").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.where("_upto - _sum + _run <= _rest")
    shown = ["doc_id", "source", "block", "place", "n_tokens", "weight"]
    return (whole.withColumn("place", place(F.col("block"))).select(shown).unionAll(inside.select(shown))
            .unionAll(edge.select(shown)))
