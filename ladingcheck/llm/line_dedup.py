"""Line deduplication by overlapping windows of three consecutive lines.

Each window is hashed (128 bits); a window that occurs more than once keeps its first occurrence, by document id and
line number, and every later occurrence covers its lines. Covered lines are merged per document and removed. Windows
travel as two numbers with their place; texts move once, with the covered line numbers of their document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladingcheck.llm.shared import quoted

WIDTH = 3


def _lines():
    return F.split(F.col("text"), "\n", -1)


def windows(documents: DataFrame) -> DataFrame:
    """doc_id, pos, h1, h2 of every window that is not blank; lines count without surrounding spaces."""
    lines = F.transform(_lines(), lambda x: F.trim(x))
    starts = F.when(F.size("lines") >= WIDTH, F.sequence(F.lit(0), F.size("lines") - WIDTH))
    # Hashing inside the array keeps the lines out of the exploded rows.
    hashed = F.transform(starts, lambda i: F.struct(
        i.alias("pos"),
        F.xxhash64(*[F.get("lines", i + k) for k in range(WIDTH)]).alias("h1"),
        F.xxhash64(F.lit(7), *[F.get("lines", i + k) for k in reversed(range(WIDTH))]).alias("h2"),
        (F.concat(*[F.get("lines", i + k) for k in range(WIDTH)]) == "").alias("blank")))
    return (documents.where("doc_id is not null and text is not null").select("doc_id", lines.alias("lines"))
            .select("doc_id", F.explode(hashed).alias("w")).where("not w.blank").select("doc_id", "w.pos", "w.h1", "w.h2"))


def covered(documents: DataFrame) -> DataFrame:
    """doc_id, gone: the line numbers that later occurrences of repeated windows cover."""
    found = windows(documents)
    first = found.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).where("n > 1").drop("n")
    later = found.join(first, ["h1", "h2"]).where(F.struct("doc_id", "pos") != F.col("first"))
    # An occurrence that overlaps the first one takes only what lies beyond it.
    start = F.when(F.col("first.doc_id") == F.col("doc_id"), F.greatest("pos", F.col("first.pos") + WIDTH)).otherwise(F.col("pos"))
    spans = later.select("doc_id", start.alias("start"), (F.col("pos") + WIDTH - 1).alias("end"))
    lines = spans.select("doc_id", F.explode(F.sequence("start", "end")).alias("line"))
    return lines.groupBy("doc_id").agg(F.collect_set("line").alias("gone"))  # a document's own lines at most


def line_dedup(documents: DataFrame) -> DataFrame:
    """All rows and columns, text without the covered lines, n_chars (where there is one) to match, and n_lines, n_removed.

    Lines end at line feeds. Texts of fewer than three lines have no window and stay; null stays null with 0 lines,
    the empty text is one line. Rows without doc_id take no part and stay as they are; rows of one doc_id count as one
    place, so repeats of a row keep or lose the same lines. Columns named n_lines or n_removed are replaced; all other extra columns, of any name,
    pass unchanged.
    """
    rest = [c for c in documents.columns if c.lower() not in ("n_lines", "n_removed")]
    # The input's columns travel in a struct, so none of them can clash with a name used here.
    rows = documents.select(F.struct(*quoted(c for c in rest if c != "text")).alias("row"), "doc_id", "text")
    joined = rows.join(covered(documents.select("doc_id", "text")), "doc_id", "left").withColumn("lines", _lines())
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    # Line numbers are distinct, so array_except loses no line.
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    out = joined.withColumn("left", text)
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long")
    n_removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")

    def shown(c: str):
        own = F.col("row").getField(c)
        if c == "text":
            return F.col("left").alias(c)
        if c == "n_chars":
            return F.when(F.col("gone").isNull(), own).otherwise(F.length("left").cast(documents.schema[c].dataType)).alias(c)
        return own.alias(c)

    return out.select(*[shown(c) for c in rest], n_lines.alias("n_lines"), n_removed.alias("n_removed"))
