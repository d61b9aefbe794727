"""Input columns named like those that the operators use inside pass through two pipeline stages unchanged."""

from pyspark.sql import functions as F

from ladingcheck.llm import language_id, line_dedup

NAMES = ("_id", "_lines", "_text", "_letters", "letters", "Letters_", "lines", "left", "row", "gone", "pos", "a.b")


def documents(spark):
    words = "one small house stands by the old river and nobody knows who built it".split()
    block = "\n".join(" ".join(words[i:i + 5]) for i in range(4))
    rows = [(i, block + f"\nlast line of number {i}", "en") for i in range(6)] + [
        (6, None, "en"), (7, "", None), (None, block, None), (8, "nothing repeats\nin this one\nat all", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # Names that differ in case only cannot stand side by side.
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in NAMES])


def same_extras(out):
    rows = out.collect()
    for r in rows:
        key = "none" if r["doc_id"] is None else r["doc_id"]
        assert [r[n] for n in NAMES] == [f"{n}:{key}" for n in NAMES]
    return rows


def test_line_dedup_keeps_columns_of_any_name(spark):
    docs = documents(spark)
    plain = line_dedup.line_dedup(docs.select("doc_id", "text", "lang"))
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    rows = same_extras(out)
    key = lambda r: (r["doc_id"] is None, r["doc_id"])
    cut = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in sorted(rows, key=key)]
    assert cut == [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in sorted(plain.collect(), key=key)]
    assert [r[3] for r in cut] == [0, 4, 4, 4, 4, 4, 0, 0, 0, 0]


def test_line_dedup_replaces_its_own_results(spark):
    docs = documents(spark).select("doc_id", "text", F.lit(9).alias("N_Lines"), F.lit(9).alias("n_removed"))
    assert line_dedup.line_dedup(docs).columns == ["doc_id", "text", "n_lines", "n_removed"]


def test_language_keeps_columns_of_any_name(spark):
    docs = documents(spark)
    plain = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"], r["bits"])
             for r in language_id.identify(docs.select("doc_id", "text", "lang")).collect()}
    out = language_id.identify(docs)
    assert out.columns == [*docs.columns, "lang_pred", "score", "bits"]
    assert {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"], r["bits"]) for r in same_extras(out)} == plain
    assert language_id.in_a_known_language(docs).columns == docs.columns
