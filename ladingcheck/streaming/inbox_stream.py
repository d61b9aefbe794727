"""New mail as a stream: validated, relevant, each id once, appended idempotently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ladingcheck import schema
from ladingcheck.operators.classify import classify, relevance
from ladingcheck.sources.inbox import email_problem


def read_new_mail(spark: SparkSession, root: str, max_files: int = 10_000) -> DataFrame:
    """File stream over ``inbox/email_*.json``; one JSON object per file, checked like the batch reader's."""
    raw = (
        spark.readStream.schema(schema.EMAIL + ", _corrupt_record string").option("multiLine", True)
        .option("mode", "PERMISSIVE").option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "email_*.json")
        .json(f"{root.rstrip('/')}/inbox")
    )
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    mail = raw.withColumnRenamed("from", "from_addr").withColumns({
        "file_stem": stem, "corrupt": F.col("_corrupt_record").isNotNull()}).drop("_corrupt_record")
    return mail.withColumn("problem", email_problem(mail))


def relevant_mail(mail: DataFrame) -> DataFrame:
    """Valid and relevant mails with their classification."""
    good = mail.filter("problem is null").drop("problem", "corrupt", "file_stem")
    kept = relevance(good).filter("relevant").select(*good.columns, "relevance_reason")
    return classify(kept).drop("quoted_history", "intent_text", "subject_text")


def append_new(batch: DataFrame, path: str) -> DataFrame:
    """Append the mails of one micro-batch whose id the table does not hold yet; returns them.

    A batch that is run again after a failure adds nothing twice.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(["email_id"])
    try:
        known = spark.read.parquet(path).select("email_id")
    except Exception as missing:  # the table does not exist before the first batch
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        known = None
    if known is not None:
        fresh = fresh.join(known, "email_id", "left_anti")
    fresh = fresh.persist()
    fresh.write.mode("append").parquet(path)
    return fresh


def stream_inbox(spark: SparkSession, root: str, table: str, checkpoint: str, *, refused: str | None = None,
                 available_now: bool = True, interval: str = "5 minutes",
                 on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start the sync: everything there now, or polling at an interval.

    Refused mails go to the table ``refused`` (default: ``table`` with _refused) under the id of their batch, so that a
    batch that runs again replaces its own; ``on_batch`` gets the mails that the batch has added.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.filter("problem is not null").write.mode("overwrite").parquet(
            f"{refused or table + '_refused'}/batch_id={batch_id}")
        fresh = append_new(relevant_mail(batch).withColumn("registry", F.lit("participant")), table)
        if on_batch is not None:
            on_batch(fresh, batch_id)
        fresh.unpersist()
        batch.unpersist()

    writer = read_new_mail(spark, root).writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
