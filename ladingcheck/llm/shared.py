"""Helpers that all operators here use: tables in shared storage, inputs, clashing names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of this process where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = getattr(spark, "_llm_own_dir", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark._llm_own_dir = made
    return made


#: Narrow rows that a task writes where their number is known beforehand.
ROWS_A_FILE = 50_000


def stored(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write the rows to shared storage once and read them from there.

    rows: an upper bound of the number of rows, if known; small tables then make few files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(-(-rows // ROWS_A_FILE) or 1)
    path = f"{shared_dir(spark)}/llm/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, what: str) -> DataFrame:
    """Like stored(), dealt by hash of `key` into as many buckets as a shuffle has partitions: joins on it move the other side only."""
    spark = df.sparkSession
    name = f"llm_{what}_{uuid.uuid4().hex}"
    df.write.bucketBy(partitions(spark), key).option("path", f"{shared_dir(spark)}/llm/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names: Iterable[str]) -> list[Column]:
    """The columns of these names, whatever characters they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def ascii_lower(text: Column) -> Column:
    """A-Z only, as the contracts say."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
