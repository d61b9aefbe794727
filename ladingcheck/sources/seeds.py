"""Seeding and clearing case tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladingcheck import constants as K


def read_seed(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A (gzipped) JSON array or JSON-lines file of case records."""
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def seed_cases(cases: DataFrame, seed: DataFrame, config_version: str) -> DataFrame:
    """Existing cases with the current configuration where the seed has them, plus the new ones."""
    seed = seed.withColumn("config_version", F.lit(config_version))
    ids = seed.select("case_id").distinct().withColumn("_seeded", F.lit(True))
    refreshed = cases.join(ids, "case_id", "left").withColumn(
        "config_version", F.when(F.col("_seeded"), F.lit(config_version)).otherwise(F.col("config_version"))
    ).drop("_seeded")
    new = seed.dropDuplicates(["case_id"]).join(cases.select("case_id"), "case_id", "left_anti")
    return refreshed.unionByName(new)


def clearable(case_id: Column) -> Column:
    """Ids made by mail sync, the composer or a test (prefixes taken literally)."""
    return case_id.rlike(K.CLEARABLE_CASE)


def clear_inbox(cases: DataFrame, *children: DataFrame) -> tuple[DataFrame, ...]:
    """The case table and its child tables without the clearable cases."""
    gone = cases.filter(clearable(F.col("case_id"))).select("case_id")
    kept = cases.filter(~clearable(F.col("case_id")))
    return kept, *[c.join(gone, "case_id", "left_anti") for c in children]


def reset(cases: DataFrame, seed: DataFrame, config_version: str, *children: DataFrame) -> tuple[DataFrame, ...]:
    kept, *rest = clear_inbox(cases, *children)
    return seed_cases(kept, seed, config_version), *rest
