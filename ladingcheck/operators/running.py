"""Running counts and previous values for keys of any size.

A window over one key sorts all its rows in one task. Here rows are first cut
into ranges of the order column; each (key, range) is its own partition, and only
one summary row per range is ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_counts(rows: DataFrame, keys: list[str], order: str, marks: dict[str, Column],
                   span: int = 100_000) -> DataFrame:
    """Adds, per name in ``marks``, how many earlier rows of the key satisfy it.

    ``order`` is an integer column that is unique within the key.
    """
    staged = rows.withColumn("_range", F.floor(F.col(order) / span))
    for name, test in marks.items():
        staged = staged.withColumn(name, F.when(test, 1).otherwise(0))
    sums = staged.groupBy(*keys, "_range").agg(*[F.sum(n).alias(f"_{n}") for n in marks])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_range", *[
        F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in marks])
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = staged
    for name in marks:
        counted = counted.withColumn(name, F.coalesce(F.sum(name).over(inside), F.lit(0)))
    joined = counted.join(carried, [*keys, "_range"])
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}") for n in marks}).drop(
        "_range", *[f"_{n}" for n in marks])


def previous_value(rows: DataFrame, keys: list[str], order: list[str], column: str, name: str,
                   bucket: Column) -> DataFrame:
    """Adds ``name``: the value of ``column`` in the row before, in key order.

    ``bucket`` must not decrease with the order (for times: the hour or the day).
    """
    staged = rows.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    last = staged.groupBy(*keys, "_bucket").agg(
        F.max_by(column, F.struct(*order)).alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_bucket")
    carried = last.select(*keys, "_bucket", F.lag("_last").over(over).alias("_carried"))
    return (
        staged.withColumn("_inner", F.lag(column).over(inside))
        .withColumn("_first", F.row_number().over(inside) == 1)
        .join(carried, [*keys, "_bucket"])
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_inner")))
        .drop("_bucket", "_inner", "_first", "_carried")
    )
