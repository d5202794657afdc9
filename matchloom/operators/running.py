"""Running sums over a global order without a task that takes all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise


def running_sums(rows: DataFrame, by: list[str], order: Column, sums: dict[str, str]) -> DataFrame:
    """rows with sums of columns (name -> column) up to and with each row, within by, in an order without ties.

    Rows are dealt by ranges of by and order; each range sums on its own, and the totals of the ranges before, of which
    there is one for each partition and value of by in it, are added.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, *by, order).sortWithinPartitions(*by, order)
    ranged = materialise(ranged.withColumn("_part", F.spark_partition_id()), "running")
    total = ranged.groupBy("_part", *by).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("_part", *by, *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    within = Window.partitionBy("_part", *by).orderBy(order)
    made = ranged.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}).join(total, ["_part", *by])
    return made.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", *(f"_{n}" for n in sums))
