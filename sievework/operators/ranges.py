"""Numbering and running totals in a total order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.partitioning import checkpointed


def running(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """The rows with the sum of ``value`` over all rows before them in the order.

    Rows are dealt to ranges of the order; each range is summed by itself, and only the ranges'
    totals, one row for each partition, are put in order in one task.
    """
    ranged = checkpointed(rows.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_base"))
    own = F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_value")
    return ranged.join(F.broadcast(before), "_range").withColumn(name, F.col("_base") + own).select(*rows.columns, name)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place in the order, from 1; the order must be total."""
    return running(rows, order, F.lit(1), "_before").select(*rows.columns, (F.col("_before") + 1).cast("bigint").alias(name))
