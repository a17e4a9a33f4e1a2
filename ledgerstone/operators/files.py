"""The file table: allocation of block ranges in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerstone.functions.numbers import div

SPAN = 4096


def allocate(files: DataFrame, order: str, blocks: str, out: str) -> DataFrame:
    """First block of each file: the sum of `blocks` over all files before it by a whole-number `order`.

    A running sum over all files would be one task.  Files of a span of `order` sum up first, the
    spans' totals, one row for thousands of files, are summed in order, and each span goes on alone.
    """
    f = files.withColumn("span_", div(F.col(order), SPAN))
    totals = f.groupBy("span_").agg(F.sum(blocks).alias("n_"))
    before = Window.orderBy("span_").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("span_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("first_"))
    inside = Window.partitionBy("span_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return f.join(first, "span_").withColumn(out, (F.col("first_") + F.sum(blocks).over(inside) - F.col(blocks)).cast("long")).drop("span_", "first_")
