"""The versioned log: latest version wins, by sequence number alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(wal: DataFrame, keys: list[str]) -> DataFrame:
    """The highest seq of each key: one hash aggregate with map-side combine."""
    return wal.groupBy(*keys).agg(F.max("seq").alias("seq"))


def latest_row(wal: DataFrame, keys: list[str]) -> DataFrame:
    """The whole row of the highest seq.  The aggregate carries keys only; payload comes by join on (key, seq)."""
    return wal.join(latest(wal, keys), [*keys, "seq"], "left_semi").dropDuplicates([*keys, "seq"])


def overlay(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of `first`, else of `second`; which one it was is in `from_first`."""
    a = first.select(*keys, F.col(value).alias("a_"))
    b = second.select(*keys, F.col(value).alias("b_"))
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("a_", "b_").alias(value), F.col("a_").isNotNull().alias("from_first"))


def running(df: DataFrame, amount: Column, part: list[str], order: list[str], out: str) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(amount).over(w))


def prefix_ok(records: DataFrame, part: list[str], order: str, ok: str) -> DataFrame:
    """Tolerant recovery: of each file the records before its first bad one."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("sound_", F.min(F.col(ok).cast("int")).over(w)).where("sound_ = 1").drop("sound_")


def retire(buffered: DataFrame, flushed: DataFrame) -> DataFrame:
    """Buffered rows that are newer than what was flushed of their block."""
    f = flushed.groupBy("block").agg(F.max("seq").alias("flushed_"))
    return buffered.join(f, "block", "left").where("flushed_ is null or seq > flushed_").drop("flushed_")
