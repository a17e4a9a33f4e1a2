"""Packing drained blocks into immutable chunks, and numbering those."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerstone.functions.codec import joined
from ledgerstone.functions.numbers import div


def pack(latest: DataFrame, part: list[str], per_chunk: int, block_size: int, header: int) -> DataFrame:
    """Blocks of each drain in ascending order, cut every `per_chunk`: pos, chunk, object_offset."""
    pos = F.row_number().over(Window.partitionBy(*part).orderBy("block")) - 1
    p = latest.withColumn("pos", pos.cast("long"))
    return p.withColumn("chunk", div(F.col("pos"), per_chunk)).withColumn("object_offset", header + F.col("pos") % per_chunk * block_size)


def with_ids(packed: DataFrame, part: list[str]) -> DataFrame:
    """Dense object ids over drains: the only global order is over one row per drain."""
    per = packed.groupBy(*part).agg((F.max("chunk") + 1).alias("chunks_"))
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    first = per.select(*part, F.coalesce(F.sum("chunks_").over(before), F.lit(0)).alias("first_"))
    return packed.join(first, part).withColumn("object_id", (F.col("first_") + F.col("chunk")).cast("long")).drop("first_")


def assemble(slots: DataFrame, keys: list[str]) -> DataFrame:
    """A chunk's body: its slots' bytes in slot order, joined in one pass; the group is a chunk, so its size is bounded."""
    body = joined(F.transform(F.array_sort(F.collect_list(F.struct("slot", "data"))), lambda x: x["data"]))
    return slots.groupBy(*keys).agg(body.alias("body"))
