"""Requests: byte ranges to blocks, checks, plans, readahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerstone.functions.numbers import div


def to_blocks(req: DataFrame, block_size: int) -> DataFrame:
    """req, off, len, block: one row per block that a request touches; an empty request touches none."""
    first, last = div(F.col("off"), block_size), div(F.col("off") + F.col("len") - 1, block_size)
    return req.where("len > 0").withColumn("block", F.explode(F.sequence(first, last)))


def slices(req: DataFrame, block_size: int) -> DataFrame:
    """The part of each block: lo and hi inside it, and whether it is partial."""
    base = F.col("block") * block_size
    lo, hi = F.greatest(F.col("off") - base, F.lit(0)), F.least(F.col("off") + F.col("len") - base, F.lit(block_size))
    return to_blocks(req, block_size).select("req", "block", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), ((lo > 0) | (hi < block_size)).alias("partial"))


def validate(req: DataFrame, size: int, block_size: int) -> DataFrame:
    """Class of each request, in the order in which the checks apply; a write must be of whole blocks."""
    end, written = F.col("off") + F.col("len"), F.col("op") == "write"
    kind = F.when(F.col("off") > size, "too_large").when(end > size, "out_of_range").when(F.col("len") == 0, "empty").when(written & (F.col("len") % block_size != 0), "misaligned").otherwise("ok")
    return req.withColumn("class", kind)


def plan(located: DataFrame, block_size: int) -> DataFrame:
    """req, object_id, first_block, num_blocks, object_offset: one fetch per run of neighbours in a chunk."""
    w = Window.partitionBy("req", "object_id").orderBy("block")
    same = (F.col("block") == F.lag("block").over(w) + 1) & (F.col("object_offset") == F.lag("object_offset").over(w) + block_size)
    run = located.withColumn("new_", F.when(same, 0).otherwise(1)).withColumn("run_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("req", "object_id", "run_").agg(F.min("block").alias("first_block"), F.count(F.lit(1)).alias("num_blocks"), F.min("object_offset").alias("object_offset")).drop("run_")


def sequential(req: DataFrame, part: list[str]) -> DataFrame:
    """Whether a request (first_block, num_blocks) starts where the one before it ended."""
    w = Window.partitionBy(*part).orderBy("req")
    before = F.lag(F.col("first_block") + F.col("num_blocks")).over(w)
    return req.withColumn("sequential", F.coalesce(F.col("first_block") == before, F.lit(False)))


def readahead(req: DataFrame, extents: DataFrame, limit: int = 256) -> DataFrame:
    """volume, req, sequential, extra: how many blocks a sequential request carries along.

    req: volume, req, first_block, num_blocks.  A request that starts where the volume's last one
    ended goes on through the extent that holds its last block: an extent is one chunk, without
    gaps, and where it ends the next block is unmapped, in another chunk or elsewhere in this one.
    """
    from ledgerstone.operators.extents import containing

    r = sequential(req, ["volume"]).withColumn("block", F.col("first_block") + F.col("num_blocks") - 1)
    found = containing(r.where("sequential").select("volume", "req", "block"), extents)
    extra = F.least(F.lit(limit).cast("long"), F.col("start_block") + F.col("num_blocks") - F.col("block") - 1)
    return r.join(found.select("volume", "req", extra.alias("extra")), ["volume", "req"], "left").select("volume", "req", "sequential", F.coalesce("extra", F.lit(0).cast("long")).alias("extra"))
