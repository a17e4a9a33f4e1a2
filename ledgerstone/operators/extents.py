"""Extents: runs of consecutive blocks that lie side by side in one chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerstone.functions.numbers import div

BUCKET = 64


def coalesce(blockmap: DataFrame, block_size: int, header: int) -> DataFrame:
    """start_block, num_blocks, object_id, object_offset: maximal runs, gaps and islands per chunk."""
    w = Window.partitionBy("object_id").orderBy("block")
    same = (F.col("block") == F.lag("block").over(w) + 1) & (F.col("object_offset") == F.lag("object_offset").over(w) + block_size)
    marked = blockmap.withColumn("new_", F.when(same, 0).otherwise(1))
    run = marked.withColumn("run_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("object_id", "run_").agg(F.min("block").alias("start_block"), F.count(F.lit(1)).alias("num_blocks"), F.min("object_offset").alias("object_offset")).select("start_block", "num_blocks", "object_id", "object_offset")


def expand(extents: DataFrame, block_size: int) -> DataFrame:
    """One row per block of each extent."""
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_blocks") - 1))
    return extents.withColumn("i_", i).select((F.col("start_block") + F.col("i_")).alias("block"), "object_id", (F.col("object_offset") + F.col("i_") * block_size).alias("object_offset"))


def _bucketed(extents: DataFrame) -> DataFrame:
    first, last = div(F.col("start_block"), BUCKET), div(F.col("start_block") + F.col("num_blocks") - 1, BUCKET)
    return extents.withColumn("bucket_", F.explode(F.sequence(first, last)))


def containing(probes: DataFrame, extents: DataFrame) -> DataFrame:
    """Each probe's block with the extent that holds it."""
    e = _bucketed(extents)
    hit = (div(F.col("block"), BUCKET) == F.col("bucket_")) & (F.col("block") >= F.col("start_block")) & (F.col("block") < F.col("start_block") + F.col("num_blocks"))
    return probes.join(e, hit).drop("bucket_")


def lookup(probes: DataFrame, extents: DataFrame, block_size: int) -> DataFrame:
    """Each probe's block with its place: a range join as an equi-join on block buckets."""
    e = _bucketed(extents)
    hit = (div(F.col("block"), BUCKET) == F.col("bucket_")) & (F.col("block") >= F.col("start_block")) & (F.col("block") < F.col("start_block") + F.col("num_blocks"))
    return probes.join(e, hit).select(*probes.columns, "object_id", (F.col("object_offset") + (F.col("block") - F.col("start_block")) * block_size).alias("object_offset"))


def overlaps(ranges: DataFrame, extents: DataFrame) -> DataFrame:
    """All extents that intersect [lo, hi) of each range; a pair meets in several buckets and is kept in its first."""
    r = ranges.where("hi > lo").withColumn("at_", F.explode(F.sequence(div(F.col("lo"), BUCKET), div(F.col("hi") - 1, BUCKET))))
    e = _bucketed(extents)
    meet = (F.col("at_") == F.col("bucket_")) & (F.col("start_block") < F.col("hi")) & (F.col("start_block") + F.col("num_blocks") > F.col("lo"))
    first = div(F.greatest("lo", "start_block"), BUCKET) == F.col("at_")
    return r.join(e, meet).where(first).select(*ranges.columns, "start_block", "num_blocks", "object_id", "object_offset")


def fracture(extents: DataFrame, writes: DataFrame, block_size: int) -> DataFrame:
    """What is left of old extents under new ones (lo, hi): interval subtraction, offsets moved along.

    Cuts stand in order and may overlap: a gap starts where all cuts before it have ended.
    """
    cut = overlaps(writes.select("lo", "hi"), extents).groupBy("start_block", "num_blocks", "object_id", "object_offset").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("cuts"))
    e = extents.join(cut, ["start_block", "num_blocks", "object_id", "object_offset"], "left")
    end = F.col("start_block") + F.col("num_blocks")
    cuts = F.coalesce("cuts", F.array().cast("array<struct<lo:bigint,hi:bigint>>"))
    # one row a cut and one for the end: a gap goes from the furthest end of all cuts before to the start of this one
    last = F.array(F.struct(end.alias("lo"), end.alias("hi")))
    each = e.select("start_block", "num_blocks", "object_id", "object_offset", F.posexplode(F.concat(cuts, last)).alias("nth", "c"))
    before = Window.partitionBy("start_block", "object_id", "object_offset").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    left = each.withColumn("g_", F.struct(F.greatest("start_block", F.coalesce(F.max("c.hi").over(before), F.col("start_block"))).alias("a"), F.col("c.lo").alias("b"))).where("g_.b > g_.a")
    return left.select(F.col("g_.a").alias("start_block"), (F.col("g_.b") - F.col("g_.a")).alias("num_blocks"), "object_id", (F.col("object_offset") + (F.col("g_.a") - F.col("start_block")) * block_size).alias("object_offset"))


def with_versions(extents: DataFrame, blockmap: DataFrame) -> DataFrame:
    """Extents with `seqs`, the version of each of their blocks in order."""
    each = containing(blockmap.select("block", "seq"), extents)
    seqs = F.transform(F.array_sort(F.collect_list(F.struct("block", "seq"))), lambda x: x["seq"])
    return each.groupBy("start_block", "num_blocks", "object_id", "object_offset").agg(seqs.alias("seqs"))


def expand_versions(extents: DataFrame, block_size: int) -> DataFrame:
    """One row per block of each extent, with its place and its own version."""
    e = extents.select("start_block", "object_id", "object_offset", F.posexplode("seqs").alias("i", "seq"))
    return e.select((F.col("start_block") + F.col("i")).alias("block"), "object_id", (F.col("object_offset") + F.col("i") * block_size).alias("object_offset"), "seq")


def put(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with entries set by their start; an entry of the same start goes."""
    return index.join(new.select("start_block"), "start_block", "left_anti").select(index.columns).unionByName(new.select(index.columns))


def remove(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the entries of these starts."""
    return index.join(gone.select("start_block").distinct(), "start_block", "left_anti").select(index.columns)
