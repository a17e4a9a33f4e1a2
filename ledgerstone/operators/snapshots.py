"""Snapshots, clones and lineage: frozen maps and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.operators.log import latest


def freeze(wal: DataFrame, seq: int) -> DataFrame:
    """The map as of a sequence number; later writes do not show."""
    return latest(wal.where(F.col("seq") <= seq), ["block"])


def resolve(blocks: DataFrame, layers: DataFrame) -> DataFrame:
    """Each block's nearest layer, null where none has it: a never written block reads as zeros."""
    near = layers.groupBy("block").agg(F.min("depth").alias("depth"))
    return blocks.join(near, "block", "left")


def flatten(layers: DataFrame) -> DataFrame:
    """Each layer without the blocks that a nearer one has."""
    near = layers.groupBy("block").agg(F.min("depth").alias("depth"))
    return layers.join(near, ["block", "depth"], "left_semi")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks whose version differs between two frozen maps."""
    x, y = a.select("block", F.col("seq").alias("old_seq")), b.select("block", F.col("seq").alias("new_seq"))
    return x.join(y, "block", "full_outer").where(~F.col("old_seq").eqNullSafe(F.col("new_seq")))


def locate(blocks: DataFrame, layers: DataFrame) -> DataFrame:
    """block, depth, volume, object_id, object_offset, seq of each block in its nearest layer; nulls where none has it."""
    where = F.struct("depth", "volume", "object_id", "object_offset", "seq")
    near = layers.groupBy("block").agg(F.min_by(where, "depth").alias("l"))
    return blocks.join(near, "block", "left").select("block", "l.*")


def choose(live: DataFrame, numbered: DataFrame, volumes: DataFrame) -> DataFrame:
    """(volume, source, block, seq, object_id): each volume's whole live checkpoint, else its numbered one, else nothing (block null)."""
    has = lambda df, name: df.select("volume").distinct().withColumn(name, F.lit(True))
    v = volumes.join(has(live, "a"), "volume", "left").join(has(numbered, "b"), "volume", "left")
    v = v.select("volume", F.when(F.col("a"), "live").when(F.col("b"), "numbered").otherwise("empty").alias("source"))
    every = live.withColumn("source", F.lit("live")).unionByName(numbered.withColumn("source", F.lit("numbered")))
    return v.join(every, ["volume", "source"], "left").select("volume", "source", "block", "seq", "object_id")
