"""Chunk garbage: reference counts, candidates, orphans, safety."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refcounts(extents: DataFrame) -> DataFrame:
    """Extents per chunk."""
    return extents.groupBy("object_id").agg(F.count(F.lit(1)).alias("refs"))


def floor(stored: int | None) -> int:
    """The least chunk number a sweep may touch, from the highest in the numbered checkpoint; without one nothing is eligible."""
    return (1 << 63) - 1 if stored is None else stored + 1


def candidates(chunks: DataFrame, refs: DataFrame, floor: int, watermark: int) -> DataFrame:
    """Chunks with no reference and floor <= id < watermark."""
    old = chunks.where((F.col("object_id") >= floor) & (F.col("object_id") < watermark)).select("object_id").distinct()
    return old.join(refs, "object_id", "left_anti")


def orphans(listed: DataFrame, tracked: DataFrame) -> DataFrame:
    """Chunks in storage that no counter knows."""
    return listed.select("object_id").distinct().join(tracked, "object_id", "left_anti")


def apply(chunks: DataFrame, candidates: DataFrame) -> DataFrame:
    """What is left after the sweep."""
    return chunks.join(candidates, "object_id", "left_anti")
