"""Rules over logs: block states, pressure, copies, error classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history(moves: DataFrame) -> DataFrame:
    """(block, t, state, seq, moved) after each move (block, t, op, arg) of a block's log.

    write makes the block hot at version arg.  pending and persist count only for the version the
    block has: pending if it is hot, persist if it is pending; others change nothing (moved false).
    Within a version the first pending counts and the first persist after it, so windows suffice.
    """
    block = Window.partitionBy("block").orderBy("t")
    upto = block.rowsBetween(Window.unboundedPreceding, 0)
    m = moves.withColumn("epoch", F.sum((F.col("op") == "write").cast("int")).over(upto))
    m = m.withColumn("seq", F.last(F.when(F.col("op") == "write", F.col("arg")), ignorenulls=True).over(upto))
    version = Window.partitionBy("block", "epoch").orderBy("t")
    before = version.rowsBetween(Window.unboundedPreceding, -1)
    same = (F.col("epoch") > 0) & (F.col("arg") == F.col("seq"))
    pends = same & (F.col("op") == "pending")
    m = m.withColumn("was_pending", F.coalesce(F.max(pends.cast("int")).over(before), F.lit(0)) == 1)
    saves = same & (F.col("op") == "persist") & F.col("was_pending")
    m = m.withColumn("saves", saves).withColumn("was_saved", F.coalesce(F.max(saves.cast("int")).over(before), F.lit(0)) == 1)
    moved = (F.col("op") == "write") | (pends & ~F.col("was_pending")) | (F.col("saves") & ~F.col("was_saved"))
    state = F.when(F.col("epoch") == 0, "empty").when(F.col("saves") | F.col("was_saved"), "persisted").when(pends | F.col("was_pending"), "pending").otherwise("hot")
    return m.select("block", "t", state.alias("state"), "seq", moved.alias("moved"))


# Limits of unflushed bytes.
HIGH, NEAR_FULL, FREE_SHARE, LEAST, RELEASE = 256 << 20, 8, 2, 16 << 20, 4


def high_mark(near_full: Column, free: Column, high: int = HIGH, least: int = LEAST) -> Column:
    """Bytes above which writers wait: less if the backend is nearly full or the log's device has little room."""
    full = F.when(near_full, F.lit(high // NEAR_FULL)).otherwise(F.lit(high)).cast("long")
    half = F.greatest(F.call_function("div", free.cast("long"), F.lit(FREE_SHARE).cast("long")), F.lit(least).cast("long"))
    return F.when(free > 0, F.least(full, half)).otherwise(full)


def pressure(log: DataFrame) -> DataFrame:
    """log (volume, t, pending, high) with `waiting`: from above the high mark until a quarter below it.

    The state after a row is that of the last row that was above the one or not above the other.
    """
    low = F.col("high") - F.call_function("div", F.col("high"), F.lit(RELEASE).cast("long"))
    mark = F.when(F.col("pending") > F.col("high"), True).when(F.col("pending") <= low, False)
    w = Window.partitionBy("volume").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("waiting", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))


def copy_check(asked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Result of each copy asked for (req, volume, src, dst) among snapshots (id, declared, volume)."""
    src = snapshots.select(F.col("id").alias("src"), F.col("declared").alias("src_declared"), F.col("volume").alias("src_volume"))
    dst = snapshots.select(F.col("id").alias("dst"), F.lit(True).alias("taken"))
    a = asked.join(src, "src", "left").join(dst, "dst", "left")
    result = (
        F.when((F.col("src") == "") | (F.col("dst") == ""), "empty_id")
        .when(F.col("src") == F.col("dst"), "same_id")
        .when(F.col("taken"), "exists")
        .when(F.col("src_volume").isNull(), "not_found")
        .when(F.col("src_declared") != F.col("src"), "declares_other")
        .when(F.col("src_volume") != F.col("volume"), "foreign")
        .otherwise("ok")
    )
    return a.select("req", "src", "dst", result.alias("result"))


# Codes of a missing object.
MISSING = ("NoSuchKey", "NoSuchBucket", "NotFound", "NoSuchVersion")


def error_class(code: Column) -> Column:
    """What a backend's error code means; null is no error."""
    return F.when(code.isNull(), "none").when(code.isin(*MISSING), "not_found").when(code == "ENOSPC", "no_space").otherwise("transient")


def load_class(local: Column, backend: Column) -> Column:
    """Why no state was loaded, from the classes of the local and the backend error.

    Any backend error but a missing object leaves the question open; a state that is there and was
    not used is without a block size.
    """
    gone = lambda c: c.isin("none", "not_found")
    return F.when(~gone(backend), "unavailable").when(gone(local), "not_found").otherwise("no_block_size")


def conflicts(writes: DataFrame, shards: int = 16) -> DataFrame:
    """(req, kind) of partial writes (req, block, start, stop) that begin while the lock of their shard is held.

    The holder is the write before in the shard; one on the same block is a conflict, else a collision.
    """
    w = Window.partitionBy(F.col("block").bitwiseAND(F.lit(shards - 1))).orderBy("start", "req")
    held = F.lag("stop").over(w) > F.col("start")
    kind = F.when(F.lag("block").over(w) == F.col("block"), "conflict").otherwise("collision")
    return writes.select("req", "block", held.alias("held"), kind.alias("kind")).where("held").select("req", "block", "kind")
