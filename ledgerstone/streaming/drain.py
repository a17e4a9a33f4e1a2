"""Structured Streaming: flush, consolidation and latest-wins state in micro-batches.

Every micro-batch writes folders of its own, named by its id.  A batch that is run again overwrites
them, and it looks only at what batches before it wrote, so a lost driver or executor costs
nothing but time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerstone.operators import chunks
from ledgerstone.operators.log import latest, latest_row


def _run(writes: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    writes.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _before(spark: SparkSession, folder: str, batch_id: int, schema: str) -> DataFrame:
    """What batches before this one wrote."""
    found = spark.read.schema(f"{schema}, batch long").option("basePath", folder)
    try:
        return found.parquet(folder).where(F.col("batch") < batch_id).drop("batch")
    except Exception as e:  # nothing was written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


PLACES = "gen long, block long, seq long, object_id long, object_offset long"


def drain(writes: DataFrame, checkpoint: str, target: str, per_chunk: int, block_size: int, header: int) -> None:
    """Writes (gen, seq, block) of whole generations, in their order: flushed, packed into chunks, put on the map.

    Of each generation the latest version of a block stays; blocks are packed in ascending order and
    chunks take numbers from where the batches before stopped.
    """

    def settle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        used = _before(spark, f"{target}/map", batch_id, PLACES).agg((F.max("object_id") + 1).alias("n")).first()["n"] or 0
        flushed = latest(batch, ["gen", "block"])
        packed = chunks.with_ids(chunks.pack(flushed, ["gen"], per_chunk, block_size, header), ["gen"])
        placed = packed.select("gen", "block", "seq", (F.col("object_id") + used).alias("object_id"), "object_offset")
        placed.coalesce(8).write.mode("overwrite").parquet(f"{target}/map/batch={batch_id}")

    _run(writes, checkpoint, settle)


def live_map(spark: SparkSession, target: str) -> DataFrame:
    """(block, seq, object_id, object_offset): the newest version of each block over all batches."""
    return latest_row(spark.read.schema(f"{PLACES}, batch long").parquet(f"{target}/map"), ["block"]).select("block", "seq", "object_id", "object_offset")


def running_latest(writes: DataFrame, checkpoint: str, target: str) -> DataFrame:
    """The state store keeps one number a block and each batch writes the blocks that changed; older sequence numbers change nothing."""
    state = writes.groupBy("block").agg(F.max("seq").alias("seq"))
    _run(state, checkpoint, lambda batch, batch_id: batch.coalesce(8).write.mode("overwrite").parquet(f"{target}/batch={batch_id}"), "update")
    return latest(writes.sparkSession.read.schema("block long, seq long, batch long").parquet(target), ["block"])


def late_rows(writes: DataFrame, checkpoint: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(taken, late): versions that were newer than their block's when they came, and those that were not.

    There is no watermark: a version is late if its block has a higher number, however old it is.
    """

    def settle(batch: DataFrame, batch_id: int) -> None:
        known = latest(_before(batch.sparkSession, f"{target}/taken", batch_id, "block long, seq long"), ["block"]).withColumnRenamed("seq", "known")
        best = latest(batch, ["block"]).withColumnRenamed("seq", "best")
        seen = batch.select("block", "seq").join(best, "block").join(known, "block", "left")
        new = (F.col("seq") == F.col("best")) & (F.col("known").isNull() | (F.col("seq") > F.col("known")))
        for name, rows in (("taken", seen.where(new)), ("late", seen.where(~F.coalesce(new, F.lit(False))))):
            rows.select("block", "seq").coalesce(8).write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id}")

    _run(writes, checkpoint, settle)
    taken, late = (writes.sparkSession.read.schema("block long, seq long, batch long").parquet(f"{target}/{name}").drop("batch") for name in ("taken", "late"))
    return taken, late


def scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors share; a temporary one only under a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return f"{found.rstrip('/')}/ledgerstone/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    return "file://" + tempfile.mkdtemp(prefix="ledgerstone-")
