"""Shared helpers: durable cuts of the lineage, widths, and numbering without one task per key."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to Spark, which serves it to all executors: their Python workers import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    folder = Path(tempfile.mkdtemp(prefix="ledgerstone-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "ledgerstone.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "ledgerstone").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(folder / "ledgerstone.zip"))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    A cluster names it in spark.checkpoint.dir.  Only a local master, as in tests, may go
    without: then, and only then, a temporary folder is used.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="ledgerstone-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/ledgerstone/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._cut_path = path
    return again


def drop(df: DataFrame | None) -> None:
    """Delete a cut that no later plan reads."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def width(spark: SparkSession) -> int:
    """Reduce-side partitions; a cluster sizes it through spark.sql.shuffle.partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: int, per: int = 2000, least: int = 16, most: int = 4096) -> int:
    """Sub-buckets of a key, so that a key with a third of all rows is still many groups."""
    return max(least, min(most, rows // per))


def number_within(df: DataFrame, keys: list[str], by: Column, order: list[Column], out: str, rows: int) -> DataFrame:
    """Gapless numbers from 0 within each key, without a task that holds a whole key.

    Rows of a key fall into sub-buckets by the hash `by`; a small table of (key, sub-bucket)
    counts gives each sub-bucket its first number, and rows are only ranked inside it.
    Keys must not be null.
    """
    b = spread(rows)
    cell = [*keys, "cell_"]
    df = df.withColumn("cell_", F.pmod(by, F.lit(b)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_")).select(*cell, F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("first_"))
    ranked = df.join(starts, cell).withColumn(out, F.col("first_") + F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) - 1)
    return ranked.drop("cell_", "first_")
