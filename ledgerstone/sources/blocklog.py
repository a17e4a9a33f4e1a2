"""Readers of block-log folders, binary files in and typed rows out, and the writer of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ledgerstone.functions import codec
from ledgerstone.functions.keys import chunk_number


def objects(spark: SparkSession, root: str) -> DataFrame:
    """path, length, content of every object below root that is not empty; content is only read if a plan uses it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def ranged(content: Column, offset: Column, length: Column) -> Column:
    """A ranged read; a length of 0 means the whole object."""
    return F.when(length == 0, content).otherwise(F.substring(content, offset + 1, length))


def short_read(content: Column, offset: Column, length: Column) -> Column:
    """True where the object ends before the range does."""
    return F.length(ranged(content, offset, length)) < length


def chunk_listing(spark: SparkSession, root: str) -> DataFrame:
    return objects(spark, root).select("path", "length", chunk_number(F.col("path")).alias("object_id")).where("object_id is not null")


def keyed(spark: SparkSession, root: str) -> DataFrame:
    """objects() with `key`, the path below root, and `prefix`, its first level."""
    below = F.substring_index(F.col("path"), root.rstrip("/").split("://", 1)[-1].rstrip("/") + "/", -1)
    return objects(spark, root).withColumn("key", below).withColumn("prefix", F.substring_index("key", "/", 1))


def write(df: DataFrame, root: str) -> None:
    """Rows (key, content) as objects below root, which may lie in any store that Arrow's file systems reach."""
    df.sparkSession.dataSource.register(ObjectSink)
    df.select("key", "content").write.format("blockobjects").mode("append").option("path", root).save()


class ObjectSink(DataSource):
    """df.write.format("blockobjects").mode("append").option("path", folder): one object a row (key, content).

    An object appears under its key only when it is whole: it is written beside it and moved, so a
    task that is run again replaces it and a lost one leaves nothing to read.
    """

    @classmethod
    def name(cls) -> str:
        return "blockobjects"

    def schema(self) -> str:
        return "key string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, batches):
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        made: set[str] = set()
        for batch in batches:
            for key, content in zip(batch["key"].to_pylist(), batch["content"].to_pylist(), strict=True):
                path = f"{base.rstrip('/')}/{key}"
                folder = path.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content or b"")
                store.move(part, path)
        return WriterCommitMessage()


def read_wal(spark: SparkSession, root: str, block_size: int) -> DataFrame:
    """Records of all logs below root, one input partition per file."""
    return codec.decode_wal(objects(spark, root).select("path", "content"), block_size, ["path"])


def read_map(spark: SparkSession, root: str) -> DataFrame:
    return codec.decode_map(objects(spark, root).select("path", "content"), ["path"])


class BlockLogSource(DataSource):
    """spark.read.format("blocklog").option("path", folder).option("block_size", n): WAL records by file.

    Files are read where they are listed, so the folder must be a mounted path that all
    executors see; for object stores use read_wal(), which goes through Spark's own reader.
    """

    @classmethod
    def name(cls) -> str:
        return "blocklog"

    def schema(self) -> str:
        return "path string, pos long, seq long, block long, data binary, crc_ok boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root, self.block = options["path"], int(options.get("block_size", "4096"))

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        return [InputPartition(str(p)) for p in sorted(Path(self.root).rglob("*")) if p.is_file()]

    def read(self, partition: InputPartition):
        from pathlib import Path
        from zlib import crc32

        size = codec.WAL_FIXED + self.block
        data = Path(partition.value).read_bytes()
        if data[:4] != codec.WAL_MAGIC or int.from_bytes(data[4:6], "big") != codec.VERSION:
            raise ValueError(f"not a block log: {partition.value}")
        for pos in range((len(data) - codec.WAL_HEADER) // size):
            r = data[codec.WAL_HEADER + pos * size : codec.WAL_HEADER + (pos + 1) * size]
            seq, block, crc = (int.from_bytes(r[a:b], "big") for a, b in ((0, 8), (8, 16), (24, 28)))
            yield partition.value, pos, seq, block, r[28:], crc32(r[:24] + r[28:]) == crc
