"""Block-log tables derived from the driver's tables, as DataFrames and as the same SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerstone.functions.numbers import div
from ledgerstone.operators import chunks, log
from ledgerstone.operators.files import allocate

BLOCK = 4096
HEADER = 10
PER_CHUNK = 16
GENERATION = 256

# Common table expressions; each uses the ones before it.
WAL = """wal AS (SELECT event_id+1 AS seq, user_id AS block, CAST(floor(event_id/256.0) AS BIGINT) AS gen, event_type, value FROM events)"""
D = WAL + """,
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gen, block ORDER BY seq DESC) rn FROM wal) x WHERE rn=1)"""
CH = D + """,
p AS (SELECT seq, block, gen, row_number() OVER (PARTITION BY gen ORDER BY block)-1 AS pos FROM d),
ch AS (SELECT seq, block, gen, CAST(dense_rank() OVER (ORDER BY gen, CAST(floor(pos/16.0) AS BIGINT))-1 AS BIGINT) AS object_id, CAST(10+(pos%16)*4096 AS BIGINT) AS object_offset FROM p)"""
BM = CH + """,
bm AS (SELECT block, seq, object_id, object_offset FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY seq DESC) r2 FROM ch) y WHERE r2=1)"""
EXT = BM + """,
isl AS (SELECT *, block-row_number() OVER (PARTITION BY object_id ORDER BY block) AS g1, block-CAST(floor((object_offset-10)/4096.0) AS BIGINT) AS g2 FROM bm),
ext AS (SELECT min(block) AS start_block, count(*) AS num_blocks, object_id, min(object_offset) AS object_offset FROM isl GROUP BY object_id, g1, g2)"""
REQ = """req AS (SELECT o_orderkey AS req, CAST(o_custkey*4096+(o_orderkey%8)*512 AS BIGINT) AS off, CAST(512*(1+o_orderkey%16) AS BIGINT) AS len FROM orders)"""
FILES = """files AS (SELECT path, size, nb, CAST(sum(nb) OVER (ORDER BY doc_id) - nb AS BIGINT) AS start_block FROM (SELECT doc_id, concat('doc/', CAST(doc_id AS VARCHAR(20))) AS path, n_chars AS size, CAST(ceil(n_chars/4096.0) AS BIGINT) AS nb FROM documents) x)"""
LAYERS = """lay AS (SELECT DISTINCT CAST(event_id%3 AS BIGINT) AS depth, user_id AS block FROM events WHERE (event_id%3=0 AND user_id%4=0) OR (event_id%3=1 AND user_id%2=0) OR event_id%3=2)"""
OPLOG = """ops AS (SELECT event_id, user_id AS volume, CASE WHEN event_type IN ('view','click') THEN 'read' ELSE 'write' END AS op, CASE WHEN event_type='error' THEN 'error' ELSE 'success' END AS outcome, CAST(round(value*100) AS BIGINT) AS bytes, event_type FROM events)"""


def _crc_table() -> str:
    """The 256 remainders of the reflected CRC-32 polynomial, as eight hex digits each."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(f"{n:08x}")
    return "".join(out)


def crc_sql(digits: str) -> str:
    """SQL of the CRC-32 of bytes written as hex digits, byte by byte; DuckDB has no function for it."""
    part = lambda text, at, n: f"CAST('0x' || substr({text}, {at}, {n}) AS BIGINT)"
    step = f"xor(c >> 8, {part(repr(_crc_table()), '8 * xor(c & 255, b) + 1', 8)})"
    return f"xor(4294967295, list_reduce(list_transform(range(0, length({digits}) // 2), lambda i: {part(digits, '2 * i + 1', 2)}), lambda c, b: {step}, CAST(4294967295 AS BIGINT)))"


def be_sql(value: str, width: int) -> str:
    """SQL of the hex digits of a whole number in so many bytes."""
    return f"lpad(lower(to_hex({value})), {2 * width}, '0')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, block, gen, event_type, value: one write per event, a drain each 256 writes."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") + 1).alias("seq"), F.col("user_id").alias("block"), div(F.col("event_id"), GENERATION).alias("gen"), "event_type", "value")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, block, gen, object_id, object_offset of every block that a drain wrote."""
    latest = log.latest(wal(spark, sf_dir).select("gen", "block", "seq"), ["gen", "block"])
    return chunks.with_ids(chunks.pack(latest, ["gen"], PER_CHUNK, BLOCK, HEADER), ["gen"]).select("seq", "block", "gen", "object_id", "object_offset")


def blockmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, seq, object_id, object_offset of the live version of each block."""
    return log.latest_row(packed(spark, sf_dir), ["block"]).select("block", "seq", "object_id", "object_offset")


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerstone.operators.extents import coalesce

    return coalesce(blockmap(spark, sf_dir), BLOCK, HEADER)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(key.alias("req"), (F.col("o_custkey") * BLOCK + key % 8 * 512).alias("off"), (512 * (1 + key % 16)).alias("len"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, size, nb, start_block: each document as a file of whole blocks."""
    d = table(spark, sf_dir, "documents")
    f = d.select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), div(F.col("n_chars") + BLOCK - 1, BLOCK).alias("nb"))
    return allocate(f, "doc_id", "nb", "start_block")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """depth, block: which blocks each layer of a clone holds, 0 being its own."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 3).alias("depth"), F.col("user_id").alias("block"))
    return e.where("depth = 2 or (depth = 1 and block % 2 = 0) or (depth = 0 and block % 4 = 0)").distinct()
