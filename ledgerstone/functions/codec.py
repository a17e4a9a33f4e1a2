"""Big-endian records as column expressions: packing, unpacking, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerstone.functions.numbers import div

# Magics, header and record sizes of the binary formats.
WAL_MAGIC, WAL_SEALED_MAGIC = b"VBWL", b"VBWE"
CHUNK_MAGIC, CHUNK_SEALED_MAGIC = b"VBCH", b"VBCE"
MAP_MAGIC, FLAT_MAGIC = b"VBWB", b"FLAT"
VERSION = 1
WAL_HEADER, WAL_FIXED, CHUNK_HEADER, MAP_HEADER, MAP_RECORD = 18, 28, 10, 14, 34
TAG, SEALED_FIXED = 16, 40


def be(value: Column, width: int) -> Column:
    """The low `width` bytes of a whole number, highest first."""
    return F.unhex(F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * width, 2 * width))


def number(data: Column, at: int | Column, width: int) -> Column:
    """The unsigned number at a byte (from 0, a number or a column); 2^63 and more raise an error in ANSI mode."""
    part = F.substring(data, at + 1, width if isinstance(at, int) else F.lit(width))
    return F.conv(F.hex(part), 16, 10).cast("long")


def raw(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def wal_record(seq: Column, block: Column, data: Column) -> Column:
    head = F.concat(be(seq, 8), be(block, 8), be(F.length(data), 8))
    return F.concat(head, be(F.crc32(F.concat(head, data)), 4), data)


def wal_header(block_size: int, seconds: Column, sealed: bool = False) -> Column:
    return F.concat(raw(WAL_SEALED_MAGIC if sealed else WAL_MAGIC), be(F.lit(VERSION), 2), be(F.lit(block_size), 4), be(seconds, 8))


def sealed_record(seq: Column, block: Column, sealed: Column) -> Column:
    """A record whose ciphertext and tag stand for data and checksum; its length is that of the data."""
    return F.concat(be(seq, 8), be(block, 8), be(F.length(sealed) - TAG, 8), sealed)


def chunk_header(block_size: int, sealed: bool = False) -> Column:
    return F.concat(raw(CHUNK_SEALED_MAGIC if sealed else CHUNK_MAGIC), be(F.lit(VERSION), 2), be(F.lit(block_size), 4))


def map_record(block: Column, object_id: Column, offset: Column, seq: Column, num_blocks: Column | None = None) -> Column:
    """A run of blocks, one by default."""
    body = F.concat(be(block, 8), be(F.lit(1) if num_blocks is None else num_blocks, 2), be(object_id, 8), be(offset, 4), be(seq, 8))
    return F.concat(body, be(F.crc32(body), 4))


def map_header(seconds: Column) -> Column:
    return F.concat(raw(MAP_MAGIC), be(F.lit(VERSION), 2), be(seconds, 8))


def _records(content: Column, header: int, size: int) -> Column:
    n = div(F.length(content) - header, size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.cast("long").alias("pos"), F.substring(content, F.lit(header + 1) + i * size, F.lit(size)).alias("rec")))


def wal_fault(content: Column, block_size: int, sealed: bool = False) -> Column:
    """Why a log would be refused; null if it would not.  A plain log under encryption is told from a strange one."""
    magic = F.substring(content, 1, 4)
    return (
        F.when(F.length(content) < WAL_HEADER, "short header")
        .when((magic == raw(WAL_MAGIC)) & F.lit(sealed), "before encryption")
        .when(magic != raw(WAL_SEALED_MAGIC if sealed else WAL_MAGIC), "bad magic")
        .when(number(content, 4, 2) != VERSION, "bad version")
        .when(number(content, 6, 4) != block_size, "bad block size")
    )


def _sound(files: DataFrame, fault: Column, strict: bool) -> DataFrame:
    """Files without a fault; if strict any fault is an error."""
    if strict:
        return files.withColumn("content", F.when(fault.isNotNull(), F.raise_error(fault).cast("binary")).otherwise(F.col("content")))
    return files.where(fault.isNull())


def decode_wal(files: DataFrame, block_size: int, keep: list[str], strict: bool = False) -> DataFrame:
    """One row per whole record: pos, seq, block, data, crc_ok.  A torn tail is no record.

    A log whose header is at fault has no records; if strict it raises an error, and so does a
    record that is damaged or declares another length.
    """
    files = _sound(files, wal_fault(F.col("content"), block_size), strict)
    r = files.select(*keep, F.explode(_records(F.col("content"), WAL_HEADER, WAL_FIXED + block_size)).alias("r")).select(*keep, "r.pos", "r.rec")
    rec = F.col("rec")
    ok = F.crc32(F.concat(F.substring(rec, 1, 24), F.substring(rec, WAL_FIXED + 1, block_size))) == number(rec, 24, 4)
    if strict:
        ok = F.when(number(rec, 16, 8) != block_size, F.raise_error(F.lit("bad length")).cast("boolean")).when(~ok, F.raise_error(F.lit("bad crc")).cast("boolean")).otherwise(True)
    return r.select(*keep, "pos", number(rec, 0, 8).alias("seq"), number(rec, 8, 8).alias("block"), F.substring(rec, WAL_FIXED + 1, block_size).alias("data"), ok.alias("crc_ok"))


def decode_sealed_wal(files: DataFrame, block_size: int, keep: list[str]) -> DataFrame:
    """One row per whole record of a sealed log: pos, seq, block, sealed.  Logs with a fault in the header have none."""
    size = SEALED_FIXED + block_size
    r = _sound(files, wal_fault(F.col("content"), block_size, True), False)
    r = r.select(*keep, F.explode(_records(F.col("content"), WAL_HEADER, size)).alias("r")).select(*keep, "r.pos", "r.rec")
    return r.select(*keep, "pos", number(F.col("rec"), 0, 8).alias("seq"), number(F.col("rec"), 8, 8).alias("block"), F.substring("rec", 25, size - 24).alias("sealed"))


def decode_map(files: DataFrame, keep: list[str]) -> DataFrame:
    """All or nothing: any fault of a checkpoint raises an error."""
    c = F.col("content")
    fault = (
        F.when(F.length(c) < MAP_HEADER, "short header")
        .when(F.substring(c, 1, 4) != raw(MAP_MAGIC), "bad magic")
        .when(number(c, 4, 2) != VERSION, "bad version")
        .when((F.length(c) - MAP_HEADER) % MAP_RECORD != 0, "trailing bytes")
    )
    sound = files.withColumn("content", F.when(fault.isNotNull(), F.raise_error(fault).cast("binary")).otherwise(c))
    r = sound.select(*keep, F.explode(_records(F.col("content"), MAP_HEADER, MAP_RECORD)).alias("r")).select(*keep, "r.rec")
    rec = F.col("rec")
    ok = F.crc32(F.substring(rec, 1, 30)) == number(rec, 30, 4)
    block = F.when(ok, number(rec, 0, 8)).otherwise(F.raise_error(F.lit("bad crc")).cast("long"))
    return r.select(*keep, block.alias("block"), number(rec, 8, 2).alias("num_blocks"), number(rec, 10, 8).alias("object_id"), number(rec, 18, 4).alias("object_offset"), number(rec, 22, 8).alias("seq"))


def map_fault(content: Column) -> Column:
    """Why a checkpoint would be refused; null if it would not."""
    body = F.substring(content, MAP_HEADER + 1, 30)
    return (
        F.when(F.length(content) < MAP_HEADER, "short header")
        .when(F.substring(content, 1, 4) != raw(MAP_MAGIC), "bad magic")
        .when(number(content, 4, 2) != VERSION, "bad version")
        .when((F.length(content) - MAP_HEADER) % MAP_RECORD != 0, "trailing bytes")
        .when((F.length(content) > MAP_HEADER) & (F.crc32(body) != number(content, MAP_HEADER + 30, 4)), "bad crc")
    )


def flat_section(sources: DataFrame, records: DataFrame) -> DataFrame:
    """(volume, content): inherited layers behind one another, from sources (volume, depth, name, uuid) and records (volume, depth, block, object_id, object_offset, seq).

    A volume has at most 255 sources; a source without blocks has an empty layer.
    """
    rec = records.select("volume", "depth", F.struct("block", map_record(F.col("block"), F.col("object_id"), F.col("object_offset"), F.col("seq")).alias("rec")).alias("r"))
    body = rec.groupBy("volume", "depth").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    s = sources.join(body, ["volume", "depth"], "left")
    n = F.greatest(F.coalesce(F.size("rs"), F.lit(0)), F.lit(0))
    name = F.col("name").cast("binary")
    layer = F.concat(be(F.length(name), 2), name, F.col("uuid"), F.unhex(F.sha2(name, 256)), be(n, 4), F.coalesce(joined(F.transform("rs", lambda x: x["rec"])), F.lit(b"").cast("binary")))
    whole = s.select("volume", F.struct("depth", layer.alias("layer")).alias("l")).groupBy("volume").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    return whole.select("volume", F.concat(raw(FLAT_MAGIC), be(F.lit(1), 1), be(F.size("ls"), 1), joined(F.transform("ls", lambda x: x["layer"]))).alias("content"))


def joined(parts: Column) -> Column:
    """Byte strings behind one another, in one pass."""
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x)), ""))


def flat_layers(files: DataFrame) -> DataFrame:
    """files with `fault` and `layers` (depth, name, uuid, name_hash, n, at) of their flat section, read from source to source."""
    c = F.col("content")
    short = lambda off, need: off + need > F.length(c)
    start = F.struct(F.lit(6).alias("off"), F.lit(None).cast("string").alias("fault"), F.expr("cast(array() as array<struct<depth:int,name:string,uuid:binary,name_hash:binary,n:int,at:int>>)").alias("layers"))

    def read(acc: Column, i: Column) -> Column:
        off = acc["off"]
        size = F.when(short(off, 2), 0).otherwise(number(c, off, 2)).cast("int")
        rest = off + 2 + size
        n = F.when(short(rest, 40), 0).otherwise(number(c, rest + 36, 4)).cast("int")
        at = rest + 40
        fault = F.when(short(off, 2), "truncated name length").when(short(off, 2 + size), "truncated name").when(short(rest, 40), "truncated identity").when(short(at, n * MAP_RECORD), "truncated block")
        layer = F.struct(i.alias("depth"), F.substring(c, off + 3, size).cast("string").alias("name"), F.substring(c, rest + 1, F.lit(4)).alias("uuid"), F.substring(c, rest + 5, F.lit(32)).alias("name_hash"), n.alias("n"), at.alias("at"))
        more = F.struct((at + n * MAP_RECORD).alias("off"), fault.alias("fault"), F.when(fault.isNull(), F.concat(acc["layers"], F.array(layer))).otherwise(acc["layers"]).alias("layers"))
        return F.when(acc["fault"].isNotNull(), acc).otherwise(more)

    head = F.when(F.length(c) < 6, "too short").when(F.substring(c, 1, 4) != raw(FLAT_MAGIC), "bad magic")
    sources = F.when(head.isNull(), number(c, 5, 1).cast("int")).otherwise(0)
    every = F.when(sources > 0, F.sequence(F.lit(0), sources - 1)).otherwise(F.array().cast("array<int>"))
    out = files.withColumn("acc", F.aggregate(every, start, read))
    return out.withColumn("fault", F.coalesce(head, F.col("acc.fault"))).withColumn("layers", F.col("acc.layers")).drop("acc")


def decode_flat(files: DataFrame, keep: list[str]) -> DataFrame:
    """One row per inherited block: depth, name, block, object_id, object_offset, seq.  Any fault raises an error."""
    f = flat_layers(files)
    layers = F.when(F.col("fault").isNotNull(), F.raise_error(F.col("fault")).cast("array<struct<depth:int,name:string,uuid:binary,name_hash:binary,n:int,at:int>>")).otherwise(F.col("layers"))
    f = f.select(*keep, "content", F.explode(layers).alias("l")).where("l.n > 0")
    f = f.select(*keep, "l.depth", "l.name", "content", F.col("l.at").alias("at"), F.explode(F.sequence(F.lit(0), F.col("l.n") - 1)).alias("i"))
    rec = F.col("rec")
    r = f.select(*keep, "depth", "name", F.substring("content", F.col("at") + F.col("i") * MAP_RECORD + 1, F.lit(MAP_RECORD)).alias("rec"))
    ok = F.crc32(F.substring(rec, 1, 30)) == number(rec, 30, 4)
    block = F.when(ok, number(rec, 0, 8)).otherwise(F.raise_error(F.lit("bad crc")).cast("long"))
    return r.select(*keep, "depth", "name", block.alias("block"), number(rec, 10, 8).alias("object_id"), number(rec, 18, 4).alias("object_offset"), number(rec, 22, 8).alias("seq"))
