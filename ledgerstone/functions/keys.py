"""Object keys: formatting, parsing, packing of shard numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_key(volume: Column, object_id: Column) -> Column:
    return F.format_string("%s/chunks/chunk.%08d.bin", volume, object_id)


# The key of each kind of object below its volume.
KINDS = {
    "config": "config.json",
    "chunk": "chunks/chunk.%08d.bin",
    "checkpoint": "checkpoints/blocks.%08d.bin",
    "wal_chunk": "wal/chunks/wal.%08d.bin",
    "wal_block": "wal/blocks/blocks.%08d.bin",
    "wal_shard": "wal/chunks/wal.%08d.shard_%02d.bin",
    "checkpoint_live": "checkpoints/blocks.live.bin",
    "snapshot_marker": "snapshots.marker",
    "unknown": "unknown.%08d.bin",
}


def key(kind: Column, volume: Column, object_id: Column) -> Column:
    """The key of an object; a sharded log carries its shard in the low byte of its number."""
    wal, shard = unpack_shard(object_id)
    out = F.format_string("%s/" + KINDS["unknown"], volume, object_id)
    for name, form in KINDS.items():
        args = (wal, shard) if name == "wal_shard" else (object_id,) if "%" in form else ()
        out = F.when(kind == name, F.format_string("%s/" + form, volume, *args)).otherwise(out)
    return out


def chunk_number(key: Column) -> Column:
    """Null for keys of any other kind."""
    digits = F.regexp_extract(key, r"/chunks/chunk\.(\d+)\.bin$", 1)
    return F.when(digits != "", digits.cast("long"))


def pack_shard(wal: Column, shard: Column) -> Column:
    return F.shiftleft(wal.cast("long"), 8).bitwiseOR(shard.cast("long"))


def unpack_shard(packed: Column) -> tuple[Column, Column]:
    return F.shiftright(packed, 8), packed.bitwiseAND(F.lit(255))


def human_bytes(n: Column) -> Column:
    """IEC units, one decimal from 1024 on, ties to even."""
    out = F.format_string("%d B", n)
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB", "EiB"), 1):
        out = F.when(n >= 1 << 10 * k, F.format_string(f"%.1f {unit}", F.bround(n / float(1 << 10 * k), 1))).otherwise(out)
    return out
