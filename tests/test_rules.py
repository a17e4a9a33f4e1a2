"""Known answers and plain versions for what SQL cannot state."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerstone import catalog
from ledgerstone.functions import codec, crypto
from ledgerstone.operators import extents, gc, simplefs
from ledgerstone.plans import fixtures as fx
from ledgerstone.plans import formats, rules
from ledgerstone.sources import blocklog

OPS = "volume long, seq long, op string, path string, size long"


def test_file_table_in_small(spark):
    k = fx.BLOCK
    ops = [(1, 0, "create_volume", None, 10 * k), (1, 1, "create", "a", 3 * k), (1, 2, "create", "b", 2 * k + 1), (1, 3, "delete", "a", None), (1, 4, "create", "c", 7 * k), (1, 5, "create", "b", 1), (1, 6, "create", "d", 100 * k), (1, 7, "delete", "x", None), (1, 8, "create", "e", 0), (1, 9, "format", None, None), (1, 10, "create", "z", k), (2, 0, "create_volume", None, k + 1), (2, 1, "create", "a", k)]
    got = {(r["volume"], r["seq"]): (r["status"], r["blocks"], r["free"]) for r in simplefs.replay(spark.createDataFrame(ops, OPS), k).collect()}
    assert got[1, 1] == ("ok", [0, 1, 2], 7) and got[1, 2] == ("ok", [3, 4, 5], 4)
    assert got[1, 3] == ("ok", [0, 1, 2], 7) and got[1, 4] == ("ok", [6, 7, 8, 9, 0, 1, 2], 0)
    assert got[1, 5] == ("ok", [3], 2)  # the old blocks go to the end of the free list first
    assert got[1, 6] == ("no_space", [], 2) and got[1, 7] == ("not_found", [], 2) and got[1, 8] == ("ok", [], 2)
    assert got[1, 9] == ("ok", [], 10) and got[1, 10] == ("ok", [0], 9)
    assert got[2, 0] == ("bad_size", [], 0) and got[2, 1] == ("no_space", [], 0)
    assert simplefs.replay(spark.createDataFrame([], OPS), k).count() == 0


def test_file_table_against_plain_lists(spark, sf_dir):
    """All operations of the fixture, replayed over a list and a dict of lists."""
    ops = rules._operations(spark, sf_dir).collect()
    free, files, total, want = {}, {}, {}, {}
    for r in sorted(ops, key=lambda r: (r["volume"], r["seq"])):
        v = r["volume"]
        status, blocks = "ok", []
        if r["op"] == "create_volume":
            status = "ok" if r["size"] % fx.BLOCK == 0 else "bad_size"
            total[v] = r["size"] // fx.BLOCK if status == "ok" else 0
        if r["op"] in ("create_volume", "format"):
            free[v], files[v] = list(range(total[v])), {}
        elif r["op"] == "delete":
            status = "ok" if r["path"] in files[v] else "not_found"
            blocks = files[v].pop(r["path"], [])
            free[v] += blocks
        else:
            free[v] += files[v].pop(r["path"], [])
            n = -(-r["size"] // fx.BLOCK)
            if n <= len(free[v]):
                blocks, free[v] = free[v][:n], free[v][n:]
                files[v][r["path"]] = blocks
            else:
                status = "no_space"
        want[v, r["seq"]] = (status, blocks, len(free[v]))
    got = {(r["volume"], r["seq"]): (r["status"], r["blocks"], r["free"]) for r in catalog.queries()["fs_replay"](spark, sf_dir).collect()}
    assert got == want
    state = {(r["volume"], r["path"]): r["blocks"] for r in catalog.queries()["fs_state"](spark, sf_dir).collect()}
    assert state == {(v, p): b for v, f in files.items() for p, b in f.items()}


def test_encoded_bytes(spark, sf_dir):
    """Logs and checkpoints byte by byte, from struct and zlib."""
    r = formats.records(spark, sf_dir).collect()
    logs = {}
    for x in sorted(r, key=lambda x: x["seq"]):
        head = struct.pack(">QQQ", x["seq"], x["block"], 16)
        body = bytes(x["data"])
        logs.setdefault((x["gen"], x["block"] % 16), []).append(head + struct.pack(">I", zlib.crc32(head + body)) + body)
    header = b"VBWL" + struct.pack(">HIQ", 1, 16, formats.NOW)
    got = {(x["gen"], x["shard"]): x["content"] for x in catalog.queries()["wal_encode"](spark, sf_dir).collect()}
    assert got == {k: (header + b"".join(v)).hex() for k, v in logs.items()}
    maps = {}
    for x in sorted(fx.blockmap(spark, sf_dir).collect(), key=lambda x: x["block"]):
        body = struct.pack(">QHQIQ", x["block"], 1, x["object_id"], x["object_offset"], x["seq"])
        maps.setdefault(x["object_id"] // 64, []).append(body + struct.pack(">I", zlib.crc32(body)))
    got = {x["part"]: x["content"] for x in catalog.queries()["ckpt_encode"](spark, sf_dir).collect()}
    assert got == {k: (b"VBWB" + struct.pack(">HQ", 1, formats.NOW) + b"".join(v)).hex() for k, v in maps.items()}


def test_known_answers_of_gcm(spark):
    """Published vectors for a key of 32 zero bytes and a nonce of 12."""
    zero = lambda n: F.unhex(F.lit("00" * n))
    none = F.lit(b"").cast("binary")
    row = spark.range(1).select(F.hex(crypto.seal(zero(16), zero(32), zero(12), none)).alias("sealed"), F.hex(crypto.mac(none, zero(32), zero(12), none)).alias("tag")).first()
    assert row["sealed"].lower() == "cea7403d4d606b6e074ec5d3baf39d18d0d1c8a799996bf0265b98b5d48ab919"
    assert row["tag"].lower() == "530f8afbc74536b9a963b4f1c4cb738b"


@pytest.mark.parametrize("name", ["seal_blocks", "meta_mac"])
def test_tags_differ_with_what_they_cover(spark, sf_dir, name):
    got = [tuple(r) for r in catalog.queries()[name](spark, sf_dir).collect()]
    assert len({r[-1] for r in got}) == len(got) and {len(r[-1]) for r in got} == {64 if name == "seal_blocks" else 32}


def test_strict_log(spark):
    rec = spark.range(1).select(codec.wal_record(F.lit(5), F.lit(9), F.unhex(F.lit("00ff10ab"))).alias("r")).first()["r"]
    head = codec.WAL_MAGIC + b"\0\1" + (4).to_bytes(4, "big") + bytes(8)
    good = head + bytes(rec)
    one = lambda content: spark.createDataFrame([(content,)], "content binary")
    assert codec.decode_wal(one(good), 4, [], strict=True).first()["seq"] == 5
    bad = {"short header": good[:17], "bad magic": b"XXXX" + good[4:], "bad version": good[:5] + b"\2" + good[6:], "bad block size": good[:9] + b"\5" + good[10:], "bad crc": good[:-1] + b"\0", "bad length": good[:18 + 23] + b"\5" + good[18 + 24 :]}
    for why, content in bad.items():
        with pytest.raises(Exception, match=why):
            codec.decode_wal(one(content), 4, [], strict=True).collect()
        if why not in ("bad crc", "bad length"):
            assert codec.decode_wal(one(content), 4, []).count() == 0
    sealed = codec.WAL_SEALED_MAGIC + good[4:]
    assert one(sealed).select(codec.wal_fault(F.col("content"), 4)).first()[0] == "bad magic"
    assert one(good).select(codec.wal_fault(F.col("content"), 4, sealed=True)).first()[0] == "before encryption"


def test_strict_flat_section(spark, sf_dir):
    own = rules._placed(spark, sf_dir).where("depth > 0").selectExpr("0L as volume", "depth", "block", "object_id", "object_offset", "seq")
    sources = spark.createDataFrame([(0, 1, "a", bytes(4)), (0, 2, "é", bytes(4)), (0, 3, "none", bytes(4))], "volume long, depth long, name string, uuid binary")
    good = bytes(codec.flat_section(sources, own).first()["content"])
    one = lambda content: spark.createDataFrame([(content,)], "content binary")
    got = codec.decode_flat(one(good), []).collect()
    assert len(got) == own.count() and {r["name"] for r in got} == {"a", "é"}
    for why, content in {"bad crc": good[:60] + bytes([good[60] ^ 1]) + good[61:], "truncated": good[:-5], "bad magic": b"X" + good[1:], "too short": good[:5]}.items():
        with pytest.raises(Exception, match=why):
            codec.decode_flat(one(content), []).collect()


def test_written_objects(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = [("v1/chunks/a.bin", b"one"), ("v1/config.json", b""), ("v2/x", bytes(range(256)))]
    blocklog.write(spark.createDataFrame(rows, "key string, content binary"), root)
    blocklog.write(spark.createDataFrame([("v2/x", b"again")], "key string, content binary"), root)
    got = {r["key"]: (bytes(r["content"]), r["length"], r["prefix"]) for r in blocklog.keyed(spark, root).collect()}
    assert got == {"v1/chunks/a.bin": (b"one", 3, "v1"), "v2/x": (b"again", 5, "v2")}  # no empty object is listed
    assert (tmp_path / "store" / "v1" / "config.json").read_bytes() == b""


def test_nothing_is_eligible_without_a_stored_checkpoint(spark):
    empty = spark.createDataFrame([], "object_id long, gen long")
    assert gc.candidates(empty, empty.groupBy("object_id").count(), gc.floor(None), 0).count() == 0
    some = spark.createDataFrame([(1, 0), (2, 0)], "object_id long, gen long")
    assert gc.candidates(some, empty.select("object_id"), gc.floor(None), 9).count() == 0


def test_fracture_by_many_cuts(spark):
    old = spark.createDataFrame([(0, 1000, 0, 10), (2000, 5, 0, 10 + 1000 * fx.BLOCK)], "start_block long, num_blocks long, object_id long, object_offset long")
    cuts = [(k, k + 1 + k % 4) for k in range(0, 990, 3)] + [(100, 400)]
    gone = {b for lo, hi in cuts for b in range(lo, hi)}
    left = extents.fracture(old, spark.createDataFrame(cuts, "lo long, hi long"), fx.BLOCK).collect()
    assert {b for r in left for b in range(r["start_block"], r["start_block"] + r["num_blocks"])} == ({*range(1000)} - gone) | {*range(2000, 2005)}
    assert all(r["object_offset"] == 10 + (r["start_block"] if r["start_block"] < 1000 else 1000) * fx.BLOCK for r in left)


def test_state_documents(spark):
    t = simplefs.Table(fx.BLOCK)
    t.create_volume(4 * fx.BLOCK)
    t.create("a", 5000)
    assert json.loads(t.dump())["Blocks"]["a"] == {"Filename": "a", "Size": 5000, "Blocks": [0, 1]}
    again = simplefs.Table.load(t.dump())
    assert again.dump() == t.dump() and again.create("b", 3 * fx.BLOCK) == ("no_space", [])
