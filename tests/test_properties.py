"""Properties that the semantics promise."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerstone import catalog
from ledgerstone.functions import codec
from ledgerstone.operators import extents, gc, log, snapshots
from ledgerstone.plans import fixtures as fx
from ledgerstone.plans import formats
from ledgerstone.sources import blocklog


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_latest_is_idempotent(spark, sf_dir):
    w = fx.wal(spark, sf_dir).select("block", "seq")
    once = log.latest(w, ["block"])
    assert rows(once) == rows(log.latest(w.unionByName(w).unionByName(once), ["block"]))


def test_coalesce_then_expand_is_identity(spark, sf_dir):
    bm = fx.blockmap(spark, sf_dir).select("block", "object_id", "object_offset")
    e = extents.coalesce(bm, fx.BLOCK, fx.HEADER)
    assert rows(extents.expand(e, fx.BLOCK)) == rows(bm)
    assert rows(extents.coalesce(extents.expand(e, fx.BLOCK), fx.BLOCK, fx.HEADER)) == rows(e)


def test_fracture_example(spark):
    old = spark.createDataFrame([(0, 20, 0, 10)], "start_block long, num_blocks long, object_id long, object_offset long")
    left = extents.fracture(old, spark.createDataFrame([(8, 12)], "lo long, hi long"), fx.BLOCK)
    assert rows(left) == [(0, 8, 0, 10), (12, 8, 0, 10 + 12 * fx.BLOCK)]
    gone = extents.fracture(old, spark.createDataFrame([(0, 64), (5, 6)], "lo long, hi long"), fx.BLOCK)
    assert rows(gone) == []


def test_overlaps_over_bucket_borders(spark):
    e = spark.createDataFrame([(s, 60, 1, 10) for s in range(0, 600, 60)], "start_block long, num_blocks long, object_id long, object_offset long")
    r = spark.createDataFrame([(1, 30, 400), (2, 59, 60), (3, 600, 700), (4, 5, 5)], "req long, lo long, hi long")
    want = sorted((q, s) for q, lo, hi in ((1, 30, 400), (2, 59, 60)) for s in range(0, 600, 60) if s < hi and s + 60 > lo)
    assert rows(extents.overlaps(r, e).select("req", "start_block")) == want


def test_lookups_do_not_nest_loops(spark, sf_dir):
    plan = extents.lookup(spark.range(50).select(F.col("id").alias("block")), fx.extents(spark, sf_dir), fx.BLOCK)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_clone_is_not_moved_by_later_writes(spark, sf_dir):
    w = fx.wal(spark, sf_dir).select("block", "seq")
    later = w.select("block", (F.col("seq") + 10_000).alias("seq"))
    assert rows(snapshots.freeze(w.unionByName(later), 500)) == rows(snapshots.freeze(w, 500))


def test_no_referenced_chunk_is_a_candidate(spark, sf_dir):
    refs = gc.refcounts(fx.extents(spark, sf_dir))
    found = gc.candidates(fx.packed(spark, sf_dir), refs, 0, 1 << 60)
    assert found.join(refs, "object_id").count() == 0


def test_every_bit_flip_is_flagged(spark):
    rec = spark.range(1).select(codec.wal_record(F.lit(5), F.lit(9), F.unhex(F.lit("00ff10ab"))).alias("r")).first()["r"]
    head = codec.WAL_MAGIC + b"\0\1" + (4).to_bytes(4, "big") + bytes(8)
    files = [(-1, head + bytes(rec))]
    for i in range(len(rec) * 8):
        if 16 <= i // 8 < 24:
            continue  # the length field is not used to decode, and is covered by the checksum as well
        b = bytearray(rec)
        b[i // 8] ^= 1 << i % 8
        files.append((i, head + bytes(b)))
    df = spark.createDataFrame(files, "i int, content binary")
    assert [r["i"] for r in codec.decode_wal(df, 4, ["i"]).where("crc_ok").collect()] == [-1]


def test_strict_checkpoint(spark, sf_dir):
    good = formats.checkpoints(spark, sf_dir).limit(1).select("content").first()["content"]
    bad = {"short header": good[:9], "bad magic": b"XXXX" + good[4:], "bad version": good[:4] + b"\0\x63" + good[6:], "trailing bytes": good + b"\0", "bad crc": good[:-1] + bytes([good[-1] ^ 1])}
    for why, content in bad.items():
        df = spark.createDataFrame([(bytes(content),)], "content binary")
        with pytest.raises(Exception, match=why):
            codec.decode_map(df, []).collect()
    assert spark.createDataFrame([(bytes(bad["bad magic"]),)], "content binary").select(codec.map_fault(F.col("content"))).first()[0] == "bad magic"


def test_import_of_the_whole_log(spark, sf_dir):
    w = fx.wal(spark, sf_dir)
    q = catalog.queries()
    assert q["import_nonzero_blocks"](spark, sf_dir).count() == w.where("block % 7 <> 0").count()
    assert {r["pct"] for r in q["import_progress"](spark, sf_dir).collect()} == set(range(101))


def test_ranged_read_of_every_document(spark, sf_dir):
    t = fx.table(spark, sf_dir, "documents")
    docs = {r["doc_id"]: r["text"] for r in t.collect()}
    at = lambda d, b: b if d % 4 == 0 else b[d % 50 : d % 50 + 64]
    want = {d: None if t is None else hashlib.sha256(at(d, t.encode())).hexdigest() for d, t in docs.items()}
    part = blocklog.ranged(F.col("text").cast("binary"), (F.col("doc_id") % 50).cast("int"), F.when(F.col("doc_id") % 4 == 0, 0).otherwise(64))
    assert dict(rows(t.select("doc_id", F.sha2(part, 256)))) == want


def test_persisted_info_of_every_block(spark, sf_dir):
    assert catalog.queries()["persisted_info"](spark, sf_dir).count() == fx.wal(spark, sf_dir).select("block").distinct().count()


def test_readers(spark, tmp_path):
    rec = spark.range(3).select(codec.wal_record(F.col("id") + 1, F.col("id") * 2, F.unhex(F.lit("00ff10ab"))).alias("r")).collect()
    header = codec.WAL_MAGIC + b"\0\1" + (4).to_bytes(4, "big") + bytes(8)
    (tmp_path / "a.wal").write_bytes(header + b"".join(r["r"] for r in rec) + b"torn")
    plain = blocklog.read_wal(spark, str(tmp_path), 4).drop("path", "pos")
    spark.dataSource.register(blocklog.BlockLogSource)
    source = spark.read.format("blocklog").option("path", str(tmp_path)).option("block_size", "4").load().drop("path", "pos")
    assert rows(plain) == rows(source) and plain.where("crc_ok").count() == 3
    (tmp_path / "chunks").mkdir()
    (tmp_path / "chunks" / "chunk.00000042.bin").write_bytes(b"x")
    assert [r["object_id"] for r in blocklog.chunk_listing(spark, str(tmp_path)).collect()] == [42]
