"""Queries on keys, binary formats, integrity, files and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.functions import codec, crypto, keys
from ledgerstone.functions.numbers import div
from ledgerstone.operators import chunks, extents, log
from ledgerstone.plans import fixtures as fx
from ledgerstone.plans.fixtures import BM, D, EXT, FILES, WAL
from ledgerstone.plans.registry import both, query

B = lambda x: f"CAST({x} AS BIGINT)"
SMALL = 16  # bytes of a block in encoded fixtures
NOW = 1_700_000_000

# ---- keys and listings ----------------------------------------------------------------------


@query("key_parse", "SELECT concat('v/chunks/chunk.', lpad(CAST(p_partkey AS VARCHAR), 8, '0'), CASE WHEN p_partkey % 5 = 0 THEN '.tmp' ELSE '.bin' END) AS key, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey END AS object_id FROM part")
def key_parse(spark, d):
    key = F.concat(F.regexp_replace(keys.chunk_key(F.lit("v"), F.col("p_partkey")), r"\.bin$", ""), F.when(F.col("p_partkey") % 5 == 0, ".tmp").otherwise(".bin"))
    return fx.table(spark, d, "part").select(key.alias("key")).select("key", keys.chunk_number(F.col("key")).alias("object_id"))


@query("key_shard_unpack", "SELECT event_id AS id, event_id >> 8 AS wal, event_id & 255 AS shard FROM events")
def key_shard_unpack(spark, d):
    wal, shard = keys.unpack_shard(F.col("event_id"))
    return fx.table(spark, d, "events").select(F.col("event_id").alias("id"), wal.alias("wal"), shard.alias("shard"))


@query("human_bytes", "SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GiB', n/1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.1f MiB', n/1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.1f KiB', n/1024.0::DOUBLE) ELSE printf('%d B', n) END AS size FROM (SELECT doc_id, n_chars * (doc_id % 900 + 1) AS n FROM documents) x")
def human_bytes(spark, d):
    n = F.col("n_chars") * (F.col("doc_id") % 900 + 1)
    return fx.table(spark, d, "documents").select("doc_id", keys.human_bytes(n).alias("size"))


# ---- encoded logs and maps ------------------------------------------------------------------


def records(spark, d) -> DataFrame:
    """The fixture log with block contents: 16 bytes, all zero for some blocks."""
    data = F.when(F.col("block") % 7 == 0, F.unhex(F.lit("00" * SMALL))).otherwise(F.substring(F.unhex(F.sha2(F.concat_ws("/", "block", "seq"), 256)), 1, SMALL))
    return fx.wal(spark, d).select("gen", "seq", "block", data.alias("data"))


def encoded(spark, d) -> DataFrame:
    """One log file per drain and shard: gen, shard, content."""
    rec = codec.wal_record(F.col("seq"), F.col("block"), F.col("data"))
    r = records(spark, d).select("gen", (F.col("block") % 16).alias("shard"), F.col("seq").alias("slot"), rec.alias("data"))
    return chunks.assemble(r, ["gen", "shard"]).select("gen", "shard", F.concat(codec.wal_header(SMALL, F.lit(NOW)), "body").alias("content"))


def hexed(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.lower(F.hex(c)))
    return df


DATA = "CASE WHEN block % 7 = 0 THEN repeat('00', 16) ELSE substr(sha256(concat(CAST(block AS VARCHAR), '/', CAST(seq AS VARCHAR))), 1, 32) END"

# The same logs and maps, written down in SQL as hex digits.
WAL_HEX = f"""{WAL}, head AS (SELECT gen, block, seq, concat({fx.be_sql('seq', 8)}, {fx.be_sql('block', 8)}, {fx.be_sql('16', 8)}) AS head, {DATA} AS data FROM wal),
sum_ AS (SELECT *, concat(head, data) AS whole FROM head),
rec AS (SELECT *, concat(head, {fx.be_sql(fx.crc_sql('whole'), 4)}, data) AS rec FROM sum_)"""
MAP_HEX = f"""{BM}, body AS (SELECT object_id // 64 AS part, block, concat({fx.be_sql('block', 8)}, '0001', {fx.be_sql('object_id', 8)}, {fx.be_sql('object_offset', 4)}, {fx.be_sql('seq', 8)}) AS body FROM bm),
rec AS (SELECT *, concat(body, {fx.be_sql(fx.crc_sql('body'), 4)}) AS rec FROM body)"""


@query("wal_encode", f"WITH {WAL_HEX} SELECT gen, block % 16 AS shard, concat('{codec.WAL_MAGIC.hex()}000100000010', {fx.be_sql(str(NOW), 8)}, string_agg(rec, '' ORDER BY seq)) AS content FROM rec GROUP BY gen, block % 16")
def wal_encode(spark, d):
    return hexed(encoded(spark, d), "content")


@query("wal_decode_roundtrip", f"WITH {WAL} SELECT gen, seq, block, {DATA} AS data, true AS crc_ok FROM wal")
def wal_decode_roundtrip(spark, d):
    return hexed(codec.decode_wal(encoded(spark, d), SMALL, ["gen"]).drop("pos"), "data").select("gen", "seq", "block", "data", "crc_ok")


@query("wal_decode_sharded", f"WITH {WAL} SELECT gen, block % 16 AS shard, count(*) AS records, max(seq) AS last_seq FROM wal GROUP BY gen, block % 16")
def wal_decode_sharded(spark, d):
    return codec.decode_wal(encoded(spark, d), SMALL, ["gen", "shard"]).groupBy("gen", "shard").agg(F.count(F.lit(1)).alias("records"), F.max("seq").alias("last_seq"))


def _damaged(spark, d) -> DataFrame:
    """In logs of odd drains one byte of the second record is flipped and the last record is torn."""
    c, at = F.col("content"), codec.WAL_HEADER + codec.WAL_FIXED + SMALL + codec.WAL_FIXED + 4
    flipped = F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring(c, at, 1)), 16, 10).cast("long").bitwiseXOR(F.lit(1))), 2, "0"))
    bad = F.concat(F.substring(c, 1, at - 1), flipped, F.substring(c, F.lit(at + 1), F.length(c) - at - 3))
    return encoded(spark, d).withColumn("content", F.when((F.col("gen") % 2 == 1) & (F.length(c) > at + 8), bad).otherwise(c))


NTH = f"{WAL}, nth AS (SELECT *, block % 16 AS shard, row_number() OVER (PARTITION BY gen, block % 16 ORDER BY seq) AS rn, count(*) OVER (PARTITION BY gen, block % 16) AS n FROM wal)"


@query("wal_crc_verify", f"WITH {NTH} SELECT gen, shard, seq, NOT (gen % 2 = 1 AND rn = 2) AS crc_ok FROM nth WHERE NOT (gen % 2 = 1 AND rn = n AND n > 1)")
def wal_crc_verify(spark, d):
    return codec.decode_wal(_damaged(spark, d), SMALL, ["gen", "shard"]).select("gen", "shard", "seq", "crc_ok")


@query("wal_prefix_recovery", f"WITH {NTH} SELECT gen, shard, seq FROM nth WHERE gen % 2 = 0 OR rn < 2")
def wal_prefix_recovery(spark, d):
    r = codec.decode_wal(_damaged(spark, d), SMALL, ["gen", "shard"])
    return log.prefix_ok(r, ["gen", "shard"], "pos", "crc_ok").select("gen", "shard", "seq")


@query("recover_equals_batch", f"WITH {WAL} SELECT block, max(seq) AS seq FROM wal GROUP BY block")
def recover_equals_batch(spark, d):
    return log.latest(codec.decode_wal(encoded(spark, d), SMALL, ["gen"]).where("crc_ok"), ["block"])


@query("chunk_assemble", f"WITH {D}, p AS (SELECT gen, block, seq, row_number() OVER (PARTITION BY gen ORDER BY block)-1 AS pos FROM d) SELECT gen, {B('floor(pos/16.0)')} AS chunk, string_agg({DATA}, '' ORDER BY block) AS body FROM p GROUP BY gen, {B('floor(pos/16.0)')}")
def chunk_assemble(spark, d):
    r = records(spark, d)
    best = log.latest_row(r, ["gen", "block"])
    slots = chunks.pack(best, ["gen"], fx.PER_CHUNK, SMALL, codec.CHUNK_HEADER).withColumnRenamed("pos", "slot")
    return hexed(chunks.assemble(slots, ["gen", "chunk"]), "body")


def checkpoints(spark, d) -> DataFrame:
    """One encoded checkpoint per 64 chunks: part, content."""
    bm = fx.blockmap(spark, d)
    rec = codec.map_record(F.col("block"), F.col("object_id"), F.col("object_offset"), F.col("seq"))
    slots = bm.select(div(F.col("object_id"), 64).alias("part"), F.col("block").alias("slot"), rec.alias("data"))
    return chunks.assemble(slots, ["part"]).select("part", F.concat(codec.map_header(F.lit(NOW)), "body").alias("content"))


@query("ckpt_encode", f"WITH {MAP_HEX} SELECT part, concat('{codec.MAP_MAGIC.hex()}0001', {fx.be_sql(str(NOW), 8)}, string_agg(rec, '' ORDER BY block)) AS content FROM rec GROUP BY part")
def ckpt_encode(spark, d):
    return hexed(checkpoints(spark, d), "content")


@query("ckpt_decode", f"WITH {BM} SELECT block, object_id, object_offset, seq FROM bm")
def ckpt_decode(spark, d):
    return codec.decode_map(checkpoints(spark, d), []).drop("num_blocks")


@query("snap_load", f"WITH {EXT} SELECT start_block, num_blocks, object_id, object_offset FROM ext")
def snap_load(spark, d):
    """A decoded map must have as many blocks as its snapshot says; here that is checked on the whole of it."""
    m = codec.decode_map(checkpoints(spark, d), [])
    n = fx.blockmap(spark, d).agg(F.count(F.lit(1)).alias("declared")).crossJoin(m.agg(F.sum("num_blocks").alias("found")))  # one row each
    right = F.when(F.col("declared") == F.col("found"), F.col("block")).otherwise(F.raise_error(F.lit("block count")).cast("long"))
    return extents.coalesce(m.crossJoin(F.broadcast(n)).withColumn("block", right), fx.BLOCK, fx.HEADER)


# ---- metadata -------------------------------------------------------------------------------


@query("config_parse", "SELECT c_custkey AS id, c_name AS name, c_custkey * 4096 AS size, CASE WHEN c_custkey % 2 = 0 THEN 'a' END AS tier FROM customer")
def config_parse(spark, d):
    """State documents, half of them in an envelope, tags sometimes null."""
    c = fx.table(spark, d, "customer")
    doc = F.concat(F.lit('{"VolumeName":"'), "c_name", F.lit('","VolumeSize":'), (F.col("c_custkey") * 4096).cast("string"), F.lit(',"Tags":'), F.when(F.col("c_custkey") % 2 == 0, '{"tier":"a"}').otherwise("null"), F.lit("}"))
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"v":1,"payload":'), doc, F.lit(',"authtag":"AA=="}'))).otherwise(doc)
    inner = F.coalesce(F.get_json_object("raw", "$.payload"), "raw")
    state = F.from_json(inner, "VolumeName string, VolumeSize long, Tags map<string,string>")
    return c.select(F.col("c_custkey").alias("id"), raw.alias("raw")).select("id", state.alias("s")).select("id", F.col("s.VolumeName").alias("name"), F.col("s.VolumeSize").alias("size"), F.col("s.Tags")["tier"].alias("tier"))


# ---- integrity ------------------------------------------------------------------------------

UUID, KEY = F.unhex, "0123456789abcdef0123456789abcdef"


def _sealed(spark, d) -> DataFrame:
    r = records(spark, d)
    iv = crypto.nonce(F.col("seq"), F.unhex(F.lit("01020304")), 1)
    aad = crypto.data_aad(F.lit("vol"), F.col("block"), F.col("seq"))
    r = r.withColumn("iv", iv).withColumn("aad", aad)
    return r.withColumn("sealed", crypto.seal(F.col("data"), F.lit(KEY).cast("binary"), F.col("iv"), F.col("aad")))


@query("nonce_build", f"WITH {WAL} SELECT seq, concat(lpad(lower(to_hex(seq)), 14, '0'), '0102030401') AS nonce FROM wal")
def nonce_build(spark, d):
    return hexed(fx.wal(spark, d).select("seq", crypto.nonce(F.col("seq"), F.unhex(F.lit("01020304")), 1).alias("nonce")), "nonce")


@query("aad_build", f"WITH {WAL} SELECT seq, concat(sha256('vol'), lpad(lower(to_hex(block)), 16, '0'), lpad(lower(to_hex(seq)), 16, '0')) AS aad FROM wal")
def aad_build(spark, d):
    return hexed(fx.wal(spark, d).select("seq", crypto.data_aad(F.lit("vol"), F.col("block"), F.col("seq")).alias("aad")), "aad")


@query("meta_aad", "SELECT o_orderkey AS id, concat(sha256('vol'), '636f6e666967', lpad(lower(to_hex(o_orderkey)), 16, '0')) AS aad FROM orders")
def meta_aad(spark, d):
    return hexed(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), crypto.meta_aad(F.lit("vol"), F.lit("config"), F.col("o_orderkey")).alias("aad")), "aad")


@query("seal_blocks")
def seal_blocks(spark, d):
    return hexed(_sealed(spark, d).select("seq", "block", "sealed"), "sealed")


@query("open_blocks", f"WITH {WAL} SELECT seq, {DATA} AS data FROM wal")
def open_blocks(spark, d):
    data = crypto.unseal(F.col("sealed"), F.lit(KEY).cast("binary"), F.col("iv"), F.col("aad"))
    return hexed(_sealed(spark, d).select("seq", data.alias("data")), "data")


@query("tamper_audit", f"WITH {WAL} SELECT seq, seq % 5 <> 0 AS sound FROM wal")
def tamper_audit(spark, d):
    """Every fifth block is presented as another block's."""
    r = _sealed(spark, d)
    aad = F.when(F.col("seq") % 5 == 0, crypto.data_aad(F.lit("vol"), F.col("block") + 1, F.col("seq"))).otherwise(F.col("aad"))
    return r.select("seq", crypto.try_unseal(F.col("sealed"), F.lit(KEY).cast("binary"), F.col("iv"), aad).isNotNull().alias("sound"))


@query("meta_mac")
def meta_mac(spark, d):
    n = fx.table(spark, d, "nation")
    seq = F.col("n_nationkey").cast("long")
    tag = crypto.mac(F.col("n_name"), F.lit(KEY).cast("binary"), crypto.nonce(seq, F.unhex(F.lit("01020304")), 2), crypto.meta_aad(F.lit("vol"), F.lit("config"), seq))
    return hexed(n.select("n_nationkey", tag.alias("tag")), "tag")


@query("nonce_unique", f"WITH {WAL} SELECT lpad(to_hex(seq), 14, '0') AS nonce, count(*) AS n FROM wal GROUP BY seq HAVING count(*) > 1")
def nonce_unique(spark, d):
    iv = F.hex(crypto.nonce(F.col("seq"), F.unhex(F.lit("01020304")), 1)).alias("nonce")
    return fx.wal(spark, d).groupBy(iv).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# ---- files and partial writes ---------------------------------------------------------------


@query("fs_file_to_chunks", f"WITH {FILES}, {EXT}, fb AS (SELECT path, start_block + i AS block, i FROM files JOIN (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) s ON i < nb) SELECT fb.path, {B('fb.i')} AS i, fb.block, bm.object_id, bm.object_offset FROM fb JOIN bm ON fb.block = bm.block")
def fs_file_to_chunks(spark, d):
    f = fx.files(spark, d).where("nb > 0")
    fb = f.select("path", F.posexplode(F.sequence(F.col("start_block"), F.col("start_block") + F.col("nb") - 1)).alias("i", "block")).withColumn("i", F.col("i").cast("long"))
    return extents.lookup(fb, fx.extents(spark, d), fx.BLOCK)


@query("fs_digest_check", "SELECT doc_id, sha256(text) AS digest FROM documents")
def fs_digest_check(spark, d):
    """Cut each file into blocks, put it together again, hash it; a file is a bounded group."""
    t = fx.table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("c"))
    n = F.ceil(F.length("c") / fx.BLOCK).cast("int")
    parts = t.select("doc_id", F.posexplode_outer(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)), lambda i: F.substring(F.col("c"), i * fx.BLOCK + 1, F.lit(fx.BLOCK)))).alias("slot", "data"))
    return chunks.assemble(parts.withColumn("data", F.coalesce("data", F.lit(b"").cast("binary"))), ["doc_id"]).select("doc_id", F.sha2("body", 256).alias("digest"))


@query("rmw_overlay", f"WITH {WAL}, w AS (SELECT block, seq, seq % 8 AS place, lpad(lower(to_hex(seq % 256)), 2, '0') AS byte FROM wal), top AS (SELECT block, place, max(seq) AS seq FROM w GROUP BY block, place), v AS (SELECT w.block, w.place, w.byte FROM w JOIN top ON w.block = top.block AND w.place = top.place AND w.seq = top.seq) SELECT block, string_agg(coalesce(byte, '00'), '' ORDER BY a) AS data FROM (SELECT b.block, s.a, v.byte FROM (SELECT DISTINCT block FROM w) b CROSS JOIN (SELECT unnest(range(8)) AS a) s LEFT JOIN v ON v.block = b.block AND v.place = s.a) z GROUP BY block")
def rmw_overlay(spark, d):
    """Partial writes of one byte, spliced in seq order into zeros.

    Of writes to one place only the last matters, so each block folds at most its own size.
    """
    w = fx.wal(spark, d).select("block", "seq", (F.col("seq") % 8).alias("at"))
    last = w.groupBy("block", "at").agg(F.max("seq").alias("seq"))
    patch = F.struct("seq", (F.col("at") + 1).cast("int").alias("at"), codec.be(F.col("seq") % 256, 1).alias("patch"))
    zeros = F.unhex(F.lit("00" * 8))
    fold = F.aggregate(F.array_sort(F.collect_list(patch)), zeros, lambda acc, x: F.overlay(acc, x["patch"], x["at"], F.lit(1)))
    return hexed(last.groupBy("block").agg(fold.alias("data")), "data")


@query("lru_hit_sim", "WITH a AS (SELECT event_id AS t, user_id AS block, user_id & 3 AS shard FROM events), p AS (SELECT *, max(t) OVER (PARTITION BY block ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM a) SELECT t, block, before_ IS NOT NULL AND (SELECT count(DISTINCT x.block) FROM a x WHERE x.shard = p.shard AND x.t > p.before_ AND x.t < p.t) < 8 AS hit FROM p")
def lru_hit_sim(spark, d):
    """Hit or miss of every access to four caches of 8 blocks: a fold over each cache's accesses in order."""
    from collections import OrderedDict

    import pyarrow as pa

    def simulate(batches):
        caches: dict[int, OrderedDict] = {}
        for batch in batches:
            hits = []
            for block, shard in zip(batch["block"].to_pylist(), batch["shard"].to_pylist(), strict=True):
                cache = caches.setdefault(shard, OrderedDict())
                hits.append(block in cache)
                cache[block] = None
                cache.move_to_end(block)
                if len(cache) > 8:
                    cache.popitem(last=False)
            yield pa.RecordBatch.from_arrays([batch["t"], batch["block"], pa.array(hits, pa.bool_())], ["t", "block", "hit"])

    a = fx.table(spark, d, "events").select(F.col("event_id").alias("t"), F.col("user_id").alias("block"), F.col("user_id").bitwiseAND(F.lit(3)).alias("shard"))
    return a.repartition("shard").sortWithinPartitions("shard", "t").mapInArrow(simulate, "t long, block long, hit boolean")
