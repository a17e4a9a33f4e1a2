"""Queries on objects in storage, states, pressure, snapshots, file tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.functions import codec, crypto, keys
from ledgerstone.functions.numbers import div
from ledgerstone.operators import chunks, extents, log, reads, simplefs, snapshots, states
from ledgerstone.plans import fixtures as fx
from ledgerstone.plans import formats
from ledgerstone.plans.fixtures import BM, CH, D, EXT, WAL
from ledgerstone.plans.formats import DATA, KEY, NOW, NTH, SMALL, hexed
from ledgerstone.plans.registry import query, run_sql
from ledgerstone.sources import blocklog
from ledgerstone.streaming import drain as stream

B = lambda x: f"CAST({x} AS BIGINT)"
MINI_UUID = "01020304"

# ---- objects in storage ---------------------------------------------------------------------

# Chunks of the fixture as objects of three volumes: a header of 10 bytes and up to 16 blocks of 16 bytes.
OBJ = f"""{D}, po AS (SELECT gen, block, seq, row_number() OVER (PARTITION BY gen ORDER BY block)-1 AS pos FROM d),
body AS (SELECT gen, gen * 1000 + pos // 16 AS id, string_agg({DATA}, '' ORDER BY block) AS body FROM po GROUP BY gen, gen * 1000 + pos // 16),
obj AS (SELECT concat('vol-', CAST(gen % 3 AS VARCHAR), '/chunks/chunk.', lpad(CAST(id AS VARCHAR), 8, '0'), '.bin') AS key, concat('56424348000100000010', body) AS hex FROM body)"""


def _objects(spark, d) -> DataFrame:
    best = log.latest_row(formats.records(spark, d), ["gen", "block"])
    slots = chunks.pack(best, ["gen"], fx.PER_CHUNK, SMALL, codec.CHUNK_HEADER).withColumnRenamed("pos", "slot")
    body = chunks.assemble(slots, ["gen", "chunk"])
    key = keys.key(F.lit("chunk"), F.concat(F.lit("vol-"), (F.col("gen") % 3).cast("string")), F.col("gen") * 1000 + F.col("chunk"))
    return body.select(key.alias("key"), F.concat(codec.chunk_header(SMALL), "body").alias("content"))


def _stored(spark, df: DataFrame) -> DataFrame:
    """Rows (key, content) written as objects, and what storage then holds."""
    root = f"{stream.scratch(spark)}/objects"
    blocklog.write(df, root)
    return blocklog.keyed(spark, root)


@query("list_objects", f"WITH {OBJ} SELECT key, {B('length(hex) / 2')} AS length FROM obj")
def list_objects(spark, d):
    return _stored(spark, _objects(spark, d)).select("key", "length")


@query("list_prefixes", f"WITH {OBJ} SELECT DISTINCT split_part(key, '/', 1) AS prefix FROM obj")
def list_prefixes(spark, d):
    return _stored(spark, _objects(spark, d)).select("prefix").distinct()


@query("object_write", f"WITH {OBJ} SELECT key, sha256(unhex(hex)) AS digest FROM obj")
def object_write(spark, d):
    """What was written is what is read, byte by byte."""
    return _stored(spark, _objects(spark, d)).select("key", F.sha2("content", 256).alias("digest"))


RANGE = f"{OBJ}, rg AS (SELECT key, hex, length(hex) // 2 AS size, 4 * CAST(right(split_part(key, '.', 2), 2) AS BIGINT) AS off FROM obj)"


def _ranged(spark, d) -> DataFrame:
    o = _stored(spark, _objects(spark, d))
    return o.withColumn("off", 4 * F.substring(F.substring_index(F.substring_index("key", ".", -2), ".", 1), -2, 2).cast("long"))


@query("src_ranged_read", f"WITH {RANGE} SELECT key, off, substr(hex, CAST(1 + 2 * off AS INT), 100) AS data FROM rg")
def src_ranged_read(spark, d):
    """Fifty bytes of each object from a place of its own; an object may end before."""
    o = _ranged(spark, d)
    return hexed(o.select("key", "off", blocklog.ranged(F.col("content"), F.col("off").cast("int"), F.lit(50)).alias("data")), "data")


@query("src_short_read_check", f"WITH {RANGE} SELECT key, size - least(off, size) < 50 AS short FROM rg")
def src_short_read_check(spark, d):
    return _ranged(spark, d).select("key", blocklog.short_read(F.col("content"), F.col("off").cast("int"), F.lit(50)).alias("short"))


@query("wal_sink", f"WITH {WAL} SELECT 'vol-' || CAST(gen % 3 AS VARCHAR) AS volume, gen, CAST(block % 16 AS BIGINT) AS shard, count(*) AS records, max(seq) AS last_seq FROM wal GROUP BY ALL")
def wal_sink(spark, d):
    """Sharded logs written under their keys, found again by them, and read strictly."""
    w = formats.encoded(spark, d)
    volume = F.concat(F.lit("vol-"), (F.col("gen") % 3).cast("string"))
    o = _stored(spark, w.select(keys.key(F.lit("wal_shard"), volume, keys.pack_shard(F.col("gen"), F.col("shard"))).alias("key"), "content"))
    r = codec.decode_wal(o, SMALL, ["key"], strict=True)
    number = lambda n: F.regexp_extract("key", r"wal\.(\d+)\.shard_(\d+)", n).cast("long")
    return r.groupBy(F.substring_index("key", "/", 1).alias("volume"), number(1).alias("gen"), number(2).alias("shard")).agg(F.count(F.lit(1)).alias("records"), F.max("seq").alias("last_seq"))


@query("ckpt_sink", f"WITH {EXT} SELECT start_block, num_blocks, object_id, object_offset FROM ext")
def ckpt_sink(spark, d):
    """Checkpoints of runs of blocks, written as objects and read strictly."""
    e = fx.extents(spark, d)
    rec = codec.map_record(F.col("start_block"), F.col("object_id"), F.col("object_offset"), F.lit(1), F.col("num_blocks"))
    parts = chunks.assemble(e.select(div(F.col("object_id"), 64).alias("part"), F.struct("object_id", "start_block").alias("slot"), rec.alias("data")), ["part"])
    content = F.concat(codec.map_header(F.lit(NOW)), "body")
    o = _stored(spark, parts.select(keys.key(F.lit("checkpoint"), F.lit("vol"), F.col("part")).alias("key"), content.alias("content")))
    return codec.decode_map(o, []).select(F.col("block").alias("start_block"), "num_blocks", "object_id", "object_offset")


@query("key_format", "SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'v/config.json' WHEN 1 THEN concat('v/chunks/chunk.', lpad(CAST(p_partkey AS VARCHAR), 8, '0'), '.bin') WHEN 2 THEN concat('v/checkpoints/blocks.', lpad(CAST(p_partkey AS VARCHAR), 8, '0'), '.bin') WHEN 3 THEN concat('v/wal/chunks/wal.', lpad(CAST(p_partkey AS VARCHAR), 8, '0'), '.bin') WHEN 4 THEN concat('v/wal/blocks/blocks.', lpad(CAST(p_partkey AS VARCHAR), 8, '0'), '.bin') WHEN 5 THEN concat('v/wal/chunks/wal.', lpad(CAST(p_partkey // 256 AS VARCHAR), 8, '0'), '.shard_', CASE WHEN p_partkey % 256 < 10 THEN '0' ELSE '' END, CAST(p_partkey % 256 AS VARCHAR), '.bin') WHEN 6 THEN 'v/checkpoints/blocks.live.bin' WHEN 7 THEN 'v/snapshots.marker' ELSE concat('v/unknown.', lpad(CAST(p_partkey AS VARCHAR), 8, '0'), '.bin') END AS key FROM part")
def key_format(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in keys.KINDS]), (F.col("p_partkey") % 9 + 1).cast("int"))
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), keys.key(kind, F.lit("v"), F.col("p_partkey")).alias("key"))


@query("volume_id", "SELECT c_custkey AS id, concat('vol-', substring(sha256(concat('vol-', c_name, '-', lower(c_mktsegment), '-', CAST(1700000000 + c_custkey AS VARCHAR))), 1, 17)) AS volume_id FROM customer")
def volume_id(spark, d):
    return fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), crypto.volume_id("vol", F.col("c_name"), F.lower("c_mktsegment"), F.col("c_custkey") + NOW).alias("volume_id"))


# ---- damaged and sealed logs ----------------------------------------------------------------

FAULTS = ["short header", "before encryption", "bad magic", "bad version", "bad block size"]
FAULTY = f"{WAL}, f AS (SELECT gen, CAST(block % 16 AS BIGINT) AS shard, CASE (gen + block % 16) % 7 WHEN 0 THEN 'short header' WHEN 1 THEN 'bad magic' WHEN 2 THEN 'bad version' WHEN 3 THEN 'bad block size' END AS fault, count(*) AS n FROM wal GROUP BY ALL)"


def _bad_headers(spark, d) -> DataFrame:
    """Logs whose header is cut, strange, of another version or of another block size, some of each."""
    c, k = F.col("content"), (F.col("gen") + F.col("shard")) % 7
    put = lambda at, what: F.concat(F.substring(c, 1, at), codec.raw(what), F.expr(f"substring(content, {at + len(what) + 1})"))
    bad = F.when(k == 0, F.substring(c, 1, 11)).when(k == 1, put(0, b"XXXX")).when(k == 2, put(4, b"\0\x63")).when(k == 3, put(6, b"\0\0\x10\0")).otherwise(c)
    return formats.encoded(spark, d).withColumn("content", bad)


@query("wal_header_audit", f"WITH {FAULTY} SELECT gen, shard, fault FROM f")
def wal_header_audit(spark, d):
    return _bad_headers(spark, d).select("gen", "shard", codec.wal_fault(F.col("content"), SMALL).alias("fault"))


@query("wal_header_skip", f"WITH {FAULTY} SELECT gen, shard, n AS records FROM f WHERE fault IS NULL")
def wal_header_skip(spark, d):
    """A log that is refused has no records; the others keep theirs."""
    return codec.decode_wal(_bad_headers(spark, d), SMALL, ["gen", "shard"]).groupBy("gen", "shard").agg(F.count(F.lit(1)).alias("records"))


def _sealed_logs(spark, d) -> DataFrame:
    r = formats._sealed(spark, d)
    slots = r.select("gen", F.col("seq").alias("slot"), codec.sealed_record(F.col("seq"), F.col("block"), F.col("sealed")).alias("data"))
    return chunks.assemble(slots, ["gen"]).select("gen", F.concat(codec.wal_header(SMALL, F.lit(NOW), sealed=True), "body").alias("content"))


@query("wal_sealed_roundtrip", f"WITH {WAL} SELECT gen, seq, block, {DATA} AS data FROM wal")
def wal_sealed_roundtrip(spark, d):
    """Sealed logs: tag in place of the checksum; opened with what the record itself says."""
    r = codec.decode_sealed_wal(_sealed_logs(spark, d), SMALL, ["gen"])
    data = crypto.unseal(F.col("sealed"), F.lit(KEY).cast("binary"), crypto.nonce(F.col("seq"), F.unhex(F.lit(MINI_UUID)), 1), crypto.data_aad(F.lit("vol"), F.col("block"), F.col("seq")))
    return hexed(r.select("gen", "seq", "block", data.alias("data")), "data")


@query("wal_before_encryption", f"WITH {WAL} SELECT gen, CASE WHEN gen % 2 = 0 THEN 'before encryption' END AS fault FROM wal GROUP BY gen")
def wal_before_encryption(spark, d):
    """Plain logs under a sealed runtime are told from damaged ones."""
    plain = chunks.assemble(formats.records(spark, d).select("gen", F.col("seq").alias("slot"), codec.wal_record(F.col("seq"), F.col("block"), F.col("data")).alias("data")), ["gen"])
    plain = plain.where("gen % 2 = 0").select("gen", F.concat(codec.wal_header(SMALL, F.lit(NOW)), "body").alias("content"))
    every = plain.unionByName(_sealed_logs(spark, d).where("gen % 2 = 1"))
    return every.select("gen", codec.wal_fault(F.col("content"), SMALL, sealed=True).alias("fault"))


@query("chunk_magic_check", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'ok' WHEN p_partkey % 5 = 0 THEN 'before_encryption' WHEN p_partkey % 5 = 1 THEN 'short_header' WHEN p_partkey % 5 < 4 THEN 'ok' ELSE 'unknown' END AS result FROM part")
def chunk_magic_check(spark, d):
    """The first bytes of a chunk before it is read: only an encrypted volume asks."""
    n, head = F.col("p_partkey"), F.substring("content", 1, 4)
    c = F.when(n % 5 == 0, codec.chunk_header(SMALL)).when(n % 5 == 1, codec.raw(b"VB")).when(n % 5 < 4, codec.chunk_header(SMALL, sealed=True)).otherwise(codec.raw(b"\0\0\0\0\0"))
    result = F.when(n % 2 == 0, "ok").when(F.length(head) < 4, "short_header").when(head == codec.raw(codec.CHUNK_MAGIC), "before_encryption").when(head == codec.raw(codec.CHUNK_SEALED_MAGIC), "ok").otherwise("unknown")
    return fx.table(spark, d, "part").select(n, c.alias("content")).select(n.alias("id"), result.alias("result"))


@query("wal_shard_union", " UNION ALL ".join(f"SELECT event_id + 1 AS seq, user_id AS block, CAST({s} AS BIGINT) AS shard FROM events WHERE (user_id & 15) = {s}" for s in range(16)))
def wal_shard_union(spark, d):
    """The sixteen logs of each generation, read as one."""
    return codec.decode_wal(formats.encoded(spark, d), SMALL, ["shard"]).select("seq", "block", "shard")


@query("wal_replay_strict", f"WITH {NTH} SELECT gen, count(*) AS records FROM nth WHERE gen % 2 = 0 GROUP BY gen")
def wal_replay_strict(spark, d):
    """The strict reader on the logs that the tolerant one finds sound."""
    whole = formats._damaged(spark, d).where("gen % 2 = 0")
    return codec.decode_wal(whole, SMALL, ["gen"], strict=True).groupBy("gen").agg(F.count(F.lit(1)).alias("records"))


@query("hot_state_dump", f"WITH {WAL}, h AS (SELECT gen, block, max(seq) AS seq FROM wal GROUP BY gen, block) SELECT gen, concat('[', string_agg(concat('{{\"SeqNum\":', seq, ',\"Block\":', block, '}}'), ',' ORDER BY block), ']') AS dump FROM h GROUP BY gen")
def hot_state_dump(spark, d):
    """The unflushed blocks of each generation as a JSON document."""
    h = log.latest(fx.wal(spark, d), ["gen", "block"])
    rows = F.transform(F.array_sort(F.collect_list(F.struct("block", "seq"))), lambda x: F.struct(x["seq"].alias("SeqNum"), x["block"].alias("Block")))
    return h.groupBy("gen").agg(F.to_json(rows).alias("dump"))


@query("map_merge", f"WITH {WAL} SELECT block, max(seq) AS seq, count(DISTINCT gen) AS sets FROM wal GROUP BY block")
def map_merge(spark, d):
    """The flushed sets of all generations in one map: the newest version of each block."""
    sets = log.latest(fx.wal(spark, d), ["gen", "block"])
    return sets.groupBy("block").agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("sets"))


# ---- import ---------------------------------------------------------------------------------


@query("import_nonzero_blocks", f"WITH {WAL}, img AS (SELECT seq, block, {DATA} AS data FROM wal) SELECT block, {B('floor(block/4096.0)')} AS batch, data FROM img WHERE data <> repeat('00', 16)")
def import_nonzero_blocks(spark, d):
    """The whole log as images, one a drain, split again; blocks of zeros are not imported."""
    r = formats.records(spark, d)
    image = chunks.assemble(r.select("gen", F.col("seq").alias("slot"), "data"), ["gen"])
    blocks = r.groupBy("gen").agg(F.array_sort(F.collect_list(F.struct("seq", "block"))).alias("blocks"))
    cut = F.transform(F.col("blocks"), lambda x, i: F.struct(x["block"].alias("block"), F.substring(F.col("body"), i * SMALL + 1, F.lit(SMALL)).alias("data")))
    kept = image.join(blocks, "gen").select(F.inline(cut)).where(F.col("data") != F.unhex(F.lit("00" * SMALL)))
    return hexed(kept.select("block", div(F.col("block"), 4096).alias("batch"), "data"), "data")


@query("import_progress", f"WITH {WAL}, r AS (SELECT seq, seq*100 AS part, (SELECT count(*) FROM wal) AS n FROM wal) SELECT {B('(part - part % n) / n')} AS pct, min(seq) AS first_block FROM r GROUP BY {B('(part - part % n) / n')}")
def import_progress(spark, d):
    """The first block of each whole per cent of the log's records."""
    w = fx.wal(spark, d)
    n = w.agg(F.count(F.lit(1)).cast("long").alias("n"))
    return w.crossJoin(F.broadcast(n)).select(F.expr("seq * 100 div n").alias("pct"), "seq").groupBy("pct").agg(F.min("seq").alias("first_block"))  # one row


# ---- states and counters --------------------------------------------------------------------

MOVES = "mv AS (SELECT user_id AS block, event_id AS t, CASE WHEN event_type IN ('view', 'click') THEN 'write' WHEN event_type = 'purchase' THEN 'pending' ELSE 'persist' END AS op, CASE WHEN event_type IN ('view', 'click') THEN event_id WHEN event_id % 4 = 0 THEN event_id - 300 ELSE (SELECT max(w.event_id) FROM events w WHERE w.user_id = e.user_id AND w.event_id < e.event_id AND w.event_type IN ('view', 'click')) END AS arg FROM events e)"


def _moves(spark, d) -> DataFrame:
    from pyspark.sql import Window

    e = fx.table(spark, d, "events")
    op = F.when(F.col("event_type").isin("view", "click"), "write").when(F.col("event_type") == "purchase", "pending").otherwise("persist")
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(op == "write", F.col("event_id"))).over(before)
    arg = F.when(op == "write", F.col("event_id")).when(F.col("event_id") % 4 == 0, F.col("event_id") - 300).otherwise(last)
    return e.select(F.col("user_id").alias("block"), F.col("event_id").alias("t"), op.alias("op"), arg.alias("arg"))


@query(
    "state_machine",
    f"""WITH RECURSIVE {MOVES}, n AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY t) AS i FROM mv),
s AS (SELECT block, i, t, CASE WHEN op = 'write' THEN 'hot' ELSE 'empty' END AS state, CASE WHEN op = 'write' THEN arg END AS seq, op = 'write' AS moved FROM n WHERE i = 1
UNION ALL SELECT n.block, n.i, n.t, CASE WHEN op = 'write' THEN 'hot' WHEN op = 'pending' AND s.state = 'hot' AND arg = s.seq THEN 'pending' WHEN op = 'persist' AND s.state = 'pending' AND arg = s.seq THEN 'persisted' ELSE s.state END, CASE WHEN op = 'write' THEN arg ELSE s.seq END, coalesce(op = 'write' OR (op = 'pending' AND s.state = 'hot' AND arg = s.seq) OR (op = 'persist' AND s.state = 'pending' AND arg = s.seq), false) FROM s JOIN n ON n.block = s.block AND n.i = s.i + 1)
SELECT block, t, state, seq, moved FROM s""",
)
def state_machine(spark, d):
    """Moves with the version they mean; a quarter of them mean an old one and change nothing."""
    m = states.history(_moves(spark, d))
    return m.select("block", "t", "state", "seq", F.coalesce("moved", F.lit(False)).alias("moved"))


@query("pending_bytes", "SELECT event_id AS t, user_id % 8 AS volume, CAST(sum(CASE WHEN event_type = 'purchase' THEN -8192 ELSE 4096 END) OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS BIGINT) AS pending FROM events")
def pending_bytes(spark, d):
    """The counter of each volume: writes add, what a drain stored is taken away; no drain sets it back."""
    e = fx.table(spark, d, "events").select(F.col("event_id").alias("t"), (F.col("user_id") % 8).alias("volume"), "event_type")
    step = F.when(F.col("event_type") == "purchase", -8192).otherwise(4096)
    return log.running(e, step, ["volume"], ["t"], "pending").select("t", "volume", F.col("pending").cast("long").alias("pending"))


LIMITS = "SELECT c_custkey AS volume, CASE WHEN c_custkey % 10 = 0 THEN h ELSE least(h, greatest((c_custkey * 300000) // 2, 16777216)) END AS high FROM (SELECT *, CAST(CASE WHEN c_custkey % 3 = 0 THEN 33554432 ELSE 268435456 END AS BIGINT) AS h FROM customer) x"


def _limits(spark, d) -> DataFrame:
    c = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(c.alias("volume"), states.high_mark(c % 3 == 0, F.when(c % 10 == 0, 0).otherwise(c * 300_000)).alias("high"))


@query("backpressure_limits", f"SELECT volume, high, high - high // 4 AS release FROM ({LIMITS}) l")
def backpressure_limits(spark, d):
    """The mark above which writers wait and that to which the drain must come, from an observation of each volume."""
    return _limits(spark, d).select("volume", "high", (F.col("high") - F.expr("high div 4")).alias("release"))


TRACE = "tr AS (SELECT volume, t, pending, CAST(200000 AS BIGINT) AS high FROM (SELECT user_id % 8 AS volume, event_id AS t, CAST(sum(CASE WHEN event_type = 'purchase' THEN -16000 ELSE 4096 END) OVER (PARTITION BY user_id % 8 ORDER BY event_id) + 150000 AS BIGINT) AS pending FROM events) x)"


@query("backpressure_trace", f"WITH RECURSIVE {TRACE}, n AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY t) AS i FROM tr), s AS (SELECT volume, i, t, pending > high AS waiting FROM n WHERE i = 1 UNION ALL SELECT n.volume, n.i, n.t, CASE WHEN n.pending > n.high THEN true WHEN n.pending <= n.high - n.high // 4 THEN false ELSE s.waiting END FROM s JOIN n ON n.volume = s.volume AND n.i = s.i + 1) SELECT volume, t, waiting FROM s")
def backpressure_trace(spark, d):
    e = fx.table(spark, d, "events").select((F.col("user_id") % 8).alias("volume"), F.col("event_id").alias("t"), F.when(F.col("event_type") == "purchase", -16000).otherwise(4096).alias("step"))
    trace = log.running(e, F.col("step"), ["volume"], ["t"], "sum").select("volume", "t", (F.col("sum") + 150_000).cast("long").alias("pending"), F.lit(200_000).cast("long").alias("high"))
    return states.pressure(trace).select("volume", "t", "waiting")


CODES = ["NoSuchKey", "NoSuchBucket", "NotFound", "NoSuchVersion", "ENOSPC", "SlowDown", "EIO"]
CODE = "list_value(" + ", ".join(f"'{c}'" for c in CODES) + ")"


def _code(n) -> F.Column:
    """One of CODES, or null."""
    return F.element_at(F.array(*[F.lit(c) for c in CODES], F.lit(None).cast("string")), (n % 8 + 1).cast("int"))


@query("error_classes", f"WITH c AS (SELECT event_id, {CODE}[event_id % 8 + 1] AS code FROM events) SELECT event_id, CASE WHEN code IS NULL THEN 'none' WHEN code LIKE 'No%' THEN 'not_found' WHEN code = 'ENOSPC' THEN 'no_space' ELSE 'transient' END AS class, CASE WHEN code = 'ENOSPC' THEN 'ENOSPC' WHEN code IS NOT NULL THEN 'EIO' END AS errno FROM c")
def error_classes(spark, d):
    """Codes of the backend, what they mean, and what the client is told: out of space, or an I/O error."""
    c = fx.table(spark, d, "events").select("event_id", _code(F.col("event_id")).alias("code")).withColumn("class", states.error_class(F.col("code")))
    return c.select("event_id", "class", F.when(F.col("class") == "no_space", "ENOSPC").when(F.col("class") != "none", "EIO").alias("errno"))


@query("state_load_class", f"WITH c AS (SELECT o_orderkey AS id, {CODE}[o_orderkey % 8 + 1] AS a, {CODE}[o_custkey % 8 + 1] AS b FROM orders), k AS (SELECT id, CASE WHEN a IS NULL OR a LIKE 'No%' THEN 'gone' END AS x, CASE WHEN b IS NULL OR b LIKE 'No%' THEN 'gone' END AS y FROM c) SELECT id, CASE WHEN y IS NULL THEN 'unavailable' WHEN x = 'gone' THEN 'not_found' ELSE 'no_block_size' END AS class FROM k")
def state_load_class(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), *[states.error_class(_code(F.col(c))).alias(n) for n, c in (("local", "o_orderkey"), ("backend", "o_custkey"))])
    return o.select("id", states.load_class(F.col("local"), F.col("backend")).alias("class"))


RMW = "w AS (SELECT event_id AS req, user_id AS block, event_id * 10 AS start, event_id * 10 + CAST(round(value * 2) AS BIGINT) AS stop FROM events)"


@query("rmw_conflicts", f"WITH {RMW}, l AS (SELECT *, lag(stop) OVER (PARTITION BY block & 15 ORDER BY start, req) AS held, lag(block) OVER (PARTITION BY block & 15 ORDER BY start, req) AS holder FROM w) SELECT req, block, CASE WHEN holder = block THEN 'conflict' ELSE 'collision' END AS kind FROM l WHERE held > start")
def rmw_conflicts(spark, d):
    e = fx.table(spark, d, "events")
    w = e.select(F.col("event_id").alias("req"), F.col("user_id").alias("block"), (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + F.round(F.col("value") * 2).cast("long")).alias("stop"))
    return states.conflicts(w)


IO = "io AS (SELECT event_id, user_id % 8 AS volume, CASE WHEN user_id % 2 = 0 THEN 'file' ELSE 's3' END AS backend, CASE WHEN event_type IN ('view', 'click') THEN 'read' ELSE 'write' END AS op, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS outcome, CAST(round(value * 100) AS BIGINT) AS bytes, CAST(event_id * 7919 % 100003 AS BIGINT) AS micros FROM events)"


def _io(spark, d) -> DataFrame:
    return run_sql(spark, d, f"WITH {IO} SELECT * FROM io")


@query("metric_backend_io", f"WITH {IO} SELECT op, backend, volume, outcome, count(*) AS ops, {B('sum(bytes)')} AS bytes, {B('sum(micros)')} AS micros, {B('sum(micros)')} / count(*) AS avg_micros FROM io GROUP BY op, backend, volume, outcome")
def metric_backend_io(spark, d):
    g = _io(spark, d).groupBy("op", "backend", "volume", "outcome")
    return g.agg(F.count(F.lit(1)).alias("ops"), F.sum("bytes").alias("bytes"), F.sum("micros").alias("micros"), (F.sum("micros") / F.count(F.lit(1))).alias("avg_micros"))


@query("flush_latency_pct", f"WITH {IO}, r AS (SELECT volume, micros, row_number() OVER (PARTITION BY volume ORDER BY micros, event_id) AS rn, count(*) OVER (PARTITION BY volume) AS n FROM io WHERE op = 'write') SELECT volume, min(CASE WHEN rn >= n * 0.5 THEN micros END) AS p50, min(CASE WHEN rn >= n * 0.99 THEN micros END) AS p99 FROM r GROUP BY volume")
def flush_latency_pct(spark, d):
    """Nearest-rank percentiles of how long writes took."""
    p = F.sort_array(F.collect_list("micros"))
    rank = lambda q: F.element_at("l", F.greatest(F.lit(1), F.ceil(F.size("l") * F.lit(q).cast("decimal(3,2)"))).cast("int"))
    return _io(spark, d).where("op = 'write'").groupBy("volume").agg(p.alias("l")).select("volume", rank("0.5").alias("p50"), rank("0.99").alias("p99"))


# ---- requests -------------------------------------------------------------------------------

CHECKED = "rq AS (SELECT o_orderkey AS req, o_custkey * 4096 + (o_orderkey % 8) * 512 AS off, 512 * (o_orderkey % 17) AS len, CASE WHEN o_orderkey % 3 = 0 THEN 'write' ELSE 'read' END AS op FROM orders)"


@query("req_validate", f"WITH {CHECKED} SELECT req, CASE WHEN off > 400000 THEN 'too_large' WHEN off + len > 400000 THEN 'out_of_range' WHEN len = 0 THEN 'empty' WHEN op = 'write' AND len % 4096 <> 0 THEN 'misaligned' ELSE 'ok' END AS class FROM rq")
def req_validate(spark, d):
    key = F.col("o_orderkey")
    r = fx.table(spark, d, "orders").select(key.alias("req"), (F.col("o_custkey") * fx.BLOCK + key % 8 * 512).alias("off"), (512 * (key % 17)).alias("len"), F.when(key % 3 == 0, "write").otherwise("read").alias("op"))
    return reads.validate(r, 400_000, fx.BLOCK).select("req", "class")


# Reads of 16 volumes: each goes on where the volume's last one ended, but every fifth, which jumps.
STREAMS = "rd AS (SELECT volume, req, CASE WHEN req % 5 = 0 THEN jump ELSE after END AS first_block, n AS num_blocks FROM (SELECT o_orderkey % 16 AS volume, o_orderkey // 16 AS req, o_custkey AS jump, 1 + o_orderkey % 3 AS n FROM orders) a JOIN (SELECT o_orderkey % 16 AS v2, o_orderkey // 16 + 1 AS r2, CASE WHEN (o_orderkey // 16) % 5 = 0 THEN o_custkey ELSE (o_orderkey // 16) % 150 END + 1 + o_orderkey % 3 AS after FROM orders) b ON v2 = volume AND r2 = req)"


def _streams(spark, d) -> DataFrame:
    return run_sql(spark, d, f"WITH {STREAMS.replace('//', 'div')} SELECT * FROM rd")


SEQUENTIAL = "sq AS (SELECT *, coalesce(first_block = lag(first_block + num_blocks) OVER (PARTITION BY volume ORDER BY req), false) AS sequential FROM rd)"


@query("readahead_detect", f"WITH {STREAMS}, {SEQUENTIAL} SELECT volume, req, sequential FROM sq")
def readahead_detect(spark, d):
    """One position a volume: a request that starts there goes on; the first never does."""
    return reads.sequential(_streams(spark, d), ["volume"]).select("volume", "req", "sequential")


@query("readahead_plan", f"WITH {EXT}, {STREAMS}, {SEQUENTIAL} SELECT volume, req, sequential, {B('CASE WHEN start_block IS NULL THEN 0 ELSE least(256, start_block + ext.num_blocks - sq.first_block - sq.num_blocks) END')} AS extra FROM sq LEFT JOIN ext ON sequential AND sq.first_block + sq.num_blocks - 1 >= start_block AND sq.first_block + sq.num_blocks - 1 < start_block + ext.num_blocks")
def readahead_plan(spark, d):
    """On the real map: to the end of the run in the same chunk, 256 blocks at most."""
    return reads.readahead(_streams(spark, d), fx.extents(spark, d))


# ---- snapshots ------------------------------------------------------------------------------

PLACED = "lay AS (SELECT DISTINCT CAST(event_id % 3 AS BIGINT) AS depth, concat('vol-', CAST(event_id % 3 AS VARCHAR(9))) AS volume, user_id AS block, user_id * 3 + event_id % 3 AS object_id, 10 + user_id % 16 * 4096 AS object_offset, user_id + 1 AS seq FROM events WHERE (event_id % 3 = 0 AND user_id % 4 = 0) OR (event_id % 3 = 1 AND user_id % 2 = 0) OR event_id % 3 = 2)"


def _placed(spark, d) -> DataFrame:
    """Layers of a clone: own blocks, those of its base, those of the base's base, each in its volume."""
    return run_sql(spark, d, f"WITH {PLACED} SELECT * FROM lay")


@query("cow_chain_read", f"WITH {PLACED}, n AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY depth) AS rn FROM lay) SELECT c_custkey AS block, depth, volume, object_id, object_offset, seq, depth IS NULL AS is_zero FROM customer LEFT JOIN n ON c_custkey = n.block AND rn = 1")
def cow_chain_read(spark, d):
    """Where each block of a clone lies: in its own volume, else in its base's, else further up, else nowhere."""
    blocks = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("block"))
    return snapshots.locate(blocks, _placed(spark, d)).withColumn("is_zero", F.col("depth").isNull())


@query("clone_open", f"WITH {PLACED} SELECT volume, depth, depth > 0 AS inherited, count(*) AS blocks, min(block) AS first_block, max(block) AS last_block FROM lay GROUP BY volume, depth")
def clone_open(spark, d):
    """The layers a clone is opened with, by the volume whose chunks they point into."""
    g = _placed(spark, d).groupBy("volume", "depth").agg(F.count(F.lit(1)).alias("blocks"), F.min("block").alias("first_block"), F.max("block").alias("last_block"))
    return g.withColumn("inherited", F.col("depth") > 0)


@query("flat_decode", f"WITH {PLACED}, n AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY depth) AS rn FROM lay) SELECT block % 5 AS clone, depth - 1 AS depth, volume AS name, block, object_id, object_offset, seq FROM n WHERE rn = 1 AND depth > 0")
def flat_decode(spark, d):
    """The section of inherited blocks of five clones, built and parsed: magic, sources, names, identities, records."""
    own = _placed(spark, d)
    inherited = snapshots.flatten(own).where("depth > 0").select((F.col("block") % 5).alias("volume"), (F.col("depth") - 1).alias("depth"), "block", "object_id", "object_offset", "seq")
    sources = inherited.select("volume").distinct().withColumn("depth", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(2).cast("long"))))
    sources = sources.withColumn("name", F.concat(F.lit("vol-"), (F.col("depth") + 1).cast("string"))).withColumn("uuid", F.unhex(F.lit(MINI_UUID)))
    got = codec.decode_flat(codec.flat_section(sources, inherited), ["volume"])
    return got.select(F.col("volume").alias("clone"), F.col("depth").cast("long").alias("depth"), "name", "block", "object_id", "object_offset", "seq")


@query("flat_faults", "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'too short' WHEN 1 THEN 'bad magic' WHEN 2 THEN 'truncated name length' WHEN 3 THEN 'truncated name' WHEN 4 THEN 'truncated identity' ELSE 'truncated block' END AS fault FROM part")
def flat_faults(spark, d):
    """Sections cut or altered at each of their parts."""
    n = F.col("p_partkey")
    name, tail = b"\0\3abc", b"\1\2\3\4" + bytes(32) + b"\0\0\0\1"
    cuts = [b"FLAT\1", b"FLAX\1\1" + name + tail, b"FLAT\1\1\0", b"FLAT\1\1" + name[:-1], b"FLAT\1\1" + name + tail[:-1], b"FLAT\1\1" + name + tail + bytes(33)]
    content = F.element_at(F.array(*[codec.raw(c) for c in cuts]), (n % 6 + 1).cast("int"))
    return codec.flat_layers(fx.table(spark, d, "part").select(n.alias("id"), content.alias("content"))).select("id", "fault")


SNAPS = "sn AS (SELECT concat('snap-', CAST(n_nationkey AS VARCHAR(9))) AS id, concat('snap-', CAST(CASE WHEN n_nationkey % 9 = 8 THEN 99 ELSE n_nationkey END AS VARCHAR(9))) AS declared, concat('vol-', CAST(n_regionkey AS VARCHAR(9))) AS volume FROM nation)"
ASKED = "asked AS (SELECT o_orderkey AS req, concat('vol-', CAST(o_custkey % 5 AS VARCHAR(9))) AS volume, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('snap-', CAST(o_orderkey % 30 AS VARCHAR(9))) END AS src, CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN concat('snap-', CAST(o_orderkey % 30 AS VARCHAR(9))) ELSE concat('snap-', CAST(o_custkey % 60 AS VARCHAR(9))) END AS dst FROM orders)"


@query("snap_copy_check", f"WITH {SNAPS}, {ASKED} SELECT req, src, dst, CASE WHEN src = '' OR dst = '' THEN 'empty_id' WHEN src = dst THEN 'same_id' WHEN t.id IS NOT NULL THEN 'exists' WHEN s.id IS NULL THEN 'not_found' WHEN s.declared <> src THEN 'declares_other' WHEN s.volume <> asked.volume THEN 'foreign' ELSE 'ok' END AS result FROM asked LEFT JOIN sn s ON s.id = src LEFT JOIN sn t ON t.id = dst")
def snap_copy_check(spark, d):
    """Copies asked for, checked against the snapshots there are, their declared ids and their volumes."""
    return states.copy_check(run_sql(spark, d, f"WITH {ASKED} SELECT * FROM asked"), run_sql(spark, d, f"WITH {SNAPS} SELECT * FROM sn"))


@query("snap_copy", f"WITH {WAL}, snap AS (SELECT block, max(seq) AS seq FROM wal WHERE seq <= 500 GROUP BY block), meta AS (SELECT (SELECT max(seq) FROM snap) AS state_seq) SELECT 'snap-1' AS snapshot_id, state_seq, CAST(1700000000 AS BIGINT) AS created_at, block, seq FROM snap, meta UNION ALL SELECT 'snap-2', state_seq + 1, 1700000060, block, seq FROM snap, meta")
def snap_copy(spark, d):
    """The same map under a new id, with the next state number and a time of its own."""
    snap = snapshots.freeze(fx.wal(spark, d), 500)
    top = F.broadcast(snap.agg(F.max("seq").alias("state_seq")))  # one row
    each = snap.crossJoin(top).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return each.select(F.concat(F.lit("snap-"), (F.col("copy") + 1).cast("string")).alias("snapshot_id"), (F.col("state_seq") + F.col("copy")).alias("state_seq"), (F.col("copy") * 60 + NOW).cast("long").alias("created_at"), "block", "seq")


@query("snap_block_count", f"WITH {EXT} SELECT {B('sum(num_blocks)')} AS blocks, {B('(SELECT count(*) FROM bm)')} AS expected, sum(num_blocks) = (SELECT count(*) FROM bm) AS sound FROM ext")
def snap_block_count(spark, d):
    n = fx.blockmap(spark, d).agg(F.count(F.lit(1)).alias("expected"))
    return fx.extents(spark, d).agg(F.sum("num_blocks").alias("blocks")).crossJoin(F.broadcast(n)).select("blocks", "expected", (F.col("blocks") == F.col("expected")).alias("sound"))  # one row each


@query("snap_drain_cut", f"WITH {WAL} SELECT block, max(seq) AS seq, true AS drained FROM wal WHERE gen <= 2 GROUP BY block UNION ALL SELECT block, max(seq), false FROM wal WHERE gen < 2 GROUP BY block")
def snap_drain_cut(spark, d):
    """A snapshot by drain: the owner of the log drains first and takes generation 2 in, another takes what is stored."""
    w = fx.wal(spark, d)
    both = [log.latest(w.where(F.col("gen") <= upto), ["block"]).withColumn("drained", F.lit(owns)) for upto, owns in ((2, True), (1, False))]
    return both[0].unionByName(both[1])


CHECKPOINTS = f"{CH}, lv AS (SELECT block % 8 AS volume, block, max(seq) AS seq FROM ch WHERE block % 8 IN (0, 3, 6) GROUP BY block), nm AS (SELECT block % 8 AS volume, block, max(seq) AS seq FROM ch WHERE block % 8 IN (0, 2, 4, 6) AND seq <= 500 GROUP BY block)"


@query("ckpt_select", f"WITH {CHECKPOINTS}, v AS (SELECT DISTINCT user_id % 8 AS volume FROM events), pick AS (SELECT 'live' AS source, lv.* FROM lv UNION ALL SELECT 'numbered', nm.* FROM nm WHERE volume NOT IN (SELECT volume FROM lv)) SELECT v.volume, coalesce(source, 'empty') AS source, p.block, p.seq, ch.object_id FROM v LEFT JOIN pick p ON p.volume = v.volume LEFT JOIN ch ON ch.block = p.block AND ch.seq = p.seq")
def ckpt_select(spark, d):
    """Whole checkpoints: some volumes have a live one, some only the older numbered one, some none."""
    p = fx.packed(spark, d).select((F.col("block") % 8).alias("volume"), "block", "seq", "object_id")
    live = log.latest_row(p.where(F.col("volume").isin(0, 3, 6)), ["block"])
    numbered = log.latest_row(p.where(F.col("volume").isin(0, 2, 4, 6) & (F.col("seq") <= 500)), ["block"])
    volumes = fx.table(spark, d, "events").select((F.col("user_id") % 8).alias("volume")).distinct()
    return snapshots.choose(live, numbered, volumes)


@query("meta_verify", "SELECT n_nationkey AS id, n_nationkey % 3 <> 0 AS sound, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS name FROM nation")
def meta_verify(spark, d):
    """Sealed envelopes of state: the tag is verified before the document is parsed; every third was altered."""
    n = F.col("n_nationkey").cast("long")
    doc = F.concat(F.lit('{"Name":"'), "n_name", F.lit('"}'))
    aad, iv, key = crypto.meta_aad(F.lit("vol"), F.lit("config"), n), crypto.nonce(n, F.unhex(F.lit(MINI_UUID)), 2), F.lit(KEY).cast("binary")
    shown = F.when(n % 3 == 0, F.concat(doc, F.lit(" "))).otherwise(doc)
    e = fx.table(spark, d, "nation").select(n.alias("id"), shown.alias("payload"), crypto.mac(doc, key, iv, aad).alias("tag"), crypto.nonce(n, F.unhex(F.lit(MINI_UUID)), 2).alias("iv"), aad.alias("aad"))
    e = e.withColumn("sound", crypto.mac(F.col("payload"), key, F.col("iv"), F.col("aad")) == F.col("tag"))
    return e.select(F.col("id").cast("int").alias("id"), "sound", F.when(F.col("sound"), F.get_json_object("payload", "$.Name")).alias("name"))


# ---- the map --------------------------------------------------------------------------------


@query("persisted_info", f"WITH {BM} SELECT block, object_id, object_offset, seq FROM bm")
def persisted_info(spark, d):
    return fx.blockmap(spark, d).select("block", "object_id", "object_offset", "seq")


@query("extent_expand", f"WITH {BM} SELECT block, object_id, object_offset, seq FROM bm")
def extent_expand(spark, d):
    """Each position of an extent: its block, its place in the chunk and its own version."""
    bm = fx.blockmap(spark, d)
    e = extents.with_versions(fx.extents(spark, d), bm)
    return extents.expand_versions(e, fx.BLOCK)


@query("extent_upsert", f"WITH {EXT}, n AS (SELECT start_block, 2 * num_blocks AS num_blocks, object_id + 1000 AS object_id, object_offset FROM ext WHERE start_block % 3 = 0), gone AS (SELECT start_block FROM ext WHERE start_block % 5 = 0) SELECT * FROM (SELECT * FROM n UNION ALL SELECT * FROM ext WHERE start_block % 3 <> 0) x WHERE start_block NOT IN (SELECT start_block FROM gone)")
def extent_upsert(spark, d):
    """set and remove on the index, by start block."""
    e = fx.extents(spark, d)
    new = e.where("start_block % 3 = 0").select("start_block", (F.col("num_blocks") * 2).alias("num_blocks"), (F.col("object_id") + 1000).alias("object_id"), "object_offset")
    return extents.remove(extents.put(e, new), e.where("start_block % 5 = 0"))


@query("persisted_range_load", f"WITH {BM}, r AS (SELECT block, CAST(777 AS BIGINT) AS object_id, seq - 1 AS seq FROM bm WHERE block % 20 < 7) SELECT b.block, coalesce(r.object_id, b.object_id) AS object_id, coalesce(r.seq, b.seq) AS seq FROM bm b LEFT JOIN r ON b.block = r.block")
def persisted_range_load(spark, d):
    """The range form of a load replaces whatever was there, newer or not."""
    bm = fx.blockmap(spark, d).select("block", "object_id", "seq")
    r = bm.where("block % 20 < 7").select("block", F.lit(777).cast("long").alias("object_id"), (F.col("seq") - 1).alias("seq"))
    return bm.join(r, "block", "left_anti").unionByName(r)


@query("gc_sweep_allowed", "WITH m AS (SELECT o_custkey AS volume, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END) AS base, max(o_orderkey) AS now_ FROM orders GROUP BY o_custkey), s AS (SELECT c_custkey AS volume, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 10 = 0) AS unpinned FROM customer) SELECT s.volume, unpinned AND NOT coalesce(base IS DISTINCT FROM now_, false) AS allowed FROM s LEFT JOIN m ON s.volume = m.volume")
def gc_sweep_allowed(spark, d):
    """A sweep needs both: no snapshot owned by the volume, and a marker that has not moved since it was read."""
    o = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("volume"), F.col("o_orderkey").alias("k"))
    m = o.groupBy("volume").agg(F.max(F.when(F.col("k") % 2 == 0, F.col("k"))).alias("base"), F.max("k").alias("now_"), F.max((F.col("k") % 10 == 0)).alias("pinned"))
    v = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("volume")).join(m, "volume", "left")
    moved = F.coalesce(~F.col("base").eqNullSafe(F.col("now_")), F.lit(False)) & F.col("now_").isNotNull()
    return v.select("volume", (~F.coalesce("pinned", F.lit(False)) & ~moved).alias("allowed"))


@query("wal_double_open", f"WITH {WAL}, w AS (SELECT gen, event_type AS writer, min(seq) AS opened FROM wal GROUP BY gen, event_type) SELECT gen, writer, opened, row_number() OVER (PARTITION BY gen ORDER BY opened) > 1 AS refused FROM w")
def wal_double_open(spark, d):
    """Writers that open a generation's log: the first gets it, all later ones find it not empty and are refused."""
    from pyspark.sql import Window

    w = fx.wal(spark, d).groupBy("gen", F.col("event_type").alias("writer")).agg(F.min("seq").alias("opened"))
    return w.withColumn("refused", F.row_number().over(Window.partitionBy("gen").orderBy("opened")) > 1)


# ---- the file table -------------------------------------------------------------------------


def _operations(spark, d) -> DataFrame:
    """Logs of some volumes: made, filled with files of few names, emptied, formatted once in a while."""
    e = fx.table(spark, d, "events")
    n, volume = F.col("event_id"), F.col("user_id") % 10
    first = e.select(volume.alias("volume")).distinct().select("volume", F.lit(-1).cast("long").alias("seq"), F.lit("create_volume").alias("op"), F.lit(None).cast("string").alias("path"), (F.lit(4096 * 64) + F.when(F.col("volume") == 9, 1).otherwise(0)).cast("long").alias("size"))
    op = F.when(n % 97 == 0, "format").when(F.col("event_type") == "error", "delete").otherwise("create")
    rest = e.select(volume.alias("volume"), n.alias("seq"), op.alias("op"), F.concat(F.lit("f"), (n % 13).cast("string")).alias("path"), F.round(F.col("value") * 100).cast("long").alias("size"))
    return first.unionByName(rest)


@query("fs_replay")
def fs_replay(spark, d):
    """Every operation's result; a free list depends on all before it, which no SQL states."""
    return simplefs.replay(_operations(spark, d), fx.BLOCK)


@query("fs_state")
def fs_state(spark, d):
    """Files after half of the log, saved, loaded, and the other half."""
    ops = _operations(spark, d)
    half = simplefs.save(ops.where("seq < 500"), fx.BLOCK)
    return simplefs.files(simplefs.resume(half, ops.where("seq >= 500"), fx.BLOCK))


@query("fs_create_volume", "SELECT c_custkey AS volume, CASE WHEN c_custkey * 1024 % 4096 <> 0 THEN 'bad_size' ELSE 'ok' END AS status, CASE WHEN c_custkey * 1024 % 4096 <> 0 THEN 0 ELSE c_custkey * 1024 // 4096 END AS free FROM customer")
def fs_create_volume(spark, d):
    c = F.col("c_custkey")
    ops = fx.table(spark, d, "customer").select(c.alias("volume"), F.lit(0).cast("long").alias("seq"), F.lit("create_volume").alias("op"), F.lit(None).cast("string").alias("path"), (c * 1024).alias("size"))
    return simplefs.replay(ops, fx.BLOCK).select("volume", "status", "free")


@query("fs_fill", "SELECT c_custkey AS volume, step AS seq, CASE WHEN step = 0 OR need <= have THEN 'ok' ELSE 'no_space' END AS status, CASE WHEN step = 0 THEN 40 WHEN need <= have THEN have - need ELSE have END AS free FROM (SELECT c_custkey, step, c_custkey % 30 AS need, CASE WHEN step < 2 THEN 40 ELSE 40 - c_custkey % 30 END AS have FROM customer, (SELECT unnest([0, 1, 2]) AS step) s) x")
def fs_fill(spark, d):
    """Two files of equal size on a volume of 40 blocks: the second finds room or an error."""
    c = F.col("c_custkey")
    ops = fx.table(spark, d, "customer").withColumn("seq", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    ops = ops.select(c.alias("volume"), "seq", F.when(F.col("seq") == 0, "create_volume").otherwise("create").alias("op"), F.concat(F.lit("f"), F.col("seq").cast("string")).alias("path"), F.when(F.col("seq") == 0, 40 * 4096).otherwise(c % 30 * 4096).cast("long").alias("size"))
    return simplefs.replay(ops, fx.BLOCK).select("volume", "seq", "status", "free")


# ---- streams --------------------------------------------------------------------------------


def _put(w: DataFrame, root: str, lo: int, hi: int) -> None:
    """Generations lo to hi - 1 as one more file of the stream's source."""
    w.where((F.col("gen") >= lo) & (F.col("gen") < hi)).select("gen", "seq", "block").coalesce(1).write.mode("append").parquet(f"{root}/in")


def _source(spark, root: str) -> DataFrame:
    return spark.readStream.schema("gen long, seq long, block long").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def _quarters(w: DataFrame) -> list[tuple[int, int]]:
    """Bounds of four runs of generations."""
    n = (w.agg(F.max("gen").alias("g")).first()["g"] or 0) + 1
    return [(n * k // 4, n * (k + 1) // 4) for k in range(4) if n * k // 4 < n * (k + 1) // 4]


@query("stream_drain", f"WITH {BM} SELECT block, seq, object_id, object_offset FROM bm")
def stream_drain(spark, d):
    """Half of the log arrives and is drained; the stream stops; the rest arrives and it goes on from its checkpoint."""
    w, root = fx.wal(spark, d), stream.scratch(spark)
    parts = _quarters(w)
    for half in (parts[:2], parts[2:]):
        for lo, hi in half:
            _put(w, root, lo, hi)
        if half:
            stream.drain(_source(spark, root), f"{root}/checkpoint", f"{root}/out", fx.PER_CHUNK, fx.BLOCK, fx.HEADER)
    return stream.live_map(spark, f"{root}/out")


@query("stream_lww", f"WITH {WAL} SELECT block, max(seq) AS seq FROM wal GROUP BY block")
def stream_lww(spark, d):
    w, root = fx.wal(spark, d), stream.scratch(spark)
    for lo, hi in _quarters(w):
        _put(w, root, lo, hi)
    return stream.running_latest(_source(spark, root).select("seq", "block"), f"{root}/checkpoint", f"{root}/out")


@query("stream_late_seq", f"WITH {WAL} SELECT block, max(seq) AS seq, count(*) - 1 AS late FROM wal GROUP BY block")
def stream_late_seq(spark, d):
    """The log arrives in reverse, in four batches: each block's newest version comes first and all others are late."""
    w, root = fx.wal(spark, d), stream.scratch(spark)
    for lo, hi in reversed(_quarters(w)):
        _put(w, root, lo, hi)
    taken, late = stream.late_rows(_source(spark, root).select("seq", "block"), f"{root}/checkpoint", f"{root}/out")
    late = late.groupBy("block").agg(F.count(F.lit(1)).alias("late"))
    return log.latest(taken, ["block"]).join(late, "block", "left").select("block", "seq", F.coalesce("late", F.lit(0).cast("long")).alias("late"))
