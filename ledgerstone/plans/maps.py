"""Queries on the log, the chunks, the extents and the lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerstone.operators import chunks, extents, gc, log, reads, snapshots
from ledgerstone.plans import fixtures as fx
from ledgerstone.plans.fixtures import BLOCK, BM, CH, D, EXT, FILES, HEADER, LAYERS, OPLOG, PER_CHUNK, REQ, WAL
from ledgerstone.plans.registry import both, query

B = lambda x: f"CAST({x} AS BIGINT)"

# ---- the log --------------------------------------------------------------------------------


@query("lww_state", f"WITH {WAL} SELECT block, max(seq) AS seq FROM wal GROUP BY block")
def lww_state(spark, d):
    return log.latest(fx.wal(spark, d), ["block"])


@query("lww_hot_overlay", f"WITH {WAL}, hot AS (SELECT block, max(seq) AS seq FROM wal WHERE gen = (SELECT max(gen) FROM wal) GROUP BY block), old AS (SELECT block, max(seq) AS seq FROM wal WHERE gen < (SELECT max(gen) FROM wal) GROUP BY block) SELECT block, coalesce(h.seq, o.seq) AS seq, h.seq IS NOT NULL AS from_first FROM hot h FULL OUTER JOIN old o USING (block)")
def lww_hot_overlay(spark, d):
    w = fx.wal(spark, d)
    top = w.agg(F.max("gen").alias("g")).first()["g"]
    return log.overlay(log.latest(w.where(F.col("gen") == top), ["block"]), log.latest(w.where(F.col("gen") < top), ["block"]), ["block"], "seq")


STATE = f"{BM}, st AS (SELECT c.block, c.seq, CASE WHEN c.seq = b.seq AND c.gen = (SELECT max(gen) FROM wal) THEN 'hot' WHEN c.seq = b.seq AND c.gen = (SELECT max(gen) FROM wal) - 1 THEN 'pending' ELSE 'persisted' END AS state FROM ch c JOIN bm b ON c.block = b.block AND c.seq = b.seq)"
both("state_counts", f"WITH {STATE} SELECT state, count(*) AS n FROM st GROUP BY state")
both("blocks_by_state", f"WITH {STATE} SELECT block, seq FROM st WHERE state = 'pending'")
both("point_read_state", f"WITH {STATE} SELECT n.block, coalesce(s.state, 'empty') AS state, coalesce(s.seq, 0) AS seq FROM (SELECT c_custkey AS block FROM customer) n LEFT JOIN st s ON n.block = s.block")
both("wal_generations", f"WITH {WAL} SELECT gen, count(*) AS writes, min(seq) AS first_seq, max(seq) AS last_seq, count(DISTINCT block) AS blocks FROM wal GROUP BY gen")
both("seq_windows", f"WITH {WAL} SELECT {B('ceil(seq/1024.0)*1024')} AS high_water, count(*) AS writes FROM wal GROUP BY {B('ceil(seq/1024.0)*1024')}")
both("counters_reconcile", f"WITH {CH} SELECT max(seq) + 1 AS next_seq, greatest(max(object_id) + 1, CAST(5 AS BIGINT)) AS next_object FROM ch")


both("flush_trigger_points", f"WITH {WAL}, r AS (SELECT gen, seq, row_number() OVER (PARTITION BY gen ORDER BY seq) * 4096 AS pending FROM wal) SELECT gen, seq, {B('pending')} AS pending FROM r WHERE pending % 262144 = 0")


@query("retire_flushed", f"WITH {WAL}, f AS (SELECT block, max(seq) AS flushed FROM wal WHERE seq % 3 = 0 GROUP BY block) SELECT w.seq, w.block FROM wal w LEFT JOIN f ON w.block = f.block WHERE f.flushed IS NULL OR w.seq > f.flushed")
def retire_flushed(spark, d):
    w = fx.wal(spark, d)
    return log.retire(w, w.where("seq % 3 = 0")).select("seq", "block")


both("shard_histogram", "SELECT CAST(user_id & 15 AS BIGINT) AS shard, count(*) AS n FROM events GROUP BY CAST(user_id & 15 AS BIGINT)")
both("state_generations", "SELECT o_custkey AS volume, o_orderkey AS save, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS state_seq FROM orders")
both("state_select", "WITH s AS (SELECT o_custkey AS volume, o_orderkey AS id, o_orderkey % 7 AS state_seq, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS is_local FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY state_seq DESC, is_local DESC, id) AS rn FROM s) SELECT volume, id, state_seq, CAST(is_local AS BIGINT) AS is_local FROM r WHERE rn = 1")
both("state_restore", "SELECT o_orderkey AS volume, CASE WHEN o_orderpriority = '1-URGENT' THEN " + B("ceil((o_orderkey+1)/1048576.0)*1048576") + " ELSE o_orderkey END AS seq FROM orders")
both("volume_size_reconcile", "SELECT c_custkey AS volume, greatest(c_custkey * 1000000, (c_custkey % 5) * 1073741824) AS size FROM customer")
both("meta_defaults", "SELECT n_nationkey AS volume, coalesce(nullif(CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END, ''), 'unnamed') AS name, coalesce(nullif(n_regionkey, 0), 9) AS tier FROM nation")

# ---- chunks and extents ---------------------------------------------------------------------


@query("chunk_pack", f"WITH {D} SELECT gen, block, seq, {B('row_number() OVER (PARTITION BY gen ORDER BY block)-1')} AS pos, {B('floor((row_number() OVER (PARTITION BY gen ORDER BY block)-1)/16.0)')} AS chunk FROM d")
def chunk_pack(spark, d):
    latest = log.latest(fx.wal(spark, d).select("gen", "block", "seq"), ["gen", "block"])
    return chunks.pack(latest, ["gen"], PER_CHUNK, BLOCK, HEADER).select("gen", "block", "seq", "pos", "chunk")


@query("chunk_ids", f"WITH {CH} SELECT seq, block, gen, object_id, object_offset FROM ch")
def chunk_ids(spark, d):
    return fx.packed(spark, d)


both("runs_in_chunk", f"WITH {CH}, i AS (SELECT *, block - row_number() OVER (PARTITION BY object_id ORDER BY block) AS g FROM ch) SELECT object_id, min(block) AS start_block, count(*) AS num_blocks FROM i GROUP BY object_id, g")


@query("extents_coalesce", f"WITH {EXT} SELECT start_block, num_blocks, object_id, object_offset FROM ext")
def extents_coalesce(spark, d):
    return fx.extents(spark, d)


@query("extents_scan", f"WITH {EXT} SELECT start_block, num_blocks, object_id, object_offset FROM ext ORDER BY start_block")
def extents_scan(spark, d):
    return fx.extents(spark, d).orderBy("start_block")


@query("extent_count", f"WITH {EXT} SELECT count(*) AS extents FROM ext")
def extent_count(spark, d):
    return fx.extents(spark, d).agg(F.count(F.lit(1)).alias("extents"))


@query("block_count", f"WITH {EXT} SELECT {B('sum(num_blocks)')} AS blocks FROM ext")
def block_count(spark, d):
    return fx.extents(spark, d).agg(F.sum("num_blocks").alias("blocks"))


CUTS = "cuts AS (SELECT DISTINCT l_partkey * 8 AS lo, l_partkey * 8 + 3 AS hi FROM lineitem WHERE l_partkey % 5 = 0)"


@query("extents_fracture", f"WITH {BM}, {CUTS}, x AS (SELECT * FROM bm WHERE NOT EXISTS (SELECT 1 FROM cuts WHERE bm.block >= lo AND bm.block < hi)), y AS (SELECT *, block - row_number() OVER (PARTITION BY object_id ORDER BY block) AS g1, block-CAST(floor((object_offset-10)/4096.0) AS BIGINT) AS g2 FROM x) SELECT min(block) AS start_block, count(*) AS num_blocks, object_id, min(object_offset) AS object_offset FROM y GROUP BY object_id, g1, g2")
def extents_fracture(spark, d):
    part = F.col("l_partkey")
    writes = fx.table(spark, d, "lineitem").where(part % 5 == 0).select((part * 8).alias("lo"), (part * 8 + 3).alias("hi")).distinct()
    return extents.fracture(fx.extents(spark, d), writes, BLOCK)


@query("extent_delete_block", f"WITH {BM}, x AS (SELECT * FROM bm WHERE block % 10 <> 3), y AS (SELECT *, block - row_number() OVER (PARTITION BY object_id ORDER BY block) AS g1, block-CAST(floor((object_offset-10)/4096.0) AS BIGINT) AS g2 FROM x) SELECT min(block) AS start_block, count(*) AS num_blocks, object_id, min(object_offset) AS object_offset FROM y GROUP BY object_id, g1, g2")
def extent_delete_block(spark, d):
    return extents.coalesce(extents.expand(fx.extents(spark, d), BLOCK).where("block % 10 <> 3"), BLOCK, HEADER)


@query("extent_point_lookup", f"WITH {BM} SELECT o_orderkey AS probe, bm.block, object_id, object_offset FROM orders JOIN bm ON o_custkey = bm.block")
def extent_point_lookup(spark, d):
    probes = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("probe"), F.col("o_custkey").alias("block"))
    return extents.lookup(probes, fx.extents(spark, d), BLOCK)


@query("extent_overlaps", f"WITH {EXT}, r AS (SELECT o_orderkey AS req, o_custkey AS lo, o_custkey + 1 + o_orderkey % 40 AS hi FROM orders) SELECT req, lo, hi, start_block, num_blocks, object_id, object_offset FROM r JOIN ext ON start_block < hi AND start_block + num_blocks > lo")
def extent_overlaps(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ranges = fx.table(spark, d, "orders").select(key.alias("req"), cust.alias("lo"), (cust + 1 + key % 40).alias("hi"))
    return extents.overlaps(ranges, fx.extents(spark, d))


@query("block_locate", f"WITH {BM} SELECT c_custkey AS block, seq, object_id, object_offset FROM customer JOIN bm ON c_custkey = bm.block")
def block_locate(spark, d):
    probes = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("block"))
    return extents.lookup(probes, fx.extents(spark, d), BLOCK).join(fx.blockmap(spark, d).select("block", "seq"), "block").select("block", "seq", "object_id", "object_offset")


@query("persisted_load", f"WITH {BM}, new_ AS (SELECT block, seq + CASE WHEN block % 2 = 0 THEN 0 ELSE -1 END AS seq, CAST(999 AS BIGINT) AS object_id FROM bm) SELECT b.block, CASE WHEN n.seq >= b.seq THEN n.object_id ELSE b.object_id END AS object_id, greatest(n.seq, b.seq) AS seq FROM bm b JOIN new_ n ON b.block = n.block")
def persisted_load(spark, d):
    """The single form of a load replaces a version that is equal or older."""
    b = fx.blockmap(spark, d).select("block", "seq", "object_id", F.lit(0).alias("order"))
    new = b.select("block", (F.col("seq") + F.when(F.col("block") % 2 == 0, 0).otherwise(-1)).alias("seq"), F.lit(999).cast("long").alias("object_id"), F.lit(1).alias("order"))
    best = b.unionByName(new).groupBy("block").agg(F.max_by(F.struct("object_id", "seq"), F.struct("seq", "order")).alias("x"))
    return best.select("block", "x.object_id", "x.seq")


@query("read_entry_run", f"WITH {BM}, hot AS (SELECT block, max(seq) AS seq FROM wal WHERE seq > 900 GROUP BY block), r AS (SELECT c_custkey AS block FROM customer) SELECT r.block, coalesce(h.seq, b.seq) AS seq, CASE WHEN h.seq IS NOT NULL THEN 'overlay' WHEN b.seq IS NOT NULL THEN 'persisted' ELSE 'empty' END AS source FROM r LEFT JOIN hot h ON r.block = h.block LEFT JOIN bm b ON r.block = b.block")
def read_entry_run(spark, d):
    run = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("block"))
    hot = log.latest(fx.wal(spark, d).where("seq > 900"), ["block"]).withColumnRenamed("seq", "h")
    kept = fx.blockmap(spark, d).select("block", F.col("seq").alias("p"))
    source = F.when(F.col("h").isNotNull(), "overlay").when(F.col("p").isNotNull(), "persisted").otherwise("empty")
    return run.join(hot, "block", "left").join(kept, "block", "left").select("block", F.coalesce("h", "p").alias("seq"), source.alias("source"))


# ---- requests -------------------------------------------------------------------------------

SPAN = f"{REQ}, span AS (SELECT req, off, len, {B('floor(off/4096.0)')} AS first_block, {B('floor((off+len-1)/4096.0)')} AS last_block FROM req), steps AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation), blk AS (SELECT req, off, len, first_block + i AS block FROM span JOIN steps ON first_block + i <= last_block)"


@query("req_to_blocks", f"WITH {SPAN} SELECT req, off, len, block FROM blk")
def req_to_blocks(spark, d):
    return reads.to_blocks(fx.requests(spark, d), BLOCK)


@query("req_block_slices", f"WITH {SPAN} SELECT req, block, {B('greatest(off-block*4096, 0)')} AS lo, {B('least(off+len-block*4096, 4096)')} AS hi, (greatest(off-block*4096, 0) > 0 OR least(off+len-block*4096, 4096) < 4096) AS partial FROM blk")
def req_block_slices(spark, d):
    return reads.slices(fx.requests(spark, d), BLOCK)


@query("req_log_replay", f"WITH {SPAN}, k AS (SELECT *, CASE WHEN req % 3 = 0 THEN 'write' ELSE 'read' END AS op FROM blk) SELECT block, count(*) AS touches, {B('''sum(CASE WHEN op = 'write' THEN 1 ELSE 0 END)''')} AS writes, max(CASE WHEN op = 'write' THEN req END) AS last_write FROM k GROUP BY block")
def req_log_replay(spark, d):
    k = reads.to_blocks(fx.requests(spark, d), BLOCK).withColumn("w", F.col("req") % 3 == 0)
    return k.groupBy("block").agg(F.count(F.lit(1)).alias("touches"), F.count_if("w").alias("writes"), F.max(F.when(F.col("w"), F.col("req"))).alias("last_write"))


@query("read_plan", f"WITH {BM}, r AS (SELECT o_orderkey AS req, o_custkey + i AS block FROM orders JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) s ON i <= o_orderkey % 20), l AS (SELECT r.req, r.block, object_id, object_offset FROM r JOIN bm ON r.block = bm.block), y AS (SELECT *, block - row_number() OVER (PARTITION BY req, object_id ORDER BY block) AS g1, block-CAST(floor((object_offset-10)/4096.0) AS BIGINT) AS g2 FROM l) SELECT req, object_id, min(block) AS first_block, count(*) AS num_blocks, min(object_offset) AS object_offset FROM y GROUP BY req, object_id, g1, g2")
def read_plan(spark, d):
    key = F.col("o_orderkey")
    r = fx.table(spark, d, "orders").select(key.alias("req"), F.explode(F.sequence(F.col("o_custkey"), F.col("o_custkey") + key % 20)).alias("block"))
    return reads.plan(extents.lookup(r, fx.extents(spark, d), BLOCK), BLOCK)


# ---- snapshots ------------------------------------------------------------------------------


@query("snap_freeze", f"WITH {WAL} SELECT block, max(seq) AS seq FROM wal WHERE seq <= 500 GROUP BY block")
def snap_freeze(spark, d):
    return snapshots.freeze(fx.wal(spark, d), 500)


@query("snap_diff", f"WITH {WAL}, a AS (SELECT block, max(seq) AS old_seq FROM wal WHERE seq <= 500 GROUP BY block), b AS (SELECT block, max(seq) AS new_seq FROM wal GROUP BY block) SELECT block, old_seq, new_seq FROM a FULL OUTER JOIN b USING (block) WHERE old_seq IS DISTINCT FROM new_seq")
def snap_diff(spark, d):
    """Derived, not in the reference."""
    w = fx.wal(spark, d)
    return snapshots.diff(snapshots.freeze(w, 500), log.latest(w, ["block"]))


@query("flat_layers", f"WITH {LAYERS} SELECT depth, block FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY depth) AS rn FROM lay) x WHERE rn = 1")
def flat_layers(spark, d):
    return snapshots.flatten(fx.layers(spark, d)).select("depth", "block")


both("lineage_closure", f"WITH RECURSIVE up AS (SELECT CAST(24 AS BIGINT) AS volume, CAST(0 AS BIGINT) AS depth UNION ALL SELECT {B('floor((volume-1)/2.0)')} AS volume, depth + 1 AS depth FROM up WHERE volume > 0) SELECT volume, depth, n_name AS name FROM up JOIN nation ON n_nationkey = volume")

# ---- garbage --------------------------------------------------------------------------------


@query("chunk_refcounts", f"WITH {EXT} SELECT object_id, count(*) AS refs FROM ext GROUP BY object_id")
def chunk_refcounts(spark, d):
    return gc.refcounts(fx.extents(spark, d))


GC = f"{EXT}, bounds AS (SELECT (SELECT max(object_id) + 1 FROM ch WHERE gen < 1) AS lo, (SELECT max(object_id) FROM ch) AS hi), cand AS (SELECT DISTINCT object_id FROM ch, bounds WHERE object_id >= lo AND object_id < hi AND object_id NOT IN (SELECT object_id FROM ext))"


def _candidates(spark, d):
    p = fx.packed(spark, d)
    at = p.agg(F.max(F.when(F.col("gen") < 1, F.col("object_id"))).alias("floor"), F.max("object_id").alias("top")).first()
    return gc.candidates(p, gc.refcounts(fx.extents(spark, d)), gc.floor(at["floor"]), at["top"] or 0)


@query("gc_candidates", f"WITH {GC} SELECT object_id FROM cand")
def gc_candidates(spark, d):
    return _candidates(spark, d)


@query("gc_apply", f"WITH {GC} SELECT seq, block, object_id FROM ch WHERE object_id NOT IN (SELECT object_id FROM cand)")
def gc_apply(spark, d):
    return gc.apply(fx.packed(spark, d), _candidates(spark, d)).select("seq", "block", "object_id")


@query("gc_floor", f"WITH {CH} SELECT max(object_id) + 1 AS floor_id FROM ch WHERE gen < 1")
def gc_floor(spark, d):
    return fx.packed(spark, d).where("gen < 1").agg((F.max("object_id") + 1).alias("floor_id"))


@query("gc_orphans", f"WITH {EXT} SELECT DISTINCT ch.object_id FROM ch WHERE object_id NOT IN (SELECT object_id FROM ext)")
def gc_orphans(spark, d):
    return gc.orphans(fx.packed(spark, d), gc.refcounts(fx.extents(spark, d)))


@query("chunk_closure", f"WITH {EXT} SELECT DISTINCT ext.object_id FROM ext WHERE object_id NOT IN (SELECT object_id FROM ch WHERE gen <> 2)")
def chunk_closure(spark, d):
    """Mapped chunks that storage does not have; the fixture loses one drain."""
    return gc.orphans(fx.extents(spark, d), fx.packed(spark, d).where("gen <> 2").select("object_id").distinct())


both("gc_safe_volumes", "SELECT c_custkey AS volume FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 10 = 0)")
both("gc_marker_moved", "WITH m AS (SELECT o_custkey AS volume, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END) AS base, max(o_orderkey) AS now_ FROM orders GROUP BY o_custkey) SELECT volume, base IS DISTINCT FROM now_ AS moved FROM m")

# ---- metrics --------------------------------------------------------------------------------

both("metric_wal_ops", f"WITH {OPLOG} SELECT event_type AS phase, outcome, count(*) AS ops FROM ops GROUP BY event_type, outcome")
both("metric_cache", f"WITH {OPLOG} SELECT volume, {B('sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END)')} AS hits, count(*) AS reads FROM ops WHERE op = 'read' GROUP BY volume")
both("cache_hits", f"WITH {WAL}, cache AS (SELECT block, seq FROM wal WHERE seq % 4 = 0), live AS (SELECT block, max(seq) AS seq FROM wal GROUP BY block) SELECT c.block, c.seq FROM cache c JOIN live l ON c.block = l.block AND c.seq = l.seq")
both("volume_dual_open", "WITH o AS (SELECT user_id AS volume, event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS step FROM events), r AS (SELECT volume, event_id, sum(step) OVER (PARTITION BY volume ORDER BY event_id) AS engines FROM o) SELECT volume, event_id, CAST(engines AS BIGINT) AS engines FROM r WHERE engines > 1")
both("backend_full_episodes", "WITH l AS (SELECT user_id AS volume, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS full_ FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY event_id) - row_number() OVER (PARTITION BY volume, full_ ORDER BY event_id) AS island FROM l) SELECT volume, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS failures FROM g WHERE full_ = 1 GROUP BY volume, island")

# ---- files ----------------------------------------------------------------------------------


@query("fs_allocate", f"WITH {FILES} SELECT path, size, nb, start_block FROM files")
def fs_allocate(spark, d):
    return fx.files(spark, d).select("path", "size", "nb", "start_block")


both("safe_casts", "SELECT c_custkey AS id, " + B("least(greatest(c_custkey*3000000000-5000000000, 0), 4294967295)") + " AS as_u32, " + B("least(greatest(c_custkey*3000000000-5000000000, -2147483648), 2147483647)") + " AS as_i32, " + B("least(greatest(c_custkey-50, 0), 65535)") + " AS as_u16 FROM customer")
