"""Op 1: near-duplicate documents by one-permutation MinHash.

A document's distinct word shingles are hashed once; the top bits of a hash name its bin and a
bin keeps its smallest value.  Empty bins are filled by optimal densification: bin i probes
bins h(i, 1), h(i, 2), ... and copies the first that is not empty.  Bands of bins are buckets,
and a bucket proposes a star, each member with its smallest one, never all its pairs.

Proposed links are confirmed on the full shingle sets.  What a star can miss, two similar members
of a bucket that are both unlike its centre, is made good: where a bucket's members still lie in more than one component, their signatures
are compared in blocks: first to propose each member's likeliest partner in another component,
then to find the families whose members no signature rules out, and inside a family all pairs
of different components are compared on their full sets, in blocks.  No bucket is capped, a
bucket whose star holds costs one link a member, and only joining links become rows.

Documents with equal shingle sets are one node from the start.  Components of more than LOCAL
links are found by alternating large-star and small-star steps over written tables, and those of
fewer, or of what the steps leave once it is fewer, in one task: the steps are a dozen exchanges
a round, whatever the size, and their plans and threads stay in the driver for a while.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm.blocks import U, Rolling, chunks, mix, tidy, word_hashes, words
from ledgerstone.llm.common import cut, drop, width
from ledgerstone.llm.repeats import NO_ID

BINS, ROWS = 128, 4
BLOCK = 512  # members of a bucket that are compared in one group
SIGMAS = 4.5  # standard errors below the threshold at which a signature rules a link out
SET_BITS = U((1 << 48) - 1)


def shingles(column, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, row of each distinct shingle, its hash), sorted by row and hash."""
    for a, b, buf, offs in chunks(column):
        start, end, counts = words(buf, offs)
        base = np.cumsum(counts) - counts
        roll = Rolling(word_hashes(buf, start, end, lower=True))
        n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        row = np.repeat(np.arange(b - a), n)
        at = base[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        h = roll.of(at, at + np.minimum(counts[row], k))
        o = np.lexsort((h, row))
        row, h = row[o], h[o]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        yield a, b, row[new], h[new]


def signatures(row: np.ndarray, h: np.ndarray, docs: int, bins: int = BINS) -> np.ndarray:
    """One-permutation signatures, densified; a row without shingles stays 0."""
    shift = U(64 - int(bins).bit_length() + 1)
    bin_ = (h >> shift).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (row[1:] != row[:-1]) | (bin_[1:] != bin_[:-1])
    sig, full = np.zeros((docs, bins), U), np.zeros((docs, bins), bool)
    sig[row[first], bin_[first]] = h[first]
    full[row[first], bin_[first]] = True
    d, i = np.nonzero(~full & full.any(1)[:, None])
    t = 0
    while len(d) and t < 256:
        t += 1
        j = (mix(i.astype(U) * U(0x9E3779B97F4A7C15) + U(t)) % U(bins)).astype(np.int64)
        hit = full[d, j]
        sig[d[hit], i[hit]] = sig[d[hit], j[hit]]
        d, i = d[~hit], i[~hit]
    step = np.zeros(len(d), np.int64)
    todo = np.arange(len(d))
    while len(todo):  # next to nothing is left: walk to the right
        step[todo] += 1
        todo = todo[~full[d[todo], (i[todo] + step[todo]) % bins]]
    sig[d, i] = sig[d, (i + step) % bins]
    return sig


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A bucket number for each band of each document."""
    parts = sig.reshape(len(sig), -1, rows)
    out = np.broadcast_to(mix(np.arange(parts.shape[1], dtype=U) + U(1)), parts.shape[:2]).copy()
    for r in range(rows):
        out = mix(out * U(0x9FB21C651E98DF25) + parts[:, :, r])
    return out


def _pack(h: np.ndarray) -> bytes:
    h = np.unique(h & SET_BITS)
    return h.astype(np.uint32).tobytes() + (h >> U(32)).astype(np.uint16).tobytes()


def _unpack(blob) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, np.uint32, n).astype(U) | np.frombuffer(blob, np.uint16, n, 4 * n).astype(U) << U(32)


def _sketch(docs: DataFrame, k: int) -> DataFrame:
    """(key, n, h1, h2, bands, mins): the set's size, 128 bits of hash of the set, its buckets, a byte of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, h in shingles(batch["text"], k):
                n = np.bincount(row, minlength=b - a)
                at = np.cumsum(n) - n
                sums = [np.append(0, np.cumsum(mix(h ^ U(s)))).astype(U) for s in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]
                h1, h2 = (x[at + n] - x[at] for x in sums)
                sig = signatures(row, h, b - a)
                buckets = bands(sig)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * buckets.shape[1]), pa.array(buckets.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["key"].slice(a, b - a), pa.array(n, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists, pa.array([x.tobytes() for x in mix(sig).astype(np.uint8)], pa.binary())], ["key", "n", "h1", "h2", "bands", "mins"])

    return docs.mapInArrow(run, "key long, n long, h1 long, h2 long, bands array<bigint>, mins binary")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, h in shingles(batch["text"], k):
                at = np.searchsorted(row, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch["key"].slice(a, b - a), pa.array([_pack(h[at[i] : at[i + 1]]) for i in range(b - a)], pa.binary())], ["key", "grams"])

    return docs.mapInArrow(run, "key long, grams binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last, left = None, None
            for x, y in zip(batch["ga"], batch["gb"], strict=True):
                x, y = x.as_buffer(), y.as_buffer()
                n, m = x.size // 6, y.size // 6
                if 100 * min(n, m) < percent * max(n, m):
                    keep.append(False)
                    continue
                if last is None or not last.equals(x):
                    last, left = x, _unpack(x)
                right = _unpack(y)
                at = np.searchsorted(left, right)
                common = int((left[np.minimum(at, n - 1)] == right).sum()) if n else 0
                keep.append(100 * common >= percent * (n + m - common))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep, pa.bool_())), batch["b"].filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    right = pairs.join(sets.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")
    both = right.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a")
    return both.select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long")


def _grouped(dealt: DataFrame, keys: tuple[str, str, str], handle) -> DataFrame:
    """handle(table) -> [(a, b), ...] for each group of rows of equal keys; rows must be dealt and sorted by them.

    Groups are taken from the stream of batches one after another, so memory follows the largest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def settle(table: pa.Table, last: bool):
            ids = [table[c].to_numpy() for c in keys]
            new = np.ones(len(table), bool)
            new[1:] = (ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1]) | (ids[2][1:] != ids[2][:-1])
            edge = np.append(np.flatnonzero(new), len(table))
            if not last:
                edge = edge[:-1]
            out = [p for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if y - x > 1 for p in handle(table.slice(x, y - x))]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"]), table.slice(int(edge[-1]) if len(edge) else 0)

        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None or not len(rest) else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if len(table):
                out, rest = settle(table.combine_chunks(), False)
                del table, batch
                tidy()
                yield out
        if rest is not None and len(rest):
            yield settle(rest.combine_chunks(), True)[0]

    return dealt.mapInArrow(run, "a long, b long")


def _dealt(members: DataFrame, group: str, size: str, block: int, rows: list[str]) -> DataFrame:
    """Members of a group in blocks of some `block` rows, each pair of blocks a group (group, i, j) of its own."""
    cell = members.withColumn("blocks", F.ceil(F.col(size) / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cell = cell.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = cell.select(group, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), *rows)
    return cell.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "key")


def _forest(ok: np.ndarray, key: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join what the symmetric relation joins: each row with the smallest it reaches."""
    root = np.arange(len(ok))
    while True:
        low = np.minimum(np.where(ok, root, len(ok)).min(1), root)
        low = low[low]
        if (low == root).all():
            break
        root = low
    return [(min(key[x], key[r]), max(key[x], key[r])) for x, r in enumerate(root.tolist()) if x != r and key[x] != key[r]]


def _alike(left: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, b) of a bucket's members, of different components, whose signatures do not rule a link out.

    best: of those only the likeliest partner of each member; else as many as join the same
    members, not all pairs.
    """

    def handle(table: pa.Table) -> list[tuple[int, int]]:
        key, n, part = (table[c].to_numpy() for c in ("key", "n", "component"))
        mins = np.frombuffer(b"".join(table["mins"].to_pylist()), np.uint8).reshape(len(table), -1)
        t, ok, likeliest = percent / 100, np.zeros((len(key), len(key)), bool), np.zeros(len(key), np.int64)
        for lo in range(0, len(key), 128):  # some rows at a time: the comparison takes 16 bytes a pair
            r = slice(lo, lo + 128)
            same = np.zeros((len(key[r]), len(key)), np.int16)
            for k in range(0, mins.shape[1], 16):
                same += (mins[r, None, k : k + 16] == mins[None, :, k : k + 16]).sum(2, dtype=np.int16)
            small, large = np.minimum(n[r, None], n), np.maximum(n[r, None], n)
            samples = BINS * (1 - np.exp(-small / BINS))  # bins that have a shingle of their own
            ok[r] = (100 * small >= percent * large) & (part[r, None] != part) & (same / BINS >= t - SIGMAS * np.sqrt(t * (1 - t) / samples))
            likeliest[r] = np.where(ok[r], same, -1).argmax(1)
        if not best:
            return _forest(ok, key.tolist())
        key = key.tolist()
        return [(min(key[x], key[y]), max(key[x], key[y])) for x, y in enumerate(likeliest.tolist()) if ok[x, y] and key[x] != key[y]]

    return _grouped(_dealt(left, "bucket", "size", BLOCK, ["key", "n", "component", "mins"]), ("bucket", "i", "j"), handle)


def _inside(families: DataFrame, percent: int) -> DataFrame:
    """Links that join what confirmed pairs join, all pairs of a family being compared on their full sets.

    families: family, size, key, component, grams.  Only joining links become rows.
    """

    def handle(table: pa.Table) -> list[tuple[int, int]]:
        key, part = table["key"].to_numpy(), table["component"].to_numpy()
        sets = [_unpack(x) for x in table["grams"].to_pylist()]
        n = np.array([len(x) for x in sets])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        row = np.repeat(np.arange(len(sets)), n)
        o = np.argsort(ids, kind="stable")
        ids, row = ids[o], row[o]
        common = np.zeros((len(sets), len(sets)), np.float32)
        top = int(ids[-1]) + 1 if len(ids) else 0
        for lo in range(0, top, 4096):
            a, b = np.searchsorted(ids, [lo, lo + 4096])
            cell = np.zeros((len(sets), min(4096, top - lo)), np.float32)
            cell[row[a:b], ids[a:b] - lo] = 1
            common += cell @ cell.T
        inter = common.astype(np.int64)
        ok = (100 * inter >= percent * (n[:, None] + n - inter)) & (part[:, None] != part) & (n > 0)
        return _forest(ok, key.tolist())

    return _grouped(_dealt(families, "family", "size", BLOCK // 2, ["key", "component", "grams"]), ("family", "i", "j"), handle)


LOCAL = 1_000_000  # links that one task joins: 16 MB of keys
SALTS = 64  # groups over which the rows of a heavy node are dealt
HEAVY, MOST_HEAVY = 256, 100_000  # rows from which a node is heavy, and how many there can be


def _with_least(edges: DataFrame, rows: int, own: bool) -> DataFrame:
    """(u, v, m): each edge with the least v of its u, or u itself if that is less and `own`.

    The least is an aggregate with map-side combine.  It goes back to the edges by a join on u, in
    which a node with a great many edges is dealt over SALTS groups; such nodes have more than
    rows / MOST_HEAVY edges each, so their list is short however long the table is.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    limit = max(HEAVY, rows // MOST_HEAVY)
    heavy = F.broadcast(low.where(F.col("n") > limit).select(F.col("u").alias("heavy")))  # at most MOST_HEAVY rows
    salt = F.when(F.col("heavy").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = edges.join(heavy, F.col("u") == F.col("heavy"), "left").select("u", "v", salt.alias("salt"))
    each = F.explode(F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    m = F.least("m", "u") if own else F.col("m")
    return dealt.join(low.select("u", m.alias("m"), each.alias("salt")), ["u", "salt"]).select("u", "v", "m")


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the nodes 0 to n - 1 that each reaches over links (a, b).

    Roots hang themselves below the least neighbouring root; two rounds leave at most half of them.
    """
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _joined(links: DataFrame) -> DataFrame:
    """(u, v): each key of at most LOCAL links (u, v) with the smallest it reaches, if that is another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        u, v = (np.concatenate(x) for x in zip((none, none), *((b["u"].to_numpy(), b["v"].to_numpy()) for b in batches), strict=True))
        key, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = roots(at[: len(u)], at[len(u) :], len(key))
        moved = np.flatnonzero(root != np.arange(len(key)))
        yield pa.RecordBatch.from_arrays([pa.array(key[moved]), pa.array(key[root[moved]])], ["u", "v"])

    return links.coalesce(1).mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(key, component): the smallest key reachable over links (a, b), a <> b, for keys that have a link.

    links: a written table, or a union of such; it is read more than once.
    """
    spark = links.sparkSession
    few = lambda df, n: df.coalesce(max(8, min(width(spark), n // 50_000)))  # noqa: E731  no flood of tiny files
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    rows, seen = e.count(), None
    if rows > LOCAL:
        e = cut(e.distinct(), "links")
        rows = e.count()
    while rows > LOCAL:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * rows, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _with_least(large, 2 * rows, False).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = cut(few(small, rows), "links")
        drop(e)
        e = after
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        rows = now["n"]
        if now == seen:  # a whole round changed nothing: all are stars
            break
        seen = now
    else:
        after = cut(_joined(e), "links")
        drop(e)
        e = after
    return e.select(F.col("u").alias("key"), F.col("v").alias("component"))


def _all_components(found: list[DataFrame]) -> DataFrame:
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return components(every)


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per input row.

    The default is five-word shingles and a similarity of 0.8.  A null or empty text, or one of
    blanks, has no shingles and links with nothing.  Rows of one doc_id are one document, so
    they share a component; a null doc_id is a document too, below all others.  Other columns
    are ignored; an empty table gives no rows.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    d = docs.select(key.alias("key"), "text")
    sketch = cut(_sketch(d, k), "sketch")
    real = sketch.where("n > 0")
    node = real.groupBy("h1", "h2", "n").agg(F.min("key").alias("node"))
    nodes = real.join(node.select(F.col("node").alias("key")).distinct(), "key", "left_semi")
    rows = nodes.select("key", "n", F.posexplode("bands").alias("band", "bucket")).distinct()
    hubs = rows.groupBy("bucket").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut(rows.join(hubs, "bucket"), "members")
    asked = members.select("key").distinct()
    wanted = d.join(asked, "key", "left_semi")
    if sketch.groupBy("key").count().where("count > 1").limit(1).count():
        wanted = wanted.distinct()  # only repeated rows make the shuffle of texts worth it
    sets = cut(_sets(wanted, k), "sets")

    star = members.where("key <> hub").groupBy("key").agg(F.min("hub").alias("a")).select("a", F.col("key").alias("b"))
    links = cut(_confirm(star, sets, percent), "confirmed")
    found, done = [links], [members, sets, links]
    # until links are joined into components, a member's centre and that one's own stand for them
    centre = links.select(F.col("b").alias("key"), F.col("a").alias("one"))
    two = links.select(F.col("b").alias("one"), F.col("a").alias("two"))
    label = first_label = cut(centre.join(two, "one", "left").groupBy("key").agg(F.min(F.coalesce("two", "one")).alias("component")), "label")
    joined = False

    def labelled(table: DataFrame) -> DataFrame:
        return table.join(label, "key", "left").withColumn("component", F.coalesce("component", "key"))

    for best in (True, False):
        # buckets that still hold more than one component
        now = labelled(members)
        open_ = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
        left = now.join(open_, "bucket", "left_semi").join(sketch.select("key", "mins").distinct(), "key")
        if best:  # likely partners share many bands: a quarter of them shows them
            left = left.where(F.col("band") < BINS // ROWS // 4)
        pairs = cut(_alike(left, percent, best).distinct(), "pairs")
        done.append(pairs)
        if not pairs.limit(1).count():
            continue
        if best:
            more = cut(_confirm(pairs.join(star, ["a", "b"], "left_anti"), sets, percent), "confirmed")
        else:
            family = components(pairs).withColumnRenamed("component", "family")
            family = family.unionByName(family.select(F.col("family").alias("key"), "family").distinct())
            size = family.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
            more = cut(_inside(labelled(family.join(size, "family")).join(sets, "key"), percent).distinct(), "confirmed")
        done.append(more)
        if more.limit(1).count() or (best and not joined):
            found.append(more)
            label, joined = _all_components(found), True
    if not joined:
        label = _all_components(found)
    for table in (*done, first_label):  # components are written: nothing reads these again
        drop(table)
    out = sketch.select("key", "n", "h1", "h2").join(node, ["h1", "h2", "n"], "left").join(label.select(F.col("key").alias("node"), "component"), "node", "left")
    of_row = out.select("key", "n", F.coalesce("component", "node", "key").alias("of"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    # rows of one doc_id with different sets are one document
    return of_row.select(back("key").alias("doc_id"), F.col("n").alias("n_shingles"), back("of").alias("component_id"), (F.col("key") == F.col("of")).alias("kept"))
