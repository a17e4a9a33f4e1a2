"""Op 8: nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The top of the tree is fitted on a bounded sample (`SAMPLE` vectors with the smallest hashes of
vec_id, or `SAMPLE_VALUES` components in all, whichever is less); every vector is then indexed
under the leaf it descends to.  A leaf of more than `GROUP` vectors is split again by k-means on a
bounded sample of its own members, level after level, so leaves keep their size and the tree
grows with the table; the lower levels are tables, not objects of the driver.  A query walks the
top with a priority queue by the distance to each node's centre and takes the leaves that come
out first; below, each level widens the nearest bins and the nearest of all open bins stay.  How
many is calibrated: up to `PROBES` queries are answered by brute force over all vectors, and the
number of visits is widened until their neighbours' leaves are reached to `TARGET`.

Equal vectors are one entry with their 11 smallest ids, which is all that a list of 10 can need;
so a vector that makes up a third of the table weighs as one.  A leaf that many queries visit
meets them in blocks, so no task holds a leaf or a list of queries of unbounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerstone.llm.common import cut, drop

SAMPLE, SAMPLE_VALUES = 20_000, 4_000_000
PROBES, TARGET = 200, 0.97
BRANCHES, LEAF = 24, 48
GROUP = 4096  # vectors or queries of a leaf in one group
SPLIT, FIT, LEVELS = 32, 2048, 7  # children of a split leaf, members (expected) they are fitted on, levels an id has room for


class Tree:
    """centres[node] for all nodes but the root 0, children[node], leaf number of each leaf node."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 7) -> None:
        self.centres: list[np.ndarray] = [sample.mean(0)]
        self.children: list[list[int]] = [[]]
        rng = np.random.default_rng(seed)
        todo = [(0, sample)]
        while todo:
            node, points = todo.pop()
            distinct = np.unique(points, axis=0) if len(points) <= 4 * leaf else points
            if len(distinct) <= leaf:
                continue
            centres, label = _kmeans(points, min(branches, -(-len(points) // leaf)), rng)
            if len(centres) < 2:
                continue
            for k, c in enumerate(centres):
                self.centres.append(c)
                self.children.append([])
                self.children[node].append(len(self.centres) - 1)
                todo.append((len(self.centres) - 1, points[label == k]))
        self.leaf_of = {n: i for i, n in enumerate(n for n, c in enumerate(self.children) if not c)}
        self.below = {n: np.stack([self.centres[c] for c in kids]) for n, kids in enumerate(self.children) if kids}

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf each row descends to."""
        node = np.zeros(len(x), np.int64)
        while True:
            open_ = [n for n in np.unique(node) if self.children[n]]
            if not open_:
                break
            for n in open_:
                mine = np.flatnonzero(node == n)
                node[mine] = np.array(self.children[n])[_squared(x[mine], self.below[n]).argmin(1)]
        names = np.full(len(self.children), -1)
        for n, i in self.leaf_of.items():
            names[n] = i
        return names[node]

    def best_first(self, q: np.ndarray, visits: int) -> list[tuple[float, int]]:
        """(squared distance, leaf) in the order a priority queue by distance gives them."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < visits:
            far, n = heapq.heappop(queue)
            if n in self.leaf_of:
                out.append((far, self.leaf_of[n]))
                continue
            for d, c in zip(((self.below[n] - q) ** 2).sum(1).tolist(), self.children[n], strict=True):
                heapq.heappush(queue, (d, c))
        return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = _squared(x, centres).argmin(1)
        n = np.bincount(label, minlength=len(centres))
        keep = n > 0
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        centres, label = sums[keep] / n[keep, None], (np.cumsum(keep) - 1)[label]
    return centres, label


def nearest(q: np.ndarray, p: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of q: its number, the k nearest rows of p and all ties with the last, exact distances."""
    for i in range(0, len(q), 256):
        rough = _squared(q[i : i + 256], p)
        slack = 1e-9 * ((q[i : i + 256] ** 2).sum(1) + (p * p).sum(1).max(initial=0))
        last = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(p) > k else np.full(len(rough), np.inf)
        for j in range(len(rough)):
            at = np.flatnonzero(rough[j] <= last[j] + slack[j])
            exact = np.sqrt(((p[at] - q[i + j]) ** 2).sum(1))
            if len(p) > k:
                keep = exact <= np.partition(exact, k - 1)[k - 1]
                at, exact = at[keep], exact[keep]
            yield i + j, at, exact


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _first(at: np.ndarray, dist: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int]]:
    """The k smallest (distance, id)."""
    return sorted((d, v) for d, a in zip(dist.tolist(), at.tolist(), strict=True) for v in ids[a])[:k]


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, embedding as double): without null ids and vectors that are null, zero or hold null or non-finite parts.

    Vectors of another length than most (the longer one on a tie) cannot be compared and take no part.
    """
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))
    top = good.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return good.where(F.size("embedding") == F.lit(top["d"] if top else 0))


def _split(points: DataFrame, level: int, group: int) -> tuple[DataFrame, DataFrame | None]:
    """(points with leaves of more than `group` rows split, (leaf, centres) of those); None if there is none.

    A leaf's members are dealt to its children in salted groups, each of which gets the centres.
    """
    size = points.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group)
    if not size.limit(1).count():
        return points, None
    mine = points.join(size, "leaf")
    draw = F.pmod(F.xxhash64(F.element_at("ids", 1), F.lit(level)), F.col("n"))

    def fit(t: pa.Table) -> pa.Table:
        x = _vectors(t["embedding"].combine_chunks())
        x = x[np.lexsort(x.T[::-1])]  # whatever order the rows came in
        centres, _ = _kmeans(x, min(SPLIT, len(x)), np.random.default_rng(level))
        return pa.table([pa.array([t["leaf"][0].as_py()], pa.int64()), pa.array([centres.tobytes()], pa.binary())], ["leaf", "centres"])

    centres = cut(mine.where(draw < FIT).select("leaf", "embedding").groupBy("leaf").applyInArrow(fit, "leaf long, centres binary"), "centres")
    salts = F.ceil(F.col("n") / group).cast("int")
    dealt = mine.withColumn("salt", F.pmod(F.xxhash64(F.element_at("ids", 1)), salts).cast("int")).select("leaf", "salt", "embedding", "ids")
    each = centres.join(size, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "centres")

    def deal(p: pa.Table, c: pa.Table) -> pa.Table:
        if not len(p) or not len(c):  # a leaf whose draw was empty stays as it is
            return p.select(["leaf", "embedding", "ids"])
        x = _vectors(p["embedding"].combine_chunks())
        child = _squared(x, np.frombuffer(c["centres"][0].as_py()).reshape(-1, x.shape[1])).argmin(1)
        return pa.table([pa.array(_child(c["leaf"][0].as_py(), level) + child), p["embedding"], p["ids"]], ["leaf", "embedding", "ids"])

    below = dealt.groupBy("leaf", "salt").cogroup(each.groupBy("leaf", "salt")).applyInArrow(deal, "leaf long, embedding array<double>, ids array<bigint>")
    rest = points.join(size, "leaf", "left_anti").select("leaf", "embedding", "ids")
    return cut(rest.unionByName(below), "leaves"), centres


def _child(leaf: int, level: int) -> int:
    """The first child's id: four bits of level, then the path from the top leaf."""
    return (level << 60) | ((leaf & (1 << 60) - 1) * SPLIT)


def _frontier(keyed: DataFrame, tree: Tree, levels: list[DataFrame], visits: int) -> DataFrame:
    """(leaf, qkey, embedding): the leaves that each query visits."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, n, d) for i, q in enumerate(_vectors(b["embedding"])) for d, n in tree.best_first(q, visits)]
            row, leaf, dist = (pa.array([x[j] for x in found], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.float64())))
            yield pa.RecordBatch.from_arrays([leaf, dist, b["qkey"].take(row), b["embedding"].take(row)], ["leaf", "dist", "qkey", "embedding"])

    schema = "leaf long, dist double, qkey long, embedding array<double>"
    open_ = keyed.mapInArrow(walk, schema)
    for level, centres in enumerate(levels, 1):

        def widen(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, leaf, dist = [], [], []
                for i, (q, n, blob) in enumerate(zip(_vectors(b["embedding"]), b["leaf"].to_pylist(), b["centres"].to_pylist(), strict=True)):
                    far = _squared(q[None], np.frombuffer(blob).reshape(-1, len(q)))[0]
                    row += [i] * len(far)
                    leaf += (_child(n, level) + np.arange(len(far))).tolist()
                    dist += far.tolist()
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(dist, pa.float64()), b["qkey"].take(at), b["embedding"].take(at)], ["leaf", "dist", "qkey", "embedding"])

        kept = open_.join(centres.select("leaf"), "leaf", "left_anti")
        below = open_.join(centres, "leaf").select("leaf", "centres", "qkey", "embedding").mapInArrow(widen, schema)
        nearest_bins = F.row_number().over(Window.partitionBy("qkey").orderBy("dist", "leaf"))
        open_ = kept.select("leaf", "dist", "qkey", "embedding").unionByName(below).withColumn("nth", nearest_bins).where(F.col("nth") <= visits).drop("nth")
    return open_.select("leaf", "qkey", "embedding")


def search(table: DataFrame, k: int = 10, every: int = 100, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is a multiple of `every`.

    Ties go to the smaller vec_id; a row is no candidate of itself, nor are rows of its own vec_id.
    Repeated (vec_id, vector) rows count once; rows of one vec_id with different vectors are each
    a query and a candidate.  Other columns are ignored; a table that is empty or has no row to
    ask for gives no rows.
    """
    spark = table.sparkSession
    good = usable(table)
    schema = "query_id long, rank int, vec_id long, score double"
    queries = good.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    keyed = queries.groupBy("embedding").agg(F.min("query_id").alias("qkey")).select("qkey", "embedding")
    probes = keyed.orderBy(F.xxhash64("qkey"), "qkey").limit(PROBES).collect()
    if not probes:
        return spark.createDataFrame([], schema)
    taken = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding")
    sample = np.array([r["embedding"] for r in taken.limit(max(k, min(SAMPLE, SAMPLE_VALUES // len(probes[0]["embedding"])))).collect()], np.float64)
    tree = Tree(sample)

    nth = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    distinct = good.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b["embedding"])
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaves(x) if len(x) else [], pa.int64()), b["embedding"], b["ids"]], ["leaf", "embedding", "ids"])

    points = cut(distinct.mapInArrow(index, "leaf long, embedding array<double>, ids array<bigint>"), "leaves")
    levels: list[DataFrame] = []
    while len(levels) < LEVELS:
        finer, centres = _split(points, len(levels) + 1, group)
        if centres is None:
            break
        drop(points)
        points = finer
        levels.append(centres)
    asked = spark.createDataFrame([(r["qkey"], r["embedding"]) for r in probes], "qkey long, embedding array<double>")
    visits = _calibrate(points, tree, levels, asked, np.array([r["embedding"] for r in probes], np.float64), [r["qkey"] for r in probes], k)

    def scan(q: pa.Table, p: pa.Table) -> pa.Table:
        keys, ids = q["qkey"].to_pylist(), p["ids"].to_pylist()
        out: list[tuple[int, float, int]] = []
        if keys and ids:
            for i, at, dist in nearest(_vectors(q["embedding"].combine_chunks()), _vectors(p["embedding"].combine_chunks()), k + 1):
                out += [(keys[i], d, v) for d, v in _first(at, dist, ids, k + 1)]
        return pa.table([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], ["qkey", "score", "vec_id"])

    # (leaf, salt, block): some vectors of a leaf and some of its queries; both are 1 but for what cannot be split and for leaves much asked for
    front = cut(_frontier(keyed, tree, levels, visits), "frontier")
    times = lambda c: F.ceil(F.col(c) / group).cast("int")
    cells = front.groupBy("leaf").agg(F.count(F.lit(1)).alias("q")).join(points.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "leaf").select("leaf", times("q").alias("blocks"), times("n").alias("salts"))
    keys = ("leaf", "salt", "block")
    one = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    mine = front.join(cells, "leaf").withColumn("block", one("qkey", "blocks")).withColumn("salt", all_of("salts")).select(*keys, "qkey", "embedding")
    theirs = points.join(cells, "leaf").withColumn("salt", one(F.element_at("ids", 1), "salts")).withColumn("block", all_of("blocks")).select(*keys, "embedding", "ids")
    found = mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(scan, "qkey long, score double, vec_id long")
    order = Window.partitionBy("qkey").orderBy("score", "vec_id")
    best = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).drop("nth")
    rows = queries.join(keyed, "embedding").select("query_id", "qkey").join(best, "qkey").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "qkey").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrate(points: DataFrame, tree: Tree, levels: list[DataFrame], asked: DataFrame, q: np.ndarray, keys: list[int], k: int) -> int:
    """The number of leaf visits that reaches TARGET of the probes' true neighbours."""

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in q]
        for b in batches:
            ids, leaf = b["ids"].to_pylist(), b["leaf"].to_pylist()
            if ids:
                for i, at, dist in nearest(q, _vectors(b["embedding"]), k + 1):
                    best[i] = sorted([*best[i], *((d, ids[a][0], leaf[a]) for d, a in zip(dist.tolist(), at.tolist(), strict=True))])[: k + 1]
        flat = [(i, *x) for i, row in enumerate(best) for x in row]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.int64()))], ["i", "d", "v", "leaf"])

    w = Window.partitionBy("i").orderBy("d", "v")
    near = points.select("leaf", "embedding", "ids").mapInArrow(truth, "i int, d double, v long, leaf long").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k + 1).collect()  # at most PROBES * (k + 1) rows
    near = [(r["i"], r["leaf"]) for r in near if r["d"] > 0]
    if not near:
        return 1
    top = lambda leaf: (leaf & (1 << 60) - 1) // SPLIT ** (leaf >> 60)
    rank = [{leaf: n for n, (_, leaf) in enumerate(tree.best_first(x, len(tree.leaf_of)))} for x in q]
    needed = sorted(rank[i][top(leaf)] + 1 for i, leaf in near)
    visits = needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))) - 1)]
    bins = len(tree.leaf_of) * SPLIT ** len(levels)
    while levels and visits < bins:
        seen = {(r["qkey"], r["leaf"]) for r in _frontier(asked, tree, levels, visits).select("qkey", "leaf").collect()}  # at most PROBES * visits rows
        if sum((keys[i], leaf) in seen for i, leaf in near) >= TARGET * len(near):
            break
        visits *= 2
    return visits
