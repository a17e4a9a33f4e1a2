"""Windows of texts that also start earlier elsewhere: the exchange that ops 5 and 9 share.

Texts lie in buckets by a hash of doc_id; the exchange that brings a bucket together is planned
once and reused by each pass.  A bucket's texts fall into segments, runs of windows with one
minimizer.  Pass 1 sends each distinct (minimizer, segment) of a bucket with its smallest
document to the minimizer's partition, and gets one flag back for each: equal segments are known
there by one entry a bucket, so thousands of copies, or a passage in a third of all texts, weigh
no more than one.  Segments that are first of their kind but share the minimizer with different
segments go, once, to the resolver, which finds the equal windows inside them; its answer is a
bit for each window.  The last pass marks what is covered and hashes what is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerstone.llm.blocks import U, chunks, dump, load, segments
from ledgerstone.llm.common import width

BUCKET_BYTES, MOST_BYTES, PART_BYTES, PAYLOAD_BYTES = 4 << 20, 64 << 20, 32 << 20, 512
PLACED = 1 << 14  # numbers up to which each is placed by name
KEEP, LATER, ASK = 0, 1, 2
LOW40 = U((1 << 40) - 1)
NO_ID = -(1 << 63)


def placed(spark: SparkSession, n: int) -> list[int]:
    """n distinct numbers, a multiple of the shuffle partitions, of which each partition gets as many.

    Grouping by 0..n-1 would send several to one task and none to another.
    """
    parts = width(spark)
    if n > PLACED:  # many a partition: chance deals them well
        return list(range(n))
    more = 4 * n + 64
    while True:
        at = spark.range(more).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("at")).toArrow()["at"].to_numpy()
        o = np.argsort(at, kind="stable")
        first = np.searchsorted(at[o], np.arange(parts))
        if np.bincount(at, minlength=parts).min() >= n // parts:
            return [int(o[first[i % parts] + i // parts]) for i in range(n)]
        more *= 2


def exchange(docs: DataFrame, least: int = BUCKET_BYTES) -> tuple[DataFrame, list[int]]:
    """((bucket, doc_id, text), names of the hash partitions): buckets of some megabytes, by a hash of doc_id.

    A null doc_id counts as the smallest.  Hash partitions are as many as keep PART_BYTES of text
    each, whatever the shuffle partitions.  A bucket sends one payload to each, so it grows with
    them, to MOST_BYTES at most: payloads stay above half a kilobyte and their number does not
    outgrow the data.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    base = width(spark)
    whole = lambda n: base * max(1, -(-n // base))
    parts = whole(-(-size // PART_BYTES))
    n = base * max(1, round(size / min(MOST_BYTES, max(least, PAYLOAD_BYTES * parts)) / base))
    number = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
    names = placed(spark, n)
    if n <= PLACED:
        number = F.element_at(F.lit(names), number + 1)
    return docs.select(number.cast("int").alias("bucket"), "doc_id", "text"), placed(spark, parts)


def ids_of(table: pa.Table) -> np.ndarray:
    return table["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


class Bucket:
    """A bucket's segments in a fixed order: by (partition, minimizer, content, doc, start)."""

    def __init__(self, table: pa.Table, symbols: Callable, window: int, k: int, parts: int, same_doc: bool) -> None:
        self.docs = ids_of(table)
        got: list[list[np.ndarray]] = []
        for a, _, buf, offs in chunks(table["text"]):
            sym, counts = symbols(buf, offs)
            text, start, size, m, content, roll = segments(sym, counts, window, k)
            again = _repeats_inside(roll.windows(window), (np.cumsum(counts) - counts)[text] + start, size) if same_doc else np.zeros(len(text), bool)
            got.append([text + a, start, size, m, content, again])
        row, start, size, m, content, again = (np.concatenate(x) for x in zip(*got, strict=True))
        part = ((m >> U(40)) % U(parts)).astype(np.int64)
        m, content, doc = m & LOW40, content & LOW40, self.docs[row]
        o = np.lexsort((start, doc, content, m, part))
        self.row, self.start, self.size, self.m, self.content, self.doc, self.part = (x[o] for x in (row, start, size, m, content, doc, part))
        new = np.ones(len(o), bool)
        new[1:] = (self.m[1:] != self.m[:-1]) | (self.content[1:] != self.content[:-1]) | (self.part[1:] != self.part[:-1])
        self.first = np.flatnonzero(new)  # of each entry
        self.entry = np.cumsum(new) - 1  # of each segment
        self.again = again[o][self.first]
        self.edges = np.searchsorted(self.part[self.first], np.arange(parts + 1))

    def flags(self, table: pa.Table, number: dict[int, int]) -> np.ndarray:
        """Flag of each entry, from the replies' rows of kind 0; number: partition of each name."""
        out = np.zeros(len(self.first), np.int64)
        for kind, p, blob in zip(table["kind"].to_pylist(), table["p"].to_pylist(), table["payload"].to_pylist(), strict=True):
            if kind == 0:
                p = number[p]
                out[self.edges[p] : self.edges[p + 1]] = load(blob)[0]
        out[(out == KEEP) & self.again] = ASK
        return out


def _repeats_inside(windows: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """True for segments, given by their windows' places, that hold a window twice."""
    where = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
    segment = np.repeat(np.arange(len(size)), size)
    o = np.argsort(windows[where], kind="stable")
    v, g = windows[where][o], segment[o]
    twice = (v[1:] == v[:-1]) & (g[1:] == g[:-1])
    out = np.zeros(len(size), bool)
    out[g[1:][twice]] = True
    return out


def rows(p: list, bucket: list, kind: int, payload: list) -> pa.Table:
    return pa.table([pa.array(p, pa.int32()), pa.array(bucket, pa.int32()), pa.array([kind] * len(p), pa.int32()), pa.array(payload, pa.binary())], ["p", "bucket", "kind", "payload"])


SCHEMA = "p int, bucket int, kind int, payload binary"


def mark(docs: DataFrame, symbols: Callable, window: int, k: int, same_doc: bool, resolve: Callable, material: Callable, finish: Callable, schema: str) -> DataFrame:
    """One row per text, by finish(table, spans) of each bucket.

    symbols(bytes, offsets) gives 64-bit symbols and their number in each text.  Windows compare
    by (doc_id, start) if same_doc, else by doc_id.  material(table, rows, starts, sizes) gives the
    resolver each segment's own data, as bytes and their numbers, and resolve(entries) a mask of the windows that come later.
    """
    base, names = exchange(docs)
    parts, number = len(names), {name: i for i, name in enumerate(names)}

    def ask(table: pa.Table) -> pa.Table:
        b = Bucket(table, symbols, window, k, parts, same_doc)
        bucket, out = table["bucket"][0].as_py(), []
        f = b.first
        known, which = np.unique(b.doc[f], return_inverse=True)
        used = [p for p in range(parts) if b.edges[p + 1] > b.edges[p]]
        for p in used:
            s = slice(b.edges[p], b.edges[p + 1])
            local, nth = np.unique(which[s], return_inverse=True)
            out.append(dump(known[local], nth, b.m[f[s]], b.content[f[s]]))
        return rows([names[p] for p in used], [bucket] * len(used), 0, out)

    def answer(table: pa.Table) -> pa.Table:
        p, buckets = table["p"][0].as_py(), table["bucket"].to_pylist()
        got = []
        for blob in table["payload"].to_pylist():
            known, nth, m, content = load(blob)
            got.append((known.astype(np.int64)[nth.astype(np.int64)], m, content))
        doc, m, content = (np.concatenate(x) for x in zip(*got, strict=True))
        o = np.lexsort((doc, content, m))
        d, g, c = doc[o], m[o], content[o]
        new_m = np.ones(len(o), bool)
        new_m[1:] = g[1:] != g[:-1]
        new_c = new_m.copy()
        new_c[1:] |= c[1:] != c[:-1]
        head, at_m = np.flatnonzero(new_c), np.cumsum(new_m) - 1
        first_doc = d[head][np.cumsum(new_c) - 1]
        many = np.bincount(at_m[head]) > 1
        if not same_doc:  # contents of a single document have nothing to compare with
            edge = np.flatnonzero(new_m)
            many &= np.minimum.reduceat(d, edge) < np.maximum.reduceat(d, edge)
        flag = np.empty(len(o), np.int64)
        flag[o] = np.where(d > first_doc, LATER, np.where(many[at_m], ASK, KEEP))
        ends = np.cumsum([len(x[0]) for x in got])
        return rows([p] * len(buckets), buckets, 0, [dump(x) for x in np.split(flag, ends[:-1])])

    def show(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table) or not len(replies):
            return rows([], [], 1, [])
        b = Bucket(table, symbols, window, k, parts, same_doc)
        bucket, out, used = table["bucket"][0].as_py(), [], []
        e = np.flatnonzero(b.flags(replies, number) == ASK)  # in order of p
        f = b.first[e]
        data, lengths = material(table, b.row[f], b.start[f], b.size[f])
        cuts, upto = np.searchsorted(e, b.edges), np.append(0, np.cumsum(lengths))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            g = f[cuts[p] : cuts[p + 1]]
            used.append(p)
            out.append(dump(b.m[g], b.content[g], b.doc[g], b.start[g], b.size[g]) + data[upto[cuts[p]] : upto[cuts[p + 1]]])
        return rows([names[p] for p in used], [bucket] * len(used), 1, out)

    def settle(table: pa.Table) -> pa.Table:
        p, buckets = table["p"][0].as_py(), table["bucket"].to_pylist()
        masks = resolve([_split(x) for x in table["payload"].to_pylist()])
        return rows([p] * len(buckets), buckets, 1, [dump(x) for x in masks])

    def end(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return finish(table, *(np.zeros(0, np.int64),) * 3)
        b = Bucket(table, symbols, window, k, parts, same_doc)
        flags = b.flags(replies, number)
        mine = b.start[b.first[b.entry]] < b.start if same_doc else np.zeros(len(b.row), bool)
        later = (flags[b.entry] == LATER) | (b.doc > b.doc[b.first[b.entry]]) | mine
        span = [(b.row[later], b.start[later], b.size[later])]
        for kind, p, blob in zip(replies["kind"].to_pylist(), replies["p"].to_pylist(), replies["payload"].to_pylist(), strict=True):
            if kind == 1:
                p = number[p]
                e = b.edges[p] + np.flatnonzero(flags[b.edges[p] : b.edges[p + 1]] == ASK)
                mask = load(blob)[0]
                hit = mask != 0
                e, mask = e[hit], mask[hit]
                # every segment of the entry's own document, at its first start if starts count
                left = b.first[e]
                right = np.append(b.first, len(b.row))[e + 1]
                n = right - left
                seg = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                mask = np.repeat(mask, n)
                own = (b.doc[seg] == np.repeat(b.doc[left], n)) & ((b.start[seg] == np.repeat(b.start[left], n)) | (not same_doc))
                seg, mask = seg[own], mask[own]
                bit = np.arange(64, dtype=np.uint64)
                i, j = np.nonzero((mask[:, None] >> bit) & U(1))
                span.append((b.row[seg][i], b.start[seg][i] + j, np.ones(len(i), np.int64)))
        return finish(table, *(np.concatenate(x) for x in zip(*span, strict=True)))

    by = base.groupBy("bucket")
    replies = by.applyInArrow(ask, SCHEMA).groupBy("p").applyInArrow(answer, SCHEMA)
    asked = by.cogroup(replies.groupBy("bucket")).applyInArrow(show, SCHEMA)
    settled = asked.groupBy("p").applyInArrow(settle, SCHEMA)
    return by.cogroup(replies.unionByName(settled).groupBy("bucket")).applyInArrow(end, schema)


def _split(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    """The five arrays of a payload of show(), and the material after them."""
    head = load(blob)
    at = 1
    for _ in range(5):
        code, n = blob[at], int.from_bytes(blob[at + 1 : at + 5], "little")
        at += 5 + (8 if code == 9 else code) * n
    return [head[0], head[1], *(x.astype(np.int64) for x in head[2:])], blob[at:]


def covered(starts: np.ndarray, sizes: np.ndarray, total: int) -> np.ndarray:
    """True where one of the ranges lies."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes, -1)
    return np.cumsum(edge[:-1]) > 0


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
