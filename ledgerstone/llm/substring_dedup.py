"""Op 5: substring dedup by De Bruijn compaction.

A window of `window` words is an edge between the two (window - 1)-grams it overlaps.  Edges are
dealt out by minimizer, so a run of windows with one minimizer is a path that travels as one
piece: equal runs of all documents meet in one join and are settled there.  Runs that differ but
share a minimizer go on to `compact`, which finds the nonbranching paths among their edges, takes
one decision a path, and checks it by source coordinates: all occurrences of a path must be as
long as its first one.  The last join brings the spans back to their documents.

A word is removed if a window covers it whose words also start earlier: in a smaller doc_id, or
in the same document at an earlier word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerstone.llm import repeats
from ledgerstone.llm.blocks import U, Rolling, chunks, word_hashes, words

WINDOW = 20
K = 5


def _symbols(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, counts = words(buf, offs)
    return word_hashes(buf, start, end, lower=False), counts


def compact(edge: np.ndarray, unit: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True for each edge occurrence that is not its edge's first by (doc, at).

    edge: edge hashes; occurrences of one unit stand together, in order.  Neighbours in a unit
    belong to one path if neither edge has another neighbour on that side anywhere.
    """
    if not len(edge):
        return np.zeros(0, bool)
    _, e = np.unique(edge, return_inverse=True)
    n = e.max() + 1
    joined = np.zeros(len(e), bool)
    joined[1:] = unit[1:] == unit[:-1]
    after = np.where(np.append(joined[1:], False), np.append(e[1:], 0), -1)
    before = np.where(joined, np.append(0, e[:-1]), -1)
    only = []
    for side in (after, before):
        low, high = np.full(n, n), np.full(n, -2)
        np.minimum.at(low, e, side)
        np.maximum.at(high, e, side)
        only.append(low == high)
    head = ~joined
    head[1:] |= ~(only[0][e[:-1]] & only[1][e[1:]])
    path = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    length = np.diff(np.append(first, len(e)))
    o = np.lexsort((at[first], doc[first], e[first]))
    new = np.ones(len(o), bool)
    new[1:] = e[first][o][1:] != e[first][o][:-1]
    source = o[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the path's first occurrence
    later = np.zeros(len(first), bool)
    d, a = doc[first], at[first]
    later[o] = ((d[o] > d[source]) | (a[o] > a[source])) & (length[o] == length[source])
    return later[path]


def _material(table: pa.Table, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The hashes of the segments' windows."""
    out, to = np.zeros(sizes.sum(), U), np.cumsum(sizes) - sizes
    for a, b, buf, offs in chunks(table["text"]):
        mine = np.flatnonzero((rows >= a) & (rows < b))
        if len(mine):
            sym, counts = _symbols(buf, offs)
            n = sizes[mine]
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat((np.cumsum(counts) - counts)[rows[mine] - a] + starts[mine], n) + j
            out[np.repeat(to[mine], n) + j] = Rolling(sym).windows(WINDOW)[at]
    return out.tobytes(), 8 * sizes


def _resolve(entries: list[tuple[list[np.ndarray], bytes]]) -> list[np.ndarray]:
    sizes = [x[4] for x, _ in entries]
    doc, start, size = (np.concatenate([x[i] for x, _ in entries]) for i in (2, 3, 4))
    edge = np.concatenate([np.frombuffer(more, U) for _, more in entries])
    unit = np.repeat(np.arange(len(size)), size)
    j = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
    later = compact(edge, unit, doc[unit], start[unit] + j)
    mask = np.zeros(len(size), U)
    np.bitwise_or.at(mask, unit[later], U(1) << j[later].astype(U))
    return np.split(mask, np.cumsum([len(x) for x in sizes])[:-1])


def _finish(table: pa.Table, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Table:
    n_words, n_removed, kept = [], [], []
    o = np.argsort(row, kind="stable")
    row, start, size = row[o], start[o], size[o]
    for a, b, buf, offs in chunks(table["text"]):
        s, e, counts = words(buf, offs)
        base = np.cumsum(counts) - counts
        i, j = np.searchsorted(row, [a, b])
        gone = repeats.covered(base[row[i:j] - a] + start[i:j], size[i:j] + WINDOW - 1, len(s))
        n_words += counts.tolist()
        sums = np.append(0, np.cumsum(gone))
        n_removed += (sums[base + counts] - sums[base]).tolist()
        for k in range(b - a):
            parts, lo, hi = buf[offs[k] : offs[k + 1]].tobytes().split(), base[k], base[k] + counts[k]
            if n_removed[a + k]:
                parts = [parts[x] for x in np.flatnonzero(~gone[lo:hi])]
            kept.append(repeats.sha(b" ".join(parts)))
    return pa.table([table["doc_id"].cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; one row per input row.

    A null or empty text has no words.  A null doc_id counts as smaller than all others; rows of
    one doc_id count as one document, so windows at equal starts of such rows are both kept.
    Other columns are ignored; an empty table gives no rows.
    """
    return repeats.mark(docs, _symbols, WINDOW, K, True, _resolve, _material, _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


