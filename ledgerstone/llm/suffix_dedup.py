"""Op 9: substring dedup over suffix arrays built by linear grouping.

Every 50-byte string is found through the suffix array of its minimizer's group: the segments
that share a minimizer are concatenated into one text, its suffixes are put in order by Lyndon
groups (`suffix_groups`), and neighbours in that order that agree on 50 bytes, compared byte by
byte, are one class.  Equal segments are pre-aggregated: they enter the suffix array as one text
that carries their smallest document, and a segment whose minimizer has no other text in the
corpus needs no array.  A minimizer with very many different segments is split by a second,
longer minimizer, so no text grows with the corpus's hottest phrase.

A byte is removed if a 50-byte string covers it that also starts in a document with a smaller
doc_id.  Matches do not cross documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm import repeats
from ledgerstone.llm.blocks import U, byte_symbols, chunks, raw, segments, tidy
from ledgerstone.llm.suffix_groups import order, order_one, ragged

WINDOW = 50
K = 24
SECOND_K = (40, 46)
CROWD = 32  # segments of a minimizer from which it is split further
IN_STEP = 2000  # symbols up to which a text is ordered in step with others
LANES, ALWAYS = 120, 300  # lanes from which a step is worth it; symbols up to which it is anyway
BATCH = 500_000


def _symbols(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return byte_symbols(buf), np.diff(offs)


def _material(table: pa.Table, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    buf, offs = raw(table["text"])
    return buf[ragged(offs[rows] + starts, sizes + WINDOW - 1)].tobytes(), sizes + WINDOW - 1


def _resolve(entries: list[tuple[list[np.ndarray], bytes]]) -> list[np.ndarray]:
    m, doc, size = (np.concatenate([x[i] for x, _ in entries]) for i in (0, 2, 4))
    data = np.frombuffer(b"".join(more for _, more in entries), np.uint8)
    off = np.cumsum(size + WINDOW - 1) - (size + WINDOW - 1)
    mask = later_windows(m, doc, size, data, off)
    tidy()
    return np.split(mask, np.cumsum([len(x[0]) for x, _ in entries])[:-1])


def later_windows(key: np.ndarray, doc: np.ndarray, size: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each segment a bit for each window that a smaller document of the same key also has."""
    mask = np.zeros(len(key), U)
    _, lane = np.unique(key, return_inverse=True)
    unit, begin, n = np.arange(len(key)), np.zeros(len(key), np.int64), size
    for k in SECOND_K:
        crowded = (np.bincount(lane) > CROWD)[lane]
        if not crowded.any():
            break
        u, b, c = unit[crowded], begin[crowded], n[crowded]
        span = c + WINDOW - 1
        text, inner, runs, second, _, _ = segments(byte_symbols(data[ragged(off[u] + b, span)]), span, WINDOW, k)
        pair = np.stack([lane[crowded][text].astype(U), second], 1)
        _, sub = np.unique(pair, axis=0, return_inverse=True)
        sub = sub.reshape(-1) + lane.max() + 1
        unit, begin, n, lane = (np.concatenate([x[~crowded], y]) for x, y in ((unit, u[text]), (begin, b[text] + inner), (n, runs), (lane, sub)))
    alone = np.bincount(lane)[lane] < 2
    # lanes of like lengths stand together, so the lanes of a batch end together
    o = np.lexsort((lane, np.bincount(lane, n + WINDOW)[lane]))
    o = o[~alone[o]]
    unit, begin, n, lane = unit[o], begin[o], n[o], lane[o]
    if not len(o):
        return mask
    new = np.ones(len(o), bool)
    new[1:] = lane[1:] != lane[:-1]
    first = np.flatnonzero(new)
    symbols = np.add.reduceat(n + WINDOW, first) + 1
    until = np.append(first[1:], len(o))
    many = np.arange(len(first), 0, -1) >= LANES  # as many lanes are left that are as long
    short = (symbols <= IN_STEP) & (many | (symbols <= ALWAYS))
    a = 0
    while a < len(first):  # batches of lanes, in order
        b = a + 1
        if short[a]:
            b = a + max(1, int(np.searchsorted(np.cumsum(np.where(short[a:], symbols[a:], 1 << 40)), BATCH, "right")))
        _settle(mask, slice(first[a], until[b - 1]), unit, begin, n, lane, doc, data, off, short[a])
        a = b
    return mask


def _settle(mask, part: slice, unit, begin, n, lane, doc, data, off, in_step: bool) -> None:
    unit, begin, n, lane = unit[part], begin[part], n[part], lane[part]
    last = np.ones(len(lane), bool)
    last[:-1] = lane[1:] != lane[:-1]
    span = n + WINDOW - 1
    width = span + 1 + last  # the bytes, a separator, and a terminator at the lane's end
    at = np.cumsum(width) - width
    text = np.zeros(int(width.sum()), np.int16)
    where = ragged(at, span)
    text[where] = data[ragged(off[unit] + begin, span)].astype(np.int16) + 2
    text[at + span] = 1
    edges = np.append(0, (at + width)[last])
    sa = order(text, edges) if in_step else order_one(text)
    owner = np.repeat(np.arange(len(unit)), width)
    inner = np.arange(len(text)) - at[owner]
    sa = sa[inner[sa] < n[owner[sa]]]  # suffixes at which a window starts
    equal = np.zeros(len(sa), bool)
    offsets = np.arange(WINDOW)
    for i in range(1, len(sa), 100_000):
        j = min(i + 100_000, len(sa))
        own = sa[i - 1 : j]
        rows = text[own[:, None] + offsets]
        equal[i:j] = (rows[1:] == rows[:-1]).all(1)
    equal[1:] &= lane[owner[sa[1:]]] == lane[owner[sa[:-1]]]
    head = np.flatnonzero(~equal)
    d = doc[unit[owner[sa]]]
    smallest = np.minimum.reduceat(d, head)[np.cumsum(~equal) - 1]
    sa = sa[d > smallest]
    w = owner[sa]
    np.bitwise_or.at(mask, unit[w], U(1) << (begin[w] + inner[sa]).astype(U))


def _finish(table: pa.Table, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Table:
    n_bytes, n_removed, n_spans, kept = [], [], [], []
    o = np.argsort(row, kind="stable")
    row, start, size = row[o], start[o], size[o]
    for a, b, buf, offs in chunks(table["text"]):
        i, j = np.searchsorted(row, [a, b])
        gone = repeats.covered(offs[row[i:j] - a] + start[i:j], size[i:j] + WINDOW - 1, len(buf))
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        heads = offs[:-1][offs[:-1] < len(buf)]
        rise[heads] = gone[heads]
        for out, flags in ((n_removed, gone), (n_spans, rise)):
            sums = np.append(0, np.cumsum(flags))
            out += (sums[offs[1:]] - sums[offs[:-1]]).tolist()
        n_bytes += np.diff(offs).tolist()
        for k in range(b - a):
            piece = buf[offs[k] : offs[k + 1]]
            kept.append(repeats.sha((piece[~gone[offs[k] : offs[k + 1]]] if n_removed[a + k] else piece).tobytes()))
    whole = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
    return pa.table([table["doc_id"].cast(pa.int64()), *whole, pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _strip(table: pa.Table, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Table:
    kept, o = [], np.argsort(row, kind="stable")
    row, start, size = row[o], start[o], size[o]
    for a, b, buf, offs in chunks(table["text"]):
        i, j = np.searchsorted(row, [a, b])
        gone = repeats.covered(offs[row[i:j] - a] + start[i:j], size[i:j] + WINDOW - 1, len(buf))
        # a character goes only whole: one that keeps a byte stays
        tail = (buf & 0xC0) == 0x80
        head = np.flatnonzero(~tail)
        if len(head):
            whole = np.logical_and.reduceat(gone, head)
            gone = np.repeat(whole, np.diff(np.append(head, len(buf))))
        kept += [buf[offs[k] : offs[k + 1]][~gone[offs[k] : offs[k + 1]]].tobytes().decode() for k in range(b - a)]
    before = table["text"].to_pylist()
    gone = [bool(x) and not y for x, y in zip(before, kept, strict=True)]
    kept = [None if x is None else y for x, y in zip(before, kept, strict=True)]
    return pa.table([table["doc_id"].cast(pa.int64()), pa.array(kept, pa.string()), pa.array(gone, pa.bool_())], ["doc_id", "text", "gone"])


def strip(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of docs with what dedup() removes cut out of their texts; doc_id must be unique.

    Texts stay UTF-8: a character of which only some bytes are repeated stays whole.  n_chars
    becomes the new length; a document that loses all its text goes, one that had none stays.
    """
    short = repeats.mark(docs, _symbols, WINDOW, K, False, _resolve, _material, _strip, "doc_id long, text string, gone boolean").where("not gone")
    rest = docs.select(F.col("doc_id").alias("rest_id"), *[c for c in columns if c not in ("doc_id", "text", "n_chars")])
    joined = short.join(rest, F.col("doc_id").eqNullSafe(F.col("rest_id")))
    return joined.withColumn("n_chars", F.length("text").cast("long")).select(columns)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per input row.

    A null or empty text has no bytes.  A null doc_id counts as smaller than all others; rows of
    one doc_id count as one document and keep what they share.  Other columns are ignored; an
    empty table gives no rows.
    """
    return repeats.mark(docs, _symbols, WINDOW, K, False, _resolve, _material, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
