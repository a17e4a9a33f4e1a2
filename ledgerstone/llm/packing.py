"""Op 10: packing documents into sequences by swap-based local search.

Lengths are whole numbers from 1 to `capacity`, so the corpus is known to the packer by a
histogram of at most `capacity` rows, whatever its size; that, and nothing else, reaches the
driver.  Bins of equal content are one pattern with a multiplicity.  Best-fit decreasing gives
the first patterns, then the local search takes the emptiest bin and lets other bins exchange
one document for one, two for one, or accept a move, each step increasing the sum of squared
fills, until no step is left; steps apply to as many equal bins as possible at once.

The patterns then turn into intervals of ranks: the r-th piece of length L goes where the
interval that holds r says.  Ranks are gapless numbers per length, counted without one task
per length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm.common import cut, number_within

CAPACITY = 1024
END_ID = 2
_loaded: dict[str, tuple] = {}


def _encoders(path: str):
    """The tokenizers library's own encoder, and a faster one over the same vocabulary."""
    if path not in _loaded:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        fast = None
        spec = json.load(open(path, encoding="utf-8"))
        if spec["model"]["type"] == "BPE" and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer"):
            back = _byte_letters()
            extra = {t["content"]: t["id"] for t in spec["added_tokens"]}
            try:
                ranks = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in extra}
                fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=extra)
            except (KeyError, ValueError):
                fast = None
        _loaded[path] = slow, fast
    return _loaded[path]


# Fixed value: the split pattern of byte-level BPE of this kind.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write for bytes: printable Latin-1 as itself, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def encode(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """Token ids of each text, as the tokenizers library gives them with add_special_tokens=False.

    Below U+0250 both libraries' character classes agree (a test goes through them all), so the
    faster encoder serves such texts; any other text goes to the tokenizers library.
    """
    slow, fast = _encoders(path)
    for text in texts:
        if fast is not None and (text.isascii() or max(text) < "ɐ"):
            yield np.array(fast.encode(text, allowed_special="all"), np.uint32)
        else:
            yield np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole documents, or cuts of `capacity` with the rest first."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch["doc_id"].to_pylist(), encode([x or "" for x in batch["text"].to_pylist()], tokenizer), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k in range(len(edges) - 1):
                    a, b = edges[k], edges[k + 1]
                    for col, v in zip(out, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[tuple[int, ...], int]:
    """Patterns (descending lengths of a bin) and how many bins have each."""
    bins = _best_fit(histogram, capacity)
    return _search(bins, capacity)


def _best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing on classes: all pieces of a length are dealt to the fullest bins that take them, class by class."""
    room: dict[int, Counter] = {}  # free space -> patterns
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        spaces = sorted(room)
        at = bisect.bisect_left(spaces, length)
        while left and at < len(spaces):
            free = spaces[at]
            for pattern in sorted(room[free]):
                have, fit = room[free][pattern], free // length
                full = min(have, left // fit)  # a bin that takes one takes as many as fit: it stays the fullest that fits
                for count, times in ((fit, full), (left - full * fit if full < have else 0, 1)):
                    if count and times:
                        room[free][pattern] -= times
                        room.setdefault(free - count * length, Counter())[pattern + (length,) * count] += times
                        left -= count * times
                room[free] += Counter()
                if not left:
                    break
            if not room[free]:
                del room[free]
            at += 1
        if left:
            fit = capacity // length
            for count, times in ((fit, left // fit), (left % fit, 1)):
                if count and times:
                    room.setdefault(capacity - count * length, Counter())[(length,) * count] += times
    return sum(room.values(), Counter())


def _search(bins: Counter, capacity: int) -> dict[tuple[int, ...], int]:
    """Drain the least filled bins by moves and exchanges that increase the sum of squared fills.

    Each step applies to as many equal pairs of source and target as there are.  The search ends
    when no bin can go, or when a pass over all patterns that are not full finds no step.
    """
    fill = lambda p: sum(p)
    bins = Counter(bins)
    least = -(-sum(fill(p) * n for p, n in bins.items()) // capacity)
    changed = True
    while changed:
        changed = False
        done: set[tuple[int, ...]] = set()
        while sum(bins.values()) > least:
            source = min((p for p in bins if fill(p) < capacity and p not in done), key=lambda p: (fill(p), p), default=None)
            if source is None:
                break
            found = _improve(bins - Counter([source]), source, capacity)
            if found is None:
                done.add(source)
                continue
            changed = True
            target, new, rest = found
            times = bins[source] // 2 if target == source else min(bins[source], bins[target])
            for pattern, change in ((source, -times), (target, -times), (new, times), (rest, times)):
                bins[pattern] += change
            del bins[()]
            bins += Counter()
    return dict(bins)


def _improve(bins: Counter, rest: tuple[int, ...], capacity: int):
    """One step that fills another bin further at the cost of `rest`: (that bin, its new pattern, the new rest)."""
    swap = lambda p, out, into: tuple(sorted([*_less(p, out), *into], reverse=True))
    open_bins = sorted((p for p in bins if sum(p) < capacity), key=lambda p: (-sum(p), p))
    low = sum(rest)
    for x in rest:  # move one document
        for p in open_bins:
            if low < sum(p) + x <= capacity:
                return p, swap(p, (), (x,)), _less(rest, (x,))
    best = None
    for p in open_bins:
        free = capacity - sum(p)
        if sum(p) < low:
            continue
        for x in set(rest):  # one for one
            for y in set(p):
                if y < x <= y + free and (best is None or x - y > best[0]):
                    best = x - y, p, swap(p, (y,), (x,)), swap(rest, (x,), (y,))
        for i, x in enumerate(rest):  # two for one
            for x2 in rest[i + 1 :]:
                for y in set(p):
                    if y < x + x2 <= y + free and (best is None or x + x2 - y > best[0]):
                        best = x + x2 - y, p, swap(p, (y,), (x, x2)), swap(rest, (x, x2), (y,))
        if best and best[0] == free:
            break
    return best[1:] if best else None


def _less(pattern: tuple[int, ...], out: tuple[int, ...]) -> tuple[int, ...]:
    left = list(pattern)
    for x in out:
        left.remove(x)
    return tuple(left)


def intervals(patterns: dict[tuple[int, ...], int]) -> np.ndarray:
    """Rows (length, first rank, each bin's count, first bin, offset in the bin), in order of (length, first rank)."""
    rows, taken, first_bin = [], Counter(), 0
    for pattern, times in sorted(patterns.items()):
        offset = 0
        for length, count in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, taken[length], count, first_bin, offset))
            taken[length] += count * times
            offset += count * length
        first_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and still has its end token.  Repeated rows are packed as often as they
    come; a null doc_id stays null.  An empty table gives no rows.  Other columns are ignored.
    """
    table = cut(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots = intervals(plan(counts, capacity))
    rows = sum(counts.values())
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    ranked = number_within(table, ["length"], F.xxhash64(*order), order, "rank", rows)
    stride = 1 + (int(slots[:, 1].max()) if len(slots) else 0)
    keys = slots[:, 0] * stride + slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(keys, length * stride + np.minimum(rank, stride - 1), "right") - 1
            into = rank - slots[at, 1]
            sequence, offset = slots[at, 3] + into // slots[at, 2], slots[at, 4] + into % slots[at, 2] * length
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
