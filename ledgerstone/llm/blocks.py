"""Whole Arrow batches of texts as numpy arrays: words, rolling hashes, minimizer segments.

Everything works on the bytes of the Arrow buffers, a quarter of a megabyte at a time, so that a task needs
no Python object per word and its memory follows the chunk, not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None

U = np.uint64
CHUNK = 1 << 18
BASE = U(0x9E3779B97F4A7C15)
_letters = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_lowered = _letters.copy()
_lowered[65:91] = _letters[97:123]
_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if off is not None else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def chunks(column, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of rows of about `limit` bytes together; a longer text is alone."""
    buf, offs = raw(column)
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b
    del buf, offs
    tidy()


def tidy() -> None:
    """Give freed memory back to the system: a Python worker lives on beside others after its task."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64, for i up to n."""
    if len(_powers[0]) <= n:
        inverse = pow(int(BASE), -1, 2**64)
        for k, b in enumerate((BASE, U(inverse))):
            p = np.full(n + 1, b, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][: n + 1], _powers[1][: n + 1]


class Rolling:
    """Hashes of any slices of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.up, self.down = powers(len(symbols))
        self.sums = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * self.up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def windows(self, k: int) -> np.ndarray:
        """Hash of each k consecutive symbols."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + U(k * 0xD6E8FEB86659FD93 % 2**64))


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of words of each text): maximal runs of bytes outside 0x20 and 0x09-0x0D."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    inside = ~_space[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = offs[:-1][offs[:-1] < len(buf)], offs[1:][offs[1:] > 0] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.diff(np.searchsorted(start, offs))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    return Rolling((_lowered if lower else _letters)[buf]).of(start, end)


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    return _letters[buf]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    size = 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:]) if len(v) > size else v[:0]
        size *= 2
    if size < w:
        v = np.minimum(v[: -(w - size)], v[w - size :]) if len(v) > w - size else v[:0]
    return v


def segments(symbols: np.ndarray, counts: np.ndarray, window: int, k: int, longest: int = 64):
    """Runs of consecutive windows of one text whose smallest k-gram hash is the same.

    Equal windows have equal minimizers, so they only ever need comparing inside a minimizer's
    group.  Gives (text, first window, windows, minimizer, hash of the run's symbols), positions
    counting from the text's start, runs being cut after `longest` windows, and the Rolling.
    """
    roll = Rolling(symbols)
    least = sliding_min(roll.windows(k), window - k + 1)
    base = np.cumsum(counts) - counts
    n = np.maximum(counts - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    at = base[text] + inner
    m = least[at] if len(at) else np.zeros(0, U)
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(m)))
    if len(size) and size.max() > longest:
        parts = -(-size // longest)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(np.repeat(size, parts) - nth * longest, longest)
        head = np.repeat(head, parts) + nth * longest
    begin = at[head]
    return text[head], inner[head], size, m[head], roll.of(begin, begin + size + window - 1), roll


# ---- payloads: some arrays in one binary value --------------------------------------------


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; whole numbers in the narrowest unsigned type of 1, 2, 4, 5, 6 or 8 bytes that holds them."""
    out = [np.uint8(len(arrays)).tobytes()]
    for a in arrays:
        if a.dtype == np.int64 and len(a) and a.min() < 0:
            code, body = 9, a.tobytes()
        else:
            top = int(a.max()) if len(a) else 0
            code = next(c for c in (1, 2, 4, 5, 6, 8) if top < 1 << 8 * c)
            if code in (5, 6):
                body = a.astype(np.uint32).tobytes() + (a.astype(U) >> U(32)).astype(f"u{code - 4}").tobytes()
            else:
                body = a.astype(f"u{code}").tobytes()
        out += [np.uint8(code).tobytes(), np.uint32(len(a)).tobytes(), body]
    return b"".join(out)


def load(blob: bytes) -> list[np.ndarray]:
    """The arrays of dump(), as unsigned 64-bit, or signed where one was negative."""
    out, at = [], 1
    for _ in range(blob[0]):
        code, n = blob[at], int.from_bytes(blob[at + 1 : at + 5], "little")
        at += 5
        if code == 9:
            out.append(np.frombuffer(blob, np.int64, n, at))
            at += 8 * n
        elif code in (5, 6):
            low, high = np.frombuffer(blob, np.uint32, n, at), np.frombuffer(blob, f"u{code - 4}", n, at + 4 * n)
            out.append(low.astype(U) | high.astype(U) << U(32))
            at += code * n
        else:
            out.append(np.frombuffer(blob, f"u{code}", n, at).astype(U))
            at += code * n
    return out
