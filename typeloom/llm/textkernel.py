"""Vectorised words, word hashes, shingles and sentences over Arrow string columns.

All functions take whole texts; null texts count as empty. A word is a maximal run of bytes
other than space and \\x09-\\x0D. Hash temporaries are built over at most SEGMENT bytes at a
time, so a very long text costs memory for its words only.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SEGMENT, SLICE = 1 << 19, 1 << 20
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_ODD = _rng.integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: 1: ASCII letters and digits, 2: ASCII punctuation but the apostrophe, 0: all else.
_KIND = np.array([1 if chr(i).isalnum() else 2 if 32 < i < 127 and i != 39 else 0 for i in range(128)] + [0] * 128, np.uint8)
_powers: list[np.ndarray] = []
#: Leading bytes in UTF-8 of kana and ideographs, and leading pairs of Thai, Lao, Myanmar and Khmer.
_GLYPH = np.zeros(256, bool)
_GLYPH[[*range(0xE3, 0xEA), 0xF0]] = True
_GLYPH_PAIR = np.zeros((2, 256), bool)
_GLYPH_PAIR[0, 0xB8:0xBC] = _GLYPH_PAIR[1, 0x80:0x83] = _GLYPH_PAIR[1, 0x9E:0xA0] = True


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over a partition, whose freed memory goes back to the system at its end: workers are used again."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.util.find_library("c")
        if libc and hasattr(ctypes.CDLL(libc), "malloc_trim"):
            ctypes.CDLL(libc).malloc_trim(0)

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT)
        _powers[:] = [np.concatenate(([U(1)], np.multiply.accumulate(np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offset of each row in them (one more offset than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_binary():
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text; a longer text stands alone."""
    _, offs = text_bytes(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """starts, ends: byte positions of words in raw; first: index of each row's first word (rows + 1 entries).

    cut: words also end between an ASCII letter or digit and ASCII punctuation other than an apostrophe.
    glyphs: every character of a script written without blanks is a word.
    """

    def __init__(self, column: pa.Array, cut: bool = False, glyphs: bool = False):
        self.raw, self.offs = text_bytes(column)
        raw, n = self.raw, len(self.raw)
        space = _SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[self.offs] = True
        begins, stops = ~space, ~space
        if n:
            begins[1:] &= space[:-1] | edge[1:n]
            stops[:-1] &= space[1:] | edge[1:n]
        if cut and n:
            kind = _KIND[raw]
            split = (kind[1:] ^ kind[:-1]) == 3
            begins[1:] |= split
            stops[:-1] |= split
        if glyphs and n and raw.max() >= 0xE0:
            at = np.flatnonzero((raw & 0xC0) != 0x80)
            lead, after = raw[at], raw[np.minimum(at + 1, n - 1)]
            glyph = _GLYPH[lead] | (lead == 0xE0) & _GLYPH_PAIR[0, after] | (lead == 0xE1) & _GLYPH_PAIR[1, after]
            glyph[1:] |= glyph[:-1]  # the character after one begins a word as well
            split = at[glyph & ~space[at]]
            begins[split] = True
            split = split[split > 0] - 1
            stops[split[~space[split]]] = True
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.offs)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; lower folds A-Z."""
        table = _BYTE_LOWER if lower else _BYTE
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            at = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, at + SEGMENT, "right")))
            s, e = self.starts[i:j] - at, self.ends[i:j] - at
            power, inverse = power_tables(int(e[-1]) + 1)
            total = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(table[self.raw[at : at + e[-1]]] * power[: e[-1]], out=total[1:])
            out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _ODD[63])
            i = j
        return out


def shingles(words: Words, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of `size` words of each row, sorted, and the offset of each row in them.

    A row of fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    h = words.hashes() if hashes is None else hashes
    first, n = words.first, len(h)
    code = np.zeros(n, np.uint64)
    for k in range(size):
        code[: n - k] += h[k:] * _ODD[k] if k < n else U(0)
    code = mix(code)
    parts, offs = [], np.zeros(len(first), np.int64)
    for r in range(len(first) - 1):
        a, b = first[r], first[r + 1]
        if b - a >= size:
            got = np.unique(code[a : b - size + 1])
        elif b > a:
            got = mix((h[a:b] * _ODD[: b - a]).sum(keepdims=True) + _ODD[62:63] * U(int(b - a)))
        else:
            got = code[:0]
        parts.append(got)
        offs[r + 1] = offs[r] + len(got)
    return (np.concatenate(parts) if parts else code[:0]), offs


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's Unicode code points and the offset of each row in them."""
    raw, offs = text_bytes(column)
    whole = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return whole, before[offs]
