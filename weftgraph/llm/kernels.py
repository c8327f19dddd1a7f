"""Vectorised text kernels shared by the operators of this subpackage.

Every kernel works on whole Arrow string columns: the column's byte buffer is
viewed as one numpy array, words are found by a byte-class table, and hashes of
words and of word n-grams come from prefix sums of a polynomial with an odd
base (the base is invertible modulo 2**64, so any range costs two loads).  No
Python loop runs over words or characters.

A word is a maximal run of ASCII letters, digits and non-ASCII characters;
everything else separates.  Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WBASE = 0xD1342543DE82EF95
CHUNK_BYTES = 1 << 20

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[ord("0") : ord("9") + 1] = True
_IS_WORD[ord("A") : ord("Z") + 1] = True
_IS_WORD[ord("a") : ord("z") + 1] = True
_IS_WORD[128:] = True
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of base**i and base**-i modulo 2**64, at least n + 1 of each."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(12, int(n + 1).bit_length())
        with np.errstate(over="ignore"):
            inverse = pow(base, -1, 1 << 64)
            out = []
            for b in (base, inverse):
                a = np.full(size, U64(b), dtype=U64)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(31))
        h = h * U64(0x7FB5D329728EA185)
        h = h ^ (h >> U64(27))
        h = h * U64(0x81DADEF4BC2DD44D)
        return h ^ (h >> U64(33))


def prefix(codes: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of codes[i] * base**i, one longer than codes."""
    p, _ = powers(base, len(codes))
    out = np.zeros(len(codes) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(codes * p[: len(codes)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of codes[start:end] for arrays of bounds; equal ranges hash alike wherever they lie."""
    _, inv = powers(base, len(pre))
    with np.errstate(over="ignore"):
        return mix((pre[end] - pre[start]) * inv[start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls become empty ranges."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        if not pa.types.is_string(column.type):
            column = column.cast(pa.string())
        kind = np.int32
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, dtype=kind, count=column.offset + n + 1)[column.offset :].astype(np.int64) if off is not None and n else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of a column in slices of about `most` bytes, one row at least."""
    _, offsets = buffers(column)
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, column.slice(at, to - at)
        at = to


class Words:
    """The words of a slice: byte bounds, hashes, and first[d] .. first[d + 1] as the words of row d."""

    __slots__ = ("raw", "offsets", "start", "end", "hash", "first")

    def __init__(self, column: pa.Array, lower: bool = True):
        if lower:
            column = pc.utf8_lower(column)
        raw, offsets = buffers(column)
        n = len(raw)
        if n == 0:
            self.raw, self.offsets = raw, offsets
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        word = _IS_WORD[raw]
        opens = word.copy()
        opens[1:] &= ~word[:-1]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        opens[inner] = word[inner]
        closes = word.copy()
        closes[:-1] &= ~word[1:]
        closes[inner - 1] = word[inner - 1]
        self.raw, self.offsets = raw, offsets
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        pre = prefix(_BYTE_CODE[raw], _BASE)
        self.hash = span_hash(pre, self.start, self.end, _BASE)
        self.first = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def ngrams(words: Words, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, word position in the row) of every n-gram.

    A row of fewer than n words, but at least one, has a single gram made of
    all of them if `short`, else none.
    """
    counts = words.counts()
    pre = prefix(words.hash, _WBASE)
    per = np.maximum(counts - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), per)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    at = words.first[:-1][row] + pos
    h = span_hash(pre, at, at + n, _WBASE)
    if short:
        few = np.flatnonzero((counts > 0) & (counts < n))
        if len(few):
            s = words.first[few]
            h = np.concatenate([h, span_hash(pre, s, s + counts[few], _WBASE)])
            row = np.concatenate([row, few])
            pos = np.concatenate([pos, np.zeros(len(few), pos.dtype)])
            order = np.argsort(row, kind="stable")
            h, row, pos = h[order], row[order], pos[order]
    return h, row, pos


def _slide(a: np.ndarray, w: int, f) -> np.ndarray:
    """f over a[i : i + w], for the len(a) - w + 1 whole windows, by doubling."""
    have, out = 1, a
    while have < w:
        step = min(have, w - have)
        out = f(out[:-step] if step else out, out[step:])
        have += step
    return out


def winnow(h: np.ndarray, row: np.ndarray, w: int) -> np.ndarray:
    """Positions of the grams that are smallest in some window of w grams of their row.

    Rows shorter than w have one window.  Two rows that share w successive
    grams choose the same one there.
    """
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    chosen = np.zeros(n, dtype=bool)
    if n >= w:
        low = _slide(h, w, np.minimum)
        low = np.where(row[: n - w + 1] == row[w - 1 :], low, U64(0))
        pad = np.zeros(w - 1, dtype=U64)
        high = _slide(np.concatenate([pad, low, pad]), w, np.maximum)
        chosen = (high == h) & (high != 0)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    length = np.diff(np.concatenate([starts, [n]]))
    short = length < w
    if short.any():
        least = np.minimum.reduceat(h, starts)
        chosen |= np.repeat(short, length) & (h == np.repeat(least, length))
    return np.flatnonzero(chosen)


def plane(a: np.ndarray) -> bytes:
    """Bytes of an integer array, byte plane after byte plane: high planes of small values are zero runs."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() if len(a) else b""


def unplane(b: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, count=n * size).reshape(size, n).T).reshape(-1).view(dtype) if n else np.zeros(0, dtype)


def distinct(a: np.ndarray) -> np.ndarray:
    """The sorted distinct values; many times as fast as a unique by hashing."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def expand(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for every count c, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
