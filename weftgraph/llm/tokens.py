"""Exact byte-pair token ids over whole Arrow columns.

Texts are cut by the public pre-tokeniser pattern (contractions, letters,
digits, other signs, white space) with array operations on code points.  Each
distinct piece is encoded once in a worker, by the library, and kept in a table
by hash; ids and counts of a column are then gathers.  The result equals the
library's encode_ordinary() of each text.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from weftgraph.llm import kernels as K

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SLOTS = 1 << 21


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": DIGIT}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    out[_WHITE] = SPACE
    return out


def cut(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of pieces, first piece of each row) for rows codes[offsets[r] : offsets[r + 1]]."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _classes()[codes]
    row_start = np.zeros(n + 1, bool)
    row_start[offsets] = True
    run = row_start[:n].copy()
    run[0] = True
    run[1:] |= kind[1:] != kind[:-1]
    s = np.flatnonzero(run)
    e = np.concatenate([s[1:], [n]])
    k = kind[s]
    begins = row_start[s]
    starts = np.zeros(n, bool)
    blank = codes == 32
    # Letters, digits, signs: a blank right before belongs to them.
    solid = k != SPACE
    lead = np.zeros(len(s), bool)
    lead[1:] = ~begins[1:] & blank[s[1:] - 1]
    starts[s[solid & lead] - 1] = True
    starts[s[solid & ~lead]] = True
    # White space: all but its last character, then that one, unless it is a blank that the next piece takes; whole at a row's end.
    space = ~solid
    ends = row_start[e]
    last_blank = blank[e - 1]
    whole = space & (ends | (e - s == 1) & ~last_blank)
    starts[s[whole]] = True
    longer = space & ~ends & (e - s > 1)
    starts[s[longer]] = True
    starts[e[longer & ~last_blank] - 1] = True
    # A lone apostrophe that opens a piece takes the ending after it.
    tick = np.flatnonzero((k == OTHER) & ~lead & (e - s == 1) & (codes[s] == 39) & ~ends)
    if len(tick):
        tick = tick[kind[e[tick]] == LETTER]
        a = codes[e[tick]]
        has = e[tick] + 1 < e[tick + 1]
        b = np.where(has, codes[np.minimum(e[tick] + 1, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ~one & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for hit, size in ((one, 1), (two, 2)):
            t = tick[hit]
            starts[e[t]] = False
            after = e[t] + size
            more = after < e[t + 1]
            starts[after[more]] = True
    at = np.flatnonzero(starts)
    return at, np.searchsorted(at, offsets)


class Encoder:
    """A tokenizer of one process; get() keeps one for each vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary = max(ranks.values()) + 1
        self.key = np.zeros(SLOTS, np.uint64)
        self.place = np.zeros(SLOTS, np.int64)
        self.flat, self.offsets = np.zeros(1 << 16, np.int32), [0]
        self.counts = np.zeros(1 << 16, np.int32)

    def _add(self, pieces: list[str]) -> np.ndarray:
        first = len(self.offsets) - 1
        for p in pieces:
            ids = self.library.encode_ordinary(p)
            at = self.offsets[-1]
            if at + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
            if len(self.offsets) > len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.flat[at : at + len(ids)] = ids
            self.counts[len(self.offsets) - 1] = len(ids)
            self.offsets.append(at + len(ids))
        self.array = np.array(self.offsets, np.int64)
        return np.arange(first, first + len(pieces))

    def pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of each piece in the table, first piece of each row)."""
        raw, offsets = K.buffers(column)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        if len(self.offsets) > 2_000_000:  # bounds the table; pieces are encoded again when met again
            self.__dict__.update(key=np.zeros(SLOTS, np.uint64), place=np.zeros(SLOTS, np.int64), offsets=[0])
        text = raw.tobytes().decode("utf-8")
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        at, first = cut(codes, heads[offsets])
        end = np.concatenate([at[1:], [len(codes)]])
        h = K.span_hash(K.prefix(codes.astype(np.uint64) + np.uint64(7), K._BASE), at, end, K._BASE) | np.uint64(1)
        slot = (h >> np.uint64(43)).astype(np.int64)
        out = self.place[slot]
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            new, index, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            numbers = self._add([text[at[j] : end[j]] for j in miss[index].tolist()])
            out[miss] = numbers[inverse]
            where = (new >> np.uint64(43)).astype(np.int64)
            self.key[where], self.place[where] = new, numbers
            # Of new pieces in one slot the last stays; the others are looked up anew next time.
        return out, first

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Tokens of each row."""
        number, first = self.pieces(column)
        total = np.concatenate([[0], np.cumsum(self.counts[number], dtype=np.int64)])
        return np.diff(total[first])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of rows)."""
        number, first = self.pieces(column)
        n = self.counts[number].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        if not len(number):
            return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
        at = np.repeat(self.array[number] - total[:-1], n) + np.arange(total[-1])
        return self.flat[at], total[first]


_held: dict[str, Encoder] = {}


def get(path: str) -> Encoder:
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]
