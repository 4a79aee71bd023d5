"""Whole-batch text kernels in numpy: words, word hashes and word n-grams of Arrow string columns.

Everything works on the UTF-8 bytes of many documents at once; no Python loop runs per word.
Words are maximal runs of bytes other than space and U+0009..U+000D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U64(0x9E3779B97F4A7C15)
NGRAM_BASE = U64(0xD1342543DE82EF95)
#: Bytes worked on at a time inside long texts.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that all bits of a hash are usable."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xE9846AF9B1A615D5)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


class _Weights:
    """Pseudo-random odd weights of the places in a span, grown to the longest met up to PIECE.

    Powers of one base would do for chance, but texts can be made that collide under any.
    """

    def __init__(self) -> None:
        self.table = np.zeros(0, U64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            self.table = _weights_from(0, max(n, 2 * len(self.table)))
        return self.table


def _weights_from(place: int, n: int) -> np.ndarray:
    return mix(np.arange(place + 1, place + n + 1, dtype=U64) * BASE) | U64(1)


_WEIGHTS = _Weights()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls as empty) and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, target: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about target bytes; a longer row is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + target, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


class Words:
    """The words of some rows: byte spans and, for every row, the range of its words.

    blank says for each byte whether it stands between words.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, blank: np.ndarray = SPACE) -> None:
        self.data, self.off = data, off
        inside = ~blank[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        heads = off[:-1][off[:-1] < len(data)]
        before[heads] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        tails = off[1:][off[1:] > 0] - 1
        after[tails] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(self.start, off)  # row r has words row[r]..row[r+1]

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash for every word; lower folds A-Z alone."""
        return span_hashes(self.data, self.start, self.end, lower)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, in order of start: their sum under the places' weights, mixed.

    Work goes on by about PIECE bytes, and longer spans piece by piece, so that memory beside
    the result does not grow with the text.
    """
    out = np.zeros(len(start), U64)
    length = end - start
    done = np.cumsum(length)
    i = 0
    while i < len(start):
        if length[i] > PIECE:
            out[i] = _long_span(data[start[i] : end[i]], lower)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(done, done[i] - length[i] + PIECE, side="right")))
        own = length[i:j]
        first = np.cumsum(own) - own
        place = np.arange(int(own.sum())) - np.repeat(first, own)
        byte = data[place + np.repeat(start[i:j], own)]
        if lower:
            byte = LOWER[byte]
        some = own > 0
        weighed = (byte.astype(U64) + U64(1)) * _WEIGHTS.upto(int(own.max(initial=1)))[place]
        if some.any():
            out[i:j][some] = np.add.reduceat(weighed, first[some])
        i = j
    return mix(out + length.astype(U64) * NGRAM_BASE)


def _long_span(data: np.ndarray, lower: bool) -> np.uint64:
    """The sum of a span longer than PIECE bytes."""
    total = 0
    for at in range(0, len(data), PIECE):
        byte = data[at : at + PIECE]
        byte = LOWER[byte] if lower else byte
        total += int(((byte.astype(U64) + U64(1)) * _weights_from(at, len(byte))).sum(dtype=U64))
    return U64(total & 0xFFFFFFFFFFFFFFFF)


def counted(members: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of every row are members; long rows go piece by piece."""
    if len(data) > PIECE:
        return np.array([sum(int(np.count_nonzero(members[data[k : min(b, k + PIECE)]])) for k in range(a, b, PIECE)) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64)
    run = np.zeros(len(data) + 1, np.int32)
    np.cumsum(members[data], out=run[1:], dtype=np.int32)
    return (run[off[1:]] - run[off[:-1]]).astype(np.int64)


def code_points(data: np.ndarray) -> np.ndarray:
    """For every byte place, the code points that begin before it."""
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    out = np.zeros(len(data) + 1, kind)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:], dtype=kind)
    return out


def ngram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words over the whole array, row borders ignored."""
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    h = np.full(m, U64(n), U64)
    for j in range(n):
        h = h * NGRAM_BASE + word[j : j + m]
    return mix(h)


def shingle_sets(words: Words, n: int = 5) -> Iterator[np.ndarray]:
    """For every row the sorted distinct hashes of its n-word windows, lower-cased A-Z.

    Rows of fewer than n words have their whole word sequence as the one window; rows
    without words have none.
    """
    word = words.hashes(lower=True)
    every = ngram_hashes(word, n)
    for a, b in zip(words.row[:-1].tolist(), words.row[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        elif b > a:
            yield ngram_hashes(word[a:b], b - a)
        else:
            yield every[:0]
