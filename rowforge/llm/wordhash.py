"""Vectorised hashing of words and word shingles straight from Arrow string buffers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; UTF-8 continuation bytes never fall in
that set, so working on bytes is the same as working on characters.  A-Z are folded to a-z.  A word
hash is a polynomial in an odd base modulo 2**64, got from one running sum over the block, and then
put through a finaliser; a shingle hash mixes the hashes of its words with their positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_OWN = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SIGNS = np.ones(256, bool)  # all ASCII but letters and digits
_SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_MULT = _rng.integers(1, 1 << 63, 64, dtype=np.int64).astype(np.uint64) | _U(1)
_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown on demand and kept for the worker's life."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        table = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if len(table) > 16 * BLOCK_BYTES:  # one very long text: not worth keeping
            return table
        _powers[key] = have = table
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hashes of the byte spans [start, end) of a block; fold: A-Z count as a-z."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE if fold else _OWN)[data] * _power_table(_BASE, len(data))[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * _power_table(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """The usual 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, past row, bytes, offsets) blocks of whole texts; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        past = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1)
        own = offsets[row : past + 1]
        yield row, past, data[own[0] : own[-1]], own - own[0]
        row = past


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block, and each text's offsets into them."""
    starts, ends, at = _runs(data, offsets, _SPACE)
    return span_hashes(data, starts, ends), at


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """One sorted array of distinct shingle hashes a row: `words` words each; a text with fewer words
    gives its whole word sequence as one shingle, and a text without words (or null) an empty array."""
    for row, past, data, offsets in text_blocks(column):
        w, at = word_hashes(data, offsets)
        n = max(0, len(w) - words + 1)
        h = np.zeros(n, np.uint64)
        for k in range(words):
            h += w[k : k + n] * _MULT[k]
        h = mix64(h)
        for d in range(past - row):
            a, b = int(at[d]), int(at[d + 1])
            if b - a >= words:
                own = np.sort(h[a : b - words + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own
            elif b > a:
                short = np.array([b - a], np.uint64) * _MULT[words]
                for k in range(b - a):
                    short += w[a + k : a + k + 1] * _MULT[k]
                yield mix64(short)
            else:
                yield np.zeros(0, np.uint64)


def _runs(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of bytes that are not `apart`, none over a text's edge, and each text's offsets into them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside, edge = ~apart[data], np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _distinct(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs of 48 bits of each hash, by row and then hash: one sort for a whole block (rows < 2**16)."""
    keys = np.sort(row.astype(np.uint64) << _U(48) | hashes >> _U(16))
    if len(keys) > 1:
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return (keys >> _U(48)).astype(np.int64), keys & _U((1 << 48) - 1)


#: Shares at which a mark of shape goes from one step to the next.
STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
BEGINNINGS = (4, 5, 6)
SHAPES = 4


def feature_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, shape) of each row: sorted distinct 48-bit hashes of its words and of words' beginnings of 4, 5 and 6 bytes;
    and marks of its shape, numbers under 64: in which step the shares of distinct words, of signs and of capitals lie, and
    that of distinct lines.  A null or empty text has neither.  Words are runs of ASCII letters, digits and other non-ASCII bytes."""
    for first, past, data, offsets in _few_rows(text_blocks(column)):
        rows, sizes = past - first, np.diff(offsets)
        starts, ends, at = _runs(data, offsets, _SIGNS)
        row, hashes = [np.repeat(np.arange(rows), np.diff(at))], [span_hashes(data, starts, ends)]
        for n in BEGINNINGS:
            longer = ends - starts > n
            row.append(row[0][longer])
            hashes.append(mix64(span_hashes(data, starts[longer], starts[longer] + n) + _U(n)))
        owner, found = _distinct(np.concatenate(row), np.concatenate(hashes))
        cut = np.searchsorted(owner, np.arange(rows + 1))
        shares = np.zeros((rows, SHAPES))
        for k, apart in ((0, _SPACE), (3, _LINE_END)):
            a, z, to = _runs(data, offsets, apart)
            n = np.diff(to)
            shares[:, k] = np.bincount(_distinct(np.repeat(np.arange(rows), n), span_hashes(data, a, z, fold=False))[0], minlength=rows) / np.maximum(1, n)
        for k, kind in ((1, _SIGNS & ~_SPACE), (2, _CAPITAL)):
            total = np.concatenate(([0], np.cumsum(kind[data])))
            shares[:, k] = np.diff(total[offsets]) / np.maximum(1, sizes)
        marks = np.searchsorted(STEPS, shares, "right") + 16 * np.arange(SHAPES)
        for d in range(rows):
            yield found[cut[d] : cut[d + 1]], marks[d].astype(np.uint64) if sizes[d] else np.zeros(0, np.uint64)


def _few_rows(blocks: Iterator, most: int = 1 << 15) -> Iterator:
    for first, past, data, offsets in blocks:
        for a in range(0, past - first, most):
            own = offsets[a : min(a + most, past - first) + 1]
            yield first + a, first + a + len(own) - 1, data[own[0] : own[-1]], own - own[0]


_LINE_END = np.arange(256) == 10
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) < 91)
