"""Vectorised text primitives shared by the corpus operators.

Everything works on Arrow string columns: the UTF-8 buffer of a slice is viewed as a numpy byte array, words are found
with table lookups, and every word gets a 64-bit hash from one prefix sum, so no Python object is made per word.

Defined cases: a null text counts as an empty one; words longer than a segment and texts of any length are handled
(memory grows with the longest single text, not with the batch).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are handled at once; longer single texts are handled alone, in segments.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_ODD = U64(0x9E3779B97F4A7C15)
_ODD_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[LOWER]

#: True for bytes of a word: all but U+0020 and U+0009 to U+000D.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False
#: True for ASCII letters and digits and every byte beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 64)
        for key, base in (("p", _ODD), ("q", _ODD_INV)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and each row's start in them, one more at the end. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of_rows(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _segment(raw: np.ndarray, word_byte: np.ndarray, lower: bool, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = word_byte[raw]
    edge = np.empty(len(raw) + 1, dtype=bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    begin = edge[:-1] & inside
    stop = edge[1:] & inside
    inner = cuts[(cuts > 0) & (cuts < len(raw))]
    if len(inner):  # rows that touch without a separator
        begin[inner] |= inside[inner]
        stop[inner - 1] |= inside[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    p, q = _power(len(raw) + 1)
    total = np.empty(len(raw) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * p[: len(raw)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * q[starts])


def words(raw: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray = NONSPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some rows: byte starts, byte ends, 64-bit hashes, and for each row the number of its first word (one more at the end).

    lower: letters A to Z are hashed as a to z. Two words have the same hash if their bytes are equal, else almost never.
    """
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if len(raw) <= 4 * CHUNK_BYTES:
        starts, ends, hashes = _segment(raw, word_byte, lower, offsets)
    else:
        parts, at = [], 0
        while at < len(raw):
            to = min(at + CHUNK_BYTES, len(raw))
            while to < len(raw) and word_byte[raw[to - 1]] and word_byte[raw[to]]:  # never cut within a word
                ahead = word_byte[raw[to : to + 65536]]
                to += int(np.argmin(ahead)) if not ahead.all() else len(ahead)
            s, e, h = _segment(raw[at:to], word_byte, lower, offsets - at)
            parts.append((s + at, e + at, h))
            at = to
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of any spans of bytes, equal for equal bytes."""
    p, q = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * p[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts])


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from each row's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def chain(hashes: np.ndarray, n: int, step: int = 1) -> np.ndarray:
    """Order-dependent hashes of n words each, step apart, at every place where they fit in the array."""
    span = (n - 1) * step
    if len(hashes) <= span:
        return np.zeros(0, np.uint64)
    size = len(hashes) - span
    out = hashes[:size].copy()
    for k in range(1, n):
        out = mix(out * U64(0xD1342543DE82EF95) + hashes[k * step : k * step + size])
    return out


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of a row's values; 0 for a row without any. first: each row's first value, one more at the end."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a text column with their bytes and offsets."""
    raw, offsets = text_buffer(column)
    for i, j in spans_of_rows(offsets, limit):
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
