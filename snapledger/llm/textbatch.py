"""Vectorised views of Arrow string batches.

A batch of texts is looked at as one byte array with offsets. Words are runs of
bytes outside ``\\x20 \\x09-\\x0D``; as these are ASCII, cutting UTF-8 bytes gives
the same words as cutting code points. Word hashes come from prefix sums of a
polynomial modulo 2**64, so that the cost is a few passes over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes looked at together; longer texts are taken one at a time. Small enough for the processor's cache.
SLICE_BYTES = 1 << 18

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, U64)
        steps[0] = 1
        got = np.cumprod(steps, dtype=U64)
        if len(got) <= SLICE_BYTES + 1:  # those of a long text are not kept
            _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes."""
    data, off = flat(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of value * BASE**position before each position, modulo 2**64."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(BASE, len(values)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of the values summed, the same wherever the span stands."""
    if not len(start):
        return np.zeros(0, U64)
    return mix((sums[end] - sums[start]) * powers(BASE_INV, len(sums))[start] + (end - start).astype(U64))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the offsets of each text's words among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    some = off[1:] > off[:-1]
    edge, tail = off[:-1][some], off[1:][some] - 1
    first[edge], last[tail] = word[edge], word[tail]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lower-cased, and the offsets of each text's words."""
    start, end, of = word_spans(data, off)
    return span_hashes(prefix_sums(LOWER[data]), start, end), of


def window_hashes(items: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` items in each text; a shorter text gives its whole sequence, an empty one nothing."""
    n = np.diff(of)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out_of = np.concatenate(([0], np.cumsum(count)))
    row = np.repeat(np.arange(len(n)), count)
    start = of[:-1][row] + np.arange(out_of[-1]) - out_of[:-1][row]
    return span_hashes(prefix_sums(items), start, np.minimum(start + width, of[1:][row])), out_of


def rows_of(of: np.ndarray) -> np.ndarray:
    """Row number of every item."""
    return np.repeat(np.arange(len(of) - 1), np.diff(of))
