"""Words and substring hashes of whole Arrow text columns, in numpy.

Hashes are polynomials modulo 2**64 over prefix sums, so that the hash of any substring
costs two lookups; they are mixed before use.  Sizes are in bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the polynomial, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Rows are worked on in slices of about so many bytes; one text is never divided.
SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64, kept per worker."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        table[0] = 1
        table = _powers[base] = np.cumprod(table, dtype=np.uint64)
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial over ``data``; one longer than it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of the substrings ``[start, end)``, the same wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(INVERSE, len(prefix))[starts])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and their offsets (nulls are empty)."""
    column = pc.fill_null(column.cast(pa.large_string()).cast(pa.large_binary()) if pa.types.is_string(column.type)
                          else column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of their texts."""
    for batch in batches:
        data, offsets = bytes_of(batch.column(batch.schema.get_field_index(text)))
        row, n = 0, batch.num_rows
        while row < n:
            end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
            end = min(max(end, row + 1), n)
            yield batch.slice(row, end - row), data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
            row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each text."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = SPACE[data]
    start = ~gap
    before = gap.copy()
    before[1:], before[0] = gap[:-1], True
    before[offsets] = True
    start &= before
    starts = np.flatnonzero(start)
    stop = gap.copy()
    stop[offsets] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, "right")]
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``k``-word shingles over lower-cased A-Z.

    A text of fewer words has its whole sequence as the one shingle; one without words has none.
    """
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    word = substring_hashes(prefix_hashes(data), starts, ends)
    rolled = np.zeros(max(len(word) - k + 1, 0), np.uint64)
    for i in range(k):
        rolled = mix(rolled * np.uint64(BASE) + word[i:i + len(rolled)])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a:b - k + 1]))
        else:
            short = np.zeros(1, np.uint64)
            for i in range(a, b):
                short = mix(short * np.uint64(BASE) + word[i:i + 1] + np.uint64(b - a))
            out.append(short if b > a else short[:0])
    return out
