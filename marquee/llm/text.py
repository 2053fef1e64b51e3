"""Arrow text columns as byte buffers: words, polynomial hashes and bounded chunks.

Everything works on UTF-8 bytes. Words are runs of bytes other than space and 0x09-0x0D;
ASCII bytes never occur inside a multi-byte character, so this equals the split by code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; makes every output bit depend on every input bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def byte_codes(fold_case: bool) -> np.ndarray:
    """A random 64-bit code per byte value; A-Z share the code of a-z if ``fold_case``."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if fold_case:
        codes[ord("A"):ord("Z") + 1] = codes[ord("a"):ord("z") + 1]
    return codes


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS.get("p", ())) < n:
        size = max(n, 1 << 20, 2 * len(_POWERS.get("p", ())))
        for key, base in (("p", _MULT), ("q", pow(_MULT, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["p"], _POWERS["q"]


class PrefixHash:
    """Prefix polynomial hashes of a buffer; ``of(start, end)`` hashes substrings in O(1)."""

    def __init__(self, data: np.ndarray, fold_case: bool = False):
        n = len(data)
        p, self._inverse = powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte_codes(fold_case)[data] * p[:n], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._inverse[start]


class Chunk(NamedTuple):
    first: int          # row of the batch that the first text belongs to
    data: np.ndarray    # uint8, all texts of the chunk
    bounds: np.ndarray  # int64, len(texts) + 1 offsets into data


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Runs of whole texts of at most ``limit`` bytes (a longer text is a chunk of its own)."""
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield Chunk(at, raw[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at])
        at = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words(NamedTuple):
    start: np.ndarray  # byte offsets into the chunk
    end: np.ndarray
    doc: np.ndarray    # text within the chunk
    count: np.ndarray  # words per text


def words(chunk: Chunk) -> Words:
    inside = np.zeros(len(chunk.data) + 2, bool)
    np.logical_not(_SPACE[chunk.data], out=inside[1:-1])
    starts = inside[1:] & ~inside[:-1]
    ends = ~inside[1:] & inside[:-1]
    cut = chunk.bounds[1:-1]
    touching = cut[inside[cut] & inside[cut + 1]]  # a word may not run on into the next text
    starts[touching] = True
    ends[touching] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    at = np.searchsorted(start, chunk.bounds)
    count = np.diff(at)
    return Words(start, end, np.repeat(np.arange(len(count)), count), count)


def word_hashes(chunk: Chunk, found: Words, fold_case: bool = True) -> np.ndarray:
    return mix(PrefixHash(chunk.data, fold_case).of(found.start, found.end))


def shingles(hashes: np.ndarray, found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every ``size``-word shingle; a text with fewer words has one of all its words."""
    doc, count = found.doc, found.count
    factors = mix(np.arange(7, 7 + size, dtype=np.uint64)) | np.uint64(1)
    n = len(hashes)
    total = np.zeros(max(0, n - size + 1), np.uint64)
    for i in range(size):
        total += hashes[i:n - size + 1 + i] * factors[i] if len(total) else total
    keep = doc[:len(total)] == doc[size - 1:] if len(total) else np.zeros(0, bool)
    short = (count > 0) & (count < size)
    rows, values = [doc[:len(total)][keep]], [mix(total[keep])]
    if short.any():
        within = np.flatnonzero(short[doc])
        place = within - (np.cumsum(count) - count)[doc[within]]
        sums = np.zeros(len(count), np.uint64)
        np.add.at(sums, doc[within], hashes[within] * factors[place])
        rows.append(np.flatnonzero(short))
        values.append(mix(sums[short] + count[short].astype(np.uint64)))
    return np.concatenate(rows), np.concatenate(values)


def distinct_per_text(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, sorted within the text, and the ``n + 1`` offsets of the texts."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    if len(rows):
        first = np.append(True, (rows[1:] != rows[:-1]) | (values[1:] != values[:-1]))
        rows, values = rows[first], values[first]
    return values, np.searchsorted(rows, np.arange(n + 1))


def int_lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
