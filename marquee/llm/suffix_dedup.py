"""Removal of repeated byte strings by a hash-compared suffix sort.

Every ``length``-byte window has one anchor: the leftmost smallest 32-byte gram inside it.
Equal windows have equal anchors at the same place, so windows are compared only under
their anchor. Anchors whose whole surrounding (all windows they stand for) is equal are
settled by its hash. For the others the surroundings are fetched, and per anchor the bytes
to the right and to the left are sorted as suffixes: prefix polynomial hashes and binary
search give common extensions, a mergesort orders by them in logarithmic comparisons, and
neighbours are then compared byte by byte. Common prefixes in sorted order give the classes
of equal windows; all but the first of a class are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import text as T
from marquee.llm.ids import keyed_texts
from marquee.llm.streams import column, dealt, group_bounds, keyed_groups
from marquee.runtime import staged

GRAM = 32
BLOCK = 2 << 20            # window starts looked at together
_LOW = np.uint64((1 << 24) - 1)


def anchors(chunk: T.Chunk, length: int):
    """(text, anchor, first window, last window, hash of the gram, hash of the windows' bytes).

    Positions are relative to the text. One row per run of windows with the same anchor.
    """
    data, bounds = chunk.data, chunk.bounds
    prefix = T.PrefixHash(data)
    width = length - GRAM + 1
    step = np.zeros(len(data) + 1, np.int8)
    size = np.diff(bounds)
    long = size >= length
    step[bounds[:-1][long]] += 1
    step[bounds[1:][long] - length + 1] -= 1
    whole = np.cumsum(step[:-1], dtype=np.int8) > 0
    out = []
    for lo in range(0, max(0, len(data) - length + 1), BLOCK):
        hi = min(lo + BLOCK, len(data) - length + 1)
        at = np.arange(lo, hi + width - 1)
        gram = T.mix(prefix.of(at, at + GRAM))
        low = (gram & ~_LOW) | np.arange(len(at), dtype=np.uint64)
        have = 1
        while have < width:
            more = min(have, width - have)
            low = np.minimum(low[:len(low) - more], low[more:])
            have += more
        place = (low & _LOW).astype(np.int64)
        valid = whole[lo:hi]
        new = valid.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
        last = valid.copy()
        last[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(last)
        a = place[first]
        doc = np.searchsorted(bounds, first + lo, "right") - 1
        base = bounds[doc] - lo
        context = T.mix(prefix.of(first + lo, last + lo + length))
        out.append((doc, a - base, first - base, last - base, gram[a], context))
    return [np.concatenate(x) for x in zip(*out)] if out else None


def _anchor_rows(length: int):
    def run(batches):
        for batch in batches:
            keys = column(batch, "key")
            for chunk in T.chunks(batch.column(1)):
                got = anchors(chunk, length)
                if got is None:
                    continue
                doc, a, first, last, gram, context = got
                loc = a << 16 | (a - first) << 8 | (a - last)
                key = keys[chunk.first + doc]
                for lo in range(0, len(doc), 1 << 17):
                    s = slice(lo, lo + (1 << 17))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (gram[s].view(np.int64), key[s], loc[s], context[s].view(np.int64))],
                        ["h", "key", "loc", "context"])
    return run


def _unpack(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position, and the bytes before it of its first and of its last window."""
    return loc >> 16, loc >> 8 & 255, loc & 255


def _settle(length: int):
    """Anchors met more than once, from a stream sorted by (h, key, loc): removed ranges where an
    earlier one has the same surrounding; the firsts of each surrounding stay open if they differ."""
    def run(batches):
        for table in keyed_groups(batches, ["h"]):
            bounds = group_bounds(table, ["h"])
            size = np.diff(bounds)
            rows = np.flatnonzero(np.repeat(size > 1, size))
            if not len(rows):
                continue
            h, key, loc, context = (table.column(c).to_numpy()[rows] for c in ("h", "key", "loc", "context"))
            spans = loc & 0xFFFF
            order = np.lexsort((np.arange(len(rows)), spans, context, h))
            head = np.append(True, (h[order][1:] != h[order][:-1]) | (context[order][1:] != context[order][:-1])
                             | (spans[order][1:] != spans[order][:-1]))
            first = np.zeros(len(rows), bool)
            first[order[head]] = True
            kinds = np.add.reduceat(first.astype(np.int64), np.flatnonzero(np.append(True, h[1:] != h[:-1])))
            group = np.cumsum(np.append(0, h[1:] != h[:-1]))
            open_ = first & (kinds[group] > 1)
            a, before, after = _unpack(loc)
            for mask, is_open in ((~first, False), (open_, True)):
                n = int(mask.sum())
                if n:
                    start, end = (a - before)[mask], (a - after + length)[mask]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[mask]), pa.array(np.full(n, is_open)), pa.array(h[mask]), pa.array(loc[mask]),
                         pa.array(start), pa.array(end)], ["key", "open", "h", "loc", "start", "end"])
    return run


def _zipped(batches):
    """Whole texts compressed, so that moving them costs less."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for chunk in T.chunks(batch.column(1)):
            n = len(chunk.bounds) - 1
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(chunk.first, n), batch.column(2).slice(chunk.first, n),
                pa.array([pack.compress(chunk.data[lo:hi].tobytes()) for lo, hi in zip(chunk.bounds[:-1], chunk.bounds[1:])],
                         pa.binary())], ["key", "doc_id", "packed"])


def _surroundings(length: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for key, packed, found in zip(column(batch, "key"), batch.column(1), batch.column(2)):
                raw = unpack.decompress(packed.as_py())
                hs = found.values.field(0).to_numpy()
                locs = found.values.field(1).to_numpy()
                a, before, after = _unpack(locs)
                yield pa.RecordBatch.from_arrays([
                    pa.array(hs), pa.array(np.full(len(hs), key)), pa.array(locs),
                    pa.array([raw[x - b:x][::-1] for x, b in zip(a, before)], pa.binary()),
                    pa.array([raw[x:x + length - c] for x, c in zip(a, after)], pa.binary()),
                ], ["h", "key", "loc", "left", "right"])
    return run


class Suffixes:
    """Byte strings compared by their prefix hashes."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
        self.prefix = T.PrefixHash(self.data)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of strings i and j, by binary search."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        a, b = self.start[i], self.start[j]
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.prefix.of(a, a + mid) == self.prefix.of(b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        x = np.where(n < self.size[i], self.data[np.minimum(self.start[i] + n, len(self.data) - 1)].astype(np.int16), -1)
        y = np.where(n < self.size[j], self.data[np.minimum(self.start[j] + n, len(self.data) - 1)].astype(np.int16), -1)
        return np.where(x == y, ties, x < y)

    def sorted_groups(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the strings inside each group, and each one's common prefix with the one before it."""
        n = int(bounds[-1])
        order = np.arange(n)
        group_start = np.repeat(bounds[:-1], np.diff(bounds))
        group_end = np.repeat(bounds[1:], np.diff(bounds))
        here = np.arange(n)
        width, longest = 1, int(np.diff(bounds).max(initial=0))
        while width < longest:  # bottom-up mergesort; each string finds its place in the other run
            run = (here - group_start) // width
            left = run % 2 == 0
            own = group_start + run * width
            other = np.where(left, own + width, own - width)
            lo = np.minimum(other, group_end)
            hi = np.minimum(other + width, group_end)
            begin = lo.copy()
            moving = np.flatnonzero(lo < hi)
            while len(moving):
                mid = (lo[moving] + hi[moving]) // 2
                less = self.before(order[mid], order[moving], ~left[moving])
                lo[moving] = np.where(less, mid + 1, lo[moving])
                hi[moving] = np.where(less, hi[moving], mid)
                moving = moving[lo[moving] < hi[moving]]
            place = np.where(left, here, here - width) + (lo - begin)
            merged = np.empty(n, np.int64)
            merged[place] = order
            order, width = merged, width * 2
        shared = np.zeros(n, np.int64)
        inner = np.flatnonzero(here != group_start)
        shared[inner] = self.common(order[inner - 1], order[inner])
        if not self.verified(order, shared, inner):
            return self.compared(bounds)
        return order, shared

    def verified(self, order: np.ndarray, shared: np.ndarray, inner: np.ndarray) -> bool:
        """Whether neighbours agree exactly as far as their hashes say, and are in order after it."""
        for i in range(int(self.size.max(initial=0)) + 1):
            on = inner[shared[inner] >= i]
            if not len(on):
                return True
            a, b = order[on - 1], order[on]
            x = np.where(i < self.size[a], self.data[np.minimum(self.start[a] + i, len(self.data) - 1)].astype(np.int16), -1)
            y = np.where(i < self.size[b], self.data[np.minimum(self.start[b] + i, len(self.data) - 1)].astype(np.int16), -1)
            ends = shared[on] == i
            if not np.where(ends, (x < y) | (x == -1) & (y == -1), x == y).all():
                return False
        return True

    def compared(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by plain comparison, for the case that a hash lied."""
        raw = self.data.tobytes()
        strings = [raw[s:s + n] for s, n in zip(self.start, self.size)]
        order = np.concatenate([np.array(sorted(range(lo, hi), key=strings.__getitem__), np.int64)
                                for lo, hi in zip(bounds[:-1], bounds[1:])])
        shared = np.zeros(len(order), np.int64)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            for i in range(lo + 1, hi):
                a, b = strings[order[i - 1]], strings[order[i]]
                shared[i] = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return order, shared


def repeated_windows(bounds: np.ndarray, left: list[bytes], right: list[bytes], before: np.ndarray,
                     after: np.ndarray, length: int) -> np.ndarray:
    """For each anchor and each number of bytes in front of it: whether that window occurs at an earlier
    row of its group. Rows of a group come in document order."""
    n = int(bounds[-1])
    heads = np.zeros(n, bool)
    heads[bounds[:-1]] = True
    classes = []
    for strings in (left, right):
        order, shared = Suffixes(strings).sorted_groups(bounds)
        classes.append((order, np.where(heads, -1, shared)))
    gone = np.zeros((n, int(before.max(initial=0)) + 1), bool)
    for b in range(gone.shape[1]):
        rows = np.flatnonzero((after <= b) & (b <= before))
        if len(rows) < 2:
            continue
        ids = []
        for (order, shared), depth in zip(classes, (b, length - b)):
            of = np.empty(n, np.int64)
            of[order] = np.cumsum(shared < depth)
            ids.append(of)
        pair = ids[0][rows] * (n + 1) + ids[1][rows]
        first = np.zeros(len(rows), bool)
        first[np.unique(pair, return_index=True)[1]] = True
        gone[rows[~first], b] = True
    return gone


def _compare(length: int):
    def run(batches):
        for table in keyed_groups(batches, ["h"]):
            bounds = group_bounds(table, ["h"])
            key = table.column("key").to_numpy()
            a, before, after = _unpack(table.column("loc").to_numpy())
            gone = repeated_windows(bounds, table.column("left").to_pylist(), table.column("right").to_pylist(),
                                    before, after, length)
            edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, low = np.nonzero(edge == 1)
            _, high = np.nonzero(edge == -1)
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[row]), pa.array(a[row] - high + 1), pa.array(a[row] - low + length)], ["key", "start", "end"])
    return run


def _cut(batches):
    unpack = zstandard.ZstdDecompressor()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
    for batch in batches:
        rows = []
        for packed, starts, ends in zip(*(batch.column(i) for i in (1, 2, 3))):
            raw = unpack.decompress(packed.as_py())
            lo, hi = merged_spans(starts.values.to_numpy() if starts.is_valid else [], ends.values.to_numpy() if ends.is_valid else [])
            edges = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(raw)]
            kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
            rows.append((len(raw), len(raw) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), lo.tolist(), hi.tolist()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows), (
                pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))))], names)


def merged_spans(starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the ranges."""
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], np.append(reach[:-1][new[1:]], reach[-1])


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends), one row per row of ``docs``.

    A byte is removed if a ``length``-byte string that covers it also starts earlier, in a
    document with a smaller id or in the same one; overlapping occurrences count and strings
    are judged on the input. Null texts are empty. Rows with null or repeated ids come in the
    order of id (null first) and text digest. ``starts`` and ``ends`` are the removed runs.
    """
    if not GRAM <= length <= 255 - GRAM:
        raise ValueError(f"length must be from {GRAM} to {255 - GRAM}")
    rows = keyed_texts(docs, id_col, text_col)
    found = rows.select("key", "text").mapInArrow(_anchor_rows(length), "h long, key long, loc long, context long")
    settled = staged(dealt(found, ["h"], ["key", "loc"]).mapInArrow(
        _settle(length), "key long, open boolean, h long, loc long, start long, end long"), "anchors")
    packed = rows.select("key", "text", "doc_id").mapInArrow(_zipped, "key long, doc_id long, packed binary")
    wanted = settled.where("open").groupBy("key").agg(F.collect_list(F.struct("h", "loc")).alias("found"))
    around = (packed.join(wanted, "key").select("key", "packed", "found")
              .mapInArrow(_surroundings(length), "h long, key long, loc long, left binary, right binary"))
    compared = dealt(around, ["h"], ["key", "loc"]).mapInArrow(_compare(length), "key long, start long, end long")
    gone = (settled.where("not open").select("key", "start", "end").unionByName(compared)
            .groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
            .select("key", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends")))
    return (packed.join(gone, "key", "left").select("doc_id", "packed", "starts", "ends")
            .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                              "starts array<long>, ends array<long>"))
