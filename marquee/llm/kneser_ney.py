"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Words are 64-bit hashes; the sorted array of the training words' hashes is the vocabulary, and
a word's place in it is its id. Bigrams are sorted arrays of ``context id << 32 | word id`` with
their counts, cut into shards at key ranges that hold about as many tokens each; a context with
more tokens than a shard is itself cut by word. Every array is a file in the shared folder.
Tasks ship their distinct n-grams as packed arrays, already counted.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm import text as T
from marquee.llm.arrays import mapped, new_folder, write_array
from marquee.llm.streams import group_bounds, keyed_groups, list_values
from marquee.runtime import staged

END = np.uint64(0x3C2F733E3C2F733E)   # the end token's hash
SHARD_TOKENS = 1_500_000
HELD = 3_000_000                      # distinct n-grams a counting task holds before it passes them on
WORD = np.int64(0xFFFFFFFF)


class Model(NamedTuple):
    folder: str
    tokens: int               # N
    words: int                # V, also the id of the begin-of-text context
    vocabulary: list[tuple[int, int, int]]  # (first hash, first id, entries) per vocabulary shard
    cuts: np.ndarray          # first keys of the bigram shards but the first
    block: int                # ids per file of the dense arrays
    discounts: tuple[float, float, float]
    lower: tuple[float, float, float]
    types: int                # distinct bigrams
    uniform: float            # weight of the uniform distribution


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; 3/4 where they are undefined."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [k - (k + 1) * y * hi / lo if lo and y else 0.75 for k, lo, hi in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.05), k) for k, x in zip((1.0, 2.0, 3.0), d))


class Tally:
    """Distinct keys with counts, merged whenever many have been added."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts

    def full(self) -> bool:
        if self.held > 2 * HELD:
            keys, counts = self.merged()
            self.keys, self.counts, self.held = [keys], [counts], len(keys)
        return self.held > HELD


def _tokens(chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text closed by the end token, and the texts' offsets."""
    found = T.words(chunk)
    hashes = T.word_hashes(chunk, found)
    bounds = np.append(0, np.cumsum(found.count + 1))
    out = np.full(bounds[-1], END)
    out[np.arange(len(hashes)) + found.doc] = hashes
    return out.view(np.int64), bounds


def _word_counts(batches):
    tally = Tally()
    for batch in batches:
        for chunk in T.chunks(batch.column(0)):
            tally.add(*np.unique(_tokens(chunk)[0], return_counts=True))
            if tally.full():
                yield pa.RecordBatch.from_arrays([*map(pa.array, tally.merged())], ["h", "c"])
                tally = Tally()
    keys, counts = tally.merged()
    for lo in range(0, len(keys), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(keys[lo:lo + (1 << 18)]), pa.array(counts[lo:lo + (1 << 18)])], ["h", "c"])


def _write_vocabulary(folder: str):
    def run(batches):
        hashes, counts = [], []
        for b in batches:
            hashes.append(b.column(0).to_numpy())
            counts.append(b.column(1).to_numpy())
        if hashes and sum(map(len, hashes)):
            h, c = np.concatenate(hashes), np.concatenate(counts)
            write_array(folder, f"hash{h[0]}", h)
            write_array(folder, f"count{h[0]}", c)
            yield pa.RecordBatch.from_arrays([pa.array(np.array([x], np.int64)) for x in (h[0], len(h), c.sum())], ["h", "n", "c"])
    return run


def _cut_keys(folder: str, step: int, words: int):
    """Keys at which a new bigram shard begins."""
    def run(batches):
        for batch in batches:
            for h, first, before in zip(*(batch.column(i).to_pylist() for i in range(3))):
                c = mapped(folder, f"count{h}", "<i8")
                after = before + np.cumsum(c)
                crossed = after // step - (after - c) // step
                at = np.flatnonzero(crossed)
                keys = [((first + i) << 32) + words * j // int(crossed[i]) for i in at for j in range(int(crossed[i]))]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["key"])
    return run


def _ids(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: not in training) and training counts of distinct sorted hashes."""
    ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    at = np.searchsorted(hashes, [h for h, _, _ in model.vocabulary]).tolist() + [len(hashes)]
    for (h, first, n), lo, hi in zip(model.vocabulary, at[:-1], at[1:]):
        if hi > lo:
            own = mapped(model.folder, f"hash{h}", "<i8")
            place = np.minimum(np.searchsorted(own, hashes[lo:hi]), n - 1)
            hit = own[place] == hashes[lo:hi]
            ids[lo:hi] = np.where(hit, first + place, -1)
            counts[lo:hi] = np.where(hit, mapped(model.folder, f"count{h}", "<i8")[place], 0)
    return ids, counts


def _text_ids(model: Model, chunk: T.Chunk):
    """(ids, contexts, training counts, offsets of the texts)."""
    hashes, bounds = _tokens(chunk)
    own, back = np.unique(hashes, return_inverse=True)
    ids, counts = _ids(model, own)
    ids = ids[back]
    context = np.empty_like(ids)
    context[1:] = ids[:-1]
    context[bounds[:-1]] = model.words
    return ids, context, counts[back], bounds


def _shipped(model: Model, keys: np.ndarray, counts: np.ndarray):
    at = np.append(0, np.append(np.searchsorted(keys, model.cuts), len(keys)))
    for shard, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
        if hi > lo:
            rows = [np.array([0, hi - lo], np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32())] + [
                    pa.ListArray.from_arrays(pa.array(rows[0]), pa.array(x.astype(np.int32)))
                    for x in (keys[lo:hi] >> 32, keys[lo:hi] & WORD, counts[lo:hi])], ["shard", "context", "word", "n"])


def _bigrams(model: Model):
    def run(batches):
        tally = Tally()
        for batch in batches:
            for chunk in T.chunks(batch.column(0)):
                ids, context, _, _ = _text_ids(model, chunk)
                tally.add(*np.unique(context << 32 | ids, return_counts=True))
                if tally.full():
                    yield from _shipped(model, *tally.merged())
                    tally = Tally()
        yield from _shipped(model, *tally.merged())
    return run


_KINDS = "kind int, target int, ids array<int>, a array<long>, b array<int>, c array<int>, d array<int>"


def _kind_rows(kind: int, block: int, ids: np.ndarray, *values: np.ndarray):
    """Rows of one kind, cut at the id blocks of the dense arrays."""
    cuts = np.flatnonzero(np.diff(ids // block)) + 1
    for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(ids))):
        if hi > lo:
            offsets = pa.array(np.array([0, hi - lo], np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[lo:hi].astype(t)))
                     for x, t in zip((ids, *values), (np.int32, np.int64, np.int32, np.int32, np.int32))]
            lists += [pa.array([[]], pa.list_(pa.int64() if i == 1 else pa.int32())) for i in range(len(lists), 5)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind], pa.int32()), pa.array([int(ids[lo]) // block], pa.int32()), *lists],
                ["kind", "target", "ids", "a", "b", "c", "d"])


def _write_shards(model: Model):
    """Merge each shard, write it, and pass on what contexts and words need to know of it."""
    def run(batches):
        for table in keyed_groups(batches, ["shard"]):
            bounds = group_bounds(table, ["shard"])
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                part = table.slice(lo, hi - lo)
                tally = Tally()
                tally.add(list_values(part.column("context"))[0].astype(np.int64) << 32 | list_values(part.column("word"))[0],
                          list_values(part.column("n"))[0].astype(np.int64))
                keys, n = tally.merged()
                shard = part.column("shard")[0].as_py()
                write_array(model.folder, f"key{shard}", keys)
                write_array(model.folder, f"n{shard}", n.astype("<u4"))
                context = keys >> 32
                first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                yield from _kind_rows(1, model.block, context[first], np.add.reduceat(n, first), *(
                    np.add.reduceat(x.astype(np.int64), first) for x in (n == 1, n == 2, n > 2)))
                yield from _kind_rows(2, model.block, *np.unique(keys & WORD, return_counts=True))
                yield from _kind_rows(0, 5, np.arange(1, 5), np.bincount(np.minimum(n, 5), minlength=6)[1:5])
                yield from _kind_rows(3, 5, np.zeros(1, np.int64), np.array([len(n)]))
    return run


def _write_dense(model: Model):
    """Add up contexts (kind 1) and continuations (kind 2) of each id block and write them by id."""
    def run(batches):
        for table in keyed_groups(batches, ["kind", "target"]):
            bounds = group_bounds(table, ["kind", "target"])
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                part = table.slice(lo, hi - lo)
                kind, target = part.column("kind")[0].as_py(), part.column("target")[0].as_py()
                at = list_values(part.column("ids"))[0].astype(np.int64) - target * model.block
                dense = []
                for name in "abcd"[:4 if kind == 1 else 1]:
                    dense.append(np.bincount(at, list_values(part.column(name))[0], model.block).astype(np.int64))
                if kind == 1:
                    for name, values in zip(("total", "one", "two", "more"), dense):
                        write_array(model.folder, f"{name}{target}", values if name == "total" else values.astype("<i4"))
                else:
                    write_array(model.folder, f"before{target}", dense[0])
                    few = np.bincount(np.minimum(dense[0], 5), minlength=6)[1:]
                    yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in few], ["t1", "t2", "t3", "t4", "t5"])
    return run


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count every text of ``docs`` (null: empty) and write the model's arrays."""
    spark = docs.sparkSession
    folder = new_folder(spark, "kneser-ney")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = staged(texts.mapInArrow(_word_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "kn-words")
    total, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)),
                             F.coalesce(F.sum(F.when(F.col("h") == int(END.view(np.int64)), F.col("c"))), F.lit(0))).first()
    shards = max(1, -(-total // SHARD_TOKENS))
    rows = (counts.repartitionByRange(shards, "h").sortWithinPartitions("h")
            .mapInArrow(_write_vocabulary(folder), "h long, n long, c long").orderBy("h").collect())  # one row per shard
    vocabulary, before, words, start = [], 0, sum(r.n for r in rows), []
    for r in rows:
        first = vocabulary[-1][1] + vocabulary[-1][2] if vocabulary else 0
        vocabulary.append((r.h, first, r.n))
        start.append((r.h, first, before))
        before += r.c
    step = max(1, total // shards)
    cuts = []
    if start:
        cuts = [r.key for r in spark.createDataFrame(start, "h long, first long, before long").repartition(min(len(start), 64))
                .mapInArrow(_cut_keys(folder, step, words), "key long").collect()]  # at most one per shard
    opening = ends // step + 1
    cuts += [(words << 32) + words * j // opening for j in range(opening)]
    model = Model(folder, total, words, vocabulary, np.array(sorted(set(cuts)), np.int64), max(1, -(-(words + 1) // shards)),
                  (0.75,) * 3, (0.75,) * 3, 0, 1.0)
    if not total:
        return model
    grams = texts.mapInArrow(_bigrams(model), "shard int, context array<int>, word array<int>, n array<int>")
    parts = staged(grams.repartition("shard").sortWithinPartitions("shard").mapInArrow(_write_shards(model), _KINDS), "kn-parts")
    few = parts.where("kind = 0").select(F.posexplode("a")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    types = parts.where("kind = 3").agg(F.sum(F.col("a")[0])).first()[0]
    dense = (parts.where("kind in (1, 2)").repartition("kind", "target").sortWithinPartitions("kind", "target")
             .mapInArrow(_write_dense(model), "t1 long, t2 long, t3 long, t4 long, t5 long"))
    t = staged(dense, "kn-dense").agg(*[F.coalesce(F.sum(f"t{i}"), F.lit(0)) for i in range(1, 6)]).first()
    n = {r.pos: r.n for r in few}
    lower = discounts(*t[:4])
    free = (lower[0] * t[0] + lower[1] * t[1] + lower[2] * sum(t[2:])) / types
    return model._replace(discounts=discounts(*(n.get(i, 0) for i in range(4))), lower=lower, types=types, uniform=free)


def _dense(model: Model, name: str, dtype: str, ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Values of a dense array at ``ids`` (all known), read block after block; order sorts the ids."""
    out = np.zeros(len(ids), np.int64)
    inner = ids[order]
    cuts = np.flatnonzero(np.diff(inner // model.block)) + 1
    for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(inner))):
        if hi > lo:
            block = int(inner[lo]) // model.block
            try:
                values = mapped(model.folder, f"{name}{block}", dtype)
            except FileNotFoundError:  # no id of this block was ever a context
                continue
            out[order[lo:hi]] = values[inner[lo:hi] - block * model.block]
    return out


def log_probabilities(model: Model, ids: np.ndarray, context: np.ndarray) -> np.ndarray:
    """log10 P(word | context) of each token."""
    n = len(ids)
    p = np.full(n, (model.uniform if model.types else 1.0) / (model.words + 1))
    if model.types:
        known = np.flatnonzero(ids >= 0)
        own, back = np.unique(ids[known], return_inverse=True)
        before = _dense(model, "before", "<i8", own, np.arange(len(own)))[back]
        p[known] += np.maximum(before - np.array((0,) + model.lower)[np.minimum(before, 3)], 0) / model.types
        ctx, place = np.unique(np.where(context >= 0, context, model.words), return_inverse=True)
        total, one, two, more = (_dense(model, name, kind, ctx, np.arange(len(ctx)))[place] for name, kind in
                                 (("total", "<i8"), ("one", "<i4"), ("two", "<i4"), ("more", "<i4")))
        total = np.where(context >= 0, total, 0)
        seen = total > 0
        d = model.discounts
        weight = np.where(seen, (d[0] * one + d[1] * two + d[2] * more) / np.maximum(total, 1), 1.0)
        count = np.zeros(n, np.int64)
        both = np.flatnonzero(seen & (ids >= 0))
        keys, back = np.unique(context[both] << 32 | ids[both], return_inverse=True)
        hits = np.zeros(len(keys), np.int64)
        at = np.append(0, np.append(np.searchsorted(keys, model.cuts), len(keys)))
        for shard, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
            if hi > lo:
                try:
                    held = mapped(model.folder, f"key{shard}", "<i8")
                except FileNotFoundError:  # no bigram fell into this range
                    continue
                place = np.minimum(np.searchsorted(held, keys[lo:hi]), len(held) - 1)
                hits[lo:hi] = np.where(held[place] == keys[lo:hi], mapped(model.folder, f"n{shard}", "<u4")[place], 0)
        count[both] = hits[back]
        p = weight * p + np.where(seen, np.maximum(count - np.array((0,) + d)[np.minimum(count, 3)], 0) / np.maximum(total, 1), 0)
    return np.log10(p)


def _scores(model: Model):
    def run(batches):
        for batch in batches:
            for chunk in T.chunks(batch.column(1)):
                ids, context, counts, bounds = _text_ids(model, chunk)
                base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
                sums = [np.add.reduceat(x, bounds[:-1]) for x in (
                    (counts > 0).astype(np.int64), base, log_probabilities(model, ids, context))]
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, n), pa.array(np.diff(bounds)), pa.array(sums[0]),
                     pa.array(np.full(n, model.tokens)), pa.array(sums[1]), pa.array(sums[2])],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row.

    Tokens are the words (A-Z lower-cased) and one end token. ``base_score`` is the additive
    unigram score, ``score`` the Kneser-Ney log10 probability of the text. Null and empty
    texts are the end token alone. Rows are independent of one another. Under a model of no
    text both distributions are uniform over the one unknown word.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scores(model), "doc_id long, n_tokens long, n_known long, train_tokens long, "
                                           "base_score double, score double")


def train_and_score(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, train(docs.where(usable), text_col), id_col, text_col)
