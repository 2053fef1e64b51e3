"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its words' character n-grams and of the words
themselves. Embeddings and output layer are trained together by stochastic gradient descent
in numpy on a bounded sample of labelled rows, and a temperature is fitted on rows left out of
training. For prediction the two layers are multiplied out, so a word adds one small vector of
class scores.

A softmax only shares its trust among the learned languages, so rejection has a second sign:
the character 4-grams of a text that no training text holds. How many a text of a learned
language has is calibrated on the rows left out as well.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm import text as T
from marquee.llm.held import free_held, tidy
from marquee.runtime import staged

BUCKETS = 1 << 16
DIM = 16
GRAMS = (1, 2, 3, 4)
CACHE_CELLS = 13 * 400_000   # words times (languages + 1) of a task's cache
CHUNK_BYTES = 1 << 20   # of texts predicted together
LEAST_STEPS = 900   # of the optimiser, however few rows are labelled
SEEN_BITS = 22      # the table of known 4-grams has 2**22 bits
QUANTILE = 0.005    # of the calibration texts may lie beyond a threshold before its margin
LEAST_UNSEEN = 0.05  # share of 4-grams that any text may miss
_LETTER = re.compile(r"[^\W\d_]")


class Model(NamedTuple):
    labels: list[str]
    scores: np.ndarray     # (BUCKETS, classes), calibrated
    bias: np.ndarray       # (classes,)
    reject_below: float
    seen: np.ndarray       # packed bits: 4-grams of the training texts
    unseen_share: float    # of a text's 4-grams that a learned language may miss


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def split_words(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters and non-ASCII characters."""
    return raw.translate(_FOLD).split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """(word, hash) of each word and of its character n-grams, with a mark at both ends.

    The longest n-grams come last, from the place returned on.
    """
    data = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)
    ends = np.cumsum([len(w) + 2 for w in words])
    begins = np.append(0, ends[:-1])
    edges = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    prefix = T.PrefixHash(data)
    of = np.searchsorted(ends, edges, "right")
    rows, hashes = [np.arange(len(words))], [prefix.of(begins, ends) + np.uint64(1)]
    for n in GRAMS:
        lo, hi = edges[:-n], edges[n:]
        inside = (of[:-n] == of[n:]) | (hi == ends[np.minimum(of[:-n], len(ends) - 1)])
        rows.append(of[:-n][inside])
        hashes.append(prefix.of(lo[inside], hi[inside]))
    return np.concatenate(rows), T.mix(np.concatenate(hashes)), sum(map(len, rows[:-1]))


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each word and of its n-grams."""
    rows, hashes, _ = grams(words)
    return rows, _bucket(hashes)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 16)).astype(np.int64)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << SEEN_BITS) - 1)).astype(np.int64)


def _is_seen(seen: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (seen[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1


def _long_grams(raw: bytes) -> np.ndarray:
    """Slots of a text's 4-grams, each word counted once."""
    found = sorted(set(split_words(raw)))
    if not found:
        return np.zeros(0, np.int64)
    _, hashes, at = grams(found)
    return _slot(hashes[at:])


def too_strange(missed: np.ndarray, total: np.ndarray, share: float) -> np.ndarray:
    """More unseen 4-grams than ``share`` and three standard deviations, so that short texts get room."""
    return missed > share * total + 3 * np.sqrt(share * (1 - share) * total) + 1


def _bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text and their shares of all its subwords."""
    out = []
    for raw in texts:
        found = split_words(raw)
        flat = subwords(found)[1] if found else np.zeros(1, np.int64)
        bucket, n = np.unique(flat, return_counts=True)
        out.append((bucket, n / len(flat)))
    return out


def fit(texts: list[bytes], labels: list[str], epochs: int = 6, rate: float = 4.0, batch: int = 32,
        margin: float = 0.9, seed: int = 7) -> Model:
    """Train on every fifth row left out, then calibrate on those.

    Each text gives two examples: whole, and a run of at most twenty of its words, so that
    short texts are learned as well. There are two rejection thresholds, both from quantiles of
    the whole calibration texts that are labelled right: ``margin`` times a low calibrated
    score, at most ``margin`` / 2 so that a text in two languages is kept, and a high share of
    4-grams unseen in training, divided by ``margin``.
    """
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 0.0, np.zeros(1 << SEEN_BITS - 3, np.uint8), 1.0)
    rng = np.random.default_rng(seed)
    short = []
    for raw in texts:
        w = split_words(raw)
        at = int(rng.integers(0, max(1, len(w) - 3)))
        short.append(b" ".join(w[at:at + int(rng.integers(2, 21))]))
    y = np.array([names.index(x) for x in labels] * 2)
    bags = _bags(texts + short)
    held = np.tile(np.arange(len(texts)) % 5 == 4, 2)
    c = len(names)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, c), np.float32), np.zeros(c, np.float32)
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(train)))
    steps, done = epochs * -(-len(train) // batch), 0
    for _ in range(epochs):
        rng.shuffle(train)
        for lo in range(0, len(train), batch):
            rows = train[lo:lo + batch]
            step = rate * (1 - done / steps)
            done += 1
            ids = np.concatenate([bags[r][0] for r in rows])
            share = np.concatenate([bags[r][1] for r in rows]).astype(np.float32)
            of = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
            hidden = np.add.reduceat(emb[ids] * share[:, None], np.searchsorted(of, np.arange(len(rows))))
            p = _softmax(hidden @ out + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = p @ out.T
            out -= step * hidden.T @ p
            bias -= step * p.sum(axis=0)
            np.add.at(emb, ids, -step * len(rows) * share[:, None] * back[of])
    table = emb @ out
    check = np.flatnonzero(held) if held.any() else train
    logits = np.stack([(table[bags[r][0]] * bags[r][1][:, None]).sum(axis=0) for r in check]) + bias
    scales = np.geomspace(0.1, 10, 41)
    losses = [-np.log(_softmax(logits * s)[np.arange(len(check)), y[check]] + 1e-12).mean() for s in scales]
    scale = scales[int(np.argmin(losses))]
    sure = _softmax(logits * scale)
    whole = (check < len(texts)) & (sure.argmax(axis=1) == y[check])
    floor = float(np.quantile(sure.max(axis=1)[whole], QUANTILE)) if whole.any() else 0.0

    own = [_long_grams(raw) for raw in texts]
    left_out = held[:len(texts)]
    seen = np.zeros(1 << SEEN_BITS, bool)
    for r in np.flatnonzero(~left_out if left_out.any() else np.zeros(len(texts), bool)):
        seen[own[r]] = True
    missing = [1 - seen[own[r]].mean() for r in check[whole] if len(own[r])] if left_out.any() else []
    unseen = min(1.0, max(LEAST_UNSEEN, float(np.quantile(missing, 1 - QUANTILE)) / margin)) if missing else 1.0
    for r in np.flatnonzero(left_out):  # known from here on
        seen[own[r]] = True
    return Model(names, (table * scale).astype(np.float32), (bias * scale).astype(np.float64), margin * min(0.5, floor),
                 np.packbits(seen), unseen)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class WordScores(dict):
    """Row of each word in a table of summed class scores, subword counts, unseen and all 4-grams."""

    def __init__(self, model: Model):
        super().__init__()
        self.table, self.seen, self.new = model.scores, model.seen, []
        self.rows = np.zeros((0, self.table.shape[1] + 3))

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def filled(self) -> np.ndarray:
        if self.new:
            of, hashes, at = grams(self.new)
            n, bucket = len(self.new), _bucket(hashes)
            sums = [np.bincount(of, self.table[bucket, c], n) for c in range(self.table.shape[1])]
            unseen = np.bincount(of[at:], 1 - _is_seen(self.seen, _slot(hashes[at:])), n)
            self.rows = np.concatenate([self.rows, np.stack(
                [*sums, np.bincount(of, minlength=n), unseen, np.bincount(of[at:], minlength=n)], axis=1)])
            self.new = []
        return self.rows


def _predict(shared, text: int, passing: bool):
    def run(batches):
        free_held()
        model: Model = shared.value
        words = WordScores(model)
        for batch in batches:
            for chunk in T.chunks(batch.column(text), CHUNK_BYTES):
                if len(words) * (len(model.labels) + 1) > CACHE_CELLS:
                    words = WordScores(model)
                at, letters = [], []
                for lo, hi in zip(chunk.bounds[:-1], chunk.bounds[1:]):
                    raw = chunk.data[lo:hi].tobytes()
                    found = split_words(raw)
                    at.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                    letters.append(_LETTER.search(raw.decode("utf-8", "replace")) is not None)
                rows = words.filled()
                sums = np.stack([rows[a].sum(axis=0) for a in at])
                p = _softmax(sums[:, :-3] / np.maximum(sums[:, -3:-2], 1) + model.bias)
                best = p.argmax(axis=1)
                known = np.array(letters) & bool(model.labels)
                label = [model.labels[b] if k else "und" for b, k in zip(best, known)]
                score = np.where(known, p.max(axis=1), 0.0)
                once = np.stack([rows[np.unique(a), -2:].sum(axis=0) for a in at])
                refused = ~known | (score < model.reject_below) | too_strange(once[:, 0], once[:, 1], model.unseen_share)
                part = batch.slice(chunk.first, len(label))
                if passing:
                    yield part.filter(pa.array(~refused))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(label, pa.string()), pa.array(score), pa.array(refused)],
                        ["doc_id", "lang_pred", "score", "rejected"])
    return run


def labelled_sample(docs: DataFrame, usable: Column, per_label: int, total: int, least: int, id_col: str, text_col: str,
                    lang_col: str) -> list:
    """Rows of every language, chosen by hash: about ``total`` shared out evenly, at most ``per_label`` of each.

    A language gets about ``least`` rows (or all it has) even where that makes more than
    ``total``, and never less than one. The counts come from all rows; the sample is cut by a
    hash of the id, so no label's rows meet in one task.
    """
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    pool = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), draw.alias("draw"))
    counts = staged(pool.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("first")), "languages")
    each = max(least, min(per_label, total // max(1, counts.count())))
    picked = (pool.join(counts, "lang").where((F.col("draw") < F.lit(each) / F.col("n")) | (F.col("draw") == F.col("first")))
              .select("text", "lang").withColumn("at", F.xxhash64("text")))
    own = Window.partitionBy("lang").orderBy("at", "text")
    return (picked.withColumn("k", F.row_number().over(own)).where(F.col("k") <= 2 * each)  # repeated ids are drawn together
            .orderBy("at", "lang").select("text", "lang").collect())


def train(docs: DataFrame, usable: Column, per_label: int = 500, total: int = 6000, least: int = 50,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a sample of all languages: ``per_label`` rows of each, fewer (``total`` shared out, but ``least``) if there are many.

    Only rows are bounded, never languages: every non-null value is a class.
    """
    rows = labelled_sample(docs, usable, per_label, total, least, id_col, text_col, lang_col)
    return fit([r.text.encode() for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) per row, over whole texts.

    ``und`` with score 0 for null texts, texts without a letter, and under a model without
    labels, all of them rejected; ``rejected`` further says that the calibrated confidence is
    below its threshold or that too many 4-grams are unknown. Rows are independent, so repeated
    and null ids are kept as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 65,536 floats per language
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(_predict(shared, 1, False)), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns.

    Null texts and texts without a letter go, as do those beyond a calibrated threshold.
    Under a model without labels nothing can be judged, and every row stays.
    """
    if not model.labels:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(tidy(_predict(shared, docs.columns.index(text_col), True)), docs.schema)
