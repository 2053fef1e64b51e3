"""Full-catalogue scoring and top-k, block against block.

Users are cut into blocks by index, movies by the length of their vectors. Both are stored
once; a task takes its user blocks through the stored movie blocks one after another, scores
them as matrix products and keeps the best ``k`` per user, so neither the score matrix nor a
whole catalogue is ever held or shuffled anywhere. A task reads its users once per partition of
movies and each movie block once, however many user blocks it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.config import TOP_KS
from marquee.functions import vectors as V
from marquee.functions.ranking import rank_within, top_n_per_key
from marquee.operators.blocks import pair_scores
from marquee.runtime import checkpointed, task_slots

RANK_DECIMALS = 9  # ties are decided on scores rounded this far, so float noise cannot reorder
USER_BLOCK = 2048
ITEM_BLOCK = 4096
ITEM_PART = 65_536  # movies of a partition
TASK_USERS = 131_072  # users of a task at most
# Spark reads a checkpoint file by a stream that holds on to its last rows, up to so many (objectStreamReset), and a
# task holds its streams to its end; so many empty rows behind the blocks make it let go of them.
EMPTY_ROWS = 100
STEP = 256          # users scored at a time inside a task
USER_BYTES = ("users", "user_vecs", "seen_rows", "seen_movies")
TOP_SCHEMA = "user_idx int, movie_idx int, score double"


def seen_items(train: DataFrame) -> DataFrame:
    return train.select("user_idx", "movie_idx").distinct()


def mask_seen(scores: DataFrame, seen: DataFrame) -> DataFrame:
    """Drop scored pairs the user already rated."""
    return scores.join(seen, ["user_idx", "movie_idx"], "left_anti")


def score_user(items: DataFrame, user_vec: Column, user_bias: Column | None = None) -> DataFrame:
    """Scores of all movies for one user given as scalar subqueries."""
    located = items.withColumn("_p", user_vec)
    score = V.dot(F.col("vec"), F.col("_p")) + F.col("bias")
    return located.select(
        "movie_idx", (score if user_bias is None else score + user_bias).alias("score"))


def predict(pairs: DataFrame, users: DataFrame, items: DataFrame, mean: float = 0.0) -> DataFrame:
    """μ + b_u + b_i + p·q for the given pairs.

    No exchange carries a vector per pair: pairs are cut by user and taken through stored
    panels of movie vectors.
    """
    left, right = ((side.select(key, "vec", "bias").where(F.col(key).isNotNull()), key) for side, key in (
        (users, "user_idx"), (items, "movie_idx")))
    dim = max(1, *[side.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0] for side, _ in (left, right)])
    targets, sources = (side.select(F.col(key).alias("node"), _with_bias(dim).alias("vec")) for side, key in (left, right))
    columns = ["movie_idx", "user_idx", *[c for c in pairs.columns if c not in ("movie_idx", "user_idx")]]
    scored = pair_scores(pairs.select(*columns), "user_idx", "movie_idx", targets, sources, dim, "score")
    return scored.withColumn("score", F.col("score") + F.lit(float(mean)))


def _with_bias(dim: int) -> Column:
    """``dim`` cells, the bias and the length; the length is -1 where a number is missing."""
    missing = F.col("vec").isNull() | F.col("bias").isNull() | F.exists("vec", lambda x: x.isNull())
    cells = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.get("vec", i), F.lit(0.0)))
    return F.concat(cells, F.array(F.coalesce("bias", F.lit(0.0)), F.when(missing, -1.0).otherwise(F.size("vec").cast("double"))))


def top_k(scores: DataFrame, k: int = max(TOP_KS)) -> DataFrame:
    """Best ``k`` finite scores per user of a score table, ties by movie index."""
    finite = scores.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    order = [F.round("score", RANK_DECIMALS).desc(), F.col("movie_idx")]
    return top_n_per_key(finite, "user_idx", order, k)


def item_rank(scores: DataFrame, pairs: DataFrame, bucket_width: float = 1.0) -> DataFrame:
    """1-based position of the given pairs in the user's full ranking.

    Scores are ranked in slices ``bucket_width`` wide, so a long list spreads over tasks.
    """
    falling = -F.round("score", RANK_DECIMALS)
    ranked = rank_within(
        scores.select("user_idx", "movie_idx", "score"), "user_idx", [falling, F.col("movie_idx")],
        F.floor(falling / bucket_width), "rank", "_n")
    wanted = pairs.select("user_idx", "movie_idx")
    return ranked.join(wanted, ["user_idx", "movie_idx"], "left_semi").select("user_idx", "movie_idx", "rank")


def top_k_dot(
    users: DataFrame, items: DataFrame, seen: DataFrame, k: int = max(TOP_KS), mean: float = 0.0,
    user_block: int = USER_BLOCK, item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """Best ``k`` unseen movies per user for μ + b_u + b_i + p·q.

    ``users`` is (user_idx, vec, bias), ``items`` (movie_idx, vec, bias). Movie blocks come in
    falling order of |q| + b_i. No score exceeds |p||q| + b_u + b_i + μ, so a user leaves out a
    block that cannot reach their ``k``-th best so far.
    """
    # fresh column names: both sides may come from one node table
    left = users.where("user_idx is not null").select(
        "user_idx", F.col("vec").alias("user_vec"), (F.col("bias") + mean).alias("user_bias"))
    right = items.where("movie_idx is not null").select(
        "movie_idx", F.col("vec").alias("item_vec"), F.col("bias").alias("item_bias"))
    user_blocks = _user_blocks(left, seen, user_block)
    # users meet the head of a partition of movies, and the walker behind a task's users meets its blocks;
    # neighbouring partitions of the product share their users: a task takes its users through all movies
    meets = (F.col("ub").isNull() != F.col("at").isNull()) & F.col("users").isNotNull() & F.col("movies").isNotNull()
    # (the hint keeps Spark from broadcasting blocks that were small on disk, being compressed)
    pairs = user_blocks.join(_item_blocks(right, item_block).hint("shuffle_replicate_nl"), meets).coalesce(user_blocks.rdd.getNumPartitions())
    return top_k(pairs.mapInArrow(_rank_pairs(k), TOP_SCHEMA), k)


def _user_blocks(left: DataFrame, seen: DataFrame, width: int) -> DataFrame:
    """One row per block of users, as bytes: numbers, vectors (p, b_u, 1), and (row, movie) seen, by movie.

    A partition holds the blocks of one task and ends with a row without a block, the walker, and empty rows.
    """
    block = F.floor(F.col("user_idx") / width).cast("int").alias("ub")
    known = seen.where("user_idx is not null and movie_idx is not null").select("user_idx", "movie_idx", block)

    def pack(u: pa.Table, known: pa.Table) -> pa.Table:
        if u.num_rows == 0:
            return pa.table({c: pa.array([], pa.binary()) for c in USER_BYTES}).add_column(0, "ub", pa.array([], pa.int32()))
        ids, movies = u["user_idx"].to_numpy(), known["movie_idx"].to_numpy().astype(np.int32)
        by_id = np.argsort(ids, kind="stable")
        rows, at = _expanded(ids[by_id], known["user_idx"].to_numpy())
        rows, movies = by_id[rows].astype(np.int32), movies[at]
        order = np.argsort(movies, kind="stable")
        vecs = np.column_stack([_matrix(u["user_vec"]), u["user_bias"].to_numpy(), np.ones(len(ids))])
        cells = (ids.astype(np.int32), vecs, rows[order], movies[order])
        return pa.table({"ub": u["ub"][:1], **{c: pa.array([x.tobytes()]) for c, x in zip(USER_BYTES, cells)}})

    packed = left.select("*", block).groupBy("ub").cogroup(known.groupBy("ub")).applyInArrow(
        pack, f"ub int, {', '.join(f'{c} binary' for c in USER_BYTES)}")
    blocks = _blocks(left, "user_idx", width)
    held = max(1, min(TASK_USERS // width, blocks // (2 * task_slots(left.sparkSession))))
    parts = max(1, -(-blocks // held))

    def with_walker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([task] * batch.num_rows, pa.int32()), *batch.columns], ["task", "ub", *USER_BYTES])
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([x], pa.int32()) for x in (task, None)], *[pa.array([b""], pa.binary())] * len(USER_BYTES)], ["task", "ub", *USER_BYTES])
        yield _empty_rows({"task": pa.int32(), "ub": pa.int32()} | dict.fromkeys(USER_BYTES, pa.binary()))

    return checkpointed(packed.repartitionById(
        parts, F.pmod(F.floor(F.col("ub") / held), F.lit(parts)).cast("int")).mapInArrow(
        with_walker, f"task int, ub int, {', '.join(f'{c} binary' for c in USER_BYTES)}"))


def _item_blocks(right: DataFrame, width: int) -> DataFrame:
    """One row per block of movies, the longest vectors first: bounds, and as bytes numbers and vectors (q, 1, b_i).

    Each partition begins with a row without a place, its head, and ends with empty rows.
    """
    length = F.sqrt(V.squared_norm(F.col("item_vec"))) + F.col("item_bias")
    order = [length.desc(), F.col("movie_idx")]
    copy = F.row_number().over(W.partitionBy("movie_idx").orderBy(length.desc()))
    right = right.withColumn("masked", copy == 1)  # of a movie given more than once, one row is masked
    parts = max(1, -(-right.count() // ITEM_PART))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        yield pa.RecordBatch.from_pydict(
            {"at": pa.array([None], pa.int64()), "length": [0.0], "item_bias": [0.0], "movies": [b""], "masked": [b""], "item_vecs": [b""]})
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= width:
                table = pa.Table.from_batches(held)
                yield _item_block(table.slice(0, width))
                held, n = table.slice(width).to_batches(), n - width
        if n:
            yield _item_block(pa.Table.from_batches(held))
        yield _empty_rows({"at": pa.int64(), "length": pa.float64(), "item_bias": pa.float64()}
                          | dict.fromkeys(("movies", "masked", "item_vecs"), pa.binary()))

    return checkpointed(right.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        pack, "at bigint, length double, item_bias double, movies binary, masked binary, item_vecs binary"))


def _empty_rows(types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: pa.nulls(EMPTY_ROWS, kind) for name, kind in types.items()})


def _item_block(items: pa.Table) -> pa.RecordBatch:
    items = items.sort_by("movie_idx")
    q, bias = _matrix(items["item_vec"]), items["item_bias"].to_numpy()
    vecs = np.column_stack([q, np.ones(len(q)), bias])
    return pa.RecordBatch.from_pydict({
        "at": [0], "length": [float(np.sqrt((q * q).sum(axis=1)).max())], "item_bias": [float(bias.max())],
        "movies": [items["movie_idx"].to_numpy().astype(np.int32).tobytes()],
        "masked": [items["masked"].to_numpy().astype(bool).tobytes()], "item_vecs": [vecs.tobytes()]})


def _rank_pairs(k: int):
    """Best ``k`` movies of the users of all (user block, movie block) rows that a task sees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, dict[int, _BestLists]] = {}  # by task and block
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                ub, own = column["ub"][i].as_py(), lists.setdefault(column["task"][i].as_py(), {})
                if ub is not None:
                    if ub not in own:
                        own[ub] = _BestLists(k, *[column[c][i].as_buffer() for c in USER_BYTES])
                    continue
                block = (column["length"][i].as_py(), column["item_bias"][i].as_py(),
                         np.frombuffer(column["movies"][i].as_buffer(), np.int32),
                         np.frombuffer(column["masked"][i].as_buffer(), bool),
                         np.frombuffer(column["item_vecs"][i].as_buffer()))
                for best in own.values():
                    best.add(*block)
        for own in lists.values():
            for best in own.values():
                yield from best.table().to_batches()

    return run


class _BestLists:
    """The best movies so far of a block of users."""

    def __init__(self, k: int, ids, vecs, seen_rows, seen_movies):
        self.k, self.ids = k, np.frombuffer(ids, np.int32).copy()
        self.vecs = np.frombuffer(vecs).reshape(len(self.ids), -1).copy()
        self.seen_rows, self.seen_movies = (np.frombuffer(x, np.int32).copy() for x in (seen_rows, seen_movies))
        self.norms = np.sqrt((self.vecs[:, :-2] ** 2).sum(axis=1))
        self.longest, self.most, self.widest = self.norms.max(), self.vecs[:, -2].max(), np.abs(self.vecs[:, -2]).max()
        self.scores = np.full((len(self.ids), k), -np.inf)
        self.movies = np.full((len(self.ids), k), np.iinfo(np.int32).max, np.int32)
        self.last = np.full(len(self.ids), -np.inf)  # rounded score of the k-th movie

    def add(self, length: float, bias: float, movies: np.ndarray, masked: np.ndarray, item_vecs: np.ndarray) -> None:
        # no user's bound is above this one; where it is no number the users are looked at one by one
        top = self.longest * length
        if np.round(top + self.most + bias + 1e-11 * (top + self.widest + abs(bias)), RANK_DECIMALS) < self.last.min():
            return
        q = item_vecs.reshape(len(movies), -1)
        own = self.vecs[:, -2]
        bound = self.norms * length + own + bias
        bound = np.round(bound + 1e-11 * (self.norms * length + np.abs(own) + abs(bias)), RANK_DECIMALS)
        # bounds that are no number hold nothing back
        beaten = (bound < self.last) | ((bound == self.last) & (movies[0] > self.movies[:, -1]))
        active = np.flatnonzero(~beaten)
        if not len(active):
            return
        hit, at = _expanded(movies, self.seen_movies)
        masked_rows, masked_cols = self.seen_rows[at[masked[hit]]], hit[masked[hit]]
        for lo in range(0, len(active), STEP):
            rows = active[lo:lo + STEP]
            scores = self.vecs[rows] @ q.T
            place = np.searchsorted(rows, masked_rows)
            inside = (place < len(rows)) & (rows[np.minimum(place, len(rows) - 1)] == masked_rows)
            scores[place[inside], masked_cols[inside]] = -np.inf
            local, cols = np.nonzero(scores >= (self.last[rows] - 10.0 ** -RANK_DECIMALS)[:, None])
            if len(local) > 2 * self.k * len(rows):
                local, cols = _best_cells(scores, self.k)
            values = scores[local, cols]
            real = np.isfinite(values)
            self._merge(rows[local[real]], values[real], movies[cols[real]])

    def _merge(self, rows: np.ndarray, values: np.ndarray, movies: np.ndarray) -> None:
        touched = np.unique(rows)
        rows = np.concatenate([np.repeat(touched, self.k), rows])
        values = np.concatenate([self.scores[touched].ravel(), values])
        movies = np.concatenate([self.movies[touched].ravel(), movies])
        order = np.lexsort([movies, -np.round(values, RANK_DECIMALS), rows])
        rows = rows[order]
        starts = np.searchsorted(rows, touched)
        best = order[starts[:, None] + np.arange(self.k)]
        self.scores[touched], self.movies[touched] = values[best], movies[best]
        self.last[touched] = np.round(self.scores[touched, -1], RANK_DECIMALS)

    def table(self) -> pa.Table:
        rows, place = np.nonzero(np.isfinite(self.scores))
        return _top_table(self.ids[rows], self.movies[rows, place], self.scores[rows, place])


def _expanded(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (position in ``ordered``, position in ``wanted``) of equal numbers; ``ordered`` is sorted."""
    lo, hi = np.searchsorted(ordered, wanted), np.searchsorted(ordered, wanted, side="right")
    count = hi - lo
    at = np.repeat(np.arange(len(wanted)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[at], at


def _blocks(df: DataFrame, index: str, width: int) -> int:
    top = df.agg(F.max(index)).first()[0]
    return 1 if top is None else top // width + 1


def _best(user_ids: np.ndarray, item_ids: np.ndarray, scores: np.ndarray, k: int) -> pa.Table:
    """Best ``k`` per row of a score block whose columns are sorted by movie index."""
    rows, cols = _best_cells(scores, k)
    return _top_table(user_ids[rows], item_ids[cols], scores[rows, cols])


def _best_cells(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the best ``k`` per row, columns sorted by movie index.

    Scores equal to the ``k``-th after rounding are taken in movie order until ``k`` is full.
    """
    scores[~np.isfinite(scores)] = -np.inf
    half = 0.5 * 10.0 ** -RANK_DECIMALS
    if scores.shape[1] > k:
        kth = np.round(np.partition(scores, -k, axis=1)[:, -k], RANK_DECIMALS)[:, None]
        above = scores > kth + half
        tied = (scores >= kth - half) & ~above & np.isfinite(scores)
        room = k - above.sum(axis=1, dtype=np.int32)
        return np.nonzero(above | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= room[:, None])))
    return np.nonzero(np.isfinite(scores))


def _top_table(users, items, scores) -> pa.Table:
    return pa.table({
        "user_idx": pa.array(users, pa.int32()),
        "movie_idx": pa.array(items, pa.int32()),
        "score": pa.array(scores, pa.float64()),
    })


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Equal-length list column as a dense matrix."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every element of a list column (nulls hold nothing)."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten().to_numpy(zero_copy_only=False)
