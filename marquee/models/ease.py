"""EASE^R item–item weights on block matrices.

The movie × movie matrices are cut into square blocks keyed (bi, bj). The Gram matrix keeps the
cells it has; its inverse and the weights are dense and built block by block; no task holds more
than a few blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.config import EASE_REG, TOP_KS
from marquee.operators.score import TOP_SCHEMA, _best, _blocks, _ragged, _top_table, top_k
from marquee.runtime import checkpointed, staged

BLOCK = 1024
PRODUCTS = 20_000_000  # products of one user that a task makes
STEP = 1_000_000       # products made at a time inside a task
HELD = 4_000_000       # products added up before they are passed on
RUN_COLUMNS = ("user_idx", "part", "movie_idx", "x", "slices")
MATRIX = "bi int, bj int, cells array<double>"


def ease_gram(
    train: DataFrame, n_items: int, block: int = BLOCK, binary: bool = False, rows_per_task: int = PRODUCTS,
) -> DataFrame:
    """Upper blocks of XᵀX as (bi, bj, at, cells), bi ≤ bj, without the ridge.

    A block holds the cells that have a common user, and the diagonal, as two arrays in the order
    of their place in the block. A rating travels once. A task multiplies the ratings of its users
    and adds up equal cells before they are shuffled; a user with more products than
    ``rows_per_task`` is cut into slices of the left side, each with all their ratings.
    """
    value = F.lit(1.0) if binary else F.col("rating_centered")
    rows = train.select("user_idx", "movie_idx", value.alias("x"))
    n = F.count("*")
    many = staged(train.groupBy("user_idx").agg(F.ceil(n * n / rows_per_task).cast("int").alias("slices")).where("slices > 1"), "hot-users")
    rows = rows.join(many, "user_idx", "left").fillna(1, ["slices"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    products = (
        rows.repartition("user_idx", "part").sortWithinPartitions("user_idx", "part", "movie_idx")
        .mapInArrow(_products(block), "src_idx int, dst_idx int, value double"))
    diagonal = train.sparkSession.range(n_items).select(
        F.col("id").cast("int").alias("src_idx"), F.col("id").cast("int").alias("dst_idx"), F.lit(0.0).alias("value"))
    cells = products.unionByName(diagonal).groupBy("src_idx", "dst_idx").agg(F.sum("value").alias("value"))
    at = F.col("src_idx") % block * block + F.col("dst_idx") % block
    packed = cells.groupBy(
        F.floor(F.col("src_idx") / block).cast("int").alias("bi"), F.floor(F.col("dst_idx") / block).cast("int").alias("bj")).agg(
        F.sort_array(F.collect_list(F.struct(at.alias("at"), "value"))).alias("e"))
    return packed.select("bi", "bj", F.col("e.at").alias("at"), F.col("e.value").alias("cells"))


def _products(block: int):
    """Cells (src, dst, value) of the users' products, src in the same block as dst or an earlier one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0
        for users in _user_runs(batches):
            for key, value in _pairs(*users, block):
                keys.append(key)
                values.append(value)
                held += len(key)
                if held >= HELD:
                    yield _summed_cells(keys, values)
                    keys, values, held = [], [], 0
        if held:
            yield _summed_cells(keys, values)

    return run


def _user_runs(batches):
    """Column slices holding whole (user, slice) runs."""
    carry = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = [batch.column(c).to_numpy() for c in RUN_COLUMNS]
        first = np.flatnonzero((now[0] != now[0][0]) | (now[1] != now[1][0]))
        same = bool(carry) and carry[-1][0][-1] == now[0][0] and carry[-1][1][-1] == now[1][0]
        if same and not len(first):
            carry.append(now)
            continue
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        whole = [*carry, [c[:cut] for c in now]]
        if sum(len(w[0]) for w in whole):
            yield [np.concatenate(c) for c in zip(*whole)]
        carry = [[c[cut:] for c in now]]
    if carry:
        yield [np.concatenate(c) for c in zip(*carry)]


def _pairs(users, parts, movies, x, slices, block):
    """(src << 32 | dst, product) of all pairs inside runs, at most about ``STEP`` at a time."""
    run = np.cumsum(np.append(False, (users[1:] != users[:-1]) | (parts[1:] != parts[:-1])))
    own = movies // block
    place = run * (own.max() + 1) + own
    lo, hi = np.searchsorted(place, place), np.searchsorted(run, run, side="right")
    nth = np.arange(len(run)) - np.searchsorted(run, run)
    left = np.flatnonzero(nth % slices == parts)
    count = (hi - lo)[left]
    upto = np.cumsum(count)
    start = 0
    while start < len(left):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + STEP, side="right")))
        some, counts = left[start:stop], count[start:stop]
        first = np.repeat(some, counts)
        second = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[some], counts)
        yield movies[first].astype(np.int64) << 32 | movies[second], x[first] * x[second]
        start = stop


def _summed_cells(keys, values) -> pa.RecordBatch:
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return pa.RecordBatch.from_arrays([
        pa.array((key[starts] >> 32).astype(np.int32)), pa.array((key[starts] & 0xFFFFFFFF).astype(np.int32)),
        pa.array(np.add.reduceat(value[order], starts))], ["src_idx", "dst_idx", "value"])


def _cells(matrix: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(matrix).ravel()
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))


def _block_table(bi: int, bj: int, matrix: np.ndarray) -> pa.Table:
    return pa.table({"bi": pa.array([bi], pa.int32()), "bj": pa.array([bj], pa.int32()), "cells": _cells(matrix)})


def gram_cells(gram: DataFrame, n_items: int, reg: float = EASE_REG, block: int = BLOCK) -> DataFrame:
    """XᵀX + λI as non-zero cells (src_idx, dst_idx, value) of both triangles."""
    cell = F.inline(F.arrays_zip("at", "cells")).alias("at", "value")
    upper = gram.select("bi", "bj", cell).select(
        (F.col("bi") * block + F.floor(F.col("at") / block)).cast("int").alias("src_idx"),
        (F.col("bj") * block + F.col("at") % block).cast("int").alias("dst_idx"), "value", "bi", "bj")
    mirrored = upper.where(F.col("bi") < F.col("bj")).select(
        F.col("dst_idx").alias("src_idx"), F.col("src_idx").alias("dst_idx"), "value")
    ridge = F.when(F.col("src_idx") == F.col("dst_idx"), F.lit(reg)).otherwise(F.lit(0.0))
    both = upper.select("src_idx", "dst_idx", "value").unionByName(mirrored)
    inside = (F.col("src_idx") < n_items) & (F.col("dst_idx") < n_items)
    return both.where(inside).withColumn("value", F.col("value") + ridge).where(F.col("value") != 0)


def ease_fit(gram: DataFrame, n_items: int, reg: float = EASE_REG, block: int = BLOCK) -> DataFrame:
    """Weights B with B_ij = −P_ij / P_jj, zero diagonal, P = (XᵀX + λI)⁻¹.

    Returns rows (src_idx, panel, w): the weights of one source movie towards the ``block``
    movies of a panel.
    """
    inverse = invert(_full(gram, n_items, reg, block), (n_items - 1) // block + 1, block)
    return _weights(inverse, (n_items - 1) // block + 1, n_items, block)


def _full(gram: DataFrame, n_items: int, reg: float, block: int) -> DataFrame:
    """Both triangles with the ridge; padding cells of the last block get a unit diagonal."""
    n_blocks = (n_items - 1) // block + 1
    pair = F.array_distinct(F.array(F.struct("bi", "bj"), F.struct(F.col("bj").alias("bi"), F.col("bi").alias("bj"))))
    spark = gram.sparkSession
    grid = spark.range(n_blocks * n_blocks).select(
        F.floor(F.col("id") / n_blocks).cast("int").alias("bi"), (F.col("id") % n_blocks).cast("int").alias("bj"))
    oriented = gram.withColumn("_to", F.explode(pair)).select(
        F.col("_to.bi").alias("bi"), F.col("_to.bj").alias("bj"), "at", "cells",
        (F.col("_to.bi") > F.col("_to.bj")).alias("flip"))

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bi, bj = key[0].as_py(), key[1].as_py()
        matrix = np.zeros((block, block))
        for at, cells, flip in zip(table["at"], table["cells"], table["flip"]):
            if cells.is_valid:
                stored = np.zeros((block, block))
                stored.ravel()[at.values.to_numpy()] = cells.values.to_numpy()
                matrix = stored.T if flip.as_py() else stored
        if bi == bj:
            real = np.arange(bi * block, (bi + 1) * block) < n_items
            matrix = matrix + np.diag(np.where(real, reg, 1.0))
        return _block_table(bi, bj, matrix)

    return checkpointed(
        grid.join(oriented, ["bi", "bj"], "left").groupBy("bi", "bj").applyInArrow(build, MATRIX))


def invert(matrix: DataFrame, n_blocks: int, block: int) -> DataFrame:
    """Inverse of a symmetric positive definite block matrix by block elimination.

    One round per block row: invert the pivot block, scale its row, and update every other
    block from its own row and column panel. A task sees at most three blocks; a round
    moves each panel block to the row or column that needs it.
    """
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    for k in range(n_blocks):
        pivot_row = matrix.where(F.col("bi") == k)
        pivot = pivot_row.where(F.col("bj") == k).select(everywhere.alias("bj"), F.col("cells").alias("pivot"))
        scaled = pivot_row.join(pivot, "bj").groupBy("bj").applyInArrow(_scaler(k, block), MATRIX)
        rows = scaled.select(everywhere.alias("bi"), "bj", F.lit("row").alias("role"), "cells")
        cols = matrix.where((F.col("bj") == k) & (F.col("bi") != k)).select(
            "bi", everywhere.alias("bj"), F.lit("col").alias("role"), "cells")
        own = matrix.where((F.col("bi") != k) & (F.col("bj") != k)).select(
            "bi", "bj", F.lit("own").alias("role"), "cells")
        matrix = checkpointed(
            own.unionByName(rows).unionByName(cols).groupBy("bi", "bj").applyInArrow(_updater(k, block), MATRIX))
    return matrix


def _scaler(k: int, block: int):
    def scale(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bj = key[0].as_py()
        inverse = np.linalg.inv(table["pivot"][0].values.to_numpy().reshape(block, block))
        if bj == k:
            return _block_table(k, k, inverse)
        return _block_table(k, bj, inverse @ table["cells"][0].values.to_numpy().reshape(block, block))

    return scale


def _updater(k: int, block: int):
    def update(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bi, bj = key[0].as_py(), key[1].as_py()
        held = {
            role.as_py(): cells.values.to_numpy().reshape(block, block)
            for role, cells in zip(table["role"], table["cells"])}
        if bi == k:
            return _block_table(bi, bj, held["row"])
        change = held["col"] @ held["row"]
        return _block_table(bi, bj, -change if bj == k else held["own"] - change)

    return update


def _weights(inverse: DataFrame, n_blocks: int, n_items: int, block: int) -> DataFrame:
    diagonal = inverse.where(F.col("bi") == F.col("bj")).select(
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("bi"), "bj", F.col("cells").alias("diag"))

    def scale(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bi, bj = key[0].as_py(), key[1].as_py()
        cells = table["cells"][0].values.to_numpy().reshape(block, block)
        weights = -cells / np.diag(table["diag"][0].values.to_numpy().reshape(block, block))
        if bi == bj:
            np.fill_diagonal(weights, 0.0)
        n_rows, n_cols = min(block, n_items - bi * block), min(block, n_items - bj * block)
        weights = np.ascontiguousarray(weights[:n_rows, :n_cols])
        offsets = np.arange(0, weights.size + 1, n_cols, dtype=np.int32)
        return pa.table({
            "src_idx": pa.array(np.arange(n_rows) + bi * block, pa.int32()),
            "panel": pa.array(np.full(n_rows, bj), pa.int32()),
            "w": pa.ListArray.from_arrays(pa.array(offsets), pa.array(weights.ravel())),
        })

    return inverse.join(diagonal, ["bi", "bj"]).groupBy("bi", "bj").applyInArrow(
        scale, "src_idx int, panel int, w array<double>")


def weight_cells(weights: DataFrame, block: int = BLOCK) -> DataFrame:
    """Weights as non-zero cells (src_idx, dst_idx, w)."""
    return weights.select("src_idx", "panel", F.posexplode("w").alias("at", "w")).where(F.col("w") != 0).select(
        "src_idx", (F.col("panel") * block + F.col("at")).cast("int").alias("dst_idx"), "w")


def ease_score(train: DataFrame, cells: DataFrame, value: str = "rating_centered") -> DataFrame:
    """x_u · B over weight cells: scores of every movie some rated movie points to.

    For sparse weights; :func:`ease_top_k` ranks with dense ones. Products are summed on
    the map side before they meet.
    """
    rated = train.select("user_idx", F.col("movie_idx").alias("src_idx"), F.col(value).alias("x"))
    return rated.join(cells, "src_idx").groupBy("user_idx", F.col("dst_idx").alias("movie_idx")).agg(
        F.sum(F.col("x") * F.col("w")).alias("score"))


def ease_top_k(
    train: DataFrame, weights: DataFrame, k: int = max(TOP_KS), value: str = "rating_centered",
    block: int = BLOCK, width: int = 256, user_block: int = 2048,
) -> DataFrame:
    """Best ``k`` unseen movies per user from dense weights.

    A task holds one user block's ratings and a ``width``-wide strip of the weights.
    """
    n_users = _blocks(train, "user_idx", user_block)
    strips_per_panel = -(-block // width)
    n_strips = (weights.agg(F.max("panel")).first()[0] + 1) * strips_per_panel
    ratings = train.select(
        "user_idx", F.struct("movie_idx", F.col(value).alias("x")).alias("cell"),
        F.floor(F.col("user_idx") / user_block).cast("int").alias("ub"))
    rated = ratings.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(n_strips - 1)))).select(
        "ub", "strip", "user_idx", F.col("cell.movie_idx").alias("movie_idx"), F.col("cell.x").alias("x"))
    part = F.explode(F.sequence(F.lit(0), F.lit(strips_per_panel - 1)))
    cut = weights.withColumn("_part", part).select(
        "src_idx", (F.col("panel") * strips_per_panel + F.col("_part")).alias("strip"),
        (F.col("panel") * block + F.col("_part") * width).alias("first"),
        F.slice("w", F.col("_part") * width + 1, F.lit(width)).alias("w")).where(F.size("w") > 0)
    strips = cut.withColumn("ub", F.explode(F.sequence(F.lit(0), F.lit(n_users - 1))))

    def rank(ratings_arrow: pa.Table, strip_arrow: pa.Table) -> pa.Table:
        if ratings_arrow.num_rows == 0 or strip_arrow.num_rows == 0:
            return _top_table([], [], [])
        ratings_arrow = ratings_arrow.sort_by("user_idx")
        first = strip_arrow["first"][0].as_py()
        rows, flat = _ragged(strip_arrow["w"])
        strip = flat.reshape(strip_arrow.num_rows, -1)
        item_ids = np.arange(first, first + strip.shape[1])
        sources = strip_arrow["src_idx"].to_numpy()
        by_source = np.argsort(sources)
        users, movies = ratings_arrow["user_idx"].to_numpy(), ratings_arrow["movie_idx"].to_numpy()
        x = ratings_arrow["x"].to_numpy()
        at = by_source[np.searchsorted(sources, movies, sorter=by_source)]
        user_ids, starts = np.unique(users, return_index=True)
        scores = np.empty((len(user_ids), strip.shape[1]))
        for row, (lo, hi) in enumerate(zip(starts, np.r_[starts[1:], len(users)])):
            scores[row] = x[lo:hi] @ strip[at[lo:hi]]
        inside = (movies >= first) & (movies < first + strip.shape[1])
        scores[np.searchsorted(user_ids, users[inside]), movies[inside] - first] = -np.inf
        return _best(user_ids, item_ids, scores, k)

    best = rated.groupBy("ub", "strip").cogroup(strips.groupBy("ub", "strip")).applyInArrow(rank, TOP_SCHEMA)
    return top_k(best, k)
