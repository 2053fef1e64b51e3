"""Explicit matrix factorisation of centred ratings by alternating least squares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.config import ALS_ITERATIONS, ALS_RANK, ALS_REG, ALS_TOL, SEED
from marquee.functions import vectors as V
from marquee.models.factors import FactorModel, random_factors, rmse
from marquee.operators.blocks import Sliced, cut, expanded, met, panels, walked
from marquee.runtime import checkpointed, staged

HOT_ROWS = 1_000_000  # an entity with more ratings is accumulated by several tasks
GATHERED = 16_000_000  # numbers that a task gathers: its ratings times the rank


def mllib_als(
    train: DataFrame, rank: int = ALS_RANK, iterations: int = ALS_ITERATIONS,
    reg: float = ALS_REG, seed: int = SEED,
) -> FactorModel:
    """MLlib's blocked ALS. It scales λ by the entity's support and has no biases."""
    fitted = ALS(
        rank=rank, maxIter=iterations, regParam=reg, seed=seed, userCol="user_idx", itemCol="movie_idx",
        ratingCol="rating_centered", implicitPrefs=False, checkpointInterval=5,
    ).fit(train.select("user_idx", "movie_idx", F.col("rating_centered").cast("float").alias("rating_centered")))

    def table(factors: DataFrame, key: str) -> DataFrame:
        return factors.select(F.col("id").alias(key), V.as_doubles(F.col("features")).alias("vec"), F.lit(0.0).alias("bias"))

    return FactorModel(
        table(fitted.userFactors, "user_idx"), table(fitted.itemFactors, "movie_idx"), rank,
        params={"rank": rank, "reg": reg, "iterations": iterations})


def als_fit(
    train: DataFrame, user_map: DataFrame, movie_map: DataFrame, rank: int = ALS_RANK,
    iterations: int = ALS_ITERATIONS, reg: float = ALS_REG, tol: float = ALS_TOL, seed: int = SEED,
    residual: str = "full",
) -> FactorModel:
    """Biased variant: alternate half steps until the training RMSE gains less than ``tol``."""
    model = FactorModel(
        checkpointed(random_factors(user_map, "user_idx", rank, seed)),
        checkpointed(random_factors(movie_map, "movie_idx", rank, seed + 1)),
        rank, params={"rank": rank, "reg": reg, "iterations": iterations, "residual": residual})
    sides = (("user_idx", "movie_idx"), ("movie_idx", "user_idx"))
    hot = {key: hot_entities(train, key) for key, _ in sides}
    stored = {key: rating_slices(train, key, other, rank, hot[key]) for key, other in sides}
    previous = float("inf")
    for round_no in range(1, iterations + 1):
        model.users = checkpointed(als_half_step(
            train, "user_idx", "movie_idx", model.items, model.users, rank, reg, residual, hot["user_idx"], stored["user_idx"]))
        model.items = checkpointed(als_half_step(
            train, "movie_idx", "user_idx", model.users, model.items, rank, reg, residual, hot["movie_idx"], stored["movie_idx"]))
        current = rmse(train, model).first()[0]
        model.history.append(current)
        if round_no > 1 and previous - current < tol:
            break
        previous = current
    return model


def hot_entities(train: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame | None:
    """Entities with more than ``rows`` ratings (at most nnz / rows of them), or None."""
    hot = staged(
        train.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > rows).select(key), "hot")
    return None if hot.isEmpty() else hot


def rating_slices(train: DataFrame, entity: str, other: str, rank: int, hot: DataFrame | None = None) -> Sliced:
    """Ratings by entity, those of ``hot`` left out; stored once, they serve every half step of that side."""
    rows = train.select(entity, other, F.col("rating_centered").cast("double").alias("y"))
    normal = rows if hot is None else rows.join(hot, entity, "left_anti")
    return cut(normal, entity, other, most_rows=max(GATHERED // rank, 4096), whole=True)


def als_half_step(
    train: DataFrame, entity: str, other: str, fixed: DataFrame, current: DataFrame,
    rank: int, reg: float, residual: str = "full", hot: DataFrame | None = None,
    stored: Sliced | None = None,
) -> DataFrame:
    """New (entity, vec, bias) with the other side fixed.

    Bias Σres/(n+λ), then (QᵀQ+λI)p = Qᵀ(res−bias); entities without ratings get zeros.
    ``residual='full'`` fits r − b_other; ``'reference'`` first subtracts the entity's
    present factor score, as the published model does.

    Ratings are cut into slices by entity and meet the stored panels of the fixed side, so no
    vector travels with a rating, and a task solves its entities itself. Entities in ``hot``
    spread over several tasks whose partial systems are then added up. ``stored`` are the
    :func:`rating_slices` of ``train`` where several half steps share them.
    """
    reference = residual == "reference"
    terms = fixed.select(F.col(other).alias("node"), F.concat("vec", F.array("bias")).alias("vec"))
    matrix = stored or rating_slices(train, entity, other, rank, hot)
    partials = walked(matrix, panels(terms, matrix.sources), _gathered(entity, rank, reg, reference), (
        f"{entity} int, system array<double>" if reference else f"{entity} int, solved array<double>"))
    if hot is not None:
        spread = train.join(hot, entity, "left_semi").join(fixed.select(other, "vec", "bias"), other).select(
            entity, other, (F.col("rating_centered") - F.col("bias")).alias("y"), "vec").withColumn("_salt", F.floor(F.col(other) / 65_536))
        pieces = _accumulate(spread, [entity, "_salt"], entity, rank)
        merged = pieces.groupBy(entity).agg(
            vector_to_array(Summarizer.sum(array_to_vector("system"))).alias("system"))
        if not reference:
            blank = merged.select(entity, V.zeros(rank).alias("present"), "system")
            merged = blank.mapInArrow(_solver(entity, rank, reg, False), f"{entity} int, vec array<double>, bias double").select(
                entity, F.concat("vec", F.array("bias")).alias("solved"))
        partials = partials.unionByName(merged)
    if not reference:
        return current.select(entity).join(partials, entity, "left").select(
            F.col(entity).cast("int").alias(entity), F.coalesce(F.slice("solved", 1, rank), V.zeros(rank)).alias("vec"),
            F.coalesce(F.get("solved", F.lit(rank)), F.lit(0.0)).alias("bias"))
    systems = current.select(entity, F.col("vec").alias("present")).join(partials, entity, "left")
    return systems.mapInArrow(
        _solver(entity, rank, reg, True), f"{entity} int, vec array<double>, bias double")


def _gathered(entity: str, rank: int, reg: float, as_system: bool):
    """The system or the solution of each entity of a task, from slices (entity, other, y) and panels (vec, bias)."""
    upper = np.triu_indices(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for _, _, row, nodes, cells in met(batches):
            ids, others, y = (c.to_numpy(zero_copy_only=False) for c in row)
            by_node = np.argsort(nodes, kind="stable")
            place, at = expanded(nodes[by_node], others)
            terms = cells.reshape(-1, rank + 1)[by_node[place]]
            found.append((ids[at], y[at] - terms[:, -1], terms[:, :-1]))
        if not found:
            return
        ids, y, q = (np.concatenate(c) for c in zip(*found))
        found.clear()
        order = np.argsort(ids, kind="stable")
        own, first = np.unique(ids[order], return_index=True)
        ends, solve = np.append(first[1:], len(ids)), _solving(rank, reg, False)
        for lo in range(0, len(own), 1024):
            out = []
            for b, e in zip(first[lo:lo + 1024], ends[lo:lo + 1024]):
                mine = order[b:e]
                system = _system(q[mine], y[mine], upper)
                out.append(system if as_system else np.append(*solve(system, None)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[lo:lo + 1024].astype(np.int32)), _lists(np.stack(out))], [entity, "system" if as_system else "solved"])
    return run


def _system(q: np.ndarray, y: np.ndarray, upper: tuple) -> np.ndarray:
    """[QᵀQ upper | Qᵀy | Σq | Σy | n] flattened."""
    return np.concatenate([(q.T @ q)[upper], q.T @ y, q.sum(axis=0), [y.sum(), float(len(y))]])


def _accumulate(rows: DataFrame, keys: list[str], entity: str, rank: int) -> DataFrame:
    """Normal equations per run of equal keys."""
    upper = np.triu_indices(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_system = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys_now = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
            q = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, rank)
            y = batch.column("y").to_numpy()
            starts = np.flatnonzero(np.r_[True, np.any(keys_now[1:] != keys_now[:-1], axis=1)])
            ids, systems = [], []
            for lo, hi in zip(starts, np.r_[starts[1:], batch.num_rows]):
                key, system = tuple(keys_now[lo]), _system(q[lo:hi], y[lo:hi], upper)
                if key == open_key:
                    open_system = open_system + system
                    continue
                if open_key is not None:
                    ids.append(open_key[0])
                    systems.append(open_system)
                open_key, open_system = key, system
            if ids:
                yield _system_batch(entity, ids, systems)
        if open_key is not None:
            yield _system_batch(entity, [open_key[0]], [open_system])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        run, f"{entity} int, system array<double>")


def _system_batch(entity: str, ids: list, systems: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int32()), _lists(np.stack(systems))], [entity, "system"])


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def _solving(rank: int, reg: float, own_score: bool):
    """(vector, bias) of a system."""
    upper = np.triu_indices(rank)
    n_upper = len(upper[0])

    def solve(system: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, float]:
        gram = np.zeros((rank, rank))
        gram[upper] = system[:n_upper]
        gram = gram + np.triu(gram, 1).T
        qty, q_sum = system[n_upper:n_upper + rank], system[n_upper + rank:n_upper + 2 * rank]
        y_sum, n = system[-2], system[-1]
        if own_score:
            qty, y_sum = qty - gram @ present, y_sum - q_sum @ present
        bias = y_sum / (n + reg)
        left, right = gram + reg * np.eye(rank), qty - bias * q_sum
        try:
            return np.linalg.solve(left, right), bias
        except np.linalg.LinAlgError:
            return np.linalg.lstsq(left, right, rcond=None)[0], bias

    return solve


def _solver(entity: str, rank: int, reg: float, own_score: bool):
    solve = _solving(rank, reg, own_score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, biases = np.zeros((batch.num_rows, rank)), np.zeros(batch.num_rows)
            present, systems = batch.column("present"), batch.column("system")
            for i in range(batch.num_rows):
                if systems[i].is_valid:
                    vecs[i], biases[i] = solve(
                        systems[i].values.to_numpy(), present[i].values.to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(entity), _lists(vecs), pa.array(biases)], [entity, "vec", "bias"])

    return run
