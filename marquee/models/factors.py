"""Factor tables: (index, vec, bias) rows for users and movies."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import vectors as V
from marquee.operators.score import predict


@dataclass
class FactorModel:
    users: DataFrame
    items: DataFrame
    rank: int
    mean: float = 0.0
    params: dict = field(default_factory=dict)
    history: list[float] = field(default_factory=list)
    val_history: list[float] = field(default_factory=list)  # from epoch 0, the start


def gaussian_vector(key: Column, dim: int, std: float, seed: int) -> Column:
    """Normal vector that depends on the key and seed only, not on the partitioning."""

    def uniform(part: int):
        return lambda d: (F.pmod(F.xxhash64(key, d, F.lit(seed), F.lit(part)), F.lit(1 << 40)) + 1.0) / float((1 << 40) + 1)

    def normal(d: Column) -> Column:
        return F.sqrt(-2.0 * F.log(uniform(0)(d))) * F.cos(2.0 * math.pi * uniform(1)(d)) * std

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), normal)


def random_factors(ids: DataFrame, key: str, rank: int, seed: int) -> DataFrame:
    """Normal start vectors of standard deviation 1/√rank, zero biases."""
    vec = gaussian_vector(F.col(key), rank, 1.0 / math.sqrt(rank), seed)
    return ids.select(key, vec.alias("vec"), F.lit(0.0).alias("bias"))


def warm_start(start: DataFrame, trained: DataFrame, key: str, rank: int, trained_rank: int) -> DataFrame:
    """Replace the first dimensions of ``start`` by the trained ones; biases stay."""
    k = min(rank, trained_rank)
    head = F.slice(F.col("_t"), 1, k)
    vec = F.when(F.col("_t").isNull(), F.col("vec"))
    vec = vec.otherwise(F.concat(head, F.slice("vec", k + 1, rank - k)) if rank > k else head)
    return start.join(trained.select(key, F.col("vec").alias("_t")), key, "left").select(
        key, vec.alias("vec"), "bias")


def concat_factors(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both models' vectors in one, first model first."""
    return first.select(key, F.col("vec").alias("_a")).join(
        second.select(key, F.col("vec").alias("_b")), key).select(key, F.concat("_a", "_b").alias("vec"))


def rmse(ratings: DataFrame, model: FactorModel) -> DataFrame:
    """Root mean squared error over all stored cells, explicit zeros included."""
    scored = predict(ratings.select("user_idx", "movie_idx", "rating_centered"), model.users, model.items, model.mean)
    error = F.col("rating_centered") - F.col("score")
    return scored.agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def gated_score(content: DataFrame, collaborative: DataFrame, gate: float = 0.0) -> DataFrame:
    """Content score plus σ(gate) times the collaborative score of the same pair."""
    weight = 1.0 / (1.0 + math.exp(-gate))
    other = collaborative.select("user_idx", "movie_idx", F.col("score").alias("_cf"))
    return content.join(other, ["user_idx", "movie_idx"]).select(
        "user_idx", "movie_idx", (F.col("score") + weight * F.col("_cf")).alias("score"))


def projection(vectors: DataFrame, key: str, dims: int = 2) -> DataFrame:
    """Principal-component map of vectors, for a picture of the latent space."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.select(key, array_to_vector("vec").alias("features"))
    reduced = PCA(k=dims, inputCol="features", outputCol="reduced").fit(data).transform(data)
    return reduced.select(key, *[
        F.get(vector_to_array("reduced"), F.lit(i)).alias(f"dim{i}") for i in range(dims)])


def early_stop(history: DataFrame, run: list[str], patience: int) -> DataFrame:
    """Best epoch and the epoch where training stops, per run of (epoch, loss) rows.

    Training stops ``patience`` epochs after the last improvement, or at the end.
    """
    from pyspark.sql import Window as W

    earlier = W.partitionBy(*run).orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*run).orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    best_before = F.min("loss").over(earlier)
    improved = best_before.isNull() | (F.col("loss") < best_before)
    marked = history.withColumn("_improved", improved).withColumn(
        "_best", F.max(F.when(F.col("_improved"), F.col("epoch"))).over(upto))
    stops = marked.withColumn("_stop", F.col("epoch") - F.col("_best") >= patience)
    ends = stops.groupBy(*run).agg(
        F.coalesce(F.min(F.when(F.col("_stop"), F.col("epoch"))), F.max("epoch")).alias("stop_epoch"))
    kept = stops.join(ends, run).where(F.col("epoch") <= F.col("stop_epoch"))
    return kept.groupBy(*run).agg(
        F.max("_best").alias("best_epoch"),
        F.min("loss").alias("best_loss"),
        F.max("stop_epoch").alias("stop_epoch"),
    )


def unit_rows(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.select(key, V.unit(F.col("vec")).alias("vec"))
