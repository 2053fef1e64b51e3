"""Clean ratings → k-core → split → indexes → centring, with the summary row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee import config
from marquee.operators import clean, prepare
from marquee.runtime import staged


@dataclass
class Preprocessed:
    interactions: DataFrame
    user_map: DataFrame
    movie_map: DataFrame
    cold: DataFrame
    stats: DataFrame

    def part_of(self, split: str) -> DataFrame:
        return self.interactions.where(F.col("split") == split).drop("split")


def preprocess(raw: DataFrame, order: list[str], **options) -> Preprocessed:
    """Everything from the raw log on; ``options`` are those of :func:`prepare_interactions`."""
    return prepare_interactions(staged(clean.clean_ratings(raw, order), "clean"), **options)


def prepare_interactions(
    ratings: DataFrame,
    min_user: int = config.MIN_USER_RATINGS, min_item: int = config.MIN_ITEM_RATINGS,
    train_ratio: float = config.TRAIN_RATIO, val_ratio: float = config.VAL_RATIO,
    cold_threshold: int = config.COLD_THRESHOLD,
) -> Preprocessed:
    """``ratings`` is clean and stored: the k-core rounds scan it repeatedly."""
    core = staged(prepare.kcore_filter(ratings, min_user, min_item), "core")
    split = staged(prepare.temporal_split(core, train_ratio, val_ratio), "split")
    user_map = staged(prepare.build_id_map(split, "user_id", "user_idx"), "user_map")
    movie_map = staged(prepare.build_id_map(split, "movie_id", "movie_idx"), "movie_map")
    indexed = prepare.apply_id_map(split, user_map, movie_map)
    # the means need no index, so the joins with the maps run once; rows without an id have no index
    train = split.where(F.col("split") == "train").dropna(subset=["user_id", "movie_id"])
    interactions = staged(prepare.mean_center(indexed, train), "interactions")
    cold = prepare.cold_users(interactions.where(F.col("split") == "train"), cold_threshold)
    return Preprocessed(
        interactions, user_map, movie_map, cold, stats_row(interactions, user_map, movie_map, cold))


def stats_row(interactions: DataFrame, user_map: DataFrame, movie_map: DataFrame, cold: DataFrame) -> DataFrame:
    sizes = interactions.agg(*[
        F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")])
    return sizes.withColumns({
        "n_users": user_map.agg(F.count("*")).scalar(),
        "n_movies": movie_map.agg(F.count("*")).scalar(),
        "n_cold": cold.agg(F.count("*")).scalar(),
    }).withColumn("density", F.col("n_train") / (F.col("n_users") * F.col("n_movies")) * 100.0).select(
        "n_users", "n_movies", "n_train", "n_val", "n_test", "n_cold", "density")
