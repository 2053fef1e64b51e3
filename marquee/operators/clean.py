"""Cleaning of the rating log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.config import RATING_RANGE, RELEVANT_RATING, USER_PREFIX


def standardise_ratings(df: DataFrame, prefix: str = USER_PREFIX) -> DataFrame:
    """Prefixed string user id, narrow typed columns; other columns pass through."""
    return df.withColumns({
        "user_id": F.concat(F.lit(prefix), F.col("user_id").cast("string")),
        "movie_id": F.col("movie_id").cast("int"),
        "rating": F.col("rating").cast("double"),
        "timestamp": F.col("timestamp").cast("bigint"),
    })


def validate_ratings(df: DataFrame, low: float = RATING_RANGE[0], high: float = RATING_RANGE[1]) -> DataFrame:
    return df.dropna(subset=["user_id", "movie_id", "rating"]).where(F.col("rating").between(low, high))


def dedup_keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last along ``order``.

    ``order`` must be total: a table has no file order. An aggregate keeps the best row of
    each map task, so a key with very many copies never meets in one sort.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    named = [c for c in order if c not in keys]
    best = F.max(F.struct(*named, *rest)).alias("_last")
    return df.groupBy(*keys).agg(best).select(*keys, "_last.*").select(*df.columns)


def clean_ratings(df: DataFrame, order: list[str]) -> DataFrame:
    """Standardise, validate and keep the last rating of each (user, movie)."""
    valid = validate_ratings(standardise_ratings(df))
    return dedup_keep_last(valid, ["user_id", "movie_id"], order).select(
        "user_id", "movie_id", "rating", "timestamp")


def drop_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows lost by cleaning and the size of what is left, as one row."""
    n_before = before.agg(F.count("*")).scalar()
    return after.agg(
        F.count("*").alias("n_ratings"),
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("movie_id").alias("n_movies"),
    ).withColumn("n_dropped", n_before - F.col("n_ratings"))


def positives(df: DataFrame, threshold: float = RELEVANT_RATING) -> DataFrame:
    return df.where(F.col("rating") >= threshold)


def relevant_by_centred(df: DataFrame) -> DataFrame:
    """Alternative relevance: rated above the user's own mean."""
    return df.where(F.col("rating_centered") > 0)


def preview(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def id_range(df: DataFrame, id_col: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.min(id_col).cast("bigint").alias("min_id"),
        F.max(id_col).cast("bigint").alias("max_id"),
    )
