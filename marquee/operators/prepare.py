"""From clean ratings to indexed, centred, time-split interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.config import (
    COLD_THRESHOLD, MIN_ITEM_RATINGS, MIN_SEQUENCE, MIN_USER_RATINGS, TRAIN_RATIO, VAL_RATIO,
)
from marquee.functions.ranking import dense_index, rank_within
from marquee.runtime import staged

_MONTH_SECONDS = 30 * 86_400


def history_bucket() -> Column:
    """Slice of a user's history for :func:`rank_within`; grows with the timestamp."""
    return F.floor(F.col("timestamp") / _MONTH_SECONDS)


def support_semi_join(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows whose key occurs at least ``k`` times."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    return df.join(counts.where(F.col("_n") >= k), key, "left_semi")


def kcore_filter(
    df: DataFrame, min_user: int = MIN_USER_RATINGS, min_item: int = MIN_ITEM_RATINGS,
    trace: list[dict] | None = None,
) -> DataFrame:
    """Largest subset where every user and every movie keeps enough ratings.

    Supports are counted once. A half round drops the keys whose support fell below the
    threshold and takes their rows off the other side's supports: one semi join of the log
    with the newly dropped keys, and none when no key falls. Only keys that lost rows are
    looked at again. The ratings are never rewritten; ``df`` should be a stored table.
    A null key is never dropped itself.
    """
    spark = df.sparkSession
    sides = (("movie_id", "user_id", min_item), ("user_id", "movie_id", min_user))
    support = {key: staged(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")), "kcore-support")
               for key, _, _ in sides}
    dead = {key: spark.createDataFrame([], df.select(key).schema) for key, _, _ in sides}
    lost: dict[str, DataFrame] = {}
    first, dropped = {"movie_id", "user_id"}, True
    while dropped:
        dropped = False
        for key, other, k in sides:
            rows = 0
            fallen = _below(support[key], lost.get(key), key, k, every=key in first)
            first.discard(key)
            fallen = staged(fallen.join(dead[key], key, "left_anti"), "kcore-rare")
            if not fallen.isEmpty():
                gone = (df.select(key, other).join(fallen, key, "left_semi").join(dead[other], other, "left_anti")
                        .groupBy(other).agg(F.count("*").alias("_lost")))
                gone = staged(gone, "kcore-lost")
                rows = gone.agg(F.coalesce(F.sum("_lost"), F.lit(0))).first()[0]
                dead[key] = staged(dead[key].unionByName(fallen), "kcore-dropped")
                lost[other] = gone if other not in lost else staged(
                    lost[other].unionByName(gone).groupBy(other).agg(F.sum("_lost").alias("_lost")), "kcore-lost")
            if trace is not None:
                trace.append({"key": key, "rows_dropped": rows})
            dropped = dropped or rows > 0
    return _alive(df, dead)


def _below(support: DataFrame, lost: DataFrame | None, key: str, k: int, every: bool) -> DataFrame:
    """Keys with fewer than ``k`` rows left: of all keys, or of those that lost rows."""
    if lost is None:
        return (support if every else support.limit(0)).where(F.col("_n") < k).select(key)
    left = F.col("_n") - F.coalesce("_lost", F.lit(0))
    return support.join(lost, key, "left" if every else "inner").where(left < k).select(key)


def _alive(df: DataFrame, dead: dict[str, DataFrame]) -> DataFrame:
    for key, keys in dead.items():
        df = df.join(keys, key, "left_anti")
    return df


def temporal_split(df: DataFrame, train_ratio: float = TRAIN_RATIO, val_ratio: float = VAL_RATIO) -> DataFrame:
    """Adds ``split``: the oldest part of each history trains, the newest tests.

    Equal timestamps are ordered by movie id.
    """
    ranked = rank_within(
        df, "user_id", [F.col("timestamp"), F.col("movie_id")], history_bucket(), "_rank", "_size")
    return ranked.withColumn("split", split_label(F.col("_rank"), F.col("_size"), train_ratio, val_ratio)).drop(
        "_rank", "_size")


def split_label(rank: Column, n: Column, train_ratio: float = TRAIN_RATIO, val_ratio: float = VAL_RATIO) -> Column:
    """Split of the ``rank``-th of ``n`` ratings; short histories keep one for validation."""
    wanted_train = F.greatest(F.lit(1), F.floor(n * F.lit(train_ratio)))
    wanted_val = F.greatest(F.lit(1), F.floor(n * F.lit(val_ratio)))
    short = n - wanted_train - wanted_val < 1
    n_train = F.when(short, F.greatest(F.lit(1), n - 2)).otherwise(wanted_train)
    n_val = F.when(short, F.lit(1)).otherwise(wanted_val)
    return F.when(rank <= n_train, "train").when(rank <= n_train + n_val, "val").otherwise("test")


def all_ids(key: str, *splits: DataFrame) -> DataFrame:
    """Distinct ids over the union of the splits."""
    out = splits[0].select(key)
    for split in splits[1:]:
        out = out.unionByName(split.select(key))
    return out.distinct()


def build_id_map(ids: DataFrame, key: str, index: str) -> DataFrame:
    """0-based position of each id in sorted order (strings sort as text)."""
    return dense_index(ids.select(key).distinct(), [F.col(key)], index).select(
        key, F.col(index).cast("int").alias(index))


def apply_id_map(df: DataFrame, user_map: DataFrame, movie_map: DataFrame) -> DataFrame:
    return df.join(movie_map, "movie_id").join(user_map, "user_id")


def user_means(train: DataFrame, key: str = "user_id") -> DataFrame:
    return train.groupBy(key).agg(F.avg("rating").alias("user_mean"))


def join_user_means(df: DataFrame, means: DataFrame, train: DataFrame, key: str = "user_id") -> DataFrame:
    """Attach each user's training mean; unknown users get the global training mean."""
    overall = train.agg(F.avg("rating")).scalar()
    return df.join(means, key, "left").withColumn("user_mean", F.coalesce("user_mean", overall))


def mean_center(df: DataFrame, train: DataFrame, key: str = "user_id") -> DataFrame:
    with_mean = join_user_means(df, user_means(train, key), train, key)
    return with_mean.withColumn("rating_centered", F.col("rating") - F.col("user_mean")).drop("user_mean")


def matrix_stats(train: DataFrame, n_users: Column, n_items: Column) -> DataFrame:
    """Stored cells (explicit zeros included), density in percent, range of the values."""
    return train.agg(
        F.count("*").alias("nnz"),
        F.min("rating_centered").alias("min_value"),
        F.max("rating_centered").alias("max_value"),
        F.avg("rating_centered").alias("mean_value"),
    ).withColumns({
        "n_users": n_users, "n_items": n_items,
        "density_pct": F.col("nnz") / (n_users * n_items) * 100.0,
    })


def user_positives(train: DataFrame, chunk: int = 4096) -> DataFrame:
    """Rated movies of each user as sorted arrays, one per slice of ``chunk`` movie ids.

    The slices bound every array, however long a history is.
    """
    return (
        train.groupBy("user_idx", F.floor(F.col("movie_idx") / chunk).cast("int").alias("chunk"))
        .agg(F.array_sort(F.collect_set("movie_idx")).alias("items"))
    )


def item_popularity(train: DataFrame) -> DataFrame:
    """Ratings per movie and the share of all ratings (the negative-sampling weight)."""
    total = train.agg(F.count("*")).scalar()
    return train.groupBy("movie_idx").agg(F.count("*").alias("cnt")).withColumn(
        "prob", F.col("cnt") / total)


def cold_users(train: DataFrame, threshold: int = COLD_THRESHOLD) -> DataFrame:
    return (
        train.groupBy("user_idx", "user_id").agg(F.count("*").alias("n_train"))
        .where(F.col("n_train") < threshold)
    )


def user_segment(users: DataFrame, train: DataFrame, threshold: int = COLD_THRESHOLD) -> DataFrame:
    """``cold`` or ``warm`` per user; users without any training row count as warm."""
    counts = train.groupBy("user_idx").agg(F.count("*").alias("n_train"))
    cold = F.col("n_train") < max(COLD_THRESHOLD, threshold)
    return users.join(counts, "user_idx", "left").select(
        "user_idx", F.when(cold, "cold").otherwise("warm").alias("segment"))


def user_sequences(train: DataFrame, min_len: int = MIN_SEQUENCE) -> DataFrame:
    """Each user's movies in time order as rows (user, position, movie)."""
    ranked = rank_within(
        train.select("user_idx", "timestamp", "movie_idx"), "user_idx",
        [F.col("timestamp"), F.col("movie_idx")], history_bucket(), "_rank", "seq_len")
    return ranked.where(F.col("seq_len") >= min_len).select(
        "user_idx", (F.col("_rank") - 1).alias("pos"), "movie_idx")
