"""Descriptive statistics of ratings and item metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.config import ACTIVITY_EDGES, NO_GENRE
from marquee.functions import scalars as S
from marquee.functions.ranking import dense_index
from marquee.runtime import staged


def dataset_stats(ratings: DataFrame) -> DataFrame:
    density = F.col("n_ratings") / (F.col("n_users") * F.col("n_movies")) * 100.0
    return ratings.agg(
        F.count("*").alias("n_ratings"),
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("movie_id").alias("n_movies"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
        F.avg("rating").alias("mean_rating"),
    ).withColumn("density_pct", density).withColumn("sparsity_pct", 100.0 - density)


def value_distribution(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(col)


def support(df: DataFrame, key: str) -> DataFrame:
    """Rows per key."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def support_summary(df: DataFrame, key: str) -> DataFrame:
    return support(df, key).agg(
        F.avg("n").alias("mean"),
        F.percentile("n", F.lit(0.5)).alias("median"),
        F.percentile("n", F.lit(0.95)).alias("p95"),
        F.max("n").alias("max"),
    )


def below_threshold(df: DataFrame, key: str, threshold: int) -> DataFrame:
    low = F.col("n") < threshold
    return support(df, key).agg(
        F.count_if(low).alias("n_below"), F.avg(low.cast("double") * 100.0).alias("pct_below"))


def histogram(
    df: DataFrame, value: Column, bins: int, low: float | None = None, high: float | None = None,
    clip: bool = False,
) -> DataFrame:
    """Equal-width counts with every bin listed; the last bin includes its right edge.

    Values outside the range are dropped, or moved to the edge when ``clip`` is set. An
    open end takes the smallest or largest value.
    """
    values = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    lo = F.lit(float(low)) if low is not None else values.agg(F.min("v")).scalar()
    hi = F.lit(float(high)) if high is not None else values.agg(F.max("v")).scalar()
    if clip:
        values = values.withColumn("v", F.least(F.greatest("v", lo), hi))
    else:
        values = values.where((F.col("v") >= lo) & (F.col("v") <= hi))
    slot = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    counts = values.groupBy(slot.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    return spark.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"))


def _levels(per_key: DataFrame) -> DataFrame:
    """Keys and rows per support value, with running totals along falling support.

    The number of distinct support values is at most the square root of twice the row
    count, which bounds the unpartitioned windows here.
    """
    levels = per_key.groupBy("n").agg(F.count("*").alias("keys"))
    falling = W.orderBy(F.col("n").desc()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    rows = F.col("n") * F.col("keys")
    return levels.select(
        "n", "keys",
        F.coalesce(F.sum("keys").over(falling), F.lit(0)).alias("keys_above"),
        F.coalesce(F.sum(rows).over(falling), F.lit(0)).alias("rows_above"),
        F.sum("keys").over(everything).alias("n_keys"),
        F.sum(rows).over(everything).alias("n_rows"),
    )


def top_share(df: DataFrame, key: str, fractions=(0.01, 0.10)) -> DataFrame:
    """Percent of all rows that the most frequent keys hold.

    Works on support levels, so keys are never sorted: the level the cut falls into
    contributes its support times the keys still needed.
    """
    levels = staged(_levels(support(df, key)), "levels")
    out = None
    for fraction in fractions:
        wanted = F.greatest(F.lit(1), F.floor(F.col("n_keys") * F.lit(fraction)))
        taken = F.greatest(F.lit(0), F.least(F.col("keys"), wanted - F.col("keys_above")))
        row = levels.agg(
            F.lit(fraction).alias("fraction"),
            F.max(wanted).alias("n_top"),
            (F.sum(taken * F.col("n")) / F.max("n_rows") * 100.0).alias("pct_rows"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def lorenz_curve(df: DataFrame, key: str) -> DataFrame:
    """Per key along rising support: percent of keys and percent of rows reached."""
    per_key = staged(support(df, key), "support")
    ranked = dense_index(per_key, [F.col("n"), F.col(key)], "rank", start=1)
    levels = _levels(per_key).select(
        "n", "n_keys", "n_rows",
        (F.col("n_keys") - F.col("keys_above") - F.col("keys")).alias("keys_below"),
        (F.col("n_rows") - F.col("rows_above") - F.col("n") * F.col("keys")).alias("rows_below"),
    )
    reached = F.col("rows_below") + (F.col("rank") - F.col("keys_below")) * F.col("n")
    return ranked.join(levels, "n").select(
        key, "rank", "n",
        F.when(F.col("n_keys") == 1, 0.0)
        .otherwise((F.col("rank") - 1) * 100.0 / (F.col("n_keys") - 1)).alias("pct_keys"),
        (reached / F.col("n_rows") * 100.0).alias("pct_rows"),
    )


def rank_frequency(df: DataFrame, key: str) -> DataFrame:
    """Rank by falling support with a slope -1 reference through the last point."""
    per_key = staged(support(df, key), "support")
    ranked = dense_index(per_key, [F.col("n").desc(), F.col(key)], "rank", start=1)
    n_keys = per_key.agg(F.count("*")).scalar()
    last = per_key.agg(F.min("n")).scalar()
    return ranked.select(key, "rank", "n", (last * n_keys / F.col("rank")).alias("reference"))


def genre_counts(movies: DataFrame, genres: str = "genres", sep: str = "|", top: int = 20) -> DataFrame:
    words = movies.select(F.explode(F.split(genres, S._literal(sep))).alias("genre"))
    counts = words.where(F.col("genre") != NO_GENRE).groupBy("genre").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "genre").limit(top)


def genres_per_movie(movies: DataFrame, genres: str = "genres", sep: str = "|") -> DataFrame:
    """Movies per number of genres, with the overall share of multi-genre movies."""
    sized = movies.where(F.col(genres).isNotNull()).select(
        F.size(F.split(genres, S._literal(sep))).cast("bigint").alias("n_genres"))
    share = sized.agg(F.avg((F.col("n_genres") > 1).cast("double")) * 100.0).scalar()
    return sized.groupBy("n_genres").agg(F.count("*").alias("n")).withColumn("pct_multi", share)


def ratings_per_year(ratings: DataFrame) -> DataFrame:
    parts = S.epoch_parts(F.col("timestamp"))
    return ratings.groupBy(parts["year"].alias("year")).agg(
        F.count("*").alias("n"),
        F.min(parts["date"]).alias("first_date"),
        F.max(parts["date"]).alias("last_date"),
    )


def rating_period(ratings: DataFrame) -> DataFrame:
    """Date range of the log and its busiest year (the earliest of equals)."""
    return ratings_per_year(ratings).agg(
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.max_by("year", F.struct(F.col("n"), -F.col("year"))).alias("peak_year"),
        F.max("n").alias("peak_n"),
    )


def monthly_cumulative(ratings: DataFrame) -> DataFrame:
    """Running number of ratings; the window sees one row per calendar month."""
    month = S.epoch_parts(F.col("timestamp"))["month"]
    monthly = ratings.groupBy(month.alias("month")).agg(F.count("*").alias("n"))
    running = W.orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    return monthly.withColumn("cumulative", F.sum("n").over(running))


def user_activity_segments(ratings: DataFrame, edges=ACTIVITY_EDGES) -> DataFrame:
    """Users and share of ratings per activity bucket."""
    total = ratings.agg(F.count("*")).scalar()
    bucket = S.activity_bucket(F.col("n"), edges).alias("bucket")
    return support(ratings, "user_id").groupBy(bucket).agg(
        F.count("*").alias("n_users"), F.sum("n").alias("n_ratings"),
    ).withColumn("pct_ratings", F.col("n_ratings") / total * 100.0)


def non_null_coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a value, count and percent, one output row per column."""
    wide = df.agg(F.count("*").alias("_all"), *[F.count(c).alias(c) for c in cols])
    long = wide.unpivot("_all", cols, "column", "n_present")
    return long.select(
        "column", "n_present", (F.col("n_present") / F.col("_all") * 100.0).alias("pct_present"))


def key_membership(df: DataFrame, key: str, catalogue: DataFrame, flag: str = "matched") -> DataFrame:
    """Flag rows whose key occurs in the catalogue."""
    known = catalogue.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_hit", F.lit(True))
    return df.join(known, key, "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_hit")


def link_coverage(links: DataFrame, key: str, catalogue: DataFrame) -> DataFrame:
    """How many links exist, and how many of them are found in the catalogue."""
    flagged = key_membership(links, key, catalogue)
    return flagged.agg(
        F.count("*").alias("n_total"),
        F.count(key).alias("n_linked"),
        F.count_if("matched").alias("n_matched"),
    ).withColumns({
        "n_unmatched": F.col("n_total") - F.col("n_matched"),
        "pct_linked": F.col("n_linked") / F.col("n_total") * 100.0,
        "pct_matched": F.col("n_matched") / F.col("n_total") * 100.0,
    })


def text_stats(df: DataFrame, text: str = "overview") -> DataFrame:
    return df.withColumns({
        "word_count": S.word_count(F.col(text)), "has_overview": S.has_overview(F.col(text))})


def text_coverage(df: DataFrame, text: str = "overview") -> DataFrame:
    flagged = text_stats(df, text)
    return flagged.agg(
        F.count("*").alias("n_rows"),
        F.count_if("has_overview").alias("n_with_text"),
        F.avg(F.when(F.col("has_overview"), F.col("word_count"))).alias("mean_words"),
        (F.avg((~F.col("has_overview")).cast("double")) * 100.0).alias("pct_zero_vector"),
    )


def coverage_funnel(ratings: DataFrame, links: DataFrame, imdb: DataFrame, tmdb: DataFrame) -> DataFrame:
    """Rated movies → metadata match → text link → usable synopsis."""
    rated = ratings.select("movie_id").distinct()
    linked = links.join(rated, "movie_id", "left_semi").withColumn("tconst", S.imdb_key(F.col("imdb_id")))
    with_text = tmdb.where(S.has_overview(F.col("overview"))).select("tmdb_id")
    flagged = key_membership(key_membership(linked, "tconst", imdb, "in_imdb"), "tmdb_id", with_text, "in_text")
    counts = flagged.agg(
        F.count_if("in_imdb").alias("imdb_match"),
        F.count("tmdb_id").alias("tmdb_link"),
        F.count_if("in_text").alias("synopsis"),
    ).withColumn("rated", rated.agg(F.count("*")).scalar())
    steps = ["rated", "imdb_match", "tmdb_link", "synopsis"]
    return counts.select(F.col("rated").alias("_base"), *steps).unpivot("_base", steps, "step", "n").select(
        "step", "n", (F.col("n") / F.col("_base") * 100.0).alias("pct"))


def match_rate(features: DataFrame, matched: Column, with_text: Column) -> DataFrame:
    return features.agg(
        F.count("*").alias("n_items"),
        F.count_if(matched).alias("n_matched"),
        F.count_if(with_text).alias("n_with_text"),
    ).withColumns({
        "pct_matched": F.col("n_matched") / F.col("n_items") * 100.0,
        "pct_with_text": F.col("n_with_text") / F.col("n_items") * 100.0,
    })
