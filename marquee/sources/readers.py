"""Typed readers for the raw files. No reader infers a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATINGS = "userId INT, movieId INT, rating FLOAT, timestamp BIGINT"
MOVIES = "movieId INT, title STRING, genres STRING"
LINKS = "movieId INT, imdbId STRING, tmdbId STRING"
BASICS = (
    "tconst STRING, titleType STRING, primaryTitle STRING, originalTitle STRING, isAdult STRING, "
    "startYear STRING, endYear STRING, runtimeMinutes STRING, genres STRING"
)
VOTES = "tconst STRING, averageRating DOUBLE, numVotes BIGINT"
TMDB_COLUMNS = ("id", "title", "overview", "release_date", "vote_average", "vote_count")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, RATINGS).select(
        F.col("userId").alias("user_id"), F.col("movieId").alias("movie_id"),
        F.col("rating").cast("double").alias("rating"), "timestamp",
    )


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, MOVIES).withColumnRenamed("movieId", "movie_id")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return typed_links(_csv(spark, path, LINKS))


def typed_links(raw: DataFrame) -> DataFrame:
    """Link ids as numbers; text that is not a number becomes null."""
    return raw.select(
        F.col("movieId").cast("int").alias("movie_id"),
        F.col("imdbId").try_cast("double").try_cast("bigint").alias("imdb_id"),
        F.col("tmdbId").try_cast("double").try_cast("bigint").alias("tmdb_id"),
    )


def read_imdb_basics(spark: SparkSession, path: str) -> DataFrame:
    """Quoting is off: titles hold stray quotes that would otherwise merge rows."""
    raw = spark.read.schema(BASICS).csv(
        path, sep="\t", header=True, nullValue="\\N", quote="", enforceSchema=False)
    return raw.select("tconst", "titleType", "startYear", "runtimeMinutes", "genres")


def read_imdb_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOTES).csv(
        path, sep="\t", header=True, nullValue="\\N", quote="", enforceSchema=False)


def read_tmdb(spark: SparkSession, path: str) -> DataFrame:
    """Quoted multi-line CSV; its header decides the column order, so columns are by name."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return typed_tmdb(raw.select(*TMDB_COLUMNS))


def typed_tmdb(raw: DataFrame) -> DataFrame:
    """Numeric ids only (rows without one are dropped); a missing overview is empty text."""
    typed = raw.select(
        F.col("id").try_cast("double").try_cast("bigint").alias("tmdb_id"),
        "title",
        F.coalesce("overview", F.lit("")).alias("overview"),
        "release_date",
        F.col("vote_average").try_cast("double").alias("vote_average"),
        F.col("vote_count").try_cast("bigint").alias("vote_count"),
    )
    return typed.dropna(subset=["tmdb_id"])


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', enforceSchema=False)
