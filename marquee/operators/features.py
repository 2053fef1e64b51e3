"""Item and user features keyed by explicit index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.config import DECAY_BASE, GENRES, HISTORY_LENGTH
from marquee.functions import scalars as S
from marquee.functions import vectors as V
from marquee.functions.ranking import top_n_per_key
from marquee.operators.clean import dedup_keep_last
from marquee.runtime import checkpointed, staged


def movies_only(basics: DataFrame) -> DataFrame:
    """Feature films with runtime and year as numbers; unreadable numbers become null."""
    return basics.where(F.col("titleType") == "movie").select(
        "tconst",
        F.col("runtimeMinutes").try_cast("double").alias("runtime"),
        F.col("startYear").try_cast("double").alias("year"),
        "genres",
    )


def imdb_join(basics: DataFrame, votes: DataFrame) -> DataFrame:
    return basics.join(votes, "tconst", "left")


def normalised_imdb(imdb: DataFrame, vocab=GENRES, sep: str = ",") -> DataFrame:
    """Runtime, vote and vote-count scaled to 0..1, plus the known genres.

    The vote fallback is the median over all films and the vote-count scale their largest
    log count; both are scalar subqueries over the metadata.
    """
    imdb = staged(imdb, "imdb")
    median_vote = imdb.agg(F.median("averageRating")).scalar()
    most_votes = imdb.agg(F.max(S.log_votes(F.col("numVotes")))).scalar()
    return imdb.select(
        "tconst",
        S.genre_list(F.col("genres"), sep, vocab).alias("genre_list"),
        S.runtime_norm(F.col("runtime")).alias("runtime_norm"),
        S.avg_vote_norm(F.col("averageRating"), median_vote).alias("avg_vote_norm"),
        (S.log_votes(F.col("numVotes")) / most_votes).alias("log_votes_norm"),
    )


def _last_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per lookup key, the largest by its other columns."""
    return dedup_keep_last(df, [key], [c for c in df.columns if c != key])


def item_imdb(movie_map: DataFrame, links: DataFrame, imdb: DataFrame) -> DataFrame:
    """Metadata row of every mapped movie; unmatched movies keep nulls."""
    keys = _last_per_key(links.select("movie_id", S.imdb_key(F.col("imdb_id")).alias("tconst")), "movie_id")
    rows = _last_per_key(imdb, "tconst").withColumn("matched", F.lit(True))
    return (
        movie_map.join(keys, "movie_id", "left").join(rows, "tconst", "left")
        .withColumn("matched", F.coalesce("matched", F.lit(False)))
    )


def build_imdb_features(movie_map: DataFrame, links: DataFrame, imdb: DataFrame, vocab=GENRES) -> DataFrame:
    """One vector per movie: genre slots, then runtime, vote and vote count; zeros if unmatched."""
    items = item_imdb(movie_map, links, normalised_imdb(imdb, vocab))
    vec = F.concat(
        S.genre_multi_hot(F.col("genre_list"), vocab),
        F.array("runtime_norm", "avg_vote_norm", "log_votes_norm"),
    )
    return items.select(
        "movie_idx", F.when(F.col("matched"), vec).otherwise(V.zeros(len(vocab) + 3)).alias("vec"), "matched")


def primary_genre(movie_map: DataFrame, links: DataFrame, basics: DataFrame, vocab=GENRES, sep: str = ",") -> DataFrame:
    items = item_imdb(movie_map, links, basics.select("tconst", "genres"))
    known = S.genre_list(F.col("genres"), sep, vocab)
    return items.select("movie_idx", S.primary_genre(known, vocab).alias("genre_idx"))


def item_text(movie_map: DataFrame, links: DataFrame, tmdb: DataFrame) -> DataFrame:
    """Synopsis of every mapped movie; no link, link 0 and blank text all give null."""
    keys = _last_per_key(links.select("movie_id", F.nullif("tmdb_id", F.lit(0)).alias("tmdb_id")), "movie_id")
    texts = _last_per_key(tmdb.select("tmdb_id", "overview"), "tmdb_id")
    joined = movie_map.join(keys, "movie_id", "left").join(texts, "tmdb_id", "left")
    return joined.select("movie_idx", F.when(S.has_text(F.col("overview")), F.col("overview")).alias("overview"))


def attach_vectors(movie_map: DataFrame, supplied: DataFrame, dim: int) -> DataFrame:
    """Supplied text vectors by movie index, unit length; zeros where none is supplied."""
    return movie_map.join(supplied, "movie_id", "left").select(
        "movie_idx", F.coalesce(V.unit(F.col("vec")), V.zeros(dim)).alias("vec"))


def text_embed(items: DataFrame, dim: int, text: str = "overview") -> DataFrame:
    """Hashed TF-IDF of each text as sparse rows (movie, slot, weight) of unit length.

    Words hash into ``dim`` slots. Blank texts give no rows, which is the zero vector.
    """
    docs = items.where(S.has_text(F.col(text)))
    words = docs.select(
        "movie_idx", F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"))).alias("word"))
    slot = (S.hash_draw("slot", F.col("word")) % dim).alias("slot")
    tf = words.groupBy("movie_idx", slot).agg(F.count("*").alias("tf"))
    tf = checkpointed(tf)  # read for the document frequencies and again for the weights
    n_docs = docs.agg(F.count("*")).scalar()
    df = tf.groupBy("slot").agg(F.count("*").alias("df"))
    weight = F.col("tf") * F.log((n_docs + 1.0) / (F.col("df") + 1.0))
    per_movie = tf.join(df, "slot").groupBy("movie_idx").agg(  # at most ``dim`` slots each
        F.collect_list(F.struct("slot", weight.alias("w"))).alias("slots"))
    norm = F.sqrt(F.aggregate("slots", F.lit(0.0), lambda acc, s: acc + s["w"] * s["w"]))
    return per_movie.withColumn("norm", norm).where(F.col("norm") > 0).select(
        "movie_idx", "norm", F.inline("slots")).select(
        "movie_idx", "slot", (F.col("w") / F.col("norm")).alias("weight"))


def sparse_to_vectors(movie_map: DataFrame, sparse: DataFrame, dim: int) -> DataFrame:
    """Sparse rows of :func:`text_embed` as one dense vector per movie."""
    filled = F.map_from_entries(F.collect_list(F.struct("slot", "weight")))
    maps = sparse.groupBy("movie_idx").agg(filled.alias("_m"))
    slots = F.sequence(F.lit(0), F.lit(dim - 1)).cast("array<bigint>")
    vec = F.transform(slots, lambda s: F.coalesce(F.try_element_at("_m", s), F.lit(0.0)))
    return movie_map.select("movie_idx").join(maps, "movie_idx", "left").select(
        "movie_idx", F.when(F.col("_m").isNull(), V.zeros(dim)).otherwise(vec).alias("vec"))


def popularity(train: DataFrame, movie_map: DataFrame) -> DataFrame:
    """log1p of the rating count over its maximum; movies without ratings get 0."""
    counts = train.groupBy("movie_idx").agg(F.count("*").alias("cnt"))
    most = counts.agg(F.log1p(F.max("cnt"))).scalar()
    return movie_map.select("movie_idx").join(counts, "movie_idx", "left").select(
        "movie_idx", (F.log1p(F.coalesce("cnt", F.lit(0))) / most).alias("pop"))


def popularity_minmax(values: DataFrame, col: str) -> DataFrame:
    """log1p of ``col`` rescaled from its smallest to its largest value."""
    logs = values.withColumn("_log", F.log1p(F.col(col).cast("double")))
    low, high = logs.agg(F.min("_log")).scalar(), logs.agg(F.max("_log")).scalar()
    return logs.select("movie_idx", ((F.col("_log") - low) / (high - low + 1e-8)).alias("pop_norm"))


def history_embedding(train: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Rating-weighted mean of the rated movies' vectors per user, unit length.

    Zero vectors add nothing to the sum, so their rows skip the vector join; the mean's
    scale cancels in the normalisation.
    """
    filled = vectors.where(V.squared_norm(F.col("vec")) > 0)
    rated = train.select("user_idx", "movie_idx", "rating").join(filled, "movie_idx")
    sums = rated.groupBy("user_idx").agg(V.vector_sum(F.col("vec"), dim, F.col("rating")).alias("vec"))
    weights = train.groupBy("user_idx").agg(F.sum("rating").alias("weight"))
    return weights.join(sums, "user_idx", "left").select(
        "user_idx",
        F.coalesce(V.unit(V.scaled(F.col("vec"), 1.0 / F.col("weight"))), V.zeros(dim)).alias("vec"))


def recency_history(
    train: DataFrame, vectors: DataFrame, dim: int,
    base: float = DECAY_BASE, length: int = HISTORY_LENGTH,
) -> DataFrame:
    """Weighted sum of the newest ``length`` vectors, weights ``base^r`` from the newest on.

    Weights are normalised over all ``length`` slots, so short histories weigh less.
    """
    newest = top_n_per_key(
        train.select("user_idx", "movie_idx", "timestamp"), "user_idx",
        [F.col("timestamp").desc(), F.col("movie_idx").desc()], length)
    total = sum(base ** r for r in range(length)) + 1e-8
    weight = F.pow(F.lit(base), F.col("rank") - 1) / total
    return newest.join(vectors, "movie_idx").groupBy("user_idx").agg(
        V.vector_sum(F.col("vec"), dim, weight).alias("vec"))
