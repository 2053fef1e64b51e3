"""Views of the supplied tables in the shape the operators expect.

A customer buying a part stands for a user rating a movie; parts carry the item metadata,
documents the synopses and embeddings the text vectors. Stage tables that many queries
share are written once per session and input folder.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import scalars as S
from marquee.functions import vectors as V
from marquee.operators import clean, features, graph
from marquee.operators.blocks import Sliced, sliced
from marquee.plans.preprocess import Preprocessed, prepare_interactions
from marquee.runtime import checkpoint_root, staged
from marquee.sources.readers import typed_links, typed_tmdb

RATING_ORDER = ["timestamp", "l_orderkey", "l_linenumber", "l_suppkey"]
VOCAB = ["anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old", "plate", "red"]
TEXT_DIM = 64


class Tables:
    """Lazily built inputs and stage tables of one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def seconds(column: str):
        """Unix seconds of a timestamp without time zone, in any session time zone."""
        stamp = F.col(column)
        day = F.unix_date(stamp.cast("date")).cast("bigint") * 86_400
        return day + F.hour(stamp) * 3_600 + F.minute(stamp) * 60 + F.second(stamp)

    # -- inputs -----------------------------------------------------------------

    def raw_ratings(self) -> DataFrame:
        lines = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_suppkey",
            F.col("l_partkey").alias("movie_id"),
            ((F.floor((F.col("l_quantity") - 1) / 5) + 1) * 0.5).alias("rating"),
            self.seconds("l_shipdate").alias("timestamp"),
        )
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
        return lines.join(orders, "l_orderkey")

    def raw_links(self) -> DataFrame:
        """Text ids with gaps: no metadata id at size 13, text id 0 at size 7, junk at size 9."""
        size = F.col("p_size")
        raw = self.table("part").select(
            F.col("p_partkey").alias("movieId"),
            F.when(size == 13, None).otherwise((F.col("p_partkey") * 7919 + 5).cast("string")).alias("imdbId"),
            F.when(size == 7, "0").when(size == 9, "n/a").when(size == 11, None)
            .otherwise(F.col("p_partkey").cast("string")).alias("tmdbId"),
        )
        return raw

    def links(self) -> DataFrame:
        return typed_links(self.raw_links())

    def file(self, raw: DataFrame, name: str, **options) -> str:
        """``raw`` written as delimited text with a header, as the readers expect it."""
        path = f"{checkpoint_root(self.spark).rstrip('/')}/marquee/{self.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        raw.write.csv(path, header=True, **options)
        return path

    def raw_basics(self) -> DataFrame:
        size = F.col("p_size")
        return self.table("part").select(
            S.imdb_key(F.col("p_partkey") * 7919 + 5).alias("tconst"),
            F.when(F.col("p_type") == "ECONOMY", "short").otherwise("movie").alias("titleType"),
            F.when(size == 4, None).otherwise((size * 2 + 1915).cast("string")).alias("startYear"),
            F.when(size == 2, None).when(size == 5, "unknown")
            .otherwise((size * 6).cast("string")).alias("runtimeMinutes"),
            F.when(size == 3, None).otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit(","))).alias("genres"),
        )

    def votes(self) -> DataFrame:
        """Votes are sales of the part; small parts have none."""
        sold = self.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
            F.count("*").alias("numVotes"))
        parts = self.table("part").where(F.col("p_size") > 10)
        return parts.join(sold, "p_partkey").select(
            S.imdb_key(F.col("p_partkey") * 7919 + 5).alias("tconst"),
            (1 + (F.col("p_retailprice") - 900) / 20).alias("averageRating"),
            "numVotes",
        )

    def movies(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("movie_id"), F.col("p_name").alias("title"),
            F.replace(F.col("p_name"), F.lit(" "), F.lit("|")).alias("genres"))

    def raw_tmdb(self) -> DataFrame:
        """Documents as synopses; junk ids for one source, bad dates for one language."""
        raw = self.table("documents").select(
            F.when(F.col("source") == "src3", "junk").otherwise(F.col("doc_id").cast("string")).alias("id"),
            F.col("source").alias("title"),
            F.when(F.col("source") == "src5", None).otherwise(F.col("text")).alias("overview"),
            F.when(F.col("lang") == "es", "unknown")
            .otherwise(F.date_add(F.lit("1990-01-01").cast("date"), F.col("n_chars").cast("int")).cast("string"))
            .alias("release_date"),
            F.lit(None).cast("string").alias("vote_average"),
            F.col("n_chars").cast("string").alias("vote_count"),
        )
        return raw

    def tmdb(self) -> DataFrame:
        return typed_tmdb(self.raw_tmdb())

    # -- stage tables -----------------------------------------------------------

    @cached_property
    def ratings(self) -> DataFrame:
        return staged(clean.clean_ratings(self.raw_ratings(), RATING_ORDER), "ratings")

    @cached_property
    def prepared(self) -> Preprocessed:
        return prepare_interactions(self.ratings)

    @property
    def user_map(self) -> DataFrame:
        return self.prepared.user_map

    @property
    def movie_map(self) -> DataFrame:
        return self.prepared.movie_map

    @property
    def interactions(self) -> DataFrame:
        return self.prepared.interactions

    def part_of(self, split: str) -> DataFrame:
        return self.interactions.where(F.col("split") == split).drop("split")

    @property
    def train(self) -> DataFrame:
        return self.part_of("train")

    @property
    def val(self) -> DataFrame:
        return self.part_of("val")

    @property
    def test(self) -> DataFrame:
        return self.part_of("test")

    @cached_property
    def n_users(self) -> int:
        return self.user_map.count()

    @cached_property
    def n_items(self) -> int:
        return self.movie_map.count()

    def imdb(self) -> DataFrame:
        return features.imdb_join(features.movies_only(self.raw_basics()), self.votes())

    @cached_property
    def item_vectors(self) -> DataFrame:
        """Supplied vectors by movie index; movies without one get zeros."""
        supplied = self.table("embeddings").select(
            F.col("vec_id").alias("movie_id"), V.as_doubles(F.col("embedding")).alias("vec"))
        return staged(features.attach_vectors(self.movie_map, supplied, TEXT_DIM), "item_vectors")

    @cached_property
    def history(self) -> DataFrame:
        return staged(features.history_embedding(self.train, self.item_vectors, TEXT_DIM), "history")

    @cached_property
    def adjacency(self) -> DataFrame:
        return staged(graph.sym_normalise(graph.bipartite_edges(self.train, self.n_users)), "adjacency")

    @cached_property
    def sliced_adjacency(self) -> Sliced:
        return sliced(self.adjacency)


_CACHE: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CACHE:
        _CACHE[key] = Tables(spark, sf_dir)
    return _CACHE[key]
