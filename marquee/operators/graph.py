"""User–movie graph as an edge table; movie nodes follow the user nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.config import GCN_LAYERS
from marquee.functions import vectors as V
from marquee.operators.blocks import Sliced, product, sliced


def bidirectional_edges(train: DataFrame) -> DataFrame:
    """Both directions of every interaction."""
    forward = train.select(F.col("user_idx").alias("src"), F.col("movie_idx").alias("dst"))
    return forward.unionByName(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def bipartite_edges(train: DataFrame, n_users: int) -> DataFrame:
    """Edges of weight 1 per interaction, movies shifted behind the users."""
    nodes = train.select("user_idx", (F.col("movie_idx") + n_users).alias("movie_idx"))
    return bidirectional_edges(nodes).withColumn("w", F.lit(1.0))


def node_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum("w").alias("degree"))


def sym_normalise(edges: DataFrame) -> DataFrame:
    """Weight over the root of both degrees. Nodes without edges have no row to scale."""
    inverse_root = node_degree(edges).select(
        F.col("src").alias("node"), (1.0 / F.sqrt("degree")).alias("d"))
    source = inverse_root.select(F.col("node").alias("src"), F.col("d").alias("d_src"))
    target = inverse_root.select(F.col("node").alias("dst"), F.col("d").alias("d_dst"))
    return edges.join(source, "src").join(target, "dst").select(
        "src", "dst", (F.col("w") * F.col("d_src") * F.col("d_dst")).alias("w"))


def neighbour_sum(edges: DataFrame | Sliced, emb: DataFrame, dim: int) -> DataFrame:
    """Weighted sum of the neighbours' vectors per node that has any."""
    return product(as_sliced(edges), emb, dim)


def propagate(edges: DataFrame | Sliced, emb: DataFrame, dim: int, layers: int = GCN_LAYERS) -> DataFrame:
    """Mean over layers 0..K of the repeatedly propagated vectors.

    A node that receives nothing in a layer counts as zero there. The layers are summed as
    E + Â(E + Â(E + …)): each step reads the one before once, and the base vectors join the
    partial products in the same aggregation. Give a :class:`Sliced` matrix where several
    products share it.
    """
    matrix, total = as_sliced(edges), emb.select("node", "vec")
    for _ in range(layers):
        total = product(matrix, total, dim, plus=emb)
    return total.select("node", V.scaled(F.col("vec"), F.lit(1.0 / (layers + 1))).alias("vec"))


def as_sliced(edges: DataFrame | Sliced) -> Sliced:
    return edges if isinstance(edges, Sliced) else sliced(edges)
