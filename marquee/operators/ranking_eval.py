"""Ranking quality of top-k lists by user segment.

The plug-in contract of a model is its table (user_idx, movie_idx, score, rank).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.config import COLD_THRESHOLD, EXCLUDED_MODELS, RELEVANT_RATING, TOP_KS
from marquee.operators.clean import positives
from marquee.operators.prepare import user_segment


def ground_truth(held_out: DataFrame, threshold: float = RELEVANT_RATING) -> DataFrame:
    """Relevant (user, movie) pairs; users without any do not appear."""
    return positives(held_out, threshold).select("user_idx", "movie_idx").distinct()


def candidate_guard(top: DataFrame, kmax: int = max(TOP_KS)) -> DataFrame:
    """Users whose list reached ``kmax`` entries: the others had too few candidates."""
    return top.groupBy("user_idx").agg(F.count("*").alias("_n")).where(F.col("_n") >= kmax).select("user_idx")


def per_user_metrics(top: DataFrame, truth: DataFrame, ks=TOP_KS) -> DataFrame:
    """NDCG and recall at every k for users with relevant movies and a full list."""
    n_relevant = truth.groupBy("user_idx").agg(F.count("*").alias("n_rel"))
    hits = top.where(F.col("rank") <= max(ks)).join(truth, ["user_idx", "movie_idx"], "left_semi")
    gained = hits.groupBy("user_idx").agg(*[
        c for k in ks for c in (
            F.sum(F.when(F.col("rank") <= k, discount(F.col("rank")))).alias(f"dcg@{k}"),
            F.count_if(F.col("rank") <= k).alias(f"hits@{k}"))
    ])
    users = n_relevant.join(candidate_guard(top, max(ks)), "user_idx", "left_semi")
    joined = users.join(gained, "user_idx", "left")
    return joined.select("user_idx", *[
        c for k in ks for c in (
            (F.coalesce(f"dcg@{k}", F.lit(0.0)) / ideal_dcg(F.col("n_rel"), k)).alias(f"ndcg@{k}"),
            (F.coalesce(f"hits@{k}", F.lit(0)) / F.col("n_rel")).alias(f"recall@{k}"))
    ])


def discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def ideal_dcg(n_relevant: Column, k: int) -> Column:
    """DCG of a list that starts with all relevant movies."""
    ranks = F.sequence(F.lit(1), F.least(n_relevant, F.lit(k)).cast("int"))
    return F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + discount(r))


def segment_metrics(per_user: DataFrame, segments: DataFrame) -> DataFrame:
    """Means per segment and overall, as (segment, metric, value) with ``n_users`` rows."""
    metrics = [c for c in per_user.columns if c != "user_idx"]
    labelled = per_user.join(segments, "user_idx").withColumn(
        "segment", F.explode(F.array(F.lit("overall"), F.col("segment"))))
    wide = labelled.groupBy("segment").agg(
        *[F.avg(f"`{m}`").alias(m) for m in metrics], F.count("*").cast("double").alias("n_users"))
    return wide.unpivot("segment", [f"`{m}`" for m in metrics] + ["n_users"], "metric", "value")


def evaluate_model(
    name: str, top: DataFrame, held_out: DataFrame, train: DataFrame, ks=TOP_KS,
    cold_threshold: int = COLD_THRESHOLD,
) -> DataFrame:
    """Report rows (model, segment, metric, value) of one model's top-k table."""
    per_user = per_user_metrics(top, ground_truth(held_out), ks)
    segments = user_segment(per_user.select("user_idx"), train, cold_threshold)
    return segment_metrics(per_user, segments).select(F.lit(name).alias("model"), "segment", "metric", "value")


def compare_models(report: DataFrame, k: int = 10) -> DataFrame:
    """One row per model: NDCG and recall, overall and for cold users; missing is 0."""
    cells = {
        f"{segment}_{metric}": (segment, f"{metric}@{k}")
        for segment in ("overall", "cold") for metric in ("ndcg", "recall")
    }
    return report.groupBy("model").agg(*[
        F.coalesce(F.max(F.when((F.col("segment") == s) & (F.col("metric") == m), F.col("value"))), F.lit(0.0)).alias(c)
        for c, (s, m) in cells.items()
    ])


def nested_report(report: DataFrame) -> DataFrame:
    """Report rows as one map per model: segment → metric → value."""
    per_segment = report.groupBy("model", "segment").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    return per_segment.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct("segment", "metrics"))).alias("segments"))


def flatten_report(nested: DataFrame, k: int = 10, excluded=EXCLUDED_MODELS) -> DataFrame:
    """Nested report → (Model, Segment, NDCG, Recall) with title-case segments."""
    rows = nested.where(~F.col("model").isin(list(excluded))).select(
        "model", F.explode("segments").alias("segment", "metrics"))

    def metric(name: str) -> Column:
        return F.coalesce(F.try_element_at("metrics", F.lit(f"{name}@{k}")), F.lit(0.0))

    return rows.select(
        F.col("model").alias("Model"), F.initcap("segment").alias("Segment"),
        metric("ndcg").alias(f"NDCG@{k}"), metric("recall").alias(f"Recall@{k}"))


def score_stats(scores: DataFrame) -> DataFrame:
    """Spread of one user's scores and the number of distinct values at four decimals."""
    return scores.agg(
        F.min("score").alias("min"), F.max("score").alias("max"), F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"),
        F.count_distinct(F.bround("score", 4)).alias("n_distinct"),
        F.count("*").alias("n_scores"),
    )


def uncentred_range(scores: DataFrame, user_mean: Column) -> DataFrame:
    """Range of one user's scores after adding back the user's mean rating."""
    raw = F.col("score") + user_mean
    return scores.agg(
        F.max(user_mean).alias("user_mean"), F.min(raw).alias("min"), F.max(raw).alias("max"), F.avg(raw).alias("mean"))


def union_reports(reports: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)
