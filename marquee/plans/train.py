"""Fit the chosen models in dependency order; fitted tables live in a model store folder."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import config
from marquee.models import als, content, ease, factors, pairwise
from marquee.operators import graph, prepare
from marquee.operators.blocks import sliced
from marquee.operators.clean import positives
from marquee.operators.features import popularity_minmax
from marquee.operators.sampling import TripletSampler, val_triplets
from marquee.plans.feature_engineering import Features
from marquee.plans.preprocess import Preprocessed
from marquee.runtime import staged
from marquee.sources import model_store

MODELS = ("als", "bpr", "easr", "hybrid", "twotower", "lightgcn")


@dataclass
class TrainOptions:
    rank: int = config.ALS_RANK
    als_iterations: int = config.ALS_ITERATIONS
    als_reg: float = config.ALS_REG
    epochs: int = config.BPR_EPOCHS
    samples: int | None = None  # triplets per epoch; as many as training positives unless given
    lr: float = config.BPR_LR
    ease_reg: float = config.EASE_REG
    ease_block: int = ease.BLOCK
    batches: int = config.BPR_BATCHES
    gcn_dim: int = config.GCN_DIM
    gcn_layers: int = config.GCN_LAYERS
    seed: int = config.SEED


@dataclass
class Trained:
    """Fitted models by name; rankers keep the side tables they score with."""

    als: factors.FactorModel | None = None
    bpr: factors.FactorModel | None = None
    lightgcn: factors.FactorModel | None = None
    ease_weights: DataFrame | None = None
    ease_block: int = ease.BLOCK
    rankers: dict[str, tuple[content.PairwiseRanker, DataFrame, DataFrame]] = field(default_factory=dict)

    def is_empty(self) -> bool:
        return not self.rankers and all(m is None for m in (self.als, self.bpr, self.lightgcn, self.ease_weights))


def train_models(
    prep: Preprocessed, feats: Features | None, store: str, models=("all",),
    options: TrainOptions = TrainOptions(), n_genres: int = len(config.GENRES),
) -> Trained:
    """ALS before BPR and Hybrid, BPR before Hybrid: fitted when chosen, loaded otherwise."""
    chosen = set(MODELS) if "all" in models else set(models)
    train, out = prep.part_of("train"), Trained()
    spark = train.sparkSession
    n_users, n_items = prep.user_map.count(), prep.movie_map.count()
    if options.samples is None:
        options = replace(options, samples=positives(train).count())
    popularity = staged(prepare.item_popularity(train), "item-popularity")

    if "als" in chosen:
        out.als = _stored(spark, store, "als", als.als_fit(
            train, prep.user_map, prep.movie_map, options.rank, options.als_iterations, options.als_reg, seed=options.seed))
    elif chosen & {"bpr", "hybrid"}:
        out.als = _needed(model_store.load_model(spark, store, "als"), "als", store)

    sampler = held_out = None
    if chosen & {"bpr", "lightgcn"}:
        sampler = TripletSampler(train, popularity)
        held_out = staged(val_triplets(positives(prep.part_of("val")), popularity, options.samples, options.seed + 1, exclude=train), "val-triplets")
    if "bpr" in chosen:
        users = factors.random_factors(prep.user_map, "user_idx", options.rank, options.seed)
        items = factors.random_factors(prep.movie_map, "movie_idx", options.rank, options.seed + 1)
        out.bpr = _stored(spark, store, "bpr", pairwise.bpr_fit(
            sampler,
            factors.warm_start(users, out.als.users, "user_idx", options.rank, out.als.rank),
            factors.warm_start(items, out.als.items, "movie_idx", options.rank, out.als.rank),
            options.rank, options.samples, options.epochs, options.lr, seed=options.seed, batches=options.batches,
            validation=held_out))
    elif "hybrid" in chosen:
        out.bpr = _needed(model_store.load_model(spark, store, "bpr"), "bpr", store)

    if "easr" in chosen:
        gram = ease.ease_gram(train, n_items, options.ease_block)
        weights = ease.ease_fit(gram, n_items, options.ease_reg, options.ease_block)
        model_store.save_weights(weights, store, "easr", options.ease_reg, options.ease_block, n_items)
        _load_weights(spark, store, out)

    if chosen & {"hybrid", "twotower"}:
        _fit_rankers(chosen, train, feats, out, popularity, options, n_genres, store)

    if "lightgcn" in chosen:
        adjacency = sliced(graph.sym_normalise(graph.bipartite_edges(train, n_users)))
        nodes = spark.range(n_users + n_items).select(F.col("id").cast("int").alias("node"))
        out.lightgcn = _stored(spark, store, "lightgcn", pairwise.lightgcn_fit(
            adjacency, nodes, sampler, n_users, options.gcn_dim, options.gcn_layers,
            options.samples, options.epochs, options.lr, seed=options.seed, validation=held_out))
    return out


def load_models(spark: SparkSession, store: str, models=("all",)) -> Trained:
    """Those of ``models`` that the store holds, rankers with their side tables."""
    chosen, out = set(MODELS) if "all" in models else set(models), Trained()
    for name in ("als", "bpr", "lightgcn"):
        if name in chosen:
            setattr(out, name, model_store.load_model(spark, store, name))
    if "easr" in chosen:
        _load_weights(spark, store, out)
    for name in ("hybrid", "twotower"):
        ranker = model_store.load_ranker(spark, store, name) if name in chosen else None
        if ranker is not None:
            out.rankers[name] = ranker
    return out


def _load_weights(spark: SparkSession, store: str, out: Trained) -> None:
    found = model_store.load_weights(spark, store, "easr")
    if found is not None:
        out.ease_weights, out.ease_block = found[0], found[1]["block"]


def _stored(spark: SparkSession, store: str, name: str, model: factors.FactorModel) -> factors.FactorModel:
    model_store.save_model(model, store, name)
    return model_store.load_model(spark, store, name)


def _needed(model, name: str, store: str):
    if model is None:
        raise ValueError(f"{store} holds no fitted {name}; train it first")
    return model


def _fit_rankers(chosen, train, feats: Features, out: Trained, popularity, options: TrainOptions, n_genres: int,
                 store: str) -> None:
    liked = positives(train)
    triplets = staged(TripletSampler(liked, popularity).draw(options.samples, options.seed), "ranker-triplets")
    pop = popularity_minmax(feats.pop, "pop")
    for name in ("hybrid", "twotower"):
        if name not in chosen:
            continue
        hybrid = name == "hybrid"
        user_extra = {"als": out.als.users, "bpr": out.bpr.users} if hybrid else {}
        item_extra = {"als": out.als.items, "bpr": out.bpr.items} if hybrid else {}
        items = staged(content.item_side(feats.text, feats.imdb, pop, n_genres, item_extra), f"{name}-items")
        profile = content.genre_profile(train, items, n_genres)
        users = staged(content.user_side(feats.history, profile, n_genres, user_extra), f"{name}-users")
        fit = content.hybrid_fit if hybrid else content.pairwise_ranker_fit
        model_store.save_ranker(fit(triplets, users, items), users, items, store, name)
        out.rankers[name] = model_store.load_ranker(train.sparkSession, store, name)
