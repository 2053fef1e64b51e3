"""Models, sinks and whole-pipeline compositions."""

from functools import lru_cache
from uuid import uuid4

from pyspark.sql import functions as F

from marquee.functions import vectors as V
from marquee.models import als, content, ease, factors, pairwise
from marquee.operators import clean, features, graph, prepare, ranking_eval, score
from marquee.operators.sampling import TripletSampler
from marquee.plans import evaluate as evaluate_plan
from marquee.plans import train as train_plan
from marquee.plans.feature_engineering import build_features
from marquee.runtime import checkpoint_root, staged
from marquee.sources import model_store, sinks
from workload.adapter import TEXT_DIM, VOCAB, Tables
from workload.feature_queries import (
    _VOCAB_SQL, CONTENT, HIST, ITEM_IMDB, REPORT, _triplet_sql, content_factors, long, popularity_factors, popularity_top, report_of,
)
from workload.oracles import CTES, MAPS, TRAIN
from workload.registry import query

RANK, EPOCHS, BLOCK = 16, 3, 512
OPTIONS = train_plan.TrainOptions(
    rank=RANK, als_iterations=3, epochs=EPOCHS, lr=0.05, ease_block=BLOCK, gcn_dim=16)


def folder(t: Tables, name: str) -> str:
    return f"{checkpoint_root(t.spark).rstrip('/')}/marquee-out/{name}-{uuid4().hex[:12]}"


def _once(fn):
    """Build once per table set."""
    return lru_cache(maxsize=None)(fn)


@_once
def popularity(t: Tables):
    return staged(prepare.item_popularity(t.train), "item-popularity")


@_once
def sampler(t: Tables):
    return TripletSampler(t.train, popularity(t))


@_once
def triplets(t: Tables):
    return staged(sampler(t).draw(t.train.count(), 42), "triplets")


@_once
def als_model(t: Tables):
    return als.als_fit(t.train, t.user_map, t.movie_map, RANK, 3)


@_once
def bpr_model(t: Tables):
    start = als_model(t)
    return pairwise.bpr_fit(
        sampler(t), start.users, start.items, RANK, t.train.count(), EPOCHS, 0.05, batches=4)


@_once
def gram(t: Tables):
    return staged(ease.ease_gram(t.train, t.n_items, BLOCK), "gram")


@_once
def ease_weights(t: Tables):
    return staged(ease.ease_fit(gram(t), t.n_items, block=BLOCK), "ease-weights")


@_once
def lightgcn_model(t: Tables):
    nodes = t.spark.range(t.n_users + t.n_items).select(F.col("id").cast("int").alias("node"))
    return pairwise.lightgcn_fit(t.sliced_adjacency, nodes, sampler(t), t.n_users, 16, 2, t.train.count(), EPOCHS, 0.05, batches=1)


@_once
def feature_tables(t: Tables):
    supplied = t.table("embeddings").select(
        F.col("vec_id").alias("movie_id"), V.as_doubles(F.col("embedding")).alias("vec"))
    return build_features(
        t.train, t.movie_map, t.links(), t.raw_basics(), t.votes(), t.tmdb(),
        dim=TEXT_DIM, vocab=VOCAB, supplied=supplied)


@_once
def ranker_inputs(t: Tables):
    feats, als_m, bpr_m = feature_tables(t), als_model(t), bpr_model(t)
    pop = features.popularity_minmax(feats.pop, "pop")
    items = staged(content.item_side(
        feats.text, feats.imdb, pop, len(VOCAB), {"als": als_m.items, "bpr": bpr_m.items}), "ranker-items")
    profile = content.genre_profile(t.train, items, len(VOCAB))
    users = staged(content.user_side(
        feats.history, profile, len(VOCAB), {"als": als_m.users, "bpr": bpr_m.users}), "ranker-users")
    liked = TripletSampler(clean.positives(t.train), popularity(t))
    return users, items, staged(liked.draw(t.train.count(), 42), "ranker-triplets")


def history_rows(t: Tables, losses: list[float]):
    return t.spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(losses)], "epoch int, loss double")


def ranking_of(top):
    return top.select("user_idx", "movie_idx", "rank", F.round("score", 4).alias("score"))


# -- factor models over vectors both engines can see --------------------------------

CTES["factors"] = """uf AS (SELECT user_idx, p, p[1] AS bu FROM uvec), itf AS (SELECT movie_idx, q, q[1] AS bi FROM ivec)"""
FACTORS = [*CONTENT, "factors"]


def visible_factors(t: Tables):
    """History and text vectors as factors, their first dimension as bias."""
    users = t.history.select("user_idx", "vec", F.get("vec", F.lit(0)).alias("bias"))
    items = t.item_vectors.select("movie_idx", "vec", F.get("vec", F.lit(0)).alias("bias"))
    return factors.FactorModel(users, items, TEXT_DIM)


@query("als_rmse", FACTORS, """SELECT round(sqrt(avg(pow(rating_centered - (bu + bi + list_dot_product(p, q)), 2))), 6) AS rmse
    FROM train JOIN uf USING (user_idx) JOIN itf USING (movie_idx)""")
def _(t: Tables):
    return factors.rmse(t.train, visible_factors(t)).withColumn("rmse", F.round("rmse", 6))


@query("mf_predict", FACTORS, """SELECT user_idx, movie_idx, round(bu + bi + list_dot_product(p, q), 6) AS score
    FROM test JOIN uf USING (user_idx) JOIN itf USING (movie_idx)""")
def _(t: Tables):
    model = visible_factors(t)
    return score.predict(t.test.select("user_idx", "movie_idx"), model.users, model.items).withColumn(
        "score", F.round("score", 6))


@query("mf_score", FACTORS, """SELECT user_idx, movie_idx, row_number() OVER (PARTITION BY user_idx ORDER BY round(s, 9) DESC, movie_idx) AS rank, round(s, 6) AS score
    FROM (SELECT user_idx, movie_idx, bu + bi + list_dot_product(p, q) AS s FROM uf CROSS JOIN itf) ANTI JOIN train USING (user_idx, movie_idx) QUALIFY rank <= 20""")
def _(t: Tables):
    model = visible_factors(t)
    top = score.top_k_dot(model.users, model.items, score.seen_items(t.train))
    return top.select("user_idx", "movie_idx", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query("warm_start", HIST, "SELECT user_idx, pos, round(CASE WHEN pos < 64 THEN x ELSE 0 END, 6) + 0.0 AS x FROM hist UNION ALL SELECT user_idx, unnest(range(64, 72)), 0.0 FROM user_map")
def _(t: Tables):
    start = t.user_map.select("user_idx", V.zeros(72).alias("vec"), F.lit(0.0).alias("bias"))
    return long(factors.warm_start(start, t.history, "user_idx", 72, TEXT_DIM), "user_idx")


@query("concat_factors", HIST, "SELECT user_idx, pos, round(x, 6) + 0.0 AS x FROM hist UNION ALL SELECT user_idx, pos + 64, round(2 * x, 6) + 0.0 FROM hist")
def _(t: Tables):
    doubled = t.history.select("user_idx", V.scaled(F.col("vec"), F.lit(2.0)).alias("vec"))
    return long(factors.concat_factors(t.history, doubled, "user_idx"), "user_idx")


@query("bpr_loss", FACTORS, _triplet_sql(
    "train", "train", "SELECT DISTINCT user_idx, movie_idx FROM train", "(SELECT count(*) FROM train)", 42).replace(
    "SELECT sample_id, user_idx, pos_idx, coalesce", ", trip AS (SELECT sample_id, user_idx, pos_idx, coalesce") + """)
    SELECT round(avg(ln(1 + exp(-((i.bi + list_dot_product(p, i.q)) - (j.bi + list_dot_product(p, j.q)))))), 6) AS loss
    FROM trip JOIN uf USING (user_idx) JOIN itf i ON i.movie_idx = pos_idx JOIN itf j ON j.movie_idx = neg_idx""")
def _(t: Tables):
    model = visible_factors(t)
    return pairwise.bpr_loss(triplets(t), model.users, model.items).withColumn("loss", F.round("loss", 6))


@query("gated_score", CONTENT, """SELECT c.user_idx, c.movie_idx, round(c.score + 0.5 * t.rating_centered, 6) + 0.0 AS score FROM content c JOIN test t USING (user_idx, movie_idx)""")
def _(t: Tables):
    pairs = content.content_score(t.test.select("user_idx", "movie_idx"), t.history, t.item_vectors)
    other = t.test.select("user_idx", "movie_idx", F.col("rating_centered").alias("score"))
    return factors.gated_score(pairs, other).withColumn("score", F.round("score", 6) + F.lit(0.0))


@query("content_score", CONTENT, "SELECT user_idx, movie_idx, round(score, 6) + 0.0 AS score FROM content SEMI JOIN val USING (user_idx, movie_idx)")
def _(t: Tables):
    return content.content_score(t.val.select("user_idx", "movie_idx"), t.history, t.item_vectors).withColumn(
        "score", F.round("score", 6) + F.lit(0.0))


CTES["losses"] = """losses AS (SELECT p_brand AS run, row_number() OVER (PARTITION BY p_brand ORDER BY m) AS epoch, loss FROM (
        SELECT p_brand, date_trunc('month', to_timestamp("timestamp")::TIMESTAMP) AS m, round(avg(rating), 6) AS loss
        FROM train JOIN part ON p_partkey = movie_id GROUP BY ALL))"""


@query("early_stop", [*TRAIN, "losses"], """, marked AS (SELECT *, max(CASE WHEN imp THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS best FROM (
        SELECT *, coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS imp FROM losses)),
    stops AS (SELECT run, coalesce(min(epoch) FILTER (epoch - best >= 7), max(epoch)) AS stop_epoch FROM marked GROUP BY 1)
    SELECT run, max(best) AS best_epoch, min(loss) AS best_loss, max(stop_epoch) AS stop_epoch FROM marked JOIN stops USING (run) WHERE epoch <= stop_epoch GROUP BY 1""")
def _(t: Tables):
    from pyspark.sql import Window as W

    part = t.table("part").select(F.col("p_partkey").cast("int").alias("movie_id"), F.col("p_brand").alias("run"))
    month = F.trunc(F.timestamp_seconds("timestamp").cast("date"), "month")
    losses = t.train.join(part, "movie_id").groupBy("run", month.alias("m")).agg(F.round(F.avg("rating"), 6).alias("loss"))
    epochs = losses.withColumn("epoch", F.row_number().over(W.partitionBy("run").orderBy("m")).cast("bigint"))
    return factors.early_stop(epochs.select("run", "epoch", "loss"), ["run"], 7)


# -- EASE -----------------------------------------------------------------------------

CTES["gram"] = """gram AS (SELECT src_idx, dst_idx, sum(v) AS value FROM (
        SELECT a.movie_idx AS src_idx, b.movie_idx AS dst_idx, a.rating_centered * b.rating_centered AS v FROM train a JOIN train b USING (user_idx)
        UNION ALL SELECT movie_idx, movie_idx, 350.0::DOUBLE FROM movie_map) GROUP BY ALL)"""


@query("gram_self_join", [*TRAIN, "gram"], """SELECT src_idx, round(sum(abs(value)) FILTER (src_idx <> dst_idx), 4) AS off_diagonal, round(max(value) FILTER (src_idx = dst_idx) - 350, 4) AS diagonal
    FROM gram GROUP BY 1""")
def _(t: Tables):
    cells = ease.gram_cells(gram(t), t.n_items, 0.0, BLOCK)
    same = F.col("src_idx") == F.col("dst_idx")
    sums = cells.groupBy("src_idx").agg(
        F.round(F.sum(F.when(~same, F.abs("value"))), 4).alias("off_diagonal"),
        F.round(F.max(F.when(same, F.col("value"))), 4).alias("diagonal"))
    return sums.withColumn("diagonal", F.col("diagonal") + F.lit(0.0))


# Centred ratings are small fractions, so their sums often end exactly on a rounding tie and
# the order of addition would decide it. This rounds at a point no such fraction hits.
SNAP_SQL = "floor({} * 10000 + 0.3) / 10000"


def snapped(column: str):
    return F.floor(F.col(column) * 10000 + F.lit(0.3)) / 10000


NOISE = 1e-9  # what is left of sums that cancel; no real cell is so small


@query("ease_gram", [*TRAIN, "gram"], f"SELECT src_idx, dst_idx, {SNAP_SQL.format('value')} AS value FROM gram WHERE abs(value) > {NOISE:.9f}")
def _(t: Tables):
    cells = ease.gram_cells(gram(t), t.n_items, block=BLOCK)
    return cells.where(F.abs("value") > NOISE).withColumn("value", snapped("value"))


@query("ease_score", [*TRAIN, "gram"], f"""SELECT user_idx, dst_idx AS movie_idx, floor(sum(rating_centered * value / 350) * 10000 + 0.3) / 10000 AS score
    FROM train JOIN gram ON src_idx = movie_idx WHERE src_idx <> dst_idx AND abs(value) > {NOISE:.9f} GROUP BY ALL""")
def _(t: Tables):
    cells = ease.gram_cells(gram(t), t.n_items, 0.0, BLOCK)
    strong = cells.where((F.col("src_idx") != F.col("dst_idx")) & (F.abs("value") > NOISE)).select(
        "src_idx", "dst_idx", (F.col("value") / 350.0).alias("w"))
    return ease.ease_score(t.train, strong).withColumn("score", snapped("score"))


@query("ease_fit")
def _(t: Tables):
    return ease.weight_cells(ease_weights(t), BLOCK).withColumn("w", F.round("w", 6))


@query("ease_top_k")
def _(t: Tables):
    return ranking_of(ease.ease_top_k(t.train, ease_weights(t), block=BLOCK))


# -- fits (no closed SQL form) -----------------------------------------------------------


@query("als_fit")
def _(t: Tables):
    model = als.mllib_als(t.train, RANK, 3)
    return ranking_of(score.top_k_dot(model.users, model.items, score.seen_items(t.train)))


@query("als_half_step")
def _(t: Tables):
    model = als_model(t)
    return long(als.als_half_step(
        t.train, "user_idx", "movie_idx", model.items, model.users, RANK, 0.1, "reference"), "user_idx", digits=4)


@query("als_biased_fit")
def _(t: Tables):
    return history_rows(t, als_model(t).history)


def _trip_cte(seed: int) -> str:
    return _triplet_sql("train", "train", "SELECT DISTINCT user_idx, movie_idx FROM train", "(SELECT count(*) FROM train)", seed).replace(
        "SELECT sample_id, user_idx, pos_idx, coalesce", ", trip AS (SELECT sample_id, user_idx, pos_idx, coalesce") + ")"


LR, KEEP = 0.05, 1 - 0.05 * 1e-4  # a step leaves this part of a parameter


def _gradient_sql(name: str, batch: int, users: str, items: str) -> str:
    """Gradients of one batch: (user_idx, k, g) and (movie_idx, k, g) from lists with the bias slot last."""
    return f""", {name} AS (SELECT *, -1 / (1 + exp(list_dot_product(p, d))) / count(*) OVER () AS w FROM (
        SELECT user_idx, pos_idx, neg_idx, u.p, list_transform(range(1, 66), lambda k: i.q[k] - j.q[k]) AS d FROM trip
        JOIN {users} u USING (user_idx) JOIN {items} i ON i.movie_idx = pos_idx JOIN {items} j ON j.movie_idx = neg_idx
        WHERE (user_idx // 512) % 2 = {batch})),
    {name}_u AS (SELECT user_idx, k, sum(w * d[k]) AS g FROM {name}, (SELECT unnest(range(1, 65)) AS k) GROUP BY ALL),
    {name}_i AS (SELECT movie_idx, k, sum(g) AS g FROM (
        SELECT pos_idx AS movie_idx, k, w * p[k] AS g FROM {name}, (SELECT unnest(range(1, 66)) AS k) UNION ALL
        SELECT neg_idx, k, -w * p[k] FROM {name}, (SELECT unnest(range(1, 66)) AS k)) GROUP BY ALL)"""


def _step_sql(step: int, m: str, v: str) -> str:
    return f"{LR} * (({m}) / (1 - pow(0.9, {step}))) / (sqrt(({v}) / (1 - pow(0.999, {step}))) + 1e-8)"


FIRST = _step_sql(1, "0.1 * a.g", "0.001 * a.g * a.g")


@query("bpr_fit", FACTORS, _trip_cte(43) + f""", ul AS (SELECT user_idx, k, p[k] AS x FROM uf, (SELECT unnest(range(1, 65)) AS k)),
    il AS (SELECT movie_idx, k, CASE WHEN k = 65 THEN bi ELSE q[k] END AS x FROM itf, (SELECT unnest(range(1, 66)) AS k)),
    u0 AS (SELECT user_idx, list_append(p, 1.0) AS p FROM uf), i0 AS (SELECT movie_idx, list_append(q, bi) AS q FROM itf)"""
    + _gradient_sql("s1", 0, "u0", "i0") + f""",
    u1 AS (SELECT user_idx, list_append(list_transform(p, lambda x: x * {KEEP}), 1.0) AS p FROM uf),
    i1l AS (SELECT movie_idx, k, x * {KEEP} - coalesce({FIRST}, 0) AS x, a.g FROM il LEFT JOIN s1_i a USING (movie_idx, k)),
    i1 AS (SELECT movie_idx, list(x ORDER BY k) AS q FROM i1l GROUP BY 1)""" + _gradient_sql("s2", 1, "u1", "i1") + f"""
    SELECT 'user' AS side, user_idx AS idx, (k - 1)::BIGINT AS pos, round(CASE WHEN (user_idx // 512) % 2 = 0
        THEN (x * {KEEP} - coalesce({FIRST}, 0)) * {KEEP}
        ELSE x * {KEEP} * {KEEP} - coalesce({_step_sql(2, "0.1 * b.g", "0.001 * b.g * b.g")}, 0) END, 5) + 0.0 AS x
    FROM ul LEFT JOIN s1_u a USING (user_idx, k) LEFT JOIN s2_u b USING (user_idx, k)
    UNION ALL SELECT 'movie', movie_idx, (k - 1)::BIGINT, round(x * {KEEP} - coalesce(
        {_step_sql(2, "0.9 * 0.1 * coalesce(i1l.g, 0) + 0.1 * b.g", "0.999 * 0.001 * coalesce(i1l.g * i1l.g, 0) + 0.001 * b.g * b.g")}, 0), 5) + 0.0
    FROM i1l LEFT JOIN s2_i b USING (movie_idx, k)""")
def _(t: Tables):
    """Factors and movie biases after two steps from the visible ones."""
    start = visible_factors(t)
    model = pairwise.bpr_fit(sampler(t), start.users, start.items, TEXT_DIM, t.train.count(), 1, LR, batches=2)
    sides = [model.users.select(F.lit("user").alias("side"), F.col("user_idx").alias("idx"), F.posexplode("vec").alias("pos", "x")),
             model.items.select(F.lit("movie").alias("side"), F.col("movie_idx").alias("idx"),
                                F.posexplode(F.concat("vec", F.array("bias"))).alias("pos", "x"))]
    return sides[0].unionByName(sides[1]).select(
        "side", "idx", F.col("pos").cast("bigint").alias("pos"), (F.round("x", 5) + F.lit(0.0)).alias("x"))


@query("bpr_history")
def _(t: Tables):
    return history_rows(t, bpr_model(t).history)


@query("lightgcn_fit", [*HIST, "edges", "node_vecs"], _trip_cte(43) + f""", out AS MATERIALIZED (SELECT node, list(x ORDER BY pos) AS v FROM (
        SELECT node, pos, sum(x) / 3 AS x FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2) GROUP BY ALL) GROUP BY 1),
    nu AS (SELECT count(*)::INTEGER AS n FROM user_map),
    tn AS MATERIALIZED (SELECT user_idx AS u, pos_idx + (SELECT n FROM nu) AS i, neg_idx + (SELECT n FROM nu) AS j FROM trip),
    s AS MATERIALIZED (SELECT u, i, j, p, d, -1 / (1 + exp(list_dot_product(p, d))) / count(*) OVER () AS w, count(*) OVER () AS total FROM (
        SELECT u, i, j, a.v AS p, list_transform(range(1, 65), lambda k: b.v[k] - c.v[k]) AS d
        FROM tn JOIN out a ON a.node = u JOIN out b ON b.node = i JOIN out c ON c.node = j)),
    g0 AS MATERIALIZED (SELECT node, k - 1 AS pos, sum(g) AS x, count(*) * any_value(2e-4 / total) AS r FROM (
        SELECT u AS node, k, w * d[k] AS g, total FROM s, (SELECT unnest(range(1, 65)) AS k) UNION ALL
        SELECT i, k, w * p[k], total FROM s, (SELECT unnest(range(1, 65)) AS k) UNION ALL
        SELECT j, k, -w * p[k], total FROM s, (SELECT unnest(range(1, 65)) AS k)) GROUP BY ALL),
    g1 AS MATERIALIZED (SELECT dst AS node, pos, sum(w * x) AS x FROM adj JOIN g0 ON node = src GROUP BY ALL),
    g2 AS (SELECT dst AS node, pos, sum(w * x) AS x FROM adj JOIN g1 ON node = src GROUP BY ALL),
    g AS MATERIALIZED (SELECT node, pos, sum(x) / 3 AS x FROM (SELECT node, pos, x FROM g0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2) GROUP BY ALL),
    t AS MATERIALIZED (SELECT e0.node, e0.pos, e0.x, coalesce(g.x, 0) + coalesce(g0.r, 0) * e0.x AS g FROM e0 LEFT JOIN g USING (node, pos) LEFT JOIN g0 USING (node, pos)),
    f0 AS MATERIALIZED (SELECT node, pos, x - {_step_sql(1, "0.1 * g", "0.001 * g * g")} AS x FROM t),
    f1 AS MATERIALIZED (SELECT dst AS node, pos, sum(w * x) AS x FROM adj JOIN f0 ON node = src GROUP BY ALL),
    f2 AS (SELECT dst AS node, pos, sum(w * x) AS x FROM adj JOIN f1 ON node = src GROUP BY ALL)
    SELECT node, pos, round(sum(x) / 3, 5) + 0.0 AS x FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY ALL""")
def _(t: Tables):
    """Propagated vectors after one step from the visible ones."""
    items = t.item_vectors.select((F.col("movie_idx") + t.n_users).alias("node"), "vec")
    start = t.history.select(F.col("user_idx").alias("node"), "vec").unionByName(items)
    model = pairwise.lightgcn_fit(t.sliced_adjacency, start, sampler(t), t.n_users, TEXT_DIM, 2, t.train.count(), 1, LR, batches=1, start=start)
    both = model.users.select(F.col("user_idx").alias("node"), "vec").unionByName(
        model.items.select((F.col("movie_idx") + t.n_users).cast("int").alias("node"), "vec"))
    return long(both, "node", digits=5)


@query("lightgcn_history")
def _(t: Tables):
    return history_rows(t, lightgcn_model(t).history)


@query("lightgcn_score", [*HIST, "edges", "node_vecs"], """, mean AS (SELECT node, pos, sum(x) / 3 AS x FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2) GROUP BY ALL),
    lists AS (SELECT node, list(x ORDER BY pos) AS v FROM mean GROUP BY 1),
    nu AS (SELECT count(*) AS n FROM user_map)
    SELECT user_idx, movie_idx, row_number() OVER (PARTITION BY user_idx ORDER BY round(s, 9) DESC, movie_idx) AS rank, round(s, 6) + 0.0 AS score FROM (
        SELECT a.node AS user_idx, (b.node - n)::INTEGER AS movie_idx, list_dot_product(a.v, b.v) AS s FROM nu, lists a, lists b WHERE a.node < n AND b.node >= n)
    ANTI JOIN train USING (user_idx, movie_idx) QUALIFY rank <= 20""")
def _(t: Tables):
    items = t.item_vectors.select((F.col("movie_idx") + t.n_users).alias("node"), "vec")
    nodes = t.history.select(F.col("user_idx").alias("node"), "vec").unionByName(items)
    out = staged(graph.propagate(t.sliced_adjacency, nodes, TEXT_DIM), "propagated").withColumn("bias", F.lit(0.0))
    users = out.where(F.col("node") < t.n_users).withColumnRenamed("node", "user_idx")
    movies = out.where(F.col("node") >= t.n_users).select((F.col("node") - t.n_users).alias("movie_idx"), "vec", "bias")
    top = score.top_k_dot(users, movies, score.seen_items(t.train))
    return top.select("user_idx", "movie_idx", F.col("rank").cast("bigint").alias("rank"),
                      (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query("pairwise_ranker_fit")
def _(t: Tables):
    users, items, samples = ranker_inputs(t)
    ranker = content.pairwise_ranker_fit(samples, users, items)
    return ranking_of(content.ranker_top_k(ranker, users, items, score.seen_items(t.train)))


@query("hybrid_fit")
def _(t: Tables):
    users, items, samples = ranker_inputs(t)
    ranker = content.hybrid_fit(samples, users, items)
    return ranking_of(content.ranker_top_k(ranker, users, items, score.seen_items(t.train)))


@query("embedding_projection")
def _(t: Tables):
    return factors.projection(t.item_vectors, "movie_idx").select(
        "movie_idx", F.round("dim0", 6).alias("dim0"), F.round("dim1", 6).alias("dim1"))


@query("run_feature_engineering", ITEM_IMDB, f"""SELECT movie_idx, {len(VOCAB) + 3} AS n_imdb, 64 AS n_text,
    coalesce(list_position({_VOCAB_SQL}, gl[1]) - 1, {len(VOCAB)})::INTEGER AS genre_idx,
    round(ln(1 + coalesce(n, 0)) / (SELECT max(ln(1 + c)) FROM (SELECT count(*) AS c FROM train GROUP BY movie_idx)), 6) AS pop
    FROM item_imdb LEFT JOIN (SELECT movie_idx, count(*) AS n FROM train GROUP BY 1) USING (movie_idx)""")
def _(t: Tables):
    feats = feature_tables(t)
    return feats.imdb.select("movie_idx", F.size("vec").alias("n_imdb")).join(
        feats.text.select("movie_idx", F.size("vec").alias("n_text")), "movie_idx").join(
        feats.pop.select("movie_idx", F.round("pop", 6).alias("pop")), "movie_idx").join(feats.genre, "movie_idx")


# -- sinks and compositions ----------------------------------------------------------------


@query("write_splits", TRAIN, "SELECT split, count(*) AS n, count(DISTINCT user_idx) AS n_users FROM inter GROUP BY 1")
def _(t: Tables):
    path = folder(t, "splits")
    sinks.write_splits(t.interactions, path)
    return t.spark.read.parquet(path).groupBy("split").agg(
        F.count("*").alias("n"), F.count_distinct("user_idx").alias("n_users"))


@query("write_maps", MAPS, "SELECT * FROM movie_map")
def _(t: Tables):
    path = folder(t, "maps")
    sinks.write_maps(t.user_map, t.movie_map, path)
    return t.spark.read.parquet(f"{path}/movie_map")


@query("write_cold", TRAIN, "SELECT user_idx, user_id, count(*) AS n_train FROM train GROUP BY ALL HAVING count(*) < 20")
def _(t: Tables):
    path = folder(t, "cold")
    sinks.write_cold(prepare.cold_users(t.train), path)
    return t.spark.read.parquet(f"{path}/cold_start_users")


@query("write_stats", TRAIN, """SELECT (SELECT count(*) FROM user_map) AS n_users, (SELECT count(*) FROM movie_map) AS n_movies,
    (SELECT count(*) FROM train) AS n_train, (SELECT count(*) FROM val) AS n_val, (SELECT count(*) FROM test) AS n_test,
    (SELECT count(*) FROM (SELECT user_idx FROM train GROUP BY 1 HAVING count(*) < 20)) AS n_cold""")
def _(t: Tables):
    path = folder(t, "stats")
    sinks.write_stats(t.prepared.stats, path)
    return t.spark.read.schema(
        "n_users bigint, n_movies bigint, n_train bigint, n_val bigint, n_test bigint, n_cold bigint").json(path)


@query("save_load_factors", HIST, "SELECT user_idx, pos, round(x, 6) + 0.0 AS x FROM hist")
def _(t: Tables):
    path = folder(t, "factors")
    sinks.save_factors(visible_factors(t), path)
    return long(sinks.load_factors(t.spark, path).users, "user_idx")


@query("model_store", FACTORS, """SELECT round(sqrt(avg(pow(rating_centered - (bu + bi + list_dot_product(p, q)), 2))), 6) AS rmse
    FROM train JOIN uf USING (user_idx) JOIN itf USING (movie_idx)""")
def _(t: Tables):
    """RMSE of a stored model: users and movies of the newest of two versions."""
    store, model = folder(t, "versions"), visible_factors(t)
    blank = model.users.withColumn("vec", V.zeros(TEXT_DIM))
    model_store.save_model(factors.FactorModel(blank, model.items, TEXT_DIM), store, "als")
    model_store.save_model(model, store, "als")
    return factors.rmse(t.train, model_store.load_model(t.spark, store, "als")).withColumn("rmse", F.round("rmse", 6))


@query("evaluate_store", REPORT, """SELECT CASE model WHEN 'Popularity' THEN 'ALS' ELSE 'BPR' END AS model, segment, metric,
    round(value, 6) AS value FROM report""")
def _(t: Tables):
    """The report of two stored factor models, evaluated from the store alone and read back."""
    store, path = folder(t, "stored-models"), folder(t, "stored-report")
    model_store.save_model(factors.FactorModel(*popularity_factors(t), 1), store, "als")
    model_store.save_model(factors.FactorModel(*content_factors(t), TEXT_DIM), store, "bpr")
    evaluate_plan.evaluate_store(t.prepared, store, report_path=path)
    return sinks.read_report(t.spark, path).withColumn("value", F.round("value", 6))


@query("cached_or_compute", TRAIN, "SELECT movie_idx, count(*) AS cnt FROM train GROUP BY 1")
def _(t: Tables):
    path = folder(t, "cached")
    sinks.cached_or_compute(t.spark, path, lambda: prepare.item_popularity(t.train).select("movie_idx", "cnt"), skip=True)
    return sinks.cached_or_compute(t.spark, path, lambda: t.movie_map, skip=True)


@query("upsert_report", REPORT, "SELECT model, segment, metric, round(value, 6) AS value FROM report")
def _(t: Tables):
    path = folder(t, "report")
    stale = ranking_eval.evaluate_model("Popularity", popularity_top(t), t.val, t.train)
    sinks.upsert_report(stale, path)
    sinks.upsert_report(report_of(t), path)
    return sinks.read_report(t.spark, path).withColumn("value", F.round("value", 6))


@_once
def trained(t: Tables):
    """The fitted models and the store that holds them."""
    store = folder(t, "models")
    return train_plan.train_models(
        t.prepared, feature_tables(t), store, options=OPTIONS, n_genres=len(VOCAB)), store


@query("train")
def _(t: Tables):
    """Training curves of the stored models."""
    models, _ = trained(t)
    rows = [
        (name, epoch + 1, float(value))
        for name in ("als", "bpr", "lightgcn") for epoch, value in enumerate(getattr(models, name).history)]
    return t.spark.createDataFrame(rows, "model string, epoch int, loss double")


@query("evaluate")
def _(t: Tables):
    """Report of all models, read back from the store."""
    return evaluate_plan.evaluate_store(t.prepared, trained(t)[1], split="val", report_path=folder(t, "eval")).withColumn(
        "value", F.round("value", 4))
