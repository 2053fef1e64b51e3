import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marquee.functions import vectors as V
from marquee.models import als, content, ease, factors, pairwise
from marquee.operators import blocks, graph, prepare, ranking_eval, sampling, score


def ratings(spark, n_users=40, n_items=30, seed=1):
    rng = np.random.default_rng(seed)
    rows = [
        (u, int(m), float(rng.normal()))
        for u in range(n_users) for m in rng.choice(n_items, size=rng.integers(3, 15), replace=False)
    ]
    return spark.createDataFrame(rows, "user_idx int, movie_idx int, rating_centered double"), rows


def dense(rows, n_users=40, n_items=30):
    x = np.zeros((n_users, n_items))
    for u, m, v in rows:
        x[u, m] = v
    return x


def vectors_of(df, key):
    return {r[key]: np.array(r["vec"]) for r in df.collect()}


def expected_top(scores, seen, k):
    out = {}
    for u, row in enumerate(scores):
        row = np.where(seen[u], -np.inf, row)
        best = sorted((m for m in range(len(row)) if np.isfinite(row[m])), key=lambda m: (-round(row[m], 9), m))[:k]
        out[u] = best
    return out


def listed(top):
    pdf = top.toPandas().sort_values(["user_idx", "rank"])
    return {u: list(g.movie_idx) for u, g in pdf.groupby("user_idx")}


@pytest.mark.parametrize("blocks", [(2048, 4096), (7, 4)])
def test_top_k_dot_matches_brute_force(spark, blocks):
    train, rows = ratings(spark)
    rng = np.random.default_rng(2)
    p, q = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(-2, 3, (30, 3)).astype(float)  # many ties
    users = spark.createDataFrame([(i, [float(x) for x in v], 0.5) for i, v in enumerate(p)], "user_idx int, vec array<double>, bias double")
    items = spark.createDataFrame([(i, [float(x) for x in v], float(i % 2)) for i, v in enumerate(q)], "movie_idx int, vec array<double>, bias double")
    top = score.top_k_dot(users, items, score.seen_items(train), 6, 0.0, *blocks)
    want = expected_top(p @ q.T + 0.5 + np.arange(30) % 2, dense(rows) != 0, 6)
    assert listed(top) == want


def test_ranking_metrics(spark):
    top = spark.createDataFrame([(0, 1, 3.0, 1), (0, 2, 2.0, 2), (0, 3, 1.0, 3), (1, 1, 1.0, 1)],
                                "user_idx int, movie_idx int, score double, rank int")
    truth = spark.createDataFrame([(0, 2), (0, 4), (1, 1)], "user_idx int, movie_idx int")
    rows = ranking_eval.per_user_metrics(top, truth, (3,)).collect()
    assert len(rows) == 1  # user 1 had too few candidates
    assert rows[0]["ndcg@3"] == pytest.approx(0.386853, abs=1e-6)
    assert rows[0]["recall@3"] == 0.5


def test_report_shapes(spark):
    report = spark.createDataFrame(
        [("A", "overall", "ndcg@10", 0.5), ("A", "cold", "recall@10", 0.2), ("SASRec", "overall", "ndcg@10", 0.9)],
        "model string, segment string, metric string, value double")
    assert {tuple(r) for r in ranking_eval.compare_models(report).collect()} == {
        ("A", 0.5, 0.0, 0.0, 0.2), ("SASRec", 0.9, 0.0, 0.0, 0.0)}
    flat = {tuple(r) for r in ranking_eval.flatten_report(ranking_eval.nested_report(report)).collect()}
    assert flat == {("A", "Overall", 0.5, 0.0), ("A", "Cold", 0.0, 0.2)}


def test_graph_normalisation_and_propagation(spark):
    train = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "user_idx int, movie_idx int")
    adj = graph.sym_normalise(graph.bipartite_edges(train, 2))
    weights = {(r.src, r.dst): r.w for r in adj.collect()}
    assert weights == pytest.approx({
        (0, 2): 0.707107, (2, 0): 0.707107, (0, 3): 0.5, (3, 0): 0.5, (1, 3): 0.707107, (3, 1): 0.707107}, abs=1e-6)
    a = np.zeros((4, 4))
    for (i, j), w in weights.items():
        a[i, j] = w
    e = np.arange(8.0).reshape(4, 2)
    emb = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e)], "node int, vec array<double>")
    got = vectors_of(graph.propagate(adj, emb, 2, 2), "node")
    np.testing.assert_allclose([got[i] for i in range(4)], (e + a @ e + a @ a @ e) / 3)


def test_ease_fixture(spark):
    x = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0)], "user_idx int, movie_idx int, rating_centered double")
    weights = ease.ease_fit(ease.ease_gram(x, 2, 2), 2, 1.0, 2)
    cells = {(r.src_idx, r.dst_idx): r.w for r in ease.weight_cells(weights, 2).collect()}
    assert cells == pytest.approx({(0, 1): 0.5, (1, 0): 1 / 3})
    got = {r.movie_idx: r.score for r in ease.ease_score(x, ease.weight_cells(weights, 2)).where("user_idx = 0").collect()}
    assert got == pytest.approx({0: 1 / 3, 1: 0.5})


@pytest.mark.parametrize("block,rows_per_task", [(64, 10**6), (8, 10**6), (8, 20)])
def test_ease_matches_dense_inverse(spark, block, rows_per_task):
    train, rows = ratings(spark)
    x = dense(rows)
    gram = ease.ease_gram(train, 30, block, rows_per_task=rows_per_task)
    got = np.zeros((30, 30))
    for r in ease.gram_cells(gram, 30, 2.0, block).collect():
        got[r.src_idx, r.dst_idx] = r.value
    np.testing.assert_allclose(got, x.T @ x + 2 * np.eye(30), atol=1e-9)
    weights = ease.ease_fit(gram, 30, 2.0, block)
    inverse = np.linalg.inv(x.T @ x + 2 * np.eye(30))
    want = -inverse / np.diag(inverse)
    np.fill_diagonal(want, 0)
    b = np.zeros((30, 30))
    for r in ease.weight_cells(weights, block).collect():
        b[r.src_idx, r.dst_idx] = r.w
    np.testing.assert_allclose(b, want, atol=1e-9)
    top = ease.ease_top_k(train, weights, 5, block=block, width=4, user_block=9)
    assert listed(top) == expected_top(x @ want, x != 0, 5)


def solve_half(rows, q, bias, current, reg, reference):
    """Brute-force half step for users."""
    vecs, biases = np.zeros_like(current), np.zeros(len(current))
    for u in range(len(current)):
        mine = [(m, v) for uu, m, v in rows if uu == u]
        if not mine:
            continue
        idx = [m for m, _ in mine]
        res = np.array([v for _, v in mine]) - bias[idx]
        if reference:
            res = res - q[idx] @ current[u]
        biases[u] = res.sum() / (len(idx) + reg)
        vecs[u] = np.linalg.solve(q[idx].T @ q[idx] + reg * np.eye(q.shape[1]), q[idx].T @ (res - biases[u]))
    return vecs, biases


@pytest.mark.parametrize("residual", ["full", "reference"])
@pytest.mark.parametrize("hot", [False, True])
def test_als_half_step(spark, residual, hot):
    train, rows = ratings(spark, 20, 15)
    rng = np.random.default_rng(3)
    q, bias, current = rng.normal(size=(15, 3)), rng.normal(size=15), rng.normal(size=(21, 3))
    fixed = spark.createDataFrame([(i, q[i].tolist(), float(bias[i])) for i in range(15)], "movie_idx int, vec array<double>, bias double")
    present = spark.createDataFrame([(i, current[i].tolist(), 0.0) for i in range(21)], "user_idx int, vec array<double>, bias double")
    hot_users = als.hot_entities(train, "user_idx", 8) if hot else None
    out = als.als_half_step(train, "user_idx", "movie_idx", fixed, present, 3, 0.1, residual, hot_users).collect()
    vecs, biases = solve_half(rows, q, bias, current, 0.1, residual == "reference")
    assert len(out) == 21
    for r in out:
        np.testing.assert_allclose(r.vec, vecs[r.user_idx], atol=1e-8)
        assert r.bias == pytest.approx(biases[r.user_idx], abs=1e-8)


def test_als_rmse_falls(spark):
    train, _ = ratings(spark)
    users, items = spark.range(40).select(F.col("id").cast("int").alias("user_idx")), spark.range(30).select(F.col("id").cast("int").alias("movie_idx"))
    model = als.als_fit(train, users, items, rank=4, iterations=4)
    assert model.history[-1] < model.history[0] < 1.0


def test_pairwise_gradient_matches_finite_differences(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=(6, 3))  # users 0..2, movies 3..5
    samples = [(0, 3, 4), (1, 4, 5), (2, 5, 3), (0, 4, 5)]

    def loss(mat):
        return np.mean([np.log1p(np.exp(-(mat[u] @ (mat[i] - mat[j])))) for u, i, j in samples])

    users = spark.createDataFrame([(i, e[i].tolist()) for i in range(3)], "idx int, vec array<double>")
    items = spark.createDataFrame([(i, e[3 + i].tolist()) for i in range(3)], "idx int, vec array<double>")
    trip = spark.createDataFrame([(u, i - 3, j - 3) for u, i, j in samples], "user_idx int, pos_idx int, neg_idx int")
    for block in (512, 1):
        rows = pairwise.pairwise_gradients(pairwise.batched(trip, 1, block), users, items, 3, len(samples)).collect()
        assert sum(r.loss for r in rows) == pytest.approx(loss(e))
        assert sum(r.uses for r in rows) == 3 * len(samples)
        grad = np.zeros_like(e)
        for r in rows:
            grad[r.idx if r.is_user else 3 + r.idx] += r.grad
        for at in np.ndindex(*e.shape):
            up, down = e.copy(), e.copy()
            up[at] += 1e-6
            down[at] -= 1e-6
            assert grad[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


def test_triplets(spark):
    rng = np.random.default_rng(5)
    pos = pd.DataFrame([(u, int(m)) for u in range(12) for m in rng.choice(20, size=4, replace=False)], columns=["user_idx", "movie_idx"])
    positives = spark.createDataFrame(pos, "user_idx int, movie_idx int")
    counts = prepare.item_popularity(positives)
    got = sampling.sample_triplets(positives, counts, 3_000).toPandas()
    assert len(got) == 3_000 and got.sample_id.is_unique
    known = set(map(tuple, pos.values))
    assert all((u, p) in known for u, p in zip(got.user_idx, got.pos_idx))
    assert [(u, n) in known for u, n in zip(got.user_idx, got.neg_idx)] == list(got.is_false_negative)
    assert not got.is_false_negative.any()
    # a user who rated everything keeps the last draw, flagged
    full = spark.createDataFrame([(0, m) for m in range(3)], "user_idx int, movie_idx int")
    assert sampling.sample_triplets(full, prepare.item_popularity(full), 10).where(~F.col("is_false_negative")).count() == 0


def test_bpr_and_lightgcn_losses_fall(spark):
    rows = [(u, m) for u in range(20) for m in range(20) if (u // 10 == m // 10) and (u + m) % 3]
    train = spark.createDataFrame(rows, "user_idx int, movie_idx int")
    sampler = sampling.TripletSampler(train, prepare.item_popularity(train))
    ids = spark.range(20).select(F.col("id").cast("int").alias("user_idx"))
    items = spark.range(20).select(F.col("id").cast("int").alias("movie_idx"))
    model = pairwise.bpr_fit(
        sampler, factors.random_factors(ids, "user_idx", 4, 1), factors.random_factors(items, "movie_idx", 4, 2),
        4, samples=400, epochs=4, lr=0.2, batches=2, block=4)
    assert model.history[-1] < model.history[0]
    adj = graph.sym_normalise(graph.bipartite_edges(train, 20))
    nodes = spark.range(40).select(F.col("id").cast("int").alias("node"))
    gcn = pairwise.lightgcn_fit(adj, nodes, sampler, 20, dim=4, layers=2, samples=400, epochs=3, lr=0.2)
    assert gcn.history[-1] < gcn.history[0]
    assert gcn.users.count() == gcn.items.count() == 20


def test_warm_start_widths(spark):
    start = spark.createDataFrame([(0, [1.0, 2.0, 3.0], 0.0), (1, [4.0, 5.0, 6.0], 0.0)], "user_idx int, vec array<double>, bias double")
    trained = spark.createDataFrame([(0, [9.0, 8.0])], "user_idx int, vec array<double>")
    got = vectors_of(factors.warm_start(start, trained, "user_idx", 3, 2), "user_idx")
    assert list(got[0]) == [9.0, 8.0, 3.0] and list(got[1]) == [4.0, 5.0, 6.0]
    wide = spark.createDataFrame([(0, [9.0, 8.0, 7.0, 6.0])], "user_idx int, vec array<double>")
    assert list(vectors_of(factors.warm_start(start, wide, "user_idx", 3, 4), "user_idx")[0]) == [9.0, 8.0, 7.0]


def test_ranker_as_factors_equals_its_features(spark):
    users = spark.createDataFrame([(0, [1.0, 2.0], [1.0, 0.0])], "user_idx int, text array<double>, genre array<double>")
    items = spark.createDataFrame([(0, [0.5, 1.0], [0.0, 1.0], 0.1, 0.2, 0.3, 0.4), (1, [1.0, 0.0], [1.0, 1.0], 0.4, 0.3, 0.2, 0.1)],
                                  "movie_idx int, text array<double>, genre array<double>, runtime double, vote double, votes double, pop double")
    ranker = content.PairwiseRanker(content.CONTENT_DOTS, {"text": 0.5, "genre": 2.0, "runtime": 1.0, "vote": -1.0, "votes": 3.0, "pop": 0.7})
    pairs = spark.createDataFrame([(0, 0), (0, 1)], "user_idx int, movie_idx int")
    direct = content.pair_features(pairs, users, items, ranker.dots).select("movie_idx", ranker.score().alias("score"))
    want = {r.movie_idx: r.score for r in direct.collect()}
    top = content.ranker_top_k(ranker, users, items, spark.createDataFrame([], "user_idx int, movie_idx int"), 2)
    assert {r.movie_idx: r.score for r in top.collect()} == pytest.approx(want)


def test_ranker_learns_the_preferred_genre(spark):
    users = spark.createDataFrame([(u, [0.0], [1.0, 0.0]) for u in range(5)], "user_idx int, text array<double>, genre array<double>")
    items = spark.createDataFrame([(m, [0.0], [float(m < 5), float(m >= 5)], 0.0, 0.0, 0.0, 0.0) for m in range(10)],
                                  "movie_idx int, text array<double>, genre array<double>, runtime double, vote double, votes double, pop double")
    trip = spark.createDataFrame([(i, i % 5, i % 5, 5 + i % 5) for i in range(40)], "sample_id long, user_idx int, pos_idx int, neg_idx int")
    assert content.pairwise_ranker_fit(trip, users, items).weights["genre"] > 0.5


def test_unit_and_wide_sums(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0])], "k int, vec array<double>")
    got = {r.k: list(r.u) for r in df.select("k", V.unit(F.col("vec")).alias("u")).collect()}
    assert got == {0: [0.6, 0.8], 1: [0.0, 0.0]}
    wide = spark.range(6).select((F.col("id") % 2).alias("k"), F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: i * 1.0).alias("vec"))
    for r in wide.groupBy("k").agg(V.vector_sum(F.col("vec"), 120, F.lit(2.0)).alias("s")).collect():
        np.testing.assert_allclose(r.s, np.arange(120) * 6.0)


def test_gated_score(spark):
    a = spark.createDataFrame([(0, 0, 1.0)], "user_idx int, movie_idx int, score double")
    b = spark.createDataFrame([(0, 0, 4.0)], "user_idx int, movie_idx int, score double")
    assert factors.gated_score(a, b, 1.0).first().score == pytest.approx(1 + 4 / (1 + math.exp(-1)))


def test_sliced_product_equals_the_dense_one(spark):
    rng = np.random.default_rng(6)
    a = np.where(rng.random((50, 50)) < 0.2, rng.normal(size=(50, 50)), 0)
    a[7] = rng.normal(size=50)  # a hub
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "src int, dst int, w double")
    e = rng.normal(size=(50, 5))
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e) if i != 3], "node int, vec array<double>")
    e[3] = 0
    for sources, slice_edges in ((4096, 131_072), (8, 20), (1, 1)):
        got = vectors_of(blocks.product(blocks.sliced(edges, sources, slice_edges), emb, 5), "node")
        want = a.T @ e
        assert set(got) == set(np.flatnonzero(np.abs(a).sum(axis=0)))
        for i, v in got.items():
            np.testing.assert_allclose(v, want[i], atol=1e-12)
    assert blocks.product(blocks.sliced(edges.where("false")), emb, 5).count() == 0


def adam_by_hand(vec, grads_by_step, lr, decay):
    """Lazy Adam with decoupled decay, one row."""
    m = v = np.zeros_like(vec)
    last = 0
    for step, g in grads_by_step:
        idle = step - last
        m, v, last = 0.9 ** idle * m + 0.1 * g, 0.999 ** idle * v + 0.001 * g * g, step
        vec = vec * (1 - lr * decay) ** idle - lr * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return vec, last


def test_lazy_adam_catches_up(spark):
    start = np.array([[1.0, -2.0], [0.5, 0.0], [3.0, 3.0]])
    state = pairwise.adam_state(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(start)], "idx int, vec array<double>"), 2)
    steps = {1: {0: [0.1, -0.2], 1: [1e-3, 0.0]}, 2: {1: [0.4, 0.4]}, 4: {0: [-0.3, 0.2]}}
    for step, grads in steps.items():
        rows = spark.createDataFrame(list(grads.items()), "idx int, grad array<double>")
        state = pairwise.lazy_adam(state, rows, step, 0.05, 0.1)
    got = vectors_of(pairwise.decayed(state, 5, 0.05, 0.1), "idx")
    for i in range(3):
        vec, last = adam_by_hand(start[i], [(s, np.array(g[i])) for s, g in steps.items() if i in g], 0.05, 0.1)
        np.testing.assert_allclose(got[i], vec * 0.995 ** (5 - last), atol=1e-12)


def test_watch_agrees_with_early_stop(spark):
    losses = [3.0, 2.0, 2.5, 2.4, 2.3, 1.0]
    watch, stopped = pairwise.Watch(3), None
    for i, loss in enumerate(losses):
        if watch.stop_after(loss, i):
            stopped = i
            break
    history = spark.createDataFrame([("r", i + 1, x) for i, x in enumerate(losses)], "run string, epoch int, loss double")
    want = factors.early_stop(history, ["run"], 3).first()
    assert (watch.best + 1, stopped + 1, min(watch.losses)) == (want.best_epoch, want.stop_epoch, want.best_loss)
    assert watch.state == watch.best


def test_fit_returns_its_best_epoch(spark):
    rows = [(u, m) for u in range(20) for m in range(20) if (u // 10 == m // 10) and (u + m) % 3]
    train = spark.createDataFrame(rows, "user_idx int, movie_idx int")
    sampler = sampling.TripletSampler(train, prepare.item_popularity(train))
    held = sampler.draw(300, 7)
    users, items = (factors.random_factors(spark.range(20).select(F.col("id").cast("int").alias(k)), k, 4, s) for k, s in (("user_idx", 1), ("movie_idx", 2)))
    for lr, epochs, patience in ((0.1, 3, 7), (50.0, 6, 1)):  # the second one only gets worse
        model = pairwise.bpr_fit(sampler, users, items, 4, samples=300, epochs=epochs, lr=lr, batches=2, block=4, validation=held, patience=patience)
        best = model.params["best_epoch"]
        assert model.val_history[best] == min(model.val_history)
        assert pairwise.bpr_loss(held, model.users, model.items).first().loss == pytest.approx(model.val_history[best])
    assert len(model.val_history) < 7
    adj = graph.sym_normalise(graph.bipartite_edges(train, 20))
    nodes = spark.range(40).select(F.col("id").cast("int").alias("node"))
    gcn = pairwise.lightgcn_fit(adj, nodes, sampler, 20, dim=4, layers=2, samples=300, epochs=2, lr=0.2, batches=2, block=4, validation=held)
    assert gcn.val_history[gcn.params["best_epoch"]] == min(gcn.val_history) < gcn.val_history[0]
    assert pairwise.bpr_loss(held, gcn.users, gcn.items).first().loss == pytest.approx(min(gcn.val_history))


def test_top_k_dot_stores_each_side_once(spark):
    """However many blocks there are, no row is repeated per block; bounds, gaps and seen copies change no list."""
    rng = np.random.default_rng(5)
    p = rng.normal(size=(30, 4)) * rng.choice([0, 0.1, 3], (30, 1))
    q = rng.normal(size=(50, 4)) * rng.choice([0, 0.01, 1, 20], (50, 1))
    bu, bi = rng.normal(size=30), np.where(rng.random(50) < 0.1, np.nan, rng.choice([-5.0, 0.0, 4.0], 50))
    users = spark.createDataFrame([(i, [float(x) for x in v], float(b)) for i, (v, b) in enumerate(zip(p, bu))], "user_idx int, vec array<double>, bias double")
    items = spark.createDataFrame([(i, [float(x) for x in v], float(b)) for i, (v, b) in enumerate(zip(q, bi))], "movie_idx int, vec array<double>, bias double")
    pairs = [(u, m) for u in range(30) for m in range(50) if rng.random() < 0.3]
    seen = np.zeros((30, 50), bool)
    seen[tuple(np.array(pairs).T)] = True
    top = score.top_k_dot(users, items, spark.createDataFrame(pairs, "user_idx int, movie_idx int"), 6, 0.25, 4, 3)
    assert "Generate" not in top._jdf.queryExecution().optimizedPlan().toString()
    assert listed(top) == expected_top(p @ q.T + bu[:, None] + bi + 0.25, seen, 6)


def test_top_k_dot_takes_many_user_blocks_through_the_movies_at_once(spark, monkeypatch):
    """A task holds several user blocks, and a negative or missing index changes nothing for the others."""
    monkeypatch.setattr(score, "task_slots", lambda _: 1)
    rng = np.random.default_rng(6)
    p, q = rng.normal(size=(30, 3)), rng.normal(size=(25, 3)) * rng.choice([0, 1], (25, 1))
    users = spark.createDataFrame([(i - 4, [float(x) for x in v], 0.0) for i, v in enumerate(p)] + [(None, [0.0] * 3, 0.0)],
                                  "user_idx int, vec array<double>, bias double")
    items = spark.createDataFrame([(i, [float(x) for x in v], 0.0) for i, v in enumerate(q)], "movie_idx int, vec array<double>, bias double")
    seen = spark.createDataFrame([(u - 4, m) for u in range(30) for m in range(u % 5, 25, 5)], "user_idx int, movie_idx int")
    blocks = score._user_blocks(users.where("user_idx >= 0").selectExpr("user_idx", "vec as user_vec", "bias as user_bias"), seen, 4)
    assert blocks.rdd.getNumPartitions() == 3  # 7 blocks
    assert blocks.where("ub is not null").count() == 7
    mask = np.array([[m % 5 == u % 5 for m in range(25)] for u in range(30)])
    want = expected_top(p @ q.T, mask, 6)
    assert listed(score.top_k_dot(users, items, seen, 6, 0.0, 4, 3)) == {u - 4: top for u, top in want.items()}


def test_ease_gram_keeps_only_its_cells(spark):
    """Blocks without common users are not stored, and a rating is not repeated per block."""
    train = spark.createDataFrame(
        [(0, 0, 1.0), (0, 9, 2.0), (1, 5, 3.0), (2, 9, 4.0)], "user_idx int, movie_idx int, rating_centered double")
    gram = ease.ease_gram(train, 10, 2)
    blocks = {(r.bi, r.bj): (list(r["at"]), list(r.cells)) for r in gram.collect()}
    assert blocks.pop((0, 4)) == ([1], [2.0])
    assert blocks == {(i, i): ([0, 3], [float(i == 0), {2: 9.0, 4: 20.0}.get(i, 0.0)]) for i in range(5)}
    ridge = {(r.src_idx, r.dst_idx): r.value for r in ease.gram_cells(gram, 10, 0.5, 2).collect()}
    assert ridge[1, 1] == 0.5 and ridge[9, 9] == 20.5 and ridge[9, 0] == 2.0


def test_a_task_sends_one_partial_sum_per_target(spark):
    edges = spark.createDataFrame([(s, d, 1.0) for s in range(40) for d in range(5)], "src int, dst int, w double")
    emb = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "node int, vec array<double>")
    rows = blocks.partial_products(blocks.sliced(edges, 8), emb, 2).collect()  # five blocks of sources
    assert sorted((r.node, *r.vec) for r in rows) == [(d, 40.0, 780.0) for d in range(5)]


def test_als_half_step_shuffles_no_vector_per_rating(spark):
    train, _ = ratings(spark, 20, 15)
    fixed = spark.createDataFrame([(i, [1.0, float(i)], 0.1) for i in range(15)], "movie_idx int, vec array<double>, bias double")
    present = spark.createDataFrame([(i, [0.0, 0.0], 0.0) for i in range(20)], "user_idx int, vec array<double>, bias double")
    out = als.als_half_step(train, "user_idx", "movie_idx", fixed, present, 2, 0.1)
    assert "hashpartitioning(movie_idx" not in out._jdf.queryExecution().executedPlan().toString()


def test_predict_sends_no_vector_per_pair(spark):
    """Pairs of several ranges and panels, ids given twice, null numbers and unequal lengths, against a plain join."""
    pairs = spark.createDataFrame(
        [(u, m, f"{u}-{m}") for u in (0, 1, 5000, 9000, None) for m in (0, 3, 4, 5, 4095, 4096, 9000, None)] + [(1, 3, "again")],
        "user_idx int, movie_idx int, note string")
    users = spark.createDataFrame(
        [(0, [1.0, 2.0], 0.5), (1, [0.5, -1.0], 1.0), (1, [3.0, 0.0], 0.0), (5000, None, 0.0), (7, [1.0, 1.0], 0.0), (None, [1.0, 1.0], 0.0)],
        "user_idx int, vec array<double>, bias double")
    items = spark.createDataFrame(
        [(0, [2.0, 1.0], 0.0), (3, [1.0, None], 0.0), (4, [1.0], 0.0), (5, [1.0, 4.0], None), (4095, [0.0, 1.0], 0.25), (4096, [1.0, 1.0], -1.0), (4096, [2.0, 1.0], 2.0)],
        "movie_idx int, vec array<double>, bias double")
    i = items.select("movie_idx", F.col("vec").alias("q"), F.col("bias").alias("bi"))
    wanted = pairs.join(users, "user_idx").join(i, "movie_idx").select(
        "movie_idx", "user_idx", "note", (0.125 + F.col("bias") + F.col("bi") + V.dot(F.col("vec"), F.col("q"))).alias("score"))
    found = score.predict(pairs, users, items, 0.125)

    def key(row):
        return tuple((x is None, x or 0) for x in row)

    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, wanted.collect()), key=key)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "vec" not in plan and "user_idx#" in plan  # the pairs meet stored panels, not a table of vectors
    cosines = content.content_score(pairs, users, items)
    assert cosines.columns == [*pairs.columns, "score"] and cosines.where("score is null").isEmpty()
