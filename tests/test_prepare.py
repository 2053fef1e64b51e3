import random
import re

import pytest
from pyspark.sql import functions as F

from marquee.functions import scalars as S
from marquee.functions.ranking import dense_index, rank_within, running_total
from marquee.models.factors import early_stop
from marquee.operators import clean, describe, features, prepare
from marquee.plans.preprocess import preprocess


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()[0]


SPLIT_SIZES = {
    1: (1, 0, 0), 2: (1, 1, 0), 3: (1, 1, 1), 4: (2, 1, 1), 5: (3, 1, 1), 6: (4, 1, 1), 9: (7, 1, 1),
    10: (8, 1, 1), 11: (8, 1, 2), 15: (12, 1, 2), 20: (16, 2, 2), 25: (20, 2, 3),
}


def test_split_sizes_and_time_order(spark):
    rows = [(f"u{n}", m, 3.0, m * 40 * 86_400) for n in SPLIT_SIZES for m in range(n)]
    df = spark.createDataFrame(rows, "user_id string, movie_id int, rating double, timestamp long")
    out = prepare.temporal_split(df).collect()
    for n, sizes in SPLIT_SIZES.items():
        mine = sorted((r.timestamp, r.split) for r in out if r.user_id == f"u{n}")
        assert tuple(sum(s == name for _, s in mine) for name in ("train", "val", "test")) == sizes
        assert [s for _, s in mine] == sorted((s for _, s in mine), key=["train", "val", "test"].index)


def test_kcore_and_trace(spark):
    pairs = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 3)]
    df = spark.createDataFrame([(u, m, 3.0, 0) for u, m in pairs], "user_id string, movie_id int, rating double, timestamp long")
    trace = []
    kept = {(r.user_id, r.movie_id) for r in prepare.kcore_filter(df, 2, 2, trace).collect()}
    assert kept == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}
    assert [t["rows_dropped"] for t in trace] == [0, 1, 1, 0, 0, 0]


def test_kcore_can_empty_the_table(spark):
    df = spark.createDataFrame([("a", 1, 3.0, 0)], "user_id string, movie_id int, rating double, timestamp long")
    assert prepare.kcore_filter(df, 2, 2).count() == 0


def test_id_map_sorts_users_as_text(spark):
    ids = spark.createDataFrame([("ML_2",), ("ML_10",), ("ML_1",), ("ML_2",)], "user_id string")
    got = {r.user_id: r.user_idx for r in prepare.build_id_map(ids, "user_id", "user_idx").collect()}
    assert got == {"ML_1": 0, "ML_10": 1, "ML_2": 2}


def test_dense_index_and_running_total(spark):
    df = spark.range(10_000).select((F.col("id") * 7 % 10_000).alias("v"))
    numbered = dense_index(df.repartition(7), [F.col("v").desc()], "i")
    assert numbered.where(F.col("i") != 9_999 - F.col("v")).count() == 0
    line = running_total(numbered.select("i", F.lit(2).alias("n")), "i", "n", "low", width=16)
    assert line.where(F.col("low") != F.col("i") * 2).count() == 0


def test_rank_within_hot_group(spark):
    df = spark.range(3_000).select(
        F.when(F.col("id") < 2_000, 0).otherwise(F.col("id") % 5).alias("k"), F.col("id").alias("t"))
    ranked = rank_within(df, "k", [F.col("t")], F.floor(F.col("t") / 100), "r", "n").toPandas()
    for _, group in ranked.groupby("k"):
        ordered = group.sort_values("t")
        assert list(ordered.r) == list(range(1, len(ordered) + 1)) and set(ordered.n) == {len(ordered)}


def test_dedup_keeps_the_last(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 5), (1, 1, 4.0, 9), (1, 1, 3.0, 7), (2, 1, 6.0, 1), (3, None, 3.0, 1)],
                               "user_id int, movie_id int, rating double, timestamp long")
    got = clean.clean_ratings(df, ["timestamp"]).collect()
    assert [(r.user_id, r.movie_id, r.rating) for r in got] == [("ML_1", 1, 4.0)]


def test_scalars(spark):
    assert [one(spark, S.imdb_key(F.lit(v).cast("bigint"))) for v in (114709, 12345678, None)] == [
        "tt0114709", "tt12345678", None]
    runtimes = [one(spark, S.runtime_norm(F.lit(v).cast("double"))) for v in (None, 30, 150, 300)]
    assert runtimes == pytest.approx([0.222222, 0.0, 0.5, 1.0], abs=1e-6)
    buckets = [one(spark, S.activity_bucket(F.lit(n), (20, 50, 200, 500))) for n in (20, 21, 500, 501)]
    assert buckets == ["<= 20", "20-50", "200-500", "500+"]
    texts = ["  two words ", "", None, "x" * 21]
    assert [one(spark, S.word_count(F.lit(t).cast("string"))) for t in texts] == [2, 0, 0, 1]
    assert [one(spark, S.has_overview(F.lit(t).cast("string"))) for t in texts] == [False, False, False, True]
    assert one(spark, S.parse_year(F.lit("not a date"))) is None
    vocab = ["Drama", "Comedy"]
    genres = S.genre_list(F.lit("Noir,Comedy,Drama"), ",", vocab)
    assert one(spark, genres) == ["Comedy", "Drama"]
    assert one(spark, S.primary_genre(genres, vocab)) == 1
    assert one(spark, S.primary_genre(S.genre_list(F.lit(None).cast("string"), ",", vocab), vocab)) == 2


def test_histogram_right_edge(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "v double")
    got = {r.bin: r.n for r in describe.histogram(df, F.col("v"), 2, 0, 10).collect()}
    assert got == {0: 1, 1: 2}


def test_popularity(spark):
    train = spark.createDataFrame([(0,), (0,), (0,), (1,)], "movie_idx int")
    movies = spark.createDataFrame([(10, 0), (11, 1), (12, 2)], "movie_id int, movie_idx int")
    got = {r.movie_idx: r.pop for r in features.popularity(train, movies).collect()}
    assert got == pytest.approx({0: 1.0, 1: 0.5, 2: 0.0})


def test_early_stop(spark):
    df = spark.createDataFrame([("r", i + 1, x) for i, x in enumerate([3.0, 2.0, 2.5, 2.4, 2.3, 1.0])], "run string, epoch int, loss double")
    row = early_stop(df, ["run"], 3).first()
    assert (row.best_epoch, row.stop_epoch, row.best_loss) == (2, 5, 2.0)


def test_preprocess_invariants(spark):
    rows = [(u, m, 0.5 + (u * m) % 10 / 2, 86_400 * (m * 3 + u)) for u in range(30) for m in range(25) if (u + m) % 3]
    df = spark.createDataFrame(rows, "user_id int, movie_id int, rating double, timestamp long")
    prep = preprocess(df, ["timestamp", "movie_id"])
    stats = prep.stats.first()
    assert stats.n_train + stats.n_val + stats.n_test == prep.interactions.count() == len(rows)
    means = prep.part_of("train").groupBy("user_idx").agg(F.avg("rating_centered").alias("m"))
    assert means.where(F.abs("m") > 1e-9).count() == 0
    assert stats.n_cold == prep.cold.count()


def test_kcore_peels_a_chain_and_keeps_null_keys(spark):
    """Each half round frees the next key; a null key is never dropped itself."""
    pairs = [(u, m) for u in range(12) for m in range(u, u + 2)] + [(u, m) for u in (90, 91, 92) for m in (90, 91, 92)]
    rows = [(u, m, 3.0, 0) for u, m in pairs] + [(None, 90, 1.0, 0), (93, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "user_id int, movie_id int, rating double, timestamp long").repartition(3)
    alive = {(u, m) for u, m, _, _ in rows}
    while True:
        before = set(alive)
        for at in (1, 0):
            have = {p[at]: sum(q[at] == p[at] for q in alive) for p in alive}
            alive = {p for p in alive if p[at] is None or have[p[at]] >= 2}
        if alive == before:
            break
    trace = []
    got = {(r.user_id, r.movie_id) for r in prepare.kcore_filter(df, 2, 2, trace).collect()}
    assert got == alive and sum(t["rows_dropped"] for t in trace) == len(rows) - len(alive)


def test_words_and_edges_without_a_regex(spark):
    """Words and trimming as the whitespace class says, by string functions alone."""
    rng = random.Random(4)
    chars = [*S.WHITESPACE, *"ab​é\U0001F600", *"cdefgh"]
    texts = ["".join(rng.choices(chars, k=rng.randrange(40))) for _ in range(500)] + ["x", " ", "\n", "a \n"]
    space = f"[{re.escape(S.WHITESPACE)}]"
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", S.word_count(F.col("t")).alias("n"), S.stripped(F.col("t")).alias("s"))
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    for r in rows.collect():
        assert r.n == len(re.findall(space.replace("[", "[^", 1) + "+", r.t))
        assert r.s == re.sub(f"^{space}+|{space}+$", "", r.t)


def test_last_row_is_kept_without_a_second_copy_of_the_order(spark):
    from marquee.operators import clean

    rows = [("a", 1, 3.0, 10, 1), ("a", 1, 4.0, 10, 2), ("a", 1, 5.0, 9, 3), ("b", 1, 1.0, None, 1), ("b", 1, 2.0, None, 0), (None, 2, 0.5, 1, 1)]
    log = spark.createDataFrame(rows, "user_id string, movie_id int, rating double, timestamp bigint, line int")
    last = clean.dedup_keep_last(log, ["user_id", "movie_id"], ["timestamp", "line"])
    assert last.columns == log.columns
    assert {tuple(r) for r in last.collect()} == {rows[1], rows[3], rows[5]}
    assert "max_by" not in last._jdf.queryExecution().optimizedPlan().toString().lower()


def test_means_are_taken_before_the_joins_with_the_maps(spark, monkeypatch):
    """Rows without an id have no index and count for no mean; the means read no indexed table."""
    from marquee.plans import preprocess as plan

    taken, mean_center = [], plan.prepare.mean_center
    monkeypatch.setattr(plan.prepare, "mean_center", lambda df, train: taken.append(train) or mean_center(df, train))
    rows = [(u, m, float(u + m), t) for u in (1, 2, 3) for t, m in enumerate((5, 6, 7, 8))] + [(1, None, 90.0, 0), (None, 5, 90.0, 0)]
    ratings = spark.createDataFrame([(None if u is None else f"ML_{u}", m, r, t) for u, m, r, t in rows],
                                    "user_id string, movie_id int, rating double, timestamp bigint")
    found = plan.prepare_interactions(ratings, 1, 1).interactions.toPandas()
    assert len(found) == 12 and "movie_idx" not in taken[0].columns
    for _, own in found.groupby("user_id"):
        mean = own[own["split"] == "train"]["rating"].mean()
        assert ((own["rating"] - mean - own["rating_centered"]).abs() < 1e-9).all()
