from pathlib import Path
from types import SimpleNamespace

import pytest

from marquee.models.content import PairwiseRanker
from marquee.models.factors import FactorModel
from marquee.plans.evaluate import evaluate_store
from marquee.plans.train import load_models
from marquee.runtime import checkpoint_root
from marquee.sources import model_store, readers, sinks


def write(path: Path, text: str) -> str:
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_readers(spark, tmp_path):
    ratings = readers.read_ratings(spark, write(tmp_path / "r.csv", "userId,movieId,rating,timestamp\n1,2,3.5,100\n"))
    assert ratings.dtypes == [("user_id", "int"), ("movie_id", "int"), ("rating", "double"), ("timestamp", "bigint")]
    links = readers.read_links(spark, write(tmp_path / "l.csv", "movieId,imdbId,tmdbId\n1,0114709,862.0\n2,,x\n")).collect()
    assert [tuple(r) for r in links] == [(1, 114709, 862), (2, None, None)]
    movies = readers.read_movies(spark, write(tmp_path / "m.csv", 'movieId,title,genres\n1,"A, B",Drama|War\n')).collect()
    assert tuple(movies[0]) == (1, "A, B", "Drama|War")
    header = "tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres\n"
    basics = readers.read_imdb_basics(spark, write(
        tmp_path / "b.tsv", header + 'tt1\tmovie\t"Open\tx\t0\t1999\t\\N\t\\N\tDrama\ntt2\tmovie\ty\ty\t0\t\\N\t\\N\t90\t\\N\n')).collect()
    assert [tuple(r) for r in basics] == [("tt1", "movie", "1999", None, "Drama"), ("tt2", "movie", None, "90", None)]
    votes = readers.read_imdb_ratings(spark, write(tmp_path / "v.tsv", "tconst\taverageRating\tnumVotes\ntt1\t7.5\t10\n")).first()
    assert tuple(votes) == ("tt1", 7.5, 10)
    tmdb = readers.read_tmdb(spark, write(
        tmp_path / "t.csv", 'id,title,vote_average,vote_count,status,release_date,overview\n'
        '5,T,6.5,3,R,2001-02-03,"Two\nlines, ""quoted"""\nbad,U,1,1,R,,x\n7,V,,,R,,\n')).collect()
    assert [(r.tmdb_id, r.overview, r.vote_average) for r in tmdb] == [(5, 'Two\nlines, "quoted"', 6.5), (7, "", None)]


def report(spark, model, value):
    return spark.createDataFrame([(model, "overall", "ndcg@10", value)], "model string, segment string, metric string, value double")


def test_report_upsert(spark, tmp_path):
    path = str(tmp_path / "report")
    for model, value in (("A", 0.1), ("B", 0.2), ("A", 0.3)):
        sinks.upsert_report(report(spark, model, value), path)
    assert {(r.model, r.value) for r in sinks.read_report(spark, path).collect()} == {("A", 0.3), ("B", 0.2)}
    merged = sinks.merge_report(sinks.read_report(spark, path), report(spark, "B", 0.9))
    assert {(r.model, r.value) for r in merged.collect()} == {("A", 0.3), ("B", 0.9)}


def test_unreadable_report_starts_fresh(spark, tmp_path):
    folder = tmp_path / "broken"
    folder.mkdir()
    (folder / "part-0.parquet").write_text("not parquet")
    sinks.upsert_report(report(spark, "A", 0.5), str(folder))
    assert [(r.model, r.value) for r in sinks.read_report(spark, str(folder)).collect()] == [("A", 0.5)]


def test_factors_round_trip(spark, tmp_path):
    users = spark.createDataFrame([(0, [1.0, 2.0], 0.5)], "user_idx int, vec array<double>, bias double")
    items = spark.createDataFrame([(3, [2.0, 1.0], 0.1)], "movie_idx int, vec array<double>, bias double")
    sinks.save_factors(FactorModel(users, items, 2, 0.25, {"reg": 0.1}, [1.0, 0.5]), str(tmp_path / "m"))
    back = sinks.load_factors(spark, str(tmp_path / "m"))
    assert (back.rank, back.mean, back.params, back.history) == (2, 0.25, {"reg": "0.1"}, [1.0, 0.5])
    assert back.users.collect() == users.collect() and back.items.collect() == items.collect()


def test_cached_or_compute(spark, tmp_path):
    path, calls = str(tmp_path / "c"), []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert sinks.cached_or_compute(spark, path, compute, skip=True).count() == 3
    assert sinks.cached_or_compute(spark, path, compute, skip=True).count() == 3
    assert len(calls) == 1
    sinks.cached_or_compute(spark, path, compute, skip=False)
    assert len(calls) == 2


def test_checkpoint_root_is_set(spark):
    assert checkpoint_root(spark)
    assert spark.sparkContext.getCheckpointDir()


@pytest.mark.parametrize("split", ["train", "val", "test"])
def test_split_folders(spark, tmp_path, split):
    df = spark.createDataFrame([(0, "train"), (1, "val"), (2, "test")], "user_idx int, split string")
    sinks.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(f"{tmp_path}/s/split={split}").count() == 1


def test_link_ids_that_are_no_bigint_become_null(spark):
    rows = [("1", "nan", "1e300"), ("2", "0114709", "inf"), ("3", "12.0", "junk"), ("4", None, "-inf")]
    got = readers.typed_links(spark.createDataFrame(rows, "movieId string, imdbId string, tmdbId string")).collect()
    assert [(r.movie_id, r.imdb_id, r.tmdb_id) for r in got] == [(1, None, None), (2, 114709, None), (3, 12, None), (4, None, None)]


def tiny_model(spark, scale):
    users = spark.createDataFrame([(0, [scale, 2.0], 0.5)], "user_idx int, vec array<double>, bias double")
    items = spark.createDataFrame([(3, [2.0, scale], 0.1)], "movie_idx int, vec array<double>, bias double")
    return FactorModel(users, items, 2, 0.25, {"reg": 0.1, "iterations": 3}, [1.0, 0.5], [0.9])


def test_model_store_reads_the_newest_committed_version(spark, tmp_path):
    store = str(tmp_path / "store")
    assert model_store.load_model(spark, store, "als") is None
    model_store.save_model(tiny_model(spark, 1.0), store, "als")
    old = model_store.load_model(spark, store, "als")
    model_store.save_model(tiny_model(spark, 7.0), store, "als")
    tiny_model(spark, 9.0).users.write.parquet(f"{store}/als/half-written/users")  # a save that died before its manifest row
    back, want = model_store.load_model(spark, store, "als"), tiny_model(spark, 7.0)
    assert (back.rank, back.mean, back.params, back.history, back.val_history) == (
        2, 0.25, {"reg": 0.1, "iterations": 3}, [1.0, 0.5], [0.9])
    assert back.users.collect() == want.users.collect() and back.items.collect() == want.items.collect()
    assert old.users.first().vec == [1.0, 2.0]


def test_rankers_and_weights_in_the_store(spark, tmp_path):
    store, model = str(tmp_path / "store"), tiny_model(spark, 1.0)
    ranker = PairwiseRanker(("text", "genre"), {"text": 0.5, "genre": -1.25, "pop": 0.1})
    model_store.save_ranker(ranker, model.users, model.items, store, "hybrid")
    model_store.save_weights(model.items, store, "easr", 300.0, 512, 7)
    trained = load_models(spark, store)
    back, users, items = trained.rankers["hybrid"]
    assert back == ranker and users.collect() == model.users.collect() and items.collect() == model.items.collect()
    assert trained.ease_block == 512 and trained.ease_weights.collect() == model.items.collect()
    assert trained.als is None and "twotower" not in trained.rankers
    assert model_store.load_weights(spark, store, "easr")[1] == {"reg": 300.0, "block": 512, "n_items": 7}


def test_evaluation_of_an_empty_store_is_refused(spark, tmp_path):
    prep = SimpleNamespace(user_map=spark.range(1))
    with pytest.raises(ValueError, match="no fitted model"):
        evaluate_store(prep, str(tmp_path / "none"))
