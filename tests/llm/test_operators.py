import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import (embedding_dedup, kneser_ney, language, lattice, line_dedup, mixing, packing, parity_join, quality,
                         suffix_dedup, token_counts)
from marquee.llm.components import connected_components
from marquee.llm.queries import PIECES, QUERIES, WORD_TOKENIZER
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def texts():
    """Null, empty, blank, tiny, repeated, near and very long texts."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(60)) + "." for _ in range(8)]
    rows = [None, "", " \n\t", "One", "one two three four", "a b c d e f g h i j " * 5, "x" * 400]
    for b in base:
        words = b.split()
        for edits in (0, 0, 1, 2, 5, 9):
            w = list(words)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w) + "\n" + rng.choice(base))
    rows.append("\n".join(" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(400)))
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame([(i, t, "s" if i % 3 else None) for i, t in texts()], "doc_id long, text string, source string")
    return df.withColumns({"key": F.lit("clash"), "n": F.lit(1), "start": F.lit(None).cast("int"), "lang": F.lit("xx")})


@pytest.fixture(scope="module")
def empty(table):
    return table.where("false")


@pytest.fixture(scope="module")
def twice(table):
    """Every row twice, and rows without an id."""
    return table.unionByName(table).unionByName(table.limit(9).withColumn("doc_id", F.lit(None).cast("long")))


def test_jaccard_groups_equal_brute_force(table, empty, twice):
    for size, percent in ((4, 85), (5, 80), (2, 50)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.jaccard_groups(table, size=size, percent=percent).collect()}
        assert got == brute.jaccard(texts(), size, percent)
    assert parity_join.jaccard_groups(empty).count() == 0
    assert parity_join.jaccard_groups(twice).count() >= table.count()


def test_parts_hold_the_largest_difference():
    for percent in (80, 85):
        low, parts, skip = parity_join.bands(percent)
        for a in [*range(1, 400), 5000, 5001]:
            band = int(np.searchsorted(low, a, "right")) - 1
            for b in range(a, a * 100 // percent + 1):
                assert parts[band] - skip[band] > parity_join.largest_difference(np.array(a), np.array(b), percent)


def test_repeats_equal_brute_force(table, empty, twice):
    for length in (100, 40):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(table, length).collect()}
        assert got == brute.repeats(texts(), length)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_repeats(twice).count() == twice.count()


def test_suffixes_sort_by_hashes():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    bounds = np.array([0, 1, 50, 200])
    order, shared = suffix_dedup.Suffixes(strings).sorted_groups(bounds)
    again = suffix_dedup.Suffixes(strings).compared(bounds)
    assert [strings[i] for i in order] == [strings[i] for i in again[0]]
    assert (shared == again[1]).all()


def test_lines_equal_brute_force(table, empty, twice):
    got = {r.doc_id: (r.n_lines, r.n_removed, list(r.removed)) for r in line_dedup.dedup_lines(table).collect()}
    assert got == brute.lines(texts())
    kept = {r.doc_id: r.text for r in line_dedup.without_lines(table).collect()}
    for i, t in texts():
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in got[i][2])
        assert kept[i] == want
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(twice).count() == twice.count()
    assert line_dedup.without_lines(table).columns == table.columns


def test_quality_counts(table, empty):
    got = {r.doc_id: r for r in quality.judge(table).collect()}
    for i, t in texts():
        r = got[i]
        assert brute.quality(t) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0


def test_quality_verdict(spark):
    good = "\n".join("this line has some words and it ends well." for _ in range(1)) + " " + " ".join(f"w{i}" for i in range(30)) + "."
    menu = " | ".join(f"item{i}" for i in range(40))
    rows = [(1, good), (2, menu), (3, good + "\nAll rights reserved."), (4, " ".join(f"W{i}!!" for i in range(40)))]
    got = {r.doc_id: (r.kept, r.clean_text) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert got[3][1] == good


def test_packing_round_trip(table, empty, twice):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts()}
    rows = packing.pack(table, WORD_TOKENIZER, window=64).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, own in ids.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own)
            assert r.ids_crc32 == zlib.crc32(np.array(own[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(own)
    for s, own in sequences.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or s == max(sequences)
    assert packing.pack(empty, WORD_TOKENIZER).count() == 0
    assert packing.pack(twice, WORD_TOKENIZER).agg(F.sum("length")).first()[0] > 2 * sum(map(len, ids.values()))


def test_unigram_counts_equal_the_tokenizer(spark, table, empty):
    from tokenizers import Tokenizer, models

    pieces = token_counts.read_pieces(PIECES)
    real = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    got = {r.doc_id: r.n_tokens for r in token_counts.unigram_counts(table, PIECES).collect()}
    for i, t in texts():
        marked = "".join("▁" + w for w in (t or "").encode().decode().split())
        assert got[i] == len(real.encode(marked).ids)
    counter = token_counts.Counter([("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -3.0)])
    tied = Tokenizer(models.Unigram([("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -3.0)], 0, False))
    for s in ("▁ab", "▁aab", "▁qqab", "▁q▁q", "ba▁ab"):
        assert counter.count(s)[1] == len(tied.encode(s).ids), s
    assert token_counts.unigram_counts(empty, PIECES).count() == 0


def test_kneser_ney_equals_brute_force(table, empty):
    use = F.col("doc_id") % 4 != 1
    got = {r.doc_id: tuple(r)[1:] for r in kneser_ney.train_and_score(table, use).collect()}
    rows = texts()
    want, p, counts = brute.kneser_ney([t for i, t in rows if i % 4 != 1], [t for _, t in rows], kneser_ney.discounts)
    for (i, _), w in zip(rows, want):
        assert got[i][:3] == w[:3]
        assert got[i][3:] == pytest.approx(w[3:], rel=1e-9)
    for u in ("\0begin", rows[20][1].split()[0]):
        assert sum(p(u, w) for w in [*counts, "\0never"]) == pytest.approx(1)
    assert kneser_ney.train_and_score(empty, use).count() == 0
    alone = kneser_ney.train_and_score(table, F.lit(False)).where("doc_id = 3").first()
    assert (alone.train_tokens, alone.score) == (0, 0.0)


def test_language_held_out(spark, table, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = QUERIES["op5_language_id"](spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    model = language.train(docs, F.lit(True))
    none = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(table, model).collect()}
    assert none[0] == none[1] == none[2] == ("und", 0.0)
    kept = language.keep_identified(table, model)
    assert kept.columns == table.columns and kept.where("text is null or text = ''").count() == 0
    assert language.identify(empty, model).count() == 0
    assert language.identify(table, language.train(empty, F.lit(True))).where("lang_pred = 'und'").count() == table.count()


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    point = lattice.nearest_e8(x)
    own = ((x - point) ** 2).sum(axis=1)
    assert (np.isclose(point.sum(axis=1) % 2, 0)).all()
    for v in lattice.neighbours():
        assert (((x - point - v) ** 2).sum(axis=1) >= own - 1e-9).all()


def test_embedding_recall_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 32))
    rows = []
    for i in range(400):
        v = centre[i % 40] + rng.normal(size=32) * rng.choice([0.0, 0.1, 0.25, 0.4])
        rows.append((i, [float(x) for x in v], i % 2))
    bad = [(400, None, 1), (401, [0.0] * 32, 1), (402, [float("nan")] * 32, 1), (403, rows[0][1], None), (404, [], 1), (405, [None, 1.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(0))
    for index in (embedding_dedup.Index(), embedding_dedup.Index(members=4)):
        got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, index=index).collect()}
        x = np.array([r[1] for r in rows])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = (x @ x.T >= 0.93) & (np.arange(400)[:, None] % 2 == np.arange(400)[None, :] % 2)
        np.fill_diagonal(near, False)
        want, have = near.sum(axis=1), np.array([got[i].n_links for i in range(400)])
        assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
        assert all(got[i].n_links == 0 and got[i].kept for i in range(400, 406))
        assert all(got[i].kept == (got[i].component_id == i) and got[i].component_id <= i for i in range(406))
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


def test_mixing(spark, table, empty):
    rows = [(i, "big" if i % 10 else ("mid" if i % 20 else "small"), 10 + i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, t long")
    uses = mixing.mix(df, F.col("t"), repetition_limit=3.0, block_tokens=4000)
    n = {r.source: (r.docs, r.uses, r.tokens) for r in uses.groupBy("source").agg(
        F.count_distinct("doc_id").alias("docs"), F.count("*").alias("uses"), F.sum("n_tokens").alias("tokens")).collect()}
    total = {s: sum(t for _, x, t in rows if x == s) for s in ("big", "mid", "small")}
    assert n["big"] == (1800, 1800, total["big"])
    assert all(n[s][2] <= 3.001 * total[s] for s in n) and max(n[s][2] / total[s] for s in n) > 2.9
    assert uses.groupBy("source", "epoch").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).where("n <> d").count() == 0
    shares = uses.groupBy("block").pivot("source").sum("n_tokens").orderBy("block").collect()
    assert all(abs(r["big"] - shares[0]["big"]) < 60 for r in shares)
    totals = spark.createDataFrame([("a", 1000), ("b", 10)], "group string, total long")
    assert 0 < mixing.find_exponent(totals, target_entropy=0.9) < 1
    assert mixing.mix(empty, mixing.word_count(F.col("text"))).count() == 0
    assert mixing.mix(table, mixing.word_count(F.col("text"))).select("doc_id").distinct().count() == table.count()


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.groups(200, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in state.collect()} if name != "packing" else None
        state = stage(spark, state, SMALL)
        if name == "packing":
            assert state.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
            continue
        assert state.columns == columns
        after = {r.doc_id: r.text for r in state.collect()}
        if name == "language_id":
            assert len(after) >= 0.99 * len(before)
        elif name == "line_dedup":
            want = brute.lines(list(before.items()))
            assert {i for i in before if want[i][0] > want[i][1]} == set(after)
        elif name == "ngram_jaccard_join":
            assert set(after) == {c for _, c in brute.jaccard(list(before.items()), 5, 80).values()}
        else:
            assert set(after) == set(before)
        state = spark.createDataFrame(state.collect(), docs.schema)
