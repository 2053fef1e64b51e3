import random

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from marquee.llm import language

SYLLABLES = {"a": "ba be bi lo la mo ne ni ra sa", "b": "schu krem zapf wolt grun prang", "c": "xiq quax yxo vuqi ojjo wyk"}


def texts(lang, n, seed):
    """Texts of a made-up language whose words are strings of its own syllables."""
    rng, parts = random.Random(seed), SYLLABLES[lang].split()
    return [" ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 80))) for _ in range(n)]


def rejected(model, rows):
    class Shared:
        value = model
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.string())], ["doc_id", "text"])
    return [r for b in language._predict(Shared, 1, False)([batch]) for r in b.column(3).to_pylist()]


def fitted():
    rows = [(t, lang) for lang in "ab" for t in texts(lang, 300, lang)]
    random.Random(1).shuffle(rows)
    return language.fit([t.encode() for t, _ in rows], [lang for _, lang in rows])


def test_unlearned_languages_and_noise_are_rejected():
    model, rng = fitted(), random.Random(2)
    learned = rejected(model, texts("a", 300, 5) + texts("b", 300, 6))
    assert sum(learned) <= 0.01 * len(learned)
    mixed = [x + " " + y for x, y in zip(texts("a", 50, 7), texts("b", 50, 8))]
    assert sum(rejected(model, mixed)) == 0
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=200)) for _ in range(100)]
    greek = ["".join(rng.choices("αβγδεζηθικλ  ", k=200)) for _ in range(100)]
    for strange in (texts("c", 100, 9), noise, greek):
        assert sum(rejected(model, strange)) >= 0.9 * len(strange)


def test_what_has_no_letter_is_rejected_and_one_language_is_enough():
    assert rejected(fitted(), [None, "", "12 34 !", " \n"]) == [True] * 4
    one = language.fit([t.encode() for t in texts("a", 200, 3)], ["a"] * 200)
    assert sum(rejected(one, texts("a", 200, 4))) <= 2
    assert sum(rejected(one, texts("c", 100, 4))) >= 90


def test_clashing_columns_and_few_rows(spark):
    schema = StructType([StructField(n, LongType() if n in ("doc_id", "n", "_n") else StringType())
                         for n in ("doc_id", "text", "lang", "_n", "n", "_lang", "_first", "first", "draw", "at", "k")])
    rows = [(i, t, lang, i, i, "x", "y", "z", "d", "a", "k") for lang in "ab" for i, t in enumerate(texts(lang, 40, lang))]
    docs = spark.createDataFrame([*rows, (None, None, "a", *[None] * 8), (7, "", None, *[None] * 8)], schema)
    model = language.train(docs, F.lit(True))
    assert model.labels == ["a", "b"]
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and 79 <= kept.count() <= 80
    single = language.train(docs.where("doc_id = 1 and lang = 'a'"), F.lit(True))
    assert language.keep_identified(docs, single).count() >= 1
