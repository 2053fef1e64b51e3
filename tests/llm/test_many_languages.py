import random

from pyspark.sql import functions as F

from marquee.llm import language


def many(languages, per_language, seed=4):
    """Texts of made-up languages, each with words of its own."""
    rng = random.Random(seed)
    rows = []
    for k in range(languages):
        words = ["".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randrange(3, 8))) for _ in range(40)]
        rows += [(" ".join(rng.choice(words) for _ in range(40)), f"l{k:02d}") for _ in range(per_language + languages - k)]
    rng.shuffle(rows)
    return [(i, t, lang) for i, (t, lang) in enumerate(rows)]


def test_every_language_is_a_class(spark):
    docs = spark.createDataFrame(many(20, 20), "doc_id long, text string, lang string").withColumn("out", F.col("doc_id") % 4 == 2)
    docs = docs.unionByName(spark.createDataFrame([(10_000, "qqxx yyqq xqxq", "rare", False), (10_001, None, "none", False)], docs.schema))
    model = language.train(docs, ~F.col("out"))
    assert model.labels == [f"l{k:02d}" for k in range(20)] + ["rare"]
    got = language.identify(docs, model).join(docs, "doc_id").where("out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_many_languages_share_the_sample(spark):
    docs = spark.createDataFrame(many(20, 40), "doc_id long, text string, lang string").withColumn("doc_id", F.lit(None).cast("long"))
    rows = language.labelled_sample(docs, F.lit(True), 500, 100, 4, "doc_id", "text", "lang")
    assert len({r.lang for r in rows}) == 20 and len(rows) <= 2 * 5 * 20
