from marquee.llm import line_dedup
from tests.llm import brute


def plan_of(df):
    return df._jdf.queryExecution().analyzed()


def test_counters_are_one_literal_of_the_plan(spark):
    """The driver once parsed 16,384 counters as expressions of a plan, which took its memory."""
    rows = spark.createDataFrame([(1, "a b c d e f\n\t \n\x0b"), (2, None)], "key long, text string")
    rank = line_dedup._ranks(line_dedup._lines(rows))
    chosen = rows.select(rank.alias("rank"))
    assert plan_of(chosen).expressions().head().child().children().size() == 0
    assert len(set(chosen.first()[0])) == line_dedup.BUCKETS


def test_sieve_keeps_all_that_are_wanted(spark):
    """A sieve is a few rows of many bits: 524,288 small ones took 21 MB of the driver at a time."""
    df = spark.range(200_000).withColumnRenamed("id", "key")
    wanted = df.where("key % 7 = 0")
    sifted = line_dedup._sifted(df, wanted, ["key"])
    kept = {r.key for r in sifted.collect()}
    assert kept >= set(range(0, 200_000, 7)) and len(kept) < 30_000
    assert line_dedup._sifted(df, wanted.limit(0), ["key"]).count() == 0
    assert (1 << line_dedup.SIEVE_BITS - line_dedup.SIEVE_ROW) <= 1 << 14


def test_lines_with_and_without_other_blanks(spark):
    rows = [(1, "one\ttwo three  four five six\n \t\x0b\n\n "), (2, "ONE two\x0bthree four five SIX\r\n  \n\x0c"), (3, "one two three four five"),
            (4, "one two three four five six seven eight\none two three four five six seven"), (5, None), (6, " \nfive"), (7, "Five")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, list(r.removed)) for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute.lines(rows)
