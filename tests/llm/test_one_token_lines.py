from marquee.llm import line_dedup
from tests.llm import brute


def test_lines_of_one_repeated_word(spark):
    """Lines that repeat one word have one distinct shingle, however long they are."""
    rows = [(1, "- - - - -\nha ha ha ha\n* * * * * *"), (2, "- - - - - - -\n* * * * *\nha ha ha ha ha"), (3, None),
            (4, "Ha ha ha ha ha ha\nha ha ha ha\n- - - -\n- - - - - x\n- - - - - - x"), (5, "a b a b a b\na b a b a b a b\n- - - - - - - -")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, list(r.removed)) for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute.lines(rows)
    assert got[2] == (3, 2, [0, 1]) and 0 in got[4][2]
    assert {r.doc_id: r.text for r in line_dedup.without_lines(df).collect()}[2] == "ha ha ha ha ha"
