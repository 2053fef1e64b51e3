"""Line-first cleaning with column expressions.

Every line is judged by itself: by its closing punctuation, by marks of navigation and of
shouting, and by boilerplate phrases. Failing lines are removed, and a document that loses
too much of its text is rejected. Next to that stand the base rules on words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
TRIMMED = " \t\n\x0b\x0c\r"
WINDOW = 8
CLOSING = [".", "!", "?", "…", ":", ";", "\"", "'", "”", "’", "»", ")", "]", "。", "！", "？"]
BOILERPLATE = ("all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy",
               "cookie", "javascript", "click here", "sign up", "log in", "subscribe", "lorem ipsum")
BOILERPLATE_CHARS = 200   # longer lines are prose that mentions such a phrase
MARKS_PERCENT = 5         # of a line's characters


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _line_fails(line: Column) -> Column:
    last = F.substring(F.rtrim(line, F.lit(TRIMMED)), -1, 1)
    marks = F.length(line) - F.length(F.regexp_replace(line, r"[#*$%&|<>]|[!?]{2,}", ""))
    phrase = (F.length(line) <= BOILERPLATE_CHARS) & F.lower(line).rlike("|".join(BOILERPLATE))
    return ~last.isin(*CLOSING) | (marks * 100 > F.length(line) * MARKS_PERCENT) | phrase


def judge(docs: DataFrame, text_col: str = "text", keep_percent: int = 50, min_words: int = 20,
          repeat_percent: int = 30) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_lines_kept,
    clean_text, base_failed and kept added (such columns of the input are replaced).

    ``clean_text`` holds the lines that pass. A document is kept if the base rules pass and at
    least ``keep_percent`` of its lines' characters are left. Null texts count as empty and are
    not kept; rows are independent, so ids are not looked at. Repeated windows are compared by
    64-bit hashes within one text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    df = docs.withColumns({"_words": split_words(text), "_lines": lines})
    df = df.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_ok": F.filter("_lines", lambda x: ~_line_fails(x)),
        "_windows": F.when(F.size("_words") >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))),
    })
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    met = F.filter("_sorted", lambda e, i: (
        ((i > 0) & (F.get("_sorted", i - 1)["h"] == e["h"]))
        | F.coalesce(F.get("_sorted", i + 1)["h"] == e["h"], F.lit(False))))
    at = F.sort_array(F.transform(met, lambda e: e["i"]))
    covered = F.aggregate(
        at, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"])
    chars = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x))
    df = df.withColumns({
        "n_repeat_words": F.coalesce(F.when(F.col("_sorted").isNotNull(), covered), F.lit(0)).cast("bigint"),
        "n_lines_kept": F.size("_ok").cast("bigint"),
        "clean_text": F.array_join("_ok", "\n"),
        "_kept_chars": chars("_ok"), "_chars": chars("_lines"),
    })
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    df = df.withColumn("base_failed", base)
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("_kept_chars") >= keep_percent * F.col("_chars")))
    return df.drop("_words", "_lines", "_ok", "_windows", "_sorted", "_kept_chars", "_chars")
