"""Near-duplicate lines by an exact set-similarity join, with column expressions only.

The tokens of a line are its distinct five-word shingles as 64-bit hashes. They are ordered
by rarity: a fixed table of 16,384 counters over all lines ranks the hash buckets, and a
token is rewritten as (rank, rest of the hash), which is one-to-one. Lines that link share a
token among their first few (prefix filter); positions and lengths bound the overlap, and
the Jaccard similarity is verified on the whole sets. A line is removed if an earlier line
links with it. Lines with a token are compared with the earliest lines of its bucket first
and leave the search as soon as one links, so groups of similar lines are not paired up.
Lines of one distinct token (one word over and over, say) are grouped by it without a join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.ids import keyed_texts
from marquee.llm.quality import SPACE, split_words
from marquee.runtime import passing, staged

WORDS = 5
BITS = 14
BUCKETS = 1 << BITS
SIEVE_BITS = 20      # a sieve has 2**20 words of 64 bits at most,
SIEVE_ROW = 6        # 2**6 of them in a row
STEP = 4
LINE = ["key", "line_no"]


def _lines(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return rows.select("key", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _words(line: Column) -> Column:
    """Lower-cased words; lines whose only blanks are spaces, nearly all, are split without a pattern."""
    low, other = F.lower(line), F.lit(False)
    for blank in "\t\x0b\x0c\r":
        other |= line.contains(blank)
    return F.when(other, split_words(low)).otherwise(F.array_remove(F.split(low, " "), ""))


def _starts(words: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(words) - WORDS, F.lit(0)))


def _shingle(words: Column, start: Column) -> Column:
    """Hash of the five words from ``start``; of all words where there are fewer (a null adds nothing)."""
    return F.xxhash64(*[F.get(words, start + i) for i in range(WORDS)])


def _worded(lines: DataFrame) -> DataFrame:
    # the filter looks at the line, so that it does not split it a second time
    return lines.where(F.col("line").rlike(f"[^{SPACE}]")).withColumn("words", _words(F.col("line")))


def _tokenised(lines: DataFrame) -> DataFrame:
    words = F.col("words")
    return _worded(lines).withColumn("tokens", F.array_distinct(F.transform(_starts(words), lambda i: _shingle(words, i))))


def _identity(words: Column, n: Column) -> Column:
    """What two lines with equal token sets by their words have in common; lines of one token have their first shingle."""
    return F.slice(words, 1, F.when(n == 1, F.least(F.size(words), F.lit(WORDS))).otherwise(F.size(words)))


def _bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit(BUCKETS - 1))


def _ranks(lines: DataFrame) -> Column:
    """The rarity rank of each of the 16,384 buckets in the upper bits of a long, as a constant array."""
    at = _worded(lines).select("words", F.explode(_starts(F.col("words"))).alias("start"))
    counts = at.select(_bucket(_shingle(F.col("words"), F.col("start"))).alias("bucket")).groupBy("bucket").count()
    n = {r.bucket: r["count"] for r in counts.collect()}  # one row per bucket at most
    rank = [0] * BUCKETS
    for i, bucket in enumerate(sorted(range(BUCKETS), key=lambda b: (n.get(b, 0), b))):
        rank[bucket] = (i - BUCKETS // 2) * (1 << 64 - BITS)
    return F.lit(np.array(rank, np.int64))  # one literal: 16,384 of them took the driver's memory, plan by plan


def _need(a, b, percent: int) -> Column:
    return F.ceil(percent * (a + b) / (100 + percent))


def _sifted(df: DataFrame, wanted: DataFrame, on: list[str] = LINE) -> DataFrame:
    """The rows of ``df`` whose columns ``on`` may be in ``wanted``: all that are, and some others.

    A bit table of bounded size is broadcast before an exact join or window, so that its shuffle
    carries few other rows. Where ``wanted`` has many millions of rows most bits are set and
    the shuffle carries all rows; results are the same.
    """
    code = F.xxhash64(*on)
    slot, bit = code.bitwiseAND(F.lit((1 << SIEVE_BITS) - 1)), F.shiftrightunsigned(code, 64 - 6).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    row, place = F.shiftright(slot, SIEVE_ROW), slot.bitwiseAND(F.lit((1 << SIEVE_ROW) - 1)).cast("int")
    words = wanted.groupBy(row.alias("_row"), place.alias("_place")).agg(F.bit_or(one).alias("_word"))
    held = F.map_from_entries(F.collect_list(F.struct("_place", "_word"))).alias("_held")
    places = F.sequence(F.lit(0), F.lit((1 << SIEVE_ROW) - 1))
    sieve = words.groupBy("_row").agg(held).select(
        "_row", F.transform(places, lambda i: F.coalesce(F.try_element_at("_held", i), F.lit(0).cast("bigint"))).alias("_words"))
    return (df.withColumn("_row", row).withColumn("_place", place).withColumn("_bit", one).join(F.broadcast(sieve), "_row")
            .where(F.get("_words", F.col("_place")).bitwiseAND(F.col("_bit")) != 0).drop("_row", "_place", "_bit", "_words"))


def _copies(table: DataFrame) -> DataFrame:
    """(key, line_no) of lines whose words, or whose only token, equal those of an earlier line."""
    groups = staged(table.groupBy("k1", "k2").agg(F.count("*").alias("size"), F.min(F.struct("key", "line_no")).alias("f"))
                    .where("size > 1").drop("size"), "equal-lines")
    return staged(_sifted(table.select("k1", "k2", *LINE), groups, ["k1", "k2"]).join(groups, ["k1", "k2"])
                  .where("key <> f.key or line_no <> f.line_no").select(*LINE), "copies")


def _shared_tokens(lines: DataFrame, copies: DataFrame) -> DataFrame:
    """Postings of the prefix tokens that several lines have, copies left out, numbered by line within the token.

    Tokens are counted first, so that the lines of tokens found once, nearly all, are not shuffled.
    """
    tokens = lines.select(F.explode("prefix").alias("token"))
    several = tokens.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    posted = lines.select("key", "line_no", "n", F.posexplode("prefix").alias("pos", "token"))
    by_token = Window.partitionBy("token")
    # outer and inner joins stay above the sieve; semi and anti joins would be moved below it
    met = _sifted(posted, several, ["token"]).join(copies.withColumn("copy", F.lit(True)), LINE, "left").where("copy is null").drop("copy")
    return staged(met
                  .withColumn("rank", F.row_number().over(by_token.orderBy(*LINE)))
                  .withColumn("size", F.count("*").over(by_token)).where("size > 1"), "shared-tokens")


def removed_lines(rows: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """((key, line_no, n) of all lines with a word, (key, line_no) of the lines to remove), from stage tables."""
    spark = rows.sparkSession
    rank = _ranks(_lines(rows))
    ordered = F.sort_array(F.transform("tokens", lambda t: rank[_bucket(t)].bitwiseOR(F.shiftrightunsigned(t, BITS))))
    n = F.size("tokens")
    own = _identity(F.col("words"), n)
    prefix = F.slice(ordered, 1, (n - F.ceil(F.lit(percent) * n / 100) + 1).cast("int"))
    table = staged(_tokenised(_lines(rows)).select(
        "key", "line_no", F.xxhash64(own).alias("k1"), F.xxhash64(F.lit(1), own).alias("k2"),
        n.alias("n"), prefix.alias("prefix")), "lines")

    copies = _copies(table)
    shared = _shared_tokens(table.where("n > 1"), copies)
    wanted = shared.select("key", "line_no").distinct()
    sets = staged(_tokenised(_sifted(_lines(rows), wanted).join(wanted, LINE))
                  .select("key", "line_no", "tokens"), "candidate-sets")
    deepest = shared.agg(F.max("size")).first()[0] or 0
    gone, low = None, 1
    while low < deepest:
        late = shared.where(F.col("rank") > low)
        if gone is not None:
            late = late.join(gone, LINE, "left_anti")
        early = shared.where((F.col("rank") >= low) & (F.col("rank") < low * STEP)).select(
            F.col("token"), *[F.col(c).alias(f"e_{c}") for c in ("key", "line_no", "n", "pos", "rank")])
        a, b = F.col("n"), F.col("e_n")
        rest = 1 + F.least(a - 1 - F.col("pos"), b - 1 - F.col("e_pos"))
        pairs = staged(late.join(early, "token").where(
            (F.col("e_rank") < F.col("rank")) & (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (rest >= _need(a, b, percent)))
            .select("key", "line_no", "e_key", "e_line_no").distinct(), "line-pairs")
        earlier = pairs.select(F.col("e_key").alias("key"), F.col("e_line_no").alias("line_no"))
        met = pairs.join(_sifted(sets, pairs), LINE).join(
            _sifted(sets, earlier).select(F.col("key").alias("e_key"), F.col("line_no").alias("e_line_no"), F.col("tokens").alias("e_tokens")),
            ["e_key", "e_line_no"])
        both = F.size(F.array_intersect("tokens", "e_tokens"))
        linked = met.where(100 * both >= percent * (F.size("tokens") + F.size("e_tokens") - both)).select("key", "line_no").distinct()
        gone = staged(linked if gone is None else gone.unionByName(linked), "removed-lines")
        low *= STEP
    near = spark.createDataFrame([], copies.schema) if gone is None else gone
    # a copy of a removed line is a copy, so copies and near lines do not overlap
    return table.select("key", "line_no", "n"), copies.unionByName(near)


def dedup_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) per row; ``removed`` has the line numbers from zero, ascending.

    Lines are compared across the whole table in the order of id (null first) and line; lines
    of null texts do not exist and lines without a word are never removed. Lines with fewer
    than five words are one token and match only equal words; a line that repeats one word five
    times or more is one token too and matches every other such line of that word. Words are lower-cased.
    """
    rows = keyed_texts(docs, id_col, text_col)
    with passing(docs.sparkSession) as kept:
        lines, removed = removed_lines(rows, percent)
        gone = kept(removed.groupBy("key").agg(F.sort_array(F.collect_list("line_no")).alias("removed")), "gone-lines")
        total = kept(lines.groupBy("key").agg(F.count("*").alias("n_lines")), "line-counts")
    return (rows.select("key", "doc_id").join(total, "key", "left").join(gone, "key", "left")
            .select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
                    F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
                    F.coalesce("removed", F.array().cast("array<int>")).alias("removed")))


def without_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the duplicate lines taken out of the text; other columns stay as they are.

    Null texts stay null. A text that loses all its lines becomes empty.
    """
    rows = keyed_texts(docs, id_col, text_col, *[F.col(c).alias(f"_in_{i}") for i, c in enumerate(docs.columns)])
    with passing(docs.sparkSession) as kept:
        _, removed = removed_lines(rows, percent)
        gone = kept(removed.groupBy("key").agg(F.collect_list("line_no").alias("_gone")), "gone-lines")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    joined = rows.join(gone, "key", "left").withColumn("_text", text)
    return joined.select(*[(F.col("_text") if c == text_col else F.col(f"_in_{i}")).alias(c) for i, c in enumerate(docs.columns)])
