"""Temperature mixing of sources.

Source shares are raised to an exponent between 0 (all sources alike) and 1 (as they are).
The exponent is bisected until the weights just meet a repetition limit or an entropy. The
weights become token budgets, and each source fills its budget with hashed permutations of
its documents, one per epoch, dealt over blocks that all hold the sources in their weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.quality import SPACE
from marquee.runtime import staged

BISECTIONS = 24
PER_JOB = 4   # halvings of the exponent's interval that one job decides


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def find_exponent(totals: DataFrame, repetition_limit: float | None = 2.0, target_entropy: float | None = None) -> float:
    """Smallest exponent in [0, 1] that keeps to the limit, to 24 bisections; 1 if none does.

    ``totals`` has a ``total`` per source. Sources are weighted by (total / largest) ** exponent
    and the largest is used once, so a source is repeated (total / largest) ** (exponent - 1)
    times. ``target_entropy`` asks for the largest exponent whose weights have at least that
    share of the greatest possible entropy instead. Only sums over sources reach the driver.
    """
    share = totals.where("total > 0").select((F.col("total") / F.max("total").over(Window.partitionBy(F.lit(0)))).alias("x"))
    share = staged(share, "shares")
    low, high = 0.0, 1.0
    for _ in range(BISECTIONS // PER_JOB):
        n = 1 << PER_JOB
        tried = [low + (high - low) * i / n for i in range(1, n)]
        if target_entropy is None:
            sums = share.agg(*[F.max(F.pow("x", F.lit(a - 1))).alias(f"r{i}") for i, a in enumerate(tried)]).first()
            good = [r is None or r <= repetition_limit for r in sums]
            at = next((i for i, g in enumerate(good) if g), len(tried))
        else:
            sums = share.agg(F.count("*"), *[e for a in tried for e in (
                F.sum(F.pow("x", F.lit(a))), F.sum(F.pow("x", F.lit(a)) * F.log("x") * a))]).first()
            entropy = lambda z, m: (_log(z) - m / z) / (_log(sums[0]) or 1.0) if z else 1.0
            good = [entropy(sums[1 + 2 * i] or 0.0, sums[2 + 2 * i] or 0.0) >= target_entropy for i in range(len(tried))]
            at = next((i for i, g in enumerate(good) if not g), len(tried))
        edges = [low, *tried, high]
        low, high = edges[at], edges[at + 1]
    return high if target_entropy is None else low


def _log(x: float) -> float:
    import math

    return math.log(x) if x > 0 else 0.0


def mix(docs: DataFrame, tokens: Column, repetition_limit: float = 2.0, target_entropy: float | None = None,
        block_tokens: int = 1 << 20, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, source, epoch, n_tokens, block, place), one row per use of a document.

    The largest source is used once and whole, smaller ones up to ``repetition_limit`` times.
    An epoch takes a source's documents in the order of md5(id:epoch); the last one stops
    before the document that would pass the budget. A source's budget is spread evenly over
    the blocks, and inside a block documents come in the order of md5(id:epoch:block).
    Null sources are one source; documents without tokens are used once per full epoch, and
    sources without any tokens once. Repeated ids are separate documents, a null id hashes as
    the empty text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = staged(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                              tokens.cast("bigint").alias("n_tokens")), "mix-rows")
    group = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    rows = rows.withColumn("group", group)
    totals = staged(rows.groupBy("group").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("docs")), "mix-totals")
    alpha = find_exponent(totals, repetition_limit, target_entropy)
    largest, n_docs = totals.agg(F.coalesce(F.max("total"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    budget = F.floor(F.lit(float(largest)) * F.pow(F.col("total") / F.lit(float(max(largest, 1))), F.lit(alpha)) + 1e-6)
    budget = F.when(F.col("total") > 0, budget).otherwise(0)
    pieces = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = staged(totals.withColumn("budget", budget).select(
        "group", "total", "budget", F.when(F.col("total") > 0, F.floor(F.col("budget") / F.col("total"))).otherwise(1).alias("full"),
        F.ceil(F.col("docs") * pieces / F.lit(float(max(n_docs, 1)))).alias("pieces")), "mix-plan")
    blocks = max(1, -(-int(plan.agg(F.coalesce(F.sum("budget"), F.lit(0))).first()[0]) // block_tokens))
    uses = (rows.join(plan, "group").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full"))))
            .withColumn("name", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "epoch"))
            .withColumn("order", F.md5("name"))
            .withColumn("piece", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("bigint") * F.col("pieces") / F.lit(1 << 32))))
    inside = Window.partitionBy("group", "epoch", "piece").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("group", "epoch").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (uses.groupBy("group", "epoch", "piece").agg(F.sum("n_tokens").alias("held"))
               .select("group", "epoch", "piece", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset")))
    placed = (uses.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
              .join(offsets, ["group", "epoch", "piece"])
              .withColumn("start", F.col("epoch") * F.col("total") + F.col("offset") + F.col("inner")))
    used = placed.where((F.col("epoch") < F.col("full"))
                        | (F.col("start") + F.col("n_tokens") <= F.col("budget")) & (F.col("n_tokens") > 0))
    block = F.when(F.col("budget") > 0, F.least(F.lit(blocks - 1), F.floor(F.col("start") * blocks / F.col("budget")))).otherwise(0)
    used = used.withColumn("block", block.cast("bigint"))
    shuffled = Window.partitionBy("block").orderBy(F.md5(F.concat_ws(":", "name", "block")), "doc_id", "n_tokens")
    return used.select("doc_id", "source", "epoch", "n_tokens", "block", (F.row_number().over(shuffled) - 1).cast("bigint").alias("place"))
