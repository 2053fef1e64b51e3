"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes every stage and reads it back as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import language, line_dedup, mixing, packing, parity_join
from marquee.llm.ids import keyed_texts
from marquee.runtime import staged

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is too unsure."""
    return language.keep_identified(docs, language.train(docs, F.lit(True)))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat an earlier line; a document of which no word is left goes."""
    cleaned = line_dedup.without_lines(docs)
    left = cleaned.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates: five-word shingles, Jaccard 0.8."""
    rows = keyed_texts(docs, "doc_id", "text", *[F.col(c).alias(f"in_{i}") for i, c in enumerate(docs.columns)])
    groups = parity_join.jaccard_groups(rows, id_col="key", size=5, percent=80)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("key"))
    return rows.join(gone, "key", "left_anti").select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, block_tokens: int = 1 << 20) -> DataFrame:
    """Repeats documents of small sources, up to twice; every document stays at least once.

    Rows are in the order of the dealt blocks, over partitions and so over the written files.
    """
    rows = keyed_texts(docs, "doc_id", "text", *[F.col(c).alias(f"in_{i}") for i, c in enumerate(docs.columns)])
    source = f"in_{docs.columns.index('source')}"
    uses = mixing.mix(rows, mixing.word_count(F.col("text")), block_tokens=block_tokens, id_col="key", source_col=source)
    dealt = rows.drop("doc_id", "text").join(uses.select(F.col("doc_id").alias("key"), "block", "place"), "key")
    return (dealt.repartitionByRange("block", "place").sortWithinPartitions("block", "place")
            .select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)]))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens, as pieces of documents in the order that mixing wrote them."""
    return packing.pack(docs, TOKENIZER, in_file_order=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_lines),
    ("ngram_jaccard_join", remove_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Language ID, tokenisation and the grouping of near duplicates have no SQL form; the tests
# compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
