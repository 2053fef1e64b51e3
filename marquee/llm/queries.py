"""Registered queries of the training-text operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import (alignment, embedding_dedup, fill_middle, kneser_ney, language, line_dedup, mixing, packing, parity_join,
                         quality, suffix_dedup, token_counts, warc)
from marquee.llm.oracles import ORACLES  # noqa: F401

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(modulus))


def op1_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir), mixing.word_count(F.col("text")))


def op2_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), WORD_TOKENIZER)


def op3_ngram_jaccard_join(spark, sf_dir):
    return parity_join.jaccard_groups(documents(spark, sf_dir), size=4, percent=85)


def op4_quality_rules(spark, sf_dir):
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_kept",
        "base_failed", "kept")


def op5_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = language.train(docs, fold(4) != 2)
    held_out = fold(4) == 2
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_lm_scoring(spark, sf_dir):
    docs = documents(spark, sf_dir)
    scored = kneser_ney.train_and_score(docs, fold(10) != 0)
    return scored.withColumn("held_out", fold(10) == 0)


def op8_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("starts", "ends")


def op9_token_counts(spark, sf_dir):
    return token_counts.unigram_counts(documents(spark, sf_dir), PIECES)


def op10_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(documents(spark, sf_dir)).withColumn("removed", F.array_join("removed", ","))


def op11_fill_in_middle(spark, sf_dir):
    found = fill_middle.fill_in_middle(documents(spark, sf_dir))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(back, 256).alias("restored_sha256"))


def op12_cross_tokenizer_alignment(spark, sf_dir):
    return alignment.alignment_counts(documents(spark, sf_dir), BYTE_LEVEL, PIECES)


def op13_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.archived_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_packing, op3_ngram_jaccard_join, op4_quality_rules, op5_language_id, op6_embedding_near_dedup,
    op7_lm_scoring, op8_suffix_array_dedup, op9_token_counts, op10_line_dedup, op11_fill_in_middle,
    op12_cross_tokenizer_alignment, op13_warc)}
