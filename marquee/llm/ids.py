"""Unique, ordered row keys for operators that compare documents with one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.runtime import staged


def keyed_texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(key, doc_id, text, ...) with a unique bigint ``key`` that orders rows as their ids do.

    Where all ids are present and different the id is the key. Otherwise rows are numbered
    in the order of id (null first) and of the text's digest; rows equal in both are
    interchangeable. Numbering costs one range shuffle of the table.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    n, present, different = rows.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == present == different:
        return rows.select(F.col("doc_id").alias("key"), "*")
    ordered = rows.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    ordered = ordered.repartitionByRange("doc_id", "_digest").sortWithinPartitions("doc_id", "_digest")
    return staged(ordered.select(F.monotonically_increasing_id().alias("key"), *rows.columns), "keyed")
