import corpus_pipeline
from marquee.llm import mixing
from pyspark.sql import functions as F


def test_packing_keeps_the_order_of_the_blocks(spark, tmp_path):
    """Sources that lie one after another in the input are packed in their blocks, the uses of a document apart."""
    rows = [(i, " ".join([f"w{i % 7}"] * (20 + i % 5 + 60 * (i % 11 == 0))), "en", "big" if i < 1000 else "small", 0) for i in range(1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    uses = mixing.mix(docs, mixing.word_count(F.col("text")), block_tokens=2000).orderBy("block", "place").collect()
    assert len({u.block for u in uses}) > 8 and any(u.epoch for u in uses)
    want = [u.doc_id for u in uses]
    assert want != sorted(want)
    mixed = corpus_pipeline.mix_sources(spark, docs, None, block_tokens=2000)
    assert mixed.columns == docs.columns
    mixed.write.parquet(out := str(tmp_path / "mixed"))
    assert len(list((tmp_path / "mixed").glob("part-*.parquet"))) > 1 or mixed.rdd.getNumPartitions() == 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # files in pieces, and several of them in a task
    try:
        pieces = corpus_pipeline.pack_sequences(spark, spark.read.parquet(out), None).orderBy("sequence_id", "offset").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [p.doc_id for p in pieces if p.start == 0] == want
    first, gaps = {}, []
    for at, doc in enumerate(want):
        if at != first.setdefault(doc, at):
            gaps.append(at - first[doc])
    assert len(gaps) > 200 and sorted(gaps)[len(gaps) // 2] > 300
