"""The pipeline keeps clean documents and acts on planted ones."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        went = corpus_pipeline.stored(stage(spark, docs, SF), "test")
        assert went.columns == docs.columns and 0.5 * n < went.count() <= docs.count(), name
        docs = went
    assert docs.select("doc_id").distinct().count() == docs.count()
    assert docs.where(F.col("text").rlike("token = \"[0-9a-f]{40}")).count() == 0
    name, last = corpus_pipeline.STAGES[-1]
    coded = last(spark, docs, SF)
    same = coded.join(docs.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)), "doc_id").where("sha = decoded_sha256")
    assert same.count() == docs.count()
