"""Searches and models whose tables come in parts, or not at all."""

import pytest
from pyspark.sql import functions as F

from sourceloom.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"


def test_parts_of_a_benchmark_agree(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    live = []
    plain = decontaminate.pattern_shards

    def watched(*args):
        for shard in plain(*args):
            live.append(sum(len(t) for _, t in shard))
            yield shard

    monkeypatch.setattr(decontaminate, "pattern_shards", watched)
    whole = sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect())
    hits = sorted(map(str, decontaminate.benchmark_hits(docs, items).collect()))
    total = live[0]
    live.clear()
    parts = decontaminate.decontaminate(docs, items, shard_bytes=total // 4)
    assert len(live) >= 4 and max(live) < total / 2
    assert parts.columns == docs.columns and sorted(r["doc_id"] for r in parts.collect()) == whole
    assert sorted(map(str, decontaminate.benchmark_hits(docs, items, shard_bytes=total // 4).collect())) == hits
    assert len(whole) < docs.count()


def labelled(spark, n, chars):
    docs = spark.createDataFrame([(i, f"word{i} and so on " * (chars // 15), "en") for i in range(n)], "doc_id long, text string, lang string")
    return docs, docs.select("doc_id", F.lit(1).alias("quality"))


def test_training_is_bounded_by_all_characters(spark):
    docs, labels = labelled(spark, 40, 30_000)
    for limit, most in ((100_000, 136_000), (1, 36_000), (10**9, 10**9)):
        texts = [r["text"] for r in quality.trusted_split(docs, labels, fit_chars=limit)[0].collect()]
        assert texts and sum(map(len, texts)) <= most and all(len(t) > 20_000 for t in texts)


def test_unusable_labels_are_told(spark):
    docs, labels = labelled(spark, 4, 100)
    with pytest.raises(ValueError, match="labelled as good"):
        quality.judge(docs, labels.withColumn("doc_id", F.col("doc_id") + 1000))
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).where("keep").count() == 4
    for one in range(4):  # a single trusted document, whichever half it falls into
        judged = quality.judge(docs, labels.where(F.col("doc_id") == one)).collect()
        assert len(judged) == 4 and all(r["perplexity"] is not None for r in judged)


def test_clashing_names(spark):
    docs, labels = labelled(spark, 6, 200)
    wide = docs.withColumn("_id", F.lit("x")).withColumn("_rejected", F.lit("y")).withColumn("_hash", F.lit(1)).withColumn("_hit", F.lit("z"))
    items = spark.createDataFrame([(1, "word3 and so"), (2, "word4 and")], "item_id long, text string")
    assert quality.keep_good(wide, labels).columns == wide.columns
    assert decontaminate.decontaminate(wide, items, shard_bytes=4).count() == 4
