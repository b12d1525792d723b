"""The quality model is trained on all trusted text."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceloom.llm import quality


def test_all_trusted_texts_are_fitted_on(spark, monkeypatch):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), "id").alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    for limit in (quality.BROADCAST_ROWS, 10):  # ids that are broadcast, and too many for it
        monkeypatch.setattr(quality, "BROADCAST_ROWS", limit)
        texts, held_out = quality.trusted_split(docs, labels)
        fitted = {r["text"] for r in texts.collect()}
        held = {f"word{r[0]}" for r in held_out.collect()}
        assert len(fitted) > 2500 and not fitted & held and len(fitted | held) == 6000


@pytest.mark.parametrize("words", [1, 3, 1 << 22])
def test_filter_of_any_size_holds_all_keys(spark, monkeypatch, words):
    monkeypatch.setattr(quality, "BLOOM_WORDS", words)
    monkeypatch.setattr(quality, "BLOOM_CHUNK", 2)
    keys = spark.range(1000).select(F.xxhash64("id").alias("key")).repartition(5)
    bloom = quality.filter_of(keys)
    held = np.array([r["key"] for r in keys.collect()], dtype=np.int64).view(np.uint64)
    assert len(bloom.bits) == min(words, 500) and bloom.might_hold(held).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert words < 500 or bloom.might_hold(others).mean() < 0.05


def test_small_filter_changes_no_score(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two w{i % 7} three w{i % 5}", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    monkeypatch.setattr(quality, "HEAD", 1)
    whole = {r["doc_id"]: r["log_prob"] for r in quality.judge(docs, labels).collect()}
    monkeypatch.setattr(quality, "BLOOM_WORDS", 1)
    assert {r["doc_id"]: r["log_prob"] for r in quality.judge(docs, labels).collect()} == pytest.approx(whole)


def test_steps_of_the_model_free_their_shuffles_and_tables(spark, monkeypatch):
    """What a step of the job stores and shuffles does not lie beside that of later steps."""
    docs = spark.createDataFrame([(i, f"one two w{i % 7} three w{i % 5}", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    monkeypatch.setattr(quality, "HEAD", 1)
    there, plain = {}, quality.stored

    def noting(rows, label, **options):
        kept = plain(rows, label, **options)
        there.setdefault(label, []).append(kept)
        return kept

    monkeypatch.setattr(quality, "stored", noting)
    scores = quality.judge(docs, labels)
    gone = [label for label, tables in there.items() for kept in tables if not os.path.exists(kept.stored_at)]
    assert sorted(gone) == ["bigrams", "contexts", "met-contexts", "trigrams", "unigrams", "weights", "weights"]
    assert len(there["scores"]) == quality.PARTS and scores.count() == 60
