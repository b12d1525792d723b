"""Attach vectors to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.vectors import is_valid
from sourceloom.operators.sizing import broadcast_if_small
from sourceloom.session import cut_lineage

# Vectors with their text hashes that may be broadcast.
BROADCAST_BYTES = 128 << 20


def embed(rows: DataFrame, text: str, encoder, into: str = "embedding", error: str | None = None) -> DataFrame:
    """One vector per row, computed where the row is; on demand the reason why there is none
    in a column ``error``. An encoder that gives no reasons leaves it null."""
    if error is None:
        return rows.withColumn(into, encoder.column(F.col(text)))
    if not hasattr(encoder, "result"):
        return rows.withColumn(into, encoder.column(F.col(text))).withColumn(error, F.lit(None).cast("string"))
    told = rows.withColumn("_result", encoder.result(F.col(text)))
    return told.withColumn(into, F.col("_result.vector")).withColumn(error, F.col("_result.error")).drop("_result")


def embed_distinct(rows: DataFrame, text: str, encoder, into: str = "embedding", error: str | None = None) -> DataFrame:
    """One encoding per distinct text, joined back by its hash.

    Worth its shuffle when the encoder is an expensive model. Copies of a text collapse
    before the shuffle of distinct texts, and the vectors are materialised, so the model
    runs once. They are broadcast if they fit; otherwise a text that much of the corpus
    repeats makes a skewed join partition, which adaptive execution splits.
    """
    keyed = rows.withColumn("_text_hash", F.md5(text))
    once = keyed.select("_text_hash", F.col(text).alias("_text")).dropDuplicates(["_text_hash"])
    vectors = cut_lineage(embed(once, "_text", encoder, into, error).drop("_text"))
    vectors = broadcast_if_small(vectors, BROADCAST_BYTES // (4 * encoder.dim + 64), None)
    return keyed.join(vectors, "_text_hash", "left").drop("_text_hash")


def failed_rows(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows the encoder gave no vector for."""
    return rows.where(~is_valid(F.col(vector)))
