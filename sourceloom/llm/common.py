"""Reading tables and cutting lineage, shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.session import scratch_dir

BATCH_CHARS = 4_000_000
# Spark removes the shuffle files of a query when it ends, not when its plan is collected.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key for joins that equal rows share: the id as text (null: empty) and a text hash."""
    return F.struct(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.xxhash64(whole_text(text)).alias("hash"))


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside leave no shuffle files."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def stored(rows: DataFrame, label: str, **options: str) -> DataFrame:
    """Write rows once to the shared folder, with the options of the writer, and read them back.

    The copy outlives lost executors, is evaluated once however often it is read, and
    gives the planner its true size. The shuffle files behind it go once it is written.
    """
    spark = rows.sparkSession
    path = scratch_dir(spark, label)
    with shuffles_freed(spark):
        rows.write.options(**options).parquet(path)
    kept = spark.read.schema(rows.schema).parquet(path)
    kept.stored_at = path  # for discard()
    return kept


def discard(*tables: DataFrame) -> None:
    """Remove the folders of stored tables that nothing reads any more; other tables are left."""
    for rows in tables:
        if path := getattr(rows, "stored_at", None):
            spark = rows.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_batches(frames: Iterable[pd.DataFrame], text: str, chars: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    """Re-cut Arrow batches so that each holds about ``chars`` characters, or one longer row.

    Bounds the arrays that a vectorised pass builds, whatever the length of the texts.
    """
    for frame in frames:
        if not len(frame):
            continue
        group = (frame[text].str.len().cumsum() // chars).to_numpy()
        for _, part in frame.groupby(group, sort=False):
            yield part

