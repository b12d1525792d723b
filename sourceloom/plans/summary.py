"""Counters and preview after an indexing run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import text as t
from sourceloom.operators.fragments import fragments_of
from sourceloom.operators.graph import graph_counts
from sourceloom.sources.store import CorpusStore

PREVIEW_ROWS = 25


def index_summary(store: CorpusStore) -> DataFrame:
    """(metric, value): counters of the last run, stored fragments, graph size."""
    last = store.runs().orderBy(F.desc("run")).limit(1)
    stored = store.searchable().agg(F.coalesce(F.sum("n_fragments"), F.lit(0)).alias("fragments"))
    return (
        as_metrics(last, "discovered", "skipped", "processed")
        .unionByName(as_metrics(stored, "fragments"))
        .unionByName(as_metrics(graph_counts(store.call_edges()), "methods", "calls"))
    )


def as_metrics(row: DataFrame, *names: str) -> DataFrame:
    """The named columns as (metric, value) rows."""
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value")) for n in names]
    return row.select(F.inline(F.array(*pairs)))


def preview_rows(fragments: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first n fragments with the width and head of their vectors."""
    return (
        fragments.orderBy("file_path", "type", "symbol")
        .limit(n)
        .select(
            F.coalesce("type", F.lit("-")).alias("type"),
            t.clip(F.when(F.col("symbol") != "", F.col("symbol")), 60, "-").alias("symbol"),
            F.coalesce(F.size("embedding"), F.lit(0)).alias("dims"),
            t.vector_head(F.col("embedding")).alias("head"),
        )
    )


def index_preview(store: CorpusStore, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first n stored fragments by path, type and symbol.

    Each file has a fragment, so the first n fragments lie within the paths of the first
    n files: only files up to that path are opened up.
    """
    files = store.searchable()
    first = files.select("file_path").orderBy("file_path").limit(n)
    last_path = first.agg(F.max("file_path")).first()[0]
    return preview_rows(fragments_of(files.where(F.col("file_path") <= last_path)), n)
