"""Empty all tables of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sourceloom.sources.store import TABLES, CorpusStore


def reset(store: CorpusStore) -> DataFrame:
    """Purge fragments, hash state and graph; returns (table_name, deleted) for the
    first two. The run log goes first, so a reset cut short leaves nothing visible."""
    counts = [("fragments", store.fragments().count()), ("file_hashes", store.file_hashes().count())]
    for name in ("runs", *sorted(TABLES.keys() - {"runs"})):
        store.clear(name)
    return store.spark.createDataFrame(counts, "table_name string, deleted long")
