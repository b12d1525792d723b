"""Report rows for search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import text as t
from sourceloom.plans.search import search
from sourceloom.sources.store import CorpusStore

REPORT_NEIGHBOURS = 12


def report(
    store: CorpusStore,
    queries: str | DataFrame,
    k: int = 10,
    encoder=None,
    with_graph: bool = True,
    latest_only: bool = False,
) -> DataFrame:
    """One escaped section per hit: title, meta line, code snippet, graph markup."""
    hits = search(
        store, queries, k, encoder, with_graph, latest_only, neighbour_limit=REPORT_NEIGHBOURS, context_top=None
    )
    return report_rows(hits)


def report_rows(hits: DataFrame) -> DataFrame:
    """Sections of hits; without callers and callees the graph is null."""
    graph = F.lit(None).cast("string")
    if "callers" in hits.columns:
        graph = t.html_escape(t.graph_text(F.coalesce("symbol", F.lit("")), F.col("callers"), F.col("callees")))
    return hits.select(
        "query_id",
        "rank",
        "score",
        t.html_escape(t.hit_title(F.col("type"), F.col("symbol"))).alias("title"),
        t.html_escape(t.hit_meta(F.coalesce("file_path", F.lit("-")), F.col("score"))).alias("meta"),
        t.html_escape(t.report_snippet(F.col("code"))).alias("snippet"),
        graph.alias("graph"),
    )


def write_report(rows: DataFrame, path: str) -> None:
    """A query's sections lie next to each other in one file, in rank order. Queries are
    dealt by hash: ranges would have to be sampled, which works the rows out twice."""
    ordered = rows.repartition("query_id").sortWithinPartitions("query_id", "rank")
    ordered.write.mode("overwrite").parquet(path)
