"""The call graph as an edge table; only one-hop lookups are needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.operators.ranking import top_n
from sourceloom.operators.sizing import BROADCAST_ROWS, any_of, at_most, broadcast_if_small, few_values
from sourceloom.session import cut_lineage


def new_edges(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Found edges that are not in the graph yet.

    The graph only grows, the edges found in one run are often few: then their callers
    are broadcast and the rest of the graph stays out of the shuffle. The found edges are
    read three times, so they are materialised.
    """
    found = cut_lineage(found.select("caller", "callee").distinct())
    callers = found.select("caller").distinct()
    if at_most(callers, BROADCAST_ROWS):
        existing = existing.join(F.broadcast(callers), "caller", "left_semi")
    return found.join(existing, ["caller", "callee"], "left_anti")


def merge_edges(existing: DataFrame, found: DataFrame) -> DataFrame:
    """The graph with the found edges; an edge already there stays single."""
    return existing.select("caller", "callee").unionByName(found.select("caller", "callee")).distinct()


def method_nodes(edges: DataFrame) -> DataFrame:
    """Every end of an edge once, in one pass over the edges."""
    return edges.select(F.explode(F.array("caller", "callee")).alias("name")).distinct()


def graph_counts(edges: DataFrame) -> DataFrame:
    """One row: distinct methods and edges. Each edge gives two ends in the scan."""
    ends = edges.select(F.explode(F.array("caller", "callee")).alias("name"))
    return ends.agg(
        F.count_distinct("name").alias("methods"), F.expr("count(1) div 2").alias("calls")
    )


def neighbours(edges: DataFrame, n: int = 10, targets: DataFrame | None = None, by_callee: DataFrame | None = None) -> DataFrame:
    """Callers and callees per method, at most n each, first by name.

    ``targets`` (one column ``target``) restricts the methods looked up. One scan of
    the edges serves both directions, unless ``by_callee`` gives those whose callees are
    looked for apart. A few targets become a filter that Parquet can answer per row group;
    more are joined, and every method is cut to n neighbours before its group is shuffled.
    """
    few = few_values(targets, "target") if targets is not None else None

    def side(edges: DataFrame, target: str, name: str, kind: str) -> DataFrame:
        if few is not None:
            edges = edges.where(any_of(F.col(target), few))
        return edges.select(F.col(target).alias("target"), F.lit(kind).alias("side"), F.col(name).alias("name"))

    if by_callee is not None:
        ends = side(by_callee, "callee", "caller", "in").unionByName(side(edges, "caller", "callee", "out"))
    else:
        if few is not None:
            edges = edges.where(any_of(F.col("caller"), few) | any_of(F.col("callee"), few))
        ends = edges.select(
            F.inline(
                F.array(
                    F.struct(F.col("callee").alias("target"), F.lit("in").alias("side"), F.col("caller").alias("name")),
                    F.struct(F.col("caller").alias("target"), F.lit("out").alias("side"), F.col("callee").alias("name")),
                )
            )
        )
        if few is not None:
            ends = ends.where(any_of(F.col("target"), few))
    if few is None and targets is not None:
        ends = ends.join(broadcast_if_small(targets), "target", "left_semi")
    near = top_n(ends, ["target", "side"], [F.col("name")], n)

    def names(side: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("name"))))

    return near.groupBy("target").agg(names("in").alias("callers"), names("out").alias("callees"))


def callers_of(edges: DataFrame, name: str, n: int = 10) -> DataFrame:
    """Callers of one method; the name filter reaches the Parquet scan."""
    return edges.where(F.col("callee") == name).select(F.col("caller").alias("name")).orderBy("name").limit(n)


def callees_of(edges: DataFrame, name: str, n: int = 10) -> DataFrame:
    """Methods called by one method."""
    return edges.where(F.col("caller") == name).select(F.col("callee").alias("name")).orderBy("name").limit(n)
