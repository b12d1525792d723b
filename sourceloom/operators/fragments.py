"""From source text to class and method fragments and call edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import java, text
from sourceloom.operators.keyfilter import might_match
from sourceloom.operators.sizing import broadcast_if_small
from sourceloom.session import cut_lineage


def read_sources(files: DataFrame) -> DataFrame:
    """Decode each file, drop its licence banner and read its names.

    One narrow projection per step: each pattern runs once per file, and no step
    shuffles.
    """
    return (
        files.withColumn("_decoded", text.decode_source(F.col("content")))
        .withColumn("_body", text.strip_block_banner(F.col("_decoded")))
        .withColumn("code", text.strip_line_banner(F.col("_body")))
        .drop("content", "_decoded", "_body")
        .transform(read_names)
    )


def read_names(coded: DataFrame) -> DataFrame:
    """Add package, classes, methods and local calls of the ``code`` column."""
    code = F.col("code")
    return (
        coded.withColumn("package", java.package_of(code))
        .withColumn("classes", java.classes_of(code))
        .withColumn("methods", java.methods_of(code))
        .withColumn("_sites", java.call_sites_of(code))
        .withColumn("calls", java.local_calls(F.col("_sites"), F.col("methods")))
        .withColumn("n_fragments", F.size("classes") + F.size("methods"))
        .drop("_sites")
    )


def fragments_of(sources: DataFrame) -> DataFrame:
    """One row per class and per method, with the columns of its file.

    Names are exploded before call lists are built, so a file with many methods never
    holds all of its lists in one row. Class rows carry bare call names, method rows
    carry full names without the method itself.
    """
    named = F.concat(
        F.transform("classes", lambda c: F.struct(F.lit("class").alias("type"), c.alias("name"))),
        F.transform("methods", lambda m: F.struct(F.lit("method").alias("type"), m.alias("name"))),
    )
    is_class = F.col("type") == "class"
    full_name = java.method_fqn(F.col("package"), F.col("classes"), F.col("name"))
    others = F.filter("calls", lambda c: c != F.col("name"))
    full_calls = F.transform(
        others, lambda c: java.method_fqn(F.col("package"), F.col("classes"), c)
    )
    return (
        sources.select("*", F.inline(named))
        .withColumn(
            "symbol", F.when(is_class, java.class_fqn(F.col("package"), F.col("name"))).otherwise(full_name)
        )
        .withColumn("calls", F.when(is_class, F.col("calls")).otherwise(full_calls))
        .drop("name", "package", "classes", "methods", "n_fragments", "dims")
    )


def call_edges_of(sources: DataFrame) -> DataFrame:
    """Distinct method to method edges.

    Both ends are made distinct within the file before they are paired; the final
    distinct then merges files that share names, partially before its shuffle.
    """
    caller = java.method_fqn(F.col("package"), F.col("classes"), F.col("_from"))
    callee = java.method_fqn(F.col("package"), F.col("classes"), F.col("_to"))
    return (
        sources.select("package", "classes", "calls", F.explode(F.array_distinct("methods")).alias("_from"))
        .select("package", "classes", "_from", F.explode(F.array_distinct("calls")).alias("_to"))
        .where(F.col("_from") != F.col("_to"))
        .select(caller.alias("caller"), callee.alias("callee"))
        .distinct()
    )


def split_by_sharing(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with calls, as (package, classes, _prefix, methods, calls) with distinct names: those
    whose package and class no other file has, and those that share them.

    A full name is this prefix, a dot and a name without dots, so that an edge can only be
    found in several files where these have one prefix.
    """
    prefix = F.concat_ws(".", F.col("package"), F.get("classes", F.lit(0)))
    distinct = [F.array_distinct(c).alias(c) for c in ("methods", "calls")]
    files = sources.where("size(methods) > 0 and size(calls) > 0").select("package", "classes", prefix.alias("_prefix"), *distinct)
    shared = files.groupBy("_prefix").count().where("count > 1").select("_prefix")
    shared = broadcast_if_small(cut_lineage(shared))
    return files.join(shared, "_prefix", "left_anti"), files.join(shared, "_prefix", "left_semi")


def edge_lists_of(files: DataFrame, side: str) -> DataFrame:
    """(side, _prefix, _others): all edges of a file by their caller or callee, the other ends
    as bare names behind a prefix."""
    near, far = ("methods", "calls") if side == "caller" else ("calls", "methods")
    named = files.select("package", "classes", "_prefix", F.explode(near).alias("_name"), F.col(far).alias("_others"))
    name = java.method_fqn(F.col("package"), F.col("classes"), F.col("_name"))
    others = F.array_remove("_others", F.col("_name"))
    return named.select(name.alias(side), "_prefix", others.alias("_others")).where(F.size("_others") > 0)


def with_new_names(sources: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files that can hold an edge that no indexed file holds: none has their package, class,
    methods and calls, in whatever order. Only indexed files that a filter lets through move."""
    keys = ["_prefix", "_methods", "_calls"]

    def keyed(rows: DataFrame) -> DataFrame:
        names = [F.array_sort(F.array_distinct(c)).alias(f"_{c}") for c in ("methods", "calls")]
        prefix = F.concat_ws(".", F.col("package"), F.get("classes", F.lit(0)))
        return rows.where("size(methods) > 0 and size(calls) > 0").select("package", "classes", "methods", "calls", prefix.alias("_prefix"), *names)

    found = keyed(sources)
    seen = might_match(keyed(indexed).select(*keys), found.select(*keys), keys, found.count())
    return found.join(seen.distinct(), keys, "left_anti")


def edges_of_fragments(fragments: DataFrame) -> DataFrame:
    """The same edges from a table of fragments."""
    return (
        fragments.where("type = 'method'")
        .select(F.col("symbol").alias("caller"), F.explode(F.array_distinct("calls")).alias("callee"))
        .distinct()
    )
