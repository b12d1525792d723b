"""Source files as a DataFrame of (file_path, content)."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.sources.listing import can_list, list_files, qualified, read_files

JAVA = ".java"


def any_case_glob(suffix: str) -> str:
    """``*.java`` in every mix of cases, as a path glob."""
    letters = (f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    return "*" + "".join(letters)


def has_suffix(file_path: Column, suffix: str = JAVA) -> Column:
    return F.endswith(F.lower(file_path), F.lit(suffix.lower()))


def local_path(path: Column) -> Column:
    """Plain paths for local files; other file systems keep their scheme."""
    return F.regexp_replace(path, "^file:(//)?", "")


def scan_files(spark: SparkSession, root: str, suffix: str = JAVA) -> DataFrame:
    """All files below root with the suffix, in any case, hidden and empty ones too.

    Folders are listed and files read in tasks, where these can open the file system. Where
    they cannot, Spark's own reader stands in, which passes over empty files and over names
    that start with ``_`` or ``.``; a warning says so.
    """
    if can_list(qualified(spark, root)):
        return read_files(list_files(spark, root, suffix))
    warnings.warn(f"hidden and empty files below {root} are not seen", stacklevel=2)
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", any_case_glob(suffix))
        .load(root)
    )
    return found.select(local_path(F.col("path")).alias("file_path"), "content")


def files_from_table(table: DataFrame, path: Column, text: Column, suffix: str = JAVA) -> DataFrame:
    """Source files that already sit in a table, one per row."""
    files = table.select(path.alias("file_path"), text.cast("binary").alias("content"))
    return files.where(has_suffix(F.col("file_path"), suffix))
