"""Fixed schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

RUN = StructField("run", IntegerType())

# One row per file and indexing run. Everything the fragments of a file share
# (code, vector) is stored once here; fragments are a view, see fragments_of().
SOURCES = StructType(
    [
        StructField("source_key", StringType()),
        StructField("file_path", StringType()),
        StructField("hash", StringType()),
        StructField("code", StringType()),
        StructField("package", StringType()),
        StructField("classes", ArrayType(StringType())),
        StructField("methods", ArrayType(StringType())),
        StructField("calls", ArrayType(StringType())),
        StructField("n_fragments", IntegerType()),
        StructField("dims", IntegerType()),
        StructField("embedding", ArrayType(FloatType())),
        StructField("norm", DoubleType()),
        StructField("error", StringType()),
        RUN,
    ]
)

CALL_EDGES = StructType(
    [StructField("caller", StringType()), StructField("callee", StringType()), RUN]
)

# A run that replaces notes the paths it has indexed anew, and those that are gone.
REMOVED = StructType([StructField("file_path", StringType()), RUN])

# Which stored file of edges holds which names: ``side`` is the column it is ordered by.
EDGE_FILES = StructType(
    [
        StructField("side", StringType()),
        StructField("part", StringType()),
        StructField("low", StringType()),
        StructField("high", StringType()),
        RUN,
    ]
)

RUNS = StructType(
    [
        StructField("discovered", LongType()),
        StructField("skipped", LongType()),
        StructField("processed", LongType()),
        StructField("full_rescan", IntegerType()),
        StructField("encoder", StringType()),
        StructField("dim", IntegerType()),
        # The compacted state that the run started from, and the rows written since.
        StructField("state", IntegerType()),
        StructField("state_rows", LongType()),
        StructField("state_bytes", LongType()),
        StructField("delta_rows", LongType()),
        # Paths whose older versions the run has taken back.
        StructField("removed", LongType()),
        RUN,
    ]
)

HASH_STATE = StructType(
    [
        StructField("file_path", StringType()),
        StructField("hash", StringType()),
        StructField("run", IntegerType()),
        StructField("v", IntegerType()),
    ]
)

# What a stream has seen: one row per file, size and time of change.
SEEN_FILES = StructType(
    [
        StructField("file_path", StringType()),
        StructField("size", LongType()),
        StructField("modified", LongType()),
        StructField("listing", LongType()),
    ]
)
