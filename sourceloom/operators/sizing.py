"""Size checks in front of every broadcast and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

# Rows of a narrow table (a path or name, a hash) that may be broadcast, and the bytes
# that they may take.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20
# Values that may be written into a filter as literals, and how many of them Spark
# passes to Parquet in one IN list before it falls back to a range.
LOOKUP_VALUES = 200
_IN_LIST = 10


def row_bytes(rows: DataFrame) -> Column:
    """About how many bytes a row takes: its texts and lists of texts, and 16 per column."""
    total = F.lit(16 * len(rows.columns)).cast("long")
    for field in rows.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, StringType):
            total += F.coalesce(F.octet_length(F.array_join(column, "")), F.lit(0))
        elif isinstance(field.dataType, (StringType, BinaryType)):
            total += F.coalesce(F.octet_length(column), F.lit(0))
    return total


def at_most(rows: DataFrame, limit: int, most_bytes: int | None = BROADCAST_BYTES) -> bool:
    """Whether a DataFrame has at most that many rows, and bytes if they are bounded; reads
    no more than needed."""
    if most_bytes is None:
        return rows.limit(limit + 1).count() <= limit
    sizes = rows.select(row_bytes(rows).alias("size")).limit(limit + 1)
    found = sizes.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    return found["n"] <= limit and (found["size"] or 0) <= most_bytes


def broadcast_if_small(
    rows: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int | None = BROADCAST_BYTES
) -> DataFrame:
    """A broadcast hint for a checked size; otherwise the plain side of a shuffle join."""
    return F.broadcast(rows) if at_most(rows, limit, most_bytes) else rows


def few_values(rows: DataFrame, column: str, limit: int = LOOKUP_VALUES) -> list | None:
    """The distinct values of a column if there are few, else None."""
    found = rows.select(column).distinct().limit(limit + 1).collect()
    return [row[0] for row in found] if len(found) <= limit else None


def any_of(column: Column, values: list) -> Column:
    """An IN filter in pieces that Parquet statistics and Bloom filters can answer."""
    test = F.lit(False)
    for start in range(0, len(values), _IN_LIST):
        piece = column.isin(values[start : start + _IN_LIST])
        test = piece if start == 0 else test | piece
    return test
