"""First n rows per group, safe for a group that holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_SALTS = 64


def top_n(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Rows ranked 1..n within their group.

    Spark cuts each group to n rows before the shuffle (WindowGroupLimit), so a hot
    group costs n rows per task. It does so only up to a configured n; beyond that a
    first pass over salted groups does the same job.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    limit = int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        salted = Window.partitionBy(*group, "_salt").orderBy(*order)
        # As many parts as the shuffle has, so that a hot group is spread over all tasks.
        salts = max(LEAST_SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c not in group]), F.lit(salts))
        rows = (
            rows.withColumn("_salt", salt)
            .withColumn("_near", F.row_number().over(salted))
            .where(F.col("_near") <= n)
            .drop("_salt", "_near")
        )
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
