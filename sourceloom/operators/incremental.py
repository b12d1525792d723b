"""Change detection by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.operators.keyfilter import might_match
from sourceloom.operators.sizing import BROADCAST_ROWS, at_most
from sourceloom.session import cut_lineage


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("hash", F.md5("content"))


def changed_files(
    files: DataFrame,
    state: DataFrame,
    full_rescan: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
    small: bool | None = None,
) -> DataFrame:
    """Files whose (path, hash) is not in the state; all of them on a full rescan.

    ``files`` may carry wide columns, so they are kept out of shuffles where possible:
    a small state is broadcast; beside a large one the anti join runs on paths and
    hashes alone, and if few files changed their paths are broadcast to pick up the
    rest. If many changed, a filter of their keys drops the others in the scan, and only
    changed contents move. ``small`` tells whether the state may be broadcast; where it is
    not known, the state is written once and measured, in rows and bytes.
    """
    if full_rescan:
        return files
    keys = ["file_path", "hash"]
    if small is None:
        state = cut_lineage(state)
        small = at_most(state, broadcast_rows)
    if small:
        return files.join(F.broadcast(state), keys, "left_anti")
    changed = cut_lineage(files.select(*keys).join(state, keys, "left_anti"))
    if at_most(changed, broadcast_rows):
        return files.join(F.broadcast(changed), keys, "left_semi")
    return might_match(files, changed, keys, changed.count()).join(changed, keys, "left_semi")


def scan_counters(files: DataFrame, state: DataFrame, full_rescan: bool = False) -> DataFrame:
    """One row: files discovered, skipped as unchanged, processed."""
    if full_rescan:
        flagged = files.select(F.lit(False).alias("same"))
    else:
        known = state.select("file_path", "hash", F.lit(True).alias("known"))
        flagged = (
            files.select("file_path", "hash")
            .join(known, ["file_path", "hash"], "left")
            .select(F.col("known").isNotNull().alias("same"))
        )
    return flagged.agg(
        F.count("*").alias("discovered"),
        F.count_if("same").alias("skipped"),
        F.count_if(~F.col("same")).alias("processed"),
    )


def upsert_hashes(state: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row per path; a scanned hash replaces the stored one."""
    new = scanned.select("file_path", F.col("hash").alias("new_hash"))
    return state.join(new, "file_path", "full_outer").select(
        "file_path", F.coalesce("new_hash", "hash").alias("hash")
    )
