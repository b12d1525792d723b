"""Folders listed and files read in tasks.

Spark's own file sources pass over empty files, and over files and folders whose names
start with ``_`` or ``.``. Here a table of folders is listed by tasks, in rounds: each task
walks down from its folders for a while and hands back those it did not come to. Nothing
but the number of open folders reaches the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.session import cut_lineage

# Folders that a task lists before it hands on the rest, and the tasks of a round.
FOLDERS = 500
TASKS = 2000
# Bytes and files that a task reads, and the bytes it holds at a time.
TASK_BYTES = 128 << 20
TASK_FILES = 20_000
BATCH_BYTES = 8 << 20
LISTED = "file_path string, size long, modified long"
_FOUND = f"is_folder boolean, {LISTED}"

# Executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path or URI, the path inside it, and what to put before such paths."""
    uri = path.replace("s3a://", "s3://", 1)
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), path, ""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/"), ""
    files, inside = pafs.FileSystem.from_uri(uri)
    whole = path.rstrip("/")
    return files, inside, whole[: len(whole) - len(inside.rstrip("/"))]


def qualified(spark: SparkSession, root: str) -> str:
    """The root as Spark would read it: with the scheme of its file system, and absolute."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") or "/")
    return str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())


def can_list(root: str) -> bool:
    """Whether tasks can open this kind of path."""
    try:
        opened(root)
    except (ValueError, pa.ArrowException, OSError):
        return False
    return True


def _is_link(files: pafs.FileSystem, path: str) -> bool:
    import os

    return isinstance(files, pafs.LocalFileSystem) and os.path.islink(path)


def walk(folders: list[str], suffix: str, most: int) -> Iterator[tuple[bool, str, int, int]]:
    """Files with the suffix in and below the folders, and the folders left when ``most`` are done.

    Links to files are followed, links to folders are not, so that no walk is endless.
    """
    left = list(folders)
    for _ in range(most):
        if not left:
            return
        files, inside, before = opened(left.pop())
        for found in files.get_file_info(pafs.FileSelector(inside)):
            path = before + found.path
            if found.type == pafs.FileType.Directory:
                if not _is_link(files, found.path):
                    left.append(path)
            elif found.type == pafs.FileType.File and path.lower().endswith(suffix):
                yield False, path, found.size, found.mtime_ns or 0
    for folder in left:
        yield True, folder, 0, 0


def list_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(file_path, size, modified) of all files below ``root`` whose names end with the suffix, in
    any case: hidden and empty ones too. Raises FileNotFoundError where there is no root."""
    files, inside, before = opened(qualified(spark, root))
    info = files.get_file_info(inside)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    if info.type == pafs.FileType.File:
        alone = [(before + inside, info.size, info.mtime_ns or 0)] if inside.lower().endswith(suffix.lower()) else []
        return spark.createDataFrame(alone, LISTED)
    suffix, most = suffix.lower(), FOLDERS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in walk(frame["file_path"].tolist(), suffix, most):
                rows.append(row)
                if len(rows) == 10_000:
                    yield pd.DataFrame(rows, columns=["is_folder", "file_path", "size", "modified"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["is_folder", "file_path", "size", "modified"])

    open_folders, n, rounds = spark.createDataFrame([(before + inside,)], "file_path string"), 1, []
    while n:
        dealt = open_folders.repartition(min(n, TASKS))
        found = cut_lineage(dealt.mapInPandas(run, _FOUND))
        rounds.append(found.where(~F.col("is_folder")).drop("is_folder"))
        open_folders = found.where("is_folder").select("file_path")
        n = open_folders.count()
    listed = rounds[0]
    for more in rounds[1:]:
        listed = listed.unionByName(more)
    return listed


def read_files(listed: DataFrame, missing_ok: bool = False) -> DataFrame:
    """(file_path, content) of listed files, spread over tasks by bytes and number.

    A file that is gone since it was listed fails the job, as in Spark's own sources, unless
    ``missing_ok``.
    """
    sizes = listed.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    tasks = max(1, -(-(sizes["bytes"] or 0) // TASK_BYTES), -(-sizes["n"] // TASK_FILES))
    tasks = max(tasks, min(sizes["n"] or 1, listed.sparkSession.sparkContext.defaultParallelism))
    schema = pa.schema([("file_path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, contents, held = [], [], 0
        for batch in batches:
            for path in batch.column("file_path").to_pylist():
                files, inside, _ = opened(path)
                try:
                    with files.open_input_stream(inside, compression=None) as stream:
                        content = stream.read()
                except FileNotFoundError:
                    if missing_ok:
                        continue
                    raise
                if paths and held + len(content) > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], schema=schema)
                    paths, contents, held = [], [], 0
                paths.append(path)
                contents.append(content)
                held += len(content)
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], schema=schema)

    return listed.select("file_path").repartition(tasks).mapInArrow(run, "file_path string, content binary")
