"""The corpus tables: plain Parquet folders, one ``run=N`` partition per indexing run.

A run writes its partitions first and its row in ``runs`` last. Readers only see runs
up to the last such row, so a run that died half-way is invisible, and its retry takes
the same number and overwrites what was left. Nothing older is ever rewritten: cost per
run follows the changed files, not the size of the corpus.

The current hash of each path is kept apart, in ``hash_state``: a compacted version ``v=N``,
which holds all runs up to N, and the runs since, which are read from ``sources``. A new
version is written when those have grown to a part of it, so that its cost is spread over
the rows that were added. The run log points to the version, and its row is written last.

A run that replaces writes the paths whose older versions no longer hold to ``removed``.
Nothing is deleted: readers leave out rows that are older than the note on their path.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sourceloom.operators.fragments import call_edges_of, edge_lists_of, fragments_of, split_by_sharing
from sourceloom.operators.graph import method_nodes
from sourceloom.operators.sizing import BROADCAST_BYTES, BROADCAST_ROWS, row_bytes
from sourceloom.schemas import CALL_EDGES, EDGE_FILES, HASH_STATE, REMOVED, RUNS, SOURCES
from sourceloom.session import cut_lineage

TABLES: dict[str, StructType] = {"sources": SOURCES, "call_edges": CALL_EDGES, "runs": RUNS, "hash_state": HASH_STATE}
TABLES |= {"callee_edges": CALL_EDGES, "edge_files": EDGE_FILES, "removed": REMOVED}
PARTITIONED_BY = {"hash_state": "v"}

# Executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Columns looked up by value; Bloom filters let a lookup skip row groups.
LOOKUP_COLUMNS = {"sources": ("source_key",), "call_edges": ("caller", "callee"), "callee_edges": ("caller", "callee")}
# Edges of a stored file, which is what a look-up of many names reads or leaves; the files
# that one may name in a filter.
EDGE_FILE_ROWS = 1_000_000
LISTED_PARTS = 20_000
# A row of this side and no file notes that a run stored all edges of its files.
WHOLE = "all"
SIDES = {"caller": "call_edges", "callee": "callee_edges"}
# Rows added since, as a part of the compacted hash state, at which it is written anew.
COMPACT_AT = 0.25


@dataclass
class Head:
    """The last run, the files that all runs have indexed, notes of removed paths, and runs from
    before the log told of a hash state."""

    run: int = 0
    processed: int = 0
    removed: int = 0
    old_runs: int = 0


@dataclass
class HashState:
    """A compacted version, its rows and bytes, and the rows that later runs have added."""

    version: int = 0
    rows: int = 0
    bytes: int = 0
    delta_rows: int = 0

    def is_small(self) -> bool:
        return self.rows + self.delta_rows <= BROADCAST_ROWS and self.bytes + self.delta_rows * 200 <= BROADCAST_BYTES


class CorpusStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        for name in TABLES:
            self._empty(name).write.mode("ignore").partitionBy(PARTITIONED_BY.get(name, "run")).parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[name])

    def _all(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(self.path(name))

    def _committed(self, name: str, head: Head | None = None) -> DataFrame:
        return self._all(name).where(F.col("run") <= (head or self.head()).run)

    def _visible(self, rows: DataFrame, head: Head) -> DataFrame:
        """Rows (file_path, run, ..) without those that a later run has taken back."""
        if not head.removed:
            return rows
        notes = self._committed("removed", head).groupBy(F.col("file_path").alias("_path")).agg(F.max("run").alias("_until"))
        notes = F.broadcast(notes) if head.removed <= BROADCAST_ROWS else notes
        return rows.join(notes, (F.col("file_path") == F.col("_path")) & (F.col("run") < F.col("_until")), "left_anti")

    # -- reading ---------------------------------------------------------------

    def runs(self) -> DataFrame:
        return self._all("runs")

    def head(self) -> Head:
        """The last run and what all runs add up to, from the run log alone."""
        sums = [F.sum("processed"), F.sum("removed"), F.count_if(F.col("state").isNull())]
        row = self.runs().agg(F.max("run"), *sums).first()
        return Head(*[n or 0 for n in row])

    def last_run(self) -> int:
        return self.head().run

    def encoder(self) -> tuple[str, int] | None:
        """Name and width of the encoder of the last run."""
        row = self.runs().orderBy(F.desc("run")).select("encoder", "dim").first()
        return (row["encoder"], row["dim"]) if row else None

    def sources(self, latest_only: bool = False) -> DataFrame:
        """Indexed files. By default every indexed version of a file, as appended;
        ``latest_only`` keeps the newest version of each path."""
        head = self.head()
        rows = self._visible(self._committed("sources", head), head)
        if latest_only:
            rows = rows.join(self._latest(head).select("file_path", "run"), ["file_path", "run"], "left_semi")
        return rows

    def _latest(self, head: Head, after: int = 0) -> DataFrame:
        """The newest row of each path among the runs after one."""
        newest = F.max_by(F.struct("hash", "run"), "run").alias("newest")
        return self._committed("sources", head).where(F.col("run") > after).groupBy("file_path").agg(newest).select("file_path", "newest.*")

    def state(self) -> HashState:
        """The hash state as of the last run, from the run log alone."""
        row = self.runs().orderBy(F.desc("run")).select("state", "state_rows", "state_bytes", "delta_rows").first()
        if not row:
            return HashState()
        if row["delta_rows"] is None:  # a log from before there was a state
            return HashState(delta_rows=self.head().processed)
        return HashState(*row)

    def _hashes(self, state: HashState) -> DataFrame:
        """(file_path, hash, run): the compacted version and, over it, what came later."""
        head = self.head()
        return self._visible(self._versions(state, head), head)

    def _versions(self, state: HashState, head: Head) -> DataFrame:
        if not state.version:
            return self._latest(head)
        base = self._all("hash_state").where(F.col("v") == state.version).drop("v")
        if not state.delta_rows:
            return base
        later = self._latest(head, state.version)
        small = F.broadcast(later) if state.delta_rows <= BROADCAST_ROWS else later
        return base.join(small, "file_path", "left_anti").unionByName(later)

    def file_hashes(self, state: HashState | None = None) -> DataFrame:
        """Current hash per path: each file's newest run wins."""
        return self._hashes(state or self.state()).select("file_path", "hash")

    def compacted(self) -> HashState:
        """The hash state for a new run: compacted up to the last run, if enough was added.

        The new version counts once a run that started from it is committed.
        """
        state, last = self.state(), self.last_run()
        if not last or state.delta_rows <= COMPACT_AT * state.rows:
            return state
        path = f"{self.path('hash_state')}/v={last}"
        # In the order of paths, so that a look-up of some skips row groups.
        self._hashes(state).repartitionByRange("file_path").sortWithinPartitions("file_path").write.mode("overwrite").parquet(path)
        written = self._all("hash_state").where(F.col("v") == last).drop("v")
        size = written.agg(F.count("*").alias("n"), F.sum(row_bytes(written)).alias("bytes")).first()
        return HashState(last, size["n"], size["bytes"] or 0, 0)

    def searchable(self, latest_only: bool = False) -> DataFrame:
        """Files with at least one fragment and a vector. The width is a column of its
        own, so that the filter reaches Parquet and the vectors need not be read."""
        return self.sources(latest_only).where("n_fragments > 0 and dims > 0")

    def vectors(self, latest_only: bool = False) -> DataFrame:
        """(source_key, part, embedding, norm) of the searchable files; ``part`` is the stored
        file that the row lies in, so that a hit knows where its code is."""
        head = self.head()
        rows = self._committed("sources", head).where("n_fragments > 0 and dims > 0")
        rows = self._visible(rows.select("source_key", F.col("_metadata.file_name").alias("part"), "embedding", "norm", "file_path", "run"), head)
        if latest_only:
            rows = rows.join(self._latest(head).select("file_path", "run"), ["file_path", "run"], "left_semi")
        return rows.select("source_key", "part", "embedding", "norm")

    def fragments(self, latest_only: bool = False) -> DataFrame:
        return fragments_of(self.searchable(latest_only))

    def index_errors(self) -> DataFrame:
        """Fragments left out because their text could not be encoded, with the reason."""
        failed = self.sources().where("n_fragments > 0 and dims = 0")
        return fragments_of(failed).select("run", "file_path", "type", "symbol", "error")

    def call_edges(self) -> DataFrame:
        """The stored edges; once paths were removed, those of the files that are left."""
        head = self.head()
        if head.removed:
            return call_edges_of(self.sources())
        return self._committed("call_edges", head).select("caller", "callee")

    def edges_of(self, side: str, names: DataFrame) -> DataFrame:
        """Edges whose ``side``, caller or callee, is among the names (one column ``target``).

        The edges are stored twice, in the order of either side, and the run log's table of
        files tells which can hold a name: only these are read. Names that touch more files
        than a filter may list are joined with all.
        """
        table, head = SIDES[side], self.head()
        if head.removed:
            return self.call_edges()
        if side == "callee" and head.old_runs:
            table = "call_edges"  # runs from before there was a second order
        edges = self._committed(table, head)
        parts = self._parts(side, names, head)
        if parts is not None:
            edges = edges.where(F.col("_metadata.file_name").isin(parts))
        return edges.select("caller", "callee")

    def _parts(self, side: str, names: DataFrame, head: Head | None = None) -> list[str] | None:
        """The stored files that can hold one of the names; None if they are not known or too many."""
        head = head or self.head()
        if head.old_runs:
            return None
        files = self._committed("edge_files", head).where(F.col("side") == side).select("run", "low", "high", "part").toArrow().to_pylist()
        of_run: dict[int, list] = {}
        for row in files:
            of_run.setdefault(row["run"], []).append((row["low"], row["high"], row["part"]))
        ordered = [sorted(rows) for rows in of_run.values()]

        def run(frames):
            for frame in frames:
                found = set()
                for name in frame["target"].dropna():
                    for rows in ordered:
                        # Files of a run lie one behind the other; a name may stand in several.
                        i = bisect_right(rows, name, key=lambda r: r[0]) - 1
                        while i >= 0 and rows[i][1] >= name:
                            found.add(rows[i][2])
                            i -= 1
                yield pd.DataFrame({"part": sorted(found)})

        hit = names.select("target").mapInPandas(run, "part string").distinct().limit(LISTED_PARTS + 1).toArrow()["part"].to_pylist()
        return hit if len(hit) <= LISTED_PARTS else None

    def holds_all_edges(self, head: Head) -> bool:
        """Whether the graph as stored has all edges of all indexed files: every run has noted
        that it stored its own, and none was taken back."""
        noted = self._committed("edge_files", head).where(F.col("side") == WHOLE).select("run").distinct()
        return not head.removed and noted.count() == head.run

    def methods(self) -> DataFrame:
        return method_nodes(self.call_edges())

    # -- writing ---------------------------------------------------------------

    def run_path(self, name: str, run: int) -> str:
        return f"{self.path(name)}/run={run}"

    def write_run(self, name: str, run: int, rows: DataFrame, max_rows: int = 0) -> None:
        """Write one run's partition of a table, with at most ``max_rows`` in a file if given; a
        retry of the run replaces it."""
        columns = [f.name for f in TABLES[name].fields if f.name != "run"]
        writer = rows.select(*columns).write.mode("overwrite").option("maxRecordsPerFile", max_rows)
        for column in LOOKUP_COLUMNS.get(name, ()):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(self.run_path(name, run))

    def write_edges(self, run: int, edges: DataFrame, whole: bool = False) -> None:
        """Write a run's edges in both orders, and which file holds which names. ``whole`` tells
        that no edge of the run's files is missing in the graph then."""
        edges = cut_lineage(edges.select("caller", "callee"))
        self._write_sides(run, edges, lambda side: None, whole)

    def write_edges_of(self, run: int, sources: DataFrame, whole: bool = False) -> None:
        """Write the edges of the first run's files in both orders.

        Only edges of files that share package and class can be found twice and are made
        distinct. The others move as lists, one for each name, and are opened up behind the shuffle.
        """
        alone, shared = split_by_sharing(sources)
        self._write_sides(run, cut_lineage(call_edges_of(shared)), lambda side: edge_lists_of(alone, side), whole)

    def _write_sides(self, run: int, edges: DataFrame, lists: Callable[[str], DataFrame | None], whole: bool) -> None:
        files = self._empty("edge_files").drop("run")
        if whole:
            files = self.spark.createDataFrame([(WHOLE,)], "side string").select(*[F.col(c) if c == "side" else F.lit(None).cast("string").alias(c) for c in files.columns])
        for side, name in SIDES.items():
            other = "callee" if side == "caller" else "caller"
            rows, at = edges, [side, other]
            if (listed := lists(side)) is not None:
                # A list stays together; edges of names that many files share may be parted.
                single = edges.select(side, F.lit("").alias("_prefix"), F.array(other).alias("_others"), F.col(other).alias("_at"))
                rows, at = listed.withColumn("_at", F.lit("")).unionByName(single), [side, "_at"]
            ordered = rows.repartitionByRange(*at)
            if listed is not None:
                ends = ordered.select(side, "_prefix", F.explode("_others").alias("_end"))
                full = F.when(F.col("_prefix") == "", F.col("_end")).otherwise(F.concat_ws(".", "_prefix", "_end"))
                ordered = ends.select(side, full.alias(other))
            self.write_run(name, run, ordered.sortWithinPartitions(side, other), max_rows=EDGE_FILE_ROWS)
            held = self.read_run(name, run).select(F.col("_metadata.file_name").alias("part"), side).groupBy("part")
            held = held.agg(F.min(side).alias("low"), F.max(side).alias("high")).withColumn("side", F.lit(side))
            files = files.unionByName(held)
        self.write_run("edge_files", run, files.coalesce(1))

    def read_run(self, name: str, run: int) -> DataFrame:
        """One run's partition, committed or not."""
        schema = StructType([f for f in TABLES[name].fields if f.name != "run"])
        return self.spark.read.schema(schema).parquet(self.run_path(name, run))

    def commit(self, run: int, **fields) -> None:
        schema = StructType([f for f in RUNS.fields if f.name != "run"])
        row = self.spark.createDataFrame([tuple(fields[f.name] for f in schema.fields)], schema)
        self.write_run("runs", run, row.coalesce(1))

    def clear(self, name: str) -> None:
        # A dynamic overwrite of no partitions would remove nothing.
        writer = self._empty(name).write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy(PARTITIONED_BY.get(name, "run")).parquet(self.path(name))
