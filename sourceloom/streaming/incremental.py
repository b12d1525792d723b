"""Incremental indexing as a stream of new and rewritten files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sourceloom.plans.index import index_files
from sourceloom.schemas import SEEN_FILES
from sourceloom.session import cut_lineage
from sourceloom.sources.files import JAVA
from sourceloom.sources.listing import list_files, read_files
from sourceloom.sources.store import CorpusStore

# Files per part of the journal where no limit is given.
BATCH_FILES = 1_000_000


def journal_changes(spark: SparkSession, root: str, journal: str, suffix: str, batch_files: int) -> int:
    """List the folder and note in the journal what is new: paths whose size or time of change
    differs from the last note. Returns the number of such files."""
    seen = spark.read.schema(SEEN_FILES).parquet(journal)
    newest = seen.groupBy("file_path").agg(F.max_by(F.struct("size", "modified"), "listing").alias("last"), F.max("listing").alias("listing"))
    number = (seen.agg(F.max("listing").alias("n")).first()["n"] or 0) + 1
    listed = list_files(spark, root, suffix)
    known = newest.select("file_path", "last.size", "last.modified")
    changed = cut_lineage(listed.join(known, ["file_path", "size", "modified"], "left_anti"))
    n = changed.count()
    if n:
        # Each part of the journal is one batch at most; few parts are smaller than that.
        parts = -(-n // (100 * batch_files))
        dealt = changed.repartition(parts).withColumn("listing", F.lit(number).cast("long"))
        dealt.write.mode("append").option("maxRecordsPerFile", batch_files).parquet(journal)
    return n


def index_stream(
    store: CorpusStore,
    root: str,
    checkpoint: str,
    encoder=None,
    suffix: str = JAVA,
    with_graph: bool = True,
    max_files_per_batch: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Start a query that indexes each micro-batch like a batch run.

    The folder is listed by tasks into a journal of (path, size, time of change) below
    ``checkpoint``, and the journal is what streams: Spark keeps track of its parts, and a
    rewritten file, a hidden or an empty one, is noted like a new one. A batch replayed after
    a failure finds its files unchanged. A file that has gone by the time its batch comes is
    passed over. ``checkpoint`` must be on shared storage. The default trigger takes what is
    there and stops; with another one the folder is listed anew at each trigger.
    """
    spark, journal = store.spark, f"{checkpoint.rstrip('/')}/journal"
    spark.createDataFrame([], SEEN_FILES).write.mode("ignore").parquet(journal)
    most = max_files_per_batch or BATCH_FILES
    once = not trigger or trigger.get("availableNow") or trigger.get("once")
    journal_changes(spark, root, journal, suffix, most)

    def one_batch(noted: DataFrame, _batch: int) -> None:
        if not once:
            journal_changes(spark, root, journal, suffix, most)
        rows = noted.where(F.col("file_path").isNotNull()).select("file_path", "size").dropDuplicates(["file_path"])
        listed = cut_lineage(rows)
        if not listed.isEmpty():
            index_files(read_files(listed, missing_ok=True), store, encoder, with_graph=with_graph)

    reader = spark.readStream.schema(SEEN_FILES)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", 1)
    noted = reader.parquet(journal)
    if not once:
        # A clock, so that there is a batch, and with it a listing, at each trigger.
        ticks = spark.readStream.format("rate").load()
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in SEEN_FILES]
        noted = noted.unionByName(ticks.select(*none))
    return (
        noted.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
