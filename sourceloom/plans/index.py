"""Index a folder, a table or a micro-batch of source files into a CorpusStore."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.encoder import HashingEncoder
from sourceloom.functions.vectors import norm
from sourceloom.operators.embed import embed, embed_distinct
from sourceloom.operators.fragments import call_edges_of, read_sources, with_new_names
from sourceloom.operators.graph import new_edges
from sourceloom.operators.incremental import changed_files, with_hash
from sourceloom.sources.files import JAVA, scan_files
from sourceloom.sources.listing import can_list, list_files, qualified, read_files
from sourceloom.sources.store import CorpusStore


def source_rows(files: DataFrame, encoder, distinct_texts: bool = False) -> DataFrame:
    """Rows of the ``sources`` table for hashed files. Only files with fragments are
    encoded, once each: all fragments of a file share its code. ``distinct_texts``
    encodes copies of a text once, which pays for an expensive model."""
    attach = embed_distinct if distinct_texts else embed
    return (
        read_sources(files)
        .withColumn("_encode", F.when(F.col("n_fragments") > 0, F.col("code")))
        .transform(attach, "_encode", encoder, error="error")
        .withColumn("dims", F.coalesce(F.size("embedding"), F.lit(0)))
        .withColumn("norm", F.when(F.col("dims") > 0, norm(F.col("embedding"))))
        .drop("_encode")
    )


def index_files(
    files: DataFrame,
    store: CorpusStore,
    encoder=None,
    full_rescan: bool = False,
    with_graph: bool = True,
    distinct_texts: bool = False,
    discovered: int | None = None,
    replace: bool = False,
    paths: DataFrame | None = None,
) -> int:
    """Index (file_path, content) rows and return the run number.

    The changed files go to ``sources`` in one pass. Edges and counters are then read
    back from what was written, so they describe the same bytes as the fragments, and
    the run becomes visible, hashes included, when its log row is written last. Rows
    without a path cannot be told apart or found again; they are not files and not counted.
    ``discovered`` is their number and ``paths`` a table of them, where the caller has them.

    Rescans append. With ``replace`` the run takes back what it supersedes: older versions of
    files that it indexes, and files that are not among ``files`` any more. Both vanish from
    search, graph, counts and hashes when the run is committed; the rows stay on disk.
    """
    files = files.where(F.col("file_path").isNotNull())
    encoder = encoder or HashingEncoder()
    head = store.head()
    run, known = head.run + 1, head.processed
    hashed = with_hash(files)
    state = store.compacted()
    all_ = full_rescan or known == 0
    changed = changed_files(hashed, store.file_hashes(state), all_, small=state.is_small())
    rows = source_rows(changed, encoder, distinct_texts).withColumn(
        "source_key", F.concat(F.col("file_path"), F.lit("\u0000"), F.lit(f"{run:010d}"))
    )
    store.write_run("sources", run, rows)

    written = store.read_run("sources", run)
    graphed = written if with_graph else written.limit(0)
    if known:
        if store.holds_all_edges(head):
            graphed = with_new_names(graphed, store.sources())
        store.write_edges(run, new_edges(store.call_edges(), call_edges_of(graphed)), with_graph)
    else:
        store.write_edges_of(run, graphed, with_graph)

    removed = 0
    if replace:
        known_paths = store.file_hashes(state).select("file_path")
        there = (files if paths is None else paths).select("file_path").distinct()
        again = written.select("file_path").join(known_paths, "file_path", "left_semi")
        store.write_run("removed", run, known_paths.join(there, "file_path", "left_anti").unionByName(again))
        removed = store.read_run("removed", run).count()
    if discovered is None:
        discovered = files.select("file_path").count()
    processed = written.count()
    store.commit(
        run,
        discovered=discovered,
        skipped=0 if full_rescan else discovered - processed,
        processed=processed,
        full_rescan=int(full_rescan),
        encoder=encoder.name,
        dim=encoder.dim,
        state=state.version,
        state_rows=state.rows,
        state_bytes=state.bytes,
        delta_rows=state.delta_rows + processed,
        removed=removed,
    )
    return run


def index_folder(
    store: CorpusStore,
    root: str,
    encoder=None,
    full_rescan: bool = False,
    with_graph: bool = True,
    distinct_texts: bool = False,
    suffix: str = JAVA,
    replace: bool = False,
) -> int:
    """Index all files with the suffix below a folder, hidden and empty ones too."""
    listed = None
    if can_list(qualified(store.spark, root)):
        listed = list_files(store.spark, root, suffix)
    files = read_files(listed) if listed is not None else scan_files(store.spark, root, suffix)
    found = listed.count() if listed is not None else None
    return index_files(files, store, encoder, full_rescan, with_graph, distinct_texts, found, replace, listed)
