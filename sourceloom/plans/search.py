"""Search fragments by text similarity, with graph context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import text as t
from sourceloom.functions.encoder import HashingEncoder
from sourceloom.operators.embed import embed
from sourceloom.operators.fragments import fragments_of
from sourceloom.operators.graph import neighbours
from sourceloom.operators.ranking import top_n
from sourceloom.operators.similarity import FIRST_TASKS, check_k, top_k, top_k_batch
from sourceloom.operators.sizing import any_of, at_most, broadcast_if_small, few_values
from sourceloom.session import cut_lineage
from sourceloom.sources.store import LISTED_PARTS, CorpusStore

CONTEXT_TOP = 5
SEARCH_NEIGHBOURS = 10
# Hits with their neighbour lists that may be broadcast; their bytes are checked too.
HIT_ROWS = 100_000


def search(
    store: CorpusStore,
    queries: str | DataFrame,
    k: int = 10,
    encoder=None,
    with_graph: bool = False,
    latest_only: bool = False,
    neighbour_limit: int = SEARCH_NEIGHBOURS,
    context_top: int | None = CONTEXT_TOP,
) -> DataFrame:
    """The k most similar fragments per query: (query_id, rank, score, type, symbol,
    file_path, code), plus callers and callees for the first ranks with ``with_graph``
    (all ranks for ``context_top=None``).

    ``queries`` is one text or a table (query_id, text).
    """
    check_k(k)
    encoder = encoder or HashingEncoder()
    indexed = store.encoder()
    if indexed and indexed != (encoder.name, encoder.dim):
        raise ValueError(f"the corpus is encoded with {indexed}, not {(encoder.name, encoder.dim)}")
    files = store.sources()
    ranked = rank_fragments(store.vectors(latest_only), files, queries, k, encoder)
    hits = ranked
    if with_graph:
        hits = cut_lineage(with_context(ranked, store, neighbour_limit, context_top))
    return fetch_code(files, hits)


def rank_fragments(
    vectors: DataFrame, files: DataFrame, queries: str | DataFrame, k: int, encoder
) -> DataFrame:
    """Top k fragments over the searchable files, without their code.

    All fragments of a file share one vector, so files are scored, not fragments: the
    k best fragments sit in the k best files, and only those files are opened up. The
    result is narrow and read several times, so it is materialised.
    """
    near = cut_lineage(nearest_sources(vectors, queries, k, encoder))
    found = lookup(files.drop("code", "embedding", "norm", "error"), near)
    order = [F.desc("score"), F.col("source_key"), F.col("symbol"), F.col("type")]
    columns = ["query_id", "rank", "score", "type", "symbol", "file_path", "source_key", "part"]
    return cut_lineage(top_n(fragments_of(found), ["query_id"], order, k).select(*columns))


def fetch_code(files: DataFrame, hits: DataFrame) -> DataFrame:
    """Add the code of each hit's file."""
    code = files.select("source_key", "code")
    return lookup(code, hits).select(*[c for c in hits.columns if c not in ("source_key", "part")], "code")


def lookup(files: DataFrame, hits: DataFrame) -> DataFrame:
    """Join materialised hits to their files by key. A few keys become a filter, so that
    Bloom filters find their rows. Of more, the stored files that hold them do, as each hit
    knows its ``part``: files without a hit are not opened. Hits are broadcast if they are few
    enough; of more, the distinct keys are, and only files that were hit are shuffled to meet
    them."""
    few = few_values(hits, "source_key")
    if few is not None:
        files = files.where(any_of(F.col("source_key"), few))
    else:
        parts = few_values(hits, "part", LISTED_PARTS)
        if parts is not None:
            files = files.where(F.col("_metadata.file_name").isin(parts))
    if at_most(hits, HIT_ROWS):
        return files.join(F.broadcast(hits), "source_key")
    if few is None:
        keys = cut_lineage(hits.select("source_key").distinct())
        files = files.join(broadcast_if_small(keys), "source_key", "left_semi")
    return files.join(hits, "source_key")


def nearest_sources(vectors: DataFrame, queries: str | DataFrame, k: int, encoder) -> DataFrame:
    """(query_id, source_key, part, score) of the k best files per query."""
    spark = vectors.sparkSession
    # The part travels behind the key, which is unique, so that it decides no tie.
    base = vectors.select(F.concat("source_key", F.lit("\u0000"), "part").alias("key"), "part", "embedding", "norm")
    if isinstance(queries, str):
        asked = spark.createDataFrame([(0, queries)], "query_id long, text string")
        vector = embed(asked, "text", encoder).first()["embedding"]
        if not vector:
            raise ValueError("the query text could not be encoded")
        near = top_k(base.drop("part"), vector, k, "key").select(F.lit(0).cast("long").alias("query_id"), "key", "score")
    else:
        # Of many stored files some are read first, for a bound on what the others must reach.
        few = F.pmod(F.xxhash64("part"), F.lit(FIRST_TASKS)) == 0
        first = base.where(few) if base.rdd.getNumPartitions() > FIRST_TASKS else None
        near = top_k_batch(base, embed(queries, "text", encoder), k, first=first).drop("rank")
    part = F.substring_index("key", "\u0000", -1)
    source_key = F.expr("substr(key, 1, length(key) - length(part) - 1)")
    return near.withColumn("part", part).withColumn("source_key", source_key).drop("key")


def with_context(hits: DataFrame, store: CorpusStore, n: int, context_top: int | None) -> DataFrame:
    """Add callers and callees, at most n each, to the hits ranked up to context_top
    (all for None). Other hits, and hits without edges, get empty lists."""
    wanted = hits if context_top is None else hits.where(F.col("rank") <= context_top)
    symbols = cut_lineage(wanted.select(F.col("symbol").alias("target")).distinct())
    near = neighbours(store.edges_of("caller", symbols), n, symbols, store.edges_of("callee", symbols))
    empty = F.array().cast("array<string>")
    in_range = F.lit(True) if context_top is None else F.col("rank") <= context_top
    return (
        hits.join(near, hits["symbol"] == near["target"], "left")
        .withColumn("callers", F.when(in_range, F.coalesce("callers", empty)).otherwise(empty))
        .withColumn("callees", F.when(in_range, F.coalesce("callees", empty)).otherwise(empty))
        .drop("target")
    )


def search_display(hits: DataFrame, show_code: bool = False) -> DataFrame:
    """Hits as shown in a result list: clipped names and, if wanted, a code preview."""
    shown = [
        "query_id",
        "rank",
        "score",
        "type",
        t.clip(F.col("symbol"), 55, "None").alias("symbol"),
        t.clip(F.col("file_path"), 40, "-").alias("file_path"),
    ]
    if show_code:
        shown.append(t.code_preview(F.col("code")).alias("preview"))
    shown += [c for c in ("callers", "callees") if c in hits.columns]
    return hits.select(*shown)
