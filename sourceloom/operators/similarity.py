"""Exact top-k by cosine similarity, for one query vector or many.

All forms rank by score, then by key: stored order does not exist in Spark, so ties
are broken explicitly. ``base`` has columns ``key`` and ``embedding``, ``queries`` has
``query_id`` and ``embedding``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sourceloom.functions.vectors import SCORE_GRID, cosine_to, is_valid
from sourceloom.operators.ranking import top_n
from sourceloom.session import cut_lineage

# Bytes of query vectors that travel with a task, and of the hits a task holds for them;
# beyond either both sides are cut in blocks, the queries by the same limits and the base
# by rows and bytes.
QUERY_BYTES = 8 << 20
STATE_BYTES = 512 << 20
HIT_BYTES = 120  # a score, and a key with the pointer to it
FIRST_TASKS = 64  # tasks from which on a first part is worth a pass of its own
BLOCK_ROWS = 65_536
BLOCK_BYTES = 128 << 20
# Rows that one task may hold of all others' best; more are found by a threshold.
TOP_ROWS = 100_000
SCORE_BINS = 1 << 16
# Blocks grow beyond the size asked for, up to the limits above, before a row is copied more often.
BLOCK_COPIES = 8
_TILE_CELLS = 4 << 20
_PAIRS = 1 << 16

# The scorers below travel to the executors as code, so that the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def check_k(k: int) -> None:
    if k < 0:
        raise ValueError("k must not be negative")


def top_k(base: DataFrame, query: Sequence[float], k: int, *tie_break: str) -> DataFrame:
    """The k best rows for one vector, with their score in place of the vector (and of its
    ``norm``, if that is stored beside it).

    The score is a JVM expression and the sort keeps k rows per task. Rows without a
    vector score null and sort last; they are dropped behind the limit, because a filter
    in front would make Spark work out a computed vector twice.
    """
    check_k(k)
    vector = F.col("embedding")
    length = F.col("norm") if "norm" in base.columns else None
    score = F.when(is_valid(vector), cosine_to(vector, query, length))
    scored = base.withColumn("score", score).drop("embedding", "norm")
    if k > TOP_ROWS:
        return _top_many(scored, k, tie_break)
    return scored.orderBy(F.desc("score"), *tie_break).limit(k).where(F.col("score").isNotNull())


def _top_many(scored: DataFrame, k: int, tie_break: Sequence[str]) -> DataFrame:
    """The k best rows where k is too many for one task.

    A histogram of the scores gives a threshold that k rows reach. These are put in order by
    ranges and counted by range, so that a row's place is that of its range and its own in it.
    """
    place = F.least(F.floor((1 - F.col("score")) / 2 * SCORE_BINS), F.lit(SCORE_BINS - 1)).cast("int")
    binned = scored.where(F.col("score").isNotNull()).withColumn("_bin", F.greatest(place, F.lit(0)))
    counts = sorted((r["_bin"], r["count"]) for r in binned.groupBy("_bin").count().collect())
    total, last = 0, -1
    for bin_, n in counts:
        if total >= k:
            break
        total, last = total + n, bin_
    kept = cut_lineage(binned.where(F.col("_bin") <= last).drop("_bin"))
    order = [F.desc("score"), *map(F.col, tie_break)]
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", at))
    before, offsets = 0, []
    for part, n in sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect()):
        offsets.append((part, before))
        before += n
    starts = scored.sparkSession.createDataFrame(offsets, "_part int, _start long")
    best = placed.join(F.broadcast(starts), "_part").where(F.col("_start") + F.col("_at") < k)
    return best.drop("_part", "_at", "_start")


def top_k_batch(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    query_bytes: int = QUERY_BYTES,
    block_rows: int = BLOCK_ROWS,
    first: DataFrame | None = None,
) -> DataFrame:
    """(query_id, key, score, rank) of the k best keys for every query.

    While the query vectors and their hits fit the byte limits, each task scores its rows
    against all of them and passes on k rows per query: the base is read once and never
    shuffled. ``first`` may name a part of the base that is cheap to read: its k-th best score
    is a lower bound for all, and no task passes on rows below it. Larger sets of queries go
    through block_join_top_k. Rows and queries without
    a vector are passed over where vectors are read. ``query_id`` may have any type, but
    each value only once.
    """
    check_k(k)
    # Both paths compute with the same 32-bit vectors; rows without a key cannot be named.
    vector = F.col("embedding").cast("array<float>").alias("embedding")
    base = base.where(F.col("key").isNotNull()).select("key", vector)
    # Read several times, and costly if a model encodes it.
    queries = cut_lineage(queries.select("query_id", vector))
    twice = queries.groupBy("query_id").count().where("count > 1").first()
    if twice:
        raise ValueError(f"query_id {twice['query_id']!r} occurs {twice['count']} times")
    one = queries.select("embedding").where(is_valid(F.col("embedding"))).first()
    width = len(one["embedding"]) if one else 1
    most = max(1, min(query_bytes // (4 * width), STATE_BYTES // (HIT_BYTES * max(k, 1))))
    held = queries.limit(most + 1).toArrow()
    if held.num_rows <= most:
        ids, vectors = _vectors(held, "query_id", width)
        id_type, schema = held.schema.field("query_id").type, _near_schema(base, queries)
        floors = None
        if first is not None and k:
            part = first.where(F.col("key").isNotNull()).select("key", vector)
            least = top_n(part.mapInArrow(_scan_scorer(ids, vectors, k, id_type), schema), ["query_id"], [F.desc("score"), F.col("key")], k)
            of = {r["query_id"]: r["score"] for r in least.where(F.col("rank") == k).collect()}
            floors = np.array([of.get(i, -np.inf) for i in ids])
        near = base.mapInArrow(_scan_scorer(ids, vectors, k, id_type, floors), schema)
    else:
        near = block_join_top_k(base, queries, k, width, block_rows, most)
    return top_n(near, ["query_id"], [F.desc("score"), F.col("key")], k)


def block_count(rows: int, size: int, limit: int) -> int:
    """How many blocks: of ``size`` rows as long as these are few, then of more rows, at most
    ``limit``. Each row is copied once per block of the other side."""
    size = max(size, -(-rows // BLOCK_COPIES))
    return max(1, -(-rows // max(1, min(size, limit))))


def block_join_top_k(
    base: DataFrame, queries: DataFrame, k: int, width: int, base_rows: int, query_rows: int
) -> DataFrame:
    """k candidates per query and pair of blocks, for any number of queries.

    Rows fall into blocks by a hash of their own id, so blocks are even whatever the
    data repeats. Blocks are as large as a task can hold where there are many, so that rows
    are copied and merged seldom. Each block meets each block of the other side once; a pair of blocks
    passes on k rows per query, never its pairs.
    """
    hits = STATE_BYTES // (HIT_BYTES * max(k, 1))
    base_blocks = block_count(base.count(), base_rows, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    query_blocks = block_count(queries.count(), query_rows, min(QUERY_BYTES // (4 * width), hits))

    def block(name: str, n: int):
        return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = base.select("*", block("key", base_blocks).alias("b"), every(query_blocks).alias("q"))
    right = queries.select("*", block("query_id", query_blocks).alias("q"), every(base_blocks).alias("b"))

    def score(base_part: pa.Table, query_part: pa.Table) -> pa.Table:
        best = _Best(*_vectors(query_part, "query_id", width), k)
        best.add(*_vectors(base_part, "key", width))
        return best.table(query_part.schema.field("query_id").type, base_part.schema.field("key").type)

    cells = left.groupBy("b", "q").cogroup(right.groupBy("b", "q"))
    return cells.applyInArrow(score, _near_schema(base, queries))


def _near_schema(base: DataFrame, queries: DataFrame) -> StructType:
    ids = [StructField("query_id", queries.schema["query_id"].dataType), StructField("key", base.schema["key"].dataType)]
    return StructType(ids).add("score", "double")


def _vectors(rows: pa.Table | pa.RecordBatch, id_column: str, width: int) -> tuple[list, np.ndarray]:
    """Ids and vectors as one matrix, without the rows that have no vector; a vector of
    another width fails the job."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(rows["embedding"]), 0))
    if not (lengths > 0).all():
        rows, lengths = rows.filter(pa.array(lengths > 0)), lengths[lengths > 0]
    if (lengths != width).any():
        raise ValueError(f"vector lengths differ: {width} and {lengths[lengths != width][0]}")
    values = np.asarray(pc.list_flatten(rows["embedding"]))
    return rows[id_column].to_pylist(), values.astype(np.float64).reshape(-1, width)


def _scan_scorer(ids: list, vectors: np.ndarray, k: int, id_type: pa.DataType, floors: np.ndarray | None = None):
    width = vectors.shape[1]
    vectors = vectors.astype(np.float32)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key_type = _Best(ids, vectors.astype(np.float64), k, floors), None
        for batch in batches:
            key_type = batch.schema.field("key").type
            best.add(*_vectors(batch, "key", width))
        if key_type is not None:
            yield from best.table(id_type, key_type).to_batches()

    return scan


def _units(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The vectors at length 1, in 32 bits; those without a length stay as they are."""
    return (vectors / np.where(norms > 0, norms, 1.0)[:, None]).astype(np.float32)


def _cosines(dots: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    scores = np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0)
    return np.rint(scores * SCORE_GRID) / SCORE_GRID


class _Best:
    """Running top k of each query over the rows seen so far, as arrays of scores and keys.

    ``floors`` are scores that a row must reach to be kept at all.
    """

    def __init__(self, ids: list, vectors: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norms = np.linalg.norm(vectors, axis=1)
        self.units = _units(vectors, self.norms)
        # What a product of two rounded unit vectors may be off by.
        self.slack = (vectors.shape[1] + 16) * 2.4e-7
        self.floors = np.full(len(ids), -np.inf) if floors is None else floors
        none = np.zeros(0)
        self.scores: list[np.ndarray] = [none] * len(ids)
        self.keys: list[np.ndarray] = [none.astype(object)] * len(ids)

    def add(self, keys: list, rows: np.ndarray) -> None:
        if not keys or self.k == 0:
            return
        # In key order, the earlier of two tied rows is the one to keep.
        order = sorted(range(len(keys)), key=keys.__getitem__)
        rows, named = rows[order], np.empty(len(keys), dtype=object)
        named[:] = [keys[i] for i in order]
        norms = np.linalg.norm(rows, axis=1)
        units = _units(rows, norms) if np.isfinite(norms).all() and np.isfinite(self.norms).all() else None
        step = max(1, _TILE_CELLS // len(keys))
        for start in range(0, len(self.ids), step):
            if units is not None:
                self._add_near(slice(start, start + step), rows, norms, units, named)
                continue
            tile = slice(start, start + step)
            scores = _cosines(self.vectors[tile] @ rows.T, np.outer(self.norms[tile], norms))
            for i, line in enumerate(scores, start):
                self._merge(i, line, named)

    def _add_near(self, tile: slice, rows: np.ndarray, norms: np.ndarray, units: np.ndarray, named: np.ndarray) -> None:
        """Products of 32-bit unit vectors tell which rows can be among the best of a query; these
        alone are scored in 64 bits."""
        near = self.units[tile] @ units.T
        have = self.scores[tile]
        least = np.array([max(f, s[-1]) if len(s) == self.k else f for f, s in zip(self.floors[tile], have)])
        if len(named) > self.k:
            open_ = np.flatnonzero([len(s) < self.k for s in have])
            at = len(named) - self.k
            if len(open_):
                reached = np.partition(near[open_], at, axis=1)[:, at]
                least[open_] = np.maximum(least[open_], reached - self.slack)
        hit = near >= (least - self.slack - 2 / SCORE_GRID).astype(np.float32)[:, None]
        # Where many rows are near, as with copies, all are scored at once.
        for i in np.flatnonzero(np.count_nonzero(hit, axis=1) > len(named) // 32):
            q = tile.start + i
            self._merge(q, _cosines(rows @ self.vectors[q], self.norms[q] * norms), named)
            hit[i] = False
        of, found = np.nonzero(hit)
        scores = np.empty(len(of))
        for start in range(0, len(of), _PAIRS):
            some = slice(start, start + _PAIRS)
            q, r = of[some] + tile.start, found[some]
            scores[some] = _cosines(np.einsum("ij,ij->i", self.vectors[q], rows[r]), self.norms[q] * norms[r])
        ends = np.searchsorted(of, np.arange(len(have) + 1))
        for i in np.unique(of):
            some = slice(ends[i], ends[i + 1])
            self._merge(tile.start + i, scores[some], named[found[some]])

    def _merge(self, i: int, scores: np.ndarray, keys: np.ndarray) -> None:
        have, k, floor = self.scores[i], self.k, self.floors[i]
        if len(have) == k:
            floor = max(floor, have[-1])
        elif len(scores) > k:
            floor = max(floor, np.partition(scores, len(scores) - k)[len(scores) - k])
        found = np.flatnonzero(scores >= floor)
        if len(found) > k:
            found = found[np.argsort(-scores[found], kind="stable")[:k]]
        if not len(found):
            return
        both, names = np.concatenate([have, scores[found]]), np.concatenate([self.keys[i], keys[found]])
        order = np.argsort(-both, kind="stable")
        if len(have) and (np.diff(both[order]) == 0).any():  # ties go by key
            order = np.array(sorted(range(len(both)), key=lambda j: (-both[j], names[j])))
        self.scores[i], self.keys[i] = both[order[:k]], names[order[:k]]

    def table(self, id_type: pa.DataType, key_type: pa.DataType) -> pa.Table:
        sizes = np.array([len(s) for s in self.scores], dtype=np.int64)
        number = np.repeat(np.arange(len(self.ids)), sizes)
        return pa.table(
            {
                "query_id": pa.array(self.ids, id_type).take(pa.array(number)),
                "key": pa.array([key for keys in self.keys for key in keys], key_type),
                "score": pa.array(np.concatenate([np.zeros(0), *self.scores]), pa.float64()),
            }
        )
