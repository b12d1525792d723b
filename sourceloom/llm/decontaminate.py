"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ten consecutive words of a benchmark item, or the whole item if it
is shorter. A table of two-word blocks says how far a position can be skipped; where it
says zero, the windows with this suffix and prefix are compared directly.
"""

from __future__ import annotations

import functools
import itertools
import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import row_key, stored, table, whole_text

WINDOW = 10
PATTERN_BYTES = 8 << 20  # of benchmark text that one search holds
# Lower-cases A-Z and blanks what is no word character.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


class _Tables:
    """Shift and hash tables of the windows of one length."""

    def __init__(self, length: int, size: int):
        self.length, self.size = length, size
        self.block = min(2, length)
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[int, list[tuple]]] = defaultdict(lambda: defaultdict(list))

    def code(self, words, end: int) -> int:
        """The block that ends before ``end``."""
        return words[end - 1] if self.block == 1 else words[end - 2] * self.size + words[end - 1]

    def add(self, window: tuple[int, ...]) -> None:
        for end in range(self.block, self.length + 1):
            code = self.code(window, end)
            self.shift[code] = min(self.shift.get(code, self.length), self.length - end)
        self.buckets[self.code(window, self.length)][self.code(window, self.block)].append(window)

    def search(self, words: list[int]) -> Iterator[tuple[int, tuple]]:
        m, n, size, block = self.length, len(words), self.size, self.block
        far = m - block + 1
        shift, end = self.shift, m
        while end <= n:
            last = words[end - 1]
            if not last:  # in no window at all
                end += m
                continue
            step = shift.get(last if block == 1 else words[end - 2] * size + last, far)
            if step:
                end += step
                continue
            start = end - m
            for window in self.buckets[self.code(words, end)].get(self.code(words, start + block), ()):
                if all(words[start + j] == window[j] for j in range(m)):
                    yield start, window
            end += 1


class Searcher:
    """Finds the windows of items (item id, text) in texts."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        split = [(item, words_of(text)) for item, text in items]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in split for w in ws}), 1)}
        self.items_of: dict[tuple, set[str]] = defaultdict(set)
        for item, words in split:
            ids = tuple(self.vocabulary[w] for w in words)
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                self.items_of[ids[i : i + m]].add(item)
        self.tables: dict[int, _Tables] = {}
        for found in self.items_of:
            tables = self.tables.setdefault(len(found), _Tables(len(found), len(self.vocabulary) + 1))
            tables.add(found)

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, merged hit ranges of words (end exclusive), and items found."""
        words = words_of(text)
        get = self.vocabulary.get
        ids = [get(w, 0) for w in words]
        ranges, items = [], set()
        for tables in self.tables.values():
            for start, window in tables.search(ids):
                ranges.append((start, start + tables.length))
                items |= self.items_of[window]
        merged: list[tuple[int, int]] = []
        for start, end in sorted(ranges):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        return len(words), merged, sorted(items)

    def clean(self, text: str | None) -> bool:
        return not self.hits(text)[1]


class _Shard:
    """A broadcast part of the items with an id to keep its searcher by."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


_SEARCHERS: dict[tuple, Searcher] = {}


def _searcher(shared, window: int) -> Searcher:
    """The worker's searcher; one is kept, as a worker meets one shard at a time."""
    if (shared.id, window) not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[shared.id, window] = Searcher(shared.value, window)
    return _SEARCHERS[shared.id, window]


def pattern_shards(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", shard_bytes: int = PATTERN_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items in parts of about ``shard_bytes``, so that none grows with the benchmark."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), whole_text(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, math.ceil(total / shard_bytes))
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) if n > 1 else items
        yield [(r["item"], r["text"]) for r in part.collect()]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = PATTERN_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, ranges (of hit words), items (ids as strings).

    A null text has no words, and neither have empty items, which are no pattern. Rows
    stay rows; other columns are not looked at. With an empty benchmark nothing is hit.

    While the benchmark fits one search, texts are read once and not moved. A larger one
    is searched for in several passes whose small results are merged per document.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    context = docs.sparkSession.sparkContext
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.to_json(row_key(doc_id, text)).alias("_key"))
    ranges = "array<struct<start:int,end:int>>"

    def one_pass(rows: DataFrame, columns: list[str], schema: str, items: list) -> DataFrame:
        shared = _Shard(context.broadcast(items))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            searcher = _searcher(shared, window)
            for frame in frames:
                found = [searcher.hits(t) for t in frame["text"]]
                out = frame[columns].copy()
                out["n_words"] = [n for n, _, _ in found]
                out["ranges"] = [[{"start": s, "end": e} for s, e in r] for _, r, _ in found]
                out["items"] = [i for _, _, i in found]
                yield out

        return rows.select(*columns, "text").mapInPandas(run, f"{schema}, n_words long, ranges {ranges}, items array<string>")

    shards = pattern_shards(benchmark, item_id, item_text, shard_bytes)
    first = next(shards)
    second = next(shards, None)
    if second is None:
        return one_pass(keyed, ["doc_id"], f"doc_id {kind}", first)
    # One part of the benchmark at a time: its hits are written before the next is fetched.
    passes = [stored(one_pass(keyed, ["_key"], "_key string", s), "hits") for s in itertools.chain([first, second], shards)]
    flat = functools.reduce(DataFrame.unionByName, passes)

    def step(state, r):
        last = F.try_element_at(state, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        shorter = F.slice(state, F.lit(1), F.greatest(F.size(state) - 1, F.lit(0)))
        return F.when(last["end"] >= r["start"], F.concat(shorter, F.array(longer))).otherwise(F.concat(state, F.array(r)))

    merged = flat.groupBy("_key").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("ranges"))).alias("_ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    merged = merged.select("_key", "n_words", F.aggregate("_ranges", F.array().cast(ranges), step).alias("ranges"), "items")
    return keyed.select("doc_id", "_key").join(merged, "_key").select("doc_id", "n_words", "ranges", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = PATTERN_BYTES) -> DataFrame:
    """The rows of ``docs``, with all columns, in whose text no window of the benchmark occurs.

    Null texts have no words and stay.
    """
    context = docs.sparkSession.sparkContext
    shards = pattern_shards(benchmark, item_id, item_text, shard_bytes)
    first = next(shards)
    second = next(shards, None)

    def kept(shared: _Shard, batches: Iterator[pa.RecordBatch], clean: bool) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(shared, window)
        for batch in batches:
            told = [searcher.clean(t) is clean for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(told, pa.bool_()))

    if second is None:
        shared = _Shard(context.broadcast(first))
        return docs.mapInArrow(lambda batches: kept(shared, batches, True), docs.schema)
    # Of more parts, each writes the keys of the texts it finds before the next is fetched.
    found = []
    rows = docs.select(docs[text].cast("string").alias(text))
    for items in itertools.chain([first, second], shards):
        shared = _Shard(context.broadcast(items))
        hit = rows.mapInArrow(lambda batches, shared=shared: kept(shared, batches, False), rows.schema)
        found.append(stored(hit.select(F.sha2(F.col(text), 256).alias("_hit")).distinct(), "hits"))
    hits = functools.reduce(DataFrame.unionByName, found).distinct()
    return docs.join(hits, F.sha2(docs[text].cast("string"), 256) == hits["_hit"], "left_anti")


def op9_benchmark_windows(spark, sf_dir):
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("ranges", F.lit(0), lambda n, r: n + r["end"] - r["start"]).cast("long")
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM bw WHERE len(w) > 0)
), dn AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM dw, (SELECT DISTINCT m FROM iw))
), hit AS (
  SELECT doc_id, dn.m, i, item_id FROM dn JOIN iw ON dn.m = iw.m AND dn.win = iw.win
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM hit)) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
