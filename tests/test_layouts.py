"""Stored layouts: edges in two orders, hits that know their file; what is not hit is not opened."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import sourceloom as sl
from sourceloom.functions.vectors import norm
from sourceloom.operators.graph import neighbours
from sourceloom.plans import search as search_plan
from sourceloom.sources import store as store_module

RUN = {"discovered": 0, "skipped": 0, "processed": 0, "full_rescan": 0, "encoder": "hashing-64", "dim": 64, "state": 0, "state_rows": 0, "state_bytes": 0, "delta_rows": 0, "removed": 0}


@pytest.fixture
def graph_store(spark, tmp_path, monkeypatch):
    """Two runs of edges in many small files."""
    monkeypatch.setattr(store_module, "EDGE_FILE_ROWS", 40)
    rng = random.Random(3)
    store, edges = sl.CorpusStore(spark, str(tmp_path / "store")), []
    for run in (1, 2):
        some = {(f"m{rng.randint(0, 3000):04d}", f"m{rng.randint(0, 3000):04d}") for _ in range(2500)} - set(edges)
        store.write_edges(run, spark.createDataFrame(sorted(some), "caller string, callee string"))
        store.commit(run, **RUN)
        edges += sorted(some)
    return store, edges


def names_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "target string")


def remove_others(store, table, parts):
    gone = 0
    for path in Path(store.path(table)).rglob("part-*.parquet"):
        if path.name not in parts:
            os.remove(path)
            gone += 1
    return gone


@pytest.mark.parametrize("side", ["caller", "callee"])
def test_many_names_open_their_files_only(spark, graph_store, side):
    store, edges = graph_store
    names = [f"m{i:04d}" for i in range(1000, 1300)] + [None, "zzz", ""]
    got = store.edges_of(side, names_of(spark, names))
    parts = store._parts(side, names_of(spark, names))
    table = store_module.SIDES[side]
    total = sum(1 for _ in Path(store.path(table)).rglob("part-*.parquet"))
    assert 0 < len(parts) < total / 3
    assert remove_others(store, table, parts) == total - len(parts)  # reading them would fail
    at = 0 if side == "caller" else 1
    found = {tuple(r) for r in got.collect()}
    assert {e for e in found if e[at] in names} == {e for e in edges if e[at] in names}


@pytest.mark.parametrize("n_targets", [3, 300])
def test_neighbours_of_a_stored_graph(spark, graph_store, n_targets):
    store, edges = graph_store
    targets = names_of(spark, [f"m{i:04d}" for i in range(0, 3000, 3000 // n_targets)])
    plain = neighbours(spark.createDataFrame(edges, "caller string, callee string"), 4, targets)
    stored = neighbours(store.edges_of("caller", targets), 4, targets, store.edges_of("callee", targets))
    rows = sorted(map(tuple, stored.collect()))
    assert rows == sorted(map(tuple, plain.collect())) and rows


def test_too_many_files_or_old_runs_are_read_whole(spark, graph_store, monkeypatch):
    store, edges = graph_store
    names = names_of(spark, [f"m{i:04d}" for i in range(0, 3000, 10)])
    monkeypatch.setattr(store_module, "LISTED_PARTS", 3)
    assert store._parts("caller", names) is None and store.edges_of("caller", names).count() == len(edges)
    old = store.read_run("runs", 1).withColumn("state", F.lit(None).cast("int")).collect()
    spark.createDataFrame(old, store.read_run("runs", 1).schema).write.mode("overwrite").parquet(store.run_path("runs", 1))
    assert store._parts("caller", names) is None and store.edges_of("callee", names).count() == len(edges)


def test_hits_open_their_files_only(spark, tmp_path, monkeypatch):
    store = sl.CorpusStore(spark, str(tmp_path / "store"))
    rows = [(f"/{i}.java", bytearray(f"class Word{i % 12}x {{ int topic{i % 12}; }}".encode())) for i in range(240)]
    files = spark.createDataFrame(rows, "file_path string, content binary").repartitionByRange(12, F.substring_index("file_path", "x", 1))
    sl.index_files(files, store)
    queries = spark.createDataFrame([(i, f"Word{i}x topic{i}") for i in (3, 4)], "query_id long, text string")
    want = sorted((r.query_id, r.rank, r.symbol, r.file_path, r.code) for r in sl.search(store, queries, k=4).collect())
    real = search_plan.few_values
    asked = []

    def only_parts(rows, column, *limit):
        found = real(rows, column, *limit) if column == "part" else None
        asked.append(found)
        return found

    monkeypatch.setattr(search_plan, "few_values", only_parts)
    hits = sl.search(store, queries, k=4)
    parts = set(asked[-1])
    total = sum(1 for _ in Path(store.path("sources")).rglob("part-*.parquet"))
    assert 0 < len(parts) < total and remove_others(store, "sources", parts) == total - len(parts)
    assert sorted((r.query_id, r.rank, r.symbol, r.file_path, r.code) for r in hits.collect()) == want


def test_stored_norms_and_reasons(spark, tmp_path):
    def load():
        def model(texts):
            if any("fail" in t for t in texts):
                raise RuntimeError("no such word")
            return [[float(len(t)), 2.0] for t in texts]

        return model

    store = sl.CorpusStore(spark, str(tmp_path / "store"))
    rows = [("/a.java", bytearray(b"class A { }")), ("/b.java", bytearray(b"class fail { }")), ("/c.java", bytearray(b"// none"))]
    files = spark.createDataFrame(rows, "file_path string, content binary")
    for distinct in (False, True):
        sl.index_files(files, store, sl.ModelEncoder("stub", 2, load), distinct_texts=distinct, full_rescan=True)
    assert [(r.run, r.symbol, r.error) for r in store.index_errors().orderBy("run").collect()] == [(n, "fail", "RuntimeError: no such word") for n in (1, 2)]
    told = store.sources().select("file_path", "norm", norm(F.col("embedding")).alias("want"), "error").collect()
    assert all(r.norm == r.want and (r.norm is not None) == (r.file_path == "/a.java") for r in told)
    assert {r.error for r in told if r.file_path != "/b.java"} == {None}
