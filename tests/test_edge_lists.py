"""Edges of a first run: lists of files of their own names, distinct edges of shared ones."""

import random
from pathlib import Path

import sourceloom as sl
from sourceloom.operators.fragments import call_edges_of, edge_lists_of, split_by_sharing
from sourceloom.sources import store as store_module


def some_sources(spark):
    rng, rows = random.Random(5), []
    for i in range(120):
        package = rng.choice([None, "a", "a.b", "a.b.C"])
        classes = rng.choice([[], ["C"], [f"D{i}"], [f"E{i}", "C"]])
        methods = [rng.choice("mnopqrs") for _ in range(rng.randint(0, 6))]
        calls = [rng.choice(methods) for _ in range(rng.randint(0, 6))] if methods else []
        rows.append((package, classes, methods, calls))
    rows += [rows[0], rows[1]] * 3
    return spark.createDataFrame(rows, "package string, classes array<string>, methods array<string>, calls array<string>")


def test_lists_of_unshared_files_are_distinct_edges(spark):
    sources = some_sources(spark)
    alone, shared = split_by_sharing(sources)
    assert alone.count() and shared.count()
    for side in ("caller", "callee"):
        lists = edge_lists_of(alone, side)
        assert lists.count() == lists.select(side).distinct().count()
    assert call_edges_of(alone).join(call_edges_of(shared), "caller", "left_semi").isEmpty()


def test_stored_edges_of_a_first_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "EDGE_FILE_ROWS", 20)
    sources, store = some_sources(spark), sl.CorpusStore(spark, str(tmp_path / "store"))
    store.write_edges_of(1, sources)
    want = sorted(map(tuple, call_edges_of(sources).collect()))
    for side, table in store_module.SIDES.items():
        assert sorted((r.caller, r.callee) for r in store.read_run(table, 1).collect()) == want
        held = sorted((r.low, r.high, r.part) for r in store.read_run("edge_files", 1).collect() if r.side == side)
        assert len(held) > 3 and all(a[1] <= b[0] for a, b in zip(held, held[1:]))
        parts = {p.name for p in Path(store.run_path(table, 1)).glob("part-*.parquet")}
        assert {p for *_, p in held} == parts


def test_edges_of_unshared_files_move_as_lists(spark, tmp_path, monkeypatch):
    moved = []
    real = store_module.edge_lists_of
    monkeypatch.setattr(store_module, "edge_lists_of", lambda files, side: moved.append(side) or real(files, side))
    code = "package p; class K%d { public void a() { b(); c(); } public void b() { a(); } public void c() { } }"
    rows = [(f"/{i}.java", bytearray((code % (i // 2 if i < 4 else i)).encode())) for i in range(12)]
    store = sl.CorpusStore(spark, str(tmp_path / "store"))
    sl.index_files(spark.createDataFrame(rows, "file_path string, content binary"), store)
    assert moved == ["caller", "callee"]
    names = {"a": "bc", "b": "ac", "c": "ab"}
    want = {(f"p.K{k}.{m}", f"p.K{k}.{o}") for k in {0, 1, *range(4, 12)} for m, others in names.items() for o in others}
    got = [tuple(r) for r in store.call_edges().collect()]
    assert len(got) == len(set(got)) and set(got) == want


def edges_of_runs(spark, path, *runs, **options):
    store = sl.CorpusStore(spark, str(path))
    for i, files in enumerate(runs):
        rows = [(f"/{name}.java", bytearray(code.encode())) for name, code in files.items()]
        more = {k: v[i] for k, v in options.items()}
        sl.index_files(spark.createDataFrame(rows, "file_path string, content binary"), store, **more)
    return store, sorted((r.run, r.caller, r.callee) for r in store._all("call_edges").collect())


A = "class A { public void f() { g(); } public void g() { } }"
B = "class A { public void g() { } public void f() { g(); f(); } }"


def test_files_of_known_names_are_not_opened_up(spark, tmp_path, monkeypatch):
    from sourceloom.plans import index

    seen = []
    real = index.new_edges
    monkeypatch.setattr(index, "new_edges", lambda existing, found: seen.append(found.count()) or real(existing, found))
    first = {"a": A, "x": "class X { public void h() { i(); } public void i() { } }"}
    second = {**first, "a": "// edited\n" + B, "n": A.replace("class A", "class N"), "k": "class K { }"}
    _, edges = edges_of_runs(spark, tmp_path / "s", first, second, second, full_rescan=[False, False, True])
    assert seen == [2, 0]  # of the new file alone; both directions, as a declaration reads like a call
    one = [(1, "A.f", "A.g"), (1, "A.g", "A.f"), (1, "X.h", "X.i"), (1, "X.i", "X.h")]
    assert edges == one + [(2, "N.f", "N.g"), (2, "N.g", "N.f")]


def test_edges_of_runs_without_a_graph_come_later(spark, tmp_path):
    _, edges = edges_of_runs(spark, tmp_path / "s", {"a": A}, {"a": A}, with_graph=[False, True], full_rescan=[False, True])
    assert edges == [(2, "A.f", "A.g"), (2, "A.g", "A.f")]


def test_edges_are_found_again_once_files_were_taken_back(spark, tmp_path):
    store, _ = edges_of_runs(spark, tmp_path / "s", {"a": A}, {"b": "class B { }"}, {"c": A}, replace=[False, True, False])
    assert sorted(map(tuple, store.call_edges().collect())) == [("A.f", "A.g"), ("A.g", "A.f")]
