import pytest
from pyspark.sql import functions as F

import sourceloom as sl
from sourceloom.plans import search as search_plan
from sourceloom.schemas import SOURCES
from sourceloom.sources.files import any_case_glob, files_from_table, scan_files
from tests.conftest import plan_of
from tests.test_encoder import load_stub
from tests.test_java import FOO, N


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "src"
    (root / "a b" / "deep").mkdir(parents=True)
    (root / "a b" / "deep" / "Foo.JAVA").write_text("/* Licensed to X */\n" + FOO)
    (root / "N.java").write_text(N)
    (root / "[x]{y}.java").write_text("class Odd { }")
    (root / "Blank.java").write_text("\n")
    (root / "readme.txt").write_text("class NotJava { }")
    return root


@pytest.fixture
def store(spark, tmp_path):
    return sl.CorpusStore(spark, str(tmp_path / "store"))


def last(store):
    row = store.runs().orderBy(F.desc("run")).first()
    return row.discovered, row.skipped, row.processed


def test_scan(spark, folder):
    assert any_case_glob(".java") == "*.[jJ][aA][vV][aA]"
    got = {r.file_path.removeprefix(str(folder)) for r in scan_files(spark, str(folder)).collect()}
    assert got == {"/a b/deep/Foo.JAVA", "/N.java", "/[x]{y}.java", "/Blank.java"}


def test_incremental_runs(store, folder):
    assert sl.index_folder(store, str(folder)) == 1
    assert last(store) == (4, 0, 4)
    first = store.fragments().count()
    assert first == 3 + 3 + 1
    assert sl.index_folder(store, str(folder)) == 2
    assert last(store) == (4, 4, 0) and store.fragments().count() == first
    edges = store.call_edges().count()

    (folder / "N.java").write_text(N.replace("a()", "z()"))
    (folder / "Blank.java").unlink()
    (folder / "Copy.java").write_text("class Odd { }")
    sl.index_folder(store, str(folder))
    assert last(store) == (4, 2, 2)
    assert store.fragments().count() == first + 3 + 1
    assert store.fragments(latest_only=True).count() == first + 1
    assert store.call_edges().count() == edges + 3
    assert store.call_edges().distinct().count() == edges + 3
    hashes = store.file_hashes()
    assert hashes.count() == 5 and hashes.select("file_path").distinct().count() == 5

    sl.index_folder(store, str(folder), full_rescan=True)
    assert last(store) == (4, 0, 4)
    assert store.fragments().count() == first + 4 + (first + 1)
    assert store.call_edges().count() == edges + 3
    assert [r.symbol for r in sl.index_preview(store).collect()] == [
        r.symbol for r in store.fragments().orderBy("file_path", "type", "symbol").limit(25).collect()
    ]
    metrics = {r.metric: r.value for r in sl.index_summary(store).collect()}
    assert metrics["calls"] == edges + 3 and metrics["processed"] == 4
    assert metrics["fragments"] == store.fragments().count()
    assert metrics["methods"] == store.methods().count()


def test_unfinished_run_is_invisible_and_replaced(store, folder):
    sl.index_folder(store, str(folder))
    before = store.fragments().count()
    left_over = store.sources().drop("run").withColumn("file_path", F.concat(F.lit("half"), "file_path"))
    store.write_run("sources", 2, left_over)
    assert store.fragments().count() == before
    (folder / "New.java").write_text("class New { }")
    assert sl.index_folder(store, str(folder)) == 2
    assert store.fragments().count() == before + 1


def test_failed_encodings_are_reported_and_skipped(store, folder):
    (folder / "Bad.java").write_text("class bad { public void f() { g(); } public void g() { } }")
    sl.index_folder(store, str(folder), sl.ModelEncoder("stub", 2, load_stub))
    assert store.fragments().count() == 7
    errors = {(r.type, r.symbol) for r in store.index_errors().collect()}
    assert errors == {("class", "bad"), ("method", "bad.f"), ("method", "bad.g")}
    assert {tuple(r) for r in store.call_edges().collect()} >= {("bad.f", "bad.g"), ("bad.g", "bad.f")}
    with pytest.raises(ValueError, match="encoded with"):
        sl.search(store, "x")


def test_copies_are_encoded_once(store, folder):
    (folder / "Copy1.java").write_text(N)
    (folder / "Copy2.java").write_text(N)
    sl.index_folder(store, str(folder), sl.ModelEncoder("stub", 2, load_stub), distinct_texts=True)
    assert store.fragments().count() == 7 + 6 and last(store) == (6, 0, 6)
    rows = store.searchable().select("code", "embedding").collect()
    assert all(r.embedding == [float(len(r.code)), 1.0] for r in rows)


def test_without_graph(store, folder):
    sl.index_folder(store, str(folder), with_graph=False)
    assert store.call_edges().count() == 0 and store.fragments().count() == 7


def test_search_and_report(spark, store, folder):
    sl.index_folder(store, str(folder))
    hits = sl.search(store, "help run foo", k=3, with_graph=True)
    rows = hits.orderBy("rank").collect()
    assert [(r.rank, r.type, r.symbol) for r in rows] == [
        (1, "class", "a.b.Foo"), (2, "method", "a.b.Foo.Foo"), (3, "method", "a.b.Foo.run"),
    ]
    assert rows[0].code == FOO and rows[0].callers == [] and rows[2].callees == ["a.b.Foo.Foo"]
    assert rows[0].score == rows[2].score > 0.3

    texts = spark.createDataFrame([(1, "help run foo"), (2, "tostring b")], "query_id long, text string")
    batch = sl.search(store, texts, k=100).collect()
    assert sorted({(r.query_id, r.rank) for r in batch}) == [(q, r) for q in (1, 2) for r in range(1, 8)]
    assert [(r.symbol, r.score) for r in sorted(batch, key=lambda r: r.rank) if r.query_id == 1][:3] == [
        (r.symbol, r.score) for r in rows
    ]
    assert sl.search(store, "x", k=0).count() == 0
    with pytest.raises(ValueError):
        sl.search(store, "x", k=-1)

    report = sl.report(store, texts, k=2)
    assert report.columns == ["query_id", "rank", "score", "title", "meta", "snippet", "graph"]
    first = report.where("query_id = 1 and rank = 2").first()
    assert first.title == "method · a.b.Foo.Foo" and "--&gt; target" in first.graph
    assert sl.report(store, texts, k=2, with_graph=False).where("graph is not null").count() == 0
    out = str(folder.parent / "report")
    sl.write_report(report, out)
    assert spark.read.parquet(out).count() == 4

    shown = sl.search_display(hits, show_code=True).orderBy("rank").first()
    assert shown.preview.endswith("\n...") and len(shown.preview.splitlines()) == 9


def test_only_hit_files_meet_many_hits(spark, store, folder, monkeypatch):
    sl.index_folder(store, str(folder))
    texts = spark.createDataFrame([(1, "help run foo"), (2, "tostring b")], "query_id long, text string")
    few = sl.search(store, texts, k=2, with_graph=True)
    monkeypatch.setattr(search_plan, "HIT_ROWS", 0)
    monkeypatch.setattr(search_plan, "few_values", lambda *_: None)
    many = sl.search(store, texts, k=2, with_graph=True)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert "BroadcastHashJoin LeftSemi" in plan_of(many) and "LeftSemi" not in plan_of(few)


def test_search_context_covers_the_first_five(store, tmp_path, spark):
    code = "".join(f"public void m{i}() {{ }}\n" for i in range(8))
    files = spark.createDataFrame([("/M.java", bytearray(code.encode()))], "file_path string, content binary")
    sl.index_files(files, store)
    rows = sl.search(store, "m1", k=8, with_graph=True).orderBy("rank").collect()
    assert [len(r.callers) for r in rows] == [7] * 5 + [0] * 3


def test_empty_store(store):
    assert sl.search(store, "anything", with_graph=True).count() == 0
    assert sl.index_preview(store).count() == 0
    assert sl.reset(store).collect() == [("fragments", 0), ("file_hashes", 0)]


def test_reset(store, folder):
    sl.index_folder(store, str(folder))
    assert {tuple(r) for r in sl.reset(store).collect()} == {("fragments", 7), ("file_hashes", 4)}
    assert store.fragments().count() == store.call_edges().count() == store.last_run() == 0
    sl.index_folder(store, str(folder))
    assert last(store) == (4, 0, 4) and store.fragments().count() == 7


def test_stream(store, folder, tmp_path):
    def run():
        query = sl.index_stream(store, str(folder), str(tmp_path / "checkpoint"), max_files_per_batch=2)
        query.awaitTermination()

    run()
    assert store.fragments().count() == 7 and store.last_run() == 2
    (folder / "More.java").write_text("class More { }")
    run()
    assert store.fragments().count() == 8 and last(store) == (1, 0, 1)
    sl.index_folder(store, str(folder))
    assert last(store) == (5, 5, 0)


def test_files_from_table(spark):
    table = spark.createDataFrame([("A.java", "class A"), ("b.py", "x"), (None, "y")], "p string, t string")
    rows = files_from_table(table, F.col("p"), F.col("t")).collect()
    assert [(r.file_path, bytes(r.content)) for r in rows] == [("A.java", b"class A")]


def test_stored_plans_prune_and_push_down(store, folder):
    sl.index_folder(store, str(folder))
    base = plan_of(store.searchable().select("source_key", "embedding"))
    assert "GreaterThan(n_fragments,0)" in base and "code" not in base.split("ReadSchema")[1].split("\n")[0]
    edges = plan_of(store.call_edges().where("callee = 'a'"))
    assert "EqualTo(callee,a)" in edges
    assert [f.name for f in SOURCES.fields] == store.sources().columns


def test_each_expression_runs_once_per_file(spark):
    from sourceloom.operators.incremental import with_hash
    from sourceloom.plans.index import source_rows

    files = spark.createDataFrame([("/A.java", b"class A")], "file_path string, content binary")
    frame = source_rows(with_hash(files), sl.HashingEncoder())
    with_strings = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "extended")
    plan = with_strings.split("== Physical Plan ==")[1]
    for part in ("sort_array(", "(?:public|protected", "md5(content", "array_except("):
        assert plan.count(part) == 1, part
    assert "Exchange" not in plan and "Python" not in plan
