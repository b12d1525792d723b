"""The compacted hash state, and change detection beside a large one."""

import random
import re

import pytest
from pyspark.sql import functions as F

import sourceloom as sl
from sourceloom.operators import keyfilter
from sourceloom.operators.incremental import changed_files
from sourceloom.sources import store as store_module
from tests.conftest import plan_of


def as_files(spark, contents):
    rows = [(p, bytearray(c.encode())) for p, c in contents.items()]
    return spark.createDataFrame(rows, "file_path string, content binary")


@pytest.mark.parametrize("compact_at", [0.0, 0.25, 100.0])
def test_hashes_after_many_runs(spark, tmp_path, monkeypatch, compact_at):
    """As one dictionary of the last contents, whenever versions are written."""
    monkeypatch.setattr(store_module, "COMPACT_AT", compact_at)
    rng = random.Random(1)
    store, contents, versions = sl.CorpusStore(spark, str(tmp_path / "store")), {}, set()
    for run in range(6):
        for _ in range(rng.randint(1, 6)):
            contents[f"/{rng.randint(0, 9)}.java"] = f"class A{rng.randint(0, 10**6)} {{ }}"
        sl.index_files(as_files(spark, contents), store, with_graph=False, full_rescan=run == 3)
        want = {r.file_path: r.hash for r in as_files(spark, contents).select("file_path", F.md5("content").alias("hash")).collect()}
        assert {r.file_path: r.hash for r in store.file_hashes().collect()} == want
        versions.add(store.state().version)
        last = store.runs().where(F.col("run") == run + 1).first()
        assert last.discovered == len(contents) and last.skipped + last.processed == len(contents)
    assert len(versions) == {0.0: 6, 0.25: len(versions), 100.0: 2}[compact_at] and len(versions) > 1


def test_a_run_reads_the_state_and_its_delta_only(spark, tmp_path):
    store = sl.CorpusStore(spark, str(tmp_path / "store"))
    contents = {f"/{i}.java": f"class A{i} {{ }}" for i in range(40)}
    for i in range(3):
        contents["/0.java"] = f"class B{i} {{ }}"
        sl.index_files(as_files(spark, contents), store, with_graph=False)
    state = store.state()
    assert (state.version, state.rows, state.delta_rows) == (1, 40, 2)
    plan = re.sub(r"#\d+", "", plan_of(store.file_hashes()))
    filters = re.findall(r"PartitionFilters: (.*)", plan)
    assert "(v = 1)" in filters[0] and all("(run > 1)" in f for f in filters[1:]) and len(filters) >= 2
    # Nothing was added since: the state alone, without grouping or joining.
    clean = store.compacted()
    monkey = store_module.HashState(clean.version, clean.rows, clean.bytes, 0)
    plan = plan_of(store.file_hashes(monkey))
    assert "Aggregate" not in plan and "Join" not in plan and "sources" not in plan


def test_an_unfinished_version_does_not_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "COMPACT_AT", 0.0)
    store = sl.CorpusStore(spark, str(tmp_path / "store"))
    sl.index_files(as_files(spark, {"/a.java": "class A { }"}), store)
    assert store.compacted().version == 1 and store.state().version == 0  # written, not committed
    assert store.file_hashes().count() == 1
    sl.index_files(as_files(spark, {"/a.java": "class A { }", "/b.java": "class B { }"}), store)
    assert store.state().version == 1 and store.file_hashes().count() == 2
    sl.reset(store)
    assert store.file_hashes().count() == 0 and store.state() == store_module.HashState()


def test_logs_without_a_state(spark, tmp_path):
    """Stores written before there was a hash state go on."""
    store = sl.CorpusStore(spark, str(tmp_path / "store"))
    sl.index_files(as_files(spark, {"/a.java": "class A { }"}), store)
    old = store.read_run("runs", 1).drop("state", "state_rows", "state_bytes", "delta_rows", "removed").collect()
    spark.createDataFrame(old, "discovered long, skipped long, processed long, full_rescan int, encoder string, dim int").write.mode("overwrite").parquet(store.run_path("runs", 1))
    assert store.state() == store_module.HashState(delta_rows=1)
    sl.index_files(as_files(spark, {"/a.java": "class A { }", "/b.java": "class B { }"}), store)
    assert store.file_hashes().count() == 2 and store.state().version == 1


def large_scan(spark, n=4000, changed=600):
    files = spark.range(n).select(F.concat(F.lit("/f"), "id").alias("file_path"), F.concat(F.lit("h"), "id").alias("hash"), F.repeat(F.lit("x"), 500).cast("binary").alias("content"))
    state = files.where(F.col("file_path").substr(3, 9).cast("int") >= changed).select("file_path", "hash")
    return files, state


def test_unchanged_contents_never_move(spark):
    """Beside a large state and many changes, a filter in the scan drops the rest."""
    files, state = large_scan(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = changed_files(files, state, broadcast_rows=100, small=False)
        assert got.count() == 600 and got.columns == files.columns
        plan = plan_of(got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = plan.split("(1)")[0]
    # Contents meet the filter first; what is left of them is shuffled.
    assert tree.index("SortMergeJoin LeftSemi") < tree.index("Exchange") < tree.index("BroadcastHashJoin LeftSemi")
    assert "_bits" in plan
    keys = state.sparkSession.createDataFrame(got.select("file_path", "hash").collect(), "file_path string, hash string")
    passed = keyfilter.might_match(files, keys, ["file_path", "hash"], 600)
    assert 600 <= passed.count() < 600 + 0.15 * 3400


@pytest.mark.parametrize("slots", [1, 64, 1 << 20])
def test_a_full_filter_changes_no_result(spark, monkeypatch, slots):
    monkeypatch.setattr(keyfilter, "slots_for", lambda n: slots)
    files, state = large_scan(spark)
    want = {r.file_path for r in files.join(state, ["file_path", "hash"], "left_anti").collect()}
    assert {r.file_path for r in changed_files(files, state, broadcast_rows=0, small=False).collect()} == want


def test_null_keys_pass_the_filter(spark):
    files = spark.createDataFrame([("a", None, b"x"), (None, "1", b"y"), ("b", "2", b"z")], "file_path string, hash string, content binary")
    state = files.where("hash = '2'").select("file_path", "hash")
    passed = keyfilter.might_match(files, files, ["file_path", "hash"], 3)
    assert passed.count() == 3 and state.count() == 1


def test_replaced_and_deleted_paths_vanish(spark, tmp_path):
    """From search, fragments, hashes and graph; what is left is what one run would give."""

    def code(name, call):
        return f"class {name} {{ public void run() {{ {call}(); }} public void {call}() {{ }} }}"

    first = {"/a.java": code("A", "alpha"), "/b.java": code("B", "beta"), "/c.java": code("C", "gamma")}
    second = {"/a.java": code("A", "delta"), "/b.java": first["/b.java"], "/d.java": code("D", "alpha")}
    store, fresh = (sl.CorpusStore(spark, str(tmp_path / n)) for n in ("store", "fresh"))
    sl.index_files(as_files(spark, first), store)
    sl.index_files(as_files(spark, second), store, replace=True)
    sl.index_files(as_files(spark, second), fresh)

    def seen(s):
        return (
            sorted((r.file_path, r.type, r.symbol) for r in s.fragments().collect()),
            sorted(map(tuple, s.call_edges().collect())),
            sorted(map(tuple, s.file_hashes().collect())),
            sorted(r.name for r in s.methods().collect()),
            [(r.rank, r.symbol, r.callers, r.callees) for r in sl.search(s, "alpha run", k=20, with_graph=True, context_top=None).orderBy("rank").collect()],
        )

    assert seen(store) == seen(fresh)
    last = store.runs().where("run = 2").first()
    assert (last.discovered, last.skipped, last.processed, last.removed) == (3, 1, 2, 2)
    assert store._all("sources").count() == 5  # the rows are still there
    # A file that comes back is indexed again, and compaction keeps to the notes.
    third = {**second, "/c.java": first["/c.java"]}
    sl.index_files(as_files(spark, third), store, replace=True)
    sl.index_files(as_files(spark, third), fresh)
    assert seen(store) == seen(fresh) and store.state().version == 2
    sl.index_files(as_files(spark, {"/a.java": second["/a.java"]}), store, replace=True)
    assert [r.file_path for r in store.file_hashes().collect()] == ["/a.java"]
    sl.reset(store)
    assert store.head() == store_module.Head()


def test_an_unfinished_replacement_takes_nothing_back(spark, tmp_path):
    store = sl.CorpusStore(spark, str(tmp_path / "store"))
    sl.index_files(as_files(spark, {"/a.java": "class A { }"}), store)
    store.write_run("removed", 2, spark.createDataFrame([("/a.java",)], "file_path string"))
    assert store.fragments().count() == 1
