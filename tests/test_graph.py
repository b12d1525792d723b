import pytest
from pyspark.sql import functions as F

from sourceloom.operators import graph
from sourceloom.operators.incremental import changed_files, scan_counters, upsert_hashes
from sourceloom.operators.ranking import top_n
from sourceloom.operators.sizing import at_most
from tests.conftest import plan_of

EDGE = "caller string, callee string"


@pytest.fixture(scope="module")
def hub(spark):
    """A third of all edges end in one method."""
    rows = [(f"c{i:04d}", "hub") for i in range(500)] + [(f"c{i:04d}", f"d{i % 37}") for i in range(1000)]
    return rows, spark.createDataFrame(rows, EDGE).repartition(6)


def test_merge_is_idempotent(spark, hub):
    _, edges = hub
    once = graph.merge_edges(spark.createDataFrame([], EDGE), edges)
    twice = graph.merge_edges(once, edges)
    assert once.count() == twice.count() == 1500
    assert graph.new_edges(once, edges).count() == 0
    more = spark.createDataFrame([("c0000", "hub"), ("new", "hub"), ("new", "hub")], EDGE)
    assert [tuple(r) for r in graph.new_edges(once, more).collect()] == [("new", "hub")]


def test_counts_and_nodes(hub):
    rows, edges = hub
    names = {n for pair in rows for n in pair}
    assert tuple(graph.graph_counts(edges).first()) == (len(names), 1500)
    assert {r.name for r in graph.method_nodes(edges).collect()} == names


def expected(rows, n, targets=None):
    out = {}
    for a, b in rows:
        out.setdefault(b, ([], []))[0].append(a)
        out.setdefault(a, ([], []))[1].append(b)
    return {t: (sorted(i)[:n], sorted(o)[:n]) for t, (i, o) in out.items() if targets is None or t in targets}


@pytest.mark.parametrize("n", [1, 10, 2000])
def test_neighbours(spark, hub, n):
    rows, edges = hub
    got = {r.target: (r.callers, r.callees) for r in graph.neighbours(edges, n).collect()}
    assert got == expected(rows, n)
    few = {"hub", "d3", "c0007", "absent"}
    targets = spark.createDataFrame([(t,) for t in few], "target string")
    got = {r.target: (r.callers, r.callees) for r in graph.neighbours(edges, n, targets).collect()}
    assert got == expected(rows, n, few)
    many = {a for a, _ in rows}
    targets = spark.createDataFrame([(t,) for t in many], "target string")
    got = {r.target: (r.callers, r.callees) for r in graph.neighbours(edges, n, targets).collect()}
    assert got == expected(rows, n, many)


def test_single_lookups(hub):
    rows, edges = hub
    assert [r.name for r in graph.callers_of(edges, "hub", 3).collect()] == ["c0000", "c0001", "c0002"]
    assert [r.name for r in graph.callees_of(edges, "c0001").collect()] == ["d1", "hub"]


def test_hot_groups_are_cut_before_the_shuffle(hub):
    _, edges = hub
    plan = plan_of(graph.neighbours(edges, 10))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert plan_of(top_n(edges, ["callee"], [F.col("caller")], 5000)).count("Window ") >= 2


STATE = "file_path string, hash string"


@pytest.fixture(scope="module")
def scans(spark):
    files = spark.createDataFrame(
        [("same", "1", b"x"), ("edited", "2", b"y"), ("new", "3", b"z"), ("moved", "1", b"x")],
        "file_path string, hash string, content binary",
    )
    state = spark.createDataFrame([("same", "1"), ("edited", "1"), ("gone", "9")], STATE)
    return files, state


@pytest.mark.parametrize("bound", [0, 2, 3, 1000])
def test_changed_files(scans, bound):
    files, state = scans
    got = changed_files(files, state, broadcast_rows=bound)
    assert {r.file_path for r in got.collect()} == {"edited", "new", "moved"}
    assert got.columns.count("content") == 1
    assert changed_files(files, state, full_rescan=True).count() == 4


def test_small_state_is_broadcast(scans):
    files, state = scans
    plan = plan_of(changed_files(files, state))
    assert "BroadcastHashJoin LeftAnti" in plan.replace("  ", " ") or ("BroadcastHashJoin" in plan and "LeftAnti" in plan)


def test_counters_and_upsert(scans):
    files, state = scans
    assert tuple(scan_counters(files, state).first()) == (4, 1, 3)
    assert tuple(scan_counters(files, state, full_rescan=True).first()) == (4, 0, 4)
    got = {r.file_path: r.hash for r in upsert_hashes(state, files).collect()}
    assert got == {"same": "1", "edited": "2", "new": "3", "moved": "1", "gone": "9"}


def test_broadcasts_are_bounded_in_bytes(spark):
    rows = spark.createDataFrame([("aé", ["bc", None], 1), (None, None, 2)], "s string, l array<string>, n int")
    assert at_most(rows, 2) and not at_most(rows, 1)
    size = 2 * 3 * 16 + 3 + 2
    assert at_most(rows, 2, size) and not at_most(rows, 2, size - 1)
    assert at_most(rows.limit(0), 0, 0) and at_most(rows, 2, None)
