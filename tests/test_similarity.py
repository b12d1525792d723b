import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceloom.functions import vectors
from sourceloom.operators.similarity import top_k, top_k_batch

VECTOR = "key long, embedding array<float>"


def frame(spark, rows, name="key", kind="long"):
    return spark.createDataFrame([(k, [float(x) for x in v] if v is not None else None) for k, v in rows],
                                 f"{name} {kind}, embedding array<float>")


def brute(base, queries, k):
    out = []
    for q, qv in queries:
        if not qv:
            continue
        a, scored = np.array(qv, np.float32).astype(float), []
        for key, bv in base:
            if bv:
                b = np.array(bv, np.float32).astype(float)
                n = np.linalg.norm(a) * np.linalg.norm(b)
                scored.append((-(round(float(a @ b / n), 9) if n else 0.0), key))
        out += [(q, r, key, round(-s, 6)) for r, (s, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def rows_of(near):
    return sorted((r.query_id, r.rank, r.key, round(r.score, 6)) for r in near.collect())


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    base = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    copy = rng.normal(size=8).tolist()
    base += [(i, copy) for i in range(300, 500)]  # one vector fills two fifths
    base += [(500, None), (501, []), (502, [0.0] * 8)]
    rng.shuffle(base)
    queries = [(i, rng.normal(size=8).tolist()) for i in range(30)] + [(30, copy), (31, [0.0] * 8), (32, None), (33, [])]
    return [(int(k), v) for k, v in base], queries


@pytest.mark.parametrize("k", [0, 1, 10, 1000])
def test_batch_is_exact(spark, data, k):
    base, queries = data
    near = top_k_batch(frame(spark, base).repartition(5), frame(spark, queries, "query_id"), k)
    assert rows_of(near) == brute(base, queries, k)


def test_blocks_give_the_same(spark, data):
    base, queries = data
    near = top_k_batch(frame(spark, base), frame(spark, queries, "query_id"), 7, query_bytes=64, block_rows=60)
    assert rows_of(near) == brute(base, queries, 7)


def test_both_paths_agree_on_doubles_and_text_ids(spark):
    rng = np.random.default_rng(5)
    base = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(1500)]
    asked = [(f"q{i}", [float(x) for x in rng.normal(size=6)]) for i in range(9)]

    def rows(kind):
        return spark.createDataFrame(base, "key long, embedding array<double>"), spark.createDataFrame(
            asked, "query_id string, embedding array<double>"
        )

    scan = top_k_batch(*rows(0), 1000)
    blocks = top_k_batch(*rows(0), 1000, query_bytes=64, block_rows=400)
    columns = ["query_id", "rank", "key", "score"]
    got = [sorted(map(tuple, frame.select(*columns).collect())) for frame in (scan, blocks)]
    assert got[0] == got[1] and len(got[0]) == 9 * 1000


def test_null_keys_and_repeated_queries(spark):
    base = frame(spark, [(None, [1.0, 0.0]), (2, [1.0, 1.0])])
    assert [r.key for r in top_k_batch(base, frame(spark, [(1, [1.0, 0.0])], "query_id"), 5).collect()] == [2]
    with pytest.raises(ValueError, match="occurs 2 times"):
        top_k_batch(base, frame(spark, [(1, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id"), 5)


def test_string_keys(spark):
    base = [("b", [1, 0]), ("é", [1, 0]), ("a", [0, 1]), ("Z", [1, 0])]
    near = top_k_batch(frame(spark, base, kind="string"), frame(spark, [(1, [1, 0])], "query_id"), 3)
    assert [r[2] for r in rows_of(near)] == ["Z", "b", "é"]


@pytest.mark.parametrize("k", [0, 1, 10, 1000])
def test_single_query_is_exact(spark, data, k):
    base, queries = data
    for q, vector in (queries[0], queries[30], queries[31]):
        got = [(r.key, round(r.score, 6)) for r in top_k(frame(spark, base), vector, k, "key").collect()]
        assert got == [(key, s) for _, _, key, s in brute(base, [(q, vector)], k)]


def test_no_rows(spark):
    empty = spark.createDataFrame([], VECTOR)
    assert top_k(empty, [1.0], 5, "key").count() == 0
    assert top_k_batch(empty, frame(spark, [(1, [1.0])], "query_id"), 5).count() == 0
    assert top_k_batch(frame(spark, [(1, [1.0])]), spark.createDataFrame([], "query_id long, embedding array<float>"), 5).count() == 0


def test_negative_k_is_refused(spark):
    with pytest.raises(ValueError):
        top_k(spark.createDataFrame([], VECTOR), [1.0], -1, "key")


@pytest.mark.parametrize("blocks", [False, True])
def test_other_widths_fail(spark, blocks):
    base, asked = frame(spark, [(1, [1, 2]), (2, [1, 2, 3])]), frame(spark, [(1, [1, 2]), (2, [2, 1])], "query_id")
    with pytest.raises(Exception, match="vector lengths differ"):
        top_k(base, [1.0, 2.0], 1, "key").collect()
    with pytest.raises(Exception, match="vector lengths differ"):
        top_k_batch(base, asked, 1, query_bytes=4 if blocks else 1 << 20).collect()


def test_vector_columns(spark):
    row = frame(spark, [(1, [3, 4])]).select(
        vectors.norm(F.col("embedding")),
        vectors.dot(F.col("embedding"), F.array(F.lit(1.0), F.lit(2.0))),
        vectors.cosine(F.col("embedding"), F.array(F.lit(0.0), F.lit(0.0))),
    ).first()
    assert tuple(row) == (5.0, 11.0, 0.0)


def test_executors_do_not_need_the_package(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    tests = Path(__file__).resolve().parent
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(tests / "elsewhere.py"), str(tests.parent)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180,
    )
    assert "passed" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("k", [1, 7, 400])
def test_a_first_part_bounds_the_others(spark, data, k):
    from sourceloom.operators import similarity

    base, queries = data
    table, asked = frame(spark, base).repartition(6), frame(spark, queries, "query_id")
    passed = []
    plain = similarity.top_n

    def counting(rows, *args):
        passed.append(rows.count())
        return plain(rows, *args)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(similarity, "top_n", counting)
        assert rows_of(top_k_batch(table, asked, k)) == brute(base, queries, k)
        whole = passed.pop()
        near = top_k_batch(table, asked, k, first=table.where("key % 3 = 0"))
        assert rows_of(near) == brute(base, queries, k)
    assert passed[-1] <= whole and (k != 7 or passed[-1] < 0.75 * whole)


@pytest.mark.parametrize("k", [0, 1, 123, 250, 400, 10_000])
def test_many_best_rows_by_a_threshold(spark, data, monkeypatch, k):
    """The same rows as one sorted list, ties at the threshold included."""
    from sourceloom.operators import similarity

    base, queries = data
    table = frame(spark, base).repartition(6)
    for query in (queries[0][1], queries[30][1]):  # the last one ties for two fifths
        monkeypatch.setattr(similarity, "TOP_ROWS", 100_000)
        want = [(r.key, r.score) for r in top_k(table, query, k, "key").collect()]
        monkeypatch.setattr(similarity, "TOP_ROWS", -1)
        got = top_k(table, query, k, "key")
        assert sorted((-r.score, r.key) for r in got.collect()) == sorted((-s, key) for key, s in want)
        assert got.columns == ["key", "score"]
        # No task sorts or holds the best of all others.
        from tests.conftest import plan_of

        assert "TakeOrdered" not in plan_of(got) and "Limit" not in plan_of(got)
