"""Scoring in blocks: how many there are, and that a prefilter in 32 bits loses no row."""

import numpy as np
import pytest

from sourceloom.operators import similarity


def test_blocks_grow_before_rows_are_copied_more_often():
    assert similarity.block_count(2_000, 700, 65_536) == 3
    assert similarity.block_count(100_000, 700, 65_536) == similarity.BLOCK_COPIES
    assert similarity.block_count(615_000, 200, 32_768) == 19  # the limit of memory holds
    assert similarity.block_count(0, 700, 65_536) == 1


def by_hand(queries, rows, k):
    best = []
    for q in queries:
        lengths = np.linalg.norm(rows, axis=1) * np.linalg.norm(q)
        scores = np.divide(rows @ q, lengths, out=np.zeros(len(rows)), where=lengths > 0)
        scores = np.rint(scores * similarity.SCORE_GRID) / similarity.SCORE_GRID
        best.append(sorted(zip(-scores, range(len(rows))))[:k])
    return best


@pytest.mark.parametrize("copies", [0, 300])
def test_prefilter_loses_no_row(copies):
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(900, 32)).astype(np.float32).astype(np.float64)
    queries = rows[::15] + rng.normal(size=(60, 32)) * 1e-4
    rows[100 : 100 + copies] = rows[0]  # ties go by key
    rows[500:520] = rows[15] + rng.normal(size=(20, 32)) * 1e-7  # closer than 32 bits can tell
    rows[600] = queries[3] = 0
    best = similarity._Best(list(range(len(queries))), queries, 10)
    for start in range(0, 900, 250):
        best.add(list(range(start, min(900, start + 250))), rows[start : start + 250])
    for i, want in enumerate(by_hand(queries, rows, 10)):
        assert best.keys[i].tolist() == [key for _, key in want]
        assert best.scores[i].tolist() == [-score for score, _ in want]


def test_scoring_touches_few_pairs(monkeypatch):
    scored, plain = [], similarity._cosines
    monkeypatch.setattr(similarity, "_cosines", lambda dots, lengths: scored.append(dots.size) or plain(dots, lengths))
    rng = np.random.default_rng(3)
    best = similarity._Best(list(range(50)), rng.normal(size=(50, 16)), 5)
    best.add(list(range(5000)), rng.normal(size=(5000, 16)))
    assert sum(scored) < 50 * 5000 / 100 and all(len(s) == 5 for s in best.scores)
