"""Near-duplicates: against all pairs, and how the work grows with a group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceloom.llm import neardup


def closure(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_classes_against_all_pairs(spark):
    """All pairs of the smallest documents are aligned; the classes are the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id").collect()
    words = [neardup.word_hashes([r["text"]], neardup.ALNUM)[0] for r in rows]
    links = []
    for i, a in enumerate(words):
        for j in range(i):
            if rows[i]["text"] == rows[j]["text"] or (len(a) and len(words[j]) and neardup.alike(a, words[j])):
                links.append((j, i))
    root = closure(len(rows), links)
    got = {r["doc_id"]: r["class_key"] for r in neardup.near_duplicates(docs).collect()}
    assert len(links) > 10
    for i, a in enumerate(rows):
        for j in range(i):
            assert (got[a["doc_id"]] == got[rows[j]["doc_id"]]) == (root[i] == root[j])


def templates(n, seed=4):
    """Texts of 12 words of which nine are common: none is alike another."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    common = [word() for _ in range(9)]
    return [(i, " ".join([*common[:4], word(), *common[4:7], word(), *common[7:], word()])) for i in range(n)]


@pytest.fixture
def compared(monkeypatch):
    """The number of pairs that are aligned."""
    seen = []
    plain = neardup.stored

    def counting(rows, label, **options):
        out = plain(rows, label, **options)
        if label in ("pairs", "left"):
            seen.append(out.count())
        return out

    monkeypatch.setattr(neardup, "stored", counting)
    return seen


def test_pairs_grow_with_a_group_not_with_its_square(spark, compared):
    work = []
    for n in (300, 600, 1200):
        compared.clear()
        got = neardup.near_duplicates(spark.createDataFrame(templates(n), "doc_id long, text string"))
        assert got.select("class_key").distinct().count() == n
        work.append(sum(compared))
    assert work[1] < 2.5 * work[0] and work[2] < 2.5 * work[1]


def test_rare_words_bring_alike_texts_together(spark):
    """Each pair of alike texts shares one of its rarest words, whatever the edits."""
    rng = random.Random(6)
    texts = []
    for _ in range(25):
        base = [rng.randint(1, 60) for _ in range(rng.randint(3, 60))]
        texts += [base, [x for x in base if rng.random() < 0.9] or base, [rng.randint(1, 60) if rng.random() < 0.1 else x for x in base]]
    arrays = [np.array(t, dtype=np.uint32) for t in texts]
    rows = [(i, len(a), bytearray(a.tobytes())) for i, a in enumerate(arrays)]
    frame = spark.createDataFrame(rows, "id long, n_words long, words binary")
    keys: dict[int, set] = {}
    for r in neardup.rare_words(frame, neardup.SIMILARITY).collect():
        keys.setdefault(r["id"], set()).add(r["key"])
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.alike(arrays[i], arrays[j])]
    assert len(pairs) > 20 and all(keys[i] & keys[j] for i, j in pairs)


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """Close copies in a family of one template, all keys of which are taken as crowded."""
    monkeypatch.setattr(neardup, "CROWD", 5)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rows = templates(60)
    rng = random.Random(8)
    copies = [(1000 + i, " ".join(w if k != 11 else "changed" + str(rng.random())[2:] for k, w in enumerate(t.split()))) for i, t in rows[::3]]
    got = {r["doc_id"]: r["class_key"] for r in neardup.near_duplicates(spark.createDataFrame(rows + copies, "doc_id long, text string")).collect()}
    assert all(got[i] == got[i - 1000] for i, _ in copies) and len(set(got.values())) == 60


def test_clashing_names(spark):
    rows = [(1, "a b c d e", 5, "x"), (2, "a b c d e", 6, "y"), (3, None, 7, "z"), (3, None, 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept int, _key string")
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("n", [200, 250, 256, 300, 500, 2000, 9000])
def test_bags_of_long_texts(n):
    """Alike pairs of any length pass, also across two levels; unlike ones hardly do."""
    rng = np.random.default_rng(n)
    often = rng.integers(0, 2**60, size=40)

    def text(size):
        some = rng.integers(0, 2**60, size=size)
        return np.where(rng.random(size) < 0.4, rng.choice(often, size), some).astype(np.uint64)

    texts = []
    for _ in range(30):
        base = text(n)
        copy = base.copy()
        at = rng.choice(n, size=n // 5, replace=False)
        copy[at] = rng.integers(0, 2**60, size=len(at)).astype(np.uint64)
        longer = np.concatenate([base, text(n // 5)])
        texts += [base, copy, longer]
    lengths = np.array([len(t) for t in texts])
    groups = np.arange(len(texts))
    left, right = neardup.may_be_alike(groups, np.zeros(len(texts), int), lengths, [neardup.word_bag(t) for t in texts])
    found = set(zip(left.tolist(), right.tolist()))
    for i in range(0, len(texts), 3):
        assert {(i, i + 1), (i, i + 2)} <= found
    others = [(i, j) for i, j in found if i // 3 != j // 3]
    assert len(others) < 0.02 * len(texts) ** 2 / 2


def test_pairs_of_many_cells_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(neardup, "PAIRS", 50)
    texts, cells = [], []
    for cell, n in enumerate((1, 30, 2, 12, 1, 9)):
        own = rng.integers(0, 1 << 63, 400 if cell % 2 else 30, dtype=np.uint64)
        for _ in range(n):
            words = own[: int(len(own) * rng.uniform(0.7, 1))].copy()
            words[rng.integers(0, len(words), len(words) // 8)] = rng.integers(0, 1 << 63, len(words) // 8, dtype=np.uint64)
            texts.append(words)
            cells.append(cell)
    cells, lengths = np.array(cells), np.array([len(t) for t in texts])
    roots, blocks = rng.integers(0, 12, len(texts)), np.where(cells == 3, rng.integers(0, 2, len(texts)), 0)
    bags = [neardup.word_bag(t) for t in texts]
    want = []
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if cells[i] != cells[j] or roots[i] == roots[j] or (cells[i] == 3 and blocks[i] == blocks[j]):
                continue
            one = [neardup.split_bags([bags[x]]) for x in (i, j)]
            if neardup.bags_allow(lengths[i : i + 1], lengths[j : j + 1], *one, neardup.SIMILARITY)[0]:
                want.append((i, j))
    left, right = neardup.may_be_alike(roots, blocks, lengths, bags, cells=cells)
    assert len(want) > 50 and sorted(zip(left.tolist(), right.tolist())) == want
    assert [len(x) for x in neardup.may_be_alike(*(x[:0] for x in (roots, blocks, lengths)), [])] == [0, 0]
