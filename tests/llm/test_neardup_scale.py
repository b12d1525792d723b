"""Near-duplicates: what pairs of unlike texts cost, and that no alike pair is lost for it."""

import numpy as np

from sourceloom.llm import neardup


def test_long_texts_of_common_words_are_told_apart():
    """Unlike texts that share half of their words hardly pass, and copies with a fifth replaced do."""
    rng = np.random.default_rng(5)
    often = rng.integers(0, 2**63, size=400, dtype=np.uint64)
    weight = 1 / np.arange(1, 401)
    texts = []
    for n in (300, 420, 700, 1500, 4000):
        for _ in range(16):
            base = np.where(rng.random(n) < 0.6, rng.choice(often, n, p=weight / weight.sum()), rng.integers(0, 2**63, n, dtype=np.uint64))
            copy = base.copy()
            copy[rng.choice(n, n // 5, replace=False)] = rng.integers(0, 2**63, n // 5, dtype=np.uint64)
            texts += [base, copy]
    lengths = np.array([len(t) for t in texts])
    left, right = neardup.may_be_alike(np.arange(len(texts)), np.zeros(len(texts), int), lengths, [neardup.word_bag(t) for t in texts])
    found = set(zip(left.tolist(), right.tolist()))
    assert {(i, i + 1) for i in range(0, len(texts), 2)} <= found
    assert len(found) < 1.3 * len(texts) / 2


def edited(rng, words, share):
    """A copy with that share of edits at random places."""
    out = words.tolist()
    for _ in range(int(len(out) * share)):
        at, word = int(rng.integers(len(out))), int(rng.integers(1 << 32))
        if rng.random() < 0.5:
            out[at] = word
        elif rng.random() < 0.5 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, word)
    return np.array(out, dtype=np.uint32)


def test_rare_words_lose_no_alike_pair(spark, monkeypatch):
    """Of lengths around the one from which pairs of words count, with repeated words, in one block and in many."""
    rng = np.random.default_rng(3)
    texts = []
    for n in [4, 5, 9, 14, 40, 50, 51, 52, 60, 64, 65, 70, 80, 120, 300] * 2:
        base = rng.integers(1, 30 if n % 2 else 400, n).astype(np.uint32)
        texts += [base, edited(rng, base, 0.1), edited(rng, base, 0.19), edited(rng, base, 0.21)]
    rows = [(i, i, len(t), bytearray(t.tobytes())) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id long, root long, n_words long, words binary")
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if neardup.alike(texts[i], texts[j])}
    assert len(alike) > 80
    found = neardup.rare_words(frame, neardup.SIMILARITY)
    for block in (neardup.BLOCK, 2):
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert alike <= {(r["a"], r["b"]) for r in neardup.rare_pairs(found, neardup.SIMILARITY).collect()}


def test_texts_that_share_a_line_do_not_meet_by_common_words(spark, monkeypatch):
    """Unlike texts of one vocabulary below one line: few rows meet beyond those of the line's keys."""
    rng = np.random.default_rng(9)
    line = [f"line{i}" for i in range(20)]
    weight = 1 / np.arange(1, 3001)
    texts = [" ".join(line + [f"w{i}" for i in rng.choice(3000, 100, p=weight / weight.sum())]) for _ in range(400)]
    met: dict[str, int] = {}
    plain = neardup.stored

    def counting(rows, label, **options):
        out = plain(rows, label, **options)
        met[label] = met.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(neardup, "stored", counting)
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got.select("class_key").distinct().count() == 400
    assert met["open"] > 400 and met["open"] + met.get("met", 0) < 4 * 400
