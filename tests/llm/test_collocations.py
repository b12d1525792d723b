"""Collocations: automata against dictionaries, results against a plain count, odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sourceloom.llm import collocations as c


def plain(rows, least, top, inside=50, longest=3):
    counts = defaultdict(Counter)
    for lang, text in rows:
        lowered = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lowered):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        candidates = {g: v for g, v in f.items() if len(g) > 1 and v >= least}
        kept = []
        for g, a in candidates.items():
            holders = [h for h in candidates if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if any(100 * candidates[h] >= inside * a for h in holders):
                continue
            score, k = min(((1_000_000 * a * a) // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def texts(seed, docs=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "été", "new", "york", "city", "a\x01b", "x\x00", "\U0001f600", "ab", "zz"]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = []
    for _ in range(docs):
        body = [rng.choices(words, weights)[0] + rng.choice(["", "", "", ".", ",", "\n", "\t", "!?", " "]) for _ in range(rng.randint(0, 60))]
        out.append((rng.choice(["en", "en", "a\tlang ", None]), " ".join(body)))
    return out


@pytest.mark.parametrize("seed,least,longest", [(1, 3, 3), (2, 10, 3), (3, 2, 2)])
def test_matches_a_plain_count(spark, monkeypatch, seed, least, longest):
    monkeypatch.setattr(c, "RANGE", 7)  # many automata
    monkeypatch.setattr(c, "LOOKUPS", 5)  # shared out among tasks
    monkeypatch.setattr(c, "VOCABULARY", 6)  # and shards that are passed on early
    rows = texts(seed)
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "lang string, text string, w1 string, n int")
    got = c.collocations(frame, longest=longest, least=least, top=40)
    assert sorted(map(tuple, got.collect())) == plain(rows, least, 40, longest=longest)


def test_automaton_is_minimal_and_exact():
    rng = np.random.default_rng(4)
    grams = sorted({tuple(f"w{x}" for x in rng.integers(0, 9, size=rng.integers(1, 4))) for _ in range(400)})
    counts = {g: int(rng.integers(1, 4)) for g in grams}
    builder = c.Builder()
    for g in grams:
        builder.add(g, counts[g])
    machine = builder.finish()
    asked = [*grams, *[tuple(f"w{x}" for x in rng.integers(0, 12, size=rng.integers(1, 4))) for _ in range(500)]]
    columns = [np.array([g[i] if i < len(g) else None for g in asked], dtype=object) for i in range(3)]
    assert c.composed(machine, columns).tolist() == [counts.get(g, 0) for g in asked]
    assert len(set(builder.states)) == len(builder.states) < len({g[:i] for g in grams for i in range(3)})
    with pytest.raises(ValueError, match="order"):
        builder.add(grams[0], 1)


def test_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_000, 4_000_000_000, 5_000_000_000
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(f"{c.SCORE} AS s").first()
    assert row["s"] == 1_000_000 * a * a // (left * right)


def test_odd_tables(spark):
    schema = "text string, lang string, phrase int"
    assert c.collocations(spark.createDataFrame([], schema)).count() == 0
    bare = [(None, None, 1), ("", "en", 2), (" ., \t!", "en", 3), ("one", "en", 4)]
    assert c.collocations(spark.createDataFrame(bare, schema)).count() == 0
    same = [("New York! " * 30_000, None, 1)] * 2
    got = c.collocations(spark.createDataFrame(same, schema)).collect()
    assert [tuple(r) for r in got] == [("und", 1, "new york", 60_000, 60_000, 60_000, 120_000, 1_000_000)]
