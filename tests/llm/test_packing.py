"""Packing: the plan against all plans, tokens against the library, and odd rows."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sourceloom.llm import packing
from sourceloom.llm.bpe import read_definition
from sourceloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def definition():
    return read_definition(public_tokenizers.path("word_bpe_49k.json"))


def library_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    return [np.array([*e.ids, 2], dtype="<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def price_of(cuts, prices, window):
    total, at = 0, 0
    for c in cuts:
        size = c - at
        assert 0 < size <= window
        total += (0 if size & (size - 1) == 0 else window - size) + prices[c] + packing.SEQUENCE
        at = c
    return total


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    window = 16
    at = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 9, size=30))]))
    price = rng.choice([0, 2, 5], size=len(at))
    best = {0: 0}
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            size = int(at[j] - at[i])
            if size <= window:
                options.append(best[i] + (0 if size & (size - 1) == 0 else window - size) + int(price[j]) + packing.SEQUENCE)
        best[j] = min(options)
    cuts = packing.plan(at, price, window)
    assert price_of(cuts.tolist(), dict(zip(at.tolist(), price.tolist())), window) == best[len(at) - 1]


def test_units_equal_the_library(definition):
    texts = ["", " ", "Hello,  WORLD's\tend.\n\nNext é1 ２ ﬁ", "a <|endoftext|> b<|startoftext|>c <|END", "<|ENDOFTEXT|> A. b.. C?! d.e f, ́g é. ß; ", "<|EndOfText|>a. <|endoftext|>", "x" * 5000, "İ Σας ΣΑΣ ́ ̸a", " a b\x0bc\x85d\x1ce", "<|endoftext|>", "word " * 3000, "\U0001f600‍ 中文。次"]
    coder = packing.WordCoder(definition)
    for _ in range(2):  # without and with what the cache holds
        ids, lengths, ends = coder.encode(texts)
        for got, want in zip(np.split(ids, np.cumsum(lengths)[:-1]), library_ids(texts)):
            assert got.tolist() == want.tolist()
    assert len(ends) and (np.diff(ends) > 0).all() and ends[-1] <= len(ids)


def test_a_full_cache_keeps_what_is_used(definition, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_UNITS", 20)
    rng = np.random.default_rng(2)
    coder = packing.WordCoder(definition)
    for _ in range(30):
        texts = [" ".join(f"word{int(x)}" for x in rng.zipf(1.5, size=12) % 300) + "." for _ in range(3)]
        ids, lengths, _ = coder.encode(texts)
        for got, want in zip(np.split(ids, np.cumsum(lengths)[:-1]), library_ids(texts)):
            assert got.tolist() == want.tolist()
    assert len(coder.units) < 80


def check_pieces(rows, want):
    """``want``: a list of id arrays per doc_id."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"]].append(r)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert documents.keys() == want.keys()
    for name, texts in want.items():
        parts = sorted(documents[name], key=lambda r: r["start"])
        if len(texts) == 1:
            assert [p["start"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts[:-1])]).tolist()
            for p in parts:
                assert p["ids_crc32"] == zlib.crc32(texts[0][p["start"] : p["start"] + p["length"]].tobytes())
                assert p["doc_tokens"] == len(texts[0])
        assert sum(p["length"] for p in parts) == sum(map(len, texts))
    return padding


def test_query_packs_each_token_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = defaultdict(list)
    for r, ids in zip(docs, library_ids([r["text"] for r in docs])):
        want[r["doc_id"]].append(ids)
    rows = QUERIES["op12_window_packing"](spark, SF).collect()
    padding = check_pieces(rows, want)
    tokens = sum(len(i) for parts in want.values() for i in parts)
    assert padding < 0.01 * tokens
    assert len(rows) < len(docs) + 1.2 * tokens / packing.WINDOW + 12


def test_blocks_join_seamlessly(spark, definition, monkeypatch):
    """Many small plans in a row lose no token and little padding."""
    monkeypatch.setattr(packing, "BLOCK", 60_000)
    monkeypatch.setattr(packing, "BATCH", 50_000)
    texts = [" ".join(f"word{i % 7} is here{'.' if i % 11 == 0 else ''}" for i in range(n)) for n in [5, 40_000, 900, 17, 3000, 8000, 1] * 3]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    packed = packing.pack(frame, definition).selectExpr("*", "crc32(ids) AS ids_crc32").collect()
    ids = library_ids(texts)
    assert check_pieces(packed, {i: [x] for i, x in enumerate(ids)}) < 0.005 * sum(map(len, ids))


def test_odd_rows(spark, definition):
    long = "no end in sight " * 9000
    rows = [(1, None, "x"), (2, "", "x"), (3, "One. Two!", "x"), (3, "One. Two!", "x"), (None, " \n\t", "x"), (4, long, "x"), (4, long, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = packing.pack(frame, definition).selectExpr("*", "crc32(ids) AS ids_crc32").collect()
    want = defaultdict(list)
    for (name, _, _), ids in zip(rows, library_ids([r[1] for r in rows])):
        want[name].append(ids)
    check_pieces(got, want)
    assert sorted(r["doc_tokens"] for r in got if r["doc_id"] in (1, 2, None)) == [1, 1, 1]
    assert packing.pack(frame.limit(0), definition).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="apart"):
        packing.WordCoder(read_definition(public_tokenizers.path("byte_bpe_50k.json")))
