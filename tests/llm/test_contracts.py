"""Contracted columns against plain Python, on whole small tables and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sourceloom.llm import bpe, chat, ppm
from sourceloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return [w for w in re.split(r"[ \t-\r]", lowered(text)) if w]


def test_base_scores(spark):
    """op6: token counts, known tokens and add-one scores from dictionaries."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in docs}
    counts = Counter()
    for r in docs:
        if not held[r["doc_id"]]:
            counts.update([*words_of(r["text"]), None])
    total, kinds = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in QUERIES["op6_ppm_score"](spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        tokens, told = [*words_of(r["text"]), None], got[r["doc_id"]]
        assert told["held_out"] == held[r["doc_id"]] and told["train_tokens"] == total
        assert told["n_tokens"] == len(tokens) and told["n_known"] == sum(counts[t] > 0 for t in tokens)
        want = sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens)
        assert told["base_score"] == pytest.approx(want, rel=1e-9)
        assert told["score"] < 0


def test_long_texts_are_encoded_as_in_one_piece(spark):
    """op8: leaves, joins and the short path against the library, on whole documents."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for leaf in (700, 32_768):
        got = {r["doc_id"]: r for r in bpe.encode(docs, bpe.read_definition(path), leaf_chars=leaf, decoded=True).collect()}
        for r in docs.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            assert np.frombuffer(got[r["doc_id"]]["ids"], "<u4").tolist() == ids
            assert got[r["doc_id"]]["text"] == library.decode(ids, skip_special_tokens=False)


def test_chat_on_odd_rows(spark):
    """op4: repeated rows, ties of turns, extra columns, null roles and empty tables."""
    rows = [(1, 0, "user", "a\n"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, None, "system", None), (2, 0, "assistant", ""), (3, 5, None, "x"), (None, 0, "user", "n")]
    turns = spark.createDataFrame([(*r, "loss", 7) for r in rows], "conv_id long, turn long, role string, text string, context string, reply int")
    told = {r["conv_id"]: r for r in chat.read_back(chat.prefix_targets(turns)).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role, text or ""))
    assert told.keys() == by.keys()
    for conv, parts in by.items():
        assert told[conv]["n_turns"] == len(parts)
        loss = "".join(t for _, role, t in sorted(parts, key=lambda p: p[0]) if role == "assistant")
        assert told[conv]["loss_text"] == loss
    assert chat.prefix_targets(turns.limit(0)).count() == 0


def test_query_digests_of_conversations(spark):
    """op4: digests of whole conversations from the plain rows."""
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in QUERIES["op4_prefix_targets"](spark, SF).collect()}
    assert got.keys() == by.keys() | {-7}
    for conv, parts in by.items():
        parts.sort()
        text = "".join(f"{role}\n{t}\n" for _, role, t in parts)
        loss = "".join(t for _, role, t in parts if role == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_scores_of_odd_rows(spark):
    rows = [(2, "a b", "x"), (2, "a b", "x"), (None, None, "x"), (7, "", "x"), (9, "A é\x0bb", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in ppm.score(docs).collect())
    assert got == sorted((i or 0, len(words_of(t)) + 1) for i, t, _ in rows)
