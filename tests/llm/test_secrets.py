"""Secret scans: ownership against a plain count, texts with many spans, redaction, clashing names."""

import random
import re
import time
from collections import defaultdict

from sourceloom.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
SCHEMA = "doc_id long, text string, source string, lang string, _secret_key string, _spans int, _real int, from int, _key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, 2, 3, "b") for r in rows], SCHEMA)


def test_ownership_against_a_plain_count(spark):
    rng = random.Random(8)
    values = [f"value{i:04d}" for i in range(12)]
    rows = []
    for i in range(150):
        text = " ".join(f"é token = {rng.choice(values)} and" for _ in range(rng.randint(0, 4)))
        rows.append((i, text, rng.choice(["s1", "s2", "s3", "s4", None]), rng.choice(["en", "de", None])))
    owners, repositories = defaultdict(set), defaultdict(set)
    for _, text, source, lang in rows:
        for m in ASSIGN.finditer(text):
            owners[m[2]].add(source)
            repositories[m[2]].add((source, lang))
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs, repository=docs["lang"]).collect()}
    for i, text, _, _ in rows:
        found = list(ASSIGN.finditer(text))
        assert [(s["start"], s["end"], s["from"], s["to"]) for s in got[i]] == [(m.start(), m.end(), len(text[: m.start()].encode()), len(text[: m.end()].encode())) for m in found]
        for s, m in zip(got[i], found):
            n = len(owners[m[2]])
            assert s["n_owners"] == n and s["n_repositories"] == len(repositories[m[2]])
            assert s["verdict"] == ("example" if n >= 3 else "live" if n == 1 else "shared")


def test_redaction_of_overlapping_spans(spark):
    rng = random.Random(9)
    parts = ["token=", "secret: ", "AKIA" + "B2" * 10, "f" * 30, "eyJabcdefgh.ijklmnopq.rst", "é", " ", "😀", "x", "ghp_" + "a1" * 20, "://u:passw0rd@h"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))), f"s{i}", "en") for i in range(200)]
    docs = frame(spark, rows)
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs, widely=10**6).collect()}
    clean = secrets.redact_secrets(docs, widely=10**6)
    assert clean.columns == docs.columns
    overlaps = 0
    for r in clean.collect():
        text, out, at = rows[r["doc_id"]][1], "", 0
        for s in spans[r["doc_id"]]:
            overlaps += s["start"] < at
            if s["start"] >= at:
                out += text[at : s["start"]] + "[secret]"
            at = max(at, s["end"])
        assert r["text"] == out + text[at:]
    assert overlaps > 20


def test_many_spans_in_one_text(spark):
    """32,000 spans took minutes while offsets grew by copies."""
    n = 32_000
    text = "".join(f"é token = abcd{i:06d} x " for i in range(n))
    docs = frame(spark, [(1, text, "s", "en"), (2, None, "s", "en"), (3, "", None, None)])
    begin = time.perf_counter()
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs).collect()}
    assert time.perf_counter() - begin < 60
    assert len(spans[1]) == n and spans[2] == spans[3] == []
    assert [s["start"] for s in spans[1]] == list(range(2, len(text), len(text) // n))
    assert {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs).collect()} == {1: "é [secret] x " * n, 2: None, 3: ""}
