import random
import re

import pytest
from pyspark.sql import functions as F

from sourceloom.functions import text


def strip_both(c):
    return text.strip_line_banner(text.strip_block_banner(c))


BANNERS = [
    ("/* Licensed to X */\n\npackage a;", "package a;"),
    ("/* plain doc */ class X", "/* plain doc */ class X"),
    ("// Copyright\n// two\n\n  class Y", "class Y"),
    ("// hi\nclass Z", "// hi\nclass Z"),
    ("/* license */\n// apache\nclass W", "class W"),
    ("  // license no newline", "  // license no newline"),
    (" // a\n  // license\nclass V", " // a\n  // license\nclass V"),
    ("// license\n" * 20_000 + "y", "y"),
    (" /* COPYRIGHT\n * x\n */ class A", "class A"),
    ("class A /* license */", "class A /* license */"),
    ("", ""),
]


def test_banners(values):
    assert values(strip_both, [b for b, _ in BANNERS]) == [want for _, want in BANNERS]


def test_decode_drops_invalid_bytes_and_keeps_the_rest(values):
    cases = [
        (b"plain", "plain"),
        (b"a\xffb\xc3", "ab"),
        ("é�".encode(), "é�"),
        (b"\xff" + "é�".encode(), "é�"),
        (b"a\r\nb\rc\n", "a\nb\nc\n"),
        (b"\xe2\x82A", "A"),
        (b"\xed\xa0\x80x", "x"),
        (b"\xef\xbb\xbfx", "﻿x"),
        (b"", ""),
    ]
    assert values(text.decode_source, [bytearray(c) for c, _ in cases], "binary") == [w for _, w in cases]
    for raw, want in cases:
        assert re.sub("\r\n?", "\n", raw.decode("utf-8", "ignore")) == want


def test_lines_match_python(values):
    rng = random.Random(1)
    ends = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", " ", " ", "a", " ", ""]
    cases = ["".join(rng.choice(ends) for _ in range(rng.randrange(7))) for _ in range(300)]
    for case, got in zip(cases, values(text.lines_of, cases)):
        assert got == case.splitlines(), repr(case)


def test_preview(values):
    ten = "\n".join(f"l{i}" for i in range(10))
    cases = [" \n a\n\n b \n", ten, ten[: ten.index("l8") - 1], "", None, " \n "]
    got = values(text.code_preview, cases)
    eight = "\n".join(f"l{i}" for i in range(8))
    assert got == ["a\n\n b", eight + "\n...", eight, text.NO_CODE, text.NO_CODE, ""]


def test_snippet_keeps_sixty_lines_untrimmed(values):
    code = "  a\n" + "\n".join(str(i) for i in range(80))
    assert values(text.report_snippet, [code, "x\n", None]) == ["\n".join(code.splitlines()[:60]), "x", ""]


def test_html_escape(values):
    assert values(text.html_escape, ["<a href=\"x\">&amp;'</a>"]) == ["&lt;a href=\"x\"&gt;&amp;amp;'&lt;/a&gt;"]


def test_numbers_are_formatted_like_python(values):
    rng = random.Random(2)
    cases = [0.03125, 0.09375, -0.03125, 1e-9, 0.0] + [rng.uniform(-2, 2) for _ in range(200)]
    want = ["-0.0000" if f"{v:.4f}" == "-0.0000" else f"{v:.4f}" for v in cases]
    assert [g.replace("-0.0000", "0.0000") for g in values(text.fixed4, cases, "double")] == [
        w.replace("-0.0000", "0.0000") for w in want
    ]


def test_vector_head(values):
    cases = [[0.5, 1.0], [0.1] * 6, [], None]
    got = values(text.vector_head, cases, "array<float>")
    assert got == ["[0.5000, 1.0000]", "[" + ", ".join(["0.1000"] * 5) + " ...]", "[]", "-"]


def test_clip_title_meta(spark):
    row = spark.createDataFrame([("class", "a.B", "/p/B.java", 0.5)], "t string, s string, f string, c double")
    got = row.select(
        text.hit_title(F.col("t"), F.col("s")),
        text.hit_meta(F.col("f"), F.col("c")),
        text.clip(F.col("s"), 2, "-"),
        text.clip(F.lit(None).cast("string"), 60, "-"),
    ).first()
    assert tuple(got) == ("class · a.B", "File: /p/B.java · Score: 0.5000", "a.", "-")


@pytest.mark.parametrize("callers, callees", [([], []), (["p.a"], ["p.b", "p.c"])])
def test_graph_text(spark, callers, callees):
    from hashlib import md5

    row = spark.createDataFrame([("p.x", callers, callees)], "s string, i array<string>, o array<string>")
    got = row.select(text.graph_text(F.col("s"), F.col("i"), F.col("o"))).first()[0]

    def key(name):
        return md5(name.encode()).hexdigest()[:16]

    want = ["graph LR", '  target["p.x"]']
    want += [f'  caller_{key(c)}(["{c}"]) --> target' for c in callers]
    want += [f'  target --> callee_{key(c)}(["{c}"]) ' for c in callees]
    assert got == "\n".join(want)


def test_scratch_folder_follows_the_session(spark):
    from types import SimpleNamespace

    from sourceloom.session import scratch_dir

    def fake(value, master="local[2]"):
        context = SimpleNamespace(master=master)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: value), sparkContext=context)

    assert scratch_dir(fake("/shared/x/"), "a").startswith("/shared/x/a-")
    assert "/sourceloom-scratch/a-" in scratch_dir(fake(None), "a")
    assert scratch_dir(spark, "a") != scratch_dir(spark, "a")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            scratch_dir(fake(None, master), "a")


def test_noncharacters_survive_decoding(values):
    raw = "a\ufdd0e\ufdd0r\ufffd".encode() + b"\xff" + "\ufdd0b".encode()
    assert values(text.decode_source, [raw], "binary") == ["a\ufdd0e\ufdd0r\ufffd\ufdd0b"]


def test_long_blank_runs_do_not_explode(values):
    assert values(text.code_preview, ["a" + " " * 1_000_000 + "b", " " * 1_000_000]) == ["a" + " " * 1_000_000 + "b", ""]
