import hashlib
import re

from pyspark.sql import functions as F

from sourceloom.functions.encoder import HashingEncoder, ModelEncoder
from sourceloom.operators.embed import embed, embed_distinct, failed_rows

TEXTS = ["parseJsonResponse(x_1)", "Été été ²", "", None, "a a a b", "XMLReader"]


def by_hand(text, dim):
    vector = [0.0] * dim
    for word in re.findall(r"\w+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", text).lower()):
        slot = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % (2 * dim)
        vector[slot % dim] += 1 if slot < dim else -1
    return vector


def test_hashing_matches_by_hand(values):
    for dim in (1, 7, 64, 384):
        got = values(HashingEncoder(dim).column, TEXTS)
        assert got == [None if t is None else by_hand(t, dim) for t in TEXTS]


def test_long_text(values):
    text = " ".join(f"word{i}" for i in range(50_000))
    assert values(HashingEncoder(16).column, [text]) == [by_hand(text, 16)]


def load_stub():
    def encode(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("cannot encode")
        return [[float(len(t)), 1.0] for t in texts]

    return encode


def test_model_failures_stay_single(spark):
    rows = [(i, "bad" if i % 7 == 0 else "x" * i) for i in range(50)] + [(50, None)]
    table = spark.createDataFrame(rows, "id int, text string").repartition(3)
    model = ModelEncoder("stub", 2, load_stub)
    got = {r.id: r.embedding for r in embed(table, "text", model).collect()}
    assert got == {i: None if t is None or t == "bad" else [float(len(t)), 1.0] for i, t in rows}
    assert {r.id for r in failed_rows(embed(table, "text", model)).collect()} == {i for i in got if got[i] is None}


def load_uneven():
    return lambda texts: [[float(len(t))] * (3 if t == "wide" else 2) for t in texts]


def test_another_width_is_a_failure(spark):
    table = spark.createDataFrame([(1, "ab"), (2, "wide"), (3, "abc")], "id int, text string").coalesce(1)
    got = {r.id: r.embedding for r in embed(table, "text", ModelEncoder("uneven", 2, load_uneven)).collect()}
    assert got == {1: [2.0, 2.0], 2: None, 3: [3.0, 3.0]}


def test_one_encoding_per_distinct_text(spark):
    rows = [(i, "hot" if i % 3 else f"text {i}") for i in range(300)]
    table = spark.createDataFrame(rows, "id int, text string")
    encoder = HashingEncoder(8)
    plain = embed(table, "text", encoder)
    once = embed_distinct(table, "text", encoder)
    assert once.columns == plain.columns
    assert once.count() == 300 and plain.exceptAll(once).count() == 0
    nulls = spark.createDataFrame([(1, None)], "id int, text string")
    assert embed_distinct(nulls, "text", encoder).select(F.col("embedding").isNull()).first()[0]


def test_words_counted_in_batches_are_those_of_spark(spark):
    latin = [chr(i) for i in range(1, 0x250)]
    texts = ["".join(latin), " ".join(latin), " ".join(f"a{c}B{c}9{c}" for c in latin), "İzmirXy fooBar9Baz", "x" * 100_000]
    texts += ["ΣΑΣ Σ.", "день ДеньXy", "中文 á", "", None, "fooBar " * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)
    for dim in (1, 7, 64):
        encoder = HashingEncoder(dim)
        got = rows.select(encoder.column(F.col("text")).alias("a"), encoder.projected(F.col("text")).alias("b"))
        assert got.where("not (a <=> b)").count() == 0


def test_latin_words_are_hashed_in_batches(spark):
    plan = spark.range(1).select(HashingEncoder(4).column(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_slots_of_a_batch():
    import pyarrow as pa

    from sourceloom.functions import encoder

    texts = ["aB c", "", "c c", "x" * 50, "\u0130 a"] * 3
    for kind in (pa.string(), pa.large_string()):
        counts = encoder.slot_counts(pa.array(texts, kind), 14)
        assert [[a - b for a, b in zip(row[:7], row[7:])] for row in counts.tolist()] == [by_hand(t, 7) for t in texts]
        assert encoder.slot_counts(pa.array([""], kind), 4).tolist() == [[0, 0, 0, 0]]


def test_words_are_told_apart_by_bytes():
    import pyarrow as pa
    import pyarrow.compute as pc

    from sourceloom.functions import encoder

    every = "".join(f"x{chr(c)}y {chr(c)} " for c in range(0x250))
    texts = ["", "ab", "cd", "", "é", "éa_1,b×c", every, "x" * 9]
    for kind in (pa.string(), pa.large_string()):
        for array in (pa.array(texts, kind), pa.array(["zz", *texts], kind).slice(1)):
            words, owner = encoder.words_of(array)
            split = pc.split_pattern_regex(array, r"[^\pL\pN_]+").to_pylist()
            want = [(i, w) for i, found in enumerate(split) for w in found if w]
            assert list(zip(owner.tolist(), words.to_pylist())) == want
    assert encoder.words_of(pa.array(["", ""]))[0].to_pylist() == []
