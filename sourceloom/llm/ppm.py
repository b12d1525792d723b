"""Language-model scoring by prediction by partial matching over bytes.

The model is the trie of all byte contexts up to three bytes of the training texts. A byte
that was seen in the longest context gets n / (N + q) there, with N occurrences and q
distinct bytes of the context; else the context escapes with q / (N + q) to the next
shorter one, where the bytes seen before are excluded from all counts. As a context's
bytes are a subset of those of its suffix, the counts left after exclusion depend on the
context alone and are computed once.

A text is padded with three marks in front and one mark at its end, bytes that UTF-8
never uses; the end mark is predicted like a byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import stored, table, text_batches, whole_text
from sourceloom.llm.wordarrays import VISIBLE, word_hashes

PAD, END = 0xFE, 0xFF
SHARD_ROWS = 4_000_000  # trie rows that a pass over the texts holds
HEAD = 1_000_000  # words that make up at least this part of the training text are frequent
COUNT_BATCH, SCORE_BATCH = 2_000_000, 500_000


def contexts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end, three bytes of context and the byte in one
    32-bit number; and how many a text has."""
    frame, mark = bytes([PAD] * 3), bytes([END])
    coded = [frame + t.encode("utf-8", "replace") + mark for t in texts]
    data = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.uint32)
    code = np.zeros(len(data), dtype=np.uint32)
    for back, shift in ((3, 24), (2, 16), (1, 8), (0, 0)):
        code[3:] |= data[3 - back : len(data) - back] << np.uint32(shift)
    sizes = np.array([len(c) for c in coded])
    starts = np.cumsum(sizes) - sizes
    real = np.ones(len(data), dtype=bool)
    real[(starts[:, None] + np.arange(3)).ravel()] = False
    return code[real], sizes - 3


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


class Level:
    """Contexts of one length: log counts of their bytes, and what escapes cost."""

    def __init__(self, length: int, codes: np.ndarray, n: np.ndarray, lower: Level | None = None):
        self.codes, self.counts = codes, n
        self.log_n = np.log(n) if len(n) else n.astype(float)
        ctx = codes >> np.uint32(8)
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, dtype=np.int64)
        self.ctx = ctx[first]
        kinds = np.diff(first, append=len(ctx)).astype(float)
        total = np.add.reduceat(n, first).astype(float) if len(ctx) else kinds
        self.kinds, self.total = kinds, total
        self.whole = np.log(total + kinds)
        self.escape = np.log(kinds) - self.whole
        # What the next shorter context has left when this one's bytes are excluded.
        if lower is not None and len(ctx):
            below, _ = _find(lower.codes, codes & np.uint32((1 << 8 * length) - 1))
            gone = np.add.reduceat(lower.counts[below], first)
            up, _ = _find(lower.ctx, self.ctx & np.uint32((1 << 8 * (length - 1)) - 1))
            left_n, left_q = lower.total[up] - gone, lower.kinds[up] - kinds
            some = left_q > 0
            self.left = np.where(some, np.log(np.where(some, left_n + left_q, 1)), 0.0)
            self.left_escape = np.where(some, np.log(np.where(some, left_q, 1)) - self.left, 0.0)


class Ppm:
    """A pretrained model from counts of four-byte codes and of two-byte codes.

    The four-byte codes may be those of some contexts only, as long as all contexts with
    the same last two bytes are there; the two-byte codes are always all.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray, codes1: np.ndarray, n1: np.ndarray):
        codes0, n0 = _summed(codes1 & np.uint32(0xFF), n1)
        codes2, n2 = _summed(codes & np.uint32(0xFFFFFF), n)
        level0 = Level(0, codes0, n0)
        level1 = Level(1, codes1, n1, level0)
        level2 = Level(2, codes2, n2, level1)
        self.levels = [level0, level1, level2, Level(3, codes, n, level2)]
        rest = 256 - len(codes0)
        self.none = -math.log(rest) if rest else 0.0

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of the last bytes of codes in their contexts."""
        out = np.zeros(len(codes))
        at = np.arange(len(codes))
        whole = np.ones(len(codes), dtype=bool)  # nothing is excluded yet
        left, left_escape = np.zeros(len(codes)), np.zeros(len(codes))
        for length in (3, 2, 1, 0):
            level = self.levels[length]
            code = codes[at] & np.uint32((1 << 8 * (length + 1)) - 1)
            i, seen = _find(level.codes, code)
            hit, rest = np.flatnonzero(seen), np.flatnonzero(~seen)
            if not len(level.codes):
                continue
            j, _ = _find(level.ctx, code[hit] >> np.uint32(8))
            out[at[hit]] += level.log_n[i[hit]] - np.where(whole[hit], level.whole[j], left[hit])
            j, known = _find(level.ctx, code[rest] >> np.uint32(8))
            fresh = whole[rest]
            out[at[rest]] += np.where(fresh, np.where(known, level.escape[j], 0.0), left_escape[rest])
            if length:
                left = np.where(known, level.left[j], 0.0)
                left_escape = np.where(known, level.left_escape[j], 0.0)
            whole = fresh & ~known
            at = at[rest]
        out[at] += self.none
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 7, is 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2


def corpus_counts(training: DataFrame, text: str = "text") -> DataFrame:
    """(kind, key, n): word hashes (w) and four-byte codes (g) of all training texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in text_batches(frames, "text", COUNT_BATCH):
            texts = part["text"].tolist()
            words, n = np.unique(word_hashes(texts, VISIBLE)[0], return_counts=True)
            yield pd.DataFrame({"kind": "w", "key": words.view(np.int64), "n": n})
            codes, n = np.unique(contexts(texts)[0], return_counts=True)
            yield pd.DataFrame({"kind": "g", "key": codes.astype(np.int64), "n": n})

    counted = training.select(whole_text(text).alias("text")).mapInPandas(run, "kind string, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    frame = rows.select("key", "n").toArrow().sort_by("key")
    return frame["key"].to_numpy().astype(np.uint32), frame["n"].to_numpy().astype(np.int64)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held: Column | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the log10 probability of the text and its end under the model; the
    ``base_score`` that of its words under add-one unigrams, whose vocabulary and counts
    come from the same training documents, all that are not ``held`` out.

    Null and empty texts are scored as empty, rows stay rows, and other columns are not
    looked at. Without training documents bytes are equally likely.

    A trie of more than ``shard_rows`` rows is cut by the last two bytes of the contexts,
    and each part scores, in a pass of its own, the bytes whose context it holds. Word
    counts are joined by word; frequent words, whose number is bounded by arithmetic, are
    looked up where the text is read, so that no word is hot in the join.
    """
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    held = held_out(doc_id) if held is None else held
    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), whole_text(text).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = stored(corpus_counts(training), "counts")
    words, codes = counts.where(F.col("kind") == "w"), counts.where(F.col("kind") == "g")
    ends = training.count()
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, vocabulary = n_words + ends, distinct + (ends > 0)
    frequent = F.col("n") >= tokens / HEAD
    head = words.where(frequent).select("key", "n").toArrow().sort_by("key")
    tail = words.where(~frequent).select("key", F.log10(F.col("n") + 1).alias("log_n"))
    shared_words = spark.sparkContext.broadcast((head["key"].to_numpy(), np.log10(head["n"].to_numpy() + 1.0)))
    codes1, n1 = _arrays(codes.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(F.sum("n").alias("n")))
    shards = max(1, math.ceil(codes.count() / shard_rows))
    end_log, all_log = math.log10(ends + 1), math.log10(tokens + vocabulary + 1)

    def shard_of(code):
        """The part that holds a code: by the last two bytes of its context."""
        return (code % (1 << 24) - code % 256) // 256 * 40503 % 65536 % shards

    def shard_column(code: Column) -> Column:
        pair = F.floor(F.pmod(code, F.lit(1 << 24)) / 256)
        return F.pmod(F.pmod(pair * 40503, F.lit(65536)), F.lit(shards))

    def one_pass(shard: int, with_words: bool) -> DataFrame:
        part = codes.where(shard_column(F.col("key")) == shard) if shards > 1 else codes
        shared = spark.sparkContext.broadcast((*_arrays(part), codes1, n1))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = Ppm(*shared.value)
            known, log_n = shared_words.value
            for part in text_batches(frames, "text", SCORE_BATCH):
                texts = part["text"].tolist()
                n = len(texts)
                code, sizes = contexts(texts)
                number = np.repeat(np.arange(n), sizes)
                if shards > 1:
                    own = np.flatnonzero(shard_of(code.astype(np.int64)) == shard)
                    code, number = code[own], number[own]
                out = part[["_row", "doc_id", "held_out"]].assign(log_prob=np.bincount(number, weights=model.log_probs(code), minlength=n))
                if with_words:
                    hashes, size = word_hashes(texts, VISIBLE)
                    number = np.repeat(np.arange(n), size)
                    at, hit = _find(known, hashes.view(np.int64))
                    out["n_words"] = size
                    out["n_head"] = np.bincount(number[hit], minlength=n)
                    out["head"] = np.bincount(number[hit], weights=log_n[at[hit]] if len(log_n) else None, minlength=n).astype(float)
                    out["rare"] = np.split(hashes.view(np.int64)[~hit], np.cumsum(size - out["n_head"].to_numpy())[:-1])
                else:
                    out["n_words"], out["n_head"], out["head"], out["rare"] = 0, 0, 0.0, None
                yield out

        schema = f"_row long, doc_id {kind}, held_out boolean, log_prob double, n_words long, n_head long, head double, rare array<long>"
        return numbered.mapInPandas(run, schema)

    # With several passes a row's number ties them together, so it must not change between them.
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    if shards > 1:
        numbered = stored(numbered, "numbered")
    base = stored(one_pass(0, True), "scored")
    log_prob = base.select("_row", "log_prob")
    for shard in range(1, shards):
        log_prob = log_prob.unionByName(one_pass(shard, False).select("_row", "log_prob"))
    asked = base.select("_row", F.explode("rare").alias("key"))
    more = asked.join(tail, "key").groupBy("_row").agg(F.sum("log_n").alias("more"), F.count("*").alias("n_more"))
    scored = base.drop("rare").join(more, "_row", "left")
    if shards > 1:
        scored = scored.drop("log_prob").join(log_prob.groupBy("_row").agg(F.sum("log_prob").alias("log_prob")), "_row")
    n_tokens = F.col("n_words") + 1
    return scored.select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("n_head") + F.coalesce("n_more", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head") + F.coalesce("more", F.lit(0.0)) + end_log - n_tokens * all_log).alias("base_score"),
        (F.col("log_prob") / math.log(10)).alias("score"),
    )


def op6_ppm_score(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
