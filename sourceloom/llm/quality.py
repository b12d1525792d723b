"""Quality classifier: interpolated modified Kneser-Ney trigrams of trusted text.

The log-probability of a text is a sum over its n-grams. For each word it is the log of its
unigram probability, plus for each longer n-gram the log of what its presence in the model
changes, plus the back-off weights of the contexts. So each n-gram of the model has one
weight, and the score of a document is a join of its n-grams with the weights and a sum.
The join is sharded by n-gram. Two things keep it small: weights of frequent n-grams, whose
number is bounded by arithmetic, are applied where the text is read, and a Bloom filter of
bounded size holds back n-grams that the model does not know. The model is as large as the
trusted text makes it: it stays in tables, and neither the driver nor a task holds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.common import discard, row_key, shuffles_freed, stored, table, text_batches, whole_text
from sourceloom.llm.wordarrays import MULTIPLIER, VISIBLE, mixed, word_hashes
from sourceloom.operators.keyfilter import might_match
from sourceloom.operators.sizing import BROADCAST_ROWS

HEAD = 400_000  # n-grams that make up at least this part of the trusted text are frequent
QUANTILE = 0.995
BOS, EOS = np.uint64(1), np.uint64(2)
BATCH = 500_000
PARTS = 2  # of the rows, which are scored one after the other
BLOOM_WORDS = 1 << 22  # 64-bit words of the filter, at most
BLOOM_CHUNK = 1 << 16  # of them in one row


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The three words that end at each event (two before it and the event), and text numbers.

    Each text is framed by two start marks and an end mark, which is an event too.
    """
    hashes, counts = word_hashes(texts, VISIBLE)
    n = len(texts)
    number = np.repeat(np.arange(n), counts + 1)
    words = np.empty(len(hashes) + 3 * n, dtype=np.uint64)
    starts = np.cumsum(counts + 3) - (counts + 3)
    words[starts] = words[starts + 1] = BOS
    words[starts + counts + 2] = EOS
    inside = np.ones(len(words), dtype=bool)
    inside[starts] = inside[starts + 1] = inside[starts + counts + 2] = False
    words[inside] = hashes
    at = np.ones(len(words), dtype=bool)
    at[starts] = at[starts + 1] = False
    at = np.flatnonzero(at)
    return words[at - 2], words[at - 1], words[at], number


def keys_of(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Keys of the unigrams, bigrams and trigrams that end at each event."""
    one = mixed(w * MULTIPLIER + np.uint64(11))
    two = mixed(one + v * MULTIPLIER + np.uint64(22))
    return [one, two, mixed(two + u * MULTIPLIER + np.uint64(33))]


# -- training -----------------------------------------------------------------------


def trigram_counts(trusted: DataFrame, text: str = "text") -> DataFrame:
    """(u, v, w, n) of all events of the trusted texts; hashes as signed longs."""

    def run(frames):
        for part in text_batches(frames, "text", BATCH):
            u, v, w, _ = grams(part["text"].tolist())
            rows, n = np.unique(np.stack([u, v, w], axis=1), axis=0, return_counts=True)
            rows = rows.view(np.int64)
            yield pd.DataFrame({"u": rows[:, 0], "v": rows[:, 1], "w": rows[:, 2], "n": n})

    counted = trusted.select(whole_text(text).alias("text")).mapInPandas(run, "u long, v long, w long, n long")
    return counted.groupBy("u", "v", "w").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame, n: str) -> list[float]:
    """D1, D2 and D3+ of modified Kneser-Ney from the counts of counts."""
    found = {r[0]: r[1] for r in counts.where(F.col(n) <= 4).groupBy(n).count().collect()}
    n1, n2, n3, n4 = (found.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw)]


def _discounted(n: str, d: list[float]):
    return F.when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])


def ngram_weights(counts: DataFrame) -> tuple[DataFrame, dict, tuple[DataFrame, ...]]:
    """The additive weights of all n-grams, (k, u, v, w, weight, n), the constants, and the
    stored tables that the weights are read from.

    Trigrams meet their contexts and the shorter n-grams one after the other, in stored
    steps, so that the shuffles of one step alone are on disk.

    ``n`` is how often the n-gram ends in the training text. The constants are the
    log-probability of an unknown word and the back-off weights of the start.
    """
    tri = stored(counts, "trigrams")
    bi = stored(tri.groupBy("v", "w").agg(F.count("*").alias("n"), F.sum("n").alias("seen")), "bigrams")
    uni = stored(bi.groupBy("w").agg(F.count("*").alias("n"), F.sum("seen").alias("seen")), "unigrams")
    d1, d2, d3 = discounts(uni, "n"), discounts(bi, "n"), discounts(tri, "n")
    kinds, total, lost = uni.agg(F.count("*"), F.sum("n"), F.sum(_discounted("n", d1))).first()
    unknown = (lost / total) / (kinds + 1)
    # Tables of words; of few, they go to the n-grams.
    small = F.broadcast if kinds < BROADCAST_ROWS else lambda rows: rows
    p1 = small(uni.select("w", ((F.col("n") - _discounted("n", d1)) / total + unknown).alias("p1"), "seen"))
    c1 = bi.groupBy("v").agg(F.sum("n").alias("t1"), F.sum(_discounted("n", d2)).alias("l1"))
    c1 = small(c1.select("v", "t1", (F.col("l1") / F.col("t1")).alias("b1")))
    p2 = bi.join(c1, "v").join(p1.select("w", "p1"), "w")
    p2 = p2.select("v", "w", "b1", "p1", "seen", ((F.col("n") - _discounted("n", d2)) / F.col("t1") + F.col("b1") * F.col("p1")).alias("p2"))
    c2 = tri.groupBy("u", "v").agg(F.sum("n").alias("t2"), F.sum(_discounted("n", d3)).alias("l2"))
    c2 = stored(c2.select("u", "v", "t2", (F.col("l2") / F.col("t2")).alias("b2")), "contexts")
    own = ((F.col("n") - _discounted("n", d3)) / F.col("t2")).alias("own")
    met = stored(tri.join(c2, ["u", "v"]).select("u", "v", "w", F.col("n").alias("seen"), "b2", own), "met-contexts")
    events = tri.agg(F.sum("n")).first()[0]
    discard(tri)
    p3 = met.join(p2.select("v", "w", "p2"), ["v", "w"])
    p3 = p3.select("u", "v", "w", "seen", "b2", "p2", (F.col("own") + F.col("b2") * F.col("p2")).alias("p3"))
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    one = p1.join(c1.withColumnRenamed("v", "w"), "w", "left").select(
        F.lit(1).alias("k"), none.alias("u"), none.alias("v"), "w", (F.log("p1") - math.log(unknown) + F.coalesce(F.log("b1"), zero)).alias("weight"), "seen"
    )
    ends = c2.select(F.col("u").alias("v"), F.col("v").alias("w"), "b2")
    two = p2.join(ends, ["v", "w"], "left").select(
        F.lit(2).alias("k"), none.alias("u"), "v", "w", (F.log(F.col("p2") / (F.col("b1") * F.col("p1"))) + F.coalesce(F.log("b2"), zero)).alias("weight"), "seen"
    )
    three = p3.select(F.lit(3).alias("k"), "u", "v", "w", F.log(F.col("p3") / (F.col("b2") * F.col("p2"))).alias("weight"), "seen")
    mark = int(BOS)
    start = c1.where(F.col("v") == mark).select(F.log("b1").alias("b")).unionByName(c2.where((F.col("u") == mark) & (F.col("v") == mark)).select(F.log("b2").alias("b")))
    constants = {"unknown": math.log(unknown), "start": start.agg(F.sum("b")).first()[0] or 0.0, "events": events}
    return one.unionByName(two).unionByName(three), constants, (met, c2, bi, uni)


def keyed_weights(weights: DataFrame) -> DataFrame:
    """(key, weight, seen) with the keys that texts are looked up by."""

    def run(frames):
        for f in frames:
            u, v, w = (f[c].to_numpy().astype(np.int64).view(np.uint64) for c in "uvw")
            keys = np.choose(f["k"].to_numpy() - 1, keys_of(u, v, w)) if len(f) else np.zeros(0, np.uint64)
            yield pd.DataFrame({"key": keys.view(np.int64), "weight": f["weight"], "seen": f["seen"]})

    return weights.mapInPandas(run, "key long, weight double, seen long")


class Bloom:
    """One 64-bit word per key with five bits set; about 32 bits a key until ``BLOOM_WORDS``."""

    def __init__(self, words: int):
        self.size = np.uint64(max(1, words))
        self.bits = np.zeros(int(self.size), dtype=np.uint64)

    def add(self, keys: np.ndarray) -> None:
        place, pattern = self._of(keys)
        np.bitwise_or.at(self.bits, place, pattern)

    def _of(self, keys):
        pattern = np.zeros(len(keys), dtype=np.uint64)
        for shift in (0, 6, 12, 18, 24):
            pattern |= np.uint64(1) << ((keys >> np.uint64(shift)) & np.uint64(63))
        return ((keys >> np.uint64(30)) % self.size).astype(np.int64), pattern

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        place, pattern = self._of(keys)
        return (self.bits[place] & pattern) == pattern


def filter_of(keys: DataFrame) -> Bloom:
    """The filter of a column ``key``. Tasks fill filters of their own, as many as there are
    cores; these are united chunk by chunk, and the driver sees the united chunks alone."""
    size = min(BLOOM_WORDS, keys.count() // 2)
    schema = pa.schema([("chunk", pa.int32()), ("bits", pa.binary())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(size)
        for batch in batches:
            own.add(batch["key"].to_numpy(zero_copy_only=False).view(np.uint64))
        for chunk, at in enumerate(range(0, len(own.bits), BLOOM_CHUNK)):
            bits = own.bits[at : at + BLOOM_CHUNK]
            if bits.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([bits.tobytes()])], schema=schema)

    def unite(rows: pa.Table) -> pa.Table:
        bits = [np.frombuffer(b, np.uint64) for b in rows["bits"].to_pylist()]
        return pa.table([rows["chunk"][:1], pa.array([np.bitwise_or.reduce(bits).tobytes()])], schema=schema)

    few = keys.select("key").coalesce(keys.sparkSession.sparkContext.defaultParallelism)
    with shuffles_freed(keys.sparkSession):
        rows = few.mapInArrow(fill, "chunk int, bits binary").groupBy("chunk").applyInArrow(unite, "chunk int, bits binary").toArrow()
    bloom = Bloom(size)
    for row in rows.to_pylist():
        bits, at = np.frombuffer(row["bits"], np.uint64), row["chunk"] * BLOOM_CHUNK
        bloom.bits[at : at + len(bits)] = bits
    return bloom


# -- scoring -----------------------------------------------------------------------------


def perplexities(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", trusted_text: str = "text") -> DataFrame:
    """(_key, doc_id, lang, n_words, log_prob, perplexity) per row of ``docs``; for ``_key`` see ``row_key``.

    All of ``trusted`` is counted. Without trusted rows the perplexity is null. Null and empty texts consist of the end mark alone. Rows stay rows.
    """
    spark = docs.sparkSession
    counts = trigram_counts(trusted, trusted_text)
    kind = docs.schema[doc_id].dataType.simpleString()
    named = [F.to_json(row_key(doc_id, text)).alias("_key"), F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang")]
    keyed = docs.select(*named, whole_text(text).alias("text"))
    if trusted.isEmpty():
        none = F.lit(None).cast("double")
        return keyed.select("_key", "doc_id", "lang", F.lit(None).cast("long").alias("n_words"), none.alias("log_prob"), none.alias("perplexity"))
    weights, constants, tables = ngram_weights(counts)
    longest = F.col("k") == 3
    parts = [stored(keyed_weights(weights.where(which)), "weights") for which in (longest, ~longest)]
    weights = parts[0].unionByName(parts[1])
    discard(*tables)
    frequent = F.col("seen") >= constants["events"] / HEAD
    head = weights.where(frequent).select("key", "weight").toArrow().sort_by("key")
    tail = weights.where(~frequent).select("key", "weight")
    shared = spark.sparkContext.broadcast((head["key"].to_numpy(), head["weight"].to_numpy(), filter_of(tail)))
    unknown, start = constants["unknown"], constants["start"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, value, bloom = shared.value
        for part in text_batches(frames, "text", BATCH):
            texts = part["text"].tolist()
            u, v, w, number = grams(texts)
            n = len(texts)
            events = np.bincount(number, minlength=n)
            total = events * unknown + start
            missed, owner = [], []
            shorter = np.ones(len(w), dtype=bool)  # only what ends in a known n-gram can be known
            for keys in keys_of(u, v, w):
                signed = keys.view(np.int64)
                at = np.minimum(np.searchsorted(known, signed), len(known) - 1) if len(known) else np.zeros(len(keys), dtype=np.int64)
                hit = known[at] == signed if len(known) else np.zeros(len(keys), dtype=bool)
                total += np.bincount(number[hit], weights=value[at[hit]], minlength=n) if hit.any() else 0.0
                rest = np.flatnonzero(~hit & shorter)
                rest = rest[bloom.might_hold(keys[rest])]
                shorter = hit
                shorter[rest] = True
                missed.append(signed[rest])
                owner.append(number[rest])
            missed, owner = np.concatenate(missed), np.concatenate(owner)
            rows = part["_row"].to_numpy()
            yield part[["_row", "_key", "doc_id", "lang"]].assign(key=mixed(rows.astype(np.uint64)).view(np.int64), events=events, head=total)
            for at in range(0, len(missed), BATCH):
                some = slice(at, at + BATCH)
                yield pd.DataFrame({"_row": rows[owner[some]], "key": missed[some]}).assign(**nothing)

    # One stream carries the rows and, behind each, the n-grams that are still to be looked
    # up: (_row, key) with nothing else. So each part of the texts is read once and no n-gram is stored.
    schema = f"_row long, key long, _key string, doc_id {kind}, lang string, events long, head double"
    nothing = dict.fromkeys(("_key", "doc_id", "lang", "events", "head"))
    own = F.struct("_key", "doc_id", "lang", "events", "head")
    tail = tail.withColumnRenamed("key", "known")

    def summed(some: DataFrame) -> DataFrame:
        numbered = some.withColumn("_row", F.monotonically_increasing_id())
        dealt = numbered.mapInPandas(run, schema).select("_row", "key", F.when(F.col("events").isNotNull(), own).alias("own"))
        met = dealt.join(tail, (F.col("key") == F.col("known")) & F.col("own").isNull(), "left")
        return met.groupBy("_row").agg(F.first("own", ignorenulls=True).alias("own"), F.sum("weight").alias("more")).select("own.*", "more")

    # The n-grams of a part of the rows are on disk at a time.
    part = F.pmod(F.xxhash64("_key"), F.lit(PARTS))
    done = [stored(summed(keyed.where(part == i)), "scores") for i in range(PARTS)]
    discard(*parts)
    scored = reduce(DataFrame.unionByName, done)
    log_prob = F.col("head") + F.coalesce("more", F.lit(0.0))
    return scored.select("_key", "doc_id", "lang", (F.col("events") - 1).alias("n_words"), log_prob.alias("log_prob"), F.exp(-log_prob / F.col("events")).alias("perplexity"))


def texts_of(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_id, text, ..) of the documents whose id is among the distinct ids, with their columns.

    Texts stay where they are beside ids that may be broadcast; of more, a filter drops most
    other texts before they move.
    """
    rows, n = docs.select(docs[doc_id].alias("_id"), whole_text(text).alias("text")), ids.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ids), "_id")
    if rows.schema["_id"].dataType == ids.schema["_id"].dataType:  # others have other hashes
        rows = might_match(rows, ids, ["_id"], n)
    return rows.join(ids, "_id")


def trusted_split(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", fit_docs: int | None = None, fit_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts to fit on, and the ids of trusted documents held out to calibrate.

    Documents labelled as good are trusted. Half of them by hash are held out; all others are
    fitted on, whatever their number. Whoever wants a smaller model may ask for the
    ``fit_docs`` with the smallest hashes, and for those that in this order have ``fit_chars``
    characters; whole texts are used, at least one.
    """
    good = labels.where(F.col(quality) == 1).select(F.col(doc_id).alias("_id")).distinct()
    good = good.withColumn("_hash", F.xxhash64(F.col("_id").cast("string")))
    fit = good.where(F.col("_hash") % 2 == 0)
    if fit_docs is not None:
        fit = fit.orderBy("_hash").limit(fit_docs)
    texts = texts_of(docs, fit, doc_id, text)
    if fit_chars is not None:
        # On demand only: one window holds the lengths.
        before = F.sum(F.length("text")).over(Window.orderBy("_hash", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1))
        texts = texts.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < fit_chars)
    return texts.select("text"), good.where(F.col("_hash") % 2 != 0).select("_id")


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, fit_docs: int | None = None) -> DataFrame:
    """(_key, doc_id, lang, n_words, log_prob, perplexity, threshold, keep) per row of ``docs``.

    The threshold of a language is a quantile of the perplexity of held-out trusted
    documents of that language, however few they are; rows without a language are one
    language. Texts above it are rejected. A language without held-out trusted documents
    has a null threshold and is kept whole, as is everything where no document is labelled
    as good. Labels of which none names a document of a non-empty table raise ValueError.
    Where no document of the half to fit on is there, the other half is fitted on as well.
    Rows stay rows, null ids and repeated rows included.
    """
    trusted, held_out = trusted_split(docs, labels, doc_id, text, fit_docs=fit_docs)
    if trusted.isEmpty() and not held_out.isEmpty():
        some = held_out if fit_docs is None else held_out.orderBy(F.xxhash64(F.col("_id").cast("string"))).limit(fit_docs)
        trusted = texts_of(docs, some, doc_id, text).select("text")
    if trusted.isEmpty() and not docs.isEmpty() and not labels.where("quality = 1").isEmpty():
        raise ValueError("no document that is labelled as good is in the table")
    scores = perplexities(docs, trusted, doc_id, text, lang)
    judged = stored(scores.withColumn("_lang", F.coalesce("lang", F.lit(""))), "judged")
    known = judged.join(held_out, F.col("doc_id") == F.col("_id"), "left_semi")
    at = F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")
    limits = known.groupBy("_lang").agg(at)
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return judged.join(limits, "_lang", "left").select("_key", "doc_id", "lang", "n_words", "log_prob", "perplexity", "threshold", keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs``, with all columns, that the classifier keeps."""
    rejected = judge(docs, labels, doc_id, text, lang, quantile).where(~F.col("keep")).select(F.col("_key").alias("_rejected"))
    rejected = rejected.distinct()
    return docs.join(rejected, F.to_json(row_key(doc_id, text)) == rejected["_rejected"], "left_anti")


def op7_kneser_ney(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("_key", "lang")
