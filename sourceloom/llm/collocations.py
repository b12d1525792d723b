"""Phrase collocations from weighted acyclic automata.

Tasks count the n-grams of their texts and pass them on sorted. Ranges of prefixes then
bring the shards together, where equal n-grams are summed, and an automaton is built from
the sorted sums of each range: a transducer from word sequences to counts. The counts of the
parts of a candidate come from composing the parts with the automata of their ranges.

Lengths are counted one after the other. An n-gram can occur ``least`` times only if both
n-grams that are one word shorter do, so that longer ones are counted where these are
frequent. A Bloom filter of fixed size tells tasks which are; what it lets through besides
is counted in vain, and dropped by its sum.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import stored, table, whole_text
from sourceloom.llm.wordarrays import MULTIPLIER, mixed
from sourceloom.operators.ranking import top_n

LONGEST = 3
LEAST = 10
TOP = 2000
INSIDE = 50  # per cent of a candidate's count that a longer one around it must have to replace it
SCALE = 1_000_000
OCCURRENCES = 8_000_000  # words that a task holds before it passes on their counts
VOCABULARY = 1_000_000  # below 2^21, so that three words make a 63-bit code
ROWS = 65_536
FILTER_SLOTS = 1 << 20  # 64-bit words of a filter, at most
RANGE = 200_000  # n-grams of an automaton
LOOKUPS = 200_000  # parts that one task composes with an automaton
_SEPARATORS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_BREAK = b"\n"
# Products of two counts pass 64 bits; decimals of up to 38 digits hold them.
SCORE = f"({SCALE}BD * CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"


def word_names(longest: int) -> list[str]:
    return [f"w{i}" for i in range(1, longest + 1)]


class _Numbers(dict):
    """Numbers for words as they come."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


class Counted:
    """Words of one language that a task has read and not passed on yet."""

    def __init__(self, lang: str):
        self.lang = lang
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers({b"": 0, _BREAK: 1})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[str]) -> None:
        data = _BREAK.join(t.encode("utf-8", "replace") for t in texts) + _BREAK
        words = data.lower().translate(_SEPARATORS).replace(_BREAK, b" \n ").split(b" ")
        found = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int64, count=len(words))
        found = found[found != 0]
        self.parts.append(found)
        self.size += len(found)

    def ngrams(self, k: int, known: Filter | None) -> Iterator[pa.RecordBatch]:
        """The n-grams of ``k`` words with their counts, in the order of their words."""
        if not self.size:
            return
        words = list(self.numbers)
        order = sorted(range(2, len(words)), key=words.__getitem__)
        rank = np.zeros(len(words), dtype=np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        text = np.concatenate([rank[p] for p in self.parts])  # 0 between pieces
        names = pa.array([words[i] for i in order], pa.binary()).cast(pa.string())
        inside = text > 0
        n = len(text) - k + 1
        if n <= 0:
            return
        good = reduce(np.logical_and, [inside[j : j + n] for j in range(k)])
        if known is not None:
            hashes = np.concatenate([np.zeros(1, dtype=np.uint64), word_codes(words[i] for i in order)])
            shorter = known.might_hold(gram_codes(self.lang, [hashes[text[j : j + n + 1]] for j in range(k - 1)]))
            good &= shorter[:n] & shorter[1 : n + 1]
        at = np.flatnonzero(good)
        code = np.zeros(len(at), dtype=np.int64)
        for j in range(k):
            code = code * (len(order) + 1) + text[at + j]
        code, counts = np.unique(code, return_counts=True)
        for some in range(0, len(code), ROWS):
            rest, columns = code[some : some + ROWS], []
            for _ in range(k):
                rest, number = np.divmod(rest, len(order) + 1)
                columns.append(names.take(pa.array(number - 1)))
            gram = pc.binary_join_element_wise(*columns[::-1], "\t")
            gram = pc.binary_join_element_wise(gram, pa.scalar(self.lang, pa.string()), " ")
            yield pa.RecordBatch.from_arrays([gram, pa.array(counts[some : some + ROWS])], names=["gram", "n"])


def shard_ngrams(texts: DataFrame, k: int, known: Filter | None = None) -> DataFrame:
    """(gram, n): counts of n-grams of ``k`` words, sorted within what a task passes on.

    A gram is its words with tabs between, a space and the language: neither stands in a word.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counted] = {}
        filter_ = shared.value if shared is not None else None
        for batch in batches:
            of: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                of.setdefault(lang, []).append(text)
            for lang, some in of.items():
                for text in in_runs(some):
                    counted = held.setdefault(lang, Counted(lang))
                    counted.add(text)
                    if len(counted.numbers) > VOCABULARY:
                        yield from counted.ngrams(k, filter_)
                        counted.clear()
            if sum(c.size for c in held.values()) > OCCURRENCES:
                for counted in held.values():
                    yield from counted.ngrams(k, filter_)
                held.clear()
        for counted in held.values():
            yield from counted.ngrams(k, filter_)

    return texts.mapInArrow(run, "gram string, n long")


def in_runs(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    """Texts in runs of about so many characters, or one longer text."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


# -- which n-grams are frequent -------------------------------------------------------------


def word_codes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64)


def gram_codes(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """Codes of n-grams from the codes of their words, column by column."""
    h = np.full(len(words[0]), xxhash.xxh64_intdigest(lang.encode()), dtype=np.uint64)
    for w in words:
        h = mixed(h * MULTIPLIER + w)
    return h


class Filter:
    """A Bloom filter of bounded size: one 64-bit word per key, four bits of it set."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(codes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
        pattern = np.zeros(len(codes), dtype=np.uint64)
        for shift in (0, 6, 12, 18):
            pattern |= np.uint64(1) << ((codes >> np.uint64(shift)) & np.uint64(63))
        return ((codes >> np.uint64(24)) % np.uint64(slots)).astype(np.int64), pattern

    def might_hold(self, codes: np.ndarray) -> np.ndarray:
        place, pattern = self.places(codes, len(self.bits))
        return (self.bits[place] & pattern) == pattern


def frequent_filter(grams: DataFrame, k: int) -> Filter:
    """The filter of a table (lang, w1..wk): set bits are joined by Spark, and the driver
    receives at most ``FILTER_SLOTS`` words. The fuller it is, the less it holds back."""
    slots = int(min(FILTER_SLOTS, max(1024, grams.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(slots, dtype=np.uint64)
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            words = [word_codes(w.encode() for w in batch.column(c).to_pylist()) for c in word_names(k)]
            for lang in set(langs):
                here = np.flatnonzero(langs == lang)
                place, pattern = Filter.places(gram_codes(lang, [w[here] for w in words]), slots)
                np.bitwise_or.at(bits, place, pattern)
        set_ = np.flatnonzero(bits)
        yield pa.RecordBatch.from_pydict({"slot": set_, "bits": bits[set_].view(np.int64)})

    parts = grams.mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(slots, dtype=np.uint64)
    bits[parts["slot"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
    return Filter(bits)


def frequent_ngrams(texts: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, w1.., n) of all n-grams of up to ``longest`` words that occur ``least`` times,
    missing words null, and (lang, n) with the number of all words.

    Shards meet by range of their words; a word, or a prefix, that makes up much of the
    text is spread over several ranges, and one n-gram has a row per shard at most.
    """
    names, known, levels, totals = word_names(longest), None, [], None
    for k in range(1, longest + 1):
        # Nearly all grams are distinct, so that dictionaries would be built in vain.
        shards = stored(shard_ngrams(texts, k, known), "shards", **{"parquet.enable.dictionary": "false"})
        sums = shards.repartitionByRange("gram").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        words = F.split(F.substring_index("gram", " ", 1), "\t")
        lang = F.expr("substr(gram, instr(gram, ' ') + 1)").alias("lang")
        grams = stored(sums.select(lang, *[words[i].alias(w) for i, w in enumerate(names[:k])], "n"), "ngrams")
        if totals is None:
            totals = stored(shards.select(lang, "n").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        if k < longest:
            known = frequent_filter(grams, k)
        missing = [F.lit(None).cast("string").alias(w) for w in names[k:]]
        levels.append(grams.select("lang", *names[:k], *missing, "n"))
    return reduce(DataFrame.unionByName, levels), totals


# -- automata -----------------------------------------------------------------------------------


class Builder:
    """A minimal acyclic transducer, built incrementally from sorted word sequences.

    States that nothing can be added to any more are looked up among the finished ones and
    shared if they are equal. The weight of an arc is the count of the sequence that ends
    with it, 0 if that is not counted here.
    """

    def __init__(self):
        self.labels = _Numbers()
        self.states: list[tuple] = []
        self.finished: dict[tuple, int] = {}
        self.open: list[list] = [[]]  # arcs [label, weight, target] of the states of the last sequence
        self.last: tuple = ()
        self.size = 0

    def _freeze(self, depth: int) -> None:
        while len(self.open) > depth + 1:
            arcs = tuple(map(tuple, self.open.pop()))
            state = self.finished.get(arcs)
            if state is None:
                state = self.finished[arcs] = len(self.states)
                self.states.append(arcs)
            self.open[-1][-1][2] = state

    def add(self, words: tuple, n: int) -> None:
        """``words`` must come after all that were added before."""
        if words <= self.last:
            raise ValueError("sequences must come in order")
        common = 0
        while common < len(self.last) and self.last[common] == words[common]:
            common += 1
        self._freeze(common)
        for word in words[common:]:
            self.open[-1].append([self.labels[word], 0, -1])
            self.open.append([])
        self.open[-2][-1][1] = n
        self.last = words
        self.size += 1

    def finish(self) -> dict:
        """Arrays of the arcs, in the order of state and label, and the labels by number."""
        self._freeze(0)
        self.states.append(tuple(map(tuple, self.open[0])))
        arcs = sorted((s, *arc) for s, out in enumerate(self.states) for arc in out)
        state, label, weight, target = (list(c) for c in zip(*arcs)) if arcs else ([], [], [], [])
        return {"start": len(self.states) - 1, "labels": list(self.labels), "state": state, "label": label, "weight": weight, "target": target}


AUTOMATON = "cell long, start int, labels array<string>, state array<int>, label array<int>, weight array<long>, target array<int>"


def composed(automaton: dict, sequences: list[np.ndarray]) -> np.ndarray:
    """The weights of many word sequences, given by column with None behind their ends; 0 if absent."""
    number = {w: i for i, w in enumerate(automaton["labels"])}
    width = len(number) + 1
    arcs = np.asarray(automaton["state"], dtype=np.int64) * width + np.asarray(automaton["label"], dtype=np.int64)
    weight, target = np.asarray(automaton["weight"], dtype=np.int64), np.asarray(automaton["target"], dtype=np.int64)
    n = len(sequences[0])
    out = np.zeros(n, dtype=np.int64)
    at, state = np.arange(n), np.full(n, automaton["start"], dtype=np.int64)
    for column in sequences:
        words = column[at]
        ends = np.array([w is None for w in words], dtype=bool)
        at, state, words = at[~ends], state[~ends], words[~ends]
        if not len(at):
            break
        label = np.array([number.get(w, -1) for w in words], dtype=np.int64)
        key = state * width + label
        arc = np.minimum(np.searchsorted(arcs, key), max(len(arcs) - 1, 0))
        hit = (label >= 0) & (arcs[arc] == key) if len(arcs) else np.zeros(len(at), dtype=bool)
        out[at[~hit]] = 0
        at, state = at[hit], target[arc[hit]]
        out[at] = weight[arc[hit]]
    return out


def automata(grams: DataFrame, longest: int) -> DataFrame:
    """(lang, w1.., cell, start, labels, ...): one automaton per range of sorted n-grams of a language.

    The words are those of the first n-gram of the range, and ``cell`` is its number.
    """
    names = word_names(longest)
    key = ["lang", *names]

    def row(cell: int, lang: str, first: tuple, builder: Builder) -> pd.DataFrame:
        padded = dict(zip(names, [*first, *[None] * (longest - len(first))]))
        return pd.DataFrame([{"lang": lang, **padded, "cell": cell, **builder.finish()}])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lang, first, builder = None, (), Builder()
        cell = TaskContext.get().partitionId() << 32
        for frame in frames:
            for values in zip(*[frame[c].tolist() for c in [*key, "n"]]):
                words = tuple(w for w in values[1:-1] if w is not None)
                if values[0] != lang or builder.size >= RANGE:
                    if builder.size:
                        yield row(cell, lang, first, builder)
                        cell += 1
                    lang, first, builder = values[0], words, Builder()
                builder.add(words, values[-1])
        if builder.size:
            yield row(cell, lang, first, builder)

    ordered = grams.select(*key, "n").repartitionByRange(*key).sortWithinPartitions(*key)
    words = "".join(f"{w} string, " for w in names)
    return ordered.mapInPandas(run, f"lang string, {words}{AUTOMATON}")


def part_counts(candidates: DataFrame, machines: DataFrame, longest: int) -> DataFrame:
    """(lang, w1.., a, k, side, f): the count of each part of each candidate.

    ``k`` is the number of words before the cut and ``side`` 0 for the part before it. A part
    belongs to one range; its bounds, one row per automaton, are all that the driver sees.
    Parts that many candidates have go to several tasks, each with a copy of the automaton.
    """
    names = word_names(longest)
    key = ["lang", *names]
    none = F.lit(None).cast("string")
    size = reduce(lambda x, y: x + y, [F.col(w).isNotNull().cast("int") for w in names])

    def part(k: int, side: int) -> Column:
        picked = names[:k] if side == 0 else names[k:]
        return F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), *[(F.col(picked[i]) if i < len(picked) else none).alias(f"p{i + 1}") for i in range(longest)])

    cuts = F.array(*[part(k, side) for k in range(1, longest) for side in (0, 1)])
    parts = candidates.select(*key, "a", F.explode(F.filter(cuts, lambda p: p["k"] < size)).alias("_p")).select(*key, "a", "_p.*")
    bounds = sorted((r["lang"], *[r[w] or "" for w in names], r["cell"]) for r in machines.select(*key, "cell").collect())
    lows, cells = [b[:-1] for b in bounds], [b[-1] for b in bounds]
    places = [f"p{i + 1}" for i in range(longest)]
    schema = "".join(f"{c} string, " for c in key) + "a long, k int, side int, " + "".join(f"{p} string, " for p in places)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = zip(frame["lang"], *[frame[p].fillna("") for p in places])
            yield frame.assign(cell=[cells[bisect_right(lows, one) - 1] for one in asked])

    routed = stored(parts.mapInPandas(route, schema + "cell long"), "parts")
    copies = {r["cell"]: -(-r["count"] // LOOKUPS) for r in routed.groupBy("cell").count().collect()}
    spread = F.create_map(*[F.lit(x) for pair in copies.items() for x in pair]) if copies else F.create_map(F.lit(0).cast("long"), F.lit(1))
    salted = routed.withColumn("salt", F.pmod(F.xxhash64(*key, "k"), spread[F.col("cell")]).cast("int"))
    last = (spread[F.col("cell")] - 1).cast("int")
    dealt = machines.where(last.isNotNull()).select(*[c.split()[0] for c in AUTOMATON.split(", ")], F.explode(F.sequence(F.lit(0), last)).alias("salt"))

    def compose(asked: pd.DataFrame, machine: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(machine):
            return pd.DataFrame(columns=[*key, "a", "k", "side", "f"])
        columns = [asked[p].astype(object).where(asked[p].notna(), None).to_numpy() for p in places]
        return asked[[*key, "a", "k", "side"]].assign(f=composed(machine.iloc[0].to_dict(), columns))

    met = salted.groupBy("cell", "salt").cogroup(dealt.groupBy("cell", "salt"))
    return met.applyInPandas(compose, "".join(f"{c} string, " for c in key) + "a long, k int, side int, f long")


# -- collocations -----------------------------------------------------------------------------------


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Words are lower-cased in A-Z and stand in pieces between ``. , ; : ! ?`` and line ends.
    A candidate has 2 to ``longest`` (at most three) words and occurs ``a >= least`` times.
    The cut with the lowest score floor(1000000 a^2 / (l r)) counts, the earliest of equal
    ones. A candidate is dropped if a longer one that holds it has ``inside`` per cent of its
    count. To look at the candidates with one word more is enough for that: whatever
    a longer one drops, its part with one word more drops too.

    Null texts are empty, a null language is ``und``; texts without words count nothing, and
    empty tables give no rows. Repeated rows count each time. Other columns are not looked at.
    """
    if not 2 <= longest <= 3:
        raise ValueError("phrases have two or three words at most")
    names = word_names(longest)
    key = ["lang", *names]
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), whole_text(text).alias("text"))
    grams, totals = frequent_ngrams(texts, longest, least)
    machines = stored(automata(grams, longest), "automata")
    candidates = grams.where(F.col("w2").isNotNull()).withColumnRenamed("n", "a")
    counted = stored(part_counts(candidates, machines, longest), "part-counts")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    cuts = counted.groupBy(*key, "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    scored = cuts.withColumn("score", F.expr(SCORE))
    lowest = scored.groupBy(*key, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_c")).select(*key, "a", "_c.score", "_c.l", "_c.r")
    # The parts that leave out one word at an end are the candidates inside.
    size = reduce(lambda x, y: x + y, [F.col(w).isNotNull().cast("int") for w in names])
    first, rest = (F.col("side") == 0) & (F.col("k") == size - 1), (F.col("side") == 1) & (F.col("k") == 1)
    shorter = [F.when(first, F.when(F.lit(i + 1) < size, F.col(w))).otherwise(F.col(names[i + 1]) if i + 1 < longest else F.lit(None)).alias(w) for i, w in enumerate(names)]
    replaced = counted.where((size > 2) & (first | rest) & (F.col("a") * 100 >= F.col("f") * inside)).select("lang", *shorter).distinct()
    same = reduce(lambda x, y: x & y, [lowest[c].eqNullSafe(replaced[c]) for c in key])
    left = lowest.join(replaced, same, "left_anti")
    phrases = left.select("lang", F.concat_ws(" ", *names).alias("phrase"), "a", "l", "r", "score")
    ranked = top_n(phrases, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_collocation_automata(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k) ks)
  GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM grams WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.*, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.j, x.f AS l, y.f AS r,
         (1000000::HUGEINT * c.a::HUGEINT * c.a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.head JOIN grams y ON y.lang = c.lang AND y.phrase = c.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_parts AS (
  SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
  FROM candidates WHERE k = 3),
dropped AS (
  SELECT DISTINCT p.lang, p.phrase FROM inner_parts p
  JOIN candidates c ON c.k = 2 AND c.lang = p.lang AND c.phrase = p.phrase
  WHERE 100 * p.a >= 50 * c.a),
ranked AS (
  SELECT lang, phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest ANTI JOIN dropped USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
