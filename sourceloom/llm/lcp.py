"""Document fingerprints by locally consistent parsing.

Runs of one symbol become one symbol. Deterministic coin tossing against the left
neighbour then reduces all symbols to a few labels, and phrases start where labels have
local maxima. A phrase is named by a hash of its symbols, the names are parsed again, and
so on. A phrase depends on a few neighbours only, so that equal substrings get the same
names inside, wherever they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import stored, table, text_batches, whole_text
from sourceloom.llm.wordarrays import MULTIPLIER, mixed, powers

LEVELS = (2, 3)  # levels whose names make the fingerprint
ROUNDS = 4  # of coin tossing: 64 bits, then 7, 4 and 3 bits
SKETCH = 64  # names kept per fingerprint
BATCH = 500_000


def toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8; neighbours that differ keep labels that differ."""
    x = symbols
    for _ in range(ROUNDS):
        one = x.dtype.type(1)
        differ = np.empty_like(x)
        differ[1:] = x[1:] ^ x[:-1]
        differ[first] = one  # the first symbol of a text has no neighbour
        low = np.bitwise_count((differ & (~differ + one)) - one)
        bit = ((x >> low.astype(x.dtype)) & one).astype(np.uint8)
        x = (low << np.uint8(1)) | bit
    return x


def parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level over texts that start at the places ``first``, none of them empty.

    Returns the names of the phrases, the places of their first symbols, and the places
    at which the texts start among the phrases.
    """
    new = np.empty(len(names), dtype=bool)
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[first] = True
    at = np.flatnonzero(new)
    symbols = names[at]
    first = np.searchsorted(at, first)
    labels = toss(symbols, first)
    top = np.zeros(len(labels), dtype=bool)
    top[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    top[-1] = len(labels) > 1 and labels[-1] > labels[-2]
    ends = first[1:] - 1  # a last symbol has no neighbour to its right
    top[ends] = labels[ends] > labels[ends - 1]
    top[first] = True
    phrase = np.flatnonzero(top)
    size = np.diff(phrase, append=len(symbols))
    value = symbols.astype(np.uint64)
    if len(at) < len(names):
        run = np.diff(at, append=len(names))
        long = np.flatnonzero(run > 1)
        value[long] = mixed(value[long] ^ (run[long].astype(np.uint64) * MULTIPLIER))
    value += np.uint64(1)
    place = np.arange(len(value), dtype=np.int32) - np.repeat(phrase.astype(np.int32), size)
    value *= powers(int(size.max()))[place]
    named = mixed(np.add.reduceat(value, phrase) ^ size.astype(np.uint64))
    return named, at[phrase], np.searchsorted(phrase, first)


def signatures(texts: list[str], levels: tuple[int, ...] = LEVELS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, names, starts in code points, text numbers) of the phrases of the given levels."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(names):
        return
    full = np.flatnonzero(lengths)
    begins = (np.cumsum(lengths) - lengths)[full]
    first, at = begins, None
    for level in range(1, max(levels) + 1):
        names, place, first = parse(names, first)
        at = place if at is None else at[place]
        if level in levels:
            number = np.repeat(np.arange(len(full)), np.diff(first, append=len(names)))
            yield level, names, at - begins[number], full[number]


def sketches(texts: list[str], levels: tuple[int, ...] = LEVELS, size: int = SKETCH) -> list[np.ndarray]:
    """The ``size`` smallest 32-bit hashes of distinct phrase names of each text, ascending."""
    parts = [(mixed(n + np.uint64(k)) >> np.uint64(32), t) for k, n, _, t in signatures(texts, levels)]
    if not parts:
        return [np.zeros(0, dtype=np.uint32) for _ in texts]
    keys = np.concatenate([(t.astype(np.uint64) << np.uint64(32)) | h for h, t in parts])
    keys = np.unique(keys)
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    return [keys[a : min(b, a + size)].astype(np.uint32) for a, b in zip(bounds[:-1], bounds[1:])]


def packed(sketch: np.ndarray) -> bytes:
    return sketch.astype(">u4").tobytes()


def written(sketch: np.ndarray) -> str:
    return packed(sketch).hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Share of the smallest hashes of both that both hold: an estimate of the Jaccard index
    of their phrases, exact below ``size`` phrases. Two empty texts are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, fingerprint (hex of up to 64 hashes).

    Null and empty texts have an empty fingerprint. Rows stay rows, nothing is shuffled,
    and other columns are not looked at.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(frames):
        for part in text_batches(frames, "text", BATCH):
            made = [written(s) for s in sketches(part["text"].tolist())]
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_chars": part["text"].str.len(), "fingerprint": made})

    return docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")).mapInPandas(run, f"doc_id {kind}, n_chars long, fingerprint string")


# Digests travel as bytes and become hex at the end.
_MADE = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(pairs: pd.DataFrame) -> pd.DataFrame:
    """Results of rows with columns doc_id, text and next (the next document's text)."""
    texts, following = pairs["text"].tolist(), pairs["next"].tolist()
    edited = []
    for a, b in zip(texts, following):
        cut = len(a) // 3
        edited.append(a[: len(a) - cut] + b[:cut])
    n = len(texts)
    # Within a batch the next document is mostly the next row, whose sketch is there already.
    own = [i for i in range(n) if i + 1 == n or following[i] is not texts[i + 1]]
    made = sketches(texts + edited + [following[i] for i in own])
    after = made[1:n] + [made[0]]
    for place, i in enumerate(own):
        after[i] = made[2 * n + place]
    return pd.DataFrame(
        {
            "doc_id": pairs["doc_id"].to_numpy(),
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).digest() for t in edited],
            "fingerprint": [packed(s) for s in made[:n]],
            "edited_fingerprint": [packed(s) for s in made[n : 2 * n]],
            "near_edited": [likeness(a, b) for a, b in zip(made[:n], made[n : 2 * n])],
            "near_next": [likeness(a, b) for a, b in zip(made[:n], after)],
        }
    )


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints compared with those of an edited text and of the next document.

    The next document is that of the next smaller id, and of the largest for the smallest;
    ties follow a hash of the text, and null ids come last. In the edited text the last third is
    replaced by the start of the next document. Null texts are empty. A table of one row
    is its own successor; an empty table gives no rows.

    Rows are dealt out by ranges of ids and compared inside their range. Only the first
    and last row of each range, whose neighbours lie elsewhere, are put together after.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.col("text")]
    # Ranges are sampled on the driver, by hashes instead of texts where ids are equal.
    spread = [order[0], F.xxhash64("text")]
    ranged = rows.repartitionByRange(*spread).sortWithinPartitions(*spread, order[1])
    schema = f"part int, role string, doc_id {kind}, {_MADE}, text string"

    def inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None

        def edge(role, row):
            given = {"part": part, "role": role, "doc_id": row["doc_id"].iloc[0], "text": row["text"].iloc[0]}
            return pd.DataFrame({c: pd.Series([given.get(c)], dtype=row["doc_id"].dtype if c == "doc_id" else object) for c in columns})

        columns = [c.split()[0] for c in schema.split(", ")]
        for frame in text_batches(frames, "text", BATCH):
            if held is None:
                yield edge("first", frame.iloc[:1])
            else:
                frame = pd.concat([held, frame], ignore_index=True)
            pairs = frame.iloc[:-1].assign(next=frame["text"].tolist()[1:])
            if len(pairs):
                yield _compared(pairs).assign(part=part, role="done", text=None)[columns]
            held = frame.iloc[-1:]
        if held is not None:
            yield edge("last", held)

    made = stored(ranged.mapInPandas(inside, schema), "fingerprints")
    shown = [c.split() for c in _MADE.split(", ")]
    result = ["doc_id", *(F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in shown)]
    parts = sorted(r[0] for r in made.where(F.col("role") == "first").select("part").collect())  # one number per range
    if not parts:
        return made.select(*result)
    pairs = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, follows int")
    last = made.where(F.col("role") == "last").select("doc_id", "text", "part").join(pairs, "part")
    first = made.where(F.col("role") == "first").select(F.col("text").alias("next"), F.col("part").alias("follows"))

    def at_edges(frames):
        for frame in frames:
            if len(frame):
                yield _compared(frame)

    edges = last.join(first, "follows").select("doc_id", "text", "next").mapInPandas(at_edges, f"doc_id {kind}, {_MADE}")
    return made.where(F.col("role") == "done").select(*result).unionByName(edges.select(*result))


def op10_phrase_fingerprints(spark, sf_dir):
    return edited_likeness(table(spark, sf_dir, "documents"))
