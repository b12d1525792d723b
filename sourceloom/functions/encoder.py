"""Text to vector: a built-in hashing encoder and a hook for a real model."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions.text import WORD

# Executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Up to U+024F, Java, RE2 and Python tell the same words and lower-case them alike.
NOT_LATIN = r"[^\x00-\x{24f}]"
# Which code points up to there are part of a word.
IN_WORDS = np.array([chr(c) == "_" or unicodedata.category(chr(c))[0] in "LN" for c in range(0x250)])
# Bytes of text whose words are counted at once, or one longer text.
COUNTED_BYTES = 8 << 20


def slots_of(words: pa.Array, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of words as they stand in texts, one behind the other, and how many each word has."""

    def hashed(parts: list[bytes]) -> np.ndarray:
        digests = b"".join([hashlib.md5(part, usedforsecurity=False).digest() for part in parts])
        return np.frombuffer(digests, dtype=">u4")[::4].astype(np.int64) % slots

    # Words of several parts: where the case changes, or that a lower-cased letter cuts.
    cut = pc.match_substring_regex(words, "[a-z0-9][A-Z]|\u0130").to_numpy(zero_copy_only=False)
    found = np.where(cut, 0, pc.binary_length(words).to_numpy(zero_copy_only=False) > 0).astype(np.int64)
    split = [re.findall(r"\w+", re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", words[int(i)].as_py()).lower()) for i in np.flatnonzero(cut)]
    found[cut] = [len(parts) for parts in split]
    flat = np.empty(found.sum(), dtype=np.int64)
    of_cut = np.repeat(cut, found)
    flat[of_cut] = hashed([part.encode() for parts in split for part in parts])
    whole = pc.utf8_lower(words.filter(pa.array((found > 0) & ~cut))).cast(pa.large_string())
    if len(whole):
        _, ends, data = whole.buffers()
        ends, data = np.frombuffer(ends, dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1].tolist(), data.to_pybytes()
        flat[~of_cut] = hashed([data[a:b] for a, b in zip(ends, ends[1:])])
    return flat, found


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts up to U+024F as they stand there, and the text of each: runs of letters,
    digits and ``_``, told apart byte by byte."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    first, ends = ends[0], ends - ends[0]
    if not ends[-1]:
        return pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    data = data.slice(first, ends[-1])
    code = np.frombuffer(data, dtype=np.uint8)
    inside = IN_WORDS[code]
    leads = np.flatnonzero(code >= 0xC0)  # of two bytes, as all letters beyond ASCII up to there
    inside[leads] = inside[leads + 1] = IN_WORDS[(code[leads].astype(np.int64) & 0x1F) << 6 | code[leads + 1] & 0x3F]
    cut = np.ones(len(code) + 1, dtype=bool)
    np.not_equal(inside[1:], inside[:-1], out=cut[1:-1])
    cut[ends] = True
    bounds = np.flatnonzero(cut)
    runs = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), data])
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(bounds, ends)))
    is_word = inside[bounds[:-1]]
    return runs.filter(pa.array(is_word)), owner[is_word]


def slot_counts(texts: pa.Array, slots: int) -> np.ndarray:
    """How often the words of each text fall into each slot; each distinct word is hashed once."""
    words, owner = words_of(texts)
    coded = words.dictionary_encode()
    flat, many = slots_of(coded.dictionary, slots)
    number, start = coded.indices.to_numpy(zero_copy_only=False), np.cumsum(many) - many
    if (many == 1).all():
        slot = flat[number]
    else:
        n = many[number]
        slot = flat[np.repeat(start[number] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        owner = np.repeat(owner, n)
    return np.bincount(owner * slots + slot, minlength=len(texts) * slots).reshape(len(texts), slots)


def tokens_of(text: Column) -> Column:
    """Lower-case words; camelCase names are split at the case change."""
    split = F.regexp_replace(text, "(?=[A-Z])(?<=[a-z0-9])", " ")
    return F.regexp_extract_all(F.lower(split), F.lit(f"{WORD}+"), F.lit(0))


class HashingEncoder:
    """Signed feature hashing of word counts as one column expression.

    The vector is a projection of its own row: no shuffle. Words are counted in Arrow
    batches, where each word is hashed once; texts beyond Latin letters, which Java and
    Python may read differently, are encoded by Spark's functions. The numbers are whole,
    so dot products and norms are exact in any order of addition.
    """

    def __init__(self, dim: int = 64):
        if dim < 1:
            raise ValueError("dim must be positive")
        self.dim = dim
        self.name = f"hashing-{dim}"

    def column(self, text: Column) -> Column:
        """The vector of a text; null for null."""
        dim = self.dim

        @F.arrow_udf("array<float>")
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                texts = batch.fill_null("")
                part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // COUNTED_BYTES
                vectors = np.zeros((len(batch), dim), dtype=np.float32)
                for some in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(part)) + 1):
                    if len(some):
                        counts = slot_counts(texts.slice(some[0], len(some)), 2 * dim)
                        vectors[some] = counts[:, :dim] - counts[:, dim:]
                offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dim)
                yield pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()), mask=batch.is_null())

        latin = counted(F.when(~text.rlike(NOT_LATIN), text))
        return F.coalesce(latin, self.projected(text))

    def projected(self, text: Column) -> Column:
        """The same by Spark's functions, for texts in any script."""
        dim, slots = self.dim, 2 * self.dim

        def slot(token: Column) -> Column:
            return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % slots).cast("int")

        # Histogram in one sort: token slots become odd numbers, and an even marker
        # stands before each slot. The gap between two markers is a slot's count.
        marked = F.sort_array(
            F.concat(
                F.transform(tokens_of(text), lambda t: slot(t) * 2 + 1),
                F.sequence(F.lit(0), F.lit(2 * slots), F.lit(2)),
            )
        )
        marker_at = F.filter(
            F.transform(marked, lambda value, i: F.when(value % 2 == 0, i)), lambda i: i.isNotNull()
        )

        def count(at: Column, s: Column) -> Column:
            return F.get(at, s + 1) - F.get(at, s)

        # The one-item array binds marker_at to a lambda variable, so it is evaluated
        # once per row and not once per use.
        vectors = F.transform(
            F.array(marker_at),
            lambda at: F.transform(
                F.sequence(F.lit(0), F.lit(dim - 1)),
                lambda i: (count(at, i) - count(at, i + dim)).cast("float"),
            ),
        )
        return F.when(text.isNotNull(), F.get(vectors, F.lit(0)))


class ModelEncoder:
    """Runs a user's model in Arrow batches on the executors.

    ``load`` is called once per Python worker and returns a function from a list of
    texts to a sequence of vectors. A text the model fails on, or for which it returns
    another width than ``dim``, gets a null vector and the reason; the rest of its batch is kept.
    """

    def __init__(self, name: str, dim: int, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]):
        self.name, self.dim, self.load = name, dim, load

    def column(self, text: Column) -> Column:
        return self.result(text)["vector"]

    def result(self, text: Column) -> Column:
        """Vector and reason of failure, in one pass of the model."""
        load, dim = self.load, self.dim

        @F.pandas_udf("vector array<float>, error string")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = load()

            def vector(values) -> np.ndarray:
                found = np.asarray(values, dtype=np.float32)
                if found.shape != (dim,):
                    raise ValueError("the model returned a vector of another width")
                return found

            def one(text: str):
                try:
                    return vector(model([text])[0]), None
                except Exception as error:
                    return None, f"{type(error).__name__}: {error}"

            for batch in batches:
                texts = batch.dropna().tolist()
                try:
                    found = [(vector(v), None) for v in model(texts)] if texts else []
                    if len(found) != len(texts):
                        raise ValueError("the model returned another number of vectors")
                except Exception:
                    found = [one(t) for t in texts]
                left = iter(found)
                rows = [(None, None) if missing else next(left) for missing in batch.isna()]
                yield pd.DataFrame({"vector": pd.Series([v for v, _ in rows], dtype=object), "error": pd.Series([e for _, e in rows], dtype=object)})

        return encode(text)
