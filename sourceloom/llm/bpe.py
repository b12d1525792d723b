"""Byte-level BPE encoding and decoding; long texts by tree concatenation.

A long text is halved until its leaves are short. Leaves are encoded in parallel, each as
a text of its own. Neighbours are then concatenated pairwise: a window around the join is
encoded anew and grows until its tokens agree with both sides, so that every level holds
exactly what the tokenizer gives for the whole stretch.

Why agreement is enough: the pre-tokenizer scans from left to right, so that two scans
which share the start of a pre-token are equal from there on. Within one long pre-token,
a sequence of tokens is the BPE of its bytes exactly if each neighbouring pair is; a token
common to the window and a side joins the pairs of both.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from sourceloom.llm.common import row_key, table, whole_text

LEAF_CHARS = 32_768
MARGIN = 16  # longer than the special token, and than what a pre-token looks ahead
CACHED_UNITS = 250_000
BATCH = 400_000  # characters at a time
TOGETHER = 512
# A space that is not followed by a visible character starts no unit.
_ODD_SPACE = re.compile(r" (?:[\s᠎​﻿]|\Z)")


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """One tokenizer in one worker.

    A unit is a word with the space before it. A space before a visible character always
    starts a pre-token, and no special token holds a space, so that units can be encoded
    apart; each distinct unit is encoded once while the cache lasts.
    """

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        symbols = byte_of_symbol()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        added = self.tokenizer.get_added_tokens_decoder()
        self.specials = sorted((t.content for t in added.values()), key=len, reverse=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for symbol, i in vocabulary.items():
            self.bytes_of[i] = symbol.encode() if i in added else bytes(map(symbols.__getitem__, symbol))
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.cache: dict[str, bytes] = {}

    def _fill(self, units: list[str]) -> None:
        """Encode distinct units, a few hundred in one string, and cut the tokens at their ends."""
        if len(self.cache) + len(units) > CACHED_UNITS:
            self.cache.clear()
        for at in range(0, len(units), TOGETHER):
            some = [" " + u for u in units[at : at + TOGETHER]]
            ids = np.array(self.tokenizer.encode("".join(some), add_special_tokens=False).ids, dtype="<u4")
            sizes = np.cumsum([len(u.encode()) for u in some])
            stops = np.searchsorted(np.cumsum(self.lengths[ids]), sizes, side="left") + 1
            data, begin = ids.tobytes(), 0
            for unit, stop in zip(units[at : at + TOGETHER], (stops * 4).tolist()):
                self.cache[unit] = data[begin:stop]
                begin = stop

    @staticmethod
    def units(text: str) -> tuple[str, list[str]]:
        """What comes before the first unit, and the units without their spaces."""
        first, *rest = text.split(" ")
        if not _ODD_SPACE.search(text):
            return first, rest
        merged: list[list[str]] = [[first]]
        for part in rest:
            if _ODD_SPACE.match(" " + part[:1]):
                merged[-1].append(part)
            else:
                merged.append([part])
        return " ".join(merged[0]), [" ".join(p) for p in merged[1:]]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.units(t) for t in texts]
        cache = self.cache
        new = {u for _, rest in split for u in rest if u not in cache}
        if new:
            known = {u for _, rest in split for u in rest} if len(cache) + len(new) > CACHED_UNITS else new
            self._fill(list(known))
        heads = self.tokenizer.encode_batch_fast([h for h, _ in split], add_special_tokens=False)
        return [np.array(h.ids, dtype="<u4").tobytes() + b"".join(map(cache.__getitem__, rest)) for h, (_, rest) in zip(heads, split)]

    def runs(self, texts: list[str]) -> Iterator[tuple[list[str], list[bytes]]]:
        """Texts in runs of about ``BATCH`` characters with their ids."""
        at, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= BATCH or i + 1 == len(texts):
                yield texts[at : i + 1], self.encode_batch(texts[at : i + 1])
                at, size = i + 1, 0

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")

    def stretch(self, text: str) -> Stretch:
        """A text with its tokens."""
        return Stretch(self, text.encode(), np.frombuffer(self.encode_batch([text])[0], dtype="<u4"))

    def starts_of_pretokens(self, text: str) -> np.ndarray:
        """Byte offsets at which pre-tokens and special tokens start."""
        starts, at = [], 0
        for piece in re.split("(" + "|".join(map(re.escape, self.specials)) + ")", text) if self.specials else [text]:
            if piece in self.specials:
                starts.append(at)
            elif piece:
                widths = np.cumsum([0, *(len(c.encode()) for c in piece)])
                starts += [at + int(widths[b]) for _, (b, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]
            at += len(piece.encode())
        return np.array(starts, dtype=np.int64)


class Stretch:
    """A piece of text and its tokens; offsets are in bytes and count from its start."""

    def __init__(self, coder: Coder, data: bytes, ids: np.ndarray):
        self.coder, self.data, self.ids = coder, data, ids
        self.ends = np.cumsum(coder.lengths[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
        self.starts = self.ends - coder.lengths[ids] if len(ids) else self.ends

    @functools.cached_property
    def pre(self) -> np.ndarray:
        """Where pre-tokens start; only texts that are long without a space need this."""
        return self.coder.starts_of_pretokens(self.data.decode())


def _inside_letters(data: bytes, at: int) -> bool:
    """Whether the characters on both sides of a byte offset are letters, of one pre-token then."""
    if not 0 < at < len(data) or data[at] & 0xC0 == 0x80:
        return False
    before = data[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:]
    after = data[at : at + 4].decode("utf-8", "ignore")[:1]
    return before.isalpha() and after.isalpha()


def _unit_starts(data: bytes) -> list[int]:
    """Offsets of spaces before ASCII letters; each starts a pre-token wherever the text is cut."""
    return [m.start() for m in re.finditer(rb" (?=[A-Za-z])", data)]


def _left_edge(left: Stretch, w: int, near: int) -> tuple[int, bool]:
    """Where the window starts, and whether that is the start of a pre-token of the whole."""
    c = len(left.data)
    low = max(0, c - near)
    if units := [u for u in _unit_starts(left.data[low:]) if low + u <= c - MARGIN]:
        return low + units[-1], True
    i = bisect.bisect_right(left.pre, c - max(w, MARGIN)) - 1
    if i >= 0 and left.pre[i] >= c - 4 * w:
        return int(left.pre[i]), True
    j = bisect.bisect_right(left.starts, c - max(w, MARGIN)) - 1
    while j >= 0 and left.starts[j] >= c - 4 * w:
        if _inside_letters(left.data, int(left.starts[j])):
            return int(left.starts[j]), False
        j -= 1
    if i >= 0 and c - left.pre[i] <= 64 * w:
        return int(left.pre[i]), True
    return 0, True


def _right_edge(right: Stretch, w: int, near: int) -> tuple[int, bool]:
    """Where the window ends, and whether both sides are sure to have a pre-token start there."""
    n = len(right.data)
    if units := [u for u in _unit_starts(right.data[:near]) if u >= MARGIN]:
        return units[0], True
    for offsets in (right.pre, right.starts):
        i = bisect.bisect_left(offsets, w)
        while i < len(offsets) and offsets[i] <= 4 * w:
            if offsets is right.pre or _inside_letters(right.data, int(offsets[i])):
                return int(offsets[i]), False
            i += 1
    return n, True


def concatenate(left: Stretch, right: Stretch, w: int = 64, near: int = 2048) -> Stretch:
    """The stretch of both texts together, as if encoded in one piece.

    ``w`` is the first width of the window on each side, ``near`` how far a space before
    a letter is looked for, where the window can end without further proof.
    """
    if not left.data or not right.data:
        return right if not left.data else left
    coder, c, data = left.coder, len(left.data), left.data + right.data
    while True:
        a, sure_left = _left_edge(left, w, near)
        edge, sure_right = _right_edge(right, w, near)
        b = c + edge
        window = coder.stretch(data[a:b].decode())
        starts, ends = (window.starts + a).tolist(), (window.ends + a).tolist()
        first, keep = 0, a
        if not sure_left:  # a token that the window shares with the left side
            seen = dict(zip(left.starts.tolist(), left.ends.tolist()))
            first = next((k for k, (s, e) in enumerate(zip(starts, ends)) if e <= c - MARGIN and seen.get(s) == e and _inside_letters(data, s) and _inside_letters(data, e)), -1)
            keep = starts[first] if first >= 0 else -1
        last, resume = len(window.ids), b
        if not sure_right:
            shared = np.intersect1d(window.pre + a, right.pre + c)
            shared = shared[(shared >= c) & (shared <= b - MARGIN)]
            if len(shared):
                resume = int(shared[0])
                last = bisect.bisect_left(starts, resume)
            else:
                seen = dict(zip((right.starts + c).tolist(), (right.ends + c).tolist()))
                last = next((k for k, (s, e) in enumerate(zip(starts, ends)) if s > c and e <= b - MARGIN and seen.get(s) == e and _inside_letters(data, s) and _inside_letters(data, e)), -1)
                resume = starts[last] if last >= 0 else -1
        if first >= 0 and last >= first and keep <= resume:
            head = int(np.searchsorted(left.starts, keep))
            tail = int(np.searchsorted(right.starts, resume - c))
            return Stretch(coder, data, np.concatenate([left.ids[:head], window.ids[first:last], right.ids[tail:]]))
        if a == 0 and b == len(data):
            return coder.stretch(data.decode())
        w *= 2


def encode_tree(leaves: list[Stretch], w: int = 64, near: int = 2048) -> Stretch:
    """Concatenate neighbours until one stretch is left."""
    while len(leaves) > 1:
        leaves = [concatenate(*leaves[i : i + 2], w, near) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


_CODERS: dict[str, Coder] = {}


def coder_of(definition: str) -> Coder:
    """The worker's coder; it is kept between tasks."""
    if definition not in _CODERS:
        _CODERS.clear()
        _CODERS[definition] = Coder(definition)
    return _CODERS[definition]


def read_definition(path: str) -> str:
    """The tokenizer file, read where the job starts; at most 64 MB, as it goes to each task."""
    with open(path, encoding="utf-8") as file:
        text = file.read(1 << 26)
        if file.read(1):
            raise ValueError("the tokenizer file is larger than 64 MB")
    return text


def encode(docs: DataFrame, definition: str, doc_id: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS, decoded: bool = False) -> DataFrame:
    """One row per document: doc_id, ids (binary, little-endian uint32), and on demand
    ``text``, decoded from these ids, special tokens included.

    Null and empty texts give no ids. Rows stay rows, null and repeated ids included;
    other columns are not looked at. Texts up to ``leaf_chars`` characters never move;
    only leaves of longer ones are shuffled, and a repeated long row is encoded once.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    long = F.length("text") > leaf_chars
    made = "ids binary, text string" if decoded else "ids binary"

    def columns(coder: Coder, ids: list[bytes]) -> dict:
        return {"ids": pa.array(ids, pa.binary())} | ({"text": pa.array(map(coder.decode, ids), pa.string())} if decoded else {})

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(definition)
        for batch in batches:
            at = 0
            for texts, ids in coder.runs(batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, len(texts))} | columns(coder, ids))
                at += len(texts)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(definition)
        for batch in batches:
            at = 0
            for texts, ids in coder.runs(batch.column("text").to_pylist()):
                same = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*same.columns, pa.array(ids, pa.binary())], names=["_key", "at", "text", "ids"])
                at += len(texts)

    def trees(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        coder = coder_of(definition)
        frame = frame.sort_values("at")
        ids = encode_tree([Stretch(coder, t.encode(), np.frombuffer(i, "<u4")) for t, i in zip(frame["text"], frame["ids"])]).ids.astype("<u4").tobytes()
        return pd.DataFrame({"_key": [key[0]], "ids": [ids]} | ({"text": [coder.decode(ids)]} if decoded else {}))

    short_ids = rows.where(~long).mapInArrow(direct, f"doc_id {kind}, {made}")
    whole = rows.where(long).withColumn("_key", F.to_json(row_key("doc_id", "text")))
    once = whole.groupBy("_key").agg(F.first("text").alias("text"))
    numbers = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / leaf_chars).cast("int"))
    cut = once.select("_key", F.explode(F.transform(numbers, lambda i: F.struct(i.alias("at"), F.substring("text", i * leaf_chars + 1, F.lit(leaf_chars)).alias("text")))).alias("_leaf")).select("_key", "_leaf.at", "_leaf.text")
    coded = cut.repartition("_key", "at").mapInArrow(leaves, "_key string, at int, text string, ids binary")
    tree_ids = coded.groupBy("_key").applyInPandas(trees, f"_key string, {made}")
    return short_ids.unionByName(whole.select("doc_id", "_key").join(tree_ids, "_key").drop("_key"))


def decode(coded: DataFrame, definition: str, ids: str = "ids") -> DataFrame:
    """``coded`` with a column ``text`` decoded from its ids, special tokens included; null ids are empty."""
    others = [f for f in coded.schema if f.name not in (ids, "text")]
    rows = coded.select(*[f.name for f in others], F.coalesce(F.col(ids), F.lit(b"").cast("binary")).alias(ids))
    schema = StructType([*others, StructField(ids, BinaryType()), StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(definition)
        for batch in batches:
            texts = pa.array(map(coder.decode, batch.column(ids).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "text"])

    return rows.mapInArrow(run, schema)


def op8_bpe_trees(spark, sf_dir):
    import public_tokenizers

    definition = read_definition(public_tokenizers.path("byte_bpe_50k.json"))
    return encode(table(spark, sf_dir, "documents"), definition, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
