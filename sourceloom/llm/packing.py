"""Packing of documents into windows by order-preserving dynamic programming.

Each task encodes the documents of its partition in the order in which the table holds them
and cuts their tokens into windows. A cut may lie at the end of a document, at the end of a
sentence, or, at a higher price, inside a sentence. The price of a packing is its padding
plus the prices of its cuts. The best packing that ends at a place follows from the best
ones at the places a window before; the least of those comes from a monotone queue. A window
whose length is a power of two needs no padding, so that these few lengths are looked up
besides.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sourceloom.llm.bpe import read_definition
from sourceloom.llm.common import table, whole_text

WINDOW = 4096
END = 2  # the id behind each document
# Prices in tokens of padding.
SENTENCE = 16
INSIDE = 64
SEQUENCE = 1
APART = 32  # sentence ends this close behind another place are not tried
STEP = 16  # distance of the places inside a sentence, where sentences are longer
BLOCK = 1_000_000  # tokens that are planned at a time
OPEN = 8  # windows at the end of a block that are planned anew with the next
CACHED_UNITS = 1_000_000
BATCH = 2_000_000  # characters at a time
TOGETHER = 128
_ENDS = tuple(c.encode() for c in ".!?…。！？")
_CLOSING = "\"'”’»)]"
_SPACES = bytes.maketrans(b"\n\r\t", b"   ")
_LOWER = bytes.maketrans(b"\n\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"   abcdefghijklmnopqrstuvwxyz")
# A single sign behind letters is a token of its own.
_SIGNS = frozenset(b".,;:!?")


# The last bytes of closing signs.
_CLOSED = frozenset(c.encode()[-1:] for c in _CLOSING)


def ends_sentence(unit: bytes) -> bool:
    """Whether a unit ends with a sentence's last sign, closing quotes and brackets aside."""
    return unit.decode().rstrip(_CLOSING).encode().endswith(_ENDS)


class _Units(dict):
    """Numbers for units; new ones are noted."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, unit):
        number = self[unit] = len(self)
        self.new.append(unit)
        return number


class WordCoder:
    """A tokenizer that drops white space and case, in one worker.

    Its tokens never cross a space, nor the place before a sign that follows letters, so that
    the units between spaces are encoded apart, each distinct one once while the cache lasts,
    and those with a sign as their word and the sign. A definition that does otherwise is
    refused.
    """

    def __init__(self, definition: str, end: int = END):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [(i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()]
        if any(" " in t.content or t.lstrip or t.rstrip or t.single_word for _, t in special):
            raise ValueError("an added token reaches beyond a word")
        self.special = [t.content.encode() for _, t in special]
        # An added token that is split off before all else can stand between units.
        marks = [(i, t.content.encode()) for i, t in special if not t.normalized]
        self.mark = marks[-1] if marks else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = json.loads(definition)["model"].get("end_of_word_suffix")
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # whether a token ends a word
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.units = _Units()
        self.units[None] = 0  # the end of a document
        self.flat = np.array([end], dtype="<u4")
        self.starts, self.sizes, self.used = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.ends = np.zeros(1, dtype=bool)
        self.sign_ids = {sign: self._alone(bytes([sign])) for sign in _SIGNS}
        sample = "One, TWO\n\tThree's  É1 ok. no; A: b! c? " + "".join(t.content for _, t in special)
        if any(len(i) != 1 for i in self.sign_ids.values()) or self.encode([sample])[0].tolist() != [*self._alone(sample.encode()), end]:
            raise ValueError("words of this tokenizer cannot be encoded apart")

    def cut(self, text: str) -> list[bytes]:
        """The units of a text."""
        data = text.encode("utf-8", "replace")
        if any(s in data.lower() for s in self.special):  # the case of these counts
            return data.translate(_SPACES).split(b" ")
        return data.translate(_LOWER).split(b" ")

    def _alone(self, unit: bytes) -> list[int]:
        return self.tokenizer.encode(unit.decode(), add_special_tokens=False).ids

    def _joined(self, some: list[bytes], between: bytes) -> np.ndarray:
        """The tokens of units in one string; the fast form keeps no offsets."""
        return np.array(self.tokenizer.encode_batch_fast([between.join(some).decode()], add_special_tokens=False)[0].ids, dtype="<u4")

    def _ids_of(self, units: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of units and how many each has, many units in one string: words with spaces
        between them, as a mark in their last token tells them apart, others with added tokens."""
        flat, sizes = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        number, content = self.mark or (None, b"")
        for at in range(0, len(units), TOGETHER):
            some = units[at : at + TOGETHER]
            if words:
                ids = self._joined(some, b" ")
                marks = np.flatnonzero(self.last[ids])
                if len(marks) == len(some):
                    sizes.append(np.diff(marks, prepend=-1))
                    flat.append(ids)
                    continue
            elif self.mark is not None and b"<" not in b"".join(some):
                ids = self._joined(some, content)
                marks = np.flatnonzero(ids == number)
                sizes.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
                flat.append(ids[ids != number])
                continue
            each = [np.array(self._alone(u), dtype="<u4") for u in some]
            sizes.append(np.array([len(i) for i in each], dtype=np.int64))
            flat += each
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self) -> None:
        """Encode the new units: words of ASCII letters, such words with a sign, and others."""
        first, numbers = len(self.sizes), self.units
        plain, other, signed, cores, signs = [], [], [], [], []
        new, numbers.new = numbers.new, []
        while new:  # the words of signed units may be new as well
            for unit in new:
                if unit.isalpha():
                    plain.append(unit)
                elif unit and unit[-1] in _SIGNS and unit[:-1].isalpha():
                    signed.append(unit)
                    cores.append(numbers[unit[:-1]])
                    signs.append(self.sign_ids[unit[-1]][0])
                else:
                    other.append(unit)
            new, numbers.new = numbers.new, []
        more = len(numbers) - first
        self.sizes = np.concatenate([self.sizes, np.zeros(more, dtype=np.int64)])
        self.starts = np.concatenate([self.starts, np.zeros(more, dtype=np.int64)])
        self.used = np.concatenate([self.used, np.zeros(more, dtype=np.int64)])
        self.ends = np.concatenate([self.ends, np.zeros(more, dtype=bool)])
        for units, words in ((plain, True), (other, False)):
            flat, sizes = self._ids_of(units, words)
            self._place(units, flat, sizes)
        if signed:
            core = np.array(cores, dtype=np.int64)
            sizes = self.sizes[core] + 1
            stops = np.cumsum(sizes)
            place = np.repeat(self.starts[core] - (stops - sizes), sizes) + np.arange(int(stops[-1]))
            flat = self.flat[np.minimum(place, len(self.flat) - 1)]
            flat[stops - 1] = signs
            self._place(signed, flat, sizes)
        for units in (other, signed):
            told = [u.endswith(_ENDS) or (u[-1:] in _CLOSED and ends_sentence(u)) for u in units]
            self.ends[[numbers[u] for u in units]] = told

    def _place(self, units: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        number = np.fromiter(map(self.units.__getitem__, units), dtype=np.int64, count=len(units))
        self.sizes[number] = sizes
        self.starts[number] = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, flat]).astype("<u4", copy=False)

    def _trim(self) -> None:
        """Keep the more used half of a full cache."""
        self.used[0] = np.iinfo(np.int64).max
        keep = np.sort(np.argsort(-self.used, kind="stable")[: CACHED_UNITS // 2])
        units = list(self.units)
        self.units = _Units()
        self.units.update((units[i], n) for n, i in enumerate(keep.tolist()))
        sizes = self.sizes[keep]
        offsets = np.cumsum(sizes) - sizes
        self.flat = self.flat[np.repeat(self.starts[keep] - offsets, sizes) + np.arange(int(sizes.sum()))]
        self.starts, self.sizes, self.ends, self.used = offsets, sizes, self.ends[keep], self.used[keep]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens, the number of tokens of each text, and the places where sentences end."""
        if len(self.units) > CACHED_UNITS:
            self._trim()
        words: list = []
        counts = np.empty(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            part = self.cut(text)
            words += part
            words.append(None)
            counts[i] = len(part) + 1
        number = np.fromiter(map(self.units.__getitem__, words), dtype=np.int64, count=len(words))
        if self.units.new:
            self._learn()
        self.used += np.bincount(number, minlength=len(self.used))
        sizes = self.sizes[number]
        stops = np.cumsum(sizes)
        place = np.repeat(self.starts[number] - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)
        lengths = np.diff(stops[np.cumsum(counts) - 1], prepend=0)
        return self.flat[place], lengths, np.unique(stops[self.ends[number]])


_CODERS: dict[tuple[str, int], WordCoder] = {}


def coder_of(definition: str, end: int) -> WordCoder:
    """The worker's coder; it is kept between tasks."""
    if (definition, end) not in _CODERS:
        _CODERS.clear()
        _CODERS[definition, end] = WordCoder(definition, end)
    return _CODERS[definition, end]


# -- planning ---------------------------------------------------------------------------------


def places(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may lie, from 0 to ``total``, and their prices.

    Of sentence ends close to each other one is taken. Long stretches without an end get
    places inside; if nothing follows (``last``), all places of the last window do, so that
    the rest can be cut into powers of two.
    """
    price = np.full(total + 1, -1, dtype=np.int32)
    inner = sentence_ends[(sentence_ends > 0) & (sentence_ends < total)]
    grain = min(APART, max(1, window // 4))
    if len(inner):
        # The first end of each stretch of so many tokens.
        price[inner[np.diff(inner // grain, prepend=-1) > 0]] = SENTENCE
    price[doc_ends[(doc_ends > 0) & (doc_ends < total)]] = 0
    price[0] = price[total] = 0
    known = np.flatnonzero(price >= 0)
    step = min(STEP, max(1, window // 4))
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > 8 * step)
    if len(wide):
        many = (gaps[wide] - 1) // step
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + 1
        price[np.repeat(known[wide], many) + nth * step] = INSIDE
    if last:
        rest = price[max(0, total - window) :]
        rest[rest < 0] = INSIDE
    at = np.flatnonzero(price >= 0)
    return at, price[at]


def plan(at: np.ndarray, price: np.ndarray, window: int) -> np.ndarray:
    """The cuts, without 0, of the cheapest packing of the places ``at``, from the first to the last.

    A window costs its padding, none at a power of two, the price of its end and a little
    for itself. Neighbouring places must be at most a window apart.
    """
    n = len(at)
    where = np.full(int(at[-1]) + 1, -1, dtype=np.int32)
    where[at] = np.arange(n, dtype=np.int32)
    powers = [1 << s for s in range(window.bit_length()) if 1 << s <= window]
    before: list = [()] * n
    for size in powers:
        hit = np.flatnonzero(at >= size)
        from_ = where[at[hit] - size]
        good = from_ >= 0
        for j, i in zip(hit[good].tolist(), from_[good].tolist()):
            before[j] = (*before[j], i)
    spot, cost = at.tolist(), price.tolist()
    best, back, keys = [0] * n, [0] * n, [0] * n  # keys: best + place
    queue, head = [0], 0  # places in the window with rising keys
    for j in range(1, n):
        p = spot[j]
        low = p - window
        while spot[queue[head]] < low:
            head += 1
        i = queue[head]
        value = keys[i] - low
        for b in before[j]:
            if best[b] < value:
                value, i = best[b], b
        value += cost[j] + SEQUENCE
        best[j], back[j] = value, i
        keys[j] = key = value + p
        while len(queue) > head and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(spot[j])
        j = back[j]
    return np.array(cuts[::-1], dtype=np.int64)


class Packer:
    """The tokens of one partition that are not packed yet."""

    def __init__(self, first_id: int, window: int):
        self.window, self.next_id = window, first_id
        self.ids, self.sentences = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        self.names: pa.Array | None = None
        self.starts, self.stops = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, names: pa.Array, ids: np.ndarray, lengths: np.ndarray, sentences: np.ndarray) -> None:
        base = len(self.ids)
        stops = base + np.cumsum(lengths)
        self.ids = np.concatenate([self.ids, ids])
        self.sentences = np.concatenate([self.sentences, base + sentences])
        self.starts, self.stops = np.concatenate([self.starts, stops - lengths]), np.concatenate([self.stops, stops])
        self.names = names if self.names is None else pa.concat_arrays([self.names, names])

    def pack(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Pieces of the windows that are sure; with ``last``, of all."""
        total = len(self.ids)
        if not total:
            return
        at, price = places(total, self.stops, self.sentences, self.window, last)
        cuts = plan(at, price, self.window)
        if not last:
            cuts = cuts[:-OPEN]
            if not len(cuts):
                return
        done = int(cuts[-1])
        edges = np.unique(np.concatenate([[0], cuts, self.stops[self.stops < done]]))
        begin, length = edges[:-1], np.diff(edges)
        doc = np.searchsorted(self.stops, begin, side="right")
        number = np.searchsorted(cuts, begin, side="right")
        opened = np.concatenate([[0], cuts[:-1]])[number]
        for some in range(0, len(begin), 4096):
            s = slice(some, some + 4096)
            low, high = int(begin[s][0]), int(edges[s.start + len(begin[s])])
            offsets = (edges[s.start : s.start + len(begin[s]) + 1] - low).astype(np.int32) * 4
            ids = pa.Array.from_buffers(pa.binary(), len(begin[s]), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.ids[low:high].tobytes())])
            columns = {
                "doc_id": self.names.take(pa.array(doc[s])),
                "start": begin[s] - self.starts[doc[s]],
                "length": length[s],
                "ids": ids,
                "doc_tokens": (self.stops - self.starts)[doc[s]],
                "sequence_id": self.next_id + number[s],
                "offset": begin[s] - opened[s],
            }
            yield pa.RecordBatch.from_pydict(columns)
        self.next_id += len(cuts)
        self.ids = self.ids[done:]
        self.sentences = self.sentences[self.sentences > done] - done
        open_ = self.stops > done
        self.names = self.names.filter(pa.array(open_))
        self.starts, self.stops = self.starts[open_] - done, self.stops[open_] - done


def pack(docs: DataFrame, definition: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian uint32), doc_tokens,
    sequence_id, offset.

    Null and empty texts consist of the end mark alone. Rows stay rows: repeated rows and
    null ids have pieces of their own; other columns are not looked at. An empty table
    gives no rows. Documents of any length are cut; no token is dropped.

    Nothing is shuffled: a sequence holds neighbours of one partition of ``docs``, whose
    number is in the high bits of its id. Plans are made for about a million tokens at a
    time, and the windows at the seam are planned again with what follows.
    """
    schema = StructType([StructField("doc_id", docs.schema[doc_id].dataType)])
    for name, kind in (("start", "long"), ("length", "long"), ("ids", "binary"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")):
        schema = schema.add(name, kind)
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(definition, end)
        packer = Packer(TaskContext.get().partitionId() << 33, window)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size < BATCH and i + 1 < len(texts):
                    continue
                packer.add(batch.column("doc_id").slice(at, i + 1 - at), *coder.encode(texts[at : i + 1]))
                at, size = i + 1, 0
                if len(packer.ids) >= BLOCK:
                    yield from packer.pack(last=False)
        yield from packer.pack(last=True)

    return rows.mapInArrow(run, schema)


def op12_window_packing(spark, sf_dir):
    import public_tokenizers

    definition = read_definition(public_tokenizers.path("word_bpe_49k.json"))
    packed = pack(table(spark, sf_dir, "documents"), definition)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
