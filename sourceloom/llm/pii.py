"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds to them.

The model is trained from a small labelled table and decoded by Viterbi in numpy batches.
A word whose emission prefers "none" by more than any transitions can make up for is fixed
to it before decoding; this never changes the best path, and cuts texts of any length
into short pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import table, text_batches, whole_text
from sourceloom.llm.wordarrays import mixed, powers

KINDS = ("email", "ip", "card", "phone")
FINE, COARSE = 1 << 15, 1 << 12
SAMPLE_DOCS = 4000  # documents whose patterns become labelled rows
SAMPLE_ROWS = 3000  # labelled rows used for training
BATCH = 1_000_000

# -- patterns -------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A failing run of digits fails from each of its digits, so only its first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the run of local characters before an @, and a domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _valid(kind: str, found: str) -> bool:
    digits = "".join(c for c in found if "0" <= c <= "9")
    if kind == "ip":
        parts = [p.lstrip("0") for p in found.split(".")]  # int() refuses very long runs
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the fixed patterns, by kind and start."""
    spans = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            spans += [(k, m.start(), m.end()) for m in pattern.finditer(text) if _valid(KINDS[k], m[0])]
    return spans


# -- words and their shapes --------------------------------------------------------

_SIGNS = "@.-+_/()%[]"
LEADING_ZERO = 31


def _classes() -> np.ndarray:
    """Character classes: 0 separates, 1 letter, 2 capital, 3 digit, then each sign."""
    classes = np.zeros(129, dtype=np.uint8)
    classes[128] = classes[97:123] = 1
    classes[65:91], classes[48:58] = 2, 3
    for i, sign in enumerate(_SIGNS):
        classes[ord(sign)] = 4 + i
    return classes


CLASSES = _classes()
_TRAILING = np.isin(np.arange(32), [4 + _SIGNS.index(c) for c in ".-/"])


class Words:
    """Words of several texts: text number, start and end in code points, shape ids."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        classes = CLASSES[np.minimum(code, 128)]
        edge = np.flatnonzero(np.diff(classes > 0, prepend=False))
        start, end = edge[0::2], edge[1::2].copy()
        for _ in range(3):
            end -= _TRAILING[classes[end - 1]] & (end - start > 1)
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.text = np.searchsorted(bounds, start, side="right") - 1
        self.start, self.end = start - bounds[self.text], end - bounds[self.text]
        self.fine, self.coarse = self._shapes(classes, start, end, code[start] == ord("0"))
        alone = np.zeros(1, dtype=np.int64)
        same = self.text[1:] == self.text[:-1]
        self.before = np.concatenate([alone, np.where(same, self.coarse[:-1], 0)]) if len(start) else alone[:0]
        self.after = np.concatenate([np.where(same, self.coarse[1:], 0), alone]) if len(start) else alone[:0]

    @staticmethod
    def _shapes(classes, start, end, zero):
        """Hashed shapes: runs of classes with the lengths of digit runs, and without.

        In the first kind a leading zero is a class of its own: dialling codes have one,
        numbers of things do not.
        """
        if not len(start):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        length = end - start
        offset = np.cumsum(length) - length
        own = classes[np.arange(int(length.sum())) + np.repeat(start - offset, length)]

        def hashed(own: np.ndarray, sized: bool) -> np.ndarray:
            new = np.diff(own, prepend=255) != 0
            new[offset] = True
            at = np.flatnonzero(new)
            run = np.diff(at, append=len(own))
            kind = own[at].astype(np.uint64)
            first = np.searchsorted(at, offset)
            runs = np.diff(first, append=len(at))
            power = powers(int(runs.max()))[np.arange(len(at)) - np.repeat(first, runs)]
            if sized:
                kind += np.where(kind == 3, np.minimum(run, 20) * 16, 0).astype(np.uint64)
            return mixed(np.add.reduceat((kind + np.uint64(1)) * power, first))

        marked = own.copy()
        marked[offset[zero]] = LEADING_ZERO
        fine, coarse = hashed(marked, True) % np.uint64(FINE - 1), hashed(own, False) % np.uint64(COARSE - 1)
        return fine.astype(np.int64) + 1, coarse.astype(np.int64) + 1

    def features(self) -> list[np.ndarray]:
        return [self.fine, self.coarse, self.before, self.after]


# -- the model ------------------------------------------------------------------------


class ShapeCrf:
    """Weights of a linear-chain CRF; label 0 is none, 1 to 4 are the kinds."""

    SIZES = (FINE, COARSE, COARSE, COARSE)

    def __init__(self, weights: list[np.ndarray] | None = None, moves: np.ndarray | None = None):
        n = len(KINDS) + 1
        self.weights = weights or [np.zeros((s, n), dtype=np.float32) for s in self.SIZES]
        self.moves = np.zeros((n, n), dtype=np.float32) if moves is None else moves

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        return sum(w[f] for w, f in zip(self.weights, features))

    def slack(self) -> float:
        """The most that transitions can gain from a label other than none at one place."""
        t = self.moves
        through = (t[:, 1:, None] + t[None, 1:, :]).max(axis=1)
        return float((through - (t[:, 0, None] + t[None, 0, :])).max())

    def viterbi(self, scores: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of pieces of ``scores``; what lies around a piece is labelled none."""
        labels = np.zeros(len(scores), dtype=np.int8)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            top = max(1, int(lengths[order[at]])) * 2
            stop = int(np.searchsorted(lengths[order], top, side="right"))
            stop = max(at + 1, min(stop, at + max(1, 2_000_000 // top)))
            self._decode(scores, firsts[order[at:stop]], lengths[order[at:stop]], labels)
            at = stop
        return labels

    def _decode(self, scores, firsts, lengths, labels) -> None:
        steps, n = int(lengths.max()), len(firsts)
        back = np.zeros((steps, n, len(self.moves)), dtype=np.int8)
        best = self.moves[0] + scores[firsts]
        for t in range(1, steps):
            live = lengths > t
            ways = best[:, :, None] + self.moves
            back[t] = ways.argmax(axis=1)
            step = ways.max(axis=1) + scores[np.where(live, firsts + t, firsts)]
            best = np.where(live[:, None], step, best)
        label = (best + self.moves[:, 0]).argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            live = lengths > t
            labels[(firsts + t)[live]] = label[live]
            label = np.where(live & (t > 0), back[t][np.arange(n), label], label)

    def decode(self, words: Words) -> np.ndarray:
        scores = self.emissions(words.features())
        if not len(scores):
            return np.zeros(0, dtype=np.int8)
        open_ = scores[:, 0] - scores[:, 1:].max(axis=1) <= self.slack() + 1e-3
        at = np.flatnonzero(open_)
        if not len(at):
            return np.zeros(len(scores), dtype=np.int8)
        breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(words.text[at]) != 0)) + 1
        begins = np.concatenate([[0], breaks])
        return self.viterbi(scores, at[begins], np.diff(begins, append=len(at)))

    def fit(self, words: Words, labels: np.ndarray, rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> ShapeCrf:
        """Full-batch Adam on the log-likelihood; each text is one sequence."""
        n = len(self.moves)
        count = np.bincount(words.text)
        count = count[count > 0]
        first = np.cumsum(count) - count
        steps, size = int(count.max()), len(count)
        place = np.minimum(first[:, None] + np.arange(steps), len(labels) - 1)
        mask = np.arange(steps) < count[:, None]
        y = np.where(mask, labels[place], 0)
        features = words.features()
        orders = [np.argsort(f, kind="stable") for f in features]
        cuts = [np.flatnonzero(np.diff(f[o], prepend=-1)) for f, o in zip(features, orders)]
        truth = np.zeros((n, n))
        np.add.at(truth, (0, y[:, 0]), 1)
        np.add.at(truth, (y[np.arange(size), count - 1], 0), 1)
        inner = mask[:, 1:]
        np.add.at(truth, (y[:, :-1][inner], y[:, 1:][inner]), 1)
        params = [*self.weights, self.moves]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, rounds + 1):
            e = self.emissions(features).astype(np.float64)[place]
            t = self.moves.astype(np.float64)
            ahead = np.zeros((steps, size, n))
            ahead[0] = t[0] + e[:, 0]
            for i in range(1, steps):
                ahead[i] = np.where(mask[:, i, None], _logsum(ahead[i - 1][:, :, None] + t, 1) + e[:, i], ahead[i - 1])
            total = _logsum(ahead[-1] + t[:, 0], 1)
            behind = np.tile(t[:, 0], (size, 1))
            expected, grads = np.zeros((n, n)), np.zeros((len(labels), n))
            for i in range(steps - 1, -1, -1):
                live = mask[:, i]
                near = np.exp(ahead[i] + behind - total[:, None])
                grads[place[live, i]] = near[live]
                expected[:, 0] += near[count == i + 1].sum(axis=0)
                if i:
                    pair = np.exp(ahead[i - 1][:, :, None] + t + (e[:, i] + behind)[:, None, :] - total[:, None, None])
                    expected += pair[live].sum(axis=0)
                    behind = np.where(live[:, None], _logsum(t[None] + (e[:, i] + behind)[:, None, :], 2), behind)
                else:
                    expected[0] += near.sum(axis=0)
            grads[np.arange(len(labels)), labels] -= 1
            changes = []
            for w, f, o, c in zip(self.weights, features, orders, cuts):
                g = decay * w.astype(np.float64)
                g[f[o][c]] += np.add.reduceat(grads[o], c)
                changes.append(g)
            changes.append(expected - truth + decay * t)
            for p, g, (m, v) in zip(params, changes, moments):
                m += 0.1 * (g - m)
                v += 0.05 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-3)).astype(np.float32)
        return self


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


# -- labelled rows ------------------------------------------------------------------------

# A hand-labelled table; marked spans are kind:text in double braces.
LABELLED = (
    "call {{phone:(555) 010-9999}} before noon",
    "phone {{phone:555-010-4477}} or write",
    "tel. {{phone:555.010.4477}} in the office",
    "reach me on {{phone:(030) 555-0199}} today",
    "the number is {{phone:+44 20 5550 1234}} at home",
    "ring {{phone:+1 (217) 555-0123}} soon",
    "mobile {{phone:0170-555-0188}} after six",
    "fax {{phone:(212) 555 0147}} for orders",
    "write to {{email:ann.lee@example.org}} please",
    "mail {{email:bob@host}} on the local net",
    "send it to {{email:c_d+tag@mail.example.com}} now",
    "address {{email:info[at]example.org}} for questions",
    "contact {{email:jo.doe(at)example.com}} about it",
    "ask {{email:sales[at]shop.example}} for prices",
    "server {{ip:10.20.30.40}} is down",
    "from {{ip:192.168.7.12}} to {{ip:203.0.113.9}} in order",
    "host {{ip:172.16.0.99}} answered",
    "card {{card:4111 1111 1111 1111}} was used",
    "paid with {{card:4111-1111-1111-1111}} in May",
    "paid with {{card:4012.8888.8888.1881}} again",
    "card no. {{card:5555/5555/5555/4444}} expired",
    "account {{card:378282246310005}} is closed",
    "{{card:4000056655665556}} was charged",
    "version 1.2.3 and release 10.4 of the tool",
    "in 2021-05-17 there were 1,200 visits",
    "chapter 12.3.4 section 5 page 117",
    "order 20231105 of 17 boxes at 3.50 each",
    "between 1914 and 1918 some 40 000 people",
    "the ratio 3/4 and 0.75 are equal",
    "room 12-34 on floor 5 (east)",
    "id 0123456789abcdef0123456789abcdef in hex",
    "token = f00dbabe12345678 was set",
    "the and of to in a is that with for",
    "Licensed under the Apache License, Version 2.0.",
    "General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "x1 y2 z3 and a-b c_d e/f",
    "from 9-17 on 1-2-2020 at 10:30",
    "la casa de los padres en 1999.",
    "der Hund und die Katze im Jahr 2001",
    "le chat et la souris de 1987 à 1990",
    "ISBN 978-3-16-148410-0 is a book",
    "call 911 or 112 in an emergency",
    "mean 0.123456789 with error 0.000012",
    "size 1024x768 at 60 Hz",
    "call {{phone:0221 555 0134}} before six",
    "home {{phone:040 5550 1177}} or work",
    "tel {{phone:0161 496 0345}} in Manchester",
    "mobile {{phone:07700 900456}} is best",
    "office {{phone:020 7946 0123}} in London",
    "dial {{phone:0033 1 5550 0142}} from abroad",
    "ring {{phone:0049 89 5550133}} in Munich",
    "phone {{phone:01632 960 555}} now",
    "{{phone:0891 555 0166}} is her number",
    "his number: {{phone:0711 555 0155}}, ask for Tim",
    "reach him at {{phone:030/555 01 77}} today",
    "fax {{phone:089/5550 1234}} for forms",
    "call {{phone:0151/5550188}} at once",
    "a message to {{phone:07911 123 456}} works",
    "number {{phone:0044 20 7946 0999}} for guests",
    "under {{phone:0531/555 02 33}} you get an answer",
    "the line {{phone:01632 960 001}} is open all day",
    "tel: {{phone:(0221) 555 0166}} or in person",
    "ask {{email:tom(at)example.org}} about it",
    "mail {{email:eve(at)uni.example.edu}} first",
    "e-mail {{email:lee[at]shop.example.com}} with orders",
    "send to {{email:a.lopez(at)example.co.uk}} please",
    "contact {{email:hr(at)firm.example.net}} for jobs",
    "write {{email:d.kim[at]example.org}} or call",
    "questions to {{email:max_b[at]mail.example.de}} only",
    "from {{email:office(at)town.example.fr}} since May",
    "address: {{email:j-p(at)lab.example.org}}, room 12",
    "copy {{email:ops[at]node.example.io}} on this",
    "card {{card:5500.0000.0000.0004}} was refused",
    "pay with {{card:4000/0566/5566/5556}} here",
    "billed to {{card:6011.0009.9013.9424}} in June",
    "add 500 000 and 20 000 to it",
    "the years 1914 1918 1939 1945 in a row",
    "some 1 000 000 people and 40 000 cars",
    "scores of 21 15 19 and 30 points",
    "codes 0001 0002 0003 in order",
    "lines 100 200 300 of the log",
    "from 10 000 to 20 000 units a year",
    "2020 2021 2022 were hard years",
    "at (noon) or (at) night",
    "look [at] this and (at) that",
    "parts 12/34 and 56/78 of the set",
    "sums of 12 345 678 and 9 876 543",
    "grid 040 050 060 by 010 020",
    "times 09 30 and 17 45 each day",
    "in 1871 the 555 men of the 20th",
    "rates of 0.25 0.50 0.75 in turn",
    "london line {{phone:020 7946 0311}} again",
    "ring {{phone:028 9018 0456}} in Belfast",
    "tel {{phone:0041 44 5550188}} in Zurich",
    "from home {{phone:0043 1 5550177}} or Vienna",
    "under {{phone:040/555 03 22}} from nine",
    "desk {{phone:0341/555 08 41}} is free",
    "sales {{phone:023 9249 0221}}, ask for Joe",
    "dates 2001 2002 2003 in a list",
    "keys 0010 0020 0030 of the map",
)
_MARK = re.compile(r"\{\{(\w+):(.*?)\}\}")
LABELLED_SCHEMA = "text string, spans array<struct<kind:string,start:int,end:int>>"


def labelled_table(spark: SparkSession) -> DataFrame:
    """The hand-labelled rows: text and spans."""
    rows = []
    for line in LABELLED:
        text, spans, at = "", [], 0
        for m in _MARK.finditer(line):
            text += line[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        rows.append((text + line[at:], spans))
    return spark.createDataFrame(rows, LABELLED_SCHEMA)


def pattern_labelled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled rows from surroundings of pattern matches in ``sample_docs`` documents.

    The documents are those of the smallest id hashes. Each match gives one row of some
    hundred characters, cut at spaces, with all matches inside it.
    """
    order = F.xxhash64(F.col(doc_id).cast("string"))
    picked = docs.select(order.alias("_hash")).distinct().orderBy("_hash").limit(sample_docs)
    rows = docs.select(order.alias("_hash"), whole_text(text).alias("text"))

    def run(frames):
        for frame in frames:
            out = []
            for t in frame["text"]:
                spans = base_spans(t)
                for _, s, e in spans[:4]:
                    low = t.rfind(" ", 0, max(0, s - 40)) + 1
                    high = t.find(" ", e + 40)
                    high = min(len(t), e + 80) if high < 0 or high > e + 120 else high
                    low = max(low, s - 160)
                    inside = [{"kind": KINDS[k], "start": a - low, "end": b - low} for k, a, b in spans if low <= a and b <= high]
                    out.append({"text": t[low:high], "spans": inside})
            yield pd.DataFrame(out, columns=["text", "spans"])

    return rows.join(F.broadcast(picked), "_hash", "left_semi").select("text").mapInPandas(run, LABELLED_SCHEMA)


def train(labelled: DataFrame, max_rows: int = SAMPLE_ROWS, rounds: int = 60, always: DataFrame | None = None) -> ShapeCrf:
    """A model from at most ``max_rows`` labelled rows, those of the smallest text hashes, and all
    rows of a small table that is ``always`` learned from.

    Rows with null or empty texts are left out; without rows the model finds nothing.
    """
    rows = labelled.where(F.length("text") > 0).orderBy(F.xxhash64("text"), "text").limit(max_rows).collect()
    if always is not None:
        rows += always.where(F.length("text") > 0).limit(max_rows).collect()
    words = Words([r["text"] for r in rows])
    if not len(words.text):
        return ShapeCrf()
    labels = np.zeros(len(words.text), dtype=np.int64)
    for i, row in enumerate(rows):
        own = np.flatnonzero(words.text == i)
        for span in row["spans"] or ():
            labels[own[(words.start[own] < span["end"]) & (words.end[own] > span["start"])]] = 1 + KINDS.index(span["kind"])
    return ShapeCrf().fit(words, labels, rounds)


# -- finding -----------------------------------------------------------------------------

_AT = re.compile(r"@|\[at\]|\(at\)")


def plausible(kind: int, found: str) -> bool:
    """Whether a span of the model has what its kind needs."""
    digits = "".join(c for c in found if "0" <= c <= "9")
    if kind == 0:
        left, *right = _AT.split(found)
        return len(right) == 1 and bool(left) and any(c.isalpha() for c in right[0]) and " " not in found
    if kind == 1:
        parts = re.split(r"[^0-9]+", found)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in found)
    return 9 <= len(digits) <= 15 and not any(c.isalpha() or c in "%_@" for c in found)


def found_spans(model: ShapeCrf, texts: list[str]) -> list[tuple[list, list]]:
    """Per text: pattern spans, and spans of the model that meet none of them."""
    base = [base_spans(t) for t in texts]
    words = Words(texts)
    labels = model.decode(words)
    more: list[list] = [[] for _ in texts]
    at = np.flatnonzero(labels)
    if len(at):
        parted = (np.diff(at) > 1) | (np.diff(labels[at]) != 0) | (np.diff(words.text[at]) != 0)
        begins = np.concatenate([[0], np.flatnonzero(parted) + 1])
        for i, j in zip(at[begins], at[np.concatenate([begins[1:], [len(at)]]) - 1]):
            n, kind = int(words.text[i]), int(labels[i]) - 1
            s, e = int(words.start[i]), int(words.end[j])
            if not any(a < e and s < b for _, a, b in base[n]) and plausible(kind, texts[n][s:e]):
                more[n].append((kind, s, e))
    return list(zip(base, more))


def find_personal_data(docs: DataFrame, model: ShapeCrf, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, base and added spans as arrays of (kind, start, end).

    Offsets are code points, end exclusive. Null and empty texts have no spans. Rows stay
    rows, repeated ones and null ids included, and nothing is shuffled; other columns are
    not looked at. Memory follows a batch of texts or the longest single text.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.moves))
    spans = "array<struct<kind:string,start:int,end:int>>"
    named = lambda found: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(found)]

    def run(frames):
        crf = ShapeCrf(*shared.value)
        for part in text_batches(frames, "text", BATCH):
            found = found_spans(crf, part["text"].tolist())
            yield pd.DataFrame({"doc_id": part["doc_id"], "base": [named(b) for b, _ in found], "added": [named(m) for _, m in found]})

    return docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")).mapInPandas(run, f"doc_id {kind}, base {spans}, added {spans}")


def joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_kind_order(spans) -> Column:
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op1_shape_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(pattern_labelled(docs), always=labelled_table(spark))
    found = find_personal_data(docs, model)
    return found.select(
        "doc_id",
        *[_count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined(in_kind_order(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def digest(spans: list[tuple[int, int, int]]) -> str:
    """The digest of spans in order, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
