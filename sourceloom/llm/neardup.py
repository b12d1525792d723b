"""Near-duplicates by order MinHash with verification by banded alignment.

A sketch takes the smallest occurrence-labelled k-mers of words under one hash function and
keeps their order in the text, so that it follows edit similarity. Texts that share a key
are candidates: a sketch of two k-mers of three words, one minimum of five words, or, for
short texts, any three words in a row. Links are verified by an alignment of the words within
a band, and groups are the connected components of verified links.

Pairs are taken in rounds. Each text is first compared with the smallest id that it meets,
then with the smallest id of each of its keys that is not in its group by then; this joins
most families of copies. Where a key still holds several groups, pairs across them are
tested by bounds that all alike texts meet. Texts of a key that many share meet there by
their rarest words instead, long ones by pairs of neighbouring words, of which alike texts have
one in common near the same place. Of the pairs that are left, some for each two groups are aligned, then more, until the groups are one or no pair
is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.common import discard, row_key, stored, table, text_batches, whole_text
from sourceloom.llm.wordarrays import ALNUM, MULTIPLIER, gram_hashes, mixed, powers, word_hashes
from sourceloom.operators.sizing import broadcast_if_small

K = 5  # words of a k-mer
SIMILARITY = 0.8  # 1 - edits / words of the longer text
SKETCHES = 8  # hash functions that take one minimum of K words
ORDERED = 5  # order sketches of shorter k-mers for each of them
MINIMA = 2  # k-mers of an order sketch
# At similarity 0.8 the edits leave three words in a row of any text of six words or more,
# and two of five words, wherever they are.
SHORT_K = 3
SHORT_WORDS = 34  # texts up to this length are met by each of their shorter k-mers
TINY_WORDS = 5
FEW = 40  # edits up to which diagonals are followed
CROWD = 128  # texts of a key that are compared with each other; more meet by rare words
BLOCK = 512  # texts of a rare word that one task compares with as many others
LONG_WORDS = 64  # texts of more words meet by rare pairs of neighbouring words, not by rare words
FREQUENT = 100_000  # words whose frequency counts, and pairs of them; all others are taken to be rarer
RARE = "key long, size int, rank int, first int, last int"
BAG = 256  # bytes of a bag: counters of words, or bits of pairs of words of a text of more
FOLDED = 32  # sums of neighbouring counters that are compared first
PAIRS = 1 << 17  # pairs that are compared at once
FIRST = 2  # pairs of two groups that are aligned in the first round, and by how much
MORE = 8  # more in each later one
BATCH = 500_000


def occurrence_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of a text, each with the number of its occurrence so far."""
    kmers = gram_hashes(words, k)
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(kmers) else np.zeros(0, int)
    if len(new) == len(kmers):
        return kmers
    count = np.arange(len(kmers)) - np.repeat(new, np.diff(new, append=len(kmers)))
    times = np.empty(len(kmers), dtype=np.uint64)
    times[order] = count.astype(np.uint64)
    return np.where(times > 0, mixed(kmers + times * MULTIPLIER), kmers)


def sequence_hash(words: np.ndarray) -> int:
    """A hash of all words in order, as a signed 64-bit number."""
    h = (words * powers(len(words))).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words))
    return int(mixed(h).view(np.int64)[0])


def labelled_kmers(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The occurrence-labelled k-mers of many texts with words, and where those of each start.

    A text of fewer words has one k-mer, of all of them.
    """
    ends = np.cumsum(counts)
    kmers = gram_hashes(words, k) if len(words) >= k else words[:0]
    place = np.arange(len(words)) - np.repeat(ends - counts, counts)
    whole = place[: len(kmers)] + k <= np.repeat(counts, counts)[: len(kmers)]
    sizes = np.maximum(counts - k + 1, 1)
    out = np.empty(int(sizes.sum()), dtype=np.uint64)
    starts = np.cumsum(sizes) - sizes
    short = np.flatnonzero(counts < k)
    mark = np.ones(len(out), dtype=bool)
    mark[starts[short]] = False
    out[mark] = kmers[whole]
    for i in short.tolist():
        out[starts[i]] = gram_hashes(words[ends[i] - counts[i] : ends[i]], k)[0]
    own = out ^ mixed(np.repeat(np.arange(len(counts), dtype=np.uint64), sizes) * MULTIPLIER)
    order = np.argsort(own, kind="stable")
    same = np.flatnonzero(own[order][1:] == own[order][:-1]) + 1
    if len(same):
        new = np.ones(len(out), dtype=bool)
        new[same] = False
        first = np.flatnonzero(new)
        times = np.empty(len(out), dtype=np.uint64)
        times[order] = (np.arange(len(out)) - np.repeat(first, np.diff(first, append=len(out)))).astype(np.uint64)
        out = np.where(times > 0, mixed(out + times * MULTIPLIER), out)
    return out, starts


def order_sketches(kmers: np.ndarray, starts: np.ndarray, sketches: int, minima: int, seed: int) -> np.ndarray:
    """One row per text and one hash per sketch: its ``minima`` smallest k-mers (one or two), in text order."""
    x = (kmers >> np.uint64(32)).astype(np.uint32)
    place = np.arange(len(kmers), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    seeds = mixed((np.arange(2 * sketches, dtype=np.uint64) + np.uint64(2 * seed + 1)) * MULTIPLIER).astype(np.uint32)
    out = np.empty((len(starts), sketches), dtype=np.uint64)
    for s in range(sketches):
        h = ((x * (seeds[2 * s] | np.uint32(1)) + seeds[2 * s + 1]).astype(np.uint64) << np.uint64(32)) | place
        first = (np.minimum.reduceat(h, starts) & low).astype(np.int64)
        sketch = mixed(kmers[first])
        if minima > 1:
            h[first] = np.uint64(0xFFFFFFFFFFFFFFFF)
            least = np.minimum.reduceat(h, starts)
            second = (least & low).astype(np.int64)
            alone = least == np.uint64(0xFFFFFFFFFFFFFFFF)
            second[alone] = first[alone]
            left, right = np.minimum(first, second), np.maximum(first, second)
            sketch = np.where(alone, sketch, mixed(mixed(kmers[left]) * MULTIPLIER + kmers[right]))
        out[:, s] = sketch + np.uint64(s)
    return out


def keys_of_texts(words: np.ndarray, counts: np.ndarray, k: int = K, sketches: int = SKETCHES) -> list[np.ndarray]:
    """Keys of texts that follow each other in ``words``; texts that share one are candidates.

    One minimum of ``k`` words per hash function; order sketches of shorter k-mers, which edits
    at regular distances leave; and all shorter k-mers of a short text, so that no two short
    texts that are alike are missed. A text without words has no keys.
    """

    def named(kind: int, h: np.ndarray) -> np.ndarray:
        return mixed(h * MULTIPLIER + np.uint64(kind * 1000))

    filled = np.flatnonzero(counts > 0)
    keys: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(counts)
    if not len(filled):
        return keys
    counts = counts[filled]
    short = min(SHORT_K, k)
    long_kmers, long_starts = labelled_kmers(words, counts, k)
    kmers, starts = labelled_kmers(words, counts, short)
    # The hash functions of both kinds have nothing in common.
    ones = named(1, order_sketches(long_kmers, long_starts, sketches, 1, 0))
    twos = named(2, order_sketches(kmers, starts, sketches * ORDERED, MINIMA, 1000))
    ends = np.append(starts[1:], len(kmers))
    word_ends = np.cumsum(counts)
    for n, i in enumerate(filled.tolist()):
        own = [ones[n], twos[n]]
        if counts[n] <= SHORT_WORDS:
            own.append(named(3, kmers[starts[n] : ends[n]]))
        if counts[n] <= TINY_WORDS:
            own.append(named(4, occurrence_kmers(words[word_ends[n] - counts[n] : word_ends[n]], 2)))
        keys[i] = np.concatenate(own)
    return keys


def keys_of(words: np.ndarray, k: int = K, sketches: int = SKETCHES) -> np.ndarray:
    """The keys of one text."""
    return keys_of_texts(words, np.array([len(words)]), k, sketches)[0]


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most + 1``.

    Diagonals within the band are followed as far as they match; step d holds the furthest
    places that d edits reach. What needs more than ``FEW`` edits is aligned by columns.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    limit = min(n, m)
    differ = np.flatnonzero(a[:limit] != b[:limit])
    head = int(differ[0]) if len(differ) else limit
    a, b = a[head:], b[head:]
    limit = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - limit :][::-1] != b[len(b) - limit :][::-1])
    tail = int(differ[0]) if len(differ) else limit
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m)

    def slide(i: int, j: int) -> int:
        step = 16
        while i < n and j < m:
            size = min(step, n - i, m - j)
            differ = a[i : i + size] != b[j : j + size]
            k = int(differ.argmax())
            if differ[k]:
                return i + k
            i, j, step = i + size, j + size, step * 4
        return i

    goal = n - m  # the diagonal i - j of the end
    reach = {0: slide(0, 0)}
    for d in range(min(most, FEW) + 1):
        if reach.get(goal, -1) >= n:
            return d
        ahead = {}
        for diagonal in range(-d - 1, d + 2):
            if abs(diagonal - goal) > most - d or abs(diagonal) > most:
                continue
            i = max(reach.get(diagonal, -2) + 1, reach.get(diagonal - 1, -2) + 1, reach.get(diagonal + 1, -1))
            i = min(i, n, m + diagonal)
            if i >= 0 and i - diagonal >= 0:
                ahead[diagonal] = slide(i, i - diagonal)
        reach = ahead
    if most <= FEW:
        return most + 1
    return min(bit_parallel_edits(a.tolist(), b.tolist()), most + 1)


def bit_parallel_edits(a: list, b: list) -> int:
    """Edit distance by columns whose differences are the bits of two integers."""
    full = (1 << len(a)) - 1
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    up, down, last, score = full, 0, 1 << (len(a) - 1), len(a)
    for y in b:
        match = where.get(y, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        more, less = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(more & last) - bool(less & last)
        more, less = (more << 1) | 1, less << 1
        up, down = (less | (full & ~(diagonal | more))) & full, more & diagonal & full
    return score


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - edits / length of the longer reaches ``similarity``."""
    longer = max(len(a), len(b))
    most = int(longer * (1 - similarity) + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return False
    # Each edit takes at most one common word away: a bound that rejects most others.
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if longer - int(np.minimum(nx[i], ny[j]).sum()) > most:
        return False
    return edits_within(a, b, most) <= most


def level_of(n: np.ndarray) -> np.ndarray:
    """0 for texts whose words are counted; of others, how often the pairs of words are halved, and one."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / BAG))).astype(np.int64)


def word_bag(words: np.ndarray, similarity: float = SIMILARITY) -> bytes:
    """How many words fall on each of ``BAG`` counters, up to 255; of a long text, bits of pairs of words.

    Counters would say nothing about a long text, and most words of unlike ones are the same. Of
    its pairs of neighbouring words, each with the number of its occurrence, a part sets bits that
    their hashes choose alike in every text: all at the first level, half at each further one. A
    text that is nearly long enough for the next level has a second bag, of that one.
    """
    n = len(words)
    level = int(level_of(np.array([n]))[0])
    next_too = n > similarity * BAG * 2**level
    items = occurrence_kmers(words.astype(np.uint64), 2) if level or next_too else words

    def counted() -> bytes:
        return np.minimum(np.bincount((words % np.uint64(BAG)).astype(np.int64), minlength=BAG), 255).astype(np.uint8).tobytes()

    def part(level: int) -> bytes:
        bits = np.zeros(BAG * 8, dtype=np.uint8)
        bits[(items[items & np.uint64((1 << (level - 1)) - 1) == 0] >> np.uint64(32)) % np.uint64(BAG * 8)] = 1
        return np.packbits(bits).tobytes()

    return (part(level) if level else counted()) + (part(level + 1) if next_too else b"")


def split_bags(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and second bags as matrices of bytes; a missing one is empty."""
    none = bytes(BAG)
    both = [b"".join(x[at : at + BAG] or none for x in bags) for at in (0, BAG)]
    first, second = (np.frombuffer(x, np.uint8).reshape(len(bags), BAG) for x in both)
    return first, second


def counts_allow(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts of ``n`` and ``m`` words may be alike by counters ``a`` and ``b`` of their words.

    An edit takes at most one word from the bag of each text. Sums of counters obey the same bound.
    """
    gap = a.astype(np.int16) - b
    lost = (np.abs(gap).sum(axis=1, dtype=np.int64) + np.abs(gap.sum(axis=1, dtype=np.int64))) // 2
    return lost <= (np.maximum(n, m) * (1 - similarity) + 1e-9).astype(np.int64)


def bits_allow(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, level: np.ndarray, similarity: float) -> np.ndarray:
    """The same by bits of pairs of words of one level, of which an edit takes at most two.

    Where a part of the pairs is taken, the lost ones in it may exceed their share by five
    standard deviations, which fewer than one in a million alike pairs do.
    """
    x, y = a.view(np.uint64), b.view(np.uint64)
    lost = np.maximum(np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
    most = 2 * (np.maximum(n, m) * (1 - similarity) + 1e-9).astype(np.int64)
    share = most / 2.0 ** (level - 1)
    return lost <= np.where(level == 1, most, share + 5 * np.sqrt(share) + 1)


def bags_allow(n: np.ndarray, m: np.ndarray, a: tuple, b: tuple, similarity: float) -> np.ndarray:
    """Whether texts of ``n`` and ``m`` words with bags ``a`` and ``b`` (first, second) may be alike.

    An edit changes the length by one at most. Texts more than one level apart have no bags of
    the same kind.
    """
    x, y = level_of(n), level_of(m)
    higher = np.maximum(x, y)
    good = np.abs(n - m) <= (np.maximum(n, m) * (1 - similarity) + 1e-9).astype(np.int64)
    near = good & (np.abs(x - y) <= 1)
    at = np.flatnonzero(near & (higher == 0))
    good[at] = counts_allow(n[at], m[at], a[0][at], b[0][at], similarity)
    at = np.flatnonzero(near & (higher > 0))
    left = np.where((x[at] < higher[at])[:, None], a[1][at], a[0][at])
    right = np.where((y[at] < higher[at])[:, None], b[1][at], b[0][at])
    good[at] = bits_allow(n[at], m[at], left, right, higher[at], similarity)
    return good


def pairs_of_cells(cells: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of one cell, about ``PAIRS`` at a time; in a cell with two blocks, across them.

    ``cells`` numbers the cells, which follow each other.
    """
    new = np.ones(len(cells), dtype=bool)
    new[1:] = cells[1:] != cells[:-1]
    begin = np.flatnonzero(new)
    sizes = np.diff(begin, append=len(cells))
    across = np.repeat(np.minimum.reduceat(blocks, begin) != np.maximum.reduceat(blocks, begin), sizes) if len(begin) else new
    partners = np.repeat(begin + sizes, sizes) - np.arange(len(cells)) - 1
    made = np.cumsum(partners)
    low = 0
    while low < len(cells):
        high = max(low + 1, int(np.searchsorted(made, (made[low - 1] if low else 0) + PAIRS, side="right")))
        n = partners[low:high]
        a = np.repeat(np.arange(low, high), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        good = ~across[a] | (blocks[a] != blocks[b])
        yield a[good], b[good]
        low = high


def may_be_alike(roots: np.ndarray, blocks: np.ndarray, lengths: np.ndarray, bags: list[bytes], similarity: float = SIMILARITY, cells: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of texts of one cell with different roots that the bounds leave.

    ``cells`` numbers the cells of the texts, which follow each other; without it all are of one.
    In a cell with two blocks, pairs lie across them. Sums of neighbouring counters of the bags
    reject most pairs of shorter texts.
    """
    bags_of = split_bags(bags)
    folded = bags_of[0].reshape(len(bags), FOLDED, BAG // FOLDED).sum(axis=2, dtype=np.int16)
    levels = level_of(lengths)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in pairs_of_cells(np.zeros(len(roots), np.int64) if cells is None else cells, blocks):
        most = (np.maximum(lengths[a], lengths[b]) * (1 - similarity) + 1e-9).astype(np.int64)
        good = (roots[a] != roots[b]) & (np.abs(lengths[a] - lengths[b]) <= most)
        at = np.flatnonzero(good & (levels[a] == 0) & (levels[b] == 0))
        good[at] = counts_allow(lengths[a[at]], lengths[b[at]], folded[a[at]], folded[b[at]], similarity)
        a, b = a[good], b[good]
        for at in range(0, len(a), PAIRS * FOLDED // BAG):
            x, y = a[at : at + PAIRS * FOLDED // BAG], b[at : at + PAIRS * FOLDED // BAG]
            good = bags_allow(lengths[x], lengths[y], tuple(z[x] for z in bags_of), tuple(z[y] for z in bags_of), similarity)
            left.append(x[good])
            right.append(y[good])
    return np.concatenate(left), np.concatenate(right)


def bounded(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the bounds on lengths and bags leave."""
    side = lambda end: texts.select(F.col("id").alias(end), F.col("n_words").alias(f"n_{end}"), F.col("bag").alias(f"bag_{end}"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                bags = [split_bags(frame[c].tolist()) for c in ("bag_a", "bag_b")]
                good = bags_allow(frame["n_a"].to_numpy(), frame["n_b"].to_numpy(), *bags, similarity)
                yield frame.loc[good, ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long")


def rare_words(texts: DataFrame, similarity: float) -> DataFrame:
    """The rarest words of each text, so many that alike texts have one in common.

    The columns of ``texts`` but its words, and ``key``; ``size``, which is 2 for keys of two
    neighbouring words, by which texts of more than ``LONG_WORDS`` meet (near that length texts
    meet both ways); ``rank``, the words or pairs of the text before it; its ``first`` and ``last`` place.

    In an alignment of alike texts, (1 - similarity) n of n words at most have no partner, and
    twice as many pairs, so that of one more, the first in any order of all words, one has. The
    order is by frequency among these texts, as far as the ``FREQUENT`` most frequent ones tell
    it; of other pairs by the product of those of their words; and by hash.
    """
    paired = 2 * (1 - similarity) <= 1

    def grams_of(words: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Size, words and grams, for each way in which a text meets others."""
        own = np.frombuffer(words, np.uint32).astype(np.uint64)
        if len(own) <= LONG_WORDS or not paired:
            yield 1, own, gram_hashes(own, 1, 1)
        if len(own) > similarity * LONG_WORDS and paired:
            yield 2, own, gram_hashes(own, 2, 2)

    def frequent(size: int) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent words or pairs, and how often they occur."""

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if size == 1:
                    held = [np.frombuffer(w, np.uint32).astype(np.uint64) for w in frame["words"]]
                else:
                    held = [grams for w in frame["words"] for n, _, grams in grams_of(w) if n == size]
                if held:
                    item, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pd.DataFrame({"item": item.view(np.int64), "n": n})

        counts = texts.select("words").mapInPandas(count, "item long, n long").groupBy("item").agg(F.sum("n").alias("n"))
        top = counts.where("n > 1").orderBy(F.desc("n"), "item").limit(FREQUENT).toArrow()
        item, n = top["item"].to_numpy().view(np.uint64), top["n"].to_numpy()
        order = np.argsort(item)
        return item[order], n[order]

    shared = texts.sparkSession.sparkContext.broadcast((frequent(1), frequent(2)))
    kept = [c for c in texts.columns if c != "words"]

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def often(items: np.ndarray, size: int) -> np.ndarray:
            known, n = shared.value[size - 1]
            if not len(known):
                return np.zeros(len(items))
            at = np.minimum(np.searchsorted(known, items), len(known) - 1)
            return np.where(known[at] == items, n[at], 0).astype(np.float64)

        for frame in frames:
            found = []
            for row, words in enumerate(frame["words"]):
                for size, own, grams in grams_of(words):
                    weight = often(own, 1)
                    if size == 2:
                        single = np.maximum(weight, 1)
                        weight = often(grams, 2) * 1e18 + (single[:-1] * single[1:])[: len(grams)]
                    places = np.lexsort((grams, weight))
                    ordered = grams[places]
                    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                    most = size * int(len(own) * (1 - similarity) + 1e-9) + size - 1
                    n = int(np.searchsorted(starts, most, side="right"))
                    ends = np.minimum.reduceat(places, starts)[:n], np.maximum.reduceat(places, starts)[:n]
                    found.append((np.full(n, row), ordered[starts[:n]].view(np.int64), np.full(n, size), starts[:n], *ends))
            if found:
                row, *rest = (np.concatenate(x) for x in zip(*found))
                yield frame[kept].iloc[row].reset_index(drop=True).assign(**dict(zip(("key", "size", "rank", "first", "last"), rest)))

    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept)
    return texts.mapInPandas(pick, f"{schema}, {RARE}")


def rare_allow(a: dict, b: dict, similarity: float) -> np.ndarray:
    """Whether texts that share a rare word may be alike by their lengths, groups, ranks and places.

    Of the first word that an alignment pairs, the words before it in either text are lost, and
    its places are no further apart than the edits; words that the longer text has more are edits too.
    """
    n, m = a["n_words"], b["n_words"]
    most = (np.maximum(n, m) * (1 - similarity) + 1e-9).astype(np.int64)
    lost = a["size"] * most
    good = (a["root"] != b["root"]) & (np.abs(n - m) <= most)
    good &= (a["rank"] <= lost - np.maximum(m - n, 0)) & (b["rank"] <= lost - np.maximum(n - m, 0))
    return good & (a["first"] - b["last"] <= most) & (b["first"] - a["last"] <= most)


def whole_cells(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of whole cells, which follow each other, with the number of the cell."""

    def numbers(rows: pd.DataFrame) -> np.ndarray:
        at = rows[by].to_numpy()
        return np.cumsum(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)]))

    held: list[pd.DataFrame] = []  # the last cell may go on in the next batch
    for frame in frames:
        if not len(frame):
            continue
        rows = pd.concat([*held, frame], ignore_index=True)
        cells = numbers(rows)
        last = int(np.searchsorted(cells, cells[-1]))
        if last:
            yield rows[:last], cells[:last]
        held = [rows[last:]]
    for rows in held:
        yield rows, numbers(rows)


def rare_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): texts that share a rare word and may be alike by ``rare_allow``, some of them repeated.

    ``rows`` are those of ``rare_words`` for texts (id, root, n_words). They are narrow, and meet
    without their bags. What more than ``BLOCK`` texts share is passed on and cut into blocks that
    meet pairwise, each two in one cell, so that no task compares them all.
    """
    columns = ["id", "root", "n_words", "key", "size", "rank", "first", "last"]
    passed = f"a long, b long, {', '.join(f'{c} {rows.schema[c].dataType.simpleString()}' for c in columns)}, crowded boolean"

    def pairs_of(rows: pd.DataFrame, cells: np.ndarray, blocks: np.ndarray) -> pd.DataFrame:
        values = {c: rows[c].to_numpy(np.int64) for c in columns}
        found = [np.zeros((0, 2), np.int64)]
        for a, b in pairs_of_cells(cells, blocks):
            good = rare_allow({c: x[a] for c, x in values.items()}, {c: x[b] for c, x in values.items()}, similarity)
            a, b = values["id"][a[good]], values["id"][b[good]]
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0))
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cells in whole_cells(frames, ["key"]):
            n = np.bincount(cells)[cells]
            some = (n > 1) & (n <= BLOCK)
            yield pairs_of(rows[some], cells[some], np.zeros(some.sum(), np.int64)).assign(**dict.fromkeys(columns, 0), crowded=False)
            if (n > BLOCK).any():
                yield rows.loc[n > BLOCK, columns].assign(a=0, b=0, crowded=True)

    def meet_across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cells in whole_cells(frames, ["key", "i", "j"]):
            yield pairs_of(rows, cells, rows["block"].to_numpy())

    met = stored(rows.select(columns).repartition("key").sortWithinPartitions("key").mapInPandas(meet, passed), "met")
    pairs, crowd = met.where("not crowded").select("a", "b"), met.where("crowded").select(columns)
    if not crowd.limit(1).count():
        return pairs
    last = F.ceil(F.col("n") / BLOCK).cast("int") - 1
    cut = crowd.join(crowd.groupBy("key").agg(F.count("*").alias("n")), "key").withColumn("last_block", last)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("last_block") + 1).cast("int"))
    dealt = cut.select("*", F.explode(F.sequence(F.lit(0), "last_block")).alias("other"))
    cells = dealt.select(*columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    ordered = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return pairs.unionByName(ordered.mapInPandas(meet_across, "a long, b long"))


def open_groups(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, key, root, n) of the keys of ``met`` (id, key) whose texts are of several groups, with
    the texts of the key. Keys of the same texts are taken once."""
    crowd = met.join(roots, "id", "left").select("id", "key", F.coalesce("root", "id").alias("root"))
    keys = crowd.groupBy("key").agg(
        F.min("root").alias("_low"), F.max("root").alias("_high"), F.bit_xor(F.xxhash64("id")).alias("_who"), F.count("*").alias("n")
    )
    keys = keys.where(F.col("_low") < F.col("_high")).groupBy("_who", "n").agg(F.min("key").alias("key"))
    return crowd.join(keys.select("key", "n"), "key")


def candidates_left(met: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of texts of one key that are of different groups and may be alike.

    ``met`` has (id, key), ``texts`` (id, n_words, bag, words). A key of up to ``CROWD`` texts is
    one cell. The texts of larger ones meet by their rarest words. Cells are read one after the
    other; bags travel to the cells of keys and to the pairs of rare words, words do not.
    """
    first = stored(open_groups(met, roots), "open")
    small = F.col("n") <= CROWD
    crowded = broadcast_if_small(first.where(~small).select("id", "root").distinct())
    rare = rare_words(texts.select("id", "n_words", "words").join(crowded, "id"), similarity)
    # Stored, so that the shuffles behind it are gone when bags move.
    many = bounded(broadcast_if_small(stored(rare_pairs(rare, similarity).distinct(), "met")), texts, similarity)
    cells = first.where(small).select("key", "id", "root").join(texts.select("id", "n_words", "bag"), "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cells in whole_cells(frames, ["key"]):
            ids, roots, lengths = (rows[c].to_numpy() for c in ("id", "root", "n_words"))
            left, right = may_be_alike(roots, np.zeros(len(rows), np.int64), lengths, rows["bag"].tolist(), similarity, cells)
            yield pd.DataFrame({"a": np.minimum(ids[left], ids[right]), "b": np.maximum(ids[left], ids[right])})

    few = cells.repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")
    return few.unionByName(many).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) of each linked id: ids with the same root are connected.

    Each round points every node to the smallest of its neighbours and itself, follows
    that pointer twice, and contracts: links get the names of where their ends point to,
    and those inside one node vanish. A star is gone after one round, a path halves.
    Rounds are stored in the shared folder; only a row count comes to the driver.
    """
    edges, labels = links.select("a", "b"), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("to")), "points")
        twice = point.join(point.select(F.col("id").alias("to"), F.col("to").alias("root")), "to").select("id", "root")
        jump = stored(twice, "jumps")
        to = lambda side: jump.select(F.col("id").alias(side), F.col("root").alias(f"{side}_root"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").where(F.col("a_root") != F.col("b_root"))
        edges = stored(moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
        if labels is None:
            labels = jump
        else:
            renamed = jump.select(F.col("id").alias("root"), F.col("root").alias("further"))
            labels = stored(labels.join(renamed, "root", "left").select("id", F.coalesce("further", "root").alias("root")), "labels")
        if not edges.limit(1).count():
            return labels
    raise RuntimeError("components did not settle")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after more links; what is not in ``roots`` is a group of its own."""
    side = lambda end: roots.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
    named = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    named = named.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b").distinct()
    further = components(stored(named, "merges"))
    moved = roots.join(further.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left")
    moved = moved.select("id", F.coalesce("to", "root").alias("root"))
    return stored(moved.unionByName(further.join(roots, "id", "left_anti")), "roots")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, similarity: float = SIMILARITY, sketches: int = SKETCHES) -> DataFrame:
    """(_key, doc_id, class_key, n_links) per row of ``docs``; rows of one class are near-duplicates.

    Texts are compared as words: runs of letters and digits, ASCII letters lower-cased.
    Equal word sequences form one class from the start, represented by its smallest key,
    so copies are never paired. Texts without words (null ones included) are alike only
    if they are equal. ``n_links`` counts the verified links of the row's representative
    that make the class; it is no count of all alike texts, as pairs that are in one class
    already are not compared.
    Rows stay rows, repeated ones and null ids included; an empty table gives no rows.

    Alike texts end in different classes only if none of the keys, and no other text, brings
    them together. Each text gives a bounded number of keys, and minima and maxima of a key
    are combined before the shuffle. The first rounds compare a text with one other per key
    at most. The last ones work on keys whose texts are of several classes; there the bounds
    are tested for the pairs of up to ``CROWD`` texts, or of texts that share a rare word or pair of words.
    """

    def own_words(texts: list[str]) -> list[np.ndarray]:
        hashes, counts = word_hashes(texts, ALNUM)
        return np.split(hashes, np.cumsum(counts)[:-1])

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in text_batches(frames, "text", BATCH):
            hashes, counts = word_hashes(part["text"].tolist(), ALNUM)
            words = np.split(hashes, np.cumsum(counts)[:-1])
            same = [sequence_hash(w) if len(w) else int(h) for w, h in zip(words, part["same"])]
            keys = [x.view(np.int64) for x in keys_of_texts(hashes, counts, k, sketches)]
            yield part[["_key", "doc_id"]].assign(same=same, keys=keys)

    kind = docs.schema[doc_id].dataType.simpleString()
    keyed = docs.select(F.to_json(row_key(doc_id, text)).alias("_key"), F.col(doc_id).alias("doc_id"), F.xxhash64(whole_text(text)).alias("same"), whole_text(text).alias("text"))
    made = stored(keyed.mapInPandas(sketch, f"_key string, doc_id {kind}, same long, keys array<long>"), "sketches")
    # ``same`` is a hash of the words, and the id of a distinct text from here on.
    dealt = made.select("same", "keys").dropDuplicates(["same"]).select(F.col("same").alias("id"), F.explode("keys").alias("key"))
    ends = dealt.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where(F.col("low") < F.col("high"))
    met = stored(dealt.join(ends.select("key", "low", "n"), "key"), "meetings")
    meets = met.where(F.col("id") != F.col("low"))
    pairs = stored(meets.groupBy("id").agg(F.min("low").alias("a")).select("a", F.col("id").alias("b")), "pairs")
    involved = met.select(F.col("id").alias("same")).distinct()
    reps = stored(made.groupBy("same").agg(F.min("_key").alias("_key")).join(involved, "same"), "involved")

    def words_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in text_batches(frames, "text", BATCH):
            words = own_words(part["text"].tolist())
            coded, bags = [w.astype(np.uint32) for w in words], [word_bag(w, similarity) for w in words]
            yield pd.DataFrame({"id": part["id"], "n_words": [len(w) for w in words], "bag": bags, "words": [w.tobytes() for w in coded]})

    # Few keys go to the texts; of many, the texts come to them.
    asked = broadcast_if_small(reps.withColumnRenamed("same", "id"))
    fetched = keyed.select("_key", "text").join(asked, "_key").select("id", "text")
    texts = stored(fetched.mapInPandas(words_of, "id long, n_words long, bag binary, words binary").dropDuplicates(["id"]), "words")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = [alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similarity) for x, y in zip(frame["left"], frame["right"])]
            yield frame.loc[np.array(good, dtype=bool), ["a", "b"]]

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b). Words of pairs alone are read and moved."""
        near = broadcast_if_small(pairs)
        side = lambda end, name: texts.select("id", F.col("words").alias(name)).join(near, F.col("id") == F.col(end)).drop("id")
        compared = side("a", "left").join(side("b", "right"), ["a", "b"]).select("a", "b", "left", "right")
        return stored(compared.mapInPandas(verify, "a long, b long"), "links")

    links = verified(stored(bounded(pairs, texts, similarity), "near"))
    roots = components(links)
    side = lambda end: roots.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
    others = meets.select(F.col("low").alias("a"), F.col("id").alias("b")).distinct().join(side("a"), "a", "left").join(side("b"), "b", "left")
    others = others.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b").join(pairs, ["a", "b"], "left_anti")
    others = stored(others, "pairs")
    second = verified(stored(bounded(others, texts, similarity), "near"))
    roots = merged(roots, second)
    links = links.unionByName(second)
    left = candidates_left(met.where("n > 2").select("id", "key"), roots, texts, similarity)
    left, take = stored(left.join(pairs.unionByName(others), ["a", "b"], "left_anti"), "left"), FIRST
    discard(met, pairs, others)
    while True:
        named = left.join(side("a"), "a", "left").join(side("b"), "b", "left")
        named = named.select("a", "b", F.coalesce("a_root", "a").alias("a_root"), F.coalesce("b_root", "b").alias("b_root")).where("a_root <> b_root")
        groups = named.select("a", "b", F.least("a_root", "b_root").alias("low"), F.greatest("a_root", "b_root").alias("high"))
        ranked = stored(groups.withColumn("rank", F.row_number().over(Window.partitionBy("low", "high").orderBy("a", "b"))), "ranked")
        if not ranked.limit(1).count():
            break
        discard(left)
        more = verified(ranked.where(F.col("rank") <= take).select("a", "b"))
        links, roots = links.unionByName(more), merged(roots, more)
        left, take = ranked.where(F.col("rank") > take).select("a", "b"), take * MORE
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    linked = roots.join(degree, "id").withColumnRenamed("id", "same")
    rooted = made.select("_key", "doc_id", "same").join(linked, "same", "left")
    rooted = stored(rooted.select("_key", "doc_id", F.coalesce("root", "same").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "classes")
    discard(made, texts)
    heads = rooted.groupBy("root").agg(F.min("_key").alias("class_key"))
    return rooted.join(heads, "root").select("_key", "doc_id", "class_key", "n_links")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest (id, hash) key; all columns stay."""
    found = near_duplicates(docs, doc_id, text, **options)
    kept = found.where(F.col("_key") == F.col("class_key")).select(F.col("_key").alias("key")).distinct()
    # Columns travel in a struct, so that no name of theirs can clash. Repeated rows share a
    # key and lie in one partition after the join.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.to_json(row_key(doc_id, text)).alias("key"))
    return rows.join(kept, "key").dropDuplicates(["key"]).select("row.*")


def op2_order_minhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    ids = found.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows"))
    return found.join(ids, "class_key").select("doc_id", "class_id", "class_rows", "n_links")
