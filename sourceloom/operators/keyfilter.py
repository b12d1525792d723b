"""A Bloom filter of bounded size, as a table that is joined in the scan.

Rows whose key cannot be among some keys are dropped where they are read, so that they do
not take part in a shuffle. What the filter lets through besides is dropped by the join that
follows; the result does not depend on the filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 20  # 64-bit words, at most
_SHIFTS = (0, 6, 12, 18)


def _place(columns: Sequence[str], slots: int) -> tuple[Column, Column]:
    """The word of a key, and the bits that the key sets in it."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(slots))
    bits, pattern = F.xxhash64(F.lit(1), *columns), None
    for shift in _SHIFTS:
        at = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at)
        pattern = bit if pattern is None else pattern.bitwiseOR(bit)
    return slot, pattern


def key_filter(keys: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """(_slot, _bits) for about ``n`` keys: four to a word, as long as there are words."""
    slot, pattern = _place(columns, slots_for(n))
    return keys.select(slot.alias("_slot"), pattern.alias("_pattern")).groupBy("_slot").agg(F.bit_or("_pattern").alias("_bits"))


def slots_for(n: int) -> int:
    return max(1024, min(SLOTS, n // 4))


def might_match(rows: DataFrame, keys: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """Rows that the filter of the keys lets through; at most ``SLOTS`` words are broadcast."""
    words = key_filter(keys, columns, n)
    slot, pattern = _place(columns, slots_for(n))
    hit = (slot == words["_slot"]) & (words["_bits"].bitwiseAND(pattern) == pattern)
    return rows.join(F.broadcast(words), hit, "left_semi")
