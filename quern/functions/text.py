"""Words, lines and n-grams of texts, and Bloom filters, as columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that parts words.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text in order, A-Z in lower case; null gives an empty array."""
    trimmed = F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def window_hashes(words: Column, n: int) -> Column:
    """One 64-bit hash for each run of n words: each word is hashed once, and a run's hash is that of its words' hashes."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
    some = F.element_at(F.transform(F.array(hashed), runs), 1)
    return F.when(F.size(words) >= n, some).otherwise(F.array().cast("array<bigint>"))


#: Bits of a Bloom filter for each key, its probes, and the most bits that it has (1 MB); beyond them more false keys pass, and no true one is lost.
BITS_PER_KEY, PROBES, MOST_BITS = 16, 5, 1 << 23


def _spots(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in range(PROBES)]


class Bloom:
    """A Bloom filter over a column of keys.

    It is a partial aggregation: each task ORs its keys' bits into words of 64, and words merge by OR after the shuffle, in any order. What reaches the driver is the filter, of at most
    MOST_BITS bits however many keys there are. ``may_hold`` is an expression over a constant, so it runs within the scan's stage.
    """

    def __init__(self, keys: DataFrame, key: str):
        n = keys.count()
        self.bits = min(MOST_BITS, 1 << max(6, (BITS_PER_KEY * max(1, n) - 1).bit_length()))
        spots = keys.select(F.explode(F.array(*_spots(F.col(key), self.bits))).alias("spot"))
        bit = F.expr("shiftleft(1L, CAST(spot & 63 AS INT))")
        made = spots.groupBy(F.expr("shiftright(spot, 6)").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
        words = [0] * (self.bits // 64)
        for r in made:
            words[r.word] = r.bits
        self.words = words

    def may_hold(self, key: Column) -> Column:
        """False for keys that surely aren't there."""
        table = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")  # folded into a constant when the query is planned
        shifted = lambda s: F.call_function("shiftright", F.get(table, F.call_function("shiftright", s, F.lit(6)).cast("int")), (s.bitwiseAND(F.lit(63))).cast("int"))
        held = [shifted(s).bitwiseAND(F.lit(1)) == 1 for s in _spots(key, self.bits)]
        out = held[0]
        for x in held[1:]:
            out = out & x
        return out
