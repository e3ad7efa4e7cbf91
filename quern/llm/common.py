"""What the operators share: words as the contracts define them, and vectorised hashing of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.storage import drop_stored, stored

__all__ = ["BLANKS", "PUNCTUATED", "STEP_BYTES", "drop_stored", "hashed_slices", "hashed_words", "let", "mix", "steps", "stored", "string_buffers", "text_column", "words"]

#: The white space of the word definition, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of text that one vectorised step takes at a time (a longer document is a step of its own).
STEP_BYTES = 1 << 17


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: str | Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order; null gives an empty array."""
    trimmed = F.btrim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The text column as a string; null is empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


# --- vectorised words -------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Blanks and ASCII punctuation: words then are runs of letters and digits.
PUNCTUATED = _SPACE.copy()
PUNCTUATED[[i for i in range(0x21, 0x7F) if not chr(i).isalnum()]] = True
_ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64 bits (the one of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty data[start:end]. Eight bytes at a time are mixed with their place, so slices that are
    made of the same parts in another order, or that only a structure such as a polynomial would confuse, differ."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    blocks = (size + 7) >> 3
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))  # the eight bytes from each place on
    with np.errstate(over="ignore"):
        if int(blocks.max()) == 1:
            total = mix(eight[start] & _FIRST_BYTES[size])
        else:
            first = np.cumsum(blocks) - blocks
            place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
            left = np.repeat(size, blocks) - 8 * place
            part = mix(eight[np.repeat(start, blocks) + 8 * place] & _FIRST_BYTES[np.minimum(left, 8)])
            later = np.flatnonzero(place)
            part[later] = mix(part[later] ^ place[later].astype(np.uint64) * _ODD)
            total = np.add.reduceat(part, first)
        return mix(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes: (first row, end row, bytes, offsets from 0). No row is cut."""
    data, at = string_buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def hashed_words(data: np.ndarray, at: np.ndarray, lower: bool = True, blanks: np.ndarray = _SPACE, tail: np.ndarray | None = None, unspaced: bool = False) -> tuple[np.ndarray, ...]:
    """(first byte, end byte, row, 64-bit hash, whether cut) of each word of the rows at[0]:at[1], at[1]:at[2]...; A-Z count as a-z if lower. blanks: which bytes part words.

    tail: one such byte after an ASCII letter or digit is cut off a word's end, and a fifth array says where that was done.
    Without tail, there are four arrays. unspaced: characters of the scripts written without blanks (UTF-8 from U+3000 to U+D7FF) are words
    of their own.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return (none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool))[: 4 if tail is None else 5]
    blank = blanks[data]
    first = ~blank
    first[1:] &= blank[:-1]
    cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    first[cuts] = ~blank[cuts]
    last = ~blank
    last[:-1] &= blank[1:]
    last[cuts - 1] = ~blank[cuts - 1]
    if unspaced and len(lead := np.flatnonzero((data >= 0xE3) & (data <= 0xED))):
        first[lead] = last[np.minimum(lead + 2, n - 1)] = True
        after, before = lead[lead + 3 < n] + 3, lead[lead > 0] - 1
        first[after], last[before] = ~blank[after], ~blank[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    cut = np.zeros(len(start), bool)
    if tail is not None:
        cut = (end - start > 1) & tail[data[end - 1]] & _ALNUM[data[end - 2]]
        end = end - cut
    value = hashed_slices(_LOWER[data] if lower else data, start, end)
    row = np.searchsorted(at, start, "right") - 1
    return (start, end, row, value) if tail is None else (start, end, row, value, cut)
