"""Operator 10: benchmark decontamination by CGK embeddings and bit-sampling LSH, with exact edit verification.

Texts and benchmark items are sequences of lower-cased words (runs of letters and digits). A document is contaminated by an
item if some stretch of it is within MOST_EDITS of the item's words, counted as word insertions, deletions and
substitutions. Windows of item size start at every word: item lengths are rounded down to a ladder of sizes, and an item
is known by its first and its last window of that size, one of over MOST_WINDOW words by windows side by side. An edit breaks at most two pairs of neighbouring words, so a window
can only qualify if enough of its pairs occur in items of its size at all, which a running count tells; the
others go no further.

The CGK embedding walks through a window: at step j it emits the current word and moves on if a random bit of (j, word) says so. Two
walks over sequences at edit distance d meet again soon after each edit, so the embeddings' Hamming distance is of
the order of d squared at most, whatever the window's length. Each of REPEATS walks is hashed at SAMPLED random
steps; windows that meet an item in any repeat are candidates, and each is verified by the exact edit distance.

Items of fewer than LEAST_ITEM words are found exactly: word for word by the hash of the whole item, and, where their length allows one
edit, by their first and last pair of words, one of which an edit leaves as it is; the words beside the pair are then compared with the item's.
Characters of scripts written without blanks count as words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import PUNCTUATED, hashed_words, mix, steps, stored, text_column

MOST_EDITS = 0.2
REPEATS, SAMPLED = 48, 4
STRETCH = 2
LEAST_ITEM = 8
#: Longer items are known by equal windows of at most this size side by side, one of which has no more than its share of the edits.
MOST_WINDOW = 48
#: Items and bytes of text in one broadcast index of about 15 bytes for each of the text (REPEATS * 24 for each window). A larger
#: benchmark is searched in blocks; an item longer than that is a block of its own.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 4 << 20
_PAD = np.uint64(0)
_WINDOWS_AT_ONCE = 1 << 12


def ladder(n: int) -> int:
    """The largest window size that is at most n: 8, 10, 12, 15, ... each a quarter above the last."""
    size = LEAST_ITEM
    while size * 5 // 4 <= n:
        size = size * 5 // 4
    return size


def windows_of(n: int) -> tuple[int, list[int]]:
    """Size and starts of the windows that an item of n words is known by; those of a long item do not overlap."""
    parts = -(-n // MOST_WINDOW)
    size = ladder(n // parts)
    return size, sorted({k * (n - size) // max(parts - 1, 1) for k in range(max(parts, 2))})


def edits_allowed(n: int) -> int:
    return int(MOST_EDITS * n + 1e-9)


@cache
def _walks(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of each step and repeat, and which repeats sample each step."""
    rng = np.random.default_rng(size)
    sampled = np.zeros((STRETCH * size, REPEATS), bool)
    for r in range(REPEATS):
        sampled[rng.choice(STRETCH * size, SAMPLED, replace=False), r] = True
    return rng.integers(1, 1 << 63, (STRETCH * size, REPEATS, 1), dtype=np.uint64) | np.uint64(1), sampled


def embed(windows: np.ndarray) -> np.ndarray:
    """[repeat, row]: hash of the sampled steps of each CGK walk over each row of windows (word hashes, padded)."""
    n, size = windows.shape
    seeds, sampled = _walks(size)
    flat = np.concatenate([windows, np.full((n, 1), _PAD)], 1).ravel()
    at = np.tile(np.arange(n) * (size + 1), (REPEATS, 1))
    end = at[:1] + size
    out = np.repeat((np.arange(REPEATS, dtype=np.uint64) + np.uint64(size * 1000))[:, None], n, 1)
    with np.errstate(over="ignore"):
        for seed, taken in zip(seeds, sampled, strict=True):
            word = flat[at]
            if taken.any():
                out[taken] = mix(out[taken] * np.uint64(0x9E3779B97F4A7C15) + word[taken])
            # Words are hashes already, so one multiplication by an odd seed gives a fair top bit.
            at += ((word * seed) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, end, out=at)
    return out


@dataclass
class Index:
    """What a block of the benchmark is searched with; its size is bounded by BLOCK_ITEMS and BLOCK_BYTES."""

    ids: list[int]
    items: list[np.ndarray]
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(repr=False)  # by number of words: sorted hashes of whole items, and the items
    edges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(repr=False)  # by number of words: sorted hashes of first and last pairs, the items, and whether the pair is the last
    vocabulary: np.ndarray  # hashes of pairs of neighbouring words
    member: np.ndarray  # of each pair in the vocabulary and each window size: whether an item of that size has the pair
    sizes: list[int]
    keys: np.ndarray
    owner: np.ndarray
    shift: np.ndarray


def pairs(word: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of neighbouring words."""
    with np.errstate(over="ignore"):
        return mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])


def sequences(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    out = np.full(max(len(word) - n + 1, 0), n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(out)])
    return out


def words_of(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return hashed_words(raw, np.array([0, len(raw)]), blanks=PUNCTUATED, unspaced=True)[3]


def build_index(ids: list[int], texts: list[str | None]) -> Index:
    """Items without a word are left out."""
    items = [words_of(x) for x in texts]
    kept, items = [i for i, x in zip(ids, items, strict=True) if len(x)], [x for x in items if len(x)]
    long, short = [], {}
    for k, words in enumerate(items):
        (long if len(words) >= LEAST_ITEM else short.setdefault(len(words), [])).append(k)
    for n, own in short.items():
        value = np.concatenate([sequences(items[k], n) for k in own])
        order = np.argsort(value, kind="stable")
        short[n] = value[order], np.array(own)[order]
    edges = {}
    for n, (_, own) in short.items():
        if edits_allowed(n):
            pair = np.stack([pairs(items[k])[[0, -1]] for k in own]).T.ravel()
            order = np.argsort(pair, kind="stable")
            edges[n] = pair[order], np.tile(own, 2)[order], np.repeat([False, True], len(own))[order]
    known: dict[int, list[tuple[int, int]]] = {}
    for k in long:
        size, starts = windows_of(len(items[k]))
        known.setdefault(size, []).extend((k, at) for at in starts)
    keys, owner, shift = [np.zeros(0, np.uint64)], [], []
    for size, places in known.items():
        for a in range(0, len(places), _WINDOWS_AT_ONCE):
            some = places[a : a + _WINDOWS_AT_ONCE]
            keys.append(embed(np.stack([items[k][at : at + size] for k, at in some])).T.ravel())
            owner += [k for k, _ in some]
            shift += [at for _, at in some]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    pick = lambda x: np.repeat(np.array(x, np.int64), REPEATS)[order]
    sizes = sorted({windows_of(len(items[k]))[0] for k in long})
    vocabulary = np.unique(np.concatenate([pairs(items[k]) for k in long])) if long else np.zeros(0, np.uint64)
    member = np.zeros((len(vocabulary), len(sizes)), bool)
    for k in long:
        member[np.searchsorted(vocabulary, pairs(items[k])), sizes.index(windows_of(len(items[k]))[0])] = True
    return Index(kept, items, short, edges, vocabulary, member, sizes, every[order], pick(owner), pick(shift))


def infix_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, first, end): the stretch of text with the least word edit distance to item; the shortest of the earliest ending."""

    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        along = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else along.copy()
        for i, w in enumerate(a, 1):
            new = row + 1
            np.minimum(new[1:], row[:-1] + (b != w), out=new[1:])
            new[0] = i
            row = np.minimum.accumulate(new - along) + along
        return row

    row = last_row(item, text, True)
    end = int(np.argmin(row))
    back = last_row(item[::-1], text[:end][::-1], False)
    return int(row[end]), end - int(np.argmin(back)), end


def _candidates(index: Index, word: np.ndarray, ends: np.ndarray, known: np.ndarray, place: np.ndarray) -> set[tuple[int, int, int]]:
    """(end of the row, position where the item would begin, item) of the windows that meet an item. ends: end of each word's row; known: positions of the benchmark's pairs, place: theirs in the vocabulary."""
    found: set[tuple[int, int, int]] = set()
    here = np.arange(len(word))
    for column, size in enumerate(index.sizes):
        hit = np.zeros(len(word), bool)
        hit[known] = index.member[place, column]
        running = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        slack = edits_allowed(size * 5 // 4 + 1)
        last = np.minimum(here + size, ends) - 1  # the last pair begins a word earlier
        starts = np.flatnonzero(running[last] - running[:-1] >= size - 1 - 2 * slack)
        for a in range(0, len(starts), _WINDOWS_AT_ONCE):
            p = starts[a : a + _WINDOWS_AT_ONCE]
            at = p[:, None] + np.arange(size)
            windows = np.where(at < ends[p][:, None], word[np.minimum(at, len(word) - 1)], _PAD)
            key = embed(windows)
            lo, hi = np.searchsorted(index.keys, key, "left"), np.searchsorted(index.keys, key, "right")
            for r, k in zip(*np.nonzero(hi > lo), strict=True):
                found.update((int(ends[p[k]]), int(p[k] - index.shift[x]), int(index.owner[x])) for x in range(lo[r, k], hi[r, k]))
    return found


def _met(pair: np.ndarray, inside: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs inside a row that are among known (sorted), and their first places there."""
    bits = np.zeros(1 << 20, bool)
    bits[known & np.uint64((1 << 20) - 1)] = True
    maybe = np.flatnonzero(bits[pair & np.uint64((1 << 20) - 1)] & inside)
    place = np.minimum(np.searchsorted(known, pair[maybe]), len(known) - 1)
    same = known[place] == pair[maybe]
    return maybe[same], place[same]


def _one_edit(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of each row: whether a stretch of text (a word longer than the item) that begins where the item does is within one edit of it."""

    def whole(same: np.ndarray) -> np.ndarray:
        """[row, i]: whether all of the first i are the same."""
        return np.logical_and.accumulate(np.concatenate([np.ones((len(same), 1), bool), same], 1), 1)

    n = item.shape[1]
    before = whole(item == text[:, :n])
    after = lambda same: whole(same[:, ::-1])[:, ::-1]
    changed = before[:, :n] & after(item == text[:, :n])[:, 1:]
    added = before & after(item == text[:, 1:])
    left_out = before[:, :n] & after(item[:, 1:] == text[:, : n - 1])
    return changed.any(1) | added.any(1) | left_out.any(1)


def _edited(index: Index, word: np.ndarray, pair: np.ndarray, inside: np.ndarray, bounds: np.ndarray, row: np.ndarray) -> set[tuple[int, int, int]]:
    """(row, position where the item would begin, item) of the short items that a row may hold with one edit: none is missed."""
    found: set[tuple[int, int, int]] = set()
    for n, (keys, own, last) in index.edges.items():
        items = np.stack([index.items[k] for k in own])
        at, low = _met(pair, inside, keys)
        count = np.searchsorted(keys, pair[at], "right") - low
        until = np.cumsum(count)
        for a in range(0, int(count.sum()), _WINDOWS_AT_ONCE):
            # The matches of a pair with each of the items that have it, numbered one after the other.
            number = np.arange(a, min(a + _WINDOWS_AT_ONCE, int(until[-1])))
            hit = np.searchsorted(until, number, "right")
            x = low[hit] + number - (until[hit] - count[hit])
            p, end = at[hit], last[x]
            along = np.arange(n + 1)
            # From a last pair both are read backwards.
            places = np.where(end[:, None], (p + 1)[:, None] - along, p[:, None] + along)
            valid = (places >= bounds[row[p]][:, None]) & (places < bounds[row[p] + 1][:, None])
            text = np.where(valid, word[np.clip(places, 0, len(word) - 1)], _PAD)
            ok = _one_edit(np.where(end[:, None], items[x, ::-1], items[x]), text)
            found.update(zip(row[p[ok]].tolist(), np.where(end, p + 2 - n, p)[ok].tolist(), own[x[ok]].tolist(), strict=True))
    return found


def search(index: Index, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item number, distance, first word, end word, words of the row) of the nearest stretch of each contaminated row and item."""
    _, _, row, word = hashed_words(data, at, blanks=PUNCTUATED, unspaced=True)
    if not len(word) or not index.items:
        return
    bounds = np.searchsorted(row, np.arange(len(at)))
    ends = bounds[1:][row]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    regions: dict[tuple[int, int], list[int]] = {}
    for n, (keys, own) in index.short.items():
        value = sequences(word, n)
        lo, hi = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
        for p in np.flatnonzero((hi > lo) & (np.arange(len(value)) + n <= ends[: len(value)])):
            for k in own[lo[p] : hi[p]]:
                r = int(row[p])
                best.setdefault((r, int(k)), (0, int(p - bounds[r]), int(p - bounds[r]) + n))
    pair, inside = pairs(word), row[1:] == row[:-1]
    if len(index.vocabulary):
        for row_end, p, k in _candidates(index, word, ends, *_met(pair, inside, index.vocabulary)):
            regions.setdefault((int(row[row_end - 1]), k), []).append(p)
    for r, p, k in _edited(index, word, pair, inside, bounds, row):
        regions.setdefault((r, k), []).append(p)
    for (r, k), places in regions.items():
        item = index.items[k]
        most = edits_allowed(len(item))
        reach = 2 * most + 2
        # Candidates whose stretches overlap are verified as one, so that none of them hides another.
        spans: list[list[int]] = []
        for p in sorted(places):
            low, high = max(int(bounds[r]), p - reach), min(int(bounds[r + 1]), p + len(item) + reach)
            if spans and low <= spans[-1][1]:
                spans[-1][1] = max(high, spans[-1][1])
            else:
                spans.append([low, high])
        for low, high in spans:
            distance, first, end = infix_distance(item, word[low:high])
            if distance <= most:
                now = (distance, low + first - int(bounds[r]), low + end - int(bounds[r]))
                best[r, k] = min(now, best.get((r, k), now))
    for (r, k), (distance, first, end) in best.items():
        yield r, k, distance, first, end, int(bounds[r + 1] - bounds[r])


COLUMNS = ("item_id", "item_words", "distance", "first_word", "end_word", "doc_words")


def _searched(index: Index, own: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, _, data, at in steps(batch.column("text")):
                out += [(i + r, index.ids[k], len(index.items[k]), *x) for r, k, *x in search(index, data, at)]
            rows, *rest = (list(x) for x in zip(*out, strict=True)) if out else [[]] * (1 + len(COLUMNS))
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in own]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x, pa.int64()) for x in rest]], [*own, *COLUMNS])

    return run


def _blocks(items: DataFrame) -> Iterator[list]:
    """All rows of items, in runs of at most BLOCK_ITEMS rows and BLOCK_BYTES of text (or one item)."""
    block, size = [], 0
    for r in items.toLocalIterator():
        n = len(r.text.encode())
        if block and (len(block) == BLOCK_ITEMS or size + n > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append(r)
        size += n
    yield block


def leaks(base: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of base but for text, and COLUMNS: one row for each row of base and item of the benchmark that its text holds."""
    items = benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), text_column(benchmark).alias("text")).filter("item_id is not null")
    own = [c for c in base.columns if c != "text"]
    kinds = dict(base.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in own] + [f"{c} bigint" for c in COLUMNS])
    done: list[DataFrame] = []
    now = None
    for block in _blocks(items):
        if now is not None:  # another block follows: only one index is held at a time
            done.append(stored(now, "leaks"))
        now = base.mapInArrow(_searched(build_index([r.item_id for r in block], [r.text for r in block]), own), schema)
    return reduce(DataFrame.union, [*done, now])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words, distance, first_word, end_word, doc_words: one row per document row and benchmark item that it holds.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Null or empty texts hold nothing; items without id or
    words are not searched; rows that repeat an item_id are items of their own. Repeated documents each give their rows. An empty
    benchmark gives no rows.
    """
    return leaks(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_column(docs).alias("text")), benchmark)
