"""Operator 13: an audit of how far the sources of a language diverge in their words.

Terms are runs of bytes that are ASCII letters or parts of other characters. A table of 256 entries maps the bytes of many texts
at once, laid end to end, to their lower case or to 0, and the changes between the two kinds are the boundaries. XXH64 puts equal slices next to
each other; each slice is then compared byte by byte with the first of its hash, and slices that only share a hash are told apart. What a
task has counted, per language, source and term, is summed by Spark before and after one shuffle.

The counts of a language are a sparse matrix of sources and terms, dealt by the hash of the term into blocks of about BLOCK entries. In a block
in CSR form, all sources are compared with one at a time: ``reduceat`` over the rows sums the divergence over the terms that a source has,
the terms that only the other one has follow from their distinct rates, and those that neither has are a number times one value, so the work is
that of the entries and not that of all terms. Blocks add up. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import drop_stored, steps, stored
from quern.sources.tables import small

#: Documents of its language that a term must be in.
LEAST_DOCUMENTS = 3
#: Ranks of part `term`.
TERMS = 200
#: A rate of 1.
SCALE = 1_000_000_000
#: Entries of the sparse matrix in a block, and pairs of sources that one block yields at a time.
BLOCK, PAIRS = 1 << 17, 1 << 20
#: Bytes of text that are tokenized at a time; a longer text is a step of its own.
STEP = 1 << 21

#: A term's byte in lower case, 0 for any other byte: [^\x00-\x40\x5B-\x60\x7B-\x7F].
_TERM = np.zeros(256, np.uint8)
_TERM[0x80:] = np.arange(0x80, 0x100)
_TERM[ord("a") : ord("z") + 1] = _TERM[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)

#: The primes of XXH64 (fixed values).
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the end."""
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each data[start:end]; the slices of one length go through its steps together."""
    size, eight = end - start, _eight(data)
    out = np.zeros(len(start), np.uint64)
    by_size = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[by_size])) + 1
    with np.errstate(over="ignore"):
        for who in np.split(by_size, cuts):
            if not len(who):
                continue
            n, at = int(size[who[0]]), start[who]
            if n >= 32:  # four lanes; few terms are as long
                raw = data.tobytes()
                out[who] = [xxhash.xxh64_intdigest(raw[a : a + n]) for a in at.tolist()]
                continue
            h, k = np.full(len(who), _P5 + np.uint64(n), np.uint64), 0
            for k in range(0, n - 7, 8):
                h = _turned(h ^ (_turned(eight[at + k] * _P2, 31) * _P1), 27) * _P1 + _P4
            k = n & ~7
            if n & 4:
                h = _turned(h ^ ((eight[at + k] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
                k += 4
            for j in range(k, n):
                h = _turned(h ^ (data[at + j].astype(np.uint64) * _P5), 11) * _P1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[who] = h ^ (h >> np.uint64(32))
    return out


def slices(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, first byte, end byte, row) of every term of the rows at[0]:at[1], at[1]:at[2]..."""
    low = _TERM[data]
    inside = low != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(first)
    return low, start, np.flatnonzero(last) + 1, np.searchsorted(at, start, "right") - 1


def _same(low: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether each slice equals, byte by byte, the other one."""
    eight, same = _eight(low), size == other_size
    live, at = np.flatnonzero(same), 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        mask = np.where(left == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1))
        differs = ((eight[start[live] + at] ^ eight[other[live] + at]) & mask) != 0
        same[live[differs]] = False
        at += 8
        live = live[~differs & (size[live] > at)]
    return same


def grouped(low: np.ndarray, start: np.ndarray, end: np.ndarray, hasher=xxh64) -> tuple[np.ndarray, np.ndarray]:
    """(order, id): the slices in an order in which equal ones follow each other, as they came, and in it the number of each one's term."""
    value = hasher(low, start, end)
    order = np.argsort(value, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = value[order[1:]] != value[order[:-1]]
    term, heads = np.cumsum(fresh) - 1, order[fresh]
    size = end - start
    same = _same(low, start[order], size[order], start[heads][term], size[heads][term])
    if not same.all():  # one hash, several terms: tell them apart by their bytes
        mixed = np.flatnonzero(np.isin(term, term[~same]))
        seen: dict[tuple[int, bytes], int] = {}
        more = [seen.setdefault((t, low[start[i] : end[i]].tobytes()), len(seen)) for t, i in zip(term[mixed].tolist(), order[mixed].tolist(), strict=True)]
        term[mixed] = len(heads) + np.array(more)
        again = np.argsort(term, kind="stable")
        order, term = order[again], term[again]
        term = np.cumsum(np.concatenate([[0], (term[1:] != term[:-1]).astype(np.int64)]))
    return order, term


def _strings(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The slices as a column of strings."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    raw = low[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())).cast(pa.string())


_CELL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, and in how many documents how often, of the rows (lang, source, text) of each step."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.column(k).dictionary_encode() for k in ("lang", "source")]
        lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in names)
        group = lang * len(names[1].dictionary) + source
        by_group = np.argsort(group, kind="stable")
        for i, _, data, at in steps(batch.column("text").take(pa.array(by_group)), STEP):
            low, start, end, row = slices(data, at)
            if not len(start):
                continue
            order, term = grouped(low, start, end)
            row = row[order] + i
            group_of = group[by_group][row]
            changes = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
            by_term = changes(term)
            cell = np.flatnonzero(by_term | changes(group_of))
            docs = np.add.reduceat((by_term | changes(row)).astype(np.int64), cell)
            heads = order[by_term]
            where = group_of[cell]
            of = [names[0].dictionary.take(pa.array(where // len(names[1].dictionary))), names[1].dictionary.take(pa.array(where % len(names[1].dictionary)))]
            columns = [x.cast(pa.string()) for x in (*of, _strings(low, start[heads], end[heads]).take(pa.array(term[cell])))]
            yield pa.record_batch([*columns, pa.array(np.diff(np.append(cell, len(order)))), pa.array(docs)], schema=_CELL)


def rate(n: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / whole) for n < whole, exact for wholes below 2 ** 53: three digits at a time."""
    left, out = np.asarray(n, np.int64) + 1, np.int64(0)
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return 1 + out


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


_OUT = pa.schema([("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("seen", pa.int64()), ("rest", pa.int64()), ("terms", pa.int64())])


def _diverged(cells: pa.Table, groups: pa.Table, share: int, shares: int) -> pa.Table:
    """What one block of a language gives: for each source and each other source of this share, the sum over the terms that either has, their number, and the
    value of a term that neither has; in the first share also the terms that stand out in a source, of equal value the first by name."""
    groups = groups.sort_by("source")
    names, total, kept, of_lang = groups["source"].to_pylist(), groups["total"].to_numpy(), int(groups["terms"][0].as_py()), int(groups["of_lang"][0].as_py())
    if not kept:
        pairs = [(a, "pair", b, 0, 0, 0, 0) for k, b in enumerate(names) if k % shares == share for a in names if a != b]
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*pairs) if pairs else [[]] * 7, _OUT, strict=True)], schema=_OUT)
    lists = cells["cells"].combine_chunks() if cells.num_rows else pa.array([], pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))
    flat = lists.flatten()
    place = {x: k for k, x in enumerate(names)}
    row = np.array([place[x] for x in flat.field("source").to_pylist()], np.int64)
    col = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)) if len(lists) else np.zeros(0, np.int64)
    by_row = np.argsort(row, kind="stable")  # CSR: the entries of one source follow each other
    row, col, n = row[by_row], col[by_row], flat.field("n").to_numpy(zero_copy_only=False)[by_row]
    bounds = np.searchsorted(row, np.arange(len(names) + 1))
    there = np.flatnonzero(np.diff(bounds))

    def by_source(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), np.int64)
        if len(there):
            out[there] = np.add.reduceat(values, bounds[there])
        return out

    whole = total + kept
    p, none = rate(n, whole[row]), rate(np.zeros(len(names), np.int64), whole)
    source, item, value, seen, rest = [], [], [], [], []
    for b in range(share, len(names), shares):
        mine = slice(bounds[b], bounds[b + 1])
        q, in_b = np.full(len(lists), none[b]), np.zeros(len(lists), bool)
        q[col[mine]], in_b[col[mine]] = p[mine], True
        other, both = q[col], in_b[col]
        levels, times = np.unique(p[mine], return_counts=True)
        only_b = (_f(none[:, None], levels[None, :]) * times).sum(1) - by_source(np.where(both, _f(none[row], other), 0))
        keep = np.arange(len(names)) != b
        source.append(np.flatnonzero(keep))
        item.append(np.full(len(names) - 1, b))
        value.append((by_source(_f(p, other)) + only_b)[keep])
        seen.append((np.diff(bounds) + len(p[mine]) - by_source(both.astype(np.int64)))[keep])
        rest.append(_f(none, none[b])[keep])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    named = pa.array(names, pa.string())
    source = join(source)
    out = [pa.table([named.take(pa.array(source)), pa.array(["pair"] * len(source), pa.string()), named.take(pa.array(join(item))), *(pa.array(join(x)) for x in (value, seen, rest)), pa.array(np.full(len(source), kept))], schema=_OUT)]
    if share == 0 and len(lists):
        terms, q = cells["term"].combine_chunks(), rate(cells["n"].to_numpy(), of_lang + kept)
        best = []
        for a in there.tolist():
            who = np.arange(bounds[a], bounds[a + 1])
            who = who[p[who] > q[col[who]]]
            f = _f(p[who], q[col[who]])
            if len(who) > TERMS:
                least = np.partition(f, -TERMS)[-TERMS]
                ties = who[f == least]
                ties = ties[np.argsort(np.array([x.encode() for x in terms.take(pa.array(col[ties])).to_pylist()], object), kind="stable")]
                who = np.concatenate([who[f > least], ties[: TERMS - int((f > least).sum())]])
            best.append(who)
        who = join(best)
        zero = pa.array(np.zeros(len(who), np.int64))
        out.append(pa.table([named.take(pa.array(row[who])), pa.array(["term"] * len(who), pa.string()), terms.take(pa.array(col[who])).cast(pa.string()), pa.array(_f(p[who], q[col[who]])), zero, zero, zero], schema=_OUT))
    return pa.concat_tables(out)


def divergence(docs: DataFrame, block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """lang, source, part, item, value and rank, of docs (text, lang, source; others ignored).

    Null text, lang and source count as empty. Part `pair` has, for every source of a language, each other source of it; `term` has its TERMS
    most divergent terms. Every row of docs is a document, repeated ones too. A language in which no term is kept has pairs of value 0, a language of
    one source has none; of no rows there is nothing. A text of any length is tokenized whole. block, pairs: bounds of what a task holds, without effect on the result.
    """
    text = {k: F.coalesce(docs[k].cast("string"), F.lit("")).alias(k) for k in ("lang", "source", "text")}
    counted = docs.select(*text.values()).mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    cells = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))
    kept = stored(whole.filter(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"), "terms")  # a row a term: at most one cell a source
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("of_lang"), F.sum(F.size("cells")).alias("entries"))
    totals = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    groups = docs.select(text["lang"], text["source"]).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "of_lang", "entries"])
    sources = F.count("*").over(Window.partitionBy("lang"))
    groups = groups.withColumns({"blocks": F.greatest(F.lit(1), F.ceil(F.col("entries") / block)), "shares": F.ceil(sources * sources / pairs)})
    groups = stored(groups.drop("entries"), "groups")
    shape = groups.select("lang", "blocks", "shares").distinct()  # a row a language
    dealt = kept.join(small(shape), "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"), "term", "n", "cells")
    places = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)))

    def apply(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
        out = _diverged(cells, groups, key[2].as_py(), int(groups["shares"][0].as_py()))
        return out.add_column(0, "lang", pa.array([key[0].as_py()] * out.num_rows, pa.string()))

    key = ("lang", "block", "share")
    both = dealt.groupBy(*key).cogroup(places.groupBy(*key))
    found = stored(both.applyInArrow(apply, "lang string, source string, part string, item string, value bigint, seen bigint, rest bigint, terms bigint"), "divergences")
    drop_stored(kept, groups)
    summed = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg((F.sum("value") + (F.max("terms") - F.sum("seen")) * F.max("rest")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = found.filter("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", rank).filter(F.col("rank") <= TERMS)
    return summed.withColumn("rank", rank).unionByName(terms)
