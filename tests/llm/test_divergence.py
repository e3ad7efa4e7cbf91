"""The source divergence audit against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.common import string_buffers
from quern.llm.divergence import divergence, grouped, rate, slices, xxh64

from .conftest import documents, edge_rows, prose
from .test_kernels import lowered

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows) -> list[tuple]:
    docs = [[x or "" for x in r[1:4]] for r in rows]  # text, lang, source
    tokens = [TERM.findall(lowered(t)) for t, _, _ in docs]
    seen, cells, of_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), words in zip(docs, tokens, strict=True):
        seen[lang].update(set(words))
        cells[lang, source].update(words)
        of_lang[lang].update(words)
    out = []
    for (lang, source), own in cells.items():
        kept = [t for t, n in seen[lang].items() if n >= 3]
        p = lambda n, total: 1 + 10**9 * (n + 1) // (total + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        size = lambda c: sum(c[t] for t in kept)
        mine = {t: p(own[t], size(own)) for t in kept}
        pairs = []
        for (other_lang, other), counts in cells.items():
            if other_lang == lang and other != source:
                n = size(counts)
                pairs.append((-sum(f(mine[t], p(counts[t], n)) for t in kept), other.encode(), other))
        out += [(lang, source, "pair", x, -v, k + 1) for k, (v, _, x) in enumerate(sorted(pairs))]
        n = size(of_lang[lang])
        tops = [(-f(mine[t], q), t.encode(), t) for t in kept if own[t] and mine[t] > (q := p(of_lang[lang][t], n))]
        out += [(lang, source, "term", x, -v, k + 1) for k, (v, _, x) in enumerate(sorted(tops)[:200])]
    return sorted(out)


def test_divergence_on_edge_rows(edge, no_documents):
    got = sorted(tuple(r) for r in divergence(edge).collect())
    assert got == plain(edge_rows())
    assert divergence(no_documents).collect() == []


def test_divergence_in_small_blocks(spark):
    """Many blocks and shares; a source without terms, a language without kept terms, one with a single source, more than 200 terms."""
    rows = [(i, prose(i % 7, 60) + " " + " ".join(f"w{chr(97 + (i * j) % 26)}{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}" for j in range(500)) * (i % 3), "en", f"s{i % 5}") for i in range(40)]
    rows += [(100, "12 34", "en", "none"), (101, "eins zwei", "de", "a"), (102, "drei", "de", "b"), (103, "un deux", "fr", "a"), (104, "É é É", "xx", "ö"), (105, "É", "xx", "o"), (106, "É-É", "xx", "ö")]
    want = plain(rows)
    assert sum(x[2] == "term" and x[5] == 200 for x in want) > 0
    assert sorted(tuple(r) for r in divergence(documents(spark, rows).repartition(3), block=100, pairs=7).collect()) == want


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ{É@é0 -[`😀z")), max_size=6))
def test_terms(rows):
    data, at = string_buffers(pa.array(rows, pa.string()))
    low, start, end, row = slices(data, at)
    got = [(int(r), low[s:e].tobytes().decode()) for s, e, r in zip(start, end, row)]
    assert got == [(k, t) for k, text in enumerate(rows) for t in TERM.findall(lowered(text))]


def test_hashes_are_xxh64():
    raw = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    start = np.arange(0, 4000, 40)
    end = start + np.arange(len(start)) % 71
    assert xxh64(raw, start, end).tolist() == [xxhash.xxh64_intdigest(raw[a:b].tobytes()) for a, b in zip(start, end)]


@pytest.mark.parametrize("hasher", [xxh64, lambda low, start, end: (end - start).astype(np.uint64) % np.uint64(3), lambda low, start, end: np.zeros(len(start), np.uint64)])
def test_slices_that_share_a_hash_are_told_apart(hasher):
    text = "ab abc ab abcdefgh abcdefgi abcdefgh abcdefghi b abcdefghi abcdefghj b"
    low, start, end, _ = slices(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    order, term = grouped(low, start, end, hasher)
    words = [text.split()[i] for i in order]
    assert [len(set(words[k] for k in np.flatnonzero(term == t))) for t in np.unique(term)] == [1] * len(set(words))
    assert all(np.diff(order[term == t]).min(initial=1) > 0 for t in np.unique(term))


def test_rates_are_exact():
    for n, whole in ((0, 1), (0, 3), (2, 3), (10**12, 10**13 + 7), (2**52, 2**53 - 111)):
        assert int(rate(np.array([n]), whole)[0]) == 1 + 10**9 * (n + 1) // whole
