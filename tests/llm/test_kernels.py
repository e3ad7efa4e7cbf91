"""The vectorised helpers against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import decontamination, near_dedup
from quern.llm.common import PUNCTUATED, hashed_words, steps

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.text(st.sampled_from("ab Z.,é\n\t\x0b\x1c 😀")), max_size=8)


def lowered(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@settings(deadline=None)
@given(texts)
def test_words_and_hashes(rows):
    for i, j, data, at in steps(pa.array(rows, pa.string()), 16):
        start, end, row, value = hashed_words(data, at)
        raw = data.tobytes()
        got = [(int(r), raw[s:e].decode()) for s, e, r in zip(start, end, row)]
        assert got == [(k, w) for k, t in enumerate(rows[i:j]) for w in WORD.findall(t)]
        by_hash = {}
        for (_, w), h in zip(got, value.tolist()):
            assert by_hash.setdefault(lowered(w), h) == h
        assert len(set(by_hash.values())) == len(by_hash)


def test_null_and_sliced_columns():
    column = pa.array(["x y", None, "", "z"]).slice(1)
    parts = list(steps(column))
    assert [hashed_words(d, a)[2].tolist() for _, _, d, a in parts] == [[2]]


def test_shingle_sets_and_sketch_estimate_similarity():
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    other = base[:350] + [f"v{x}" for x in range(50)]
    a, b = near_dedup.shingle_sets(pa.array([" ".join(base), " ".join(other)]))
    assert len(a) == 396
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    seen = (near_dedup.sketch(a) == near_dedup.sketch(b)).mean()
    assert abs(seen - true) < 0.15


def test_sketch_fills_every_coordinate_of_tiny_sets():
    for n in (1, 2, 3, 10):
        s = near_dedup.sketch(np.arange(1, n + 1, dtype=np.uint64))
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def edit_infix(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != t)))
        row = new
    return min(row)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=9), st.lists(st.integers(0, 4), max_size=14))
def test_infix_distance(item, text):
    got, first, end = decontamination.infix_distance(np.array(item, np.uint64), np.array(text, np.uint64))
    assert got == edit_infix(item, text)
    assert 0 <= first <= end <= len(text)


def test_cgk_recall_at_the_edit_limit():
    rng = np.random.default_rng(2)
    found = 0
    for k in range(60):
        item = [f"i{x}" for x in rng.integers(0, 10**6, 30)]
        index = decontamination.build_index([7], [" ".join(item)])
        words = list(item)
        for p in rng.choice(30, 4, replace=False):
            kind = rng.integers(3)
            words[p] = "" if kind == 0 else f"new{p}" if kind == 1 else f"{words[p]} more{p}"
        text = " ".join(["filler"] * int(rng.integers(0, 30)) + words + ["end"] * 20).encode()
        found += bool(list(decontamination.search(index, np.frombuffer(text, np.uint8), np.array([0, len(text)]))))
    assert found >= 54, found


def test_no_pair_of_words_spans_rows():
    index = decontamination.build_index([1], ["a b c d e f g h"])
    raw = b"x a b c d" + b"e f g h y"
    assert not list(decontamination.search(index, np.frombuffer(raw, np.uint8), np.array([0, 9, len(raw)])))


def test_punctuation_parts_words():
    raw = np.frombuffer("Ab,c d-e".encode(), np.uint8)
    assert len(hashed_words(raw, np.array([0, len(raw)]), blanks=PUNCTUATED)[0]) == 4


def thue_morse(n: int) -> tuple[str, str]:
    """Two words that share no place, which every polynomial hash modulo 2**64 confuses."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_structured_words_differ():
    a, b = thue_morse(2048)
    blocks = ["abcdefgh", "ijklmnop", "qrstuvwx"]
    texts = [a, b, "".join(blocks), "".join(blocks[::-1]), "a" * 7, "a" * 8, "a" * 9, "a" * 16, "a\0", "a"]
    raw = "\n".join(texts).encode()
    value = hashed_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[3]
    assert len(set(value.tolist())) == len(texts)
