"""Language identification: n-grams against plain Python, the trainer against its optimum, and accuracy on held-out documents."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import language_id
from quern.llm.language_id import BUCKETS, COST, Model, Sample, families, grams, identify, machine, profiles
from quern.sources.tables import load

from .conftest import documents, edge_rows
from .test_kernels import lowered


def plain_grams(text: str) -> Counter:
    raw = re.sub(rb"[^a-z\x80-\xff]", b" ", lowered(text).encode())
    inner = re.sub(rb" +", b" ", b" " + raw)[1:]  # after the blank before the row, blanks in front vanish
    line = b" " + inner + b" "
    found = Counter()
    for n in (1, 2, 3, 4):
        found.update(line[i : i + n] for i in range(len(line) - n + 1))
    del found[b" "]
    if blanks := inner.count(b" "):
        found[b" "] = blanks
    return found


@pytest.mark.parametrize("texts", [["Ab, cd", "", "é", "x  y!"], ["", ""], ["a"], [" a b ", "zz top zz"]])
def test_grams_equal_plain_ones(texts):
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    row, _ = grams(np.frombuffer(b"".join(raw), np.uint8), at)
    want = [plain_grams(t) for t in texts]
    got = np.bincount(row, minlength=len(texts)).tolist()
    assert [g for g, t in zip(got, texts) if t] == [sum(w.values()) for w, t in zip(want, texts) if t]
    x = profiles(np.frombuffer(b"".join(raw), np.uint8), at)
    alone = np.concatenate([profiles(np.frombuffer(r, np.uint8), np.array([0, len(r)])) for r in raw])
    assert np.allclose(x, alone)  # no row sees its neighbours
    assert all(math.isclose(float(v @ v), 1, rel_tol=1e-5) for v, t in zip(x, texts) if t)


def toy(seed: int, n: int = 120) -> Sample:
    r = np.random.default_rng(seed)
    rows, lang = [], r.integers(0, 2, n)
    for y in lang:
        index = np.sort(r.choice(40, 12, replace=False)) + 20 * int(y)
        value = r.random(12)
        rows.append((index, value / np.linalg.norm(value)))
    return Sample(rows, lang, np.zeros(n, bool))


def test_the_machine_nears_its_optimum(monkeypatch):
    """The primal objective comes within a hundredth of the least one that a long run finds."""
    sample = toy(1)
    y = np.where(sample.lang == 1, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * COST

    def objective():
        w, b = machine(sample, np.arange(len(y)), y)
        return (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - y * language_id.margins(sample, np.arange(len(y)), w, b))).sum()

    monkeypatch.setattr(language_id, "PASSES", 200)
    near = objective()
    monkeypatch.setattr(language_id, "PASSES", 3000)
    assert near <= 1.01 * objective()


def test_families_join_the_closest():
    base = np.eye(6)[:, :6]
    means = np.stack([base[0] + 0.9 * base[1], base[1] + 0.9 * base[0], base[2] + 0.8 * base[3], base[3] + 0.8 * base[2]])
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    assert families(means) == [[0, 1], [2, 3]]
    assert families(means[:1]) == [[0]] and families(means[:2]) == [[0], [1]]


def test_held_out_accuracy(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = identify(docs).collect()
    apart = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    right = sum(truth[r.doc_id] == r.lang_pred for r in apart)
    assert len(got) == len(truth) and right >= 0.99 * len(apart), (right, len(apart))


def test_edge_rows(spark, edge, no_documents):
    got = identify(edge).collect()
    assert len(got) == len(edge_rows())
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id is not None}
    assert by_id[3] == by_id[4] == by_id[5] == by_id[12] == ("und", 0.0)
    assert by_id[0] == by_id[1]
    assert identify(no_documents).collect() == []
    one = identify(documents(spark, [(1, "ein Wort", "de", None), (4, "noch eins", "de", None), (2, "12 € …", "de", "x"), (3, "anders", None, None)])).collect()
    assert {r.doc_id: r.lang_pred for r in one} == {1: "de", 4: "de", 2: "und", 3: "de"}
    assert {r.lang_pred for r in identify(documents(spark, [(1, "ein Wort", None, None)])).collect()} == {"und"}
