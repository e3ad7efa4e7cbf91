"""Corpus operators against plain Python: nulls, empty texts, repeated rows, hot lines, and false positives of the filter."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quern.functions.text import Bloom, window_hashes, words
from quern.operators import corpus
from quern.operators.corpus import license_lines, line_dedup, masked, overlaps

from .test_plans import plan

DOCS = "doc_id bigint, text string"


def test_line_dedup(spark):
    rows = [(3, "a\nb\na\n\nc"), (1, "hot\nx"), (2, "hot\n y\nhot"), (None, "b\nnull id"), (4, None), (5, ""), (6, "\n"), (7, "hot\nx"), (9, "z"), (9, "z"), (9, "w\nz")]
    rows += [(100 + i, f"hot\nline {i}\nhot") for i in range(50)]
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()))
    seen, want = set(), {}
    for r in order:
        lines = r[1].split("\n") if r[1] else []
        kept = [x for x in lines if not x.strip() or not (x in seen or seen.add(x))]
        want[r] = (len(lines), len(kept), "\n".join(kept))
    got = sorted((r.doc_id, r.n_lines, r.n_kept, r.text) for r in line_dedup(spark.createDataFrame(rows, DOCS).repartition(6)).collect() if r.doc_id is not None)
    assert got == sorted((r[0], *want[r]) for r in rows if r[0] is not None)
    assert line_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_overlaps_remove_false_positives(spark, monkeypatch):
    """With a filter of few bits nearly every window passes, and the result stays."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, None), (3, "w0 w1"), (4, "W3 w4\tw5 w6 w7 w8 w9 w10 " * 3), (5, "clean " * 30)]
    items = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(3, 13))), (8, "w5 w6 w7 w8 w9 w10 w11 w12"), (9, "short item"), (10, None)], "item_id bigint, text string")
    want = sorted([(1, 33, 3, 7), (1, 33, 3, 7), (2, 0, 0, None), (3, 0, 0, None), (4, 17, 3, 7), (5, 23, 0, None)], key=repr)
    for bits in (1 << 23, 64):
        monkeypatch.setattr("quern.functions.text.MOST_BITS", bits)
        assert sorted((tuple(r) for r in overlaps(spark.createDataFrame(rows, DOCS), items).collect()), key=repr) == want
    assert overlaps(spark.createDataFrame([], DOCS), items).collect() == []
    assert {r.n_hits for r in overlaps(spark.createDataFrame(rows, DOCS), items.limit(0)).collect()} == {0}


def test_the_filter_holds_its_keys_and_few_others(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    bloom = Bloom(keys, "k")
    assert keys.filter(~bloom.may_hold(F.col("k"))).isEmpty()
    others = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("k"))
    assert others.filter(bloom.may_hold(F.col("k"))).count() < 200
    assert "Python" not in plan(others.filter(bloom.may_hold(F.col("k"))))


def test_window_hashes(spark):
    df = spark.createDataFrame([("A b c a B c",), ("a b",), (None,)], "t string").select(words(F.col("t")).alias("w"))
    got = [r.h for r in df.select(window_hashes(F.col("w"), 3).alias("h")).collect()]
    assert [len(x) for x in got] == [4, 0, 0] and got[0][0] == got[0][3] and len(set(got[0])) == 3


def luhn(x):
    return sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, reversed(x)))) % 10 == 0


def iban(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def plain_masks(text):
    out, spans, at = "", [], 0
    for m in re.finditer(corpus.CANDIDATE, text or ""):
        x, bare = m.group(), re.sub("[ -]", "", m.group())
        if "@" in x:
            kind = "email"
        elif "." in x:
            kind = "ip" if len(x.split(".")) == 4 and all(len(o) <= 3 and int(o) <= 255 for o in x.split(".")) else None
        elif x[0].isalpha():
            kind = "iban" if iban(bare) else None
        else:
            kind = "card" if 13 <= len(bare) <= 19 and luhn(bare) else None
        if kind:
            spans.append(f"{kind}:{m.start()}:{m.end()}")
            out, at = out + text[at : m.start()] + f"[{kind.upper()}]", m.end()
    return ",".join(spans), out + (text or "")[at:]


def test_personal_data(spark):
    texts = [
        "pay 4539 1488 0343 6467 or 4539148803436468, 4539148803436467.", "DE89 3704 0044 0532 0130 00 but not DE88370400440532013000 GB82WEST12345698765432", "é 😀 a.b@c.example.org and 10.0.0.255, 10.0.0.256 1.2.3.4.5",
        None, "", "no data", "4539148803436467", "0" * 16, "x@y", "12-34 5678-1234-5678-9012", "1234.5678 " + "mail me@a.example 1.1.1.1 " * 200,
    ]
    got = {r.doc_id: (r.spans, r.text, r.n_card + r.n_email + r.n_ip + r.n_iban) for r in masked(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    for i, t in enumerate(texts):
        spans, text = plain_masks(t)
        assert got[i] == (spans, text, len([x for x in spans.split(",") if x])), t
    assert {k: sum(k in g[0] for g in got.values()) > 0 for k in corpus.PII} == dict.fromkeys(corpus.PII, True)
    assert masked(spark.createDataFrame([], DOCS)).collect() == []


def test_license_lines(spark):
    rows = [(1, "Some text\nLicensed under the Apache License, Version 2.0.\nend"), (2, "This program is RELEASED UNDER THE MIT-LICENSE!"), (3, "my licence to drive"), (4, None), (5, "the mit license\nThe work is licensed under the GNU General Public License version 2")]
    got = {(r.doc_id, r.line): (r.license, r.share) for r in license_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, 2): ("Apache-2.0", 1000), (2, 1): ("MIT", 1000), (5, 2): ("GPL-3.0", 857)}


@pytest.mark.parametrize("name", ["doc_exact_dedup", "doc_line_dedup", "doc_stats_filter", "doc_contamination", "doc_pii", "doc_license"])
def test_no_python_in_the_plan(spark, sf_dir, name):
    text = plan(getattr(corpus, name)(spark, sf_dir))
    assert "Python" not in text and "Arrow" not in text and "NestedLoop" not in text
