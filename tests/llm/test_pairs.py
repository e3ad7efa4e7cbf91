"""Operators 4 and 10 and the pipeline against brute force."""

from __future__ import annotations

import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm.components import components
from quern.llm.decontamination import build_index, contaminated, edits_allowed, search
from quern.llm.near_dedup import near_duplicates, near_groups
from quern.sources.tables import load

from .conftest import documents, edge_rows, prose
from .test_kernels import edit_infix, lowered, thue_morse
from .test_native import base_counts, base_secrets, plain_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(lowered(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes_of(rows):
    """doc_id: (set size, least doc_id reachable) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    least[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_near_duplicates_on_documents(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    got = near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes_of([(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_large_loose_group(spark):
    """Copies of one text, each with edits of its own, from few to so many that links only run through others."""
    r = random.Random(3)
    base = prose(1, 150).split()
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4, 5, 6, 8))):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w), "en", "a"))
    rows += [(2000 + i, prose(50 + i, 100), "en", "a") for i in range(30)]
    assert result(near_duplicates(documents(spark, rows).repartition(5))) == classes_of([(x[0], x[1]) for x in rows])


def test_near_duplicates_of_ids_with_several_texts(spark):
    """Every text of an id has its own links, through the other texts of its id too only where those are similar."""
    a, b = prose(61, 100), prose(62, 100)
    rows = [(2, a, "en", "a"), (2, b, "en", "a"), (1, a + " more", "en", "a"), (3, b + " more", "en", "a"), (4, prose(63, 100), "en", "a"), (4, prose(63, 100), "en", "a")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(documents(spark, rows)).collect())
    assert got == [(1, 97, 1), (2, 96, 1), (2, 96, 2), (3, 97, 2), (4, 96, 4), (4, 96, 4)]
    leads = sorted(r.doc_id for r in near_groups(documents(spark, rows)).collect() if r.leads)
    assert leads == [1, 2, 4, 4]


def test_blocks_around_a_pivot_lose_no_link(spark, monkeypatch):
    """Loose copies around one text in many small blocks and chunks: components equal those of all pairs."""
    module = sys.modules["quern.llm.near_dedup"]
    for name, value in (("BLOCK_CLASSES", 16), ("CHUNK_CLASSES", 16), ("PRODUCT_COLUMNS", 8), ("PAIRS_AT_ONCE", 64)):
        monkeypatch.setattr(module, name, value)
    r = random.Random(5)
    base, rows = prose(70, 120).split(), []
    for i in range(400):
        w = list(rows[r.randrange(len(rows))][1].split() if rows and r.random() < 0.5 else base)
        for _ in range(r.choice((1, 2, 3, 3, 4, 5))):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((5000 - i, " ".join(w), "en", "a"))
    want = classes_of([(x[0], x[1]) for x in rows])
    assert len({c for _, c in want.values()}) > 20
    assert result(near_duplicates(documents(spark, rows).repartition(7))) == want


def test_near_duplicates_on_edge_rows(edge, no_documents):
    got = near_duplicates(edge).collect()
    assert len(got) == len(edge_rows()) and near_duplicates(no_documents).count() == 0
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    want = classes_of([(x[0], x[1]) for x in edge_rows() if x[0] is not None])
    assert {k: (r.n_shingles, r.component_id) for k, r in by_id.items()} == want
    assert by_id[9].component_id == 8 and by_id[7].component_id == 6 and by_id[2].component_id == 0
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]


def test_words_that_polynomial_hashes_confuse_are_not_linked(spark):
    a, b = thue_morse(2048)
    rows = [(1, a, "en", "a"), (2, b, "en", "a"), (3, b, "en", "b")]
    assert {r.doc_id: r.component_id for r in near_duplicates(documents(spark, rows)).collect()} == {1: 1, 2: 2, 3: 2}


@pytest.mark.parametrize("contracted", [1 << 20, 1])
def test_components_of_long_chains_and_hubs(spark, monkeypatch, contracted):
    """In one contraction, and, where a partition contracts each edge by itself, by star rounds over the cluster."""
    monkeypatch.setattr(sys.modules["quern.llm.components"], "CONTRACTED", contracted)
    edges = [(i, i + 1) for i in range(200, 260)] + [(1, k) for k in range(300, 400)] + [(500, 399), (7, 7), (None, 3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1 if contracted == 1 else 10_000)
    try:
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(8)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: 200 for i in range(200, 261)} | {k: 1 for k in (1, *range(300, 400), 500)}


def planted(spark):
    r = random.Random(9)
    items = [(k, prose(700 + k, n)) for k, n in enumerate((8, 12, 20, 33, 60, 150))] + [(90, "a short item"), (90, "of one id"), (91, None), (92, "..."), (None, prose(5, 30))]
    rows, want = [], set()
    for i in range(120):
        words = prose(i, 120).split()
        if i % 3 == 0:
            k = (i // 3) % 6
            leak = items[k][1].split()
            for _ in range(r.randint(0, edits_allowed(len(leak)) // 2)):
                leak[r.randrange(len(leak))] = "changed"
            at = r.randrange(len(words))
            words[at:at] = leak
        if i % 10 == 0:
            words[5:5] = ["A", "short,", "item" if i % 20 else "thing", "of", "one", "id"]
        rows.append((i, " ".join(words).upper() if i % 2 else " ".join(words), "en", "a"))
    for i, text, *_ in rows:
        for k, item in items:
            own = re.findall("[a-z0-9]+", (item or "").lower())
            if k is not None and own and edit_infix(own, re.findall("[a-z0-9]+", text.lower())) <= edits_allowed(len(own)):
                want.add((i, k))
    return rows, items, want


def test_contamination_equals_brute_force(spark, edge, no_documents):
    rows, items, want = planted(spark)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    got = contaminated(documents(spark, rows, clash=True), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) >= 40
    assert contaminated(edge, benchmark.limit(0)).count() == 0 and contaminated(no_documents, benchmark).count() == 0
    own = spark.createDataFrame([(1, prose(3, 200)), (2, " ".join(edge_rows()[8][1].split()[5000:5700]))], "item_id bigint, text string")
    found = contaminated(edge, own).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(6, 2), (7, 2), (11, 1), (11, 1)]


def test_a_partial_quote_does_not_hide_a_whole_copy(spark):
    rows, items = [], []
    for i in range(40):
        n, part, between = ((59, 29, 5), (100, 50, 10), (100, 65, 0))[i % 3]
        item = prose(3000 + i, n).split()
        items.append((i, " ".join(item)))
        rows.append((i, " ".join([*prose(i, 40).split(), *item[:part], *prose(5000 + i, between).split(), *item, *prose(6000 + i, 40).split()]), "en", "a"))
    got = {(r.doc_id, r.item_id): r.distance for r in contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(i, i): 0 for i in range(40)}


def test_items_without_blanks_and_repeated_ids(spark):
    """Characters of scripts without blanks are words; items that share an id are all searched, across blocks too."""
    item = "我们在河边测量水位并记录每天的变化情况直到春天结束"
    rows = [(1, "前言。" + item + "。后记", "zh", "a"), (2, "前言。" + item[:10] + "换" + item[11:] + "。后记", "zh", "a"), (3, item[:8], "zh", "a"), (4, prose(1, 40), "en", "a")]
    items = spark.createDataFrame([(7, item), (7, prose(1, 40)), (7, prose(2, 40))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in contaminated(documents(spark, rows), items).collect()}
    assert got == {(1, 7, 0), (2, 7, 1), (4, 7, 0)}


@pytest.mark.parametrize("n", [8, 15, 30, 48, 49, 60, 80, 97, 100, 120, 150])
def test_items_with_all_allowed_edits_are_found(n):
    r = random.Random(n)
    missed = 0
    for _ in range(40):
        word = lambda: f"w{r.randrange(3000)}"
        item = [word() for _ in range(n)]
        leak = list(item)
        for k in sorted(r.sample(range(n), edits_allowed(n)), reverse=True):
            leak[k : k + 1] = r.choice(([], ["new"], ["new", leak[k]]))
        raw = " ".join([*[word() for _ in range(40)], *leak, *[word() for _ in range(40)]]).encode()
        missed += not list(search(build_index([1], [" ".join(item)]), np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    assert missed == 0


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 7])
def test_short_items_equal_brute_force(n):
    """Few distinct words, so that edits, near misses, repeats and rows' ends meet in every way; several rows and items at once."""
    r = random.Random(n)
    some = lambda k: [r.choice("abcd") if r.random() < 0.9 else "e" for _ in range(k)]
    items = [some(n) for _ in range(30)]
    rows = [some(r.choice((0, 1, n - 1, n, n + 1, 12))) for _ in range(200)] + [some(2) + item for item in items[::9]]
    raw = [" ".join(x).encode() for x in rows]
    got = {(i, k): d for i, k, d, *_ in search(build_index(list(range(30)), [" ".join(x) for x in items]), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))}
    want = {(i, k): d for i, x in enumerate(rows) for k, item in enumerate(items) if x and (d := edit_infix(item, x)) <= edits_allowed(n)}
    assert got == want and (n < 5 or {0, 1} == set(want.values()))


def test_benchmark_blocks(spark, monkeypatch):
    from quern.llm import decontamination

    rows, items, want = planted(spark)
    items += [(90, items[k][1]) for k in range(4)]  # more items than a block share the id
    want |= {(i, 90) for i, k in want if k in range(4)}
    for name, value in (("BLOCK_ITEMS", 2), ("BLOCK_BYTES", 300)):
        with monkeypatch.context() as m:
            m.setattr(decontamination, name, value)
            got = contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    docs = {r.doc_id: r for r in load(spark, sf_dir, "documents").collect()}
    bench = [(r.item_id, re.findall(r"[^\W_]+", r.text.lower())) for r in load(spark, sf_dir, "benchmark").collect()]
    frames, now = [], load(spark, sf_dir, "documents", *corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, sf_dir), "test-stage")
        frames.append(now)
    assert all(f.columns == list(corpus_pipeline.COLUMNS) for f in frames[:-1])
    good, single, clean, masked = ({r.doc_id: r for r in f.collect()} for f in frames[:-1])
    assert set(good) <= {i for i, r in docs.items() if not base_counts(r.text)[5]}
    assert len(good) >= 0.7 * sum(not base_counts(r.text)[5] for r in docs.values())
    want = classes_of([(i, r.text) for i, r in good.items()])
    assert set(single) == {i for i, (_, least) in want.items() if least == i}
    words = {i: re.findall(r"[^\W_]+", r.text.lower()) for i, r in single.items()}
    leaks = {i for i, w in words.items() for _, item in bench if len(set(item) & set(w)) >= 0.7 * len(set(item)) and edit_infix(item, w) <= edits_allowed(len(item))}
    assert set(clean) == set(single) - leaks
    assert set(masked) == set(clean)
    for i, r in masked.items():
        assert (r.text == clean[i].text) == (base_secrets(clean[i].text)[:3] == (0, 0, 0)) and r.n_chars == len(r.text)
        assert not base_secrets(r.text)[0]
    mix = frames[-1].collect()
    sizes: dict = {}
    for r in masked.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    want_mix = plain_targets(sizes)
    assert {r.doc_id for r in mix} == set(masked) and all(r.target == pytest.approx(want_mix[masked[r.doc_id].source]) for r in mix)


def test_pipeline_stages_on_edge_rows(spark, tmp_path, no_documents):
    """Null and repeated ids, several texts of one id, clashing columns and an empty table: no row goes but those that a stage rejects."""
    item = prose(900, 40)
    spark.createDataFrame([(1, item), (2, "yes"), (None, prose(1, 30)), (3, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    x, y, z, leak = prose(801, 60), prose(802, 60), prose(803, 60), prose(804, 30) + " " + item + " " + prose(805, 30)
    rows = [(1, x, "en", "a"), (2, x, "en", "b"), (2, y, None, "a"), (2, y, None, "a"), (None, z, "en", None), (None, leak, "en", "a"), (None, x, None, None), (3, leak, "de", "a"), (4, "yes", "en", "a"), (4, None, "en", "a"), (5, "", "en", "a"), (6, f"yes {z} token=abcdefghijklmnop", "en", "a")]
    docs = documents(spark, rows, clash=True)
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    own = lambda *keep: sorted(((rows[k][0], rows[k][1]) for k in keep), key=repr)
    assert texts(stages["quality_rules"](spark, docs, str(tmp_path))) == own(0, 1, 2, 3, 4, 5, 6, 7, 11)
    assert texts(stages["near_dedup"](spark, docs, str(tmp_path))) == own(0, 2, 4, 5, 6, 7, 8, 9, 10, 11)
    assert texts(stages["decontamination"](spark, docs, str(tmp_path))) == own(0, 1, 2, 3, 4, 6, 9, 10, 11)
    masked = stages["secret_scan"](spark, docs, str(tmp_path))
    assert masked.count() == len(rows) and masked.columns == list(corpus_pipeline.COLUMNS)
    assert [r.text for r in masked.collect() if r.doc_id == 6] == [f"yes {z} [SECRET]"]
    assert sorted((r.doc_id or 0, r.size) for r in stages["source_mix"](spark, docs, str(tmp_path)).collect()) == sorted((r[0] or 0, len(WORD.findall(r[1] or ""))) for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, str(tmp_path)).count() == 0, name
