"""Operators 1, 2, 3, 6 and 8."""

from __future__ import annotations

import dataclasses
import os
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import html_extract, html_training, lm_score, toxicity
from quern.llm.cotraining import quality
from quern.llm.lm_score import lm_scores
from quern.llm.token_count import frequent_words, token_counts
from quern.sources.tables import load

from .conftest import documents, edge_rows, prose

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    (1, "plain words, with. points ... and 'quotes' don't we'll I'M", None, None), (2, "<|endoftext|> in <|startoftext|>text<|ENDOFTEXT|>", None, None),
    (3, "É é ñ ß ẞ Σ ΣΑΣ ŉ İ", None, None), (4, "a b c　d\x1ce\x85f", None, None), (5, "123 4.5,6 x,y. 7, 8.", None, None), (6, "😀😀 ​ zero", None, None),
    (7, "A,B.C, d.. e,. f,", None, None), (8, "日本語, テキスト。", None, None), (9, "́x ́", None, None),
]


@pytest.mark.parametrize("rows", [ODD, edge_rows()])
def test_token_counts_equal_the_library(spark, rows):
    library = tokenizers.Tokenizer.from_file(PATH)
    want = Counter()
    for r in rows:
        text = r[1] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want[r[0], len(text.encode()), n, n > 2048] += 1
    assert Counter(tuple(r) for r in token_counts(documents(spark, rows, clash=True), PATH).collect()) == want


def test_token_counts_on_documents(spark, sf_dir):
    library = tokenizers.Tokenizer.from_file(PATH)
    docs = load(spark, sf_dir, "documents")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()}
    assert got == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}


def test_other_tokenizers_are_refused(no_documents):
    with pytest.raises(ValueError, match="fold case"):
        token_counts(no_documents, public_tokenizers.path("byte_bpe_50k.json"))


def test_long_words_stay_out_of_the_sketch_but_count(spark):
    library = tokenizers.Tokenizer.from_file(PATH)
    rows = [(i, f"{'ab' * 400} short {'x' * (60 + i % 9)},", None, None) for i in range(50)]
    assert all(len(w.encode()) <= 64 for w in frequent_words(documents(spark, rows)))
    got = {r.doc_id: r.n_tokens for r in token_counts(documents(spark, rows), PATH).collect()}
    assert got == {r[0]: len(library.encode(r[1], add_special_tokens=False).ids) for r in rows}


def test_token_counts_of_nothing(no_documents):
    assert token_counts(no_documents, PATH).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style></head><body><nav><a href="/a">Menu</a></nav><!-- <p>no</p> -->
<div class="ad">Buy now and save more.</div><article><h1>Head &amp; line</h1><p><b>Bold<br>next&nbsp;word<p>Second  para
graph &lt;here&gt; <a href='x'>link</a>.</p><script>var t="<p>no</p>";</script><form><p>Your mail</p></form><p>Ok.</p></article>
<section id="comments"><p>A reader writes a long and friendly answer to all of this here today.</p></section><footer>&copy; 2020</footer></body></html>"""


def test_page_text():
    tree = html_extract.trained()
    assert html_extract.main_text(PAGE, tree) == "Head & line\nBold next word\nSecond para graph <here> link.\nOk."


@pytest.mark.parametrize("page", ["", "<", "<p", "text only here", "<article>open", "<!-- never closed", "</p></p>", "<script>x", "<p>a &am", "<a title='>'>x</a>", "<head><title>x", "<li><li></ul>"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_extract.main_text(page, html_extract.trained()), str)


def wrong_blocks(tree, pages, zeroed=()):
    """Blocks of labelled pages that the tree gets wrong, of how many; some features set to 0."""
    wrong = n = 0
    for page in pages:
        found = html_extract.blocks(page)
        x = html_extract.features(found)
        x[:, [html_extract.FEATURES.index(k) for k in zeroed]] = 0
        n += len(found)
        wrong += sum((html_extract.predict(tree, row) >= 0.5) != b.label for b, row in zip(found, x, strict=True) if b.label is not None)
    return wrong, n


def test_the_tree_learns_from_neighbours_and_generalises():
    tree, pages = html_extract.trained(), html_training.pages(99, 10)
    used, rest = set(), [tree]
    while rest:
        node = rest.pop()
        if isinstance(node, tuple):
            used.add(html_extract.FEATURES[node[0]])
            rest += node[2:]
    neighbours = [k for k in html_extract.FEATURES if k.endswith(("_before", "_after"))]
    assert used & {"words_before", "words_after"} and used & {"link_density_before", "link_density_after"} and "link_density" in used and "words" in used
    wrong, n = wrong_blocks(tree, pages)
    assert wrong <= 0.01 * n and wrong_blocks(tree, pages, neighbours)[0] > 5 * wrong + 10


def test_names_decide_nothing_alone():
    tree = html_extract.trained()
    long = "The notes of that year fill four large boxes in the archive of the town and nobody has read all of them since."
    page = f'<body><div class="two-col side-by-side"><h1>On maps</h1><p>{long}</p><p>{long}</p></div></body>'
    assert html_extract.main_text(page, tree) == f"On maps\n{long}\n{long}"
    page = f"<article><h1>T</h1><h2><a href=1>A linked heading</a></h2><p>{long}</p><ul><li><a href=2>One</a></li><li><a href=3>Two</a></li></ul></article>"
    assert html_extract.main_text(page, tree) == f"T\nA linked heading\n{long}\nOne\nTwo"
    page = f'<article><h1>T</h1><p>{long}</p><div class="x">Buy two pairs of boots now.</div><p>{long}</p></article><div class="y"><div>Ann Hill</div><p>I was there too and {long}</p></div>'
    assert html_extract.main_text(page, tree) == f"T\n{long}\n{long}"
    page = f'<body><form><div class="sidebar-layout"><h1>T</h1><p>{long}</p></div></form><form><p>{long}</p></form></body>'
    assert html_extract.main_text(page, tree) == f"T\n{long}"


def test_quotes_open_after_an_equals_sign_only_and_drawings_nest():
    tree = html_extract.trained()
    long = "The notes of that year fill four large boxes in the archive of the town and nobody has read all of them since."
    read = lambda inner: html_extract.main_text(f"<article><h1>T</h1>{inner}</article>", tree)
    assert read(f"<p title=don't>{long}</p><p>It isn't over: {long}</p>") == f"T\n{long}\nIt isn't over: {long}"
    assert read(f'<p title = "a > b" data-x=\'<p>"\'>{long}</p><p 5" wide>{long}</p>') == f"T\n{long}\n{long}"
    assert read(f"<svg width=1><g/><svg/><svg><text>no</text></svg><text>leak</text></svg><p>{long}</p>") == f"T\n{long}"
    assert read(f"<template><template>no</template>leak</template><script>'</script x><p>{long}</p>") == f"T\n{long}"
    assert read(f'<svg title="</svg>"><text>leak</text></svg><p>{long}</p>') == f"T\n{long}"


@pytest.mark.parametrize("part", ["<p><span>x ", "<div><a>x", "<ul><li>x", "</b>", "<p>x", "<li><ul><b>", '<a "', "<!-- ", "<form>", '<a x="', "<a x='\">", "<svg>", "<svg x='", '= "<p x=">'])
def test_reading_takes_linear_time(part):
    tree, took = html_extract.trained(), []
    for n in (200_000, 800_000):
        began = time.process_time()
        html_extract.main_text(part * (n // len(part)), tree)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1


def test_pages(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        whole = " ".join(html_extract.html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", inside)).split())
        assert got[r.page_id].text.replace("\n", " ") == whole and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_null_pages(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    df = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "", "y"), (2, "u", "<p>One two three four five six.</p>", "z")], "page_id bigint, url string, html string, text string")
    assert Counter((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect()) == {(1, "", 0): 2, (None, "", 0): 1, (2, "One two three four five six.", 28): 1}


def test_tree_learns_its_table():
    x = np.array([[0, 1], [0, 2], [1, 5], [1, 6]], float)
    tree = html_extract.train_tree(x, np.array([0.0, 0, 1, 1]))
    assert [html_extract.predict(tree, r) for r in x] == [0, 0, 1, 1]


def labelled(n: int):
    rows, marks = [], []
    for i in range(n):
        bad, rude = i % 4 == 0, i % 5 == 0
        text = prose(i, 60)
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if rude:
            text += " vequ" + "abcdefghij"[i % 10] + "or snarf " + prose(1000 + i, 10) + " snarf"
        rows.append((i, text, "en" if i % 2 else "fr", f"s{i % 3}"))
        marks.append((i, int(not bad), int(rude)))
    return rows, marks


def test_quality_and_toxicity_learn(spark):
    rows, marks = labelled(600)
    docs, labels = documents(spark, rows, clash=True), spark.createDataFrame(marks[:480], "doc_id bigint, quality int, toxic int")
    good = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert np.mean([good[i].kept == bool(q) for i, q, _ in marks[480:]]) >= 0.95
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    rest = [i for i, _, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i].held_out} == set(rest)
    assert np.mean([got[i].predicted == marks[i][2] for i in rest]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_models_on_edge_rows(spark, edge, no_documents):
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 1), (6, 1, 1), (10, 0, None), (None, 1, 1), (11, None, 0), (12, 0, 0)], "doc_id bigint, quality int, toxic int")
    none = labels.limit(0)
    for operator in (quality, toxicity.toxicity):
        for marks in (labels, none):
            assert Counter(r.doc_id for r in operator(edge, marks).collect()) == Counter(r[0] for r in edge_rows())
        assert operator(no_documents, labels).count() == 0
    got = lm_scores(edge).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in edge_rows()) and lm_scores(no_documents).count() == 0
    assert all((r.n_tokens == 0) == (r.mean_log_likelihood is None) and r.log_likelihood <= 0 for r in got)


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    net = toxicity.Network(np.arange(1, 5, dtype=np.uint64))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((5, 3, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    weight = rng.standard_normal(3)
    _, kept = net.forward(x, True)
    g, dx = net.backward(weight, kept)
    for name in ("fx", "fh", "fb", "bx", "bh", "a", "v", "o", "c"):
        flat, at = net.p[name].reshape(-1), rng.integers(net.p[name].size)
        old, ends = flat[at], []
        for step in (1e-4, -1e-4):
            flat[at] = old + step
            ends.append(float(net.forward(x) @ weight))
        flat[at] = old
        assert g[name].reshape(-1)[at] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=2e-2, abs=1e-4), name
    old, ends = x[2, 1, 3], []
    for step in (1e-4, -1e-4):
        x[2, 1, 3] = old + step
        ends.append(float(net.forward(x) @ weight))
    assert dx[2, 1, 3] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=2e-2, abs=1e-4)


def test_recurrent_network_equals_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    net = toxicity.Network(np.arange(1, 5, dtype=np.uint64))
    p = net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((6, 4, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    n, sigmoid = toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    for w, got in enumerate(net.forward(x)):
        states = []
        for side, order in (("f", range(6)), ("b", range(5, -1, -1))):
            h, out = np.zeros(n), {}
            for t in order:
                gate, back = x[t, w] @ p[f"{side}x"] + p[f"{side}b"], h @ p[f"{side}h"]
                z, r = sigmoid(gate[:n] + back[:n]), sigmoid(gate[n : 2 * n] + back[n : 2 * n])
                h = (1 - z) * np.tanh(gate[2 * n :] + r * back[2 * n :]) + z * h
                out[t] = h
            states.append(out)
        both = [np.concatenate([states[0][t], states[1][t]]) for t in range(6)]
        weight = np.exp([(np.tanh(b @ p["a"]) @ p["v"])[0] for b in both])
        pooled = sum(a * b for a, b in zip(weight / weight.sum(), both, strict=True))
        assert got == pytest.approx((pooled @ p["o"])[0] + p["c"][0], rel=1e-4)


def test_toxicity_needs_words_and_characters():
    """The whole network tells texts that it hasn't seen; without word vectors it finds no toxic one, without those of characters it errs."""
    toxic = np.array([float(i % 5 == 0) for i in range(300)])
    net = toxicity.train([prose(i, 40) + (f" vequ{'abcdefgh'[i % 8]}or " if i % 5 == 0 else " ") + prose(900 + i, 20) for i in range(300)], toxic, 0.2)
    rude, clean = [prose(2000 + i, 40) + f" vequ{x}or " + prose(3000 + i, 20) for i, x in enumerate("abcdefgh")], [prose(4000 + i, 60) for i in range(8)]

    def found(part: str | None = None) -> tuple[float, float]:
        kept = dict(net.p)
        if part:
            net.p[part] = 0 * net.p[part]
        raw = [t.encode() for t in rude + clean]
        out = toxicity.scores(net, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 0.0) >= 0.5
        net.p = kept
        return out[:8].mean(), out[8:].mean()

    assert found() == (1.0, 0.0)
    assert found("word")[0] <= 0.25
    hit, alarm = found("char")
    assert hit < 1 or alarm > 0


def test_sums_over_the_pool_equal_plain_ones(spark):
    """Gradients and Hessians that tasks add up are those of all documents that the other view is certain of, computed in one place."""
    from quern.llm import cotraining

    rng = np.random.default_rng(3)
    batch = next(iter(cotraining._packed(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": [prose(i, 30).upper() if i % 3 else prose(i, 30) for i in range(60)], "lang": ["en"] * 60, "source": [f"s{i % 5}" for i in range(60)]})]))))
    views = cotraining._unpacked(batch)
    y = (np.arange(60) % 3 > 0).astype(float)
    fitted = [cotraining.Logistic(v, y) for v in views]
    teachers = [f.beta + rng.standard_normal(len(f.beta)) * 0.01 for f in fitted]
    pool = spark.createDataFrame([(bytes(a), bytes(b)) for a, b in zip(batch.column("text_view").to_pylist(), batch.column("meta_view").to_pylist(), strict=True)], "text_view binary, meta_view binary").repartition(4)
    got = cotraining._taught(pool, fitted, teachers)
    z = [f.standard(v) for f, v in zip(fitted, views, strict=True)]
    for pupil, teacher in ((0, 1), (1, 0)):
        p = 1 / (1 + np.exp(-np.clip(z[teacher] @ teachers[teacher], -30, 30)))
        for label in (0, 1):
            sure = np.flatnonzero((p if label else 1 - p) >= cotraining.CERTAIN)
            g, h = np.zeros(z[pupil].shape[1]), 0
            for i in sure:
                q = 1 / (1 + np.exp(-np.clip(z[pupil][i] @ fitted[pupil].beta, -30, 30)))
                g, h = g + (q - label) * z[pupil][i], h + max(q * (1 - q), 1e-5) * np.outer(z[pupil][i], z[pupil][i])
            n, gradient, hessian = got[pupil][label]
            assert n == len(sure) and np.allclose(gradient, g, atol=1e-6) and np.allclose(hessian, h, atol=1e-6)


def test_windows_cover_every_word():
    start, end, row = toxicity.windows(np.array([0, 0, 5, 5 + 32, 5 + 32 + 100]))
    assert set(row.tolist()) == {1, 2, 3}
    for r, (a, b) in enumerate([(0, 0), (0, 5), (5, 37), (37, 137)]):
        assert set().union(*[range(s, e) for s, e, k in zip(start, end, row) if k == r], set()) == set(range(a, b))


def test_language_model_tells_order_from_shuffle(spark):
    """Texts with a grammar score above the same words in random order."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(300):
        words = []
        for _ in range(60):
            words += ["the", f"noun{r.integers(6)}", "is", f"kind{r.integers(6)}x", "now"]
        if i % 10 == 0:
            words = list(r.permutation(words))
        rows.append((i, " ".join(words), "en", "a"))
    got = {x.doc_id: x.mean_log_likelihood for x in lm_scores(documents(spark, rows)).collect()}
    assert max(got[i] for i in got if i % 10 == 0) < min(got[i] for i in got if i % 10)


def lexicon_of(top, pairs=None, others=None):
    return lm_score.build_lexicon(top, pairs or {}, np.ones(lm_score.LENGTH_CLASSES) if others is None else others)


def small_network():
    """A network with random parameters, and tokens of two rows with words in and outside its classes."""
    net = lm_score.WindowNetwork(lexicon_of([(k, 3000 - k) for k in range(1, 200)]))
    rng = np.random.default_rng(1)
    net.p = {k: v.astype(float) + rng.standard_normal(v.shape) * 0.3 for k, v in net.p.items()}
    n = 40
    rank = rng.integers(0, 256, n)
    group = np.where(rng.random(n) < 0.3, lm_score.COMMON_CLASSES + rng.integers(0, lm_score.LENGTH_CLASSES, n), rank // lm_score.CLASS_WORDS)
    common = group < lm_score.COMMON_CLASSES
    t = lm_score.Tokens(np.repeat([0, 1], [25, 15]), group, np.where(common, rank % lm_score.CLASS_WORDS, 0), np.where(common, rank, lm_score.TOP + rank), rank, np.zeros(n), np.zeros(n))
    return net, t


def test_network_equals_a_plain_forward_pass():
    net, t = small_network()
    got = net.log_probability(lm_score.contexts(t), t.group, t.place)
    for i in range(len(t.row)):
        h = net.p["b"].copy()
        for k, shift in enumerate((-2, -1, 1, 2)):
            j = i + shift
            inside = 0 <= j < len(t.row) and t.row[j] == t.row[i]
            h += net.p["e"][k, t.number[j] if inside else lm_score.NOTHING]
        h = np.tanh(h)
        odds = h @ net.p["w"] + net.p["c"]
        want = odds[t.group[i]] - np.log(np.exp(odds).sum())
        if t.group[i] < lm_score.COMMON_CLASSES:
            odds = net.p["o"][t.group[i]] @ h + net.p["d"][t.group[i]]
            want += odds[t.place[i]] - np.log(np.exp(odds).sum())
        assert got[i] == pytest.approx(want)


def test_gradients_of_the_window_network():
    net, t = small_network()
    around = lm_score.contexts(t)
    g = net.gradients(around, t.group, t.place)
    loss = lambda: -float(net.log_probability(around, t.group, t.place).mean())
    for name, v in g.items():
        for at in np.argsort(np.abs(v).ravel())[-5:]:
            flat, ends = net.p[name].reshape(-1), []
            old = flat[at]
            for step in (1e-5, -1e-5):
                flat[at] = old + step
                ends.append(loss())
            flat[at] = old
            assert v.reshape(-1)[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4), name


def test_network_beats_counts_on_held_out_text_and_does_not_depend_on_the_dealing(spark):
    """On text it hasn't seen the trained network gains at least 0.2 nats a token over the same model without it, on any dealing of the rows alike."""
    docs = load(spark, "/root/testdata/sf0.01", "documents") if os.path.isdir("/root/testdata/sf0.01") else pytest.skip("no tables")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    learn, tell = docs.filter(part > 0), docs.filter(part == 0)
    model = lm_score.fit(learn.repartition(2))
    mean = lambda m: lm_score.scores(tell, m).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    assert mean(model) - mean(dataclasses.replace(model, weights=None)) > 0.2
    again = lm_score.fit(learn.repartition(16))
    assert np.abs(model.weights - again.weights).max() < 1e-4


def test_spelling_model_is_a_distribution():
    pairs = {(ord("a") + 1): 5, (ord("a") + 1) * 257 + ord("b") + 1: 4, (ord("b") + 1) * 257: 4, (ord("a") + 1) * 257: 1}
    lexicon = lexicon_of([(3, 10), (2, 5), (9, 5)], pairs)
    assert np.exp(lexicon.length_mass).sum() == pytest.approx(1) and np.exp(lexicon.class_odds).sum() == pytest.approx(1)
    assert np.exp(lexicon.word_odds).sum(1) == pytest.approx(np.ones(lm_score.COMMON_CLASSES))
    assert np.exp(lexicon.word_odds[0, :3]) == pytest.approx([0.5, 0.25, 0.25], abs=1e-4)
    t = lm_score.tokens(lexicon, np.frombuffer(b"ab a", np.uint8), np.array([0, 4]))
    spell = lexicon.spell.reshape(257, 257)
    a, b = ord("a") + 1, ord("b") + 1
    assert t.spelt[0] == pytest.approx(spell[0, a] + spell[a, b] + spell[b, 0] - lexicon.length_mass[1])
    assert t.spelt[1] == pytest.approx(spell[0, a] + spell[a, 0] - lexicon.length_mass[0])


def test_words_outside_the_most_frequent_are_scored_by_their_counts(spark):
    """Two words of like spelling outside the top: the one seen often scores above the one seen once, by their counts."""
    rows = [(i, "aaaa bbbb aaaa bbbb aaaa bbbb", "en", "a") for i in range(60)] + [(100 + i, "aaaa cdcd bbbb", "en", "a") for i in range(50)] + [(200, "aaaa dcdc bbbb", "en", "a"), (200, None, "en", "a")]
    docs = documents(spark, rows)
    model = lm_score.fit(docs, 2)
    got = lm_score.scores(docs, dataclasses.replace(model, weights=None)).collect()
    often, once, none = (next(r for r in got if r.doc_id == i and (r.n_tokens > 0) == some) for i, some in ((100, True), (200, True), (200, False)))
    assert len(got) == len(rows) and (none.n_tokens, none.log_likelihood, none.mean_log_likelihood) == (0, 0, None)
    # Of 51 such tokens and 2 such words, the common one has (50 - 1 + 2 * spelling) / 51 and the single one 2 / 51 * spelling.
    pairs = Counter()
    for _, text, *_ in rows:
        letters = [0] + [0 if c == " " else ord(c) + 1 for c in (text or "")] + [0]
        pairs.update(a * 257 + b for a, b in zip(letters, letters[1:], strict=False) if a or b)
    lexicon = lexicon_of([], dict(pairs))
    spelt = [float(lm_score.tokens(lexicon, np.frombuffer(w, np.uint8), np.array([0, 4])).spelt[0]) for w in (b"cdcd", b"dcdc")]
    want = np.log((49 + 2 * np.exp(spelt[0])) / 51) - (np.log(2 / 51) + spelt[1])
    assert often.log_likelihood - once.log_likelihood == pytest.approx(want, abs=1e-6)
    trained = {r.doc_id: r.log_likelihood for r in lm_score.scores(docs, model).collect() if r.n_tokens}
    assert trained[100] - trained[200] > 3
    # Whether counts are at hand or come by the join makes no difference.
    joined = lm_score.fit(docs, 2, 2)
    assert len(joined.lexicon.keys) == 2 < len(model.lexicon.keys)
    assert {r.doc_id: r.log_likelihood for r in lm_score.scores(docs, joined).collect() if r.n_tokens} == pytest.approx(trained, rel=1e-5)


def test_every_unlabelled_document_teaches(spark, monkeypatch):
    """A source that no label names, among 4500 documents: all that the text view is certain of teach the metadata view."""
    from quern.llm import cotraining

    rows, marks = labelled(200)
    shout = " ".join(w.upper() + "!!" for w in prose(1, 60).split())
    rows += [(1000 + i, shout if i % 3 == 0 else prose(4, 60), "en", "bad" if i % 3 == 0 else "new") for i in range(4500)]
    seen = []
    taught = cotraining._taught
    monkeypatch.setattr(cotraining, "_taught", lambda *x: seen.append(taught(*x)) or seen[-1])
    got = {r.doc_id: r for r in quality(documents(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")).collect()}
    (bad, _, _), (good, _, _) = seen[-1][1]
    assert (bad, good) == (1500, 3000)
    assert got[1000].meta_score < got[1001].meta_score


def test_the_text_view_keeps_what_the_labels_taught_it(spark):
    """Few bad documents and metadata that tell little: learning from all documents must not spoil the text view."""
    rows = [(i, " ".join(w.upper() + "!!" for w in prose(i, 60).split()) if i % 16 == 0 else prose(i, 60), "en" if i // 16 % 2 else "fr", f"s{i // 32 % 3}") for i in range(3200)]
    marks = [(i, int(i % 16 > 0)) for i in range(0, 1600)]
    got = quality(documents(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int")).collect()
    assert all((r.text_score >= 0.5) == (r.doc_id % 16 > 0) for r in got)


def test_quality_fits_settle(spark, sf_dir, monkeypatch):
    """Every round's fit goes on until its steps are small, and the held-aside documents are told apart."""
    from quern.llm import cotraining

    steps, rounds, was, taught = [], [], cotraining.Logistic.step, cotraining._trusted

    def step(self, labels=()):
        size = was(self, labels)
        if labels:
            steps.append(size)
        return size

    monkeypatch.setattr(cotraining.Logistic, "step", step)
    monkeypatch.setattr(cotraining, "_trusted", lambda *x: rounds.append(len(steps)) or taught(*x))
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    scored = {r.doc_id: r.score for r in cotraining.quality(docs, labels).collect()}
    ends = sorted({n for n in rounds if n} | {len(steps)})
    assert steps and all(max(steps[n - 2 : n]) < cotraining.SETTLED for n in ends)
    truth = {r.doc_id: r.quality for r in labels.filter("quality IS NOT NULL").collect()}
    assert np.mean([(scored[k] >= 0.5) == bool(v) for k, v in truth.items() if k in scored]) > 0.9
