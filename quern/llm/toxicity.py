"""Operator 8: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Words are runs of letters and digits, lower-cased. A word's input is its own vector (zero for words outside the vocabulary)
beside the mean vector of its hashed character n-grams, so that words outside the vocabulary have an input too. Windows of WINDOW words
start every STRIDE words; each goes through a gated recurrent unit in both directions, attention pools the states, and a
document's score is that of its highest window, calibrated. Training is multiple-instance: a toxic document vouches for its
highest windows, a clean one for all of its windows. Vectors start from the log-odds of words and n-grams in the
training documents.

The network is fitted on at most MOST_LABELLED labelled documents of each class, those with the least hash of doc_id
among the rows that are not held out. Scoring covers every window of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import PUNCTUATED, STEP_BYTES, hashed_words, mix, steps, text_column

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 8, 6, 6, 8
BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
MOST_LABELLED = 1500
MOST_WORDS = 1 << 15
ROUNDS, PASSES, BATCH, RATE = 4, 2, 256, 0.01
FOLDS, HELD_OUT = 5, 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Words:
    """The words of some texts: row of each, and for the distinct ones their hash and n-gram buckets in compressed rows."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        parts = []
        i = 0
        while i < len(at) - 1:  # a run of rows at a time: the hashes take many times the memory of the bytes
            j = max(i + 1, int(np.searchsorted(at, at[i] + STEP_BYTES, "right")) - 1)
            start, end, row, value = hashed_words(data[at[i] : at[j]], at[i : j + 1] - at[i], blanks=PUNCTUATED)
            parts.append((start + at[i], end + at[i], row + i, value))
            i = j
        start, end, self.row, value = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else hashed_words(data, at)
        self.hash, first, self.which = np.unique(value, return_index=True, return_inverse=True)
        self.bounds = np.searchsorted(self.row, np.arange(len(at)))
        self.grams, self.gram_at = _grams(data, start[first], end[first])


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of each word with a mark before it; a word too short for any has the bucket of itself."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    length = end - start + 1
    at = np.concatenate([[0], np.cumsum(length)])
    own = np.repeat(np.arange(len(start)), length)
    inside = np.arange(at[-1]) - at[own]
    byte = np.where(inside == 0, ord("<"), data[np.maximum(start[own] + inside - 1, 0)]).astype(np.uint64)
    byte[(byte >= 65) & (byte <= 90)] += np.uint64(32)
    room = length[own] - inside
    found, word = [], []
    for n in GRAMS:
        p = np.flatnonzero((room >= n) | (inside == 0) & (room < n) & (n == GRAMS[0]))
        code = np.full(len(p), np.uint64(n))
        for k in range(n):
            code = (code << np.uint64(8)) | np.where(k < room[p], byte[np.minimum(p + k, at[-1] - 1)], np.uint64(0))
        found.append((mix(code) % np.uint64(BUCKETS)).astype(np.int64))
        word.append(own[p])
    found, word = np.concatenate(found), np.concatenate(word)
    order = np.argsort(word, kind="stable")
    return found[order], np.searchsorted(word[order], np.arange(len(start) + 1))


class Network:
    """Parameters, and the passes forwards and backwards, over batches of windows."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": 0.1 * w(len(vocabulary) + 1, WORD_DIM), "char": 0.1 * w(BUCKETS, CHAR_DIM)}
        for s in "fb":
            self.p |= {f"{s}x": w(d, 3 * HIDDEN), f"{s}h": w(HIDDEN, 3 * HIDDEN), f"{s}b": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": w(2 * HIDDEN, ATTEND), "v": w(ATTEND, 1), "o": w(2 * HIDDEN, 1), "c": np.zeros(1, np.float32)}
        self.p["word"][0] = 0
        self.scale, self.shift = 1.0, 0.0

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in the vocabulary plus one; 0 if it is absent."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, words: Words) -> np.ndarray:
        """The input vector of each distinct word."""
        if not len(words.hash):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        n = np.diff(words.gram_at)[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][self.ids(words.hash)], np.add.reduceat(self.p["char"][words.grams], words.gram_at[:-1], 0) / n], 1)

    def forward(self, x: np.ndarray, keep: bool = False):
        """Logit of each window. x: [step, window, input]; a step past the end of a short window has zeros."""
        p, n, tape, states = self.p, x.shape[1], {}, []
        for s, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            h, out, saved = np.zeros((n, HIDDEN), np.float32), [None] * len(x), [None] * len(x)
            gates = x @ p[f"{s}x"] + p[f"{s}b"]
            for t in order:
                u = h @ p[f"{s}h"]
                zr = _sigmoid(gates[t][:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                m = np.tanh(gates[t][:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                if keep:
                    saved[t] = (h, z, r, m, u[:, 2 * HIDDEN :])
                h = m + z * (h - m)
                out[t] = h
            states.append(np.stack(out))
            tape[s] = saved
        both = np.concatenate(states, 2)
        heard = np.tanh(both @ p["a"])
        e = (heard @ p["v"])[..., 0]
        e = np.exp(e - e.max(0))
        share = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", share, both)
        logit = (pooled @ p["o"])[:, 0] + p["c"][0]
        return (logit, (x, tape, both, heard, share, pooled)) if keep else logit

    def backward(self, dlogit: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters but the vectors, and that of x."""
        x, tape, both, heard, share, pooled = kept
        p, g = self.p, {}
        g["o"], g["c"] = pooled.T @ dlogit[:, None], dlogit.sum(keepdims=True)
        dpooled = dlogit[:, None] * p["o"][:, 0]
        dboth = share[..., None] * dpooled
        dshare = np.einsum("tnh,nh->tn", both, dpooled)
        de = share * (dshare - (share * dshare).sum(0))
        dheard = de[..., None] * p["v"][:, 0] * (1 - heard * heard)
        g["v"], g["a"] = np.einsum("tna,tn->a", heard, de)[:, None], np.einsum("tnh,tna->ha", both, dheard)
        dboth += dheard @ p["a"].T
        dx = np.zeros_like(x)
        for i, (s, order) in enumerate((("f", range(len(x) - 1, -1, -1)), ("b", range(len(x))))):
            back, gx, gh, gb = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros_like(p[f"{s}x"]), np.zeros_like(p[f"{s}h"]), np.zeros_like(p[f"{s}b"])
            for t in order:
                h, z, r, m, u = tape[s][t]
                d = dboth[t][:, i * HIDDEN : (i + 1) * HIDDEN] + back
                dm = d * (1 - z) * (1 - m * m)
                gate = np.concatenate([d * (h - m) * z * (1 - z), dm * u * r * (1 - r), dm], 1)
                inner = np.concatenate([gate[:, : 2 * HIDDEN], dm * r], 1)
                back = d * z + inner @ p[f"{s}h"].T
                gh += h.T @ inner
                gx += x[t].T @ gate
                gb += gate.sum(0)
                dx[t] += gate @ p[f"{s}x"].T
            g |= {f"{s}x": gx, f"{s}h": gh, f"{s}b": gb}
        return g, dx


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, row) of every window. bounds: first word of each row, and the end."""
    size = np.diff(bounds)
    n = np.where(size > WINDOW, -(-(size - WINDOW) // STRIDE) + 1, (size > 0).astype(np.int64))
    row = np.repeat(np.arange(len(size)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = bounds[:-1][row] + k * STRIDE
    return start, np.minimum(start + WINDOW, bounds[1:][row]), row


def _gather(rows: np.ndarray, words: Words, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[step, window]: the distinct word at each step, and rows extended by a zero row that steps past the end get."""
    at = start + np.arange(WINDOW)[:, None]
    which = np.where(at < end, words.which[np.minimum(at, len(words.which) - 1)], len(rows))
    return which, np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)])


def window_logits(net: Network, words: Words, start: np.ndarray, end: np.ndarray, at_once: int = 2048) -> np.ndarray:
    rows, out = net.inputs(words), []
    for k in range(0, len(start), at_once):
        which, extended = _gather(rows, words, start[k : k + at_once], end[k : k + at_once])
        out.append(net.forward(extended[which]))
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def _log_odds(doc: np.ndarray, item: np.ndarray, toxic: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-odds of each item for toxic documents, by documents that hold it; and their number."""
    pair = np.unique(doc * n + item)
    doc, item = pair // n, pair % n
    yes = np.bincount(item, weights=toxic[doc], minlength=n)
    no = np.bincount(item, weights=1 - toxic[doc], minlength=n)
    return _odds(yes, no, toxic), yes + no


def _odds(yes: np.ndarray, no: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    return np.clip(np.log((yes + 0.5) / (toxic.sum() + 1)) - np.log((no + 0.5) / (len(toxic) - toxic.sum() + 1)), -3, 3)


def train(texts: list[str], toxic: np.ndarray, share: float) -> Network:
    """A network fitted to labelled texts, of which both classes must occur. share: that of toxic documents where they come from."""
    raw = [x.encode() for x in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    words = Words(np.frombuffer(b"".join(raw), np.uint8), at)
    # A fifth of the documents is kept from the fit, for the calibration.
    aside = np.zeros(len(texts), bool)
    for y in (0, 1):
        own = np.flatnonzero(toxic == y)
        aside[np.random.default_rng(4).permutation(own)[: len(own) // 5]] = True
    fit = ~aside[words.row]
    odds, seen = _log_odds(words.row[fit], words.which[fit], toxic, max(1, len(words.hash)))
    chosen = np.flatnonzero(seen >= 2)
    chosen = np.sort(chosen[np.argsort(-seen[chosen], kind="stable")[:MOST_WORDS]])
    net = Network(words.hash[chosen])
    net.p["word"][1:, 0] = odds[chosen]
    n = np.diff(words.gram_at)
    # Documents of each distinct word, spread over its n-grams, some documents at a time.
    pair = np.unique(words.row[fit] * len(n) + words.which[fit])
    yes, no = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for k in range(0, len(texts), 100):
        some = pair[np.searchsorted(pair, k * len(n)) : np.searchsorted(pair, (k + 100) * len(n))]
        doc_of, word_of = some // max(1, len(n)), some % max(1, len(n))
        times = n[word_of]
        gram = words.grams[np.repeat(words.gram_at[:-1][word_of], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        held = np.unique(np.repeat(doc_of, times) * BUCKETS + gram)
        yes += np.bincount(held % BUCKETS, weights=toxic[held // BUCKETS], minlength=BUCKETS)
        no += np.bincount(held % BUCKETS, weights=1 - toxic[held // BUCKETS], minlength=BUCKETS)
    net.p["char"][:, 0] = _odds(yes, no, toxic)
    start, end, row = windows(words.bounds)
    ids, rng = net.ids(words.hash), np.random.default_rng(6)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    rank = np.add.reduceat(net.inputs(words)[:, [0, WORD_DIM]].sum(1)[words.which], start) if len(start) else np.zeros(0)
    for turn in range(ROUNDS):
        score = rank if turn == 0 else window_logits(net, words, start, end)
        order = np.lexsort((-score, row))
        order = order[~aside[row[order]]]
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        top = order[place < 2]
        other = order[(place >= 2) & (toxic[row[order]] == 0)]
        use = np.concatenate([top[(place[place < 2] == 0) | (toxic[row[top]] == 0)], rng.permutation(other)[: 3 * len(texts)]])
        for _ in range(PASSES):
            use = rng.permutation(use)
            for k in range(0, len(use), BATCH):
                step += 1
                _learn(net, words, ids, start[use[k : k + BATCH]], end[use[k : k + BATCH]], toxic[row[use[k : k + BATCH]]], moments, step)
    # Calibration: a logistic curve through the highest windows of the documents aside, if they are enough.
    highest = np.full(len(texts), -8.0)
    np.maximum.at(highest, row, window_logits(net, words, start, end))
    if min(toxic[aside].sum(), (1 - toxic[aside]).sum()) >= 20:
        highest, toxic = highest[aside], toxic[aside]
    # The sample has about as many documents of either class, so each is weighted by what its class stands for.
    stands_for = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = _sigmoid(a * highest + b)
        w = np.maximum(q * (1 - q), 1e-6)
        w, off = w * stands_for, (q - toxic) * stands_for
        gap = np.array([(off * highest).sum() + 0.01 * (a - 1), off.sum()])
        curve = np.array([[(w * highest * highest).sum() + 0.01, (w * highest).sum()], [(w * highest).sum(), w.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(curve, gap), -1, 1)
        a, b = a - move[0], b - move[1]
    net.scale, net.shift = float(max(a, 0.05)), float(b)
    return net


def _learn(net: Network, words: Words, ids: np.ndarray, start: np.ndarray, end: np.ndarray, y: np.ndarray, moments: dict, step: int) -> None:
    """One step of Adam on a batch of windows, classes weighted alike."""
    at = start + np.arange(WINDOW)[:, None]
    inside = at < end
    token = words.which[np.minimum(at, len(words.which) - 1)]
    one, place = np.unique(token, return_inverse=True)
    place = place.reshape(token.shape)
    n = np.diff(words.gram_at)[one]
    gram = words.grams[np.repeat(words.gram_at[:-1][one], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    at_gram = np.cumsum(n) - n
    rows = np.concatenate([net.p["word"][ids[one]], np.add.reduceat(net.p["char"][gram], at_gram, 0) / n[:, None]], 1).astype(np.float32)
    logit, kept = net.forward(rows[place] * inside[..., None], True)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    g, dx = net.backward(((_sigmoid(logit) - y) * weight).astype(np.float32), kept)
    dx = (dx * inside[..., None]).reshape(-1, dx.shape[2])
    order = np.argsort(place.ravel(), kind="stable")
    drow = np.add.reduceat(dx[order], np.searchsorted(place.ravel()[order], np.arange(len(one))), 0)
    spread = np.repeat(drow[:, WORD_DIM:] / n[:, None], n, 0)
    g["word"] = np.stack([np.bincount(ids[one], weights=x, minlength=len(net.p["word"])) for x in drow[:, :WORD_DIM].T], 1).astype(np.float32)
    g["char"] = np.stack([np.bincount(gram, weights=x, minlength=BUCKETS) for x in spread.T], 1).astype(np.float32)
    g["word"][0] = 0
    for k, v in g.items():
        m, s = moments[k]
        m += 0.1 * (v - m)
        s += 0.001 * (v * v - s)
        net.p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def scores(net: Network, data: np.ndarray, at: np.ndarray, empty: float) -> np.ndarray:
    """The score of each text of one step; a text without words has the score empty."""
    words = Words(data, at)
    start, end, row = windows(words.bounds)
    highest = np.full(len(at) - 1, -np.inf)
    np.maximum.at(highest, row, window_logits(net, words, start, end))
    with np.errstate(over="ignore"):
        return np.where(np.isinf(highest), empty, _sigmoid(net.scale * highest + net.shift))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of at most MOST_LABELLED documents of each class that aren't held out, and the share of toxic ones."""
    own = labels.filter(~held_out(labels["doc_id"]) & labels["toxic"].isNotNull() & labels["doc_id"].isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = own.agg(F.avg("toxic").alias("share")).first().share or 0.0
    picked = [r for y in (0, 1) for r in own.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED).collect()]
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in picked], "id bigint, toxic int")
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_column(docs).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], np.array([r.toxic for r in rows], float), float(share)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of every row of docs.

    docs: doc_id, text; labels: doc_id, toxic; other columns are ignored, and neither labels nor ids enter a score. Texts without
    words, null ones included, score the labelled share of toxic documents (below 0.5 at most). Without labels of both classes every
    document scores that. Null ids count as not held out; repeated rows each have their score.
    """
    texts, toxic, share = labelled_sample(docs, labels)
    empty = min(share, 0.49)
    net = train(texts, toxic, share) if len(texts) and 0 < toxic.sum() < len(toxic) else None
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [scores(sent.value, data, at, empty) if sent.value else np.full(len(at) - 1, empty) for _, _, data, at in steps(batch.column("text"), 1 << 18)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    base = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), text_column(docs).alias("text"))
    return base.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
