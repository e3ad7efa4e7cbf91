"""Operator 12: language identification by hierarchical discrimination.

A text is a profile: the square roots of its counts of hashed byte n-grams of letters, scaled to length 1. The languages of the training
documents are put into families, those whose mean profiles are closest first (average linkage, until there are about as many families as each has members).
A linear support vector machine for each family against the others picks the family; within it, one for each pair of languages
votes. Machines are trained by dual coordinate descent in numpy; a fifth of the sample fits how a margin becomes a probability.

The machines are fitted on a bounded sample: at most MOST_LABELLED documents, as many of each language (LEAST_PER_LANGUAGE at least), those
with the least hash of doc_id among the rows that aren't held out. Beside its whole text, each of them also gives SNIPPETS of a few words, as
short texts are to be told apart too. Prediction reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import mix, steps, text_column
from quern.sources.tables import small

GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 13
MOST_LABELLED, LEAST_PER_LANGUAGE = 2000, 20
SNIPPETS = (3, 9)
FOLDS, HELD_OUT = 3, 1
#: Cost of a margin that is missed, passes over the sample, and rows that are predicted at a time.
COST, PASSES, ROWS = 10.0, 12, 128
UNKNOWN = "und"

#: Letters' bytes in lower case; all other bytes are blanks.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of each row at[0]:at[1], at[1]:at[2]... A row's letters lie between single blanks, one before and one after the row."""
    text = np.insert(_LETTER[data], at, 32)
    edge = np.zeros(len(text), bool)
    edge[at + np.arange(len(at))] = True
    blank = text == 32
    keep = np.ones(len(text), bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | edge[1:]
    text, edge = text[keep].astype(np.uint64), edge[keep]
    row = np.cumsum(edge) - 1  # a blank between two rows counts as the second one's, and ends n-grams of the first
    rows, buckets, code = [], [], np.zeros(len(text), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        code = (code[: len(text) - n + 1] << np.uint64(8)) | text[n - 1 :]
        if n not in GRAMS or not len(code):
            continue
        first, last = row[: len(code)], row[n - 1 :]
        own = ((first == last) | (last == first + 1) & edge[n - 1 :]) & (first < len(at) - 1)
        if n == 1:
            own &= ~edge
        rows.append(first[own])
        buckets.append((mix(code[own] + np.uint64(n << 40)) % np.uint64(BUCKETS)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (np.zeros(0, np.int64),) * 2


def profiles(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of length 1 (or 0, without n-grams) for each text."""
    n = len(at) - 1
    row, bucket = grams(data, at)
    x = np.sqrt(np.bincount(row * BUCKETS + bucket, minlength=n * BUCKETS).astype(np.float32)).reshape(n, BUCKETS)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


# --- training ---------------------------------------------------------------------------------------------------------


class Sample:
    """Profiles in compressed rows, with the number of each one's language and whether it calibrates."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], lang: np.ndarray, apart: np.ndarray):
        self.rows, self.lang, self.apart = rows, lang, apart

    def mean(self, lang: int) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for k in np.flatnonzero(self.lang == lang):
            index, value = self.rows[k]
            out[index] += value
        return out / max(np.linalg.norm(out), 1e-9)


def machine(sample: Sample, who: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear support vector machine for the rows ``who`` with labels y of -1 and 1, and its offset: dual coordinate descent, classes weighted alike."""
    w, offset, dual = np.zeros(BUCKETS), 0.0, np.zeros(len(who))
    most = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * COST
    norm = np.array([float(sample.rows[k][1] @ sample.rows[k][1]) + 1 for k in who])
    random = np.random.default_rng(0)
    for _ in range(PASSES):
        worst = 0.0
        for i in random.permutation(len(who)).tolist():
            index, value = sample.rows[who[i]]
            gap = y[i] * (float(w[index] @ value) + offset) - 1
            now = min(max(dual[i] - gap / norm[i], 0.0), most[i])
            if (move := now - dual[i]) != 0.0:
                worst, dual[i] = max(worst, abs(move)), now
                w[index] += move * y[i] * value
                offset += move * y[i]
        if worst < 1e-3:
            break
    return w, offset


def margins(sample: Sample, who: np.ndarray, w: np.ndarray, offset: float) -> np.ndarray:
    return np.array([float(w[sample.rows[k][0]] @ sample.rows[k][1]) + offset for k in who])


def slope(margin: np.ndarray, y: np.ndarray) -> float:
    """The factor with which margins are log-odds: the likeliest one on these rows, near 2 where they are few."""
    a = 2.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin * y, -30, 30)))
        g = (margin * y * (1 - p)).sum() - 0.1 * (a - 2)
        a = min(max(a + g / ((margin**2 * p * (1 - p)).sum() + 0.1), 0.1), 20.0)
    return a


def families(means: np.ndarray) -> list[list[int]]:
    """Languages (rows of means) in families: the two of greatest mean similarity join, until ceil(sqrt(number of languages)) are left."""
    near, out = means @ means.T, [[k] for k in range(len(means))]
    while len(out) > int(np.ceil(np.sqrt(len(means)))):
        a, b = max(combinations(range(len(out)), 2), key=lambda p: (near[np.ix_(out[p[0]], out[p[1]])].mean(), -p[0], -p[1]))
        out[a] = sorted(out[a] + out.pop(b))
    return out


class Model:
    """Languages, families, and one column of weights for each machine: the families' first, then the pairs' within them."""

    def __init__(self, languages: list[str], sample: Sample):
        self.languages = languages
        self.families = families(np.stack([sample.mean(k) for k in range(len(languages))]))
        self.pairs = [p for f in self.families for p in combinations(f, 2)]
        fits = []
        if len(self.families) > 1:
            fits = [(np.arange(len(sample.lang)), np.where(np.isin(sample.lang, f), 1.0, -1.0)) for f in self.families]
        for a, b in self.pairs:
            who = np.flatnonzero((sample.lang == a) | (sample.lang == b))
            fits.append((who, np.where(sample.lang[who] == a, 1.0, -1.0)))
        self.w, self.offset = np.zeros((BUCKETS, len(fits)), np.float32), np.zeros(len(fits), np.float32)
        for j, (who, y) in enumerate(fits):
            apart = sample.apart[who]
            w, offset = machine(sample, who[~apart], y[~apart])
            a = slope(margins(sample, who[apart], w, offset), y[apart])
            self.w[:, j], self.offset[j] = a * w, a * offset

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each profile's language, and a score from 0 to 1: the probability of its family times that of it among the family."""
        odds = x @ self.w + self.offset
        n, k = len(x), len(self.families) if len(self.families) > 1 else 0
        first = odds[:, :k] - odds[:, :k].max(1, keepdims=True) if k else np.zeros((n, 1), np.float32)
        share = np.exp(first) / np.exp(first).sum(1, keepdims=True)
        family = share.argmax(1)
        votes, chance = np.zeros((n, len(self.languages))), np.zeros((n, len(self.languages)))
        for j, (a, b) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-np.clip(odds[:, k + j], -30, 30)))
            votes[:, a] += p >= 0.5
            votes[:, b] += p < 0.5
            chance[:, a] += p
            chance[:, b] += 1 - p
        out, score = np.zeros(n, np.int64), np.zeros(n)
        for f, members in enumerate(self.families):
            who = np.flatnonzero(family == f)
            best = np.array(members)[(votes[np.ix_(who, members)] + chance[np.ix_(who, members)] / (len(members) + 1)).argmax(1)]
            out[who], score[who] = best, share[who, f] * (chance[who, best] / (len(members) - 1) if len(members) > 1 else 1.0)
        return out, np.clip(score, 0, 1)


# --- Spark ------------------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _snippets(text: str) -> list[str]:
    """A few runs of words from inside a text, where its own length says."""
    words = text.split()
    return [" ".join(words[(k := len(text) * (j + 1) % max(1, len(words) - n + 1)) : k + n]) for j, n in enumerate(SNIPPETS)]


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, h, and the profiles (bucket and value) of each text and its snippets."""
    for batch in batches:
        for lang, h, text in zip(*(batch.column(k).to_pylist() for k in ("lang", "h", "text")), strict=True):
            raw = [x.encode() for x in (text, *_snippets(text))]
            out = []
            for x in profiles(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])):
                index = np.flatnonzero(x)
                out.append((index.astype(np.uint16).tobytes(), x[index].astype(np.float16).tobytes()))
            yield pa.record_batch({"lang": [lang] * len(out), "h": [h] * len(out), "buckets": pa.array([x[0] for x in out], pa.binary()), "weights": pa.array([x[1] for x in out], pa.binary())})


def labelled_sample(docs: DataFrame, most: int = MOST_LABELLED) -> tuple[list[str], Sample | None]:
    """The languages and the sample that the machines are fitted on."""
    doc_id = docs["doc_id"].cast("bigint")
    base = docs.select(docs["lang"].cast("string").alias("lang"), F.xxhash64(doc_id).alias("h"), text_column(docs).alias("text"), held_out(docs["doc_id"]).alias("apart"))
    base = base.filter(~F.col("apart") & F.col("lang").isNotNull()).drop("apart")
    ids = base.select("lang", "h").distinct()
    languages = base.select("lang").distinct().count()
    each = max(LEAST_PER_LANGUAGE, most // max(1, languages))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = ids.withColumn("rank", rank).filter(F.col("rank") <= each).groupBy("lang").agg(F.max("h").alias("last"))  # a row a language; texts aren't shuffled to meet it
    chosen = base.join(small(last), "lang").filter(F.col("h") <= F.col("last")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = sorted(chosen.mapInArrow(_profiled, "lang string, h bigint, buckets binary, weights binary").collect(), key=lambda r: (r.lang.encode(), r.h, r.buckets, r.weights))
    rows = [r for r in rows if len(r.buckets)]
    names = sorted({r.lang for r in rows}, key=str.encode)
    if not names:
        return [], None
    place = {x: k for k, x in enumerate(names)}
    found = [(np.frombuffer(r.buckets, np.uint16).astype(np.int64), np.frombuffer(r.weights, np.float16).astype(np.float64)) for r in rows]
    return names, Sample(found, np.array([place[r.lang] for r in rows]), np.array([r.h % 5 == 0 for r in rows]))


def identify(docs: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row of docs (doc_id, text, lang; others ignored).

    A null or empty text, or one without any letter, is UNKNOWN with score 0; so is every text if no row teaches a language. With one language, it is every
    other text's, with score 1. Rows with null lang teach nothing and are predicted; null ids count as not held out; of rows with one id
    and lang the least text teaches. lang, source and doc_id don't enter a prediction, so equal texts have equal ones. most: MOST_LABELLED.
    """
    languages, sample = labelled_sample(docs, most)
    model = docs.sparkSession.sparkContext.broadcast(Model(languages, sample) if sample else None)
    names = pa.array([*languages, UNKNOWN], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            which, score = np.full(n, len(names) - 1), np.zeros(n)
            known = batch.column("letters").to_numpy(zero_copy_only=False)
            for i, j, data, at in steps(batch.column("text")) if model.value else ():
                for k in range(i, j, ROWS):
                    end = min(k + ROWS, j)
                    here = at[k - i : end - i + 1]
                    which[k:end], score[k:end] = model.value.predict(profiles(data[here[0] : here[-1]], here - here[0]))
            which, score = np.where(known, which, len(names) - 1), np.where(known, score, 0.0)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": names.take(pa.array(which)), "score": score})

    text = text_column(docs)
    base = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), text.rlike("\\p{L}").alias("letters"), text.alias("text"))
    return base.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
