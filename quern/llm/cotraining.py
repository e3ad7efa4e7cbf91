"""Operator 3: a quality classifier by co-training two views of a document.

The text view sees what is written: shares of byte classes and of pairs of them, line and word shape, and how repetitive the
text is. The metadata view sees language, source and length only. Each view is a logistic regression. Both start from
labelled documents; in every round each view labels all unlabelled documents of which it is CERTAIN, and the other
view learns from them too. Labelled documents that were kept aside calibrate each view, and a last regression on the two calibrated
log-odds combines them. The result scores every document.

At most MOST_LABELLED labelled documents are used, those with the least hash of doc_id, and every unlabelled one: their features
are stored once, and each of Newton's steps sums gradients and Hessians over all of them on the cluster, so that only
matrices of the features' size reach the driver. The documents that carry a label from the other view together weigh at most TAUGHT_WEIGHT
times the labelled documents of that label, however many there are. A view teaches a label only while its certainty holds among the
labelled documents kept aside: one that knows no more than the share of good documents would otherwise spoil the other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import drop_stored, hashed_words, steps, stored, text_column

MOST_LABELLED = 4000
CERTAIN, TAUGHT_WEIGHT = 0.95, 0.5
#: Rounds of teaching at most (labels near the limit of certainty may come and go for ever), and steps of a fit at most; a fit ends once a step is below SETTLED, after about ten.
ROUNDS, NEWTON_STEPS, SETTLED = 8, 40, 1e-3
#: Tasks that add up the sums of the others before the driver does.
MERGES = 8
SOURCE_BUCKETS, LANG_BUCKETS, LENGTH_STEPS = 64, 16, 16
KEEP_FROM = 0.5

#: Byte classes of the text view: what a byte is, roughly.
_CLASS_OF = np.full(256, 11, np.uint8)
for _k, _chars in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"#*$%&|<>", b"'\"()[]{}-_/+=@~^`\\")):
    _CLASS_OF[list(_chars)] = _k
_CLASS_OF[128:] = 12
CLASSES = 13
TEXT_FEATURES = CLASSES + CLASSES * CLASSES + 6
META_FEATURES = LANG_BUCKETS + SOURCE_BUCKETS + LENGTH_STEPS


def text_view(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text features of each text of one step."""
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1)
    own = np.repeat(np.arange(n), np.diff(at))
    kind = _CLASS_OF[data].astype(np.int64)
    one = np.bincount(own * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / size[:, None]
    same = own[1:] == own[:-1]
    code = (own[1:] * CLASSES + kind[:-1]) * CLASSES + kind[1:]
    two = np.bincount(code[same], minlength=n * CLASSES * CLASSES).reshape(n, -1) / size[:, None]
    start, end, row, value = hashed_words(data, at)
    words = np.bincount(row, minlength=n)
    some = np.maximum(words, 1)
    length = np.bincount(row, weights=end - start, minlength=n) / some
    order = np.lexsort((value, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (value[order][1:] != value[order][:-1])
    distinct = np.bincount(row[order][new], minlength=n)
    lines = np.bincount(own[data == 10], minlength=n) + 1
    shape = np.stack([np.log1p(words), length / 10, distinct / some, np.log1p(words / lines), (words < 20).astype(float), (words == 0).astype(float)], 1)
    return np.concatenate([np.sqrt(one), np.sqrt(two), shape], 1)


def meta_view(lang: list[str | None], source: list[str | None], n_chars: np.ndarray) -> np.ndarray:
    """Hashed language and source, and steps of log length."""
    out = np.zeros((len(lang), META_FEATURES))
    each = np.arange(len(lang))
    out[each, [zlib.crc32(f"l{x}".encode()) % LANG_BUCKETS for x in lang]] = 1
    out[each, [LANG_BUCKETS + zlib.crc32(f"s{x}".encode()) % SOURCE_BUCKETS for x in source]] = 1
    out[each, LANG_BUCKETS + SOURCE_BUCKETS + np.minimum(np.log2(np.maximum(n_chars, 1)).astype(int), LENGTH_STEPS - 1)] = 1
    return out


class Logistic:
    """Logistic regression on standardised features by Newton's iterations with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, moments: tuple[np.ndarray, np.ndarray] | None = None):
        self.mean, self.spread = moments or spread_of(x.mean(0), x.std(0))
        self.z, self.y, self.ridge = self.standard(x), y, np.full(x.shape[1] + 1, ridge)
        self.ridge[-1] = 1e-6
        self.beta = np.zeros(x.shape[1] + 1)
        for _ in range(12):
            if self.step() < 1e-6:
                break

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x - self.mean) / self.spread, np.ones((len(x), 1))], 1)

    def step(self, taught: tuple[tuple[int, np.ndarray, np.ndarray], ...] = ()) -> float:
        """One of Newton's steps, and its size. taught: of each label the number, gradient and Hessian of the documents that the other view labelled."""
        _, gradient, hessian = derivatives(self.z, self.y, self.beta)
        for label, (n, g, h) in enumerate(taught):
            weight = min(TAUGHT_WEIGHT, TAUGHT_WEIGHT * float((self.y == label).sum()) / max(n, 1))
            gradient, hessian = gradient + weight * g, hessian + weight * h
        step = np.linalg.solve(hessian + np.diag(self.ridge), gradient + self.ridge * self.beta)
        self.beta = self.beta - np.clip(step, -5, 5)
        return float(np.abs(step).max())

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.spread) @ self.beta[:-1] + self.beta[-1], -30, 30)


def spread_of(mean: np.ndarray, deviation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mean, np.maximum(deviation, 1e-3)


def derivatives(z: np.ndarray, y: np.ndarray | float, beta: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, gradient and Hessian of the logistic loss over them."""
    q = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
    return len(z), z.T @ (q - y), (z * np.maximum(q * (1 - q), 1e-5)[:, None]).T @ z


def _summed(pool: DataFrame, kernel, size: int) -> np.ndarray:
    """The sum of kernel(text view, metadata view), an array of that size, over all batches of the pool of features."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += kernel(*_unpacked(batch))
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column("total"):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    rows = pool.select("text_view", "meta_view").mapInArrow(each, "total binary").repartition(MERGES).mapInArrow(merged, "total binary").collect()
    return np.sum([np.frombuffer(bytes(r.total)) for r in rows], 0) if rows else np.zeros(size)


def _taught(pool: DataFrame, fitted: list[Logistic], teachers: list[np.ndarray]) -> list[tuple]:
    """Of each view and label: the number, gradient and Hessian, at the view's own weights, of the unlabelled documents that the other view is certain of."""
    scales, betas = [(f.mean, f.spread) for f in fitted], [f.beta for f in fitted]

    def kernel(*views: np.ndarray) -> np.ndarray:
        z = [np.concatenate([(x - mean) / spread, np.ones((len(x), 1))], 1) for x, (mean, spread) in zip(views, scales, strict=True)]
        out = []
        for pupil, teacher in ((0, 1), (1, 0)):
            p = 1 / (1 + np.exp(-np.clip(z[teacher] @ teachers[teacher], -30, 30)))
            for label, sure in ((0, 1 - p >= CERTAIN), (1, p >= CERTAIN)):
                n, g, h = derivatives(z[pupil][sure], float(label), betas[pupil])
                out += [np.array([n], float), g, h.ravel()]
        return np.concatenate(out)

    widths = [len(b) for b in betas]
    flat, at, out = _summed(pool, kernel, sum(2 * (1 + w + w * w) for w in widths)), 0, []
    for w in widths:
        labels = []
        for _ in range(2):
            labels.append((int(round(flat[at])), flat[at + 1 : at + 1 + w], flat[at + 1 + w : at + 1 + w + w * w].reshape(w, w)))
            at += 1 + w + w * w
        out.append(tuple(labels))
    return out


def _trusted(teacher: Logistic, x: np.ndarray, y: np.ndarray) -> list[bool]:
    """Of each label: whether a share of at least CERTAIN of the documents x that the view is certain of has it, with at most half the errors of giving it to all."""
    p = 1 / (1 + np.exp(-teacher.log_odds(x)))
    return [bool(sure.any() and (y[sure] != label).mean() <= min(1 - CERTAIN, (y != label).mean() / 2)) for label, sure in ((0, 1 - p >= CERTAIN), (1, p >= CERTAIN))]


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: DataFrame):
    """Two fitted views, their calibrations and the combination. views: features of labelled rows; pool: packed features of all unlabelled ones."""
    aside = np.arange(len(y)) % 4 == 0 if min(y.sum(), len(y) - y.sum()) >= 8 else np.zeros(len(y), bool)
    learn, tell = ~aside, aside if aside.any() else ~aside
    sums = _summed(pool, lambda *v: np.concatenate([[len(v[0])], *[x.sum(0) for x in v], *[(x * x).sum(0) for x in v]]), 1 + 2 * (TEXT_FEATURES + META_FEATURES))
    ones, squares = np.split(sums[1:], 2)
    n, moments, at = sums[0] + learn.sum(), [], 0
    for v in views:
        w = v.shape[1]
        mean, square = (ones[at : at + w] + v[learn].sum(0)) / n, (squares[at : at + w] + (v[learn] ** 2).sum(0)) / n
        moments.append(spread_of(mean, np.sqrt(np.maximum(square - mean * mean, 0))))
        at += w
    fitted = [Logistic(v[learn], y[learn], moments=m) for v, m in zip(views, moments, strict=True)]
    for _ in range(ROUNDS if sums[0] else 0):
        teachers = [f.beta for f in fitted]
        trusted = [_trusted(f, v[tell], y[tell]) for f, v in zip(fitted, views, strict=True)][::-1]  # by pupil
        if not any(map(any, trusted)):
            break
        for f in fitted:
            f.beta = np.zeros_like(f.beta)  # from saturated weights, Newton's steps would overshoot
        for _ in range(NEWTON_STEPS):
            taught = [tuple((k, g, h) if ok else (0, 0 * g, 0 * h) for ok, (k, g, h) in zip(may, own, strict=True)) for may, own in zip(trusted, _taught(pool, fitted, teachers), strict=True)]
            if max([f.step(t) for f, t in zip(fitted, taught, strict=True)]) < SETTLED:
                break
        if not any(k for t in taught for k, _, _ in t) or max(np.abs(f.beta - t).max() for f, t in zip(fitted, teachers, strict=True)) < 1e-2:
            break
    calibrated = [Logistic(f.log_odds(v[tell])[:, None], y[tell], ridge=0.1) for f, v in zip(fitted, views, strict=True)]
    odds = np.stack([c.log_odds(f.log_odds(v[tell])[:, None]) for c, f, v in zip(calibrated, fitted, views, strict=True)], 1)
    joint = Logistic(odds, y[tell], ridge=0.1)
    for model in (*fitted, *calibrated, joint):
        model.z = model.y = None  # not needed to predict
    return fitted, calibrated, joint


def predict(model, views: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Probabilities of good quality: of the text view, of the metadata view, and combined."""
    fitted, calibrated, joint = model
    odds = [c.log_odds(f.log_odds(v)[:, None]) for c, f, v in zip(calibrated, fitted, views, strict=True)]
    return [1 / (1 + np.exp(-x)) for x in (*odds, joint.log_odds(np.stack(odds, 1)))]


def _views(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
    for i, j, data, at in steps(batch.column("text")):
        chars = np.bincount(np.repeat(np.arange(j - i), np.diff(at)), weights=(data & 0xC0) != 0x80, minlength=j - i)
        yield text_view(data, at), meta_view(lang[i:j], source[i:j], chars)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and the two views of every row, as bytes: single precision, and the places of the metadata view's ones."""
    for batch in batches:
        at = 0
        for text, meta in _views(batch):
            n = len(text)
            places = np.nonzero(meta)[1].astype(np.uint8).reshape(n, -1)
            own = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (text.astype(np.float32), places)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), *own], ["doc_id", "text_view", "meta_view"])
            at += n


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    text, places = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(n, -1) for c, kind in (("text_view", np.float32), ("meta_view", np.uint8)))
    meta = np.zeros((n, META_FEATURES))
    np.put_along_axis(meta, places.astype(np.int64), 1, 1)
    return text.astype(float), meta


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_score, meta_score, score (each 0 to 1) and kept (score >= 0.5) of every row of docs.

    docs: doc_id, text, and lang and source if there are any; labels: doc_id, quality (0 or 1). Other columns are ignored. Null and empty
    texts are scored like any other, null lang or source is a value of its own. Without labels of both classes every score is the
    labelled share of good documents (0.5 without labels). Repeated rows each have their scores.
    """
    own = {c: docs[c].cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")}
    base = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_column(docs).alias("text"), own["lang"].alias("lang"), own["source"].alias("source"))
    marks = labels.filter(labels["quality"].isNotNull() & labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("bigint").alias("id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    picked = marks.orderBy(F.xxhash64("id"), "id").limit(MOST_LABELLED).collect()
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r.id, r.quality) for r in picked], "id bigint, quality int")
    once = base.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source")).alias("x")).select("doc_id", "x.*")
    schema = "doc_id bigint, text_view binary, meta_view binary"
    known = once.mapInArrow(_packed, schema).collect()  # features, not texts: MOST_LABELLED rows of less than 1 kB
    known.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    marked = dict(picked)
    y = np.array([marked[r.doc_id] for r in known], float)
    model, share = None, float(y.mean()) if len(y) else 0.5
    if 0 < y.sum() < len(y):
        features = base.mapInArrow(_packed, schema)
        pool = stored(features.join(marks, F.col("doc_id") == F.col("id"), "left_anti").select("text_view", "meta_view"), "features")
        model = co_train(_unpacked(pa.RecordBatch.from_pydict({k: [bytes(r[k]) for r in known] for k in ("text_view", "meta_view")})), y, pool)
        drop_stored(pool)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [predict(sent.value, v) if sent.value else [np.full(len(v[0]), share)] * 3 for v in _views(batch)]
            text, meta, both = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.float64()) for x in (text, meta, both)], pa.array(both >= KEEP_FROM)], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return base.mapInArrow(run, "doc_id bigint, text_score double, meta_score double, score double, kept boolean")
