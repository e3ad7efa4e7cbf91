"""Operator 6: documents scored by masked pseudo-likelihood under a bidirectional window network trained in numpy.

Tokens are lower-cased runs of letters and digits. Each token is hidden in turn and predicted from the SIDE tokens on either
side; a document's score is the sum of the log-probabilities. The network has a vector for each of the TOP most frequent words, and
BUCKETS for the others by hash, in each place around the hidden token; one hidden layer gives the odds of the token's class, and the odds of
the word within it. Words of like frequency form a class of CLASS_WORDS (so a softmax needs no more than that many words at a time);
the words outside the TOP form classes by length. There a word's own count decides, less a discount of one that goes to the
spelling: a byte-bigram model over all tokens, normalised for each length, which alone speaks for words seen once.

The first pass counts words and byte pairs, summed by key over the cluster. Training takes ROUNDS rounds that each go through a part
of the documents: shards that depend on doc_id and text alone train from the same start, and their parameters are averaged by tokens,
so that every token is learnt from once and the model doesn't depend on how rows are dealt. The last pass scores. It has the counts of the
KNOWN most frequent words at hand, and stores the other words of each text, which are then joined with the stored counts of all words
by shuffling. So only KNOWN words and counts, 257 * 257 byte-pair counts, two sums a length class and the averaged parameters go to the
driver; the counts, which grow with the corpus, stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import PUNCTUATED, hashed_words, mix, steps, stored, text_column

TOP, CLASS_WORDS, BUCKETS = 2048, 64, 512
#: Words whose counts are sent to every task (16 bytes each). Which these are changes the time only.
KNOWN = 1 << 16
SIDE = 2
COMMON_CLASSES, LENGTH_CLASSES, HIDDEN = TOP // CLASS_WORDS, 12, 16
CLASSES = COMMON_CLASSES + LENGTH_CLASSES
#: Stands where the text has no token.
NOTHING = TOP + BUCKETS
BATCH, ROUNDS, RATES = 4096, 4, (0.03, 0.015, 0.008, 0.004)
#: Tokens of a shard, unless there would be more than MOST_SHARDS; each shard's parameters are sent once a round in CHUNKS pieces.
SHARD_TOKENS, MOST_SHARDS, CHUNKS = 1 << 20, 4096, 16
_STEP = 1 << 18
_LOWERED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.int64)


def _letters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes plus one, 0 where a word ends: blanks, punctuation, and a 0 after each row."""
    kept = np.where(PUNCTUATED[data], 0, _LOWERED[data] + 1)
    return np.insert(kept, at[1:], 0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words (kind: the length, at most LENGTH_CLASSES) and of the neighbouring byte pairs (kind 0) of each batch."""
    for batch in batches:
        for _, _, data, at in steps(batch.column("text"), 1 << 22):
            start, end, _, value = hashed_words(data, at, blanks=PUNCTUATED)
            key, first, n = np.unique(value, return_index=True, return_counts=True)
            length = np.minimum((end - start)[first], LENGTH_CLASSES)
            x = np.concatenate([[0], _letters(data, at)])
            pair = np.bincount(x[:-1] * 257 + x[1:], minlength=257 * 257)
            pair[0] = 0  # between words nothing is spelt
            used = np.flatnonzero(pair)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([length, np.zeros(len(used), np.int64)]), pa.int32()), pa.array(np.concatenate([key.view(np.int64), used])), pa.array(np.concatenate([n, pair[used]]), pa.int64())], ["kind", "key", "n"])


@dataclass
class Lexicon:
    """Sorted hashes of the most frequent words with their ranks and counts, the spelling model, and where the network starts: at plain counts."""

    keys: np.ndarray
    rank: np.ndarray
    seen: np.ndarray
    spell: np.ndarray
    length_mass: np.ndarray
    class_odds: np.ndarray
    word_odds: np.ndarray


def build_lexicon(known: list[tuple[int, int]], pairs: dict[int, int], others: np.ndarray, top: int = TOP) -> Lexicon:
    """known: (word hash, count) in falling order of counts, the first top of which go into classes by frequency; pairs: byte-pair counts; others: tokens outside the top of each length class."""
    keys, seen = np.array([k for k, _ in known], np.int64).view(np.uint64), np.array([c for _, c in known], float)
    n = np.zeros(TOP)
    n[: min(top, len(known))] = seen[:top]
    table = np.zeros(257 * 257)
    for k, c in pairs.items():
        table[k] = c
    table = table.reshape(257, 257) + 0.01
    table[0, 0] = 0  # a word has a letter
    chance = table / table.sum(1, keepdims=True)
    reach, lengths = chance[0, 1:].copy(), []
    for _ in range(LENGTH_CLASSES - 1):
        lengths.append(float(reach @ chance[1:, 0]))
        reach = reach @ chance[1:, 1:]
    lengths.append(max(1e-12, 1 - sum(lengths)))
    with np.errstate(divide="ignore"):
        spell = np.log(chance)
    spell[0, 0] = 0.0  # stands between words, where nothing is spelt
    order = np.argsort(keys, kind="stable")
    n = n.reshape(COMMON_CLASSES, CLASS_WORDS)
    classes = np.concatenate([n.sum(1), others]) + 0.5
    return Lexicon(keys[order], np.where(order < top, order, TOP), seen[order], spell.ravel(), np.log(np.array(lengths)), np.log(classes / classes.sum()), np.log((n + 1e-6) / (n + 1e-6).sum(1, keepdims=True)))


@dataclass
class Tokens:
    """Of every token: its row, its class, its place in a class of words (0 in one by length), its number as a neighbour, its hash, the log-probability of its spelling, and its count (0 if it isn't known)."""

    row: np.ndarray
    group: np.ndarray
    place: np.ndarray
    number: np.ndarray
    value: np.ndarray
    spelt: np.ndarray
    seen: np.ndarray


def tokens(lexicon: Lexicon, data: np.ndarray, at: np.ndarray) -> Tokens:
    start, end, row, value = hashed_words(data, at, blanks=PUNCTUATED)
    length = np.minimum(end - start, LENGTH_CLASSES) - 1
    group, place, number = COMMON_CLASSES + length, np.zeros(len(value), np.int64), TOP + (value % np.uint64(BUCKETS)).astype(np.int64)
    x = _letters(data, at)
    spelt = np.concatenate([[0.0], np.cumsum(lexicon.spell[np.concatenate([[0], x[:-1]]) * 257 + x])]) if len(x) else np.zeros(1)
    # Each earlier row adds one place, and a word's end is spelt at the place after it.
    inside = spelt[end + row + 1] - spelt[start + row] - lexicon.length_mass[length]
    seen = np.zeros(len(value))
    if len(lexicon.keys) and len(value):
        found = np.minimum(np.searchsorted(lexicon.keys, value), len(lexicon.keys) - 1)
        found = np.where(lexicon.keys[found] == value, found, -1)
        seen = np.where(found >= 0, lexicon.seen[found], 0)
        hit = np.flatnonzero((found >= 0) & (lexicon.rank[found] < TOP))
        rank = lexicon.rank[found[hit]]
        number[hit], group[hit], place[hit] = rank, rank // CLASS_WORDS, rank % CLASS_WORDS
    return Tokens(row, group, place, number, value, inside, seen)


def rare_words(t: Tokens) -> tuple[np.ndarray, ...]:
    """(row, hash, length, log-probability of the spelling, times) of the different words of each row whose counts aren't known."""
    rare = np.flatnonzero(t.seen == 0)
    rare = rare[np.argsort(t.value[rare] ^ mix(t.row[rare].astype(np.uint64)))]
    new = np.ones(len(rare), bool)
    new[1:] = (t.row[rare][1:] != t.row[rare][:-1]) | (t.value[rare][1:] != t.value[rare][:-1])
    first = np.flatnonzero(new)
    one = rare[first]
    return t.row[one], t.value[one], t.group[one] - COMMON_CLASSES + 1, t.spelt[one], np.diff(np.append(first, len(rare)))


def known_words(t: Tokens, others: np.ndarray, different: np.ndarray) -> np.ndarray:
    """Of each token the log-probability within its class by length, from its count and spelling; 0 in a class of words, and where the count isn't known."""
    out, at = np.zeros(len(t.group)), np.flatnonzero((t.group >= COMMON_CLASSES) & (t.seen > 0))
    length = t.group[at] - COMMON_CLASSES
    out[at] = np.log((t.seen[at] - 1 + np.maximum(different, 1)[length] * np.exp(t.spelt[at])) / np.maximum(others, 1)[length])
    return out


def contexts(t: Tokens) -> np.ndarray:
    """[position, token]: the numbers of the tokens SIDE before to SIDE after, NOTHING where the text has none."""
    out = np.full((2 * SIDE, len(t.number)), NOTHING, np.int16)
    for k, shift in enumerate((*range(-SIDE, 0), *range(1, SIDE + 1))):
        a, b = (slice(-shift, None), slice(None, shift)) if shift < 0 else (slice(None, -shift), slice(shift, None))
        out[k][a] = np.where(t.row[a] == t.row[b], t.number[b], NOTHING)
    return out


def _chances(o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of log-odds, in place, what is in proportion to the probabilities of each row, and the rows' sums. One shift for all rows keeps exp in range."""
    o -= o.max()
    np.exp(o, out=o)
    return o, o @ np.ones(o.shape[1], o.dtype) + np.float32(1e-37)


def _log_chance(o: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Of each row of log-odds, the log-probability of one column."""
    own = o[row, column] - o.max()
    return own.astype(float) - np.log(_chances(o)[1])


class WindowNetwork:
    """Probabilities of classes and of words within them from the words around: a table for each place, one hidden layer, two softmaxes."""

    def __init__(self, lexicon: Lexicon, flat: np.ndarray | None = None):
        rng = np.random.default_rng(3)
        shapes = {"e": (2 * SIDE, NOTHING + 1, HIDDEN), "b": (HIDDEN,), "w": (HIDDEN, CLASSES), "c": (CLASSES,), "o": (COMMON_CLASSES, CLASS_WORDS, HIDDEN), "d": (COMMON_CLASSES, CLASS_WORDS)}
        start = {"e": lambda s: rng.standard_normal(s) * 0.3, "c": lambda s: lexicon.class_odds, "d": lambda s: lexicon.word_odds}
        self.p, at = {}, 0
        for k, s in shapes.items():
            n = int(np.prod(s))
            self.p[k] = (start.get(k, np.zeros)(s) if flat is None else flat[at : at + n].reshape(s)).astype(np.float32)
            at += n
        self.moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        self.turn = 0

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.p["e"][0][around[0]]
        for k in range(1, 2 * SIDE):
            h += self.p["e"][k][around[k]]
        h += self.p["b"]
        return np.tanh(h, out=h)

    def log_probability(self, around: np.ndarray, group: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each token its class's, plus the word's within it where that is a class of words."""
        out, p = np.zeros(len(group)), self.p
        for first in range(0, len(group), 4 * BATCH):
            order = first + np.argsort(group[first : first + 4 * BATCH].astype(np.uint8), kind="stable")  # classes then are slices
            h, g, w, each = self._hidden(around[:, order]), group[order], place[order], np.arange(len(order))
            found = _log_chance(h @ p["w"] + p["c"], each, g)
            bounds = np.searchsorted(g, np.arange(COMMON_CLASSES + 1)).tolist()
            for c, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if a < b:
                    found[a:b] += _log_chance(h[a:b] @ p["o"][c].T + p["d"][c], each[: b - a], w[a:b])
            out[order] = found
        return out

    def gradients(self, around: np.ndarray, group: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability."""
        p, n = self.p, len(group)
        order = np.argsort(group.astype(np.uint8), kind="stable")  # classes then are slices
        around, group, place = around[:, order], group[order], place[order]
        h = self._hidden(around)
        d, total = _chances(h @ p["w"] + p["c"])
        d /= total[:, None]
        d[np.arange(n), group] -= 1
        dh = d @ p["w"].T
        g = {"e": np.zeros_like(p["e"]), "w": h.T @ d, "c": d.sum(0), "o": np.zeros_like(p["o"]), "d": np.zeros_like(p["d"])}
        bounds = np.searchsorted(group, np.arange(COMMON_CLASSES + 1)).tolist()
        each = np.arange(n)
        for c, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if a < b:
                own = h[a:b]
                d, total = _chances(own @ p["o"][c].T + p["d"][c])
                d /= total[:, None]
                d[each[: b - a], place[a:b]] -= 1
                g["o"][c], g["d"][c] = d.T @ own, d.sum(0)
                dh[a:b] += d @ p["o"][c]
        dh *= 1 - h * h
        g["b"] = dh.sum(0)
        for k, x in enumerate(around):
            order = np.argsort(x, kind="stable")
            sorted_ = x[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            g["e"][k][sorted_[first]] = np.add.reduceat(dh[order], first, 0)
        for v in g.values():
            v /= n
        return g

    def learn(self, around: np.ndarray, group: np.ndarray, place: np.ndarray, rate: float) -> None:
        """One step of Adam."""
        self.turn += 1
        pace = rate * np.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn)
        for k, v in self.gradients(around, group, place).items():
            m, s = self.moments[k]
            m *= 0.9
            m += 0.1 * v
            v *= v
            v *= 0.001
            s *= 0.999
            s += v
            np.sqrt(s, out=v)
            v += 1e-8
            np.divide(m, v, out=v)
            v *= pace
            self.p[k] -= v


@dataclass
class Model:
    """A lexicon, the network's parameters (None without a token), the stored counts of words, and of the words outside the TOP the tokens and different words of each length class."""

    lexicon: Lexicon
    weights: np.ndarray | None
    counts: DataFrame
    others: np.ndarray
    different: np.ndarray


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_column(docs).alias("text"))


def _average(parts: DataFrame) -> np.ndarray | None:
    """The parameters of all shards, averaged by tokens; added up in the order of the shards. parts: shard, chunk, seen, value."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for chunk, seen, value in zip(*(batch.column(k).to_pylist() for k in ("chunk", "seen", "value")), strict=True):
                n, total = sums.get(chunk, (0, 0.0))
                sums[chunk] = n + seen, total + seen * np.frombuffer(value, np.float32).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(t / n).astype(np.float32).tobytes() for n, t in sums.values()], pa.binary())], ["chunk", "value"])

    rows = parts.repartition(CHUNKS, "chunk").sortWithinPartitions("chunk", "shard").mapInArrow(added, "chunk int, value binary").collect()
    return np.concatenate([np.frombuffer(bytes(r.value), np.float32) for r in sorted(rows, key=lambda r: r.chunk)]) if rows else None


def fit(docs: DataFrame, top: int = TOP, known: int = KNOWN) -> Model:
    """The model of all texts of docs, with at most top (up to TOP) words in classes by frequency and the counts of about known words at hand."""
    spark, base = docs.sparkSession, _base(docs)
    counts = stored(base.select("text").mapInArrow(_counted, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")), "words")
    known = counts.filter("kind > 0").orderBy(F.desc("n"), "key").limit(max(top, known)).collect()
    pairs = {r.key: r.n for r in counts.filter("kind = 0").collect()}  # 257 * 257 at most
    others, different, total = np.zeros(LENGTH_CLASSES), np.zeros(LENGTH_CLASSES), 0
    for r in counts.filter("kind > 0").groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        others[r.kind - 1], different[r.kind - 1] = r.n, r.words
        total += r.n
    for r in known[:top]:
        others[r.kind - 1] -= r.n
        different[r.kind - 1] -= 1
    lexicon = build_lexicon([(r.key, r.n) for r in known], pairs, others, top)
    sent, weights = spark.sparkContext.broadcast(lexicon), None
    shards = int(min(MOST_SHARDS, max(1, -(-total // (ROUNDS * SHARD_TOKENS)))))
    mark = F.xxhash64("doc_id", "text")
    marked = base.withColumns({"mark": mark, "shard": F.pmod(mark, F.lit(shards)), "turn": F.pmod(F.shiftright(mark, 32), F.lit(ROUNDS))})
    for turn in range(ROUNDS if total else 0):
        start = spark.sparkContext.broadcast(weights)

        def trained(batches: Iterator[pa.RecordBatch], start=start, rate=RATES[turn]) -> Iterator[pa.RecordBatch]:
            shard, net, seen, held = None, None, 0, []

            def learn(all_: bool) -> None:
                nonlocal held, seen
                around, group, place = (np.concatenate(x, -1) for x in zip(*held, strict=True))
                end = len(group) if all_ else len(group) // BATCH * BATCH
                for a in range(0, end, BATCH):
                    part = slice(a, min(a + BATCH, end))
                    net.learn(around[:, part], group[part], place[part], rate)
                seen += end
                held = [(around[:, end:], group[end:], place[end:])]

            def told() -> Iterator[pa.RecordBatch]:
                if held:
                    learn(True)
                if seen:
                    pieces = np.array_split(net.flat(), CHUNKS)
                    columns = [shard] * CHUNKS, range(CHUNKS), [seen] * CHUNKS, [x.tobytes() for x in pieces]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["shard", "chunk", "seen", "value"])

            for batch in batches:
                own = batch.column("shard").to_numpy()
                bounds = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
                for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                    if j == i:
                        continue
                    if own[i] != shard:  # rows come sorted by shard
                        yield from told()
                        shard, net, seen, held = int(own[i]), WindowNetwork(sent.value, start.value), 0, []
                    for _, _, data, at in steps(batch.column("text").slice(i, j - i), _STEP):
                        t = tokens(sent.value, data, at)
                        held.append((contexts(t), t.group, t.place))
                        if sum(len(x[1]) for x in held) >= BATCH:
                            learn(False)
            yield from told()

        dealt = marked.filter(F.col("turn") == turn).repartition(shards, "shard").sortWithinPartitions("shard", "mark").select("shard", "text")
        after = _average(dealt.mapInArrow(trained, "shard bigint, chunk int, seen bigint, value binary"))
        weights = weights if after is None else after
    return Model(lexicon, weights, counts, others, different)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """What ``lm_scores`` gives, under a fitted model. Words that the model has not seen are scored by their spelling."""
    base, spark = _base(docs), docs.sparkSession
    sent = spark.sparkContext.broadcast((model.lexicon, model.weights, model.others, model.different))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights, others, different = sent.value
        net, names = WindowNetwork(lexicon, weights), ["row", "doc_id", "n", "total", "key", "kind", "spelt", "times"]
        kinds, after = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.float64(), pa.int64()], TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j, data, at in steps(batch.column("text"), _STEP):
                t = tokens(lexicon, data, at)
                total = net.log_probability(contexts(t), t.group, t.place) + known_words(t, others, different)
                own = [np.arange(after, after + j - i), batch.column("doc_id").slice(i, j - i), np.bincount(t.row, minlength=j - i), np.bincount(t.row, weights=total, minlength=j - i)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(own, kinds, strict=False)] + [pa.nulls(j - i, k) for k in kinds[4:]], names)
                at_row, *rare = rare_words(t)
                rare[0] = rare[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at_row + after, pa.int64()), *[pa.nulls(len(at_row), k) for k in kinds[1:4]], *[pa.array(x, k) for x, k in zip(rare, kinds[4:], strict=True)]], names)
                after += j - i

    parts = stored(base.mapInArrow(scored, "row bigint, doc_id bigint, n bigint, total double, key bigint, kind int, spelt double, times bigint"), "scores")
    again = model.counts.filter("kind > 0 and n > 1").select(F.col("key").alias("word"), F.col("n").alias("seen"))
    words = parts.filter("key is not null").join(again.hint("merge"), F.col("key") == F.col("word"), "left")
    tokens_of, words_of = (F.element_at(F.array(*[F.lit(float(max(v, 1))) for v in x]), F.col("kind")) for x in (model.others, model.different))
    inside = F.when(F.col("seen").isNull(), F.log(words_of / tokens_of) + F.col("spelt")).otherwise(F.log((F.col("seen") - 1 + words_of * F.exp("spelt")) / tokens_of))
    texts = parts.filter("key is null").select("row", "doc_id", "n", "total")
    nothing = F.lit(None).cast("bigint")
    all_parts = texts.union(words.select("row", nothing, nothing, F.col("times") * inside))
    # A text of no rare words has one part; the sums of the others are those of their words.
    return all_parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n_tokens"), F.sum("total").alias("log_likelihood")).select(
        "doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood")
    )


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum over tokens) and mean_log_likelihood of every row of docs.

    docs: doc_id, text, others ignored. A text without tokens, null ones included, has 0 tokens, sum 0 and a null mean. Repeated rows
    and null ids have their own rows. An empty table gives no rows. Scores are the same however rows are dealt, but for
    rounding.
    """
    return scores(docs, fit(docs))
