"""Operator 4: near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds its distinct five-word shingles (its whole word sequence if shorter). The sketch has T coordinates.
Round i hashes every shingle to a coordinate and a value; a coordinate keeps the least (round, value) placed in it. The first
T rounds choose coordinates by hash, the next T rounds go to one coordinate each, so every coordinate is filled whatever the
set's size, and rounds stop as soon as all are. Two sketches agree in a coordinate with the sets' Jaccard similarity as
probability, and the mean over coordinates is at least as concentrated as that of T independent ones.

Candidates are the pairs that share one of BANDS bands of ROWS coordinates: a pair at similarity 0.75 shares none with probability
(1 - 0.75**4)**32 = 5e-6. Documents with equal sets are one class first. Every bucket has a pivot, its least class, and every
class is compared with the pivots of its buckets on the full sets; what is kept of such a star pair is the size of the
intersection and the shingles that only one of the two has. The classes around one pivot hold every bucket of that pivot, so
it is enough to compare them with each other, and two of them have

    |X and Y| = |X and P| + |Y and P| - |P| + |(X without or only P) and (Y without or only P)|

so their exact similarity follows from those differences. That is done for the classes whose component is not the pivot's,
against all others around the pivot, in pairs of blocks of bounded bytes that spread over tasks. Nowhere does a pair that
isn't a star pair or a confirmed link become a row. No bucket is capped and no pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import drop_stored, hashed_words, mix, steps, stored, text_column
from quern.llm.components import components

SHINGLE = 5
SIMILARITY_PERCENT = 75
BANDS, ROWS = 32, 4
#: Coordinates of a sketch, all of which the bands use.
T = BANDS * ROWS
#: Classes that one task compares with a pivot before it reads the pivot again.
CHUNK_CLASSES = 256
#: A block holds so many classes, and so many bytes of differences, on average.
BLOCK_CLASSES, BLOCK_BYTES = 512, 1 << 20
#: Columns of the products that count the common differences of two blocks.
PRODUCT_COLUMNS = 4096
#: Pairs of lists that are numbered at a time.
PAIRS_AT_ONCE = 1 << 20
#: Rows of an Arrow batch: a batch is held in the JVM and in Python at once.
BATCH_ROWS = 1000

_SEED = np.random.default_rng(7).integers(1, 1 << 63, 2 * T, dtype=np.uint64)
_MULTIPLIER = np.random.default_rng(11).integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    for i, j, data, at in steps(column):
        _, _, row, word = hashed_words(data, at)
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        with np.errstate(over="ignore"):
            if len(word) >= SHINGLE:
                whole = mix(sum(word[k : len(word) - SHINGLE + 1 + k] * _MULTIPLIER[k] for k in range(SHINGLE)))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a >= SHINGLE:
                    yield np.unique(whole[a : b - SHINGLE + 1])
                elif b > a:
                    yield mix(np.array([sum(int(x) * int(m) for x, m in zip(word[a:b], _MULTIPLIER, strict=False)) + int(b - a) * int(_MULTIPLIER[-1]) & 0xFFFFFFFFFFFFFFFF], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)


def sketch(items: np.ndarray) -> np.ndarray:
    """T coordinates of a non-empty set of 64-bit hashes, each (round << 56 | hash >> 8) of the item that fills it."""
    out = np.full(T, _EMPTY)
    # About so many rounds fill all coordinates; which rounds are taken at once changes no coordinate.
    i, each = 0, min(2 * T, 1 + int(1.2 * T * np.log(T)) // len(items))
    while i < 2 * T:
        rounds = np.arange(i, min(2 * T, i + each), dtype=np.uint64)
        value = mix(items[None, :] ^ _SEED[rounds][:, None])
        place = np.where(rounds[:, None] < T, value % np.uint64(T), rounds[:, None] - np.uint64(T))
        np.minimum.at(out, place.ravel(), ((rounds[:, None] << np.uint64(56)) | (value >> np.uint64(8))).ravel())
        i += each
        if not (out == _EMPTY).any():
            break
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        n, keys, bands, lengths = [], [], [], []
        for items in shingle_sets(batch.column("text")):
            n.append(len(items))
            lengths.append(BANDS if len(items) else 0)
            keys.append(None)
            if len(items):
                with np.errstate(over="ignore"):
                    rows = mix(sketch(items)).reshape(BANDS, ROWS)
                    bands.append(mix((rows * _MULTIPLIER[:ROWS]).sum(1, dtype=np.uint64) ^ salt))
                    one, two = mix(items ^ _SEED[0]).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(items ^ _SEED[1]))
                keys[-1] = int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")
        flat = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("own"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "own", "n_shingles", "set_key", "bands"])


def sketches(base: DataFrame) -> DataFrame:
    """doc_id, own, n_shingles, set_key (equal for equal sets) and bands of every row of base (doc_id, own, text)."""
    return base.mapInArrow(_sketched, "doc_id bigint, own bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def similar(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of sizes a and b with so many common items reach the similarity."""
    return 100 * common >= SIMILARITY_PERCENT * (a + b - common)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class and pivot, whose rows come sorted with the pivot's before: sizes, common shingles, link, and the shingles of one alone."""
    pivot: np.ndarray = np.zeros(0, np.uint64)
    for batch in batches:
        out: list[tuple] = []
        p, kind, row = (batch.column(k).to_pylist() for k in ("p", "kind", "row"))
        for k, items in enumerate(shingle_sets(batch.column("text"))):
            if kind[k] == 0:
                pivot = items
                continue
            apart = np.setxor1d(pivot, items, assume_unique=True)
            common = (len(pivot) + len(items) - len(apart)) // 2
            out.append((p[k], row[k], len(items), len(pivot), common, bool(similar(common, len(items), len(pivot))), apart.tobytes()))
        columns = zip(*out, strict=True) if out else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["p", "row", "n", "n_p", "common", "linked", "apart"])


def _stars(base: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Every class with every pivot of its buckets: p, row, n, n_p, common, linked and apart. None if no bucket has two classes."""
    banded = classes.select("row", F.explode("bands").alias("key"))
    pivots = banded.groupBy("key").agg(F.min("row").alias("p"), F.max("row").alias("last")).filter("p < last").select("key", "p")
    pairs = stored(banded.join(pivots, "key").filter("row <> p").select("p", "row").distinct(), "pairs")
    parts = pairs.groupBy("p").agg(F.ceil(F.count("*") / CHUNK_CLASSES).alias("parts"))
    around = pairs.join(parts, "p").select("p", F.pmod(F.xxhash64("row"), "parts").alias("part"), F.lit(1).alias("kind"), "row")
    middle = parts.select("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("p").alias("row"))
    wanted = around.union(middle).join(classes.select("row", "doc_id", "own"), "row")
    met = wanted.join(base, ["doc_id", "own"]).select("p", "part", "kind", "row", "text")
    dealt = met.repartition("p", "part").sortWithinPartitions("p", "part", "kind", "row")
    out = stored(dealt.mapInArrow(_compared, "p bigint, row bigint, n bigint, n_p bigint, common bigint, linked boolean, apart binary"), "stars")
    drop_stored(pairs)
    if out.isEmpty():
        drop_stored(out)
        return None
    return out


def common_items(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """[i, j]: how many items the lists x[i] and y[j] have in common. x, y: (offsets, items); no list repeats an item.

    Items that many lists of both sides have are counted by products of 0-1 matrices, the others by numbering their pairs of lists.
    """
    shared = np.intersect1d(x[1], y[1])
    shape = len(x[0]) - 1, len(y[0]) - 1
    out = np.zeros(shape, np.int64)
    sides = []
    for at, values in (x, y):
        place = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        hit = np.flatnonzero(shared[place] == values) if len(shared) else np.zeros(0, np.int64)
        place, owner = place[hit], np.searchsorted(at, hit, "right") - 1
        order = np.argsort(place, kind="stable")
        sides.append((place[order], owner[order], np.bincount(place, minlength=len(shared))))
    (place, owner, times), (place2, owner2, times2) = sides
    many = times * times2 > out.size // 64
    column = np.cumsum(many) - 1
    n = int(many.sum())
    for low in range(0, n, PRODUCT_COLUMNS):
        high = min(low + PRODUCT_COLUMNS, n)
        factors = []
        for (at, own, _), rows in zip(sides, shape, strict=True):
            here = many[at] & (column[at] >= low) & (column[at] < high)
            f = np.zeros((rows, high - low), np.float32)
            f[own[here], column[at[here]] - low] = 1
            factors.append(f)
        out += (factors[0] @ factors[1].T).astype(np.int64)  # below 2**24, so exact
    few = np.flatnonzero(~many[place])
    first = np.concatenate([[0], np.cumsum(times2)])
    ends = np.cumsum(times2[place[few]])
    done = 0
    while done < len(few):
        before = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, before + PAIRS_AT_ONCE, "right")))
        at, own = place[few[done:upto]], owner[few[done:upto]]
        n = times2[at]
        theirs = owner2[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[at], n)]
        out += np.bincount(np.repeat(own, n) * shape[1] + theirs, minlength=out.size).reshape(shape)
        done = upto
    return out


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the classes of two blocks around one pivot: of those that join the same components, one."""
    for batch in batches:
        u, v = [], []
        for k in range(batch.num_rows):
            same, n_p = batch.column("same")[k].as_py(), batch.column("n_p")[k].as_py()
            side = []
            for name in ("x", "y"):
                block = batch.column(name)[k].values
                row, n, common, c = (block.field(f).to_numpy(zero_copy_only=False) for f in ("row", "n", "common", "c"))
                apart = block.field("apart").to_pylist()
                at = np.concatenate([[0], np.cumsum([len(z) // 8 for z in apart])])
                side.append((row, n, common, c, (at, np.frombuffer(b"".join(apart), np.uint64))))
            (row, n, common, c, apart), (row2, n2, common2, c2, apart2) = side
            both = common[:, None] + common2[None, :] - n_p + common_items(apart, apart2)
            linked = similar(both, n[:, None], n2[None, :]) & (c[:, None] != c2[None, :])
            if same:
                linked &= row[:, None] < row2[None, :]
            top: dict[int, int] = {}
            for i, j in zip(*np.nonzero(linked), strict=True):
                a, b = int(c[i]), int(c2[j])
                while (z := top.get(a, a)) != a:
                    a = z
                while (z := top.get(b, b)) != b:
                    b = z
                if a != b:
                    top[max(a, b)] = min(a, b)
                    u.append(row[i])
                    v.append(row2[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(z, np.int64)) for z in (u, v)], ["u", "v"])


def _between(stars: DataFrame, label: DataFrame | None) -> DataFrame:
    """Links (u, v) between classes around the same pivot that lie in different components."""
    named = stars.select("p", "row", F.octet_length("apart").alias("size"))
    if label is None:
        named = named.withColumns({"c": F.col("row"), "c_p": F.col("p")})
    else:
        own, pivots = (label.select(F.col("node").alias(k), F.col("component").alias(f"_{k}")) for k in ("row", "p"))
        named = named.join(own, "row", "left").join(pivots, "p", "left").select("p", "row", "size", F.coalesce("_row", "row").alias("c"), F.coalesce("_p", "p").alias("c_p"))
    named = named.select("p", "row", "size", "c", (F.col("c") != F.col("c_p")).alias("other"))

    def blocks(side: F.Column) -> F.Column:
        count, size = F.count(F.when(side, 1)), F.sum(F.when(side, F.col("size")))
        return F.greatest(F.ceil(count / BLOCK_CLASSES), F.ceil(F.coalesce(size, F.lit(0)) / BLOCK_BYTES))

    # Blocks up to k hold what lies in other components than the pivot, the blocks after it the rest.
    groups = named.groupBy("p").agg(blocks(F.col("other")).alias("k"), blocks(~F.col("other")).alias("m"), F.count("*").alias("members")).filter("k > 0 AND members > 1").drop("members")
    hashed = F.xxhash64("row")
    place = F.when(F.col("other"), F.pmod(hashed, "k")).otherwise(F.col("k") + F.pmod(hashed, F.greatest("m", F.lit(1))))
    placed = named.join(groups, "p").select("p", "row", "c", "k", (F.col("k") + F.col("m")).alias("all"), place.alias("block"))
    whole = placed.join(stars.select("p", "row", "n", "n_p", "common", "apart"), ["p", "row"])
    packed = stored(whole.groupBy("p", "n_p", "k", "all", "block").agg(F.collect_list(F.struct("row", "n", "common", "c", "apart")).alias("x")), "blocks")
    left = packed.filter("block < k").select("p", "n_p", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("all") - 1)).alias("j"), "x")
    right = packed.select("p", F.col("block").alias("j"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("block", F.col("k") - 1))).alias("i"), F.col("x").alias("y"))
    met = left.join(right, ["p", "i", "j"]).select("n_p", (F.col("i") == F.col("j")).alias("same"), "x", "y")
    links = stored(met.mapInArrow(_matched, "u bigint, v bigint"), "links")
    drop_stored(packed)
    return links


def _class_components(classes: DataFrame, base: DataFrame) -> DataFrame | None:
    """(node, component) of the classes that have links, None if there is none."""
    stars = _stars(base, classes)
    if stars is None:
        return None
    near = stars.filter("linked").select(F.col("row").alias("u"), F.col("p").alias("v"))
    label = stored(components(near), "labels")
    links = _between(stars, label)
    # Nodes that the first labels lack have none; a first label is a link of its own.
    again = stored(components(links.union(label.select(F.col("node").alias("u"), F.col("component").alias("v")))), "labels")
    drop_stored(stars, label, links)
    return again


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows for the stages that run within; the session's setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, own (the text's xxhash64), n_shingles, component_id and leads of every row of docs.

    component_id is the least doc_id reachable over links, itself included. leads says whether the row has the least (doc_id, own)
    of its component, so that of different texts exactly one in a component leads; rows without words or doc_id lead themselves.
    """
    with _short_batches(docs.sparkSession):  # every Python stage is run to its end in here
        base = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(text_column(docs)).alias("own"), text_column(docs).alias("text"))
        found = stored(sketches(base).withColumn("row", F.monotonically_increasing_id()), "sketches")
        filled = found.filter("set_key is not null and doc_id is not null")
        if not filled.groupBy("doc_id", "own").count().filter("count > 1").isEmpty():  # repeated rows have one text
            base = base.groupBy("doc_id", "own").agg(F.min("text").alias("text"))
        least = filled.groupBy("set_key").agg(F.min("row").alias("row"), F.min(F.struct("doc_id", "own")).alias("lead"))
        # The wide column is fetched by the least row, not carried through the aggregation.
        classes = stored(filled.select("row", "doc_id", "own", "bands").join(least.select("row", "set_key", "lead"), "row"), "classes")
        label = _class_components(classes, base)
    own = classes.select("set_key", "row", "lead")
    if label is not None:
        met = own.join(label.withColumnRenamed("node", "row"), "row").select("set_key", "component", "lead")
        leads = met.groupBy("component").agg(F.min("lead").alias("least"))
        better = met.join(leads, "component").select("set_key", "least")
        own = own.join(better, "set_key", "left").select("set_key", F.coalesce("least", "lead").alias("lead"))
    out = found.select("doc_id", "own", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(own.select("set_key", "lead"), "set_key", "left")
    lead = F.coalesce("lead", F.struct("doc_id", "own"))
    return out.select("doc_id", "own", "n_shingles", lead["doc_id"].alias("component_id"), F.coalesce((F.col("doc_id") == lead["doc_id"]) & (F.col("own") == lead["own"]), F.lit(True)).alias("leads"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links, itself included) and kept (doc_id = component_id).

    docs: doc_id, text, any other columns (ignored). One row per input row. Null or empty texts, and texts without a word, have
    n_shingles 0 and are linked with nothing, as are rows without doc_id (component_id null, kept true). Rows that
    repeat a doc_id with the same text are one document; with different texts each text has its own links, and each row the
    component of its own text.
    """
    return near_groups(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
