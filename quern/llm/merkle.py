"""Operator 11: a Merkle manifest of a dataset, with a proof for every row.

Each document is a leaf, the hash of its fields. The leaves of one language, in order of doc_id, are a tree of arity ARITY; the
trees' roots, in order of language, are the leaves of one more tree, whose root names the dataset.

A leaf's index within its tree comes from dealing the leaves by ranges and adding up the ranges' sizes. From there on the work is a
monoid: a ``Forest`` holds nodes keyed by tree, level and index whose sibling run isn't whole yet. As the tree's width is known, so
is the number of siblings of every run, the last one's too; whenever a run completes it becomes its parent's one node. Merging
is the union followed by these completions, so it is associative and commutative, and any split of the leaves gives one result. Each task
folds its leaves into a forest and hands on what is left; ``tree_reduce`` merges these fragments in rounds, each of which
completes LEVELS levels, by the common ancestor, so that no task holds more than ARITY ** LEVELS nodes and nothing of a tree
passes through the driver but its height. On the way back down, each node's siblings become its path to the root, and the leaves of
one ancestor meet the ancestor's path and prove themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import drop_stored, stored

ARITY = 8
_BITS = 3  # of an index within its run
#: Levels that one round of merging completes; a group of a round has at most ARITY ** LEVELS nodes.
LEVELS = 4
#: Nodes that a task keeps before it hands them on; it only reaches them where its leaves aren't next to each other.
MOST_OPEN = 1 << 16

NODE = "tree string, width bigint, height int, level int, index bigint, digest binary"
RESULT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


class Forest:
    """Nodes of trees whose sibling runs aren't whole, and a merge that completes what it can. Nodes rise to level ``upto`` at most."""

    def __init__(self, upto: int = 64):
        self.upto, self.open, self.size = upto, {}, 0

    def add(self, tree: str, width: int, height: int, level: int, index: int, digest: bytes) -> Forest:
        """One more node; a run that it completes becomes the parent, and so on upwards. A node that is there already changes nothing."""
        while True:
            run = self.open.setdefault((tree, level, index >> _BITS), (width, height, {}))[2]
            self.size += index not in run
            run[index] = digest
            if level >= min(self.upto, height) or len(run) < siblings(width, level, index):
                return self
            del self.open[tree, level, index >> _BITS]
            self.size -= len(run)
            digest = sha256("".join(run[i].hex() for i in sorted(run)).encode()).digest()
            level, index = level + 1, index >> _BITS

    def merge(self, other: Forest) -> Forest:
        for row in other.nodes():
            self.add(*row)
        return self

    def nodes(self) -> Iterator[tuple]:
        for (tree, level, _), (width, height, run) in self.open.items():
            for index, digest in run.items():
                yield tree, width, height, level, index, digest


def siblings(width: int, level: int, index: int) -> int:
    """The number of nodes in the run of a node, itself included, in a tree of ``width`` leaves."""
    at_level = (width + (1 << _BITS * level) - 1) >> _BITS * level
    return min(ARITY, at_level - (index >> _BITS << _BITS))


_TYPES = pa.schema([("tree", pa.string()), ("width", pa.int64()), ("height", pa.int32()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema = _TYPES) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _rows(batch: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in _TYPES.names), strict=True)


def _folded(batches: Iterator[pa.RecordBatch], rise: int) -> Iterator[pa.RecordBatch]:
    """A task's leaves as the nodes that its forest leaves open."""
    forest = Forest(rise)
    for batch in batches:
        for row in _rows(batch):
            forest.add(*row)
        if forest.size > MOST_OPEN:
            yield from _table(list(forest.nodes())).to_batches()
            forest = Forest(rise)
    yield from _table(list(forest.nodes())).to_batches()


# A path is one entry a level, from below: the node's place in its run, the number of its siblings, and their digests.


def _entry(run: dict[int, bytes], index: int) -> bytes:
    others = [run[i] for i in sorted(run) if i != index]
    return bytes([sum(i < index for i in run), len(others)]) + b"".join(others)


def read_path(path: bytes) -> list[tuple[str, str]]:
    """For each level the hex digests of the siblings before and after the node."""
    out, at = [], 0
    while at < len(path):
        before, n = path[at], path[at + 1]
        start, middle, end = at + 2, at + 2 + 32 * before, at + 2 + 32 * n
        out.append((path[start:middle].hex(), path[middle:end].hex()))
        at = end
    return out


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a node of this digest gives along a path."""
    for before, after in path:
        digest = sha256((before + digest + after).encode()).hexdigest()
    return digest


def _levels(nodes: list[tuple], upto: int) -> list[dict[int, bytes]]:
    """All nodes of one ancestor, level by level, from its nodes of one level up to level ``upto``, that of the ancestor."""
    _, width, _, level, _, _ = nodes[0]
    out = [{row[4]: row[5] for row in nodes}]
    while level < upto:
        runs: dict[int, list[bytes]] = {}
        for index in sorted(out[-1]):
            runs.setdefault(index >> _BITS, []).append(out[-1][index])
        out.append({run: sha256("".join(d.hex() for d in digests).encode()).digest() for run, digests in runs.items()})
        level += 1
    return out


def _path_within(levels: list[dict[int, bytes]], index: int) -> bytes:
    out = b""
    for nodes in levels[:-1]:
        first = index >> _BITS << _BITS
        out += _entry({i: nodes[i] for i in range(first, first + ARITY) if i in nodes}, index)
        index >>= _BITS
    return out


def _completed(table: pa.Table, rise: int) -> pa.Table:
    """The nodes of one ancestor, from several fragments, merged: the ancestor."""
    forest = Forest(rise)
    for row in _rows(table):
        forest.add(*row)
    return _table(list(forest.nodes()))


_CLIMBED = _TYPES.append(pa.field("path", pa.binary()))


def _climbed(table: pa.Table, rise: int) -> pa.Table:
    """The nodes of one ancestor, all of one level: the ancestor, and for each node its path to the ancestor."""
    nodes = list(_rows(table))
    tree, width, height, level, index, _ = nodes[0]
    upto = min(height, level + rise)
    levels = _levels(nodes, upto)
    top = [(tree, width, height, upto, index >> _BITS * (upto - level), next(iter(levels[-1].values())), None)]
    return _table(top + [(*row, _path_within(levels, row[4])) for row in nodes], _CLIMBED)


def _height(width: Column) -> Column:
    """Levels above the leaves: how many powers of ARITY, from 1 on, are below the width."""
    return sum((F.when(width > (1 << _BITS * k), 1).otherwise(0) for k in range(1, 21)), F.when(width > 1, 1).otherwise(0))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with index (the place within its tree, by ``order``), and the width and height of the tree.

    Rows are dealt by ranges and numbered where they lie; a small table of the ranges' sizes does the rest. Rows that are equal in
    all of ``order`` follow in any order.
    """
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "salt").sortWithinPartitions("tree", *order, "salt").drop("salt")
    numbered = stored(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "numbered")
    in_tree = Window.partitionBy("tree")
    spans = numbered.groupBy("tree", "part").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    upto = F.sum("n").over(in_tree.orderBy("part"))
    spans = spans.select("tree", "part", (upto - F.col("n") - F.col("least")).alias("shift"), F.sum("n").over(in_tree).alias("width"))
    spans = stored(spans.withColumn("height", _height(F.col("width")).cast("int")), "spans")
    placed = numbered.join(spans, ["tree", "part"]).withColumn("index", F.col("at") + F.col("shift")).drop("part", "at", "shift")
    placed._tables = (numbered, spans)
    return placed


def tree_reduce(leaves: DataFrame, rise: int = LEVELS) -> tuple[DataFrame, list[DataFrame]]:
    """leaves (tree, width, height, index, digest) to (roots, rounds): one row a tree, and what each round made.

    The first round's table has every node of level ``rise`` (or the root of a lower tree); the k-th has the nodes of level k * rise with a
    null path, and those of the level below with their paths to them.
    """
    nodes = leaves.withColumn("level", F.lit(0)).select(*_TYPES.names)
    fragments = stored(nodes.mapInArrow(partial(_folded, rise=rise), NODE), "fragments")
    whole = F.col("level") >= F.least(F.col("height"), F.lit(rise))
    ancestor = lambda k: F.expr(f"shiftright(index, CAST({_BITS} * ({k} - level) AS INT))")
    merged = fragments.filter(~whole).groupBy("tree", ancestor(f"least(height, {rise})").alias("ancestor")).applyInArrow(lambda key, t: _completed(t, rise), NODE)
    rounds = [stored(fragments.filter(whole).unionByName(merged).withColumn("path", F.lit(None).cast("binary")), "round")]
    tallest = rounds[0].agg(F.max("height")).first()[0] or 0
    for k in range(2, -(-tallest // rise) + 1):
        below = rounds[-1].filter(F.col("path").isNull() & (F.col("height") > F.col("level"))).drop("path")
        rounds.append(stored(below.groupBy("tree", ancestor(f"least(height, {k * rise})").alias("ancestor")).applyInArrow(lambda key, t: _climbed(t, rise), NODE + ", path binary"), "round"))
    drop_stored(fragments)
    roots = rounds[0].filter("false")
    for x in rounds:
        roots = roots.unionByName(x.filter("path is null and level = height"))
    return roots.select("tree", "digest"), rounds


def descend(rounds: list[DataFrame], tops: DataFrame, rise: int = LEVELS) -> DataFrame:
    """The nodes of the first round (tree, ancestor: their index) with their paths to the top. tops: each tree's path from its root on, and further columns."""
    more = [c for c in tops.columns if c not in ("tree", "path")]
    out = None
    for k in range(len(rounds) - 1, -1, -1):
        ends = rounds[k].filter("path is null and level = height").select("tree", "index").join(tops, "tree")
        if k + 1 < len(rounds):
            above = out.select("tree", F.col("index").alias("up"), F.col("path").alias("rest"), *more)
            steps = rounds[k + 1].filter("path is not null").withColumn("up", F.expr(f"shiftright(index, {_BITS} * (least(height, {(k + 2) * rise}) - level))"))
            ends = ends.unionByName(steps.join(above, ["tree", "up"]).select("tree", "index", F.concat("path", "rest").alias("path"), *more))
        out = ends
    return out.withColumnRenamed("index", "ancestor")


def _by_ancestor(leaves: DataFrame, rise: int) -> GroupedData:
    return leaves.withColumn("level", F.lit(0)).groupBy("tree", F.expr(f"shiftright(index, {_BITS} * least(height, {rise}))").alias("ancestor"))


_TOP = pa.schema([("tree", pa.string()), ("subroot", pa.binary()), ("path", pa.binary()), ("root", pa.binary())])


def _top_paths(leaves: pa.Table, above: pa.Table, rise: int) -> pa.Table:
    """The leaves of one ancestor with their paths to the root. Here a leaf is the root of the tree it is named by."""
    if not leaves.num_rows:
        return _table([], _TOP)
    names, nodes = leaves["name"].to_pylist(), list(_rows(leaves))
    levels, rest, root = _levels(nodes, min(nodes[0][2], rise)), above["path"][0].as_py(), above["root"][0].as_py()
    return _table([(name, row[5], _path_within(levels, row[4]) + rest, root) for name, row in zip(names, nodes, strict=True)], _TOP)


_OUT = pa.schema([("doc_id", pa.int64()), *((k, pa.string()) for k in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def _proofs(leaves: pa.Table, above: pa.Table, rise: int) -> pa.Table:
    """The leaves of one ancestor, proved: the root that each gives, or its tampered leaf, with its siblings."""
    if not leaves.num_rows:
        return _table([], _OUT)
    nodes = list(_rows(leaves))
    levels = _levels(nodes, min(nodes[0][2], rise))
    hexes = [{i: d.hex() for i, d in x.items()} for x in levels]
    rest, subroot, root = read_path(above["path"][0].as_py()), above["subroot"][0].as_py().hex(), above["root"][0].as_py().hex()
    rest_text = "".join(a + b for a, b in rest).encode()
    folds: dict[str, str] = {}  # from the ancestor on, the root depends on the ancestor's digest alone
    out = []
    for doc_id, bad, row in zip(leaves["doc_id"].to_pylist(), leaves["tampered"].to_pylist(), nodes, strict=True):
        index, path = row[4], []
        for x in hexes[:-1]:
            first = index >> _BITS << _BITS
            path.append(("".join(x[i] for i in range(first, index)), "".join(x[i] for i in range(index + 1, first + ARITY) if i in x)))
            index >>= _BITS
        leaf = row[5].hex()
        mine = folded(leaf if bad is None else bad.hex(), path)
        if mine not in folds:
            folds[mine] = folded(mine, rest)
        proof = sha256("".join(a + b for a, b in path).encode())
        proof.update(rest_text)
        out.append((doc_id, leaf, subroot, root, proof.hexdigest(), folds[mine], folds[mine] == root))
    return _table(out, _OUT)


def _field(c: Column) -> Column:
    """A field in a leaf: `-` if null, else its bytes in UTF-8, a colon and itself."""
    value = c.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, tree, digest and tampered: the leaf of every row, and that of its tampered text where the row is one to tamper with."""
    doc_id, text = docs["doc_id"].cast("bigint"), docs["text"].cast("string")
    leaf = lambda t: F.unhex(F.sha2(F.concat(_field(doc_id), _field(docs["source"]), _field(docs["lang"]), _field(docs["n_chars"]), _field(t)), 256))
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(doc_id.cast("string")) % 3 == 0
    tree = F.coalesce(F.concat(F.lit("v"), docs["lang"].cast("string")), F.lit("n"))  # no null, in the order of languages, null first
    return docs.select(doc_id.alias("doc_id"), tree.alias("tree"), leaf(text).alias("digest"), F.when(chosen, leaf(lower)).alias("tampered"))


def manifest(docs: DataFrame, rise: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs (doc_id, source, lang, n_chars, text; others ignored).

    rise: the levels that a round of merging completes.

    Null fields have a mark of their own, so they differ from empty ones; a null lang is a tree of its own, before all others;
    null doc_ids come first in their tree and are never tampered with. Rows with one doc_id follow each other by their leaf; equal rows have equal
    leaves, and each has a place and a proof of its own. A text of any length is hashed whole. Of no rows there are no proofs.
    """
    hashed = stored(leaves_of(docs), "leaves")  # texts are read and hashed once
    leaves = ranked(hashed, ["doc_id", "digest"])
    roots, rounds = tree_reduce(leaves, rise)
    roots = stored(roots, "roots")
    names = ranked(roots.select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    root, top_rounds = tree_reduce(names, rise)
    top = root.select("tree", F.unhex(F.lit("")).alias("path"), F.col("digest").alias("root"))
    above = descend(top_rounds, top, rise)
    tops = stored(_by_ancestor(names, rise).cogroup(above.groupBy("tree", "ancestor")).applyInArrow(lambda a, b: _top_paths(a, b, rise), "tree string, subroot binary, path binary, root binary"), "tops")
    paths = stored(descend(rounds, tops, rise), "paths")
    drop_stored(hashed, roots, *names._tables, *rounds, *top_rounds)
    return _by_ancestor(leaves, rise).cogroup(paths.groupBy("tree", "ancestor")).applyInArrow(lambda a, b: _proofs(a, b, rise), RESULT)
