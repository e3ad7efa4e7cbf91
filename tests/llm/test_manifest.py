"""The Merkle manifest against plain Python, and the laws of its monoid."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from quern.llm import merkle
from quern.llm.merkle import Forest, folded, manifest, read_path

from .conftest import documents, edge_rows, prose


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(row) -> str:
    doc_id, text, lang, source, n_chars = row
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree_of(leaves: list[str]) -> tuple[str, list[list[str]]]:
    """The root, and for each leaf its siblings, level by level."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i // 8 * 8
            proofs[k] += [(nodes[first:i], nodes[i + 1 : first + 8])]
        at = [i // 8 for i in at]
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows) -> list[tuple]:
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {n: tree_of([x[2] for x in sorted(trees[n], key=lambda x: x[:3])]) for n in names}
    root, tops = tree_of([made[n][0] for n in names])
    out = []
    for n, top in zip(names, tops, strict=True):
        for (_, _, leaf, row), path in zip(sorted(trees[n], key=lambda x: x[:3]), made[n][1], strict=True):
            path = path + top
            now = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                now = leaf_of((row[0], lowered(row[1]), *row[2:]))
            for before, after in path:
                now = h("".join([*before, now, *after]))
            out.append((row[0], leaf, made[n][0], root, h("".join("".join(b + a) for b, a in path)), now, now == root))
    return sorted(out, key=repr)


def with_lengths(rows):
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_manifest_on_edge_rows(edge, no_documents):
    want = plain(with_lengths(edge_rows()))
    assert got(manifest(edge)) == want
    assert manifest(no_documents).collect() == []


@pytest.mark.parametrize("n", [1, 65, 700])
def test_manifest_of_trees_of_many_sizes(spark, n):
    """One large and several small trees; with one level a round there are several rounds up and down."""
    rows = [(i, prose(i, 4).title() if i % 5 else None, "en", "a") for i in range(n)]
    rows += [(10_000 + i, f"Text {i}", f"l{i % 11}", None) for i in range(40)]
    random.Random(n).shuffle(rows)
    want = plain(with_lengths(rows))
    assert got(manifest(documents(spark, rows).repartition(5), 4 if n == 65 else 1)) == want
    assert {x[6] for x in want} == {True, False}


def test_trees_of_more_than_one_round(spark):
    rows = [(i, f"T{i}", "en", "a") for i in range(5000)]
    assert got(manifest(documents(spark, rows))) == plain(with_lengths(rows))


@pytest.mark.parametrize("width", [1, 7, 8, 9, 63, 65, 520])
def test_forests_merge_in_any_order(width):
    """Associative, commutative and idempotent: any split and order of the leaves gives the root of the plain tree."""
    height = next(k for k in range(21) if 8**k >= width)
    leaves = [h(str(i)) for i in range(width)]
    want, _ = tree_of(leaves)
    for seed in range(4):
        r = random.Random(seed)
        nodes = [("t", width, height, 0, i, bytes.fromhex(x)) for i, x in enumerate(leaves)]
        r.shuffle(nodes)
        parts = [Forest() for _ in range(5)]
        for x in nodes:
            r.choice(parts).add(*x)
        while len(parts) > 1:
            a, b = parts.pop(r.randrange(len(parts))), parts.pop(r.randrange(len(parts)))
            parts.append(a.merge(b).merge(Forest()))
        assert [(x[3], x[4], x[5].hex()) for x in parts[0].nodes()] == [(height, 0, want)]


def test_a_sorted_run_leaves_few_nodes_open():
    forest = Forest()
    for i in range(1000, 90_000):
        forest.add("t", 100_000, 6, 0, i, sha256(str(i).encode()).digest())
    assert forest.size <= 2 * 7 * 7


def test_paths_are_read_back():
    run = {i: sha256(str(i).encode()).digest() for i in range(8, 13)}
    path = read_path(merkle._entry(run, 10))
    assert folded(run[10].hex(), path) == h("".join(run[i].hex() for i in sorted(run)))
