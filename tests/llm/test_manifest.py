"""The Merkle manifest against a plain tree, and its traversal's memory."""

import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from quantloom.llm import manifest
from quantloom.llm.common import fold


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each node its path: what stands before and after it at each level."""
    paths, of = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(of):
            a = i // 8 * 8
            paths[k].append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 8])))
        of = [i // 8 for i in of]
        nodes = [h("".join(nodes[a : a + 8])) for a in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    rows = sorted(rows, key=lambda r: (r["lang"] is not None, (r["lang"] or "").encode(), r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
    groups = [list(g) for _, g in itertools.groupby(rows, lambda r: r["lang"])]
    trees = [tree([plain_leaf(r, r["text"]) for r in g]) for g in groups]
    root, over = tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), above in zip(groups, trees, over, strict=True):
        for r, path in zip(g, paths, strict=True):
            whole, text = path + above, r["text"]
            if text is not None and zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = plain_leaf(r, text)
            for before, after in whole:
                node = h(before + node + after)
            out.append((r["doc_id"], plain_leaf(r, r["text"]), subroot, root, h("".join(b + a for b, a in whole)), node, node == root))
    return out


def rows_of(sizes):
    rows, n = [], itertools.count()
    for lang, size in sizes.items():
        for _ in range(size):
            i = next(n)
            rows.append({"doc_id": i * 7919 % 10_007 if i % 50 else None, "source": None if i % 7 == 0 else f"s{i % 3}", "lang": lang, "n_chars": i if i % 5 else None, "text": None if i % 11 == 0 else "" if i % 13 == 0 else f"Text {i} É🙂", "leaf": "x", "pos": 1, "tree": 2.0})
    return rows + rows[:9] + rows[:3]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int, tree double"


def result(spark, rows, parts, shape=manifest.SHAPE):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = manifest.manifest(docs, fold("doc_id", 3) == 0, F.translate("text", manifest.UPPER, manifest.LOWER), shape)
    return [tuple(r) for r in got.collect()]


SIZES = {None: 3, "": 1, "de": 8, "en": 9, "fr": 65, "zh": 700, "é": 64}


@pytest.mark.parametrize("shape", [manifest.SHAPE, manifest.Shape(2, 1), manifest.Shape(1, 1)])
def test_manifest_equals_a_plain_tree(spark, shape):
    """Blocks of fewer levels make several tiers of blocks."""
    rows = rows_of(SIZES)
    assert sorted(result(spark, rows, 5, shape), key=str) == sorted(brute(rows), key=str)


def test_one_row_and_none(spark):
    rows = [rows_of({"en": 2})[1]]
    assert result(spark, rows, 1) == brute(rows)
    assert result(spark, [], 1) == []


def test_many_languages_make_a_tree_of_several_levels(spark):
    rows = rows_of({f"l{i}": 1 + i % 3 for i in range(80)})
    assert sorted(result(spark, rows, 3), key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("total", [1, 7, 8, 9, 64, 65, 511, 513, 4096])
def test_traversal(total):
    nodes = [h(str(i)) for i in range(total)]
    root, roots = manifest.reduced(nodes, total)
    want, paths = tree(nodes)
    assert root == want
    assert [low + high for _, low, high in manifest.traversal(iter(nodes), total, roots)] == paths


def test_a_walk_reads_one_subtree_ahead():
    """So the lower layer holds an existing and a desired subtree at most."""
    nodes = [h(str(i)) for i in range(4096)]
    _, roots = manifest.reduced(nodes, 4096)
    read = 0

    def stream():
        nonlocal read
        for read, node in enumerate(nodes, 1):  # noqa: B007
            yield node

    ahead = max(read - k for k, _ in enumerate(manifest.traversal(stream(), 4096, roots), 1))
    assert ahead <= manifest.SHAPE.run


def test_changed_nodes_are_noticed():
    nodes = [h(str(i)) for i in range(70)]
    _, roots = manifest.reduced(nodes, 70)
    with pytest.raises(ValueError):
        list(manifest.traversal(iter([*nodes[:69], h("other")]), 70, roots))
