"""A Merkle manifest of a dataset, with a proof for every row.

Each row is a leaf. The leaves of a language form a tree of runs of eight, the roots of these trees
another one. Leaves are sorted by range partitions and numbered by the partitions' counts, and cut
into aligned blocks of 8^4. A pass upwards hashes every block to its root, and keeps the roots of
its subtrees of two levels; block roots are cut into blocks in their turn. A pass downwards walks
each block from left to right, in the way of fractal traversal: for each of two stacked layers it
holds the existing subtree around the current leaf, for the lower layer also the desired one, which
grows by one leaf a step and takes the other's place when that is used up. So a block's walk holds a
few hundred digests. The path above a block is the same for all of its leaves; it is computed once,
from the blocks above, and appended.

Defined cases: a null id sorts first; rows of one id are ordered by their leaves, so equal rows have
the proofs of neighbours; a null language is a tree of its own, before all others; an empty text
differs from a null one; an empty table gives an empty result; other columns aren't read. The id of a
row without one counts as '' where tampered rows are chosen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fold, written

RUN = 8  # nodes under a node
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODES = "tree string, pos long, hash string, total long, below long, runs array<string>"
PATHS = "tree string, pos long, below long, runs array<string>, subroot string, before array<string>, after array<string>"

PATH_COLUMNS = [x.split()[0] for x in PATHS.split(", ")]

@dataclass(frozen=True)
class Shape:
    """Of blocks: their levels, and how many of them the lower layer has."""

    levels: int = 4
    layer: int = 2

    @property
    def block(self) -> int:
        return RUN**self.levels

    @property
    def run(self) -> int:
        """Nodes under a subtree of the lower layer."""
        return RUN**self.layer


SHAPE = Shape()


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Subtree:
    """Levels above consecutive nodes, filled from the left, one node a step."""

    def __init__(self, height: int):
        self.height = height
        self.levels: list[list[str]] = [[] for _ in range(height + 1)]

    def push(self, node: str, level: int = 0) -> None:
        row = self.levels[level]
        row.append(node)
        if level < self.height and len(row) % RUN == 0:
            self.push(digest("".join(row[-RUN:])), level + 1)

    def close(self) -> str:
        """The root, after runs that are not full are hashed as they are."""
        for level in range(self.height):
            rest = len(self.levels[level]) % RUN
            if rest:
                self.push(digest("".join(self.levels[level][-rest:])), level + 1)
        (root,) = self.levels[self.height]
        return root

    def path(self, i: int) -> Iterator[tuple[str, str]]:
        """For each level, what stands before and after the i-th node's ancestor in its run."""
        for row in self.levels[: self.height]:
            at = i % RUN
            run = row[i - at : i - at + RUN]
            yield "".join(run[:at]), "".join(run[at + 1 :])
            i //= RUN


def heights(total: int, shape: Shape = SHAPE) -> tuple[int, int]:
    """Levels of the lower and the upper layer of a block of a tree of ``total`` nodes: a small tree ends where one node remains."""
    levels, n = 0, total
    while n > 1 and levels < shape.levels:
        n = -(-n // RUN)
        levels += 1
    return min(levels, shape.layer), max(0, levels - shape.layer)


def reduced(nodes: list[str], total: int, shape: Shape = SHAPE) -> tuple[str, list[str]]:
    """The root of a block, and the roots of the lower layer's subtrees."""
    low, high = heights(total, shape)
    top, roots = Subtree(high), []
    for a in range(0, len(nodes), shape.run):
        subtree = Subtree(low)
        for node in nodes[a : a + shape.run]:
            subtree.push(node)
        roots.append(subtree.close())
        top.push(roots[-1])
    return top.close(), roots


def traversal(nodes: Iterator[str], total: int, roots: list[str], shape: Shape = SHAPE) -> Iterator[tuple[int, list[tuple[str, str]], list[tuple[str, str]]]]:
    """For each node of a block its number among its subtree's, and its path: the lower layer's part and the upper one's.

    ``roots`` are those of the block's lower subtrees, left from the pass upwards.
    """
    low, high = heights(total, shape)
    top = Subtree(high)
    for root in roots:
        top.push(root)
    top.close()

    def authenticated(subtree: Subtree, nth: int) -> Iterator[tuple]:
        if subtree.close() != roots[nth]:
            raise ValueError("a block's nodes differ from those that were hashed before")
        over = list(top.path(nth))
        for i in range(len(subtree.levels[0])):
            yield i, list(subtree.path(i)), over

    existing: Iterator[tuple] = iter(())
    desired, nth = Subtree(low), 0
    for node in nodes:
        if len(desired.levels[0]) == shape.run:  # as many steps ago the existing subtree began, so it is used up
            existing, desired, nth = authenticated(desired, nth), Subtree(low), nth + 1
        yield from islice(existing, 1)
        desired.push(node)
    yield from existing
    yield from authenticated(desired, nth)


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with pos, their place in their tree's order, and total, the tree's rows."""
    spark = rows.sparkSession
    placed = written(rows.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(tree, *order, "own").sortWithinPartitions(tree, *order, "own").drop("own").withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "placed")
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(tree, "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))  # a row for each partition and tree
    starts = starts.select(F.col(tree).alias("t"), F.col("part").alias("p"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy(tree)).alias("total"))
    again = spark.read.schema(placed.schema).parquet(placed.written_to)
    return again.join(starts, (F.col(tree) == F.col("t")) & (F.col("part") == F.col("p"))).withColumn("pos", F.col("place") + F.col("shift")).drop("t", "p", "part", "place", "shift")


def block_of(shape: Shape) -> Column:
    return F.expr(f"pos div {shape.block}").alias("block")


def climbed(leaves: DataFrame, shape: Shape = SHAPE) -> list[DataFrame]:
    """Tables of NODES: ``total`` nodes of the table in a tree, ``below`` of the one before, and roots of subtrees. Each has a row for a block of the one before; the last has one row for each tree.

    ``leaves``: tree, pos, hash, total.
    """

    def up(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        total = int(nodes["total"].iloc[0])
        root, roots = reduced(list(nodes["hash"]), total, shape)
        return pd.DataFrame({"tree": nodes["tree"].iloc[:1], "pos": int(nodes["pos"].iloc[0]) // shape.block, "hash": root, "total": -(-total // shape.block), "below": total, "runs": [roots]})

    out, nodes = [], leaves
    while not out or (out[-1].agg(F.max("total")).first()[0] or 1) > 1:
        out.append(written(nodes.select("tree", "pos", "hash", "total").groupBy("tree", block_of(shape)).applyInPandas(up, NODES), "nodes"))
        nodes = out[-1]
    return out


def above(paths: DataFrame) -> DataFrame:
    """``paths`` under other names of their keys, grouped by them."""
    return paths.select(F.col("tree").alias("of_tree"), F.col("pos").alias("of_pos"), *[c for c in PATH_COLUMNS if c not in ("tree", "pos")]).groupBy("of_tree", "of_pos")


def descended(tiers: list[DataFrame], tops: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """The path of each block of leaves (PATHS), from ``tops``: tree, subroot, before, after."""

    def down(nodes: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        nodes, over = nodes.sort_values("pos"), over.iloc[0]
        walk = [low + high for _, low, high in traversal(iter(nodes["hash"]), int(over["below"]), list(over["runs"]), shape)]
        out = nodes[["tree", "pos", "below", "runs"]].assign(subroot=over["subroot"])
        out["before"] = [[b for b, _ in p] + list(over["before"]) for p in walk]
        out["after"] = [[a for _, a in p] + list(over["after"]) for p in walk]
        return out

    paths = tiers[-1].join(tops, "tree").select(*PATH_COLUMNS)
    for nodes in reversed(tiers[:-1]):
        paths = nodes.groupBy("tree", block_of(shape)).cogroup(above(paths)).applyInPandas(down, PATHS)
    return paths


def proofs(leaves: DataFrame, paths: DataFrame, kernel: Callable[..., tuple], extra: list[str], schema: str, shape: Shape = SHAPE) -> DataFrame:
    """What ``kernel`` makes of each leaf's row and its path: the fields of ``schema``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def walk(nodes: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        nodes, over = nodes.sort_values("pos"), over.iloc[0]
        upper = list(zip(over["before"], over["after"], strict=True))
        rows, cached = [], {}
        steps = traversal(iter(nodes["hash"]), int(over["below"]), list(over["runs"]), shape)
        for row, (i, low, high) in zip(nodes[extra].itertuples(index=False), steps, strict=True):
            if i == 0:  # another subtree: what lies above is another
                cached = {"above": high + upper, "joined": "".join([b + a for b, a in high + upper])}
            rows.append(kernel(row, low, cached, over["subroot"]))
        return pd.DataFrame(rows, columns=names)

    return leaves.select("tree", "pos", "hash", *[c for c in extra if c != "hash"]).groupBy("tree", block_of(shape)).cogroup(above(paths)).applyInPandas(walk, schema)


def folded(node: str, low: list[tuple[str, str]], cached: dict) -> str:
    """The root that follows from a leaf and its siblings. Below one subtree, equal roots of it give equal results."""
    for before, after in low:
        node = digest(before + node + after)
    if node not in cached:
        root = node
        for before, after in cached["above"]:
            root = digest(before + root + after)
        cached[node] = root
    return cached[node]


def leaf(text: Column | None = None) -> Column:
    """The digest of a row's fields; ``text`` stands for its text."""
    parts = []
    for name in FIELDS:
        value = (text if text is not None and name == "text" else F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def manifest(docs: DataFrame, tampered: Column | None = None, text: Column | None = None, shape: Shape = SHAPE) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    Where ``tampered`` holds, the root is recomputed from a row whose text is ``text``; elsewhere from the row itself.
    """
    other = F.when(tampered, leaf(text)) if tampered is not None else F.lit(None).cast("string")
    rows = written(docs.select("doc_id", F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("tree"), F.unhex(leaf()).alias("leaf"), F.unhex(other).alias("other")), "leaves")
    leaves = numbered(rows, "tree", "doc_id", "leaf").withColumn("hash", F.lower(F.hex("leaf"))).withColumn("other", F.lower(F.hex("other"))).withColumn("doc_id", F.col("doc_id").cast("string")).drop("leaf")  # an id as text stays exact beside nulls
    tiers = climbed(leaves, shape)
    subroots = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("hash"))
    trees = numbered(subroots, "tree", "of")
    over = climbed(trees, shape)
    top = over[-1].select("hash").first()
    root = top[0] if top else ""
    none = F.array().cast("array<string>")
    tops = over[-1].select("tree", F.lit("").alias("subroot"), none.alias("before"), none.alias("after"))
    paths = descended(over, tops, shape)

    def path(row, low, cached, subroot):
        whole = low + cached["above"]
        return row.of, row.hash, [b for b, _ in whole], [a for _, a in whole]

    tops = written(proofs(trees, paths, path, ["of", "hash"], "tree string, subroot string, before array<string>, after array<string>", shape), "tops")
    paths = descended(tiers, tops, shape)

    def proof(row, low, cached, subroot):
        doc_id, hashed, other = row
        back = folded(other if isinstance(other, str) else hashed, low, cached)
        return doc_id, hashed, subroot, root, digest("".join([b + a for b, a in low]) + cached["joined"]), back, back == root

    kind = dict(docs.dtypes)["doc_id"]
    return proofs(leaves, paths, proof, ["doc_id", "hash", "other"], "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", shape).withColumn("doc_id", F.col("doc_id").cast(kind))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, a third of them with capitals made small after it was made."""
    return manifest(documents(spark, sf_dir), fold("doc_id", 3) == 0, F.translate("text", UPPER, LOWER))
