"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Each document's ids end with id 0. Longer ones are cut into pieces of ``capacity`` ids, of which the
first may be shorter. Full pieces are sequences of their own; those over half a sequence open one.
The rest is packed in rounds. In a round, documents and gaps are range-sorted together by size, from
the largest, gaps first. A sweep over each range gives every document the smallest gap of its range
that holds it. What is left over is matched across ranges: a document takes the nearest gap of the
ranges above, counted by its rank from one summary row per range. Gaps are updated, and the next
round starts. Where no gap holds any document, as many empty sequences are opened as the rest fills.

Defined cases: a null or empty text has the single id 0; equal sizes are ordered by row; a repeated
row is packed once per occurrence; an empty table gives an empty result; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, dropped, held, trim, written
from .tokens import ByteBPE

CAPACITY = 2048
SWEEP_ROWS = 250_000  # documents and gaps in one range
DOC, GAP, LATER = 1, 0, 2  # LATER: a gap that has shrunk below its range


def loaded(name: str) -> ByteBPE:
    return held(("byte", name), lambda: ByteBPE(name))


def cut_points(n: int, capacity: int) -> list[int]:
    """Where the pieces of n ids start: only the first may be shorter."""
    return [0, *range((n - 1) % capacity + 1, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = "byte_bpe_50k.json", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ids if asked for."""

    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if keep_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        bpe = loaded(name)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):  # texts become strings one by one
                raw = bpe.ids(text.as_py() or "") + bytes(4)
                starts = cut_points(len(raw) // 4, capacity)
                for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(raw) // 4], strict=True)):
                    part = raw[4 * lo : 4 * hi]
                    rows.append((doc_id, k, lo, hi - lo, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype("i4")] if keep_ids else [])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
        trim()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range of kind, id, size, sorted from the largest: each document takes the smallest gap that holds it.

    Gives the same rows with mate (a document's gap, if any), and for those left over nth, the place
    among the documents from the first, or among the gaps from the last.
    """
    rows = pd.concat([pd.DataFrame({"kind": [], "id": [], "size": []}, dtype="int64"), *batches])
    if not len(rows):
        return
    at: dict[int, list[tuple[int, int]]] = {}  # size -> gaps with the size that they came with
    sizes: list[int] = []
    placed, left = [], []
    smallest = int(rows["size"].iloc[-1])
    for kind, key, size in zip(rows["kind"].tolist(), rows["id"].tolist(), rows["size"].tolist(), strict=True):
        if kind != DOC:
            if size not in at:
                at[size] = []
                insort(sizes, size)
            at[size].append((key, size))
            continue
        i = bisect_left(sizes, size)
        if i == len(sizes):
            left.append((DOC, key, size, None, len(left)))
            continue
        gap = sizes[i]
        mate, full = at[gap].pop()
        if not at[gap]:
            del at[gap], sizes[i]
        placed.append((DOC, key, size, mate, None))
        if gap > size:
            if gap - size not in at:
                at[gap - size] = []
                insort(sizes, gap - size)
            at[gap - size].append((mate, full))
    later = 0
    for size in sizes:
        for key, _ in at[size]:
            if size >= smallest:
                left.append((GAP, key, size, None, later))
                later += 1
            else:
                left.append((LATER, key, size, None, None))
    out = pd.DataFrame(placed + left, columns=["kind", "id", "size", "mate", "nth"])
    yield out.astype({"mate": "Int64", "nth": "Int64"})


def across(ranges: list) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """Which leftover documents meet which leftover gaps of earlier ranges.

    ranges: rows part, docs, widest (document), gaps, narrowest (gap), in order. Gives rows (part of
    documents, from, to, number of the first match, documents a gap, part of gaps, from, to).
    """
    stack: list[list[int]] = []  # part, gaps taken, gaps, narrowest
    out, number = [], 0
    for r in ranges:
        done = 0
        free = sum(s[2] - s[1] for s in stack)
        while done < r["docs"] and stack:
            top = stack[-1]
            each = max(1, min(top[3] // r["widest"], -(-(r["docs"] - done) // free)))
            take = min(top[2] - top[1], -(-(r["docs"] - done) // each))
            n = min(r["docs"] - done, take * each)
            out.append((r["part"], done, done + n, number, each, top[0], top[1], top[1] + take))
            number, done, free = number + take, done + n, free - take
            top[1] += take
            if top[1] == top[2]:
                stack.pop()
        if r["gaps"]:
            stack.append([r["part"], 0, r["gaps"], r["narrowest"]])
    return out


def swept(state: DataFrame, rows: int, sweep_rows: int) -> DataFrame:
    order = [F.desc("size"), F.asc("kind"), F.asc("id")]
    n = -(-rows // sweep_rows)
    ranged = state.repartitionByRange(n, *order) if n > 1 else state.repartition(1)
    return ranged.sortWithinPartitions(*order).mapInPandas(sweep, "kind int, id long, size long, mate long, nth long").withColumn("part", F.spark_partition_id())


def best_fit(sizes: DataFrame, capacity: int = CAPACITY, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """id, bin, step for each id, size below ``capacity``; no bin holds more than ``capacity``."""
    spark = sizes.sparkSession
    large = F.col("size") * 2 > capacity
    placed = [sizes.where(large).select("id", F.col("id").alias("bin"), F.lit(0).alias("step"))]
    state = sizes.select(F.when(large, GAP).otherwise(DOC).cast("int").alias("kind"), "id", F.when(large, capacity - F.col("size")).otherwise(F.col("size")).alias("size"))
    old = None
    step = 0
    while True:
        step += 1
        left = {r["kind"]: r for r in state.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("sum"), F.max("size").alias("max"), F.min("size").alias("min")).collect()}
        if DOC not in left:
            break
        docs, gaps = left[DOC], left.get(GAP)
        if not gaps or gaps["max"] < docs["min"]:  # nothing fits: open what the rest fills at best
            new = -(-docs["sum"] // capacity)
            opened = spark.range(new).select(F.lit(GAP).alias("kind"), (-(F.col("id") + 1) - F.lit(step * 2**40)).alias("id"), F.lit(capacity).cast("long").alias("size"))
            state = state.where(f"kind = {DOC}").unionByName(opened)
            rows = docs["n"] + new
        else:
            state = state.where(f"kind = {DOC} or size >= {docs['min']}")
            rows = docs["n"] + gaps["n"]
        got = written(swept(state, rows, sweep_rows), "sweep")
        rest = got.where("mate is null")
        ranges = (
            rest.groupBy("part")
            .agg(F.count_if(F.col("kind") == DOC).alias("docs"), F.max(F.when(F.col("kind") == DOC, F.col("size"))).alias("widest"), F.count_if(F.col("kind") == GAP).alias("gaps"), F.min(F.when(F.col("kind") == GAP, F.col("size"))).alias("narrowest"))
            .orderBy("part")
            .collect()
        )  # a row for each range
        meets = across(ranges)
        matched = got.where(f"mate is not null and kind = {DOC}").select("id", F.col("mate").alias("bin"), "size")
        now, waiting = rest.where(f"kind <> {DOC}").select("id", "size"), rest.where(f"kind = {DOC}").select("id", "size")
        if meets:
            table = F.broadcast(spark.createDataFrame(meets, "dpart int, dlo long, dhi long, number long, each long, gpart int, glo long, ghi long"))  # two rows a range at most
            d = rest.where(f"kind = {DOC}").join(table, (F.col("part") == F.col("dpart")) & (F.col("nth") >= F.col("dlo")) & (F.col("nth") < F.col("dhi")))
            d = d.select("id", "size", F.expr("number + (nth - dlo) div each").alias("m"))
            g = rest.where(f"kind = {GAP}").join(table, (F.col("part") == F.col("gpart")) & (F.col("nth") >= F.col("glo")) & (F.col("nth") < F.col("ghi")))
            g = g.select(F.col("id").alias("bin"), F.expr("number + nth - glo").alias("m"))
            met = written(d.join(g, "m").select("id", "bin", "size"), "across")
            matched = matched.unionByName(met)
            taken = met.groupBy(F.col("bin").alias("id")).agg(F.sum("size").alias("taken"))
            now = now.join(taken, "id", "left").select("id", (F.col("size") - F.coalesce("taken", F.lit(0))).alias("size")).where("size > 0")
            waiting = waiting.join(met.select("id"), "id", "left_anti")
        placed.append(matched.select("id", "bin", F.lit(step).alias("step")))
        state = written(now.select(F.lit(GAP).alias("kind"), "id", "size").unionByName(waiting.select(F.lit(DOC).alias("kind"), "id", "size")), "gaps")
        dropped(old)
        old = state
    dropped(old)
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, name: str = "byte_bpe_50k.json", keep_ids: bool = False, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset."""
    cut = written(pieces(docs, capacity, name, keep_ids).withColumn("id", F.monotonically_increasing_id()), "pieces")
    bins = best_fit(cut.where(F.col("length") < capacity).select("id", F.col("length").alias("size")), capacity, sweep_rows)
    inside = Window.partitionBy("bin").orderBy("step", "id").rowsBetween(Window.unboundedPreceding, -1)
    small = cut.where(F.col("length") < capacity).join(bins, "id").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
    full = cut.where(F.col("length") == capacity).withColumns({"bin": F.col("id"), "offset": F.lit(0).cast("long")})
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, F.col("bin").alias("sequence_id"), "offset"]
    return small.select(*cols).unionByName(full.select(*cols))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(documents(spark, sf_dir))
