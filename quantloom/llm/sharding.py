"""Sharding by histogram sort.

Rows are ordered by (hash of the text, row number). The order is cut into shards at splitters that
are found by counting: each round probes equally spaced boundaries inside the interval that still
holds a splitter, sums the exact bytes below each probe over all partitions, and keeps the one
sub-interval that the target falls into. Only those sums (shards x fan-out rows at most) reach the
driver. Rows are exchanged once, after the splitters stand. All of it is DataFrame expressions.

Defined cases: a null text has size 8 and checksum 0; equal texts are neighbours in the order and
are cut, if they must be, between two of their rows; an empty table gives an empty result; columns
of the input other than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

ROW_BYTES = 8  # bytes that a row costs beside its text
SHARDS = 24
FANOUT = 256  # probes per open splitter and round
TOLERANCE = 0.001  # of the mean shard
CELLS = 256  # exchange cells per shard


@dataclass(frozen=True)
class Interval:
    """Keys lo..hi of the first key column, or of the second one where the first equals ``at``."""

    lo: int
    hi: int
    at: int | None = None

    @property
    def holds(self) -> str:
        if self.at is None:
            return f"k1 between {self.lo}L and {self.hi}L"
        return f"k1 = {self.at}L and k2 between {self.lo}L and {self.hi}L"

    def width(self, fanout: int) -> int:
        return (self.hi - self.lo) // fanout + 1

    def sub(self, fanout: int) -> str:
        return f"cast((k{1 if self.at is None else 2} - {self.lo}L) div {self.width(fanout)}L as int)"

    def nth(self, i: int, fanout: int) -> Interval:
        lo = self.lo + i * self.width(fanout)
        return Interval(lo, min(self.hi, lo + self.width(fanout) - 1), self.at)

    @property
    def start(self) -> tuple[int, int]:
        """The smallest (k1, k2) in it."""
        return (self.lo, -1) if self.at is None else (self.at, self.lo)

    @property
    def end(self) -> tuple[int, int]:
        """The smallest (k1, k2) above it."""
        return (self.hi + 1, -1) if self.at is None else (self.at, self.hi + 1)


def splitters(keyed: DataFrame, parts: int, fanout: int = FANOUT, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Keys (k1, k2) at which ``keyed`` (k1, k2, size) is cut into ``parts`` runs of near equal size."""
    top = keyed.agg(F.sum("size"), F.max("k2")).first()
    total, last = int(top[0] or 0), int(top[1] or 0)
    targets = [total * j // parts for j in range(1, parts)]
    slack = max(1, int(total / parts * tolerance))
    open_at: dict[int, tuple[Interval, int]] = {j: (Interval(0, 2**63 - 2), 0) for j in range(len(targets))}  # with the bytes below
    found: dict[int, tuple[int, int]] = {}
    while open_at:
        spans = sorted({s for s, _ in open_at.values()}, key=lambda s: s.start)
        which = "case " + " ".join(f"when {s.holds} then {i}" for i, s in enumerate(spans)) + " end"
        sub = "case span " + " ".join(f"when {i} then {s.sub(fanout)}" for i, s in enumerate(spans)) + " end"
        counted = keyed.select("k1", "k2", "size", F.expr(which).alias("span")).where("span is not null").groupBy("span", F.expr(sub).alias("sub")).agg(F.sum("size").alias("size"))
        sums: dict[int, list[tuple[int, int]]] = {}
        for r in counted.collect():  # at most fanout rows for each open interval
            sums.setdefault(r["span"], []).append((r["sub"], int(r["size"])))
        for j, (span, below) in list(open_at.items()):
            del open_at[j]
            at = below
            for i, size in sorted(sums.get(spans.index(span), [])):
                if at + size < targets[j]:
                    at += size
                    continue
                part = span.nth(i, fanout)
                single = part.lo == part.hi
                if targets[j] - at <= slack or at + size - targets[j] <= slack or (single and part.at is not None):
                    found[j] = part.start if targets[j] - at <= at + size - targets[j] else part.end
                elif single:  # rows of one text: go on between them
                    open_at[j] = (Interval(0, last, part.lo), at)
                else:
                    open_at[j] = (part, at)
                break
            else:
                found[j] = span.end
    return [found[j] for j in range(len(targets))]


def histogram_shard(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards of near equal bytes, rows numbered in each."""
    text = F.col("text").cast("string")
    keyed = written(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 1).alias("k1"),
            F.monotonically_increasing_id().alias("k2"),
        ),
        "shard-keys",
    )
    cuts = splitters(keyed, shards, tolerance=tolerance)
    shard = " + ".join(f"int(k1 > {a}L or (k1 = {a}L and k2 >= {b}L))" for a, b in cuts) or "0"
    placed = keyed.withColumn("shard", F.expr(f"cast({shard} as int)")).withColumn("cell", F.pmod(F.xxhash64("k2"), F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "cell").orderBy("k1", "k2")
    return (
        placed.withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "cell"])  # shards x cells rows at most
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"))
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return histogram_shard(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
