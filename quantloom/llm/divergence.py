"""How sources differ in what they say: an audit of term shares per language and source.

Counts and shares. Texts are counted per (language, source, term) on the workers, rows are gathered
by (language, term), and terms in too few of a language's documents go. A share is an integer in
units of 10^-9, smoothed by 2 counts; all arithmetic is on integers.

Pairs of sources. Most terms are missing in most sources, where they have the source's least share,
its baseline. So the divergence of two sources is that of their baselines times the number of terms,
corrected for the terms that one of them has (by the number of terms of each share), and for those
that both have (a join of the sparse counts on the term).

Ranking. The k highest values of each group are found by radix selection: histograms over ten bits of
the values at a time, of what still shares the threshold's higher bits, give the k-th value of all
groups at once. Ties at that value are refined by the bytes of the terms: histograms of the next
bytes, after what all candidates have in common, until no more than the places left remain. No task
sorts a group.

Defined cases: null texts, languages and sources are ''; a language without kept terms has pairs of
value 0 and no terms; a group without any term is in all pairs of its language; repeated rows and ids
count as documents of their own; ties are ordered by the item's bytes; long texts are counted in
parts; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import documents, trim, written

# What separates terms (in UTF-8 bytes), the least number of documents, the unit of shares, the smoothing.
BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]+")
LEAST, UNIT, SMOOTH = 10, 1_000_000_000, 2

TOP = 10
PART = 1_000_000  # bytes of a text that are counted at a time
ENTRIES = 400_000  # terms and groups that a task holds before it hands them on
BITS, DIGIT = 30, 10  # of values, which are at most a share, and of a histogram
GROUP = ["lang", "source"]


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a part at a time; parts end between terms. Lower case of bytes is that of A-Z."""
    at = 0
    while at < len(text):
        cut = BETWEEN.search(text, at + PART) if len(text) - at > PART else None
        end = cut.start() if cut else len(text)
        terms = BETWEEN.split(text[at:end].lower())
        yield terms[terms[0] == b"" : len(terms) - (terms[-1] == b"" and len(terms) > 1)]
        at = end


def counted(docs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, added up as far as a task's memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        found: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            columns: list[list[pa.Array]] = [[] for _ in range(5)]
            for (lang, source), (times, docs) in found.items():
                terms = list(times)
                group = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
                for column, values in zip(columns, (*group, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(times.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())), strict=True):
                    column.append(values)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in columns], ["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"], strict=True):
                times, docs = found.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(times), set()
                for terms in terms_of(text.as_buffer().to_pybytes()):
                    times.update(terms)
                    seen.update(terms)
                docs.update(seen)
                size += len(times) - before
                if size >= entries:
                    yield rows()
                    found.clear()
                    size = 0
        if size:
            yield rows()

    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: str | int, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exact for any count; null without terms."""
    return F.expr(f"1 + (cast({n} + {SMOOTH} as decimal(20, 0)) * {UNIT}) div nullif(cast({total} + {SMOOTH} * {terms} as decimal(20, 0)), 0)")


def apart(p: str, q: str) -> str:
    """The part of a divergence that shares ``p`` and ``q`` give; the squares of shares fit a long."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def shares(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, terms: V of the language, base: the share of a term that the group lacks), and cells
    (lang, source, term, p, q, base) of what occurs: the shares in the group and in its language."""
    of_term = Window.partitionBy("lang", "term")
    cells = written(
        counted(docs)
        .repartition("lang", "term")  # a group's rows of a term were added up before
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
        .where(F.col("lang_docs") >= least)
        .select(*GROUP, "term", "n", "lang_n", "first"),
        "terms",
    )
    langs = cells.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"))
    totals = cells.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]).distinct()
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "terms", "lang_total")}
    groups = written(every.join(totals, GROUP, "left").join(langs, "lang", "left").withColumns(zero).withColumn("base", share(0, "total", "terms")), "groups")
    valued = cells.join(groups, GROUP).select(*GROUP, "term", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"), "base")
    return groups.select(*GROUP, "terms", "base"), written(valued, "shares")


def pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, item, value: the divergence from each other source of the language."""
    g = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    a, b = F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")
    apart_bases = apart("base", "other")
    both_lack = groups.join(g, "lang").where("source < item").select("lang", a, b, F.expr(f"if(terms > 0, terms * ({apart_bases}), 0)").alias("value"))
    kinds = cells.groupBy(*GROUP, "base", "p").agg(F.count("*").alias("n"))  # terms of equal shares
    one_has = kinds.join(g, "lang").where("source <> item").select("lang", a, b, F.expr(f"n * ({apart('p', 'other')} - {apart_bases})").alias("value"))
    others = cells.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("base").alias("other"))
    both = cells.join(others, ["lang", "term"]).where("source < item")
    both_have = both.select("lang", a, b, F.expr(f"{apart('p', 'r')} - {apart('p', 'other')} - {apart('base', 'r')} + {apart_bases}").alias("value"))
    total = both_lack.unionByName(one_has).unionByName(both_have).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return total.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")).select("lang", "x.source", "x.item", "value")


def thresholds(values: DataFrame, k: int, bits: int = BITS, digit: int = DIGIT) -> DataFrame:
    """lang, source, value, places, ties: each group's k-th highest value (its least, if it has fewer), how many of those with it are among the k, and how many there are.

    ``values``: lang, source, value, from 0 to 2^bits - 1.
    """
    down = Window.partitionBy(*GROUP).orderBy(F.desc("high")).rowsBetween(Window.unboundedPreceding, -1)
    least = Window.partitionBy(*GROUP).orderBy("high")
    found = None
    for shift in range(bits - digit, -1, -digit):
        rows = values.withColumn("high", F.shiftright("value", shift))
        if found is None:
            rows = rows.withColumn("places", F.lit(k).cast("long"))
        else:
            rows = rows.join(found.select(*GROUP, F.col("value").alias("above"), "places"), GROUP).where(F.shiftright("high", digit) == F.col("above"))
        bins = rows.groupBy(*GROUP, "places", "high").agg(F.count("*").alias("ties"))  # 2^digit for each group
        bins = bins.withColumn("before", F.coalesce(F.sum("ties").over(down), F.lit(0))).where("before < places").withColumn("last", F.row_number().over(least))
        found = written(bins.where("last = 1").select(*GROUP, F.col("high").alias("value"), (F.col("places") - F.col("before")).alias("places"), "ties"), "thresholds")
    return found


in_common = F.udf(lambda a, b: commonprefix([a, b]), StringType())  # one row for each open group


def refined(tied: DataFrame, width: int = 4) -> DataFrame:
    """lang, source, reach, upto: the tied terms whose first ``reach`` digits are at most ``upto`` have the places, where each group has more ties than places.

    ``tied``: lang, source, places, code (the bytes of a distinct term in hexadecimal). ``width``: hexadecimal digits of a histogram.
    """
    up = Window.partitionBy(*GROUP).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy(*GROUP).orderBy(F.desc("bin"))
    done, open_at = None, tied.groupBy(*GROUP, "places").agg(F.min("code").alias("lo"), F.max("code").alias("hi"))
    while True:
        at = written(open_at.select(*GROUP, F.col("places").alias("left"), in_common("lo", "hi").alias("prefix")), "open")
        rows = tied.join(at, GROUP).where(F.expr("startswith(code, prefix)")).withColumn("reach", F.length("prefix") + width)
        bins = rows.withColumn("bin", F.expr("substring(code, 1, reach)")).groupBy(*GROUP, "left", "reach", "bin").agg(F.count("*").alias("n"), F.min("code").alias("lo"), F.max("code").alias("hi"))
        bins = bins.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0))).where("before < left").withColumn("last", F.row_number().over(last))
        chosen = written(bins.where("last = 1").select(*GROUP, "reach", "bin", (F.col("left") - F.col("before")).alias("places"), "n", "lo", "hi"), "bins")
        closed = chosen.where("n <= places").select(*GROUP, "reach", F.col("bin").alias("upto"))
        done = closed if done is None else done.unionByName(closed)
        open_at = chosen.where("n > places")
        if open_at.isEmpty():
            return done


def highest(values: DataFrame, k: int = TOP) -> DataFrame:
    """The k rows of each group (lang, source) with the highest ``value``, ties by ``term``; terms of a group are distinct."""
    edge = thresholds(values.select(*GROUP, "value"), k)
    rows = values.join(edge.select(*GROUP, F.col("value").alias("kth"), "places", "ties"), GROUP).where("value >= kth")
    sure = rows.where("value > kth or ties <= places").select(*values.columns)
    tied = written(rows.where("value = kth and ties > places").withColumn("code", F.hex(F.encode("term", "UTF-8"))).select(*values.columns, "places", "code"), "tied")
    upto = refined(tied.select(*GROUP, "places", "code"))
    again = tied.sparkSession.read.schema(tied.schema).parquet(tied.written_to)
    fits = again.join(upto, GROUP).where(F.expr("substring(code, 1, reach) <= upto"))
    return sure.unionByName(fits.select(*values.columns))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence from the language's other sources, and the terms that a source has more than its language."""
    groups, cells = shares(docs, least)
    terms = highest(cells.where("p > q").select(*GROUP, "term", F.expr(apart("p", "q")).alias("value")), top)
    rows = pairs(groups, cells).select(*GROUP, F.lit("pair").alias("part"), "item", "value").unionByName(terms.select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    order = Window.partitionBy(*GROUP, "part").orderBy(F.desc("value"), "item")  # as many rows as a language has sources, or ``top``
    return rows.withColumn("rank", F.row_number().over(order))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(documents(spark, sf_dir))
