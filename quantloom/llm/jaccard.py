"""N-gram Jaccard join by a MinHash LSH forest.

Texts are sets of shingles of five words. Equal texts are one class, which is compared once. Every
class has a MinHash signature, cut into trees; a tree is a prefix trie, kept as the range-sorted keys of
all classes. A pass over the sorted keys gives each class its longest prefix in common with a neighbour;
classes whose longest match in a tree is shorter than the depth asked for leave that tree. The others
meet below one node: neighbours first, which have the longest prefixes in common, then, with prefixes
shortened to the depth, all that aren't connected yet. The depth begins where the modelled recall at the
threshold reaches the target, and is shortened, with a looser drop of candidates by their signatures,
until the measured recall reaches it too: that of a bounded sample of documents, whose links are
counted by brute force in the pass that signs all texts, and that told by the similarities of the links
found. What is left falls into connected groups, and in each group every pair is verified on the exact
sets by an inverted index. Large trie nodes and groups are cut into blocks that meet pairwise, so neither
is ever one task's, and pairs aren't rows: a task returns counts and a spanning forest of its links.

Defined cases: rows without id, and texts that are null or without words, link with nothing; a text of
one to four words is one shingle; ties are inclusive (similarity of exactly the threshold links);
repeated rows are copies; a repeated id has a row for each of its texts; an empty table gives an empty
result; columns other than doc_id and text pass through ``one_of_each``, whatever their names, and are
otherwise not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, dropped, fresh, trim, written
from .graph import components, forest, roots

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 8  # tries, and values in each: 128 hash functions
TARGET = 0.999  # recall
CLEAR = 5.0  # standard deviations below the threshold at which a signature rules a pair out
AUDIT, AUDIT_SHINGLES = 512, 1_000_000  # documents whose links are counted by brute force, and shingles of them, at most
SORTED_ROWS = 200_000  # rows of the sorted tries in one range
FILTER_WORDS = 1 << 20  # of 64 bits, in the filter that keeps texts without candidates from being shuffled: 8 MB
NODE_BLOCK, GROUP_BLOCK = 1000, 1500  # classes
CHUNK = 1 << 20  # bytes hashed at once

PRIME = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME ** i and its inverses modulo 2 ** 64, for i up to n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, CHUNK + (CHUNK >> 2))
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(PRIME), -1, 2**64))
            _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, x, "u8")]) for x in (PRIME, inverse)]
    return _POWERS[0], _POWERS[1]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, text after text, and where each text's begin (with the end)."""
    joined = [" ".join(t.split()).encode("utf-8", "replace") if t else b"" for t in texts]
    out, counts, lo = [], np.zeros(len(texts), "i8"), 0
    while lo < len(joined):
        hi, size = lo, 0
        while hi < len(joined) and (hi == lo or size + len(joined[hi]) < CHUNK):
            size += len(joined[hi]) + 1
            hi += 1
        full = [i for i in range(lo, hi) if joined[i]]
        lo = hi
        if not full:
            continue
        data = np.frombuffer(b" ".join([joined[i] for i in full]) + b" ", "u1")
        ends = np.flatnonzero(data == 32)  # of words
        starts = np.r_[0, ends[:-1] + 1]
        text_ends = np.cumsum([len(joined[i]) + 1 for i in full]) - 1
        owner = np.searchsorted(text_ends, ends)
        words = np.bincount(owner, minlength=len(full))
        first = np.cumsum(words) - words
        n = np.maximum(1, words - WORDS + 1)
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        last = at + np.repeat(np.minimum(words, WORDS), n) - 1
        power, inverse = powers(len(data))
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum((data.astype("u8") + np.uint64(1)) * power[: len(data)])]
            h = (sums[ends[last]] - sums[starts[at]]) * inverse[starts[at]]
            h = (h ^ (h >> np.uint64(32))) * PRIME
            out.append(h ^ (h >> np.uint64(29)))
        counts[full] = n
    return np.concatenate(out) if out else np.zeros(0, "u8"), np.r_[0, np.cumsum(counts)]


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """TREES x DEPTH MinHash values of each text, from its shingles; zeros for one without words."""
    out = np.zeros((len(bounds) - 1, TREES * DEPTH), "u4")
    some = np.flatnonzero(np.diff(bounds))
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**32, (2, TREES * DEPTH), dtype="u4")
    a |= np.uint32(1)
    x = (h >> np.uint64(32)).astype("u4")
    lo = 0
    while lo < len(some):  # so many texts at once that their hashes stay in the CPU's cache
        hi = max(lo + 1, int(np.searchsorted(bounds[some], bounds[some[lo]] + 60_000)))
        part = x[bounds[some[lo]] : bounds[some[min(hi, len(some)) - 1] + 1]]
        starts = bounds[some[lo:hi]] - bounds[some[lo]]
        work = np.empty_like(part)
        for k in range(TREES * DEPTH):
            np.multiply(part, a[k], out=work)
            np.add(work, b[k], out=work)
            out[some[lo:hi], k] = np.minimum.reduceat(work, starts)
        lo = hi
    return out


class Sample:
    """Some texts' shingles, sorted, against which others are compared by brute force."""

    def __init__(self, texts: list[str]):
        sets = [np.unique(h) for h in (shingles([t])[0] for t in texts)]
        self.sizes = np.array(list(map(len, sets)), "i8")
        owner, h = np.repeat(np.arange(len(sets)), self.sizes), np.concatenate([np.zeros(0, "u8"), *sets])
        order = np.argsort(h, kind="stable")
        self.h, self.owner = h[order], owner[order]

    def links(self, h: np.ndarray, bounds: np.ndarray, threshold: float) -> list[list[int]]:
        """For each text, given by its shingles, the sampled ones that are similar to it."""
        out: list[list[int]] = [[] for _ in bounds[1:]]
        at = np.searchsorted(self.h, h)
        hit = np.flatnonzero(self.h[np.minimum(at, len(self.h) - 1)] == h) if len(self.h) else at[:0]
        doc = np.searchsorted(bounds, hit, "right") - 1
        for i in np.unique(doc):
            own = np.unique(h[bounds[i] : bounds[i + 1]])
            lo, hi = np.searchsorted(self.h, own), np.searchsorted(self.h, own, "right")
            n = hi - lo
            met = self.owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            shared = np.bincount(met, minlength=len(self.sizes))
            out[i] = np.flatnonzero((shared > 0) & (shared / (len(own) + self.sizes - shared) >= threshold)).tolist()
        return out


def modelled_recall(similarity: float | np.ndarray, depth: int) -> float | np.ndarray:
    """The chance that two sets meet in a trie node of ``depth``."""
    return 1 - (1 - similarity**depth) ** TREES


def first_depth(threshold: float, target: float) -> int:
    """The longest prefix whose recall at the threshold reaches the target."""
    return next((d for d in range(DEPTH, 0, -1) if modelled_recall(threshold, d) >= target), 1)


def text_keys() -> list[Column]:
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def has_words() -> Column:
    """Some character that Python's split() keeps."""
    return F.coalesce(F.col("text").cast("string").rlike(r"[^\s\p{Z}\x1c-\x1f\x85]"), F.lit(False))


def usable(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 and text of documents that have an id and words."""
    return docs.where(F.col("doc_id").isNotNull() & has_words()).select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(), F.col("text").cast("string").alias("text"))


def sampled(rows: DataFrame) -> pd.DataFrame:
    """doc_id, h1, h2 and text of some documents: AUDIT and about AUDIT_SHINGLES at most, in the order of a hash.

    A text that would exceed the bound, or a twentieth of it, is passed over, the ones after it aren't; if all are so long, the shortest is taken.
    """
    got = rows.select("doc_id", "h1", "h2", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id", "h1", F.lit(5)), "doc_id", "h1").limit(AUDIT).toPandas()
    room, fits = 5 * AUDIT_SHINGLES, []
    for i, n in enumerate(got["n"]):
        if n <= min(room, AUDIT_SHINGLES // 4):
            room -= n
            fits.append(i)
    if not len(got):
        return got.assign(text=[])
    got = got.iloc[fits or [int(got["n"].argmin())]]
    keys = F.broadcast(rows.sparkSession.createDataFrame(got[["doc_id", "h1", "h2"]], "doc_id long, h1 long, h2 long"))
    return rows.join(keys, ["doc_id", "h1", "h2"]).toPandas().drop_duplicates(["h1", "h2"], ignore_index=True)


def signed(rows: DataFrame, sample: Sample, threshold: float) -> DataFrame:
    """doc_id, h1, h2, signature and the places of the sampled texts that are similar to the document's."""
    shared = rows.sparkSession.sparkContext.broadcast(sample)  # AUDIT_SHINGLES shingles

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i : i + 500]
                h, bounds = shingles(part["text"].tolist())
                s = signatures(h, bounds)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "h1": part["h1"].to_numpy(), "h2": part["h2"].to_numpy(), "sig": [x.tobytes() for x in s], "near": shared.value.links(h, bounds, threshold)})
        trim()

    return rows.mapInPandas(run, "doc_id long, h1 long, h2 long, sig binary, near array<int>").withColumn("row", F.monotonically_increasing_id())


def sorted_tries(classes: DataFrame, n: int, depth: int) -> DataFrame:
    """tree, key, node, match: ``n`` classes in each tree, range-sorted by key, as far as their longest common prefix with a neighbour (match, in values) is ``depth`` or more, or can't be known before the ranges meet."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        for b in batches:
            if len(b):
                raw = np.frombuffer(b"".join(b["sig"]), "u4").astype(">u4").tobytes()
                width = 4 * DEPTH
                yield pd.DataFrame({"tree": np.tile(np.arange(TREES, dtype="i4"), len(b)), "key": [raw[i : i + width] for i in range(0, len(raw), width)], "node": np.repeat(b["node"].to_numpy(), TREES)})

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        rows = pd.concat([pd.DataFrame({"tree": [], "key": [], "node": []}).astype({"tree": "i4", "node": "i8"}), *batches], ignore_index=True)  # SORTED_ROWS on average
        if not len(rows):
            return
        values, tree = np.frombuffer(b"".join(rows["key"]), ">u4").reshape(-1, DEPTH), rows["tree"].to_numpy()
        common = np.cumprod((values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(axis=1)
        longest = np.maximum(np.r_[DEPTH, common], np.r_[common, DEPTH])  # the ends may go on in the next range
        yield rows.assign(match=longest)[longest >= depth]

    order = ["tree", "key", "node"]
    rows = classes.select("node", "sig").mapInPandas(keys, "tree int, key binary, node long")
    parts = -(-n * TREES // SORTED_ROWS)
    return rows.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order).mapInPandas(match, "tree int, key binary, node long, match int")


def blocked(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Rows of groups over ``block`` are dealt into blocks, and meet once for each pair of blocks a <= b."""
    n = f"cast(ceil({size} / {block}) as int)"
    own = rows.withColumn("block", F.expr(f"cast(pmod(xxhash64(node, {key}), {n}) as int)")).withColumn("other", F.expr(f"explode(sequence(0, {n} - 1))"))
    return own.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("other")


def sketch(sig: bytes) -> np.ndarray:
    """Eight bits of each MinHash value."""
    with np.errstate(over="ignore"):
        return ((np.frombuffer(sig, "u4") * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype("u1")


def likely(cut: float):
    """Rows trie, a, b, block, key, node, sketch, sorted by cell and key: a spanning forest of pairs in each cell whose sketches agree to ``cut``."""

    def forest_of(node: np.ndarray, block: np.ndarray, s: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
        n = len(node)
        near = np.flatnonzero((s[1:] == s[:-1]).mean(axis=1, dtype="f4") >= cut)  # neighbours: the longest common prefixes
        left, right = [near], [near + 1]
        ids, low = roots(np.r_[near, np.arange(n)], np.r_[near + 1, np.arange(n)])
        for i in range(0, n if len(np.unique(low)) > 1 else 0, 64):  # shorter ones: pairs that aren't connected yet
            x, y = np.nonzero((low[i : i + 64, None] < low[None]) | ((low[i : i + 64, None] > low[None]) & (np.arange(i, min(n, i + 64))[:, None] < np.arange(n))))
            x += i
            fine = block[x] != block[y] if cross else np.ones(len(x), bool)
            x, y = x[fine], y[fine]
            for k in range(0, len(x), 20_000):
                hit = (s[x[k : k + 20_000]] == s[y[k : k + 20_000]]).mean(axis=1, dtype="f4") >= cut
                a, b = forest(x[k : k + 20_000][hit], y[k : k + 20_000][hit])
                left.append(a)
                right.append(b)
        x, y = forest(np.concatenate(left), np.concatenate(right))
        return node[x], node[y]

    def cells(df: pd.DataFrame) -> pd.DataFrame:
        node, block, cross = df["node"].to_numpy(), df["block"].to_numpy(), (df["a"] != df["b"]).to_numpy()
        s = np.frombuffer(b"".join(df["sketch"]), "u1").reshape(len(df), -1)
        cell = df[["trie", "a", "b"]].to_numpy()
        bounds = np.r_[0, np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1, len(df)]
        size = np.diff(bounds)
        two = bounds[:-1][size == 2]
        ok = (s[two] == s[two + 1]).mean(axis=1) >= cut
        pairs = [(node[two[ok]], node[two[ok] + 1])]
        for lo, n in zip(bounds[:-1][size > 2], size[size > 2], strict=True):
            pairs.append(forest_of(node[lo : lo + n], block[lo : lo + n], s[lo : lo + n], bool(cross[lo])))
        return pd.DataFrame({"a": np.concatenate([a for a, _ in pairs]), "b": np.concatenate([b for _, b in pairs])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        rest = None
        for df in batches:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            last = df[["trie", "a", "b"]].to_numpy()
            cut_at = len(df) - int((last[::-1] == last[-1]).all(axis=1).cumprod().sum()) if len(df) else 0
            rest = df.iloc[cut_at:]  # the last cell may go on
            if cut_at:
                yield cells(df.iloc[:cut_at])
        if rest is not None and len(rest):
            yield cells(rest)

    return run


def candidates(classes: DataFrame, n: int, depth: int, threshold: float, clear: float) -> DataFrame:
    """node, component of classes that are likely to be similar to another one; ``n`` classes."""
    prefix = F.xxhash64("tree", F.expr(f"substring(key, 1, {4 * depth})")).alias("trie")
    tries = written(sorted_tries(classes, n, depth).select(prefix, "key", "node"), "tries")
    sizes = tries.groupBy("trie").agg(F.count("*").alias("n")).where("n > 1")
    cells = blocked(tries.join(sizes, "trie"), "trie", "n", NODE_BLOCK).join(classes.select("node", "sketch"), "node").select("trie", "a", "b", "block", "key", "node", "sketch")
    cut = threshold - clear * np.sqrt(threshold * (1 - threshold) / (TREES * DEPTH))
    sorted_cells = cells.repartition("trie", "a", "b").sortWithinPartitions("trie", "a", "b", "key", "node")
    edges = sorted_cells.mapInPandas(likely(float(cut)), "a long, b long")
    out = written(components(edges).select(F.col("id").alias("node"), "component"), "groups")
    dropped(tries)
    return out


def filtered(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` whose (h1, h2) may be among those of ``keys``: all that are, and few others unless the filter is full."""
    places = keys.select(F.explode(F.array("h1", "h2")).alias("h"))
    word = F.shiftrightunsigned("h", 6) % FILTER_WORDS
    got = places.select(word.alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # FILTER_WORDS rows at most
    bits = np.zeros(FILTER_WORDS, "u8")
    bits[got["word"].to_numpy("i8")] = got["bits"].to_numpy("i8").view("u8")
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def among(one: pd.Series, two: pd.Series) -> pd.Series:
        ok = np.ones(len(one), bool)
        for h in (one.to_numpy("i8").view("u8"), two.to_numpy("i8").view("u8")):
            ok &= (shared.value[(h >> np.uint64(6)) % np.uint64(FILTER_WORDS)] >> (h & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(ok)

    return rows.where(among("h1", "h2"))


def verified(docs: DataFrame, classes: DataFrame, groups: DataFrame, threshold: float, depth: int) -> DataFrame:
    """Rows kind 'n' (node, n: texts, docs: documents linked), 'e' (node, other: a forest of links) and 's' (n links, of which some share x is modelled as lost)."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    total = groups.count()
    bins = -(-total // GROUP_BLOCK) or 1
    where = groups.join(sizes, "component").join(classes.select("node", "doc_id", "h1", "h2", "copies"), "node")
    small = F.col("size") <= GROUP_BLOCK
    where = where.withColumn("cell", F.when(small, -1 - F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")))
    where = written(where, "where")
    texts = filtered(usable(docs), where).join(where, ["doc_id", "h1", "h2"])

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i : i + 500]
                h, bounds = shingles(part["text"].tolist())
                own = [np.unique(h[x:y]).astype("i8") for x, y in zip(bounds, bounds[1:], strict=False)]
                yield part[["cell", "size", "component", "node", "copies"]].assign(items=own)

    rows = texts.select("cell", "size", "component", "node", "copies", "text").mapInPandas(sets, "cell long, size long, component long, node long, copies long, items array<long>")
    cells = blocked(rows, "cell", f"if(size > {GROUP_BLOCK}, size, 1)", GROUP_BLOCK)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        cross = pdf["a"].iloc[0] != pdf["b"].iloc[0]
        node, block, copies, group = (pdf[c].to_numpy() for c in ("node", "block", "copies", "component"))
        lengths = np.fromiter(map(len, pdf["items"]), "i8", len(pdf))
        with np.errstate(over="ignore"):  # equal items of different groups don't meet
            items = np.concatenate(list(pdf["items"])).astype("u8") ^ (np.repeat(group, lengths).astype("u8") * PRIME)
        owner = np.repeat(np.arange(len(pdf)), lengths)
        kinds, flat = np.unique(items, return_inverse=True)
        order = np.argsort(flat, kind="stable")
        posting, begins = owner[order], np.searchsorted(flat[order], np.arange(len(kinds) + 1))
        df = np.diff(begins)
        n_text, n_docs = np.zeros(len(pdf), "i8"), np.zeros(len(pdf), "i8")
        left, right, values = [], [], []
        ends = np.cumsum(lengths)
        for i in range(len(pdf)):
            own = flat[ends[i] - lengths[i] : ends[i]]
            own = own[df[own] > 1]
            if not len(own):
                continue
            runs = df[own]
            reach = posting[np.repeat(begins[own] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())]
            shared = np.bincount(reach[reach > i], minlength=0)
            j = np.flatnonzero(shared)
            if cross:
                j = j[block[j] != block[i]]
            jaccard = shared[j] / (lengths[i] + lengths[j] - shared[j])
            hit = jaccard >= threshold
            j = j[hit]
            n_text[i] += len(j)
            n_docs[i] += copies[j].sum()
            n_text[j] += 1
            n_docs[j] += copies[i]
            if len(j):
                left.append(np.full(len(j), i))
                right.append(j)
                values.append(jaccard[hit])
                if sum(map(len, left[1:])) > 500_000:
                    left, right = ([x] for x in forest(np.concatenate(left), np.concatenate(right)))
        linked = n_text > 0
        out = [pd.DataFrame({"kind": "n", "node": node[linked], "n": n_text[linked], "docs": n_docs[linked]})]
        if left:
            a, b = forest(np.concatenate(left), np.concatenate(right))
            s = np.concatenate(values)
            met = modelled_recall(s, depth)
            out.append(pd.DataFrame({"kind": "e", "node": node[a], "other": node[b]}))
            out.append(pd.DataFrame({"kind": ["s"], "node": [0], "n": [len(s)], "x": [float((1 / met - 1).sum())]}))
        return pd.concat(out).reindex(columns=["kind", "node", "n", "docs", "other", "x"]).astype({"n": "Int64", "docs": "Int64", "other": "Int64"})

    out = written(cells.groupBy("cell", "a", "b").applyInPandas(run, "kind string, node long, n long, docs long, other long, x double"), "links")
    dropped(where)
    return out


def with_sketch(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        for b in batches:
            yield b.assign(sketch=[sketch(s).tobytes() for s in b["sig"]])

    return rows.mapInPandas(run, "doc_id long, h1 long, h2 long, copies long, node long, sig binary, sketch binary")


def measured(rows: DataFrame, sample: pd.DataFrame, classes: DataFrame, found: DataFrame) -> float:
    """The mean share of the links to other texts that were found, over the sampled documents that have any; 1 if none has, or if there are no documents."""
    if not len(sample):  # of an empty table only
        return 1.0
    texts = rows.where("size(near) > 0").select("h1", "h2", F.explode("near").alias("k")).distinct()
    own = rows.sparkSession.createDataFrame(sample.assign(k=range(len(sample)))[["k", "h1", "h2"]], "k int, h1 long, h2 long")
    true = texts.groupBy("k").agg((F.count("*") - 1).alias("n")).where("n > 0").join(own, "k")  # a text is near to itself
    got = F.broadcast(true).join(classes.select("h1", "h2", "node"), ["h1", "h2"], "left").join(found.where("kind = 'n'").groupBy("node").agg(F.sum("n").alias("got")), "node", "left")
    share = got.agg(F.avg(F.least(F.lit(1.0), F.coalesce("got", F.lit(0)) / F.col("n")))).first()[0]
    return 1.0 if share is None else float(share)


def links(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal texts (node, doc_id: their smallest, h1, h2, copies), link counts (node, n_texts, n_docs) and groups (node, group)."""
    sample = sampled(usable(docs))
    rows = written(signed(usable(docs), Sample(sample["text"].tolist()), threshold), "signatures")
    equal = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("copies")).select("copies", F.col("first.row").alias("row"))
    classes = written(with_sketch(rows.join(equal, "row").select("doc_id", "h1", "h2", "copies", F.col("row").alias("node"), "sig")), "classes")
    n, depth, clear = classes.count(), first_depth(threshold, target), CLEAR
    while True:
        groups = candidates(classes, n, depth, threshold, clear)
        found = verified(docs, classes, groups, threshold, depth)
        got = found.where("kind = 's'").agg(F.sum("n").alias("n"), F.sum("x").alias("lost")).first()
        enough = not got["n"] or got["lost"] <= (1 - target) * (got["n"] + got["lost"])
        share = measured(rows, sample, classes, found) if enough or depth == 1 else 0.0
        if share >= target:
            break
        if depth == 1:
            raise RuntimeError(f"prefixes of one value found {share:.4f} of the sampled documents' links, less than {target}: the signatures have too few trees for this threshold")
        depth, clear = depth - 1, clear + 1
        dropped(groups, found)
    dropped(rows, groups)
    counts = found.where("kind = 'n'").groupBy("node").agg(F.sum("n").alias("n_texts"), F.sum("docs").alias("n_docs"))
    joined = components(found.where("kind = 'e'").select(F.col("node").alias("a"), F.col("other").alias("b"))).select(F.col("id").alias("node"), F.col("component").alias("group"))
    return classes.drop("sig", "sketch"), counts, joined


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, class_id (the smallest id of its group), n_links (other documents linked directly, copies among them), n_text_links (other texts) and copy_of (the smallest id with the same text)."""
    classes, counts, joined = links(docs, threshold)
    nodes = classes.join(counts, "node", "left").join(joined, "node", "left").select("doc_id", "h1", "h2", F.coalesce("group", "node").alias("group"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), (F.coalesce("n_docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    nodes = written(nodes, "nodes")
    least = nodes.groupBy("group").agg(F.min("doc_id").alias("class_id"))
    nodes = nodes.join(least, "group").select("h1", "h2", F.col("doc_id").alias("copy_of"), "class_id", "n_links", F.col("n_texts").alias("n_text_links"))
    has_id = F.col("doc_id").isNotNull()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.when(has_id, h).alias(n) for h, n in zip(text_keys(), ("h1", "h2"), strict=True)])
    got = ids.join(nodes, ["h1", "h2"], "left")
    return got.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"), F.coalesce("copy_of", "doc_id").alias("copy_of"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group of similar texts, that of the smallest id; rows without id or words stay."""
    classes, _, joined = links(docs, threshold)
    best = classes.join(joined, "node", "left").withColumn("group", F.coalesce("group", "node"))
    best = best.groupBy("group").agg(F.min(F.struct("doc_id", "node")).alias("first")).select(F.col("first.node").alias("node"))
    own = fresh(docs, "h1", "h2", "kept_id", "kept_h1", "kept_h2", "more")
    kept = classes.join(best, "node").select(*[c.alias(n) for c, n in zip((F.col("doc_id"), F.col("h1"), F.col("h2"), F.col("copies") > 1), own[2:], strict=True)])
    h1, h2, kept_id, kept_h1, kept_h2, more = map(F.col, own)
    keyed = docs.withColumns(dict(zip(own, text_keys(), strict=False)))
    out = keyed.where("doc_id is not null").join(kept, (F.col("doc_id").cast("long") == kept_id) & (h1 == kept_h1) & (h2 == kept_h2))
    once = out.where(~more).select(docs.columns)
    several = out.where(more).dropDuplicates(["doc_id", *own[:2]]).select(docs.columns)  # copies may have the same id
    wordless = docs.where(F.col("doc_id").isNull() | ~has_words())
    return once.unionByName(several).unionByName(wordless)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their groups and links, by shingles of five words and a similarity of 0.8 or more."""
    return jaccard_join(documents(spark, sf_dir))
