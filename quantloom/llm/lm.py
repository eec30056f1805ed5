"""Language-model scoring with a log-frequency Bloom filter.

All words and word pairs of the training texts are counted exactly, by 64-bit hashes: tasks count
locally and send sorted blocks to buckets, which merge them. A pair's bucket follows from its first
word (the context); pairs of a frequent context are dealt to as many buckets as its count asks for, so
that a bucket's work doesn't grow with the corpus. Pair counts are quantised to levels on a logarithmic
scale, and a pair with level j is put into its bucket's Bloom filter once for each level up to j; its
count is read back by probing level after level. Each filter is sized by its entries, so every
counted pair is in one at any size of the input, and the first level has so many probes that false
positives add less than 2 ** -FALSE to the probabilities after any context, whatever the vocabulary.

P(w | h) = max(q(hw) - d, 0) / T(h) + d K(h) / T(h) * (c(w) + 0.1) / (N + 0.1 (V + 1)), with q the
quantised count, T(h) the sum of q and K(h) the number of words over all that follow h: the
probabilities after any context add up to 1. After a context that was never seen, P is the last factor.

The vocabulary (counts, T, K) is exact. Its most frequent words, of bounded number, are broadcast; the
other words and the filters stay in their buckets, since they grow with the corpus. Batches of texts
send their distinct pairs and unknown words there, and the levels come back to the batch.

Defined cases: a null or empty text is its end token alone; without training texts N and V are 0, and
both scores are those of the base; repeated rows are scored alike; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, dropped, fold, trim, written
from .jaccard import PRIME, powers

FOLDS, HELD_OUT = 10, 0
FALSE = 8  # probes of the first level beyond the logarithm of the vocabulary
LEVEL_PROBES = 12  # of each further level
LOAD = 0.5  # share of bits set, by design
FREQUENT = 1 << 20  # words that are broadcast: 24 MB
DISCOUNT = 0.75
BASE = 2**0.5  # of the levels
BUCKET_BYTES = 4 << 20  # of text, for each bucket of counts
HOT = 1 << 17  # tokens: contexts of more are dealt to several buckets
BATCH_BYTES = 8 << 20  # of text, on average, that ask and are scored together
FLUSH = 4_000_000  # tokens that a task counts at once
CHUNK = 1 << 20
PROBED = 1 << 15  # keys that are probed together, so that they stay in the CPU's cache
END = np.uint64(0x5851F42D4C957F2D)

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

Hot = tuple[np.ndarray, np.ndarray]  # sorted contexts, and the number of buckets of each


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * PRIME
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end token included, and where each text's begin (with the end)."""
    raw = [t.translate(LOWER) for t in texts]
    out, counts, lo = [], np.zeros(len(texts), "i8"), 0
    while lo < len(raw):
        hi, size = lo, 0
        while hi < len(raw) and (hi == lo or size + len(raw[hi]) < CHUNK):
            size += len(raw[hi]) + 1
            hi += 1
        data = np.frombuffer(b"\n".join(raw[lo:hi]) + b"\n", "u1")
        blank = SPACE[data]
        edge = np.diff(np.r_[True, blank].astype("i1"))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        text_ends = np.cumsum([len(x) + 1 for x in raw[lo:hi]])
        n = np.bincount(np.searchsorted(text_ends, starts, "right"), minlength=hi - lo)
        power, inverse = powers(len(data))
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum((data.astype("u8") + np.uint64(1)) * power[: len(data)])]
            h = mixed((sums[ends] - sums[starts]) * inverse[starts])
        out.append(np.insert(h, np.cumsum(n), END))
        counts[lo:hi] = n + 1
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, "u8"), np.r_[0, np.cumsum(counts)]


def contexts(t: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The token before each; before the first of a text, the end token."""
    c = np.r_[END, t[:-1]]
    c[bounds[:-1]] = END
    return c


def dealt(context: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the pairs of a hot context in one of its buckets."""
    with np.errstate(over="ignore"):
        return mixed(context + (salt + np.uint64(1)) * PRIME) >> np.uint64(32)


def pair_keys(context: np.ndarray, t: np.ndarray, hot: Hot) -> np.ndarray:
    """32 bits of the context, by which pairs are dealt to buckets, and 32 bits of a hash of both."""
    names, salts = hot
    upper, word = context >> np.uint64(32), mixed(t)
    if len(names):
        at = np.minimum(np.searchsorted(names, context), len(names) - 1)
        some = np.flatnonzero(names[at] == context)
        upper[some] = dealt(context[some], word[some] % salts[at[some]])
    with np.errstate(over="ignore"):
        return (upper << np.uint64(32)) | (mixed(context * np.uint64(3) + word) >> np.uint64(32))


def levels(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and one more for each factor BASE."""
    return (1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9)).astype("i4")


def value(level: np.ndarray) -> np.ndarray:
    """What a level stands for: the least count of it where it has few, else its geometric middle."""
    low = BASE ** (level - 1.0)
    return np.where(level <= 0, 0.0, np.where(low * (BASE - 1) < 1, np.ceil(low - 1e-6), low * np.sqrt(BASE)))


def hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each key at a level: the places of its probes follow from the first, and a step further for each probe."""
    with np.errstate(over="ignore"):
        one = mixed(keys ^ mixed(np.full(1, 0x2003 + level * 0x9E37, "u8")))
        return one, mixed(one + PRIME) | np.uint64(1)


def place(one: np.ndarray, size: int) -> np.ndarray:
    """A place among ``size`` bits, from a hash."""
    return (one >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)


def probes_of(level: int, probes: int) -> int:
    return probes if level == 1 else LEVEL_PROBES


def built(keys: np.ndarray, level: np.ndarray, probes: int) -> np.ndarray:
    """The bytes of a filter that holds ``keys`` at all levels up to their own."""
    n = len(keys) * probes + int((level - 1).sum()) * LEVEL_PROBES
    size = 8 * max(8, int(np.ceil(n / -np.log(1 - LOAD) / 8)))
    bits = np.zeros(size, bool)
    now = 1
    while len(keys):
        for lo in range(0, len(keys), PROBED):
            one, two = hashes(keys[lo : lo + PROBED], now)
            for _ in range(probes_of(now, probes)):
                bits[place(one, size)] = True
                one += two
        now += 1
        keys, level = keys[level >= now], level[level >= now]
    return np.packbits(bits, bitorder="little")


def probe(bits: np.ndarray, keys: np.ndarray, probes: int) -> np.ndarray:
    """The highest level up to which each key is in the filter."""
    out, table = np.zeros(len(keys), "u1"), np.unpackbits(bits, bitorder="little").view(bool)
    for lo in range(0, len(keys), PROBED):
        left, now = np.arange(lo, min(lo + PROBED, len(keys))), 1
        while len(left) and now < 200:
            one, two = hashes(keys[left], now)
            for _ in range(probes_of(now, probes)):
                hit = table[place(one, len(table))]
                if not hit.all():
                    left, one, two = left[hit], one[hit], two[hit]
                one += two
            out[left] = now
            now += 1
    return out


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences, which compress well."""
    return np.diff(keys, prepend=np.uint64(0)).view("u1").reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(8, -1).T).view("u8").ravel(), dtype="u8")


def cells(keys: np.ndarray, up: np.uint64) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys, whose upper bits are their bucket."""
    bucket = keys >> up
    at = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(keys)]
    return [(int(bucket[lo]), lo, hi) for lo, hi in zip(at, at[1:], strict=False) if lo < hi]


def counted(texts: DataFrame, shift: int, keys_of) -> DataFrame:
    """bucket, keys: blocks of locally counted keys; a key's bucket is left out of it, and its count is there instead."""
    up, low, most = np.uint64(64 - shift), np.uint64(shift), (1 << shift) - 1

    def flush(parts: list[np.ndarray]) -> pd.DataFrame:
        keys = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts, keys = np.diff(np.r_[first, len(keys)]), keys[first]
        if counts.max() > most:  # large counts are several entries
            times = -(-counts // most)
            ends = np.cumsum(times) - 1
            rest = counts - (times - 1) * most
            keys, counts = np.repeat(keys, times), np.full(int(times.sum()), most)
            counts[ends] = rest
        entries = (keys << low) | counts.astype("u8")
        rows = [(b, packed(np.sort(entries[lo:hi]))) for b, lo, hi in cells(keys, up)]
        return pd.DataFrame(rows, columns=["bucket", "keys"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        parts: list[np.ndarray] = []
        for b in batches:
            for i in range(0, len(b), 1000):
                parts.append(keys_of(*tokens(encoded(b["text"].iloc[i : i + 1000]))))
                if sum(map(len, parts)) > FLUSH:
                    yield flush(parts)
                    parts = []
        if parts:
            yield flush(parts)

    return texts.select("text").mapInPandas(run, "bucket long, keys binary")


def encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in texts]


def merged(blocks: pd.Series, bucket: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of one bucket and their counts, from its blocks."""
    entries = np.sort(np.concatenate([unpacked(x) for x in blocks]))
    keys, counts = entries >> np.uint64(shift), (entries & np.uint64((1 << shift) - 1)).astype("i8")
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first] | (np.uint64(bucket) << np.uint64(64 - shift)), np.add.reduceat(counts, first)


VOCABULARY = "bucket long, keys binary, counts binary, total binary, back binary"


def count_words(training: DataFrame, shift: int) -> DataFrame:
    """bucket, keys, counts: all words and end tokens."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        k, c = merged(pdf["keys"], bucket, shift)
        return pd.DataFrame({"bucket": [bucket], "keys": [k.tobytes()], "counts": [c.tobytes()]})

    return counted(training, shift, lambda t, bounds: t).groupBy("bucket").applyInPandas(merge, "bucket long, keys binary, counts binary")


def count_pairs(training: DataFrame, shift: int, hot, probes: int) -> DataFrame:
    """bucket, kind: 2, the filter of a bucket's pairs (keys); 3, contexts (keys) of a bucket of words, with the sum of their quantised counts (total) and the number of words that follow (kinds)."""
    up = np.uint64(32 - shift)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        k, c = merged(pdf["keys"], bucket, shift)
        level = levels(c)
        rows = [(bucket, 2, built(k, level, probes).tobytes(), b"", b"")]
        upper = k >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, upper[1:] != upper[:-1]])
        context, total, kinds = upper[first], np.add.reduceat(value(level), first), np.diff(np.r_[first, len(k)])
        names, salts = hot.value
        if len(names):  # what is dealt to several buckets belongs to one context
            own = np.repeat(names, salts.astype("i8"))
            other = dealt(own, np.concatenate([np.arange(int(s), dtype="u8") for s in salts]))
            order = np.argsort(other)
            other, own = other[order], own[order]
            at = np.minimum(np.searchsorted(other, context), len(other) - 1)
            context = np.where(other[at] == context, own[at] >> np.uint64(32), context)
            order = np.argsort(context, kind="stable")
            context, total, kinds = context[order], total[order], kinds[order]
        for b, lo, hi in cells(context, up):
            rows.append((b, 3, context[lo:hi].astype("u4").tobytes(), total[lo:hi].astype("f8").tobytes(), kinds[lo:hi].astype("i8").tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "kind", "keys", "total", "kinds"])

    blocks = counted(training, shift, lambda t, bounds: pair_keys(contexts(t, bounds), t, hot.value))
    return blocks.groupBy("bucket").applyInPandas(merge, "bucket long, kind int, keys binary, total binary, kinds binary")


def with_contexts(words: DataFrame, contexts_: DataFrame) -> DataFrame:
    """VOCABULARY rows: the words with their T (total) and their weight d K / T of falling back (back)."""

    def meet(words: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(words):
            return pd.DataFrame({"bucket": [], "keys": [], "counts": [], "total": [], "back": []}).astype({"bucket": "i8"})
        k = np.frombuffer(words["keys"].iloc[0], "u8")
        c = np.frombuffer(b"".join(own["keys"]), "u4").astype("u8")
        kinds, at = np.unique(c, return_inverse=True)
        total = np.bincount(at, np.frombuffer(b"".join(own["total"]), "f8"), len(kinds))
        n = np.bincount(at, np.frombuffer(b"".join(own["kinds"]), "i8"), len(kinds))
        upper = k >> np.uint64(32)
        place_ = np.minimum(np.searchsorted(kinds, upper), max(len(kinds) - 1, 0))
        found = kinds[place_] == upper if len(kinds) else np.zeros(len(k), bool)
        t = np.where(found, total[place_], 1.0) if len(kinds) else np.ones(len(k))
        back = np.where(found, DISCOUNT * n[place_] / t, 1.0) if len(kinds) else np.ones(len(k))
        return pd.DataFrame({"bucket": words["bucket"], "keys": words["keys"], "counts": words["counts"], "total": [t.astype("f4").tobytes()], "back": [back.astype("f4").tobytes()]})

    return words.groupBy("bucket").cogroup(contexts_.groupBy("bucket")).applyInPandas(meet, VOCABULARY)


def sizes(words: DataFrame) -> tuple[int, int]:
    """N and V."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        for b in batches:
            counts = [np.frombuffer(x, "i8") for x in b["counts"]]
            yield pd.DataFrame({"n": [int(sum(c.sum() for c in counts))], "v": [sum(map(len, counts))]})

    got = words.select("counts").mapInPandas(run, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return int(got["n"] or 0), int(got["v"] or 0)


def least_count(words: DataFrame, most: int) -> int | None:
    """The least count such that at most ``most`` words have it or more; None if even the largest counts are too many."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for vals in b["counts"]:
                c, n = np.unique(np.frombuffer(vals, "i8"), return_counts=True)
                yield pd.DataFrame({"c": c, "n": n})

    steps = words.select("counts").mapInPandas(spread, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    band = F.floor(F.log2("c") * 16)  # counts in bands, so that few rows come back
    at, left = None, most
    for r in steps.groupBy(band.alias("band")).agg(F.sum("n").alias("n"), F.min("c").alias("least")).orderBy(F.desc("band")).collect():
        if r["n"] > left:
            break
        at, left = r["least"], left - r["n"]
    return at


def picked(words: DataFrame, least: int, columns: dict[str, str]) -> list[np.ndarray]:
    """keys, counts and further columns of the words that occur ``least`` times or more, sorted by key."""
    kinds = {"keys": "u8", "counts": "i8", **columns}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        for b in batches:
            keep = [np.frombuffer(x, "i8") >= least for x in b["counts"]]
            yield pd.DataFrame({c: [np.frombuffer(x, kind)[k].tobytes() for x, k in zip(b[c], keep, strict=True)] for c, kind in kinds.items()})

    got = words.select(*kinds).mapInPandas(run, ", ".join(f"{c} binary" for c in kinds)).toPandas()
    out = [np.frombuffer(b"".join(got[c]), kind) for c, kind in kinds.items()]
    order = np.argsort(out[0])
    return [x[order] for x in out]


BLOB = "batch long, ids binary, known binary, times binary, lengths binary, texts binary"


def blobs(docs: DataFrame, batches_: int) -> DataFrame:
    """BLOB rows: compressed texts dealt to batches, equal rows once, with their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids = b["doc_id"].astype("object").where(b["doc_id"].notna(), None)
            rows: dict[int, dict[tuple, int]] = {}
            for batch, doc_id, text in zip(b["batch"].tolist(), ids, b["text"], strict=True):
                own = rows.setdefault(batch, {})
                own[doc_id, text] = own.get((doc_id, text), 0) + 1
            out = []
            for batch, own in rows.items():
                raw = [t.encode("utf-8", "replace") for _, t in own]
                known = np.array([i is not None for i, _ in own])
                out.append((batch, np.array([i or 0 for i, _ in own], "i8").tobytes(), known.tobytes(), np.array(list(own.values()), "i8").tobytes(), np.array(list(map(len, raw)), "i8").tobytes(), squeeze.compress(b"".join(raw))))
            yield pd.DataFrame(out, columns=["batch", "ids", "known", "times", "lengths", "texts"])

    return docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches_))).mapInPandas(run, BLOB)


def opened(pdf: pd.DataFrame) -> tuple[list, np.ndarray, list[bytes]]:
    """Ids, numbers and texts of a batch, in an order that doesn't depend on the rows' order."""
    pdf = pdf.sort_values(["ids", "lengths"], kind="stable")
    ids, known, times, lengths = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in (("ids", "i8"), ("known", bool), ("times", "i8"), ("lengths", "i8")))
    data = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in pdf["texts"])
    ends = np.cumsum(lengths)
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)], times, [data[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def lm_scores(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text; ``held_out`` is a condition on doc_id."""
    context_ = docs.sparkSession.sparkContext
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = int(cols.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    shift = max(8, min(24, (size // BUCKET_BYTES).bit_length()))
    training = cols.where(~held_out)
    words = written(count_words(training, shift), "words")
    n_train, kinds = sizes(words)
    least = least_count(words, FREQUENT)
    probes = FALSE + (kinds + 1).bit_length()
    hot_at = max(HOT, n_train >> 20)  # so hot contexts have at most 2 ** 21 buckets together
    names, counts = picked(words, max(hot_at, least), {}) if least is not None else (np.zeros(0, "u8"), np.zeros(0, "i8"))
    hot = context_.broadcast((names, -(-counts // hot_at).astype("u8") if len(counts) else counts.astype("u8")))
    pairs = written(count_pairs(training, shift, hot, probes), "pairs")
    vocabulary = written(with_contexts(words, pairs.where("kind = 3").select("bucket", "keys", "total", "kinds")), "vocabulary")
    shared = context_.broadcast(picked(vocabulary, least, {"total": "f4", "back": "f4"}) if least is not None else [np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "f4"), np.zeros(0, "f4")])  # FREQUENT words
    dropped(words)
    up, low = np.uint64(64 - shift), np.uint64(shift)
    norm = np.log10(max(n_train + 0.1 * (kinds + 1), 1e-300))
    texts = blobs(cols, 1 + size // BATCH_BYTES)

    def parts_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, bounds, the distinct ones, whether those are among the broadcast words, and the pairs' keys."""
        t, bounds = tokens(raw)
        word, known = distinct(np.r_[t, END]), shared.value[0]
        at = np.minimum(np.searchsorted(known, word), max(len(known) - 1, 0))
        return t, bounds, word, known[at] == word if len(known) else np.zeros(len(word), bool), pair_keys(contexts(t, bounds), t, hot.value)

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        """What a batch has to know: its distinct words that aren't broadcast (kind 1) and its distinct pairs (kind 2), by bucket."""
        _, _, word, known, pair = parts_of(opened(pdf)[2])
        got = [(kind, b, packed(keys[lo:hi] << low)) for kind, keys in ((1, word[~known]), (2, distinct(pair))) for b, lo, hi in cells(keys, up)]
        return pd.DataFrame(got, columns=["kind", "bucket", "keys"]).assign(batch=pdf["batch"].iloc[0])

    def answer(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """The levels of pairs; counts, totals and weights of words; in the order of the keys."""
        none = pd.DataFrame({"batch": [], "kind": [], "bucket": [], "vals": []}).astype({"batch": "i8", "kind": "i4", "bucket": "i8"})
        if not len(asked):
            return none
        top = np.uint64(int(asked["bucket"].iloc[0])) << up
        given = [(unpacked(raw) >> low) | top for raw in asked["keys"]]
        q, ends = np.concatenate(given), np.cumsum(list(map(len, given)))
        if int(asked["kind"].iloc[0]) == 2:
            bits = np.frombuffer(own["keys"].iloc[0], "u1") if len(own) else np.zeros(8, "u1")
            got = [probe(bits, q, probes)]
        else:
            k, c, t, back = (np.frombuffer(own[col].iloc[0] if len(own) else b"", kind) for col, kind in (("keys", "u8"), ("counts", "i8"), ("total", "f4"), ("back", "f4")))
            at = np.minimum(np.searchsorted(k, q), max(len(k) - 1, 0))
            hit = k[at] == q if len(k) else np.zeros(len(q), bool)
            got = [np.where(hit, x[at] if len(k) else 0, other).astype(kind) for x, other, kind in ((c, 0, "i8"), (t, 1, "f4"), (back, 1, "f4"))]
        vals = [b"".join(x[hi - len(own_) : hi].tobytes() for x in got) for own_, hi in zip(given, ends.tolist(), strict=True)]
        return asked[["batch", "kind", "bucket"]].assign(vals=vals)

    def score(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known_k, known_c, known_t, known_b = shared.value
        answers = answers.sort_values("bucket")  # keys are sorted by bucket
        ids, times, raw = opened(pdf)
        t, bounds, word, known, pair = parts_of(raw)
        count, total, back = np.zeros(len(word), "i8"), np.ones(len(word)), np.ones(len(word))
        place_ = np.searchsorted(known_k, word[known])
        count[known], total[known], back[known] = known_c[place_], known_t[place_], known_b[place_]
        given = [(v, len(v) // 16) for v in answers.loc[answers["kind"] == 1, "vals"]]
        count[~known] = np.frombuffer(b"".join(v[: 8 * n] for v, n in given), "i8")
        total[~known] = np.frombuffer(b"".join(v[8 * n : 12 * n] for v, n in given), "f4")
        back[~known] = np.frombuffer(b"".join(v[12 * n :] for v, n in given), "f4")
        at = np.searchsorted(word, t)
        at_c = np.searchsorted(word, contexts(t, bounds))
        at_p = np.unique(pair, return_inverse=True)[1]
        level = np.frombuffer(b"".join(answers.loc[answers["kind"] == 2, "vals"]), "u1")
        seen = np.maximum(value(np.arange(256)) - DISCOUNT, 0)[level]
        p = np.minimum(1.0, seen[at_p] / total[at_c] + back[at_c] * (count[at] + 0.1) / 10**norm)
        n = np.diff(bounds)
        out = pd.DataFrame({
            "doc_id": pd.array(ids, "Int64"), "n_tokens": n, "n_known": np.add.reduceat((count[at] > 0).astype("i8"), bounds[:-1]),
            "base_score": np.add.reduceat(np.log10(count[at] + 0.1), bounds[:-1]) - n * norm, "score": np.add.reduceat(np.log10(p), bounds[:-1]),
        })
        return out.loc[np.repeat(np.arange(len(out)), times)]

    asked = texts.groupBy("batch").applyInPandas(ask, "kind int, bucket long, keys binary, batch long")
    filters = pairs.where("kind = 2").select("kind", "bucket", "keys", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("total"), F.lit(None).cast("binary").alias("back"))
    own = vocabulary.select(F.lit(1).alias("kind"), "bucket", "keys", "counts", "total", "back").unionByName(filters)
    answers = asked.groupBy("kind", "bucket").cogroup(own.groupBy("kind", "bucket")).applyInPandas(answer, "batch long, kind int, bucket long, vals binary")
    out = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents, learnt from those not held out."""
    return lm_scores(documents(spark, sf_dir), fold("doc_id", FOLDS) == HELD_OUT)
