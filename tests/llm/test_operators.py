"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import ann, bpe, chat, graph, jaccard, lm, neardup, packing, quality, sharding, toxicity
from quantloom.llm.tokens import ByteBPE, Generations, tokenizer_path

DOCS = "doc_id long, text string, size long, score double, id string, shard int"
rng = random.Random(4)
WORDS = ["the", "of", "river", "stone", "Éau", "naïve", "x1", "hill", "wind", "über", "don't", "42"]


def sentence(n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def near(text: str) -> str:
    words = text.split(" ")
    words[len(words) // 2] = "changed"
    return " ".join(words)


BASE = [sentence(rng.randint(1, 120)) for _ in range(60)]
TEXTS = [None, "", "   ", "a", "one two three", sentence(40_000), "\x1c odd\x1d\x85 text", "🙂🙂 é́ ΣΑΣ İ  ß", "a\n b \n\n  c\t d <|endoftext|>x", *BASE, *BASE[:9], *(near(t) for t in BASE if len(t.split()) > 60)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (3, "a"), (None, "no id"), (7, "another text of a repeated id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 0.5, "z", 2) for i, t in ROWS], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def hf(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def test_bpe_equals_the_library(docs, empty):
    t = hf("word_bpe_49k.json")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(docs).collect())
    want = []
    for i, text in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.bpe_digests(empty).count() == 0
    assert {len(r.ids) for r in bpe.bpe_texts(docs.where("doc_id = 3")).collect()} == {1}


def test_byte_ids_equal_the_library():
    t, own = hf("byte_bpe_50k.json"), ByteBPE()
    for _, text in ROWS:
        assert own.ids(text or "") == np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_long_texts_are_encoded_whole():
    """Words of long texts are mostly met once, so they don't go through the cache; white space and marks at the ends and the seams are the library's."""
    t, own = hf("byte_bpe_50k.json"), ByteBPE()
    for seam in (" ", "  ", "\n ", " \n", "\u00a0 ", " \u3000", "\r\n", "\t"):
        text = seam.join(["", *(f"w{i}é'll 12" for i in range(50)), "漢字", ""])
        assert own.ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert not own.after_space


def test_caches_are_bounded_by_bytes():
    cache = Generations(lambda k: k[::-1], 1_000_000)
    for i in range(10_000):
        text = f"{i:05d}" * 400  # 2,000 characters without a space
        assert cache[text] == text[::-1]
        assert cache.bytes <= 1_000_000 and len(cache) + len(cache.older) < 600
    assert cache["x" * 50_000] == "x" * 50_000 and "x" * 50_000 not in cache
    own = ByteBPE(limit=200_000)
    for i in range(3000):
        own.ids("a " + f"{i:x}Z" * 60)
    assert own.after_space.bytes <= 200_000


def sequential(sizes, capacity):
    gaps, n = [], 0
    for size in sorted(sizes, reverse=True):
        i = bisect_left(gaps, size)
        n += i == len(gaps)
        left = (capacity if i == len(gaps) else gaps.pop(i)) - size
        if left:
            insort(gaps, left)
    return n


def test_packing(docs, empty):
    t = hf("byte_bpe_50k.json")
    rows = packing.pack(docs).collect()
    by_seq, texts = collections.defaultdict(list), collections.Counter()
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_seq) == sequential([r.length for r in rows], 2048)
    for i, text in ROWS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = packing.cut_points(len(ids), 2048)
        for k, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            texts[i, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())] += 1
    assert texts == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("sizes", [[1] * 900, [99] * 50 + [1] * 300, [rng.randint(1, 99) for _ in range(800)], [60, 40, 60, 40, 30, 30, 40]])
def test_best_fit_over_many_ranges(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    rows = packing.best_fit(df, 100, sweep_rows=100).collect()
    assert sorted(r.id for r in rows) == list(range(len(sizes)))
    used = collections.Counter()
    for r in rows:
        used[r.bin] += sizes[r.id]
    assert max(used.values()) <= 100
    assert len(used) <= sequential(sizes, 100) * 1.03 + 1


def shingles(text):
    words = (text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_links(rows, threshold=0.8):
    sets = [shingles(t) if i is not None else frozenset() for i, t in rows]
    return [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]


def test_jaccard_join(docs, empty):
    got = jaccard.jaccard_join(docs).collect()
    links = brute_links(ROWS)
    n, parent = collections.Counter(), list(range(len(ROWS)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        n[a] += 1
        n[b] += 1
        parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(ROWS):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = sorted((-1 if i is None else i, -1 if i is None else least[find(k)], n[k]) for k, (i, _) in enumerate(ROWS))
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links) for r in got) == want
    assert jaccard.jaccard_join(empty).count() == 0


def test_one_of_each(docs, empty):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert not brute_links(rows)
    assert {(None, "no id"), (0, None), (1, ""), (2, "   "), (7, "another text of a repeated id")} <= set(rows)
    linked = {k for pair in brute_links(ROWS) for k in pair}
    assert {ROWS[k] for k in range(len(ROWS)) if k not in linked} <= set(rows)
    assert jaccard.one_of_each(empty).count() == 0


def test_large_trie_nodes_and_groups_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "NODE_BLOCK", 7)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        words = list(base)
        words[5 * i] = f"v{i}"
        rows.append((i, " ".join(words)))
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = collections.Counter(x for pair in brute_links(rows) for x in pair)
    assert {r.doc_id: r.n_links for r in got} == {i: n[i] for i in range(40)}
    assert {r.class_id for r in got} == {0}


def test_missed_links_shorten_the_prefixes(spark, monkeypatch):
    g = random.Random(3)
    base = [[f"w{g.randrange(400)}" for _ in range(60)] for _ in range(40)]
    rows = [(2 * i, " ".join(w)) for i, w in enumerate(base)] + [(2 * i + 1, " ".join([*w[:-1], "end"])) for i, w in enumerate(base)]
    real, depths = jaccard.candidates, []

    def poor(classes, n, depth, threshold, clear):
        depths.append((depth, clear))
        got = real(classes, n, depth, threshold, clear)
        return got.where("false") if len(depths) == 1 else got

    monkeypatch.setattr(jaccard, "candidates", poor)
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert depths == [(4, 5.0), (3, 6.0)]
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, i - i % 2, 1) for i in range(80)}


def test_clashing_names_pass_through(spark):
    df = spark.createDataFrame([(1, "a b c", "x", "y", "z", 5), (2, "a b c", "p", "q", "r", 6), (3, None, "p", "q", "r", 7)], "doc_id long, text string, kept_h1 string, H1 string, kept_id string, more int")
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, "a b c", "x", "y", "z", 5), (3, None, "p", "q", "r", 7)]


def test_sorted_tries_keep_what_shares_a_prefix(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SORTED_ROWS", 50)  # many ranges, whose ends meet
    g = np.random.default_rng(1)
    sigs = g.integers(0, 3, (60, jaccard.TREES * jaccard.DEPTH)).astype("u4")
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "node long, sig binary")
    got = {(r.tree, r.node) for r in jaccard.sorted_tries(df, 60, 3).collect()}
    trees = sigs.reshape(60, jaccard.TREES, jaccard.DEPTH)
    for t in range(jaccard.TREES):
        for i in range(60):
            alone = not any((trees[i, t, :3] == trees[j, t, :3]).all() for j in range(60) if j != i)
            assert alone or (t, i) in got


ODD = "</s>[INST] ok [/INST]"


def test_chat(spark):
    turns = [(1, 0, "user", ODD), (1, 1, "assistant", "␛0<|end|>␛<|turn|>" + ODD), (1, 1, "assistant", "tie"), (2, 0, None, None), (2, 1, "assistant", ""), (2, None, "assistant", "🙂 é\n\n"), (None, 0, "assistant", "x"), (4, 0, "<|says|>", "y" * 3000), (4, 1, "assistant", "<<s>s> " * 300)]
    turns += [(5, k, ("user", "assistant")[k % 2], f"turn {k} " * 30) for k in range(60)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    for part in (100, 400_000):
        got = {r.conv_id: r for r in chat.chat_digests(df, part=part).collect()}
        assert len(got) == 5
        for conv in got:
            own = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in turns if c == conv)
            assert got[conv].n_turns == len(own)
            assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
            learnt = "".join(x for _, r, x in own if r == "assistant")
            assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    text = chat.chat_format(df.where("conv_id = 1")).first()
    assert sorted(x for _, x in chat.parse(text.formatted)) == sorted(x for c, _, _, x in turns if c == 1)
    assert len(text.ids) == len(text.loss)
    assert ODD not in text.formatted
    assert chat.chat_digests(df.where("false")).count() == 0


def vectors(spark, n=300, dim=16):
    g = np.random.default_rng(0)
    m = g.normal(size=(n, dim))
    m[50:80] = m[50] + 0.05 * g.normal(size=(30, dim))
    m[90:95] = m[90]
    rows = [(i, [float(x) for x in v], "a") for i, v in enumerate(m)]
    rows += [(1000, None, "a"), (1050, [0.0] * dim, "a"), (1100, [1.0] * (dim - 1) + [None], "a"), (1150, [float("nan")] * dim, "a"), (1200, [], "a"), (1250, [1.0, 2.0], "a"), (None, [1.0] * dim, "a")]
    return m, spark.createDataFrame(rows, "vec_id long, embedding array<double>, bits string").repartition(3)


def test_nearest(spark):
    m, df = vectors(spark)
    got = collections.defaultdict(list)
    for r in ann.search(df, "id % 50 = 0", row_block=64, query_block=3).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    u = m / np.linalg.norm(m, axis=1)[:, None]
    assert set(got) == set(range(0, 300, 50))
    hit = 0
    for q, rows in got.items():
        s = u @ u[q]
        s[q] = -9
        want = sorted(range(len(m)), key=lambda i: (-s[i], i))[:5]
        rows.sort()
        assert [x[0] for x in rows] == [1, 2, 3, 4, 5]
        assert all(abs(score - s[v]) < 1e-12 for _, v, score in rows)
        hit += len(set(want) & {v for _, v, _ in rows})
    assert hit >= 0.9 * 5 * len(got)
    assert ann.search(df.where("false"), "id % 50 = 0").count() == 0


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARD", 40)
    monkeypatch.setattr(neardup, "HOMES", 25)
    monkeypatch.setattr(neardup, "MEMBERS", 60)
    m, df = vectors(spark)
    got = {r.id: r for r in neardup.near_duplicates(df).collect() if r.id is not None}
    u = m / np.linalg.norm(m, axis=1)[:, None]
    link = u @ u.T >= 0.9
    ids, low = graph.roots(*np.nonzero(link))
    for i in range(len(m)):
        assert got[i].n_links == link[i].sum() - 1
        assert got[i].component == low[i]
    for i in (1000, 1050, 1100, 1150, 1200, 1250):
        assert (got[i].n_links, got[i].component) == (0, i)
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_planted_vectors_among_many(spark, monkeypatch):
    g = np.random.default_rng(11)
    m = g.normal(size=(10_000, 24))
    for i in range(0, 600, 2):  # pairs near the threshold
        m[i + 1] = m[i] + 0.35 * g.normal(size=24)
    m[1000:1400] = m[1000] + 0.1 * g.normal(size=(400, 24))  # a dense group
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    audits, real = [], neardup.audit
    monkeypatch.setattr(neardup, "audit", lambda *args: audits.append(real(*args)) or audits[-1])
    got = {r.id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = m / np.linalg.norm(m, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    want = link.sum(axis=1)
    assert (want[:600] > 0).sum() > 200 and audits and audits
    have = np.array([got[i].n_links for i in range(len(m))])
    assert (have <= want).all() and np.mean(have[want > 0] / want[want > 0]) >= 0.98
    low = np.arange(len(m))
    ids, reached = graph.roots(*np.nonzero(link))
    low[ids] = reached
    assert np.mean([got[i].component == low[i] for i in range(len(m))]) > 0.999


def test_repeated_ids_of_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [1.0, 0.05]), (3, [0.0, 1.0]), (4, None)]
    got = [(r.id, r.n_links, r.component) for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got) == [(1, 3, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4)]


def test_components_in_rounds(spark):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {(r.id, r.component) for r in graph.components(df).collect()}
    assert {(r.id, r.component) for r in graph.components(df, one_task=1).collect()} == one
    assert (139, 100) in one and (29, 20) in one


def test_sharding(docs, empty, spark):
    got = sharding.histogram_shard(docs, shards=4, cells=3).collect()
    assert len(got) == len(ROWS)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert want == collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    assert sharding.histogram_shard(empty).count() == 0
    even = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))  # one hot group
    n = collections.Counter(r.shard for r in sharding.histogram_shard(even, shards=8).collect())
    assert len(n) == 8 and max(n.values()) - min(n.values()) <= 0.02 * 5000 / 8 + 2


@pytest.fixture(scope="module")
def marked(spark):
    good = [(i, sentence(rng.randint(30, 90)), 1, 0) for i in range(400)]
    junk = [(400 + i, " ".join([rng.choice(WORDS).upper() + "!!"] * rng.randint(30, 90)), 0, 0) for i in range(120)]
    bad = [(600 + i, sentence(40) + " zorkel" + rng.choice(["ig", "um", "ast"]) + " " + sentence(40), 1, 1) for i in range(160)]
    rows = good + junk + bad
    return spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int"), rows


def test_quality(marked, docs, empty, spark):
    texts, labels, rows = marked
    got = {r.doc_id: r.s for r in quality.quality(texts, labels.where("doc_id % 5 > 0").select("doc_id", F.col("quality").alias("y")), "s").collect()}
    assert np.mean([(got[i] >= 0.3) == (q == 1) for i, _, q, _ in rows if i % 5 == 0]) > 0.97
    none = labels.where("false").select("doc_id", F.col("quality").alias("y"))
    out = quality.quality(docs, none, "s")
    assert out.columns == [*docs.columns, "s"] and {r.s for r in out.collect()} == {0.5}
    model = quality.fit(texts, labels.select("doc_id", F.col("quality").alias("y")))
    scores = docs.select(quality.scorer(model)(F.col("text")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in scores)
    assert quality.quality(empty, none, "s").count() == 0


def test_normal_equations_and_ridge(spark):
    g = np.random.default_rng(3)
    x, y = g.normal(size=(500, 6)), g.integers(0, 2, 500).astype(float)
    features = quality.Cosines(x.mean(axis=0), x.std(axis=0), n=40)
    rows = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(5)
    a, b, n = quality.normal_equations(rows, features, parts=3)
    z = features(x)
    assert n == 500 and np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)


def test_cosines_approximate_a_gaussian_kernel():
    g = np.random.default_rng(4)
    x = g.normal(size=(60, 8))
    features = quality.Cosines(np.zeros(8), np.ones(8), n=20_000, width=3.0)
    z = features(x)[:, 9:]  # beyond the constant and the linear terms
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 3.0**2))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_isotonic():
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 0.6, 0.4, 1]), np.array([1.0, 1, 1, 2]))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [0, 1.5, 3]


def test_gradients():
    net = toxicity.Network(kind="f8")
    words = [f"w{i}" for i in range(30)]
    grams = toxicity.grams_of_all(words)
    g = np.random.default_rng(0)
    index = g.integers(0, 30, (6, toxicity.WINDOW)).astype("i4")
    index[3, 5:] = -1
    y, weight = np.arange(6) % 2, g.random(6) + 0.5
    for k in ("word", "char"):
        net.p[k] *= 20
    _, got = net.gradients(index, y, weight, grams)

    def loss():
        return net.gradients(index, y, weight, grams)[0]

    for k, (rows, d) in got.items():
        p = net.p[k]
        rows = np.arange(len(p)) if isinstance(rows, slice) else rows
        cells = [(r, c) for r in range(len(rows)) for c in (range(p.shape[1]) if p.ndim > 1 else [None])]
        for r, c in [cells[i] for i in g.permutation(len(cells))[:150]]:
            at = rows[r] if c is None else (rows[r], c)
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            want = (up - down) / 2e-5
            assert abs((d[r] if c is None else d[r, c]) - want) < 1e-7 + 1e-5 * abs(want), (k, at)


def test_training_lowers_the_loss():
    net = toxicity.Network()
    grams = toxicity.grams_of_all([f"w{i}" for i in range(30)])
    index = np.random.default_rng(0).integers(0, 30, (16, toxicity.WINDOW)).astype("i4")
    y, weight = (np.arange(16) % 2).astype("f4"), np.ones(16, "f4")
    losses = [net.train(index, y, weight, grams, 0.01) for _ in range(150)]
    assert losses[-1] < 0.2 * losses[0]


def test_all_windows_are_read():
    assert toxicity.window_starts(33)[-1] + toxicity.WINDOW >= 33 and list(toxicity.window_starts(5)) == [0]
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(n)) for n in (0, 1, 5, 32, 33, 47, 48, 49, 1000)]
    windows = toxicity.Windows(iter(texts))
    names = list(windows.vocabulary)
    for d, text in enumerate(texts):
        own = windows[np.flatnonzero(windows.docs == d)]
        words = text.split()
        assert {names[i] for i in own.ravel() if i >= 0} == set(words)
        starts = list(toxicity.window_starts(len(words))) if words else []
        assert [[names[i] for i in row if i >= 0] for row in own] == [words[s : s + toxicity.WINDOW] for s in starts]


def test_toxicity(marked, docs, empty, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 250)  # for time
    texts, labels, rows = marked
    got = {r.doc_id: r.s for r in toxicity.toxicity(texts, labels.where("doc_id % 3 <> 1").select("doc_id", F.col("toxic").alias("y")), "s").collect()}
    assert np.mean([(got[i] >= 0.7) == (x == 1) for i, _, _, x in rows if i % 3 == 1]) > 0.97
    model = toxicity.fit(texts, labels.select("doc_id", F.col("toxic").alias("y")))
    own = {r.text: r.s for r in docs.select("text", toxicity.scorer(model)(F.col("text")).alias("s")).collect()}  # nulls, no words, 40,000 words
    assert all(0 <= s <= 1 for s in own.values()) and own[None] == own[""] == own["   "] == min(own.values())
    clean, start = sentence(40_000), sentence(20)  # text like that of the clean documents; one word decides, wherever it stands
    raw = model.raw([clean[:200_000] + " zorkelig " + clean[200_000:], clean, start + " zorkelig " + start, start + " " + start])
    assert raw[0] > raw[1] + 1 and raw[2] > raw[3] + 1
    none = labels.where("false").select("doc_id", F.col("toxic").alias("y"))
    assert {r.s for r in toxicity.toxicity(docs, none, "s").collect()} == {0.0}
    assert toxicity.toxicity(empty, none, "s").count() == 0


def test_language_model(docs, empty):
    held = F.col("doc_id") % 10 == 0
    got = sorted(lm.lm_scores(docs.where("doc_id is not null"), held).collect(), key=lambda r: (r.doc_id, r.n_tokens, r.base_score))
    rows = [(i, t) for i, t in ROWS if i is not None]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for _, t in rows]
    c = collections.Counter()
    for (i, _), t in zip(rows, tokens):
        if i % 10:
            c.update(t)
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(t), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), sum(c[w] > 0 for w in t)) for (i, _), t in zip(rows, tokens))
    for r, w in zip(got, sorted(want, key=lambda x: x[:3]), strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (w[0], w[1], w[3], n)
        assert abs(r.base_score - w[2]) < 1e-6 and math.isfinite(r.score) and r.score < 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm.lm_scores(empty, held).count() == 0


def test_words_that_are_not_broadcast(docs, monkeypatch):
    held = F.col("doc_id") % 10 == 0
    some = docs.where("doc_id is not null")
    want = sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in lm.lm_scores(some, held).collect())
    for most in (0, 6):
        monkeypatch.setattr(lm, "FREQUENT", most)
        assert sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in lm.lm_scores(some, held).collect()) == want


def test_filters_hold_all_that_is_counted():
    g = np.random.default_rng(2)
    for n in (0, 1, 1000, 200_000):
        keys, level = g.integers(0, 2**63, n).astype("u8"), g.integers(1, 12, n)
        bits = lm.built(keys, level, 20)
        got = lm.probe(bits, keys, 20)
        assert (got >= level).all() and (got > level).mean() < 0.01 if n else not len(got)
        assert np.unpackbits(bits).mean() <= 0.51
    assert len(bits) > 5 * len(lm.built(keys[:20_000], level[:20_000], 20))  # it grows with its entries
    assert not lm.probe(bits, g.integers(0, 2**63, 200_000).astype("u8"), 20).any()


def test_blocks_of_keys():
    g = np.random.default_rng(4)
    keys = np.sort(g.integers(0, 2**64, 5000, dtype="u8"))
    assert (lm.unpacked(lm.packed(keys)) == keys).all()
    assert [b for b, _, _ in lm.cells(keys, np.uint64(60))] == list(range(16))


def language_model(texts):
    """The model's formula on exact dictionaries: a function P(w | h), and the vocabulary."""

    def rounded(count):
        return float(lm.value(lm.levels(np.array([count])))[0])

    c = collections.Counter(p for i, t in texts if i % 10 for p in pairs(t))
    words, total, follow = collections.Counter(), collections.Counter(), collections.Counter()
    for (h, w), n in c.items():
        words[w] += n
        total[h] += rounded(n)
        follow[h] += 1
    n = sum(words.values())

    def p(w, h):
        base = (words[w] + 0.1) / (n + 0.1 * (len(words) + 1))
        if not total[h]:
            return base
        seen = max(rounded(c[h, w]) - lm.DISCOUNT, 0) if c[h, w] else 0
        return seen / total[h] + lm.DISCOUNT * follow[h] / total[h] * base

    return p, words


def pairs(text):
    t = [*text.split(), None]
    return list(zip([None, *t[:-1]], t))


@pytest.mark.parametrize("hot", [1 << 17, 40])
def test_language_model_scores_every_pair(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)  # 40: the pairs of frequent contexts are dealt to several buckets
    monkeypatch.setattr(lm, "LEVEL_PROBES", 24)  # next to no false positives
    g = random.Random(8)
    texts = [(i, " ".join(g.choices([f"w{k}" for k in range(300)], [1 / (k + 1) for k in range(300)], k=g.randint(0, 60)))) for i in range(120)]
    texts.append((10, "w0 never seen w1"))
    rows = lm.lm_scores(spark.createDataFrame([*texts, (3, texts[3][1])], "doc_id long, text string"), F.col("doc_id") % 10 == 0).collect()
    p, words = language_model([*texts, (3, texts[3][1])])
    want = sorted((i, sum(math.log10(min(1.0, p(w, h))) for h, w in pairs(t))) for i, t in [*texts, (3, texts[3][1])])
    got = sorted((r.doc_id, r.score) for r in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert not [(i, s, w) for (i, s), (_, w) in zip(got, want, strict=True) if abs(s - w) > 1e-3]
    for h in [None, "w0", "w1", "w250", "w299", "never"]:  # frequent, rare and unseen contexts
        assert abs(sum(p(w, h) for w in [*words, "unknown"]) - 1) < 1e-9


def test_false_positives_of_a_rare_context_are_bounded():
    g = np.random.default_rng(6)
    vocabulary = 100_000
    probes = lm.FALSE + (vocabulary + 1).bit_length()
    keys = g.integers(0, 2**63, 50_000).astype("u8")
    bits = lm.built(keys, np.ones(len(keys), "i4"), probes)
    assert (1 - lm.DISCOUNT) * np.count_nonzero(lm.probe(bits, g.integers(0, 2**63, vocabulary * 20).astype("u8"), probes)) / 20 < 0.02


def test_near_vectors_that_the_graph_misses(spark, monkeypatch):
    real = neardup.link_pass
    monkeypatch.setattr(neardup, "link_pass", lambda *args: real(*args).where("id % 3 > 0"))
    for block in (4000, 70):
        monkeypatch.setattr(neardup, "BLOCK", block)
        m, df = vectors(spark)
        got = {r.id: r for r in neardup.near_duplicates(df).collect()}
        u = m / np.linalg.norm(m, axis=1)[:, None]
        link = u @ u.T >= 0.9
        low = graph.roots(*np.nonzero(link))[1]
        for i in range(len(m)):
            assert (got[i].n_links, got[i].component) == (link[i].sum() - 1, low[i])


def test_audit_counts_nodes_alike(spark):
    g = np.random.default_rng(5)
    dense, pairs = g.normal(size=64) + 0.01 * g.normal(size=(300, 64)), np.repeat(g.normal(size=(20, 64)), 2, axis=0) + 0.01 * g.normal(size=(40, 64))
    nodes = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(np.vstack([dense, pairs]))], "id long, v array<double>, copies long")
    found = [("n", i, 299) for i in range(300)]
    every = spark.createDataFrame(found + [("n", i, 1) for i in range(300, 340)], "kind string, id long, other long")
    assert neardup.audit(nodes, every, 0.9) == 1.0
    assert neardup.audit(nodes, every.where("id < 300"), 0.9) < 0.9  # all links of the pairs are lost, 40 of 89,740


def test_equal_vectors_are_ranked_by_id():
    g = np.random.default_rng(3)
    for trial in range(150):
        n, dim = (15, 50, 500)[trial % 3], 64
        m = np.vstack([np.repeat(g.normal(size=(1, dim)), n, axis=0), g.normal(size=(200, dim))])
        ids = g.permutation(len(m))
        q = m[:1] + 0.1 * g.normal(size=(1, dim))
        order = g.permutation(len(m))
        m, ids, same = m[order], ids[order], np.sort(ids[:n])
        bits, scalar = ann.encode(m)
        got = ann.nearest(np.array([-1]), q, np.arange(len(m)), ids, m, bits, scalar, 5, 2.6)
        assert [v for _, _, v, _ in got] == same[:5].tolist()


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_products_on_packed_bits(dim):
    g = np.random.default_rng(2)
    m, q = g.normal(size=(50, dim)), g.normal(size=(7, dim))
    bits, _ = ann.encode(m)
    signs = np.unpackbits(bits, axis=1, count=dim).astype(float) * 2 - 1
    planes, code = ann.Planes(q), np.ascontiguousarray(ann.wide(bits).T)
    ones = np.bitwise_count(code).sum(axis=0, dtype="i8")
    for i in range(len(q)):
        off = np.abs(planes.products(i, code, ones) - signs @ q[i] / np.sqrt(dim))
        assert (off <= planes.error()[i] + 1e-9).all()


def test_nearest_with_repeated_ids_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.2]), (7, [0.9, 0.1]), (7, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in sorted(ann.search(df, "id = 0").collect(), key=lambda r: (r.score, r["rank"])):
        got[r["rank"]].append(r.vec_id)
    assert {k: sorted(v) for k, v in got.items()} == {1: [7, 7], 2: [7, 7], 3: [0, 0]}  # either row 0 has three candidates


def test_most_frequent_word_of_a_whole_text():
    text = " ".join(["cheap" if i % 4 == 1 else f"w{i}" for i in range(200)])
    row = dict(zip(quality.STATISTICS, quality.statistics([text])[0]))
    assert abs(row["top"] - math.log1p(50 / 200 * 100)) < 1e-12
