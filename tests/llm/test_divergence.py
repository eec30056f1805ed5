"""The divergence audit against plain counting, and its ranking against sorting."""

import collections
import random
import re

import pytest

from quantloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, p int, value long"


def brute(rows, least, top=10):
    times, docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        for t in terms:
            times[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        count = {s: {t: times[lang, s, t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 1_000_000_000 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}  # noqa: B023, E731
        p, q = {s: share(count[s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def audited(spark, rows, least):
    docs = spark.createDataFrame([(i % 5 or None, *r, "x", 1, 2) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in divergence.audit(docs, least).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("part, entries", [(divergence.PART, divergence.ENTRIES), (30, 20)])
def test_audit_equals_plain_counts(spark, monkeypatch, part, entries):
    monkeypatch.setattr(divergence, "PART", part)
    monkeypatch.setattr(divergence.counted, "__defaults__", (entries,))
    rng = random.Random(5)
    words = ["The", "of", "River", "É", "é", "naïve", "漢字", "x1y", "ß-ß", "🙂", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = [(" ".join(rng.choice(words[: rng.randint(4, len(words))]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "B", "é", None, ""])) for _ in range(300)]
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("only twice here", "es", "a"), ("only twice here", "es", None), ("long " * 5_000, "en", "a")] + rows[:20]
    assert audited(spark, rows, 10) == brute(rows, 10)
    assert audited(spark, rows, 2) == brute(rows, 2)


def test_no_documents(spark):
    assert audited(spark, [], 10) == []


@pytest.mark.parametrize("values", ["few", "equal", "mixed"])
def test_radix_selection_equals_sorting(spark, values):
    rng = random.Random(7)
    names = ["a" * i for i in range(1, 40)] + [f"common prefix of all {i}" for i in range(60)] + ["é", "zz", "漢", "🙂", "Z"]
    rows = []
    for g in range(6):
        for name in names[: 3 if values == "few" else len(names)]:
            value = {"few": 5, "equal": 9, "mixed": rng.choice([0, 1, 2**30 - 1, 1024, 1025, rng.randrange(2**30)])}[values]
            rows.append(("en", f"s{g}", name, value))
    got = divergence.highest(spark.createDataFrame(rows, "lang string, source string, term string, value long"))
    want = []
    for g in range(6):
        want += sorted((r for r in rows if r[1] == f"s{g}"), key=lambda r: (-r[3], r[2].encode()))[:10]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_shares_of_huge_counts_are_exact(spark):
    n, total, terms = 10**15, 10**16, 10**6
    (got,) = spark.range(1).select(divergence.share(n, str(total), str(terms))).first()
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)
