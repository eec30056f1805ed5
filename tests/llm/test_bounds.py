"""Samples that very long texts can't end, and calibration by few labels."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import jaccard, lm, toxicity
from quantloom.llm.common import fold


@pytest.mark.parametrize("long_id", [3, 11, 29])
def test_a_very_long_text_does_not_end_the_audit_sample(spark, long_id):
    docs = spark.range(40).withColumnRenamed("id", "doc_id").withColumn("text", F.when(F.col("doc_id") == long_id, F.repeat(F.lit("long "), 1_200_000)).otherwise(F.concat(F.lit("some words of text "), F.col("doc_id"))))
    got = jaccard.sampled(jaccard.usable(docs))
    assert sorted(got["doc_id"]) == [i for i in range(40) if i != long_id]


def test_an_audit_sample_is_never_empty(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "AUDIT_SHINGLES", 4)
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f"), (3, "")], "doc_id long, text string")
    assert list(jaccard.sampled(jaccard.usable(docs))["doc_id"]) == [2]
    assert not len(jaccard.sampled(jaccard.usable(docs.limit(0))))


def test_a_recall_below_the_target_at_the_last_depth_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "measured", lambda *a: 0.5)
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 3}") for i in range(6)], "doc_id long, text string")
    with pytest.raises(RuntimeError, match="0.5000"):
        jaccard.jaccard_join(docs)


def test_a_very_long_text_does_not_end_the_toxic_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_CHARS", 20_000)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, F.repeat(F.lit("long "), 1_000)).otherwise(F.repeat(F.lit("word "), 10)).alias("text"))
    got = toxicity.sample_texts(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y")))
    assert sorted(got["doc_id"]) == [i for i in range(60) if i % 7]
    assert got.groupby("y")["weight"].sum().tolist() == pytest.approx([30, 30])


def test_the_toxic_sample_reaches_the_driver_in_parts(spark, monkeypatch):
    """No frame of all texts: they come one after the other by rising id, and the words are let go before training."""
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, F.lit("good day ")).otherwise(F.lit("foul day ")), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y"))
    monkeypatch.setattr(type(docs), "toPandas", lambda self: pytest.fail("all texts at once"))
    read, seen = [], []
    got = toxicity.sample_texts(docs, labels, read.extend)
    assert got["doc_id"].tolist() == list(range(200)) and [int(t.split()[-1]) for t in read] == list(range(200))
    monkeypatch.setattr(toxicity.Network, "highs", lambda self, windows, grams, real=toxicity.Network.highs: (seen.append((len(windows.vocabulary), len(windows.kinds))), real(self, windows, grams))[1])
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert seen and set(seen) == {(0, 0)}
    assert max(scores[i] for i in range(0, 200, 2)) < min(scores[i] for i in range(1, 200, 2))


def test_all_windows_by_passes_equal_one_table(monkeypatch):
    """Gates held for a pass's words give the logits that a table of the whole vocabulary gives."""
    windows = toxicity.Windows(" ".join(f"w{(i * k) % 37}" for k in range(90)) for i in range(1, 12))
    grams = toxicity.grams_of_all([w.replace("w", "ab") + "x" for w in windows.vocabulary])
    net = toxicity.Network()
    table = net.gate_table(net.inputs(*grams)[0])
    monkeypatch.setattr(toxicity, "PASS", 7)
    assert net.highs(windows, grams) == pytest.approx(net.logits(windows[np.arange(len(windows.starts))], table), abs=1e-5)


@pytest.mark.parametrize("n, low, high", [(60, 0.55, 1.0), (20_000, 0.0, 1.0)])
def test_calibration_of_few_and_many_labels(n, low, high):
    """Scores rise with raw scores, are near the labels' shares, and with 30 labels of either class still pass the threshold."""
    rng = np.random.default_rng(1)
    y = np.repeat([0.0, 1.0], n // 2)
    raw = rng.normal(size=n) + 3 * y
    at, value = toxicity.calibration(raw, y, np.ones(n))
    assert (np.diff(np.interp(np.linspace(-3, 6, 50), at, value)) >= 0).all()
    assert np.interp(5, at, value) >= toxicity.THRESHOLD and np.interp(-2, at, value) <= 0.2
    truth = 1 / (1 + np.exp(-3 * (np.array([0.5, 1.5, 2.5]) - 1.5)))
    assert np.abs(np.interp([0.5, 1.5, 2.5], at, value) - truth).max() < (0.25 if n == 60 else 0.08)


def test_calibration_without_one_class_or_with_one_score():
    for y in (np.zeros(5), np.ones(5)):
        _, value = toxicity.calibration(np.arange(5.0), y, np.ones(5))
        assert np.isfinite(value).all() and (0 <= value).all() and (value <= 1).all()
    _, value = toxicity.calibration(np.full(4, 2.0), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert np.isfinite(value).all()


def test_the_language_model_scores_rows_without_an_id(spark):
    """An id of '' is held out, as an id whose remainder is 0 is; so equal texts have equal scores."""
    held = next(i for i in range(1_000, 2_000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(i, f"some words of number {i % 3}") for i in range(30)] + [(None, "some words of no number"), (held, "some words of no number"), (None, None)]
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), fold("doc_id", 10) == 0).collect()
    assert len(got) == len(rows)
    none = {r.n_tokens: r.score for r in got if r.doc_id is None}
    (same,) = [r.score for r in got if r.doc_id == held]
    assert set(none) == {1, 6} and none[6] == pytest.approx(same) and all(s < 0 for s in none.values())
