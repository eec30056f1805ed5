"""The pipeline's stages on the smallest tables, each held against its own operator or brute force."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import packing, quality, toxicity
from quantloom.llm.common import documents, written

from .test_operators import brute_links

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_stages(spark, results):
    docs = documents(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "duplicates", "packing"]
    before = docs
    for got in results[:3]:
        assert got.columns == docs.columns
        assert got.exceptAll(before).count() == 0  # rows are kept or go, and don't change
        before = got
    assert results[0].count() < docs.count()


def test_duplicates_and_packing(results):
    rows = [(r.doc_id, r.text) for r in results[1].collect()]
    kept = {r.doc_id for r in results[2].collect()}
    links = brute_links(rows)
    assert not [1 for a, b in links if rows[a][0] in kept and rows[b][0] in kept]
    linked = {k for pair in links for k in pair}
    assert {rows[k][0] for k in range(len(rows)) if k not in linked} <= kept
    pieces = results[3].collect()
    assert {r.doc_id for r in pieces} == kept
    used = collections.Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= packing.CAPACITY


def test_rejected_documents_score_below_the_thresholds(spark, results):
    labels = quality.training_labels(spark, SF, "quality", quality.FOLDS, quality.HELD_OUT)
    scores = {r.doc_id: r.s for r in quality.quality(documents(spark, SF), labels, "s").collect()}
    assert {i for i, s in scores.items() if s >= quality.THRESHOLD} == {r.doc_id for r in results[0].collect()}


def test_toxicity_keeps_what_its_scorer_passes(spark, results):
    labels = quality.training_labels(spark, SF, "toxic", toxicity.FOLDS, toxicity.HELD_OUT)
    scores = {r.doc_id: r.s for r in toxicity.toxicity(results[0], labels, "s").collect()}
    assert {i for i, s in scores.items() if s < toxicity.THRESHOLD} == {r.doc_id for r in results[1].collect()}


def test_clashing_names_pass_through_the_stages(spark):
    docs = documents(spark, SF).limit(40).withColumn("score", F.lit("own")).withColumn("Score_", F.lit(3))
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.toxicity_stage, corpus_pipeline.duplicates_stage):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and {(r.score, r.Score_) for r in got.collect()} == {("own", 3)}
    pieces = corpus_pipeline.packing_stage(spark, docs.withColumns({c: F.lit("own") for c in ("piece", "start", "sequence_id", "offset")}), SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()} and all(r.offset >= 0 for r in pieces)


def test_an_empty_table_passes_through_the_stages(spark):
    docs = documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() == 0


def test_the_whole_run_equals_the_stages(spark, results):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == sorted((r.doc_id, r.piece, r.length) for r in results[3].collect())
