"""Token counts against the tokenizers library."""

import random

import numpy as np
import pytest

from quantloom.llm import counts
from quantloom.llm.tokens import tokenizer_path

NAME = "byte_bpe_50k.json"
ODD = [None, "", " ", "   ", "a", " a  b", "\x1c odd\x1d\x85 text", "🙂🙂 é́ ΣΑΣ İ  ß", "a\n b \n\n  c\t d <|endoftext|>x", "<|endoftext|>", " <|endoftext|><|endoftext|> <|endoftext|", "don't we'll I'm", "x " * 50_000, "漢" * 20_000, "ab" * 30_000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(NAME))
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_splitting_equals_the_library(library):
    rng, splitter = random.Random(3), counts.Splitter(NAME)
    alphabet = [*"ab'sldt \n\t\x1c\x85\xa0é🙂1<|endoftext|>.,漢 ́", "  ", "<|endoftext|>", "'ll", " don't ", " Río, "]
    for _ in range(3_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        block = counts.Block(splitter, 0, 3)
        block.add(1, text)
        pieces = [splitter.pieces(x) for x in block.numbers]
        assert sum(pieces[i] * n for i, n in zip(block.entries[0], block.times[0], strict=True)) == library(text), text


@pytest.mark.parametrize("block, part", [(counts.BLOCK, counts.PART), (40, 1_000)])
def test_counts_equal_the_library(spark, library, monkeypatch, block, part):
    monkeypatch.setattr(counts, "PART", part)
    rows = [*enumerate(ODD), (3, "a"), (3, "a"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1, "p", 2) for i, t in rows], "doc_id long, text string, block long, pretoken string, number int").repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_tokens) for r in counts.token_counts(docs, NAME, block).collect()]
    want = [(i, len((t or "").encode()), library(t or "")) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_documents(spark):
    assert counts.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_pretoken_of_all_texts_comes_once_a_block(spark):
    docs = spark.range(4_000).selectExpr("id doc_id", "concat('the same words ', id) text").coalesce(1)
    table = counts.blocks(docs, NAME, 7, 10_000).where("bucket is not null").collect()
    held = [r.block for r in table if "Ġsame" in counts.words_of(r.pretokens)]
    assert len(held) == len(set(held)) == len({r.block for r in table}) <= 10


def test_packed_numbers():
    numbers = np.array([0, 1, 255, 256, 70_000, 2**32 - 1])
    assert (counts.unpacked(counts.packed(numbers), len(numbers)) == numbers).all()
    assert len(counts.unpacked(counts.packed(numbers[:0]), 0)) == 0


def test_over_the_limit(spark, library):
    got = counts.op11_counts(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i, len(t.encode()), library(t), library(t) > 1024) for i, t in docs.items())
