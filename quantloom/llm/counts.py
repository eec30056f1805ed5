"""Token counts without ids.

Texts are split into pre-tokens, which the tokenizer never merges across. A pass over the texts
writes, for each block of them, the block's distinct pre-tokens, and for each document how often it
has which of them. The pre-tokens of all blocks meet in buckets of their hash, where each distinct
one is encoded once for its number of pieces; these numbers are joined back to the blocks, where
each document's frequencies are weighed by them and summed. Ids are never kept.

A block holds a bounded number of characters (or one text), so a pre-token that every text has
comes once a block to its bucket. The number of buckets follows the bytes of all texts. A block's
pre-tokens of a bucket are one row, and a block's documents another one, both compressed.

Defined cases: null and empty texts have no bytes and no tokens; special strings inside a text are
one token each, as the library has it by default; very long texts are split in parts at places
where a pre-token must begin; rows are independent, so repeated rows and ids have a result each; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held, trim, written
from .tokens import ByteBPE, bytes_of_chars, tokenizer_path

BLOCK = 4_000_000  # characters of a block
PART = 1_000_000  # characters of a text that are split at a time
BUCKETS, BUCKET_BYTES = 256, 32_000_000  # buckets at least, and bytes of text a bucket at most
LIMIT = 1024
SPECIAL = " "  # marks special strings among pre-tokens; the byte alphabet has no space
SPACE = "\u0120"  # a space in the byte alphabet
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")  # letters, and a mark: two pre-tokens, of the commonest form
ROWS = "block long, bucket int, words int, pretokens binary, doc_ids array<long>, n_bytes array<long>, n_entries int, entries binary, times binary"
CODEC, SEPARATOR = "zstd", "\0"
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
SCHEMA = pa.schema([(n, KINDS[k]) for n, k in map(str.split, ROWS.split(", "))])


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 by planes of their bytes, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T).tobytes(), CODEC, asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, CODEC, asbytes=True), "u1").reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Splitter:
    """Pre-tokens of texts in the byte alphabet, as the tokenizers file ``name`` splits them."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(tokenizer_path(name))
        if whole.normalizer is not None or type(whole.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError(f"{name} isn't a byte-level tokenizer without a normalizer")
        self.pretokens, self.model = whole.pre_tokenizer.pre_tokenize_str, whole.model
        byte = {b: c for c, b in bytes_of_chars().items()}
        self.bytes = {i: "".join(byte[b] for b in chr(i).encode()) for i in range(192, 256)}
        special = sorted((t.content for t in whole.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = set(special)
        self.is_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def stretches(self, text: str) -> Iterator[str]:
        """The text in special strings and stretches between them, long ones cut where a pre-token must begin."""
        for part in self.is_special.split(text) if self.is_special else [text]:
            at = 0
            while len(part) - at > PART:
                cut = ByteBPE.CUT.search(part, at + PART)
                if cut is None:
                    break
                yield part[at : cut.start()]
                at = cut.start()
            if at < len(part):
                yield part[at:]

    def words(self, stretch: str) -> tuple[str, Counter]:
        """What stands before the first space that begins a pre-token, and how often which run follows such a space."""
        if ByteBPE.ODD.search(stretch[1:]):
            behind = "x" if stretch[0] == " " else ""  # what ends with a letter, so that a word may follow
            first, *rest = ByteBPE.CUT.split(behind + stretch)
            first = first.removeprefix(behind)
        else:
            first, *rest = stretch.split(" ")
        return first, Counter(rest)

    def after_space(self, word: str) -> list[str]:
        """The pre-tokens of a space and ``word``."""
        plain = PLAIN.fullmatch(word)
        if plain:
            letters, mark = plain.groups()
            return [SPACE + letters.translate(self.bytes), mark] if mark else [SPACE + letters.translate(self.bytes)]
        return [x for x, _ in self.pretokens(" " + word)]

    def pieces(self, pretoken: str) -> int:
        return 1 if pretoken.startswith(SPECIAL) else len(self.model.tokenize(pretoken))


class Block:
    """Texts with the pre-tokens they share."""

    def __init__(self, splitter: Splitter, block: int, buckets: int):
        self.splitter, self.block, self.buckets, self.chars = splitter, block, buckets, 0
        self.numbers: dict[str, int] = {}
        self.of_word: dict[str, tuple[int, ...]] = {}
        self.ids: list = []
        self.sizes: list[int] = []
        self.entries: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def numbered(self, pretokens: list[str]) -> tuple[int, ...]:
        return tuple([self.numbers.setdefault(x, len(self.numbers)) for x in pretokens])

    def add(self, doc_id, text: str) -> None:
        times: dict[int, int] = {}
        for stretch in self.splitter.stretches(text):
            if stretch in self.splitter.special:
                (i,) = self.numbered([SPECIAL + stretch])
                times[i] = times.get(i, 0) + 1
                continue
            first, words = self.splitter.words(stretch)
            for i in self.numbered([x for x, _ in self.splitter.pretokens(first)]):
                times[i] = times.get(i, 0) + 1
            for word, n in words.items():
                of = self.of_word.get(word)
                if of is None:
                    of = self.of_word[word] = self.numbered(self.splitter.after_space(word))
                for i in of:
                    times[i] = times.get(i, 0) + n
        self.ids.append(doc_id)
        self.sizes.append(len(text.encode()))
        self.entries.append(np.fromiter(times, np.int64, len(times)))
        self.times.append(np.fromiter(times.values(), np.int64, len(times)))
        self.chars += len(text) + 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row for each bucket's pre-tokens, and one for the documents: the differences between the sorted numbers of (document, pre-token)."""
        order = sorted((zlib.crc32(x.encode()) % self.buckets, x) for x in self.numbers)
        place = np.empty(len(order), np.int64)
        place[[self.numbers[x] for _, x in order]] = range(len(order))
        of_bucket = [(bucket, [x for _, x in run]) for bucket, run in groupby(order, itemgetter(0))]
        lengths = [len(x) for x in self.entries if len(x)]  # of texts that aren't empty, so that differences stay small
        docs = np.repeat(np.arange(len(lengths)), lengths)
        keys = docs * len(order) + place[np.concatenate(self.entries)]
        sort = np.argsort(keys)
        for bucket, words in of_bucket:
            text = SEPARATOR.join(words).encode()
            yield batch(block=self.block, bucket=bucket, words=len(words), pretokens=len(text).to_bytes(8, "little") + pa.compress(text, CODEC, asbytes=True))
        yield batch(block=self.block, doc_ids=self.ids, n_bytes=self.sizes, n_entries=len(keys), entries=packed(np.diff(keys[sort], prepend=0)), times=packed(np.concatenate(self.times)[sort]))


def batch(**values) -> pa.RecordBatch:
    """One row of ROWS."""
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in SCHEMA], schema=SCHEMA)


def blocks(docs: DataFrame, name: str, buckets: int, size: int = BLOCK) -> DataFrame:
    """Rows of both kinds: a block's pre-tokens of a bucket, and a block's documents with how often they have which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        splitter = held(("splitter", name), lambda: Splitter(name))
        first = TaskContext.get().partitionId() << 32  # the same for every attempt
        nth, block = 0, Block(splitter, first, buckets)
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                block.add(doc_id, text.as_py() or "")
                if block.chars >= size:
                    yield from block.rows()
                    nth += 1
                    block = Block(splitter, first + nth, buckets)
        if block.ids:
            yield from block.rows()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ROWS)


def words_of(data: bytes) -> list[str]:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), CODEC, asbytes=True).decode().split(SEPARATOR)


def priced(has: DataFrame, name: str) -> DataFrame:
    """in_block, bucket, words, pieces: the numbers of pieces of the blocks' pre-tokens, each distinct one encoded once."""

    def run(table: pa.Table) -> pa.Table:
        splitter = held(("splitter", name), lambda: Splitter(name))
        known: dict[str, int] = {}
        out = []
        for data in table["pretokens"]:
            words = words_of(data.as_py())
            for x in words:
                if x not in known:
                    known[x] = splitter.pieces(x)
            out.append(packed(np.array([known[x] for x in words])))
        return pa.table({"in_block": table["block"], "bucket": table["bucket"], "words": table["words"], "pieces": pa.array(out, pa.binary())})

    return has.groupBy("bucket").applyInArrow(run, "in_block long, bucket int, words int, pieces binary")


def weighed(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """Each document's frequencies times the numbers of pieces, summed."""

    def run(texts: pa.Table, pieces: pa.Table) -> pa.Table:
        (row,), pieces = texts.to_pylist(), pieces.sort_by("bucket").to_pylist()
        of = np.concatenate([np.zeros(0, np.int64), *(unpacked(x["pieces"], x["words"]) for x in pieces)])
        sums, filled = np.zeros(len(row["doc_ids"]), np.int64), np.flatnonzero(row["n_bytes"])
        if len(of):
            keys = np.cumsum(unpacked(row["entries"], row["n_entries"]))
            np.add.at(sums, filled[keys // len(of)], of[keys % len(of)] * unpacked(row["times"], row["n_entries"]))
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()), "n_tokens": sums})

    return texts.groupBy("block").cogroup(pieces.groupBy("in_block")).applyInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.json", block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row's whole text."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    table = written(blocks(docs, name, max(BUCKETS, -(-size // BUCKET_BYTES)), block), "counts")
    has = table.where("bucket is not null").select("block", "bucket", "words", "pretokens")
    texts = table.where("bucket is null").select("block", "doc_ids", "n_bytes", "n_entries", "entries", "times")
    return weighed(texts, priced(has, name))


def op11_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and bytes of all documents, and whether they exceed a context of 1,024 tokens."""
    return token_counts(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
