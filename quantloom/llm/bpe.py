"""BPE encoding and decoding with word ends.

Texts are normalised (NFC, white space, lower case) and split as the tokenizers file says. Each word
is merged with a priority queue of merge ranks over a doubly linked list of symbols; entries whose
symbols have changed since are skipped. Decoding joins the vocabulary strings. Words are kept in a
bounded cache, since a few words make up most of a text.

Defined cases: null and empty texts have no ids, and the digests of an empty string; rows are
independent, so repeated rows and ties have equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, held, trim
from .tokens import Generations, bytes_of_chars, tokenizer_path

SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
SEPARATORS = regex.compile("[\x1c-\x1f]")  # white space to Python, but not to Unicode
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")


class WordBPE:
    """Encoder and decoder of a tokenizers file with byte-level words and a word-end suffix."""

    def __init__(self, name: str = "word_bpe_49k.json", limit: int = 120_000_000):
        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        chars = {b: c for c, b in bytes_of_chars().items()}
        self.inner = [self.vocab.get(chars[b]) for b in range(256)]
        self.last = [self.vocab.get(chars[b] + self.suffix) for b in range(256)]
        self.is_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.word = Generations(self._word, limit // 2)
        self.chunk = Generations(self._chunk, limit)

    def merge(self, word: str) -> list[int]:
        """Ids of one normalised word."""
        raw = word.encode()
        ids = [i for i in [*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]] if i is not None]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        merges = self.merges
        queue = []
        for at in range(n - 1):
            m = merges.get((ids[at], ids[at + 1]))
            if m:
                queue.append((m[0], at, m[1], ids[at], ids[at + 1]))
        heapq.heapify(queue)
        while queue:
            _, at, new, left, right = heapq.heappop(queue)
            nxt = after[at]
            if ids[at] != left or nxt < 0 or ids[nxt] != right:
                continue  # stale
            ids[at], ids[nxt] = new, -1
            after[at] = far = after[nxt]
            if far >= 0:
                before[far] = at
                m = merges.get((new, ids[far]))
                if m:
                    heapq.heappush(queue, (m[0], at, m[1], new, ids[far]))
            back = before[at]
            if back >= 0:
                m = merges.get((ids[back], new))
                if m:
                    heapq.heappush(queue, (m[0], back, m[1], ids[back], new))
        return [i for i in ids if i >= 0]

    def _word(self, word: str) -> tuple[int, ...]:
        return tuple(self.merge(word))

    def _chunk(self, chunk: str) -> tuple[str, str]:
        ids = self._ids(chunk)
        return " ".join(map(str, ids)), self.decode(ids)

    def _ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for part in self.is_special.split(chunk) if self.is_special and "<" in chunk else [chunk]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if part.isascii():
                part = part.lower()
            else:  # character by character: a final sigma isn't told apart
                part = "".join(map(str.lower, unicodedata.normalize("NFC", part)))
            for word in WORDS.findall(part):
                out += self.word[word]
        return out

    def chunks(self, text: str) -> list[str]:
        return [c for c in SPACES.split(text) if c] if SEPARATORS.search(text) else text.split()

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self._ids(c)]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])

    def both(self, text: str) -> tuple[str, str]:
        """The decimal ids joined by spaces, and the decoded text."""
        got = [x for x in map(self.chunk.__getitem__, self.chunks(text)) if x[0]]
        return " ".join([x[0] for x in got]), " ".join([x[1] for x in got])


def loaded(name: str) -> WordBPE:
    """One encoder, with its cache, for each worker process."""
    return held(("word", name), lambda: WordBPE(name))


def bpe_texts(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, ids, decoded: the ids and the decoded text of each whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        bpe = loaded(name)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": ids, "decoded": [bpe.decode(i) for i in ids]})

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        bpe = loaded(name)
        for b in batches:
            rows = []
            for text in b["text"]:
                ids, decoded = bpe.both(text or "")
                rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of all documents."""
    return bpe_digests(documents(spark, sf_dir))
