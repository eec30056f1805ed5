"""Ids of whole texts, fast: in one call, or word by word from a bounded cache where there are few."""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array
from sys import getsizeof

ENTRY = 100  # bytes of a dict's entry


class Generations(dict):
    """A dict that computes missing values and keeps at most two generations of ``limit`` bytes.

    Values over a hundredth of that are computed anew each time.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older, self.bytes = make, limit, {}, 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        size = ENTRY + getsizeof(key) + getsizeof(value) + (sum(map(getsizeof, value)) if isinstance(value, tuple) else 0)
        if size > self.limit // 100:
            return value
        if self.bytes + size > self.limit:
            self.older = dict(self)
            self.clear()
            self.bytes = 0
        self.bytes += size
        self[key] = value
        return value


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file is on this machine; a path is returned as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBPE:
    """Byte-level BPE ids as little-endian 32-bit bytes, equal to those of the tokenizers file ``name``.

    Texts are encoded whole. Only those of a few words are cut at spaces between characters that are no
    white space, where a new pre-token always starts, and their words are kept: in longer texts a word in
    seven is new, and that costs more than the cache saves.
    """

    FEW = 4

    CUT = re.compile(r"(?<=\S) (?=\S)")
    ODD = re.compile(r" \s|\s |^ | $")

    def __init__(self, name: str = "byte_bpe_50k.json", limit: int = 40_000_000):
        import numpy as np
        import tiktoken
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        alphabet = bytes_of_chars()
        skip = set(self.special)
        ranks = {bytes(alphabet[c] for c in token): i for token, i in self.whole.get_vocab().items() if token not in skip}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.array = (lambda ids: array("I", ids).tobytes()) if sys.byteorder == "little" and array("I").itemsize == 4 else lambda ids: np.array(ids, "<u4").tobytes()
        self.after_space = Generations(lambda part: self.array(self.encode(" " + part)), limit)

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.array(self.whole.encode(text, add_special_tokens=False).ids)
        if text.count(" ") > self.FEW:
            return self.array(self.encode(text))
        parts = self.CUT.split(text) if self.ODD.search(text) else text.split(" ")
        return self.array(self.encode(parts[0])) + b"".join(map(self.after_space.__getitem__, parts[1:]))


#: The public pattern by which byte-level BPE splits texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def bytes_of_chars() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
