"""Chat formatting with a loss mask that is aligned by offsets.

A conversation is rendered as a whole: each turn is ``<|turn|>`` role ``<|says|>`` text ``<|end|>``.
Inside roles and texts, control strings (of this template and of common others) are broken by an
escape character, reversibly, so none of them stands in a text. The rendered conversation is encoded
once with offsets, the three marks being tokens of their own, which no text token crosses. Token
spans and the sorted spans of the assistant's texts are intersected by binary search; tokens inside
such a span carry the loss.

Defined cases: a null text is empty, a null role is the empty role; turns are ordered by (turn, role,
text), nulls first; repeated rows are turns of their own; conversations with a null id form one; an
empty table gives the conversations added by the caller only; columns other than conv_id, turn, role
and text are not read. A conversation is read as a sorted stream of rows and rendered in parts of
bounded length, cut between turns, where no token crosses either.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held
from .tokens import tokenizer_path

#: The marks of the template, and control strings of other public templates.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
CONTROL = [
    TURN, SAYS, END,
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<|startoftext|>", "<|endoftext|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|begin_of_text|>", "<|end_of_text|>",
]
ESCAPE = "␛"
PART = 400_000  # characters rendered at once
TOKENIZER = "byte_bpe_50k.json"

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(ESCAPE + "([01])")


def escape(text: str) -> str:
    """The escape character becomes itself and 0; a control string gets itself and 1 after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + "1" + m[0][1:], text.replace(ESCAPE, ESCAPE + "0"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE if m[1] == "0" else "", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns, and the span of each text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + SAYS, escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at = spans[-1][1] + len(END)
    return "".join(out), spans


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the sorted spans; offsets: rows (from, to)."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    which = np.searchsorted(spans[:, 0], offsets[:, 0], "right") - 1
    inside = spans[np.maximum(which, 0)]
    return (which >= 0) & (offsets[:, 0] < inside[:, 1]) & (offsets[:, 1] <= inside[:, 1])


def loaded(name: str):
    """The tokenizer, with the template's marks as tokens of their own, for each worker process."""

    def make():
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(tokenizer_path(name))
        t.no_truncation()
        t.no_padding()
        t.add_special_tokens([AddedToken(x, normalized=False) for x in (TURN, SAYS, END)])
        return t

    return held(("chat", name), make)


def formatted(turns: list[tuple[str, str]], name: str = TOKENIZER) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The text, token ids, offsets and loss mask of one conversation, or of a run of its turns."""
    text, spans = render(turns)
    got = loaded(name).encode(text, add_special_tokens=False)
    offsets = np.array(got.offsets, "i8").reshape(-1, 2)
    own = np.array([s for s, (role, _) in zip(spans, turns, strict=True) if role == "assistant" and s[1] > s[0]], "i8").reshape(-1, 2)
    return text, np.array(got.ids, "i8"), offsets, loss_mask(offsets, own)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns that a formatted text was made of."""
    return [(unescape(role), unescape(body)) for role, _, body in (t.removesuffix(END).partition(SAYS) for t in text.split(TURN)[1:])]


def masked_text(text: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """The characters under the mask, once each, unescaped."""
    own = offsets[mask]
    if not len(own):
        return ""
    starts = np.maximum(own[:, 0], np.concatenate([[0], np.maximum.accumulate(own[:, 1])[:-1]]))  # tokens of one character share its offsets
    return unescape("".join([text[a:b] for a, b in zip(starts.tolist(), own[:, 1].tolist(), strict=True) if a < b]))


def runs(batches: Iterator[pd.DataFrame], part: int) -> Iterator[tuple[int | None, bool, list[tuple[str, str]]]]:
    """(conversation, whether it ends, turns) from sorted rows; long conversations come in several runs."""
    now, turns, size, begun = None, [], 0, False
    for b in batches:
        ids = b["conv_id"].astype("object").where(b["conv_id"].notna(), None)
        for conv, role, text in zip(ids, b["role"].fillna(""), b["text"].fillna(""), strict=True):
            if begun and conv != now:
                yield now, True, turns
                turns, size = [], 0
            elif size > part:
                yield now, False, turns
                turns, size = [], 0
            now, begun = conv, True
            turns.append((role, text))
            size += len(text) + len(role)
    if begun:
        yield now, True, turns


def sorted_turns(conversations: DataFrame) -> DataFrame:
    cols = conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "cast(text as string) text")
    return cols.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def chat_format(conversations: DataFrame, name: str = TOKENIZER, part: int = PART) -> DataFrame:
    """conv_id, part, formatted, ids, loss: rendered conversations, in parts of about ``part`` characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = 0
        for conv, ends, turns in runs(batches, part):
            text, ids, _, mask = formatted(turns, name)
            yield pd.DataFrame({"conv_id": pd.array([conv], "Int64"), "part": [k], "formatted": [text], "ids": [ids], "loss": [mask]})
            k = 0 if ends else k + 1

    return sorted_turns(conversations).mapInPandas(run, "conv_id long, part int, formatted string, ids array<long>, loss array<boolean>")


def chat_digests(conversations: DataFrame, name: str = TOKENIZER, part: int = PART) -> DataFrame:
    """What is read back from the formatted conversations: their turns, and the text under the loss mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, n, chars, loss, seen, learnt = [], 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for conv, ends, turns in runs(batches, part):
            text, _, offsets, mask = formatted(turns, name)
            for role, body in parse(text):
                seen.update(f"{role}\n{body}\n".encode())
                n += 1
            own = masked_text(text, offsets, mask)
            learnt.update(own.encode())
            chars, loss = chars + len(text), loss + len(own)
            if ends:
                rows.append((conv, n, seen.hexdigest(), loss, learnt.hexdigest(), chars))
                n, chars, loss, seen, learnt = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            if len(rows) >= 2000:
                yield frame(rows)
                rows = []
        yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        return out.astype({"conv_id": "Int64"})

    return sorted_turns(conversations).mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one (-1) whose texts hold control strings."""
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat_digests(turns.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text").unionByName(more))
