"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input is a hashed word vector beside the squashed sum of its hashed character n-gram vectors.
Windows of words run through a GRU in either direction, are pooled by attention and end in one
probability. A document's raw score is that of its highest window, all overlapping windows of the
whole text counting. Training reads all windows of a bounded sample of labelled documents, whose words
are kept as numbers: in each epoch it learns from the windows that the network itself finds highest (in
toxic documents) or most mistaken (in others), and from some others; a part of the sample tells which epoch's network ranks
documents best. Raw scores are calibrated on labelled documents that the network didn't learn from: by
isotonic regression, in which a logistic curve stands for a few more labels.

Defined cases: a null or empty text, or one without words, has the raw score NO_WORDS, below all
others; a document with several labels counts with the largest, and one with several texts is learnt
from by one of them; without labels of both classes every score is the share of label 1 (0 without
labels); repeated rows have equal scores; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, dropped, fold, held, trim, written
from .quality import bounded, isotonic, training_labels

WINDOW, STRIDE = 32, 16  # words
FIT_DOCUMENTS = 4000  # of either label, at most, by a hash of the id
EPOCHS, MOST_EPOCHS, BATCH, RATE = 4, 8, 256, 0.01
STEPS = 1200  # at least, by more epochs and, of few windows, by several passes in each
VALID, PATIENCE = 6, 2  # one text in so many only tells the best epoch; epochs without a better one that end the training
CLEAN = 12_000  # windows of other documents, on average, that an epoch takes at random
TABLE_RATE = 0.1  # of the learning rate, for the hashed vectors
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 17, 1 << 17
RARE = 3  # words and n-grams of fewer sampled documents keep a zero vector
GRAMS = (3, 4, 5)
CACHED_WORDS = 200_000
ROWS = 1024  # windows scored together; their arrays stay in the processor's cache
PASS = 16 * ROWS  # windows whose words' gates are held at a time while training looks at all windows
PART = 20_000  # words whose n-grams are looked at together
SAMPLE_PARTS = 64  # of the sampled texts, which reach the driver one part at a time
THRESHOLD = 0.7
NO_WORDS = -40.0  # the raw score of a text without words
FOLDS, HELD_OUT = 3, 1
BINS = 1000
FIT_CHARS = 60_000_000  # of the sample's texts, at most; a twentieth of it of one text
PRIOR, LOW = 2.0, -12.0  # labels that the logistic curve adds to a bin; raw scores below count as LOW for it
CALIBRATE = 100_000  # labelled documents that scores are calibrated on, at most

WORDS = re.compile(r"[^\W\d_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def window_starts(n: int) -> range:
    """Where the overlapping windows of n words start; the last one reaches the end."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its hash row; hash rows of all character n-grams, one word after the other, and where each word's begin."""
    raw = [f"<{w}>".encode("utf-8", "replace") for w in words]
    sizes = np.fromiter(map(len, raw), "i8", len(raw))
    data = np.frombuffer(b"".join(raw), "u1").astype("u8") + np.uint64(1)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(raw)), sizes)
    left = ends[owner] - np.arange(len(data))  # bytes up to the word's end
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(sizes.max()), MIX, "u8"))
        whole = np.add.reduceat(data * power[(sizes[owner] - left)], ends - sizes)
        word_rows = ((whole * MIX) >> np.uint64(40)).astype("i4") % WORD_ROWS
        found, owners = [], []
        for n in GRAMS:
            h = np.full(max(0, len(data) - n + 1), n, "u8")
            for k in range(n):
                h = h * MIX + data[k : k + len(h)]
                h ^= h >> np.uint64(29)
            ok = left[: len(h)] >= n
            found.append(((h[ok] * MIX) >> np.uint64(40)).astype("i4") % CHAR_ROWS)
            owners.append(owner[: len(h)][ok])
    rows, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")  # every word has an n-gram: it has 3 bytes at least
    return word_rows, rows[order], np.searchsorted(owners[order], np.arange(len(raw)))


def grams_of_all(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``grams_of``, a part of the words at a time."""
    parts = [grams_of(words[i : i + PART]) for i in range(0, len(words), PART)]
    shifts = np.cumsum([0, *(len(p[1]) for p in parts[:-1])])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] + s for p, s in zip(parts, shifts, strict=True)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = np.exp(-x)
    y += 1
    return np.reciprocal(y, out=y)


class Network:
    """Parameters, forward and backward passes."""

    def __init__(self, seed: int = 5, kind: str = "f4"):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        p = {"word": rng.normal(size=(WORD_ROWS, WORD_DIM)) * 0.02, "char": rng.normal(size=(CHAR_ROWS, CHAR_DIM)) * 0.02}
        for side in "fb":
            p |= {f"w{side}": rng.normal(size=(d, 3 * h)) / np.sqrt(d), f"u{side}": rng.normal(size=(h, 3 * h)) / np.sqrt(h), f"c{side}": np.zeros(3 * h)}
        p |= {"att": rng.normal(size=2 * h) * 0.1, "out": rng.normal(size=2 * h) * 0.3, "bias": np.zeros(1)}
        self.p = {k: v.astype(kind) for k, v in p.items()}
        self.kind = kind
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.step = 0
        self.common: dict[str, np.ndarray] = {}  # rows of the hashed vectors that are learnt

    def prime(self, kinds: list[np.ndarray], label: np.ndarray, grams: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Start the first component of the hashed vectors at the log odds of label 1 given the word or n-gram; ``kinds``: each document's distinct words."""
        word_rows, gram_rows, begins = grams
        sizes = np.diff(np.r_[begins, len(gram_rows)])
        hits = {k: np.zeros(len(self.p[k])) for k in ("word", "char")}
        total = {k: np.zeros(len(self.p[k])) for k in ("word", "char")}
        for words, y in zip(kinds, label, strict=True):
            starts = np.cumsum(sizes[words]) - sizes[words]
            of_grams = gram_rows[np.repeat(begins[words] - starts, sizes[words]) + np.arange(sizes[words].sum())]
            for name, rows in (("word", word_rows[words]), ("char", of_grams)):
                rows = np.unique(rows)
                hits[name][rows] += y
                total[name][rows] += 1
        for name in hits:
            base = label.mean()
            share = (hits[name] + 4 * base) / (total[name] + 4)
            odds = np.log(share / (1 - share)) - np.log(base / (1 - base))
            self.p[name][:, 0] = odds * 0.4
            self.common[name] = total[name] >= RARE
            self.p[name][~self.common[name]] = 0

    def inputs(self, word_rows: np.ndarray, gram_rows: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input vectors of distinct words, and their n-gram counts' roots."""
        ends = np.r_[begins[1:], len(gram_rows)]
        root = np.sqrt(ends - begins).astype(self.kind)[:, None]
        parts = [slice(i, i + PART) for i in range(0, len(begins), PART)]
        chars = np.tanh(np.concatenate([np.add.reduceat(self.p["char"][gram_rows[begins[x][0] : ends[x][-1]]], begins[x] - begins[x][0]) for x in parts]) / root)
        return np.hstack([self.p["word"][word_rows], chars]), root

    def parts(self, grams: tuple[np.ndarray, np.ndarray, np.ndarray], kinds: np.ndarray) -> Iterator[np.ndarray]:
        """Input vectors of the words ``kinds`` (rising rows of ``grams``), a part of them at a time."""
        word_rows, gram_rows, begins = grams
        for i in range(0, len(kinds), PART):
            x = kinds[i : i + PART]
            sizes = np.where(x + 1 < len(begins), begins[np.minimum(x + 1, len(begins) - 1)], len(gram_rows)) - begins[x]
            starts = np.cumsum(sizes) - sizes
            yield self.inputs(word_rows[x], gram_rows[np.repeat(begins[x] - starts, sizes) + np.arange(sizes.sum())], starts)[0]

    def highs(self, windows: Windows, grams: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The logits of all windows; gates are held for the words of PASS windows, not for the whole vocabulary."""
        found, place = [np.zeros(0, self.kind)], np.zeros(len(grams[0]), "i4")
        for index in windows.parts(PASS):
            place[:] = 0
            place[index[index >= 0]] = 1
            kinds = np.flatnonzero(place)
            place[kinds] = np.arange(len(kinds))
            table, at = np.empty((len(kinds), 6 * HIDDEN), self.kind), 0
            for x in self.parts(grams, kinds):
                table[at : at + len(x)] = self.gate_table(x)
                at += len(x)
            index = np.where(index >= 0, place[np.maximum(index, 0)], -1)
            found += [self.logits(index[i : i + ROWS], table) for i in range(0, len(index), ROWS)]
        return np.concatenate(found)

    def recur(self, rows: np.ndarray, table: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (T, 2H, N) of both directions, stepped together; rows: (T, N) of the gates in ``table`` (K, 6H). Windows are the last axis, so that operations run over long rows."""
        last, lo = len(rows) - 1, 2 * HIDDEN
        halves, u = table.reshape(-1, 3 * HIDDEN), np.stack([self.p["uf"].T, self.p["ub"].T])  # forward gates in even rows, backward ones in odd rows
        h = np.zeros((2, HIDDEN, rows.shape[1]), self.kind)
        out = np.empty((len(rows), 2, HIDDEN, rows.shape[1]), self.kind)
        for t in range(len(rows)):
            now = np.ascontiguousarray(halves[2 * rows[[t, last - t]] + [[0], [1]]].transpose(0, 2, 1))
            back = u @ h
            zr = sigmoid(now[:, :lo] + back[:, :lo])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = r * back[:, lo:]
            n += now[:, lo:]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            m = mask[[t, last - t]][:, None]
            if keep is not None:
                keep.append((h, z, r, n, back[:, lo:], m))
            h = new if m.all() else np.where(m, new, h)
            out[t, 0], out[last - t, 1] = h
        return out.reshape(len(rows), 2 * HIDDEN, -1)

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention over time: logits, weights, pooled states."""
        a = np.where(mask, self.p["att"] @ states, -1e9)
        a = np.exp(a - a.max(axis=0))
        a = a * mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,thn->hn", a, states)
        return self.p["out"] @ pooled + self.p["bias"], a, pooled

    def gate_table(self, x: np.ndarray) -> np.ndarray:
        """Gates of either direction for each input vector."""
        return np.hstack([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]]).astype(self.kind)

    def logits(self, index: np.ndarray, table: np.ndarray) -> np.ndarray:
        """For windows (N, T) of rows of ``table``, -1 where there is no word."""
        mask = (index >= 0).T
        return self.pool(self.recur(np.maximum(index, 0).T, table, mask), mask)[0]

    def gradients(self, index: np.ndarray, y: np.ndarray, weight: np.ndarray, grams: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[float, dict[str, tuple]]:
        """The mean loss on windows of words (rows of ``grams``), and its gradient: for each parameter the rows concerned, and their part."""
        p, h = self.p, HIDDEN
        kinds, at = np.unique(np.maximum(index, 0), return_inverse=True)
        word_rows, gram_rows, begins = grams
        ends = np.r_[begins[1:], len(gram_rows)]
        sizes = ends[kinds] - begins[kinds]
        starts = np.cumsum(sizes) - sizes
        own = gram_rows[np.repeat(begins[kinds] - starts, sizes) + np.arange(sizes.sum())]
        x, root = self.inputs(word_rows[kinds], own, starts)
        mask = (index >= 0).T
        rows = at.reshape(index.shape).T
        keep: list[tuple] = []
        states = self.recur(rows, self.gate_table(x), mask, keep)
        logit, a, pooled = self.pool(states, mask)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        d_logit = ((sigmoid(logit) - y) * weight / weight.sum()).astype(self.kind)
        g["out"], g["bias"][0] = pooled @ d_logit, d_logit.sum()
        d_pooled = p["out"][:, None] * d_logit
        d_a = np.einsum("hn,thn->tn", d_pooled, states)
        d_score = a * (d_a - (a * d_a).sum(axis=0))
        g["att"] = np.einsum("tn,thn->h", d_score, states)
        d_states = a[:, None] * d_pooled + d_score[:, None] * p["att"][:, None]
        u, last = np.stack([p["uf"], p["ub"]]), len(rows) - 1
        d_u, d_h = np.zeros_like(u), np.zeros((2, h, rows.shape[1]), self.kind)
        d_gates = np.zeros((2, 3 * h, *rows.shape), self.kind)
        for t in range(last, -1, -1):
            before, z, r, n, back_n, m = keep.pop()
            d_h = d_h + np.stack([d_states[t, :h], d_states[last - t, h:]])
            d_new = np.where(m, d_h, 0)
            d_n = d_new * (1 - z) * (1 - n * n)
            d_z = d_new * (before - n) * z * (1 - z)
            d_r = d_n * back_n * r * (1 - r)
            d_back = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_u += before @ d_back.transpose(0, 2, 1)
            d_h = np.where(m, d_new * z, d_h) + u @ d_back
            for side, at_t in enumerate((t, last - t)):
                d_gates[side, : 2 * h, at_t], d_gates[side, 2 * h :, at_t] = d_back[side, : 2 * h], d_n[side]
        d_x = np.zeros_like(x)
        for i, side in enumerate("fb"):
            flat = d_gates[i].reshape(3 * h, -1)
            summed = np.stack([np.bincount(rows.reshape(-1), v, len(kinds)) for v in flat], axis=1).astype(self.kind)
            g["u" + side], g["w" + side], g["c" + side] = d_u[i], x.T @ summed, flat.sum(axis=1)
            d_x += summed @ p["w" + side].T
        d_chars = d_x[:, WORD_DIM:] * (1 - x[:, WORD_DIM:] ** 2) / root
        out: dict[str, tuple] = {k: (slice(None), v) for k, v in g.items()}
        for k, at, d in (("word", word_rows[kinds], d_x[:, :WORD_DIM]), ("char", own, np.repeat(d_chars, sizes, axis=0))):
            touched = np.flatnonzero(np.bincount(at))
            place = np.zeros(len(p[k]), "i4")
            place[touched] = np.arange(len(touched))
            at = place[at]
            out[k] = (touched, np.stack([np.bincount(at, v, len(touched)) for v in d.T], axis=1).astype(self.kind))
        return float((np.logaddexp(0, np.where(y == 1, -logit, logit)) * weight).sum() / weight.sum()), out

    def train(self, index: np.ndarray, y: np.ndarray, weight: np.ndarray, grams: tuple[np.ndarray, np.ndarray, np.ndarray], rate: float) -> float:
        """One step of Adam; gives the mean loss before it."""
        loss, g = self.gradients(index, y, weight, grams)
        self.step += 1
        for k, (rows, d) in g.items():
            if k in ("word", "char"):
                learnt = self.common[k][rows] if k in self.common else slice(None)
                self.move(k, rows[learnt], d[learnt], rate * TABLE_RATE)
            else:
                self.move(k, rows, d, rate)
        return loss

    def move(self, k: str, rows: slice | np.ndarray, g: np.ndarray, rate: float) -> None:
        """One step of Adam for some rows."""
        first, second = (m[rows] for m in self.moments[k])
        first = first + 0.1 * (g - first)
        second = second + 0.01 * (g * g - second)
        self.moments[k][0][rows], self.moments[k][1][rows] = first, second
        first *= rate / (1 - 0.9**self.step)
        second /= 1 - 0.99**self.step
        first /= np.sqrt(second) + 1e-8
        self.p[k][rows] -= first


class Windows:
    """All overlapping windows of some texts; words are kept as numbers, 4 bytes each."""

    def __init__(self, texts: Iterator[str]):
        self.vocabulary: dict[str, int] = {}
        flat, starts, ends, docs, at = [np.zeros(1, "i4")], [], [], [], 1
        self.kinds: list[np.ndarray] = []  # distinct words of each text
        for d, text in enumerate(texts):
            words = words_of(text)
            flat.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words), "i4", len(words)))
            self.kinds.append(np.unique(flat[-1]))
            if words:
                own = window_starts(len(words))
                starts.append(at + np.array(own))
                ends.append(np.full(len(own), at + len(words)))
                docs.append(np.full(len(own), d))
            at += len(words)
        self.flat = np.concatenate(flat)
        self.starts, self.ends, self.docs = (np.concatenate(x or [np.zeros(0, "i8")]) for x in (starts, ends, docs))

    def __getitem__(self, rows) -> np.ndarray:
        """Windows as rows of word numbers, -1 beyond the text."""
        place = self.starts[rows][:, None] + np.arange(WINDOW)
        return np.where(place < self.ends[rows][:, None], self.flat[np.minimum(place, len(self.flat) - 1)], -1)

    def parts(self, size: int = ROWS) -> Iterator[np.ndarray]:
        for i in range(0, len(self.starts), size):
            yield self[np.arange(i, min(i + size, len(self.starts)))]


def concordance(score: np.ndarray, label: np.ndarray) -> float:
    """How often a document of label 1 scores above one of label 0; ties count half."""
    kinds, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    ones = int(label.sum())
    return float((rank[label == 1].sum() - ones * (ones + 1) / 2) / max(1, ones * (len(label) - ones)))


def fit_network(windows: Windows, label: np.ndarray, primed: bool = True) -> tuple[Network, np.ndarray]:
    """A network from all windows of some texts and the texts' labels, and its raw scores of the texts that it didn't learn from (others: not a number).

    One text in VALID tells which epoch was the best. The words themselves are let go: ``windows`` keeps their numbers.
    """
    words = list(windows.vocabulary)
    windows.vocabulary.clear()
    grams = grams_of_all(words)
    del words
    net, rng = Network(), np.random.default_rng(3)
    valid = np.arange(len(label)) % VALID == VALID - 1
    if len(np.unique(label[valid])) < 2 or len(np.unique(label[~valid])) < 2:
        valid[:] = False
    if primed:
        net.prime([k for k, v in zip(windows.kinds, valid, strict=True) if not v], label[~valid], grams)
    windows.kinds.clear()
    y, doc = label[windows.docs], windows.docs
    own = ~valid[doc]
    clean = min(0.3, CLEAN / max(1, int((y == 0).sum())))
    epochs, epoch, found, least = EPOCHS, 0, (-1.0, 0), None
    while True:
        trim()
        if epoch or not primed:
            high = net.highs(windows, grams)
        else:
            odds = np.concatenate([x[:, 0] + x[:, WORD_DIM] for x in net.parts(grams, np.arange(len(grams[0])))])
            high = np.concatenate([np.where(index >= 0, odds[np.maximum(index, 0)], -9).max(axis=1) for index in windows.parts()])
        best = np.full(len(label), -np.inf)
        np.maximum.at(best, doc, high)
        if epoch:
            now = concordance(best[valid], label[valid]) if valid.any() else float(epoch)
            if now >= found[0]:
                found, least = (now, epoch), {k: v.copy() for k, v in net.p.items()}
                unseen = np.where(valid, np.where(np.isfinite(best), best, NO_WORDS), np.nan)
            if epoch == epochs or epoch - found[1] >= PATIENCE:
                net.p = least
                return net, unseen
        top, hard, hardest = np.quantile(high[own & (y == 1)], 0.5), np.quantile(high[own & (y == 0)], 0.8), np.quantile(high[own & (y == 0)], 0.95)
        rest = (high > hard) & (rng.random(len(y)) < 2 * clean) | (high > hardest) | (rng.random(len(y)) < clean)
        use = np.flatnonzero(own & np.where(y == 1, (high >= best[doc]) | (high > max(top, hard)), rest))
        if not epoch:
            steps = -(-len(use) // BATCH)
            epochs = min(MOST_EPOCHS, max(EPOCHS, -(-STEPS // steps)))
            passes = max(1, STEPS // (epochs * steps))
        weight = np.where(y == 1, 1.0, max(1.0, y[use].sum()) / max(1.0, (1 - y[use]).sum())).astype("f4")
        order = np.concatenate([rng.permutation(use) for _ in range(passes)])
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            net.train(windows[part], y[part].astype("f4"), weight[part], grams, RATE * (1 - epoch / epochs) ** 2)
        epoch += 1


class Scorer:
    """Raw scores of texts, with gates of known words kept in a bounded table."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.net = Network()
        self.net.p = parameters
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), "f4")

    def rows(self, words: list[str]) -> list[int]:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS and self.known:
            self.forget()
            new = list(dict.fromkeys(words))
        if new:
            at = len(self.known)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
            if at + len(new) > len(self.table):
                bigger = np.zeros((2 * (at + len(new)), 6 * HIDDEN), "f4")
                bigger[:at] = self.table[:at]
                self.table = bigger
            for i in range(0, len(new), PART):
                part = new[i : i + PART]
                self.table[at + i : at + i + len(part)] = self.net.gate_table(self.net.inputs(*grams_of(part))[0])
        return list(map(self.known.__getitem__, words))

    def raw(self, texts: list[str]) -> np.ndarray:
        """The highest window of each whole text; texts are taken in groups of about 50,000 words."""
        out = np.full(len(texts), NO_WORDS)
        pending: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            words = words_of(text) if text else []
            for lo in range(0, len(words), 48_000):  # long texts in parts that overlap by a window
                pending.append((i, words[lo : lo + 48_000 + WINDOW]))
                size += len(pending[-1][1])
                if size > 50_000:
                    self.flush(pending, out)
                    pending, size = [], 0
        self.flush(pending, out)
        return out

    def flush(self, pending: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        if not pending:
            return
        rows = np.array(self.rows([w for _, ws in pending for w in ws]), "i4")
        starts, ends, docs, at = [], [], [], 0
        for i, ws in pending:
            got = [at + s for s in window_starts(len(ws))]
            starts += got
            docs += [i] * len(got)
            ends += [at + len(ws)] * len(got)
            at += len(ws)
        place = np.array(starts)[:, None] + np.arange(WINDOW)
        index = np.where(place < np.array(ends)[:, None], rows[np.minimum(place, len(rows) - 1)], -1)
        high = np.concatenate([self.net.logits(index[i : i + ROWS], self.table) for i in range(0, len(index), ROWS)])
        np.maximum.at(out, docs, high)


def sample_texts(docs: DataFrame, marked: DataFrame, read: Callable[[Iterator[str]], object] | None = None) -> pd.DataFrame:
    """doc_id, y and weight (labelled documents that it stands for) of a bounded sample of labelled documents, by rising id; ``read`` gets their whole texts in this order.

    FIT_DOCUMENTS of either label at most, by a hash of the id, and FIT_CHARS characters: a text that would exceed these is left out, others after it aren't.
    The driver holds one of SAMPLE_PARTS parts of the texts at a time.
    """
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"doc_id": [], "y": [], "weight": []})
    share = "case " + " ".join(f"when y = {y} then {min(1.0, FIT_DOCUMENTS / max(1, n))}" for y, n in counts.items()) + " end"
    chosen = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < F.expr(f"({share}) * 1000000"))
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(chosen), "doc_id")
    picked = written(texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "sample")
    sizes = picked.select("doc_id", "y", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id", F.lit(19)), "doc_id").collect()  # 2 x FIT_DOCUMENTS rows at most
    room, fits = FIT_CHARS, []
    for r in sizes:
        if r["n"] <= min(room, FIT_CHARS // 20):
            room -= r["n"]
            fits.append((r["doc_id"], r["y"]))
    got = pd.DataFrame(sorted(fits), columns=["doc_id", "y"])
    if read and fits:
        ids = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i, _ in fits], "doc_id long"))
        parts = picked.join(ids, "doc_id").repartitionByRange(SAMPLE_PARTS, "doc_id").sortWithinPartitions("doc_id").select("text")
        read(r["text"] or "" for r in parts.toLocalIterator())
    dropped(picked)
    return got.assign(weight=got["y"].map(counts) / got.groupby("y")["y"].transform("size"))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A rising logistic curve's values at x, fitted to targets that stay off 0 and 1 by what few labels can't tell."""
    ones, all_ = (weight * y).sum(), weight.sum()
    target = y * (ones + 1) / (ones + 2) + (1 - y) / (all_ - ones + 2)
    scale = max(float(np.sqrt(np.average((x - np.average(x, weights=weight)) ** 2, weights=weight))), 1e-9)
    z = np.stack([np.ones(len(x)), (x - np.average(x, weights=weight)) / scale], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        w = weight * p * (1 - p)
        step = np.linalg.solve((z * w[:, None]).T @ z + 1e-3 * np.eye(2), (z * weight[:, None]).T @ (target - p) - 1e-3 * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    b[1] = max(b[1], 0.0)
    return 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))


def calibration(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic steps of labels ``y`` (means of ``n``) by raw scores: each bin counts with PRIOR labels more, as the logistic curve has them, so that few labels don't end in steps of a few documents."""
    curve = logistic(np.maximum(x, LOW), y, n)
    at, value = isotonic(x, (n * y + PRIOR * curve) / (n + PRIOR), n + PRIOR)
    return at, value


class Model:
    """A network and the calibration of its raw scores; or a constant."""

    def __init__(self, constant: float | None = None, parameters=None):
        self.constant, self.parameters, self.token = constant, parameters, uuid.uuid4().hex
        self.at, self.value = np.array([-6.0, 6.0]), np.array([0.0, 1.0])

    def raw(self, texts: list[str]) -> np.ndarray:
        return held(self.token, lambda: Scorer(self.parameters.value)).raw(texts)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return np.clip(np.interp(self.raw(texts), self.at, self.value), 0, 1)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the texts of the documents that ``labels`` (doc_id, y) marks."""
    marked = labels.where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    later = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(4)) == 0
    read: list[Windows] = []
    got = sample_texts(docs, marked.where(~later), lambda texts: read.append(Windows(texts)))  # each text goes as soon as its words are numbers
    if got["y"].nunique() < 2:
        return Model(constant=float(got["y"].max()) if len(got) else 0.0)
    label, weight, windows = got["y"].to_numpy("i8"), got["weight"].to_numpy("f8"), read.pop()
    if len(np.unique(label[windows.docs])) < 2:  # no words in the texts of one class
        return Model(constant=float(label.max()))
    docs.sparkSession._jvm.java.lang.System.gc()  # the driver's heap hands back what it has free: training needs memory beside it
    net, unseen = fit_network(windows, label)
    del windows
    model = Model(parameters=docs.sparkSession.sparkContext.broadcast(net.p))  # 8 MB whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        for b in batches:
            yield pd.DataFrame({"raw": model.raw(b["text"].fillna("").tolist()), "y": b["y"]})

    rest = bounded(labels.where(later), CALIBRATE, 29)
    raw = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(rest), "doc_id").mapInPandas(run, "raw double, y double")
    bins = raw.groupBy(F.floor(F.greatest("raw", F.lit(-40.0)) * (BINS / 80)).alias("bin")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).collect()  # about BINS rows at most
    own = np.isfinite(unseen)  # of the sample, what only told the best epoch
    x, y, n = (np.concatenate([np.array([b[k] for b in bins], "f8"), more]) for k, more in (("x", unseen[own]), ("y", label[own].astype("f8")), ("n", weight[own])))
    if len(x) > 1:
        model.at, model.value = calibration(x, y, n)
    return model


def scorer(model: Model) -> Callable[[Column], Column]:
    """The score as a function of the text column; other columns stay where they are."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(model.score(t.fillna("").tolist()), dtype="f8")
        trim()

    return lambda text: score(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1."""
    return docs.withColumn(name, scorer(fit(docs, labels))(F.col("text")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of all documents."""
    got = toxicity(documents(spark, sf_dir).select("doc_id", "text"), training_labels(spark, sf_dir, "toxic", FOLDS, HELD_OUT))
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
