"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters the network as character and word inputs: a vector of the word and
the mean and the largest of the vectors of its character n-grams. These vectors
are trained with the network. The first component of a vector starts from how
much its word or n-gram leans towards toxic documents, which for a training
document is counted on other folds than its own, the others from small random
numbers; ``leanings=False`` starts all of them so. A run of word characters that
is longer than ``LETTERS``, as in text without spaces, is read as overlapping
pieces of ``PIECE`` characters that cover all of it. A piece is known by its
n-grams, so that unspaced text is judged well only if the labelled texts hold
some. The network reads windows of ``WINDOW`` words that overlap by half; a
document scores as its highest window. Everything is numpy; the input side of
the gates is multiplied out once for each distinct word.

The model is fitted on at most ``max_toxic`` plus ``max_clean`` labelled
documents, chosen by a hash of the id, with whole texts. Scoring covers every
window of every text.

Cases: null and empty texts are scored as a window without words; repeated rows
score alike; documents with more than one label count as toxic if one says so;
without labels of both classes every score is 0; columns other than the text
never enter a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.llm import common

TOKEN = re.compile(r"\w+")
WINDOW, STRIDE = 32, 16
HIDDEN, VECTOR = 8, 4
#: The word's vector, the largest and the mean of its n-grams' vectors, and a flag for being a word.
INPUTS = 3 * VECTOR + 1
FOLDS = 4
CACHE_WORDS = 100_000
#: Spread of the vectors at first, and how far a step moves those that it meets.
START, RATE = 0.05, 0.02
#: Documents with which a word or n-gram moves half as far as it would.
DOUBT = 20
#: Windows that go through the network at once.
BATCH = 2048


#: Lengths of the character n-grams.
GRAMS = (4, 5)
#: Runs over so many characters are read in pieces; lengths of a piece and of the way to the next. No n-gram falls between pieces.
LETTERS, PIECE, STEP = 40, 16, 8
#: Words that are coded at once.
CODED = 50_000
#: Odd multiplier of the rolling hashes, and one that spreads their bits.
ROLL, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bits of the filter that says which hashes may be in a table.
FILTER_BITS = 22


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case, long runs in pieces; the last piece ends where its run does."""
    out = []
    for w in TOKEN.findall((text or "").lower()):
        if len(w) <= LETTERS:
            out.append(w)
        else:
            out += [w[i : i + PIECE] for i in range(0, len(w) - PIECE, STEP)]
            out.append(w[-PIECE:])
    return out


@dataclass
class Coded:
    """Hashes of many words at once: of each word, and of its n-grams (marks ``^`` and ``$`` at the ends) with the word they are in."""

    words: np.ndarray
    grams: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Coded:
        marked = [f"^{w}$" for w in words]
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(codes)) - starts[owner]
        powers = np.cumprod(np.full(max(LETTERS + 2, sizes.max(initial=0)), ROLL, np.uint64))
        whole = np.add.reduceat(codes * powers[at], starts) * SPREAD if len(words) else np.empty(0, np.uint64)
        found, owners = [], []
        for n in GRAMS:
            if len(codes) < n:
                continue
            h = np.zeros(len(codes) - n + 1, np.uint64)
            for k in range(n):
                h += codes[k : len(codes) - n + 1 + k] * powers[k]
            inside = at[: len(h)] + n <= sizes[owner[: len(h)]]
            h = (h[inside] + np.uint64(n)) * SPREAD
            found.append(h ^ (h >> np.uint64(29)))
            owners.append(owner[: len(inside)][inside])
        none = np.empty(0, np.uint64)
        return cls(whole ^ (whole >> np.uint64(29)), np.concatenate([none, *found]), np.concatenate([np.empty(0, np.int64), *owners]))


@dataclass
class Table:
    """Vectors by hash; what is not in it has zeros, which are the row behind the last."""

    keys: np.ndarray
    values: np.ndarray

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    def __getstate__(self):
        return self.keys, self.values

    def __setstate__(self, state):
        self.keys, self.values = state
        self.__post_init__()

    def rows(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), len(self.keys), np.int32)
        if len(self.keys):
            maybe = np.flatnonzero(self.filter[keys >> np.uint64(64 - FILTER_BITS)])
            wanted = keys[maybe]
            at = np.searchsorted(self.keys, wanted)
            at[at == len(self.keys)] = 0
            same = self.keys[at] == wanted
            out[maybe[same]] = at[same]
        return out


#: Of each class: hashes, in how many documents each is, and the number of documents.
Counts = list[tuple[np.ndarray, np.ndarray, int]]


def counted(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """From the distinct hashes of each document."""
    keys, n = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]), return_counts=True)
    return keys, n.astype(np.int32), len(hashes)


def added(parts: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)), sum(p[2] for p in parts)


def known(keys: np.ndarray, counts: tuple) -> np.ndarray:
    """In how many documents of a class each key is."""
    held, n, _ = counts
    if not len(held):
        return np.zeros(len(keys))
    at = np.searchsorted(held, keys)
    at[at == len(held)] = 0
    return np.where(held[at] == keys, n[at], 0)


def odds(keys: np.ndarray, clean: tuple, toxic: tuple) -> np.ndarray:
    """Log odds of the keys by documents of each class, 0 where too little speaks for one; one more 0 at the end."""
    pos, neg = known(keys, toxic), known(keys, clean)
    lean = np.log((pos + 0.5) / (toxic[2] + 1)) - np.log((neg + 0.5) / (clean[2] + 1))
    # what few documents hold says little
    lean *= pos / (pos + 2.0)
    lean[(pos + neg < 2) | (pos < 1) | (np.abs(lean) <= 0.3)] = 0
    return np.r_[lean, 0].astype(np.float32)


def common_keys(clean: tuple, toxic: tuple) -> np.ndarray:
    """What is in a toxic document and in two at least."""
    return toxic[0][toxic[1] + known(toxic[0], clean) >= 2]


def by_owner(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and largest of the rows of each owner; owners come in order, those without rows have zeros."""
    sums, most = np.zeros((n, values.shape[1]), np.float32), np.zeros((n, values.shape[1]), np.float32)
    if len(owner):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sums[owner[first]] = np.add.reduceat(values, first)
        most[owner[first]] = np.maximum.reduceat(values, first)
    return sums, most


@dataclass
class Inputs:
    """What the network reads of a word."""

    words: Table
    grams: Table

    def features(self, words: list[str]) -> np.ndarray:
        """One row of inputs a word."""
        parts = [self.coded(words[i : i + CODED]) for i in range(0, len(words), CODED)]
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros((0, INPUTS), np.float32), *parts])

    def coded(self, words: list[str]) -> np.ndarray:
        coded = Coded.of(words)
        order = np.argsort(coded.owner, kind="stable")
        owner = coded.owner[order]
        sums, most = by_owner(self.grams.values[self.grams.rows(coded.grams[order])], owner, len(words))
        n = np.maximum(1, np.bincount(owner, minlength=len(words)))[:, None]
        flag = np.ones((len(words), 1), np.float32)
        return np.concatenate([self.words.values[self.words.rows(coded.words)], most, sums / n, flag], axis=1).astype(np.float32)


class Lexicon:
    """The words of the training texts as rows of both tables, and the vectors that are being trained.

    ``lean`` holds the first components' starts by fold; the last is that of all folds.
    """

    def __init__(self, names: list[str], keys: tuple[np.ndarray, np.ndarray], lean: list[tuple[np.ndarray, np.ndarray]], documents: tuple[np.ndarray, np.ndarray], rng: np.random.Generator):
        empty = [Table(k, np.zeros((len(k) + 1, 1), np.float32)) for k in keys]
        self.keys, self.lean = keys, lean
        # what few documents hold moves less
        self.trust = [np.r_[n / (n + DOUBT), 0].astype(np.float32) for n in documents]
        word_rows, rows, sizes, all_sizes = [], [], [], []
        for start in range(0, len(names), CODED):
            part = names[start : start + CODED]
            coded = Coded.of(part)
            word_rows.append(empty[0].rows(coded.words))
            found = empty[1].rows(coded.grams)
            order = np.argsort(coded.owner, kind="stable")
            order = order[found[order] < len(keys[1])]
            rows.append(found[order])
            sizes.append(np.bincount(coded.owner[order], minlength=len(part)))
            all_sizes.append(np.bincount(coded.owner, minlength=len(part)))
        none = np.empty(0, np.int32)
        self.word_rows, self.gram_rows = np.concatenate([none, *word_rows]), np.concatenate([none, *rows])
        self.begin = np.r_[0, np.cumsum(np.concatenate([none, *sizes]).astype(np.int64))]
        self.n_grams = np.maximum(1, np.concatenate([none, *all_sizes]))
        self.vectors, self.squares = [], []
        for k in keys:
            v = rng.normal(0, START, (len(k) + 1, VECTOR)).astype(np.float32)
            v[:, 0] = 0
            v[-1] = 0
            self.vectors.append(v)
            self.squares.append(np.full(len(k) + 1, 1e-6, np.float32))

    def gathered(self, ids: np.ndarray, fold: int) -> tuple[np.ndarray, ...]:
        sizes = self.begin[ids + 1] - self.begin[ids]
        owner = np.repeat(np.arange(len(ids)), sizes)
        rows = self.gram_rows[np.arange(len(owner)) + np.repeat(self.begin[ids] - np.cumsum(sizes) + sizes, sizes)]
        values = self.vectors[1][rows]
        values[:, 0] += self.lean[fold][1][rows]
        return sizes, owner, rows, values

    def features(self, ids: np.ndarray, fold: int) -> np.ndarray:
        """Inputs of words given by number, as a document of the fold meets them."""
        parts = [self._features(ids[i : i + CODED], fold)[0] for i in range(0, len(ids), CODED)]
        return np.concatenate([np.zeros((0, INPUTS), np.float32), *parts])

    def _features(self, ids: np.ndarray, fold: int) -> tuple:
        sizes, owner, rows, values = self.gathered(ids, fold)
        sums, most = by_owner(values, owner, len(ids))
        # an n-gram that is in no table counts as zeros
        some = (sizes < self.n_grams[ids])[:, None]
        most = np.where(some, np.maximum(most, 0), most)
        own = self.vectors[0][self.word_rows[ids]]
        own[:, 0] += self.lean[fold][0][self.word_rows[ids]]
        x = np.concatenate([own, most, sums / self.n_grams[ids][:, None], np.ones((len(ids), 1), np.float32)], axis=1).astype(np.float32)
        return x, owner, rows, values

    def learn(self, ids: np.ndarray, fold: int, dx: np.ndarray, rate: float) -> None:
        """A step against the gradient ``dx`` of the inputs of distinct words."""
        x, owner, rows, values = self._features(ids, fold)
        most, mean = slice(VECTOR, 2 * VECTOR), slice(2 * VECTOR, 3 * VECTOR)
        d = (dx[:, mean] / self.n_grams[ids][:, None])[owner] + np.where(values == x[owner, most], dx[owner, most], 0)
        for k, at, g in ((0, self.word_rows[ids], dx[:, :VECTOR]), (1, rows, d)):
            if not len(at):
                continue
            touched, number = np.unique(at, return_inverse=True)
            total = np.stack([np.bincount(number, g[:, j], len(touched)) for j in range(VECTOR)], axis=1).astype(np.float32)
            self.squares[k][touched] += (total * total).mean(1)
            # the row of what is in no table is not trusted at all and stays at zero
            self.vectors[k][touched] -= (rate * self.trust[k][touched] / np.sqrt(self.squares[k][touched]))[:, None] * total

    def inputs(self) -> Inputs:
        tables = []
        for k in (0, 1):
            v = self.vectors[k].copy()
            v[:, 0] += self.lean[-1][k]
            tables.append(Table(self.keys[k], v))
        return Inputs(*tables)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def hyperbolic(x: np.ndarray) -> np.ndarray:
    """tanh by the exponential, which numpy has in vector form on every machine."""
    return 1.0 - 2.0 / (np.exp(np.minimum(2.0 * x, 60)) + 1.0)


@dataclass
class Network:
    """Both directions' gates (update, reset, new side by side), attention and output weights."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng, h, d = np.random.default_rng(seed), HIDDEN, INPUTS
        p = {}
        for s in "fb":
            p["W" + s] = rng.normal(0, 0.3, (d, 3 * h))
            p["U" + s] = rng.normal(0, 0.3, (h, 3 * h))
            p["b" + s] = np.zeros(3 * h)
        p["A"], p["c"], p["v"] = rng.normal(0, 0.3, (2 * h, h)), np.zeros(h), rng.normal(0, 0.3, h)
        p["o"], p["q"] = rng.normal(0, 0.3, 2 * h), np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def direction(self, proj: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (time, batch, hidden) from the input side of the gates (time, batch, 3 * hidden)."""
        h, u = np.zeros((proj.shape[1], HIDDEN), np.float32), self.p["U" + side]
        out = np.empty((*proj.shape[:2], HIDDEN), np.float32)
        times = range(len(proj)) if side == "f" else range(len(proj) - 1, -1, -1)
        for t in times:
            a = h @ u
            zr = sigmoid((proj[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = hyperbolic(proj[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, r, n, a[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def pooled(self, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, ...]:
        k = hyperbolic(states @ self.p["A"] + self.p["c"])
        e = k @ self.p["v"]
        e = np.where(real, e, -1e9)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pool = (alpha[:, :, None] * states).sum(0)
        return pool @ self.p["o"] + self.p["q"][0], alpha, k, pool

    def logits(self, proj_f: np.ndarray, proj_b: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of windows given as word numbers (batch, time); number 0 is no word."""
        ids = ids.T
        states = np.concatenate([self.direction(proj_f[ids], "f"), self.direction(proj_b[ids], "b")], axis=2)
        return self.pooled(states, ids > 0)[0]

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((x @ self.p["W" + s] + self.p["b" + s]).astype(np.float32) for s in "fb")

    def gradient(self, x: np.ndarray, real: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss, by weights and (``x``) by inputs; x: (time, batch, inputs)."""
        p, kept, sides = self.p, {"f": [], "b": []}, {}
        for s in "fb":
            sides[s] = self.direction(x @ p["W" + s] + p["b" + s], s, kept[s])
        states = np.concatenate([sides["f"], sides["b"]], axis=2)
        logit, alpha, k, pool = self.pooled(states, real)
        d = (sigmoid(logit) - y) * weight / len(y)
        g = {"o": d @ pool, "q": np.array([d.sum()])}
        dpool = d[:, None] * p["o"]
        dstates = alpha[:, :, None] * dpool
        dalpha = (states * dpool).sum(2)
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        dk = de[:, :, None] * p["v"] * (1 - k * k)
        g["v"] = np.einsum("tb,tbh->h", de, k)
        g["c"] = dk.sum((0, 1))
        g["A"] = np.einsum("tbi,tbh->ih", states, dk)
        dstates = dstates + dk @ p["A"].T
        for s, part in (("f", dstates[:, :, :HIDDEN]), ("b", dstates[:, :, HIDDEN:])):
            dh = np.zeros_like(part[0])
            du, dgate = np.zeros_like(p["U" + s]), np.empty((*part.shape[:2], 3 * HIDDEN), np.float32)
            for t, before, z, r, n, a in reversed(kept[s]):
                dh = dh + part[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * a * r * (1 - r)
                dgate[t] = np.concatenate([dz, dr, dn], axis=1)
                through = np.concatenate([dz, dr, dn * r], axis=1)
                du += before.T @ through
                dh = dh * z + through @ p["U" + s].T
            g["U" + s], g["b" + s] = du, dgate.sum((0, 1))
            g["W" + s] = np.einsum("tbi,tbh->ih", x, dgate)
            g["x"] = g.get("x", 0) + dgate @ p["W" + s].T
        return g


@dataclass
class Model:
    inputs: Inputs
    net: Network
    slope: float
    shift: float

    def score(self, logit: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * logit + self.shift)


def windows(ids: np.ndarray) -> np.ndarray:
    """All overlapping windows (count, WINDOW) of a document's word numbers; the last is filled up with 0."""
    count = max(1, -(-(len(ids) - STRIDE) // STRIDE))
    padded = np.zeros((count - 1) * STRIDE + WINDOW, np.int32)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _doc_logits(net: Network, proj, wins: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Every window's logit, and each document's highest."""
    flat = np.concatenate(wins)
    logits = np.concatenate([net.logits(*proj, flat[i : i + BATCH]) for i in range(0, len(flat), BATCH)])
    starts = np.cumsum([0, *map(len, wins[:-1])])
    return logits, np.maximum.reduceat(logits, starts)


def fit(texts: list[str], labels: list[int], *, steps: int = 240, seed: int = 7, leanings: bool = True) -> Model | None:
    """None unless both classes occur; ``leanings`` tells where vectors start. Which window of a toxic document is toxic is found as training goes on."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    y = np.array(labels)
    # words become numbers at once: each spelling is held a single time
    vocabulary: dict[str, int] = {}
    tokens = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)), np.int32) for t in texts]
    names, distinct = list(vocabulary), [np.unique(ts) for ts in tokens]
    del vocabulary
    # folds by text, so that copies are in one fold, and by class in turn
    order = sorted(range(len(texts)), key=lambda i: (labels[i], xxhash.xxh64_intdigest(texts[i] or "", seed=seed)))
    fold, turn, last = np.zeros(len(texts), int), 0, None
    for i in order:
        turn += texts[i] != last
        fold[i], last = turn % FOLDS, texts[i]
    counts = {}
    for k in range(FOLDS):
        for c in (0, 1):
            coded = [Coded.of([names[j] for j in distinct[i]]) for i in np.flatnonzero((fold == k) & (y == c))]
            counts[k, c] = counted([d.words for d in coded]), counted([np.unique(d.grams) for d in coded])

    def sums(kind: int, label: int, skip: int | None = None) -> tuple:
        return added([counts[k, label][kind] for k in range(FOLDS) if k != skip])

    keys = tuple(common_keys(sums(kind, 0), sums(kind, 1)) for kind in (0, 1))
    lean = [tuple(odds(keys[kind], sums(kind, 0, skip), sums(kind, 1, skip)) * leanings for kind in (0, 1)) for skip in [*range(FOLDS), None]]
    documents = tuple(known(keys[kind], sums(kind, 0)) + known(keys[kind], sums(kind, 1)) for kind in (0, 1))
    del counts
    lexicon = Lexicon(names, keys, lean, documents, rng)
    used = [np.unique(np.concatenate([np.empty(0, np.int32), *(distinct[i] for i in np.flatnonzero(fold == k))])) for k in range(FOLDS)]
    # words by number among those of their fold, 0 for none
    wins: list[np.ndarray] = [windows(np.searchsorted(used[fold[i]], tokens[i]).astype(np.int32) + 1) for i in range(len(texts))]
    del distinct, tokens, names
    starts = np.cumsum([0, *map(len, wins)])
    members = [np.flatnonzero(fold == k) for k in range(FOLDS)]

    def rows_of(k: int) -> np.ndarray:
        return np.concatenate([np.zeros((1, INPUTS), np.float32), lexicon.features(used[k], k)])

    def strongest(score) -> tuple[np.ndarray, np.ndarray]:
        """Each document's highest window by ``score(rows, windows)``, and where that is among all windows; a fold at a time."""
        best, where = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for k, own in enumerate(members):
            if len(own):
                values = score(rows_of(k), [wins[i] for i in own])
                ends = np.cumsum([len(wins[i]) for i in own])
                for i, e in zip(own, ends, strict=True):
                    part = values[e - len(wins[i]) : e]
                    at = int(np.argmax(part))
                    best[i], where[i] = part[at], starts[i] + at
        return best, where

    def leading(x: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
        strength = np.maximum(x[:, 0], x[:, VECTOR])
        return np.concatenate([np.sort(strength[w], axis=1)[:, -3:].sum(1) for w in own])

    def judged(x: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
        return _doc_logits(net, net.project(x), own)[0]

    def batch(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Folds and word numbers of windows."""
        docs = np.searchsorted(starts, places, "right") - 1
        return fold[docs], np.stack([wins[d][p - starts[d]] for d, p in zip(docs, places, strict=True)])

    # at first the window with the strongest leanings stands for its document
    where = strongest(leading)[1]
    net = Network.fresh(seed)
    moment = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    positive, negative = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for step in range(1, steps + 1):
        if step % (steps // 3) == 0 and step < steps:
            where = strongest(judged)[1]
        pos, neg = rng.choice(positive, 64), rng.choice(negative, 96)
        any_of = rng.choice(negative, 32)
        take = np.concatenate([where[pos], where[neg], (starts[any_of] + rng.random(32) * (starts[any_of + 1] - starts[any_of])).astype(int)])
        target = np.r_[np.ones(64), np.zeros(128)].astype(np.float32)
        folds, ids = batch(take)
        x, met = np.zeros((*ids.shape, INPUTS), np.float32), []
        for k in range(FOLDS):
            own = np.flatnonzero(folds == k)
            distinct, number = np.unique(ids[own], return_inverse=True)
            numbers = used[k][distinct[distinct > 0] - 1]
            table = np.concatenate([np.zeros((len(distinct) - len(numbers), INPUTS), np.float32), lexicon.features(numbers, k)])
            number = number.reshape(len(own), -1)
            x[own] = table[number]
            met.append((k, own, number, numbers, len(table)))
        g = net.gradient(x.transpose(1, 0, 2), ids.T > 0, target, np.ones(192, np.float32))
        dx = g.pop("x").transpose(1, 0, 2)
        for k, own, number, numbers, n in met:
            d = np.stack([np.bincount(number.ravel(), dx[own, :, j].ravel(), n) for j in range(INPUTS)], axis=1)
            lexicon.learn(numbers, k, d[n - len(numbers) :], RATE)
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, v in g.items():
            v = v * min(1.0, 5.0 / (size + 1e-9)) + 1e-4 * net.p[k]
            moment[k] = 0.9 * moment[k] + 0.1 * v
            square[k] = 0.99 * square[k] + 0.01 * v * v
            net.p[k] = (net.p[k] - 0.02 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(lexicon.inputs(), net, *_platt(strongest(judged)[0], y))


def _platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from a document's highest logit to its label, targets drawn in as Platt does."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2)
    t = np.where(y == 1, hi, lo)
    a, b = 1.0, 0.0
    for _ in range(60):
        p = sigmoid(a * logit + b)
        w = p * (1 - p) + 1e-6
        ga, gb = ((p - t) * logit).sum() + 1e-3 * a, (p - t).sum() + 1e-3 * b
        h = np.array([[(w * logit * logit).sum() + 1e-3, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [ga, gb])
        cut = min(1.0, 2.0 / (abs(da) + abs(db) + 1e-9))
        a, b = a - cut * da, b - cut * db
        if abs(da) + abs(db) < 1e-7:
            break
    return max(float(a), 1e-3), float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = 1500, max_clean: int = 3000) -> list:
    """The bounded training sample: (text, toxic) of labelled documents that are not held out, chosen by a hash of the id."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).withColumn("at", F.xxhash64(F.lit(11), "doc_id"))
    chosen = [r.doc_id for y, n in ((1, max_toxic), (0, max_clean)) for r in known.filter(F.col("toxic") == y).orderBy("at", "doc_id").limit(n).collect()]
    picked = docs.sparkSession.createDataFrame([(i,) for i in chosen], "label_id long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"), "left_semi")
    # of rows of one id the one of largest text, chosen before anything is collected
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"))
    truth = known.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"), "left_semi").select("doc_id", "toxic")
    found = {r.doc_id: r.text for r in rows.collect()}
    return sorted(((found[r.doc_id] or "", r.toxic) for r in truth.collect() if r.doc_id in found), key=lambda r: (r[1], r[0]))


class Scorer:
    """A worker's model with the gates' input sides of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.proj = self.model.net.project(np.zeros((1, INPUTS), np.float32))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.number]
        if not new:
            return
        x = self.model.inputs.features(new)
        start = len(self.proj[0])
        self.number.update(zip(new, range(start, start + len(new)), strict=True))
        self.proj = tuple(np.concatenate([a, b]) for a, b in zip(self.proj, self.model.net.project(x), strict=True))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        tokens = [words_of(t) for t in texts]
        if len(self.number) > CACHE_WORDS:
            self.clear()
        self.learn(set().union(*tokens))
        get = self.number.__getitem__
        wins = [windows(np.fromiter(map(get, ts), np.int32, len(ts))) for ts in tokens]
        return self.model.score(_doc_logits(self.model.net, self.proj, wins)[1])




def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score), one row a document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model) if model else None
        for batch in common.slices(batches, limit=2 << 20):
            found = scorer.score(batch.column(1).to_pylist()) if scorer else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(float))], names=["doc_id", "score"])

    return rows.mapInArrow(work, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model | None, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model) if model else None
        for batch in common.slices(batches, text_col, limit=2 << 20):
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            yield batch.filter(pa.array(scorer.score(texts) < threshold)) if scorer else batch

    return docs.mapInArrow(work, docs.schema)


def train(docs: DataFrame, labels: DataFrame, **bounds) -> Model | None:
    sample = labelled(docs, labels, **bounds)
    return fit([t for t, _ in sample], [y for _, y in sample])


def digest(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The columns that op1 returns."""
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
