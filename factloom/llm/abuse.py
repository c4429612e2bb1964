"""Abusive, hateful or sexual content: a bidirectional gated recurrent network over overlapping windows of each text.

Inputs of a word are its own vector and the mean of the vectors of its character n-grams (after undoing digits for
letters, look-alike letters, stretched, split and spelled-out words). Two gated recurrent networks read a window forwards
and backwards, attention pools their states, and a logistic unit scores the window. A text's score is that of its worst
window; windows overlap and cover the whole text. No word list goes in: all is learnt from labelled texts.

The network is trained in numpy on a bounded sample of labelled texts (MAX_FLAGGED and MAX_CALM, the least hashes of
doc_id; texts of at most MAX_TRAIN_CHARS). Labels belong to texts, not windows, and some are wrong. Training starts from
windows with runs of words that are commoner in flagged texts than chance can explain (a likelihood ratio against the
sample's rate of flags, held to the number of runs tried). Then, crosswise for two halves, a network picks
the abusive windows of the texts that it has not seen, and the unflagged windows that it gets wrong. Flagged texts
without an abusive window are taken for mistakes. A trained network is kept in the shared folder under the hash of its sample.

Defined results: null, empty and word-less texts score 0. Raters who disagree evenly leave a text unlabelled. Without
enough labels for any run of words to stand out nothing is learnt, and all texts score 0. Repeated rows of a document are
scored each. Words and n-grams that training has not seen say nothing by themselves.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import ensure_checkpoint_dir

#: Flagged and unflagged texts used for training at most, and their greatest length.
MAX_FLAGGED, MAX_CALM, MAX_TRAIN_CHARS = 2_500, 20_000, 20_000
#: Words of a window, and words by which the next one starts later.
WINDOW, STEP = 12, 5
#: Widths of the word and n-gram vectors, states of each direction, and texts in which a word or n-gram must stand to get a vector.
WIDTH, HIDDEN, LEAST = 20, 24, 3
EPOCHS, BATCH, RATE = 4, 512, 0.006
#: Training windows from each unflagged text, unflagged windows at most for each flagged one, and score from which a text is flagged.
CALM_WINDOWS, CALM_SHARE, THRESHOLD = 3, 4, 0.9
#: Times that a wrongly scored unflagged window counts, and windows of random characters and of random words among the unflagged ones.
HARD, STRANGE = 3, 300
#: Share of flags among texts with an abusive run of words that the likelihood ratio assumes.
ABUSIVE = 0.9
#: Logarithm of the odds by which a run must be telling, besides the number of runs tried for each one taken.
DOUBT = 6.5
#: Letters of the longest word; longer ones are cut into words of that length.
LONGEST = 24

_LEET = str.maketrans("0134578@$!|", "oieastbasil")
# Cyrillic and Greek letters that look like Latin ones.
_LOOKS = str.maketrans("асеорхуіјѕкмтвнԁɡαοερνικτ", "aceopxyijskmtbhdgaoepvikt")
_WORD = re.compile(r"[^\W_][\w*$@!'’-]*[\w*$@!]|[^\W_]|[!?]")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![^\W_])")
_GAPS = re.compile(r"[ .\-_*]")
_STRETCH = re.compile(r"(\w)\1{2,}")
_CJK = re.compile(r"([぀-ヿ㐀-鿿가-힯])")
_UNSEEN = re.compile("[̀-ͯ­​-‏⁠﻿]")
_HUMPS = re.compile(r"[A-Z]+(?![a-z])[^A-Za-z_]*|[A-Z]?[^A-Z_]+")
_NUMBER = re.compile(r"[\d.,:+-]+(?:[tT]\d+)?[zZ]?")


def fold(word: str) -> str:
    """A word in lower case without stretching and digits for letters."""
    w = _STRETCH.sub(r"\1", word.lower().rstrip("!"))
    if not w.isascii() and re.search("[a-z]", w):
        w = w.translate(_LOOKS)
    if any(c in "0134578@$!|" for c in w) and not re.fullmatch(r"[^\W\d_]+\d+|[\W\d_]+", w):
        w = w.translate(_LEET)
    return w


@lru_cache(maxsize=1 << 17)
def pieces(token: str) -> tuple[str, ...]:
    """The folded words of a token; names of code are cut into their words, unless letters just change case at random."""
    if token in ("!", "?"):
        return (token,)
    if _NUMBER.fullmatch(token):
        return ("<number>",)
    parts = [token]
    if "_" in token or re.search("[a-z][A-Z]", token):
        humps = _HUMPS.findall(token)
        plain = [x for x in token.split("_") if x]
        parts = humps if len(token) >= 3 * len(humps) else plain
    out = []
    for p in parts:
        w = "<number>" if _NUMBER.fullmatch(p) else fold(p)
        out += [w[i:i + LONGEST] for i in range(0, len(w), LONGEST)]
    return tuple(out)


def words(text: str | None) -> list[str]:
    """The folded words of a text; numbers and times become one word each."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", unicodedata.normalize("NFKD", text)))
        text = _CJK.sub(r" \1 ", text)
    text = _SPELLED.sub(lambda m: _GAPS.sub("", m[0]), text)
    return [w for t in _WORD.findall(text) for w in pieces(t)]


@lru_cache(maxsize=1 << 16)
def ngrams(word: str) -> tuple[str, ...]:
    """The distinct character n-grams of a word with its edges marked."""
    marked = f"<{word}>"
    return tuple(dict.fromkeys(marked[i:i + n] for n in (3, 4) for i in range(max(1, len(marked) - n + 1))))


def windows(n: int) -> list[int]:
    """First words of the overlapping windows that cover n words."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STEP), n - WINDOW]


def _cut(t: list[str]) -> list[list[str]]:
    return [t[s:s + WINDOW] for s in windows(len(t))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Bidirectional GRU with attention pooling; parameters are float32 arrays in `p`, both directions stacked.

    `known` and `grams` give the rows of the words and n-grams that have vectors; row 0 of either table is nothing.
    """

    def __init__(self, known: dict[str, int], grams: dict[str, int], seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = 2 * WIDTH, HIDDEN
        s = lambda *shape, scale=0.15: r.normal(0, scale, shape).astype(np.float32)
        self.known, self.grams = known, grams
        self.p = {"E": s(len(known) + 1, WIDTH, scale=0.03), "C": s(len(grams) + 1, WIDTH, scale=0.03), "a": s(2 * h), "o": s(2 * h), "b": np.zeros(1, np.float32), "W": s(2, d, 3 * h), "U": s(2, h, 3 * h), "c": np.zeros((2, 1, 3 * h), np.float32)}
        self.p["c"][:, :, :h] = -1.0
        self.p["E"][0] = self.p["C"][0] = 0

    def look_up(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word rows, n-gram rows, owner of each n-gram, n-grams of each word) of distinct words."""
        all_grams = [ngrams(w) for w in vocabulary]
        many = np.array([len(x) for x in all_grams], np.float32)
        rows = np.array([self.grams.get(g, 0) for x in all_grams for g in x], np.int64)
        owner = np.repeat(np.arange(len(vocabulary)), many.astype(np.int64))
        seen = rows > 0
        return np.array([self.known.get(w, 0) for w in vocabulary], np.int64), rows[seen], owner[seen], many

    def embed(self, looked) -> np.ndarray:
        w, g, owner, many = looked
        chars = np.zeros((len(w), WIDTH), np.float32)
        if len(g):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            chars[owner[first]] = np.add.reduceat(self.p["C"][g], first, axis=0)
        return np.concatenate([self.p["E"][w], chars / many[:, None]], 1)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """Input products of words for both directions, with a last row for padding."""
        v = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
        return v @ self.p["W"] + self.p["c"]

    def run(self, ids: np.ndarray, projected: np.ndarray, keep: bool = False):
        """Logits of windows of word ids (-1 pads at the end); `projected` holds each word's input products."""
        n, t = ids.shape
        h, U = HIDDEN, self.p["U"]
        both = np.stack([ids, ids[:, ::-1]])
        mask = (both >= 0).astype(np.float32)
        s = np.zeros((2, n, h), np.float32)
        S = np.zeros((t, n, 2 * h), np.float32)
        tape = []
        for i in range(t):
            x = np.stack([projected[0][both[0, :, i]], projected[1][both[1, :, i]]])
            m = mask[:, :, i, None]
            zr = _sigmoid(x[:, :, :2 * h] + s @ U[:, :, :2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            rs = r * s
            c = np.tanh(x[:, :, 2 * h:] + rs @ U[:, :, 2 * h:])
            new = s + m * z * (c - s)
            if keep:
                tape.append((s, z, r, c, rs, m))
            s = new
            S[i, :, :h], S[t - 1 - i, :, h:] = s[0], s[1]
        e = S @ self.p["a"] + (mask[0].T - 1) * 1e4
        e -= e.max(0)
        a = np.exp(e)
        a /= a.sum(0)
        pooled = np.einsum("tn,tnd->nd", a, S)
        logit = pooled @ self.p["o"] + self.p["b"]
        return (logit, S, a, pooled, tape, both) if keep else logit

    def score(self, texts: list[list[str]]) -> np.ndarray:
        """The worst window's probability of each text of folded words."""
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        out = np.zeros(len(texts), np.float64)
        if not vocabulary:
            return out
        projected = self.project(self.embed(self.look_up(list(vocabulary))))
        rows: list[np.ndarray] = []
        owner: list[int] = []
        for d, t in enumerate(texts):
            ids = np.full(max(len(t), WINDOW), -1, np.int64)
            ids[:len(t)] = [vocabulary[w] for w in t]
            at = windows(len(t))
            rows += [ids[s:s + WINDOW] for s in at]
            owner += [d] * len(at)
            if rows and (len(rows) >= 4096 or d == len(texts) - 1):
                for i in range(0, len(rows), 4096):
                    np.maximum.at(out, owner[i:i + 4096], _sigmoid(self.run(np.stack(rows[i:i + 4096]), projected).astype(np.float64)))
                rows, owner = [], []
        return out

    def step(self, batch: list[list[str]], target: np.ndarray, weight: np.ndarray, state: dict, n_step: int, rng: np.random.Generator) -> None:
        """One step of Adam on a batch of windows; some words go without their own vector, so that their letters count."""
        h, p = HIDDEN, self.p
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in batch for w in t))}
        w, grams, owner, many = self.look_up(list(vocabulary))
        w = np.where(rng.random(len(w)) < 0.2, 0, w)
        vectors = self.embed((w, grams, owner, many))
        projected = self.project(vectors)
        ids = np.array([[vocabulary[x] for x in t] + [-1] * (WINDOW - len(t)) for t in batch])
        logit, S, a, pooled, tape, both = self.run(ids, projected, keep=True)
        n, t = ids.shape
        g = ((_sigmoid(logit) - target) * weight / n).astype(np.float32)
        G = {"o": pooled.T @ g, "b": g.sum(keepdims=True)}
        d_pooled = np.outer(g, p["o"])
        d_a = np.einsum("nd,tnd->tn", d_pooled, S)
        d_e = a * (d_a - (a * d_a).sum(0))
        G["a"] = np.einsum("tn,tnd->d", d_e, S)
        d_S = a[:, :, None] * d_pooled + d_e[:, :, None] * p["a"]
        U = p["U"]
        UT = U.transpose(0, 2, 1)
        dU = np.zeros_like(U)
        D = np.zeros((2, t, n, 3 * h), np.float32)
        carry = np.zeros((2, n, h), np.float32)
        for i in range(t - 1, -1, -1):
            s, z, r, c, rs, m = tape[i]
            ds = carry + np.stack([d_S[i, :, :h], d_S[t - 1 - i, :, h:]])
            dmz = ds * m
            dz = dmz * (c - s) * z * (1 - z)
            dc = dmz * z * (1 - c * c)
            d_rs = dc @ UT[:, 2 * h:]
            dzr = np.concatenate([dz, d_rs * s * r * (1 - r)], 2)
            dU[:, :, :2 * h] += s.transpose(0, 2, 1) @ dzr
            dU[:, :, 2 * h:] += rs.transpose(0, 2, 1) @ dc
            carry = ds * (1 - m * z) + d_rs * r + dzr @ UT[:, :2 * h]
            D[:, i, :, :2 * h], D[:, i, :, 2 * h:] = dzr, dc
        d_proj = np.zeros((2, len(vectors) + 1, 3 * h), np.float32)
        for k in (0, 1):
            at = both[k].T.ravel()
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], at[order][1:] != at[order][:-1])))
            d_proj[k][at[order][first]] = np.add.reduceat(D[k].reshape(t * n, 3 * h)[order], first, axis=0)
        padded = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
        G |= {"U": dU, "W": padded.T @ d_proj, "c": d_proj.sum(1, keepdims=True)}
        d_vectors = (d_proj @ p["W"].transpose(0, 2, 1)).sum(0)[:-1]
        sparse = {"E": (w, d_vectors[:, :WIDTH]), "C": (grams, (d_vectors[:, WIDTH:] / many[:, None])[owner])}
        fix = np.sqrt(1 - 0.999 ** n_step) / (1 - 0.9 ** n_step)
        for k, grad in G.items():
            m, v = state.setdefault(k, (np.zeros_like(p[k]), np.zeros_like(p[k])))
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            p[k] -= (RATE * fix * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        for k, (at, grad) in sparse.items():
            # Rows of a table that a batch doesn't touch keep their moments; row 0 stays nothing.
            order = np.argsort(at, kind="stable")
            at, grad = at[order], grad[order]
            if not len(at):
                continue
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            rows, total = at[first], np.add.reduceat(grad, first, axis=0)
            rows, total = rows[rows > 0], total[rows > 0]
            m, v = state.setdefault(k, (np.zeros_like(p[k]), np.zeros_like(p[k])))
            m[rows] += 0.1 * (total - m[rows])
            v[rows] += 0.001 * (total * total - v[rows])
            p[k][rows] -= (RATE * fix * m[rows] / (np.sqrt(v[rows]) + 1e-8)).astype(np.float32)


def telling_runs(texts: list[list[str]], labels: list[int]) -> list[np.ndarray]:
    """For each text, the (position, length) of its telling runs of one to three words, as columns in order.

    A run is telling if the likelihood that ABUSIVE of its texts are flagged exceeds the likelihood that they are flagged
    at the sample's rate, by e**DOUBT times the number of runs tried for each one taken, so that chance finds few of these. Runs of fewer words are tried on the texts that no
    longer run explains, so that a word isn't blamed for the company that it sometimes keeps.
    """
    vocabulary: dict[str, int] = {}
    flat = np.array([vocabulary.setdefault(w, len(vocabulary)) + 1 for t in texts for w in t], np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    y = np.array(labels, bool)
    starts = np.cumsum([0, *[len(t) for t in texts]])
    rate = min(0.5, max(1e-3, y.mean()))
    open_ = np.ones(len(texts), bool)
    found = []
    for n in (3, 2, 1):
        key = np.zeros(len(flat), np.uint64)
        for i in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([flat[i:], np.zeros(i, np.uint64)])
            key ^= key >> np.uint64(29)
        at = np.flatnonzero((np.concatenate([owner[n - 1:], np.full(n - 1, -1)]) == owner) & open_[owner])
        tried, count = np.unique(key[at[y[owner[at]]]], return_counts=True)
        tried = tried[count >= 2]
        at = at[np.isin(key[at], tried)]
        pairs = np.unique(np.stack([np.searchsorted(tried, key[at]).astype(np.int64), owner[at]]), axis=1)
        pos = np.bincount(pairs[0], y[pairs[1]], len(tried))
        every = np.bincount(pairs[0], minlength=len(tried))
        ratio = pos * np.log(ABUSIVE / rate) + (every - pos) * np.log((1 - ABUSIVE) / (1 - rate))
        fine = np.sort(ratio)[::-1] > np.log(max(1, len(tried)) / np.arange(1, len(tried) + 1)) + DOUBT
        least = np.sort(ratio)[::-1][np.flatnonzero(fine)[-1]] if fine.any() else np.inf
        at = at[np.isin(key[at], tried[ratio >= least])]
        found.append(np.stack([at, np.full(len(at), n)]))
        open_[owner[at]] = False
    spots = np.concatenate(found, 1)
    spots = spots[:, np.argsort(spots[0], kind="stable")]
    cuts = np.searchsorted(spots[0], starts)
    return [spots[:, cuts[i]:cuts[i + 1]] - np.array([[starts[i]], [0]]) for i in range(len(texts))]


def _with_runs(n_words: int, spots: np.ndarray) -> np.ndarray:
    """For each window of a text whether a telling run lies in it."""
    at = np.array(windows(n_words))
    if not spots.shape[1]:
        return np.zeros(len(at), bool)
    return ((spots[0][None] >= at[:, None]) & (spots[0][None] + spots[1][None] <= at[:, None] + WINDOW)).any(1)


def _tables(hot: list[list[str]], cold: list[list[str]]) -> tuple[dict[str, int], dict[str, int]]:
    """The words and n-grams that get vectors."""
    many = Counter(w for x in (*hot, *cold) for w in set(x))
    grams: Counter = Counter()
    for w, n in many.items():
        for g in ngrams(w):
            grams[g] += n
    return {w: i + 1 for i, w in enumerate(sorted(w for w, n in many.items() if n >= LEAST))}, {g: i + 1 for i, g in enumerate(sorted(g for g, n in grams.items() if n >= LEAST))}


def _fit(hot: list[list[str]], cold: list[list[str]], seed: int, epochs: int) -> Network:
    """A network for windows that are abusive or not."""
    rng = np.random.default_rng(seed)
    net = Network(*_tables(hot, cold), seed)
    letters = np.array([*"abcdefghijklmnopqrstuvwxyz0123456789"])
    strange = [[chr(c) for c in rng.integers(0x4E00, 0x9F00, rng.integers(1, WINDOW + 1))] for _ in range(STRANGE)]
    strange += [["".join(rng.choice(letters, rng.integers(1, LONGEST + 1))) for _ in range(rng.integers(1, WINDOW + 1))] for _ in range(STRANGE)]
    data = [(w, 1.0) for w in hot] + [(w, 0.0) for w in strange] + [(w, 0.0) for w in cold]
    gain = min(8.0, max(1.0, 0.2 * len(cold) / max(1.0, len(hot))))
    state: dict = {}
    n_step = 0
    for _ in range(max(epochs, min(60, 120 * BATCH // max(1, len(data))))):
        order = rng.permutation(len(data))
        for i in range(0, len(order), BATCH):
            part = [data[j] for j in order[i:i + BATCH]]
            y = np.array([x[1] for x in part], np.float32)
            weight = np.where(y > 0, gain, 1.0).astype(np.float32)
            # Words are dropped at random, so that no window is known by heart.
            batch = [[w for w, keep in zip(x[0], rng.random(len(x[0])) > 0.1) if keep] or x[0] for x in part]
            n_step += 1
            net.step(batch, y, weight, state, n_step, rng)
    return net


def _judged(net: Network, texts: list[list[str]]) -> list[np.ndarray]:
    """The score of each window of each text."""
    cut = [_cut(t) for t in texts]
    s = net.score([w for d in cut for w in d])
    return np.split(s, np.cumsum([len(d) for d in cut])[:-1]) if cut else []


def train(texts: list[list[str]], labels: list[int], seed: int = 7) -> Network | None:
    """A network trained on labelled texts of folded words; deterministic for the same input in the same order.

    Copies of a text count once, with their labels' majority. None if nothing tells flagged texts from others.
    """
    votes: dict[tuple[str, ...], list[int]] = {}
    for t, y in zip(texts, labels):
        if t:
            votes.setdefault(tuple(t), []).append(y)
    mean = {t: sum(v) / len(v) for t, v in votes.items()}
    texts = [list(t) for t, x in mean.items() if x != 0.5]
    labels = [int(x > 0.5) for x in mean.values() if x != 0.5]
    if not any(labels) or all(labels):
        return None
    rng = np.random.default_rng(seed)
    spots = telling_runs(texts, labels)
    cuts = [_cut(t) for t in texts]
    runs = [_with_runs(len(t), s) for t, s in zip(texts, spots)]
    flagged = [i for i, y in enumerate(labels) if y]
    calm = [i for i, y in enumerate(labels) if not y]
    hot = {i: [w for w, x in zip(cuts[i], runs[i]) if x] for i in flagged}
    if not any(hot.values()):
        return None
    # Words of abusive windows in unflagged texts are what is hard to tell; other unflagged windows are taken at random.
    common = Counter(w for i in flagged for x in hot[i] for w in set(x))
    rare = Counter(w for i in calm[:4 * len(flagged)] for w in set(texts[i]))
    share = {w: n / (n + rare[w]) for w, n in common.items() if n >= LEAST}
    cold = {}
    for i in calm:
        ok = np.flatnonzero(~runs[i])
        if len(ok):
            worst = sorted(ok, key=lambda j: -max((share.get(w, 0.0) for w in cuts[i][j]), default=0.0))[:1]
            cold[i] = [cuts[i][j] for j in {*worst, *rng.permutation(ok)[:CALM_WINDOWS - 1]}]
    bound = CALM_SHARE * sum(map(len, hot.values())) + 2_000

    def some(group: list[int]) -> list[list[str]]:
        every = [w for i in group for w in cold.get(i, [])]
        return [every[j] for j in sorted(rng.permutation(len(every))[:bound])]

    halves = [(flagged[h::2], calm[h::2]) for h in (0, 1)]
    picked: list[list[str]] = []
    hard: list[list[str]] = []
    for h in (0, 1):
        mine, other = halves[1 - h], halves[h]
        net = _fit([w for i in mine[0] for w in hot[i]], some(mine[1])[:bound // 2], seed, EPOCHS // 2)
        # Each half is judged by a network that has not seen it, so that no mistake of a rater confirms itself.
        for i, s in zip(other[0], _judged(net, [texts[i] for i in other[0]])):
            picked += [w for w, x, run in zip(cuts[i], s, runs[i]) if x > 0.5 or run]
        for i, s in zip(other[1], _judged(net, [texts[i] for i in other[1]])):
            hard += [w for w, x, run in zip(cuts[i], s, runs[i]) if x > 0.3 and not run for _ in range(HARD)]
    return _fit(picked, some(calm) + hard, seed, EPOCHS)


def sample(docs: DataFrame, labels: DataFrame, flagged: int = MAX_FLAGGED, calm: int = MAX_CALM) -> tuple[list[list[str]], list[int]]:
    """The words of at most so many labelled texts of either kind with their raters' majority, in the order of their ids' hashes.

    The ids are chosen from the labels alone, so that only chosen texts leave the scan; texts are cut into words there.
    """
    votes = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.avg("toxic").alias("share")).where(F.col("share") != 0.5)
    ranked = votes.select("doc_id", (F.col("share") > 0.5).cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
    picked = [ranked.where(F.col("y") == y).orderBy("h", "doc_id").limit(bound) for y, bound in ((1, flagged), (0, calm))]
    both = docs.where(F.length("text").between(1, MAX_TRAIN_CHARS)).select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf[["h", "y"]].assign(words=[" ".join(words(t)) for t in pdf["text"]])

    rows = sorted(tuple(r) for r in both.select("h", "y", "text").mapInPandas(cut, "h long, y int, words string").collect())
    return [r[2].split(" ") if r[2] else [] for r in rows], [r[1] for r in rows]


def _pack(net: Network | None) -> bytes:
    out = io.BytesIO()
    names = json.dumps([sorted(t, key=t.get) for t in (net.known, net.grams)] if net else None)
    np.savez(out, names=np.frombuffer(names.encode("utf-8", "surrogatepass"), np.uint8), **(net.p if net else {}))
    return out.getvalue()


def _unpack(blob: bytes) -> Network | None:
    got = np.load(io.BytesIO(blob), allow_pickle=False)
    names = json.loads(got["names"].tobytes().decode("utf-8", "surrogatepass"))
    if names is None:
        return None
    net = Network(*({x: i + 1 for i, x in enumerate(t)} for t in names))
    net.p = {k: got[k] for k in got.files if k != "names"}
    return net


def fitted(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> Network | None:
    """The network for a sample of these texts: trained once, then read from `folder` (else the session's checkpoint folder)."""
    spark = docs.sparkSession
    texts, y = sample(docs, labels)
    h = hashlib.sha256(repr((WINDOW, STEP, WIDTH, HIDDEN, LEAST, EPOCHS, BATCH, RATE, CALM_WINDOWS, CALM_SHARE, HARD, STRANGE, ABUSIVE, DOUBT, LONGEST)).encode())
    for t, x in zip(texts, y):
        h.update(f"{x} {' '.join(t)}\n".encode("utf-8", "surrogatepass"))
    path = f"{(folder or ensure_checkpoint_dir(spark)).rstrip('/')}/abuse-{h.hexdigest()[:32]}.parquet"
    try:
        return _unpack(bytes(spark.read.schema("model binary").parquet(path).first()["model"]))
    except (PySparkException, TypeError):  # there is none yet, or its writing was cut off
        net = train(texts, y)
    spark.createDataFrame([(bytearray(_pack(net)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return net


def scored(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of each document and its score, a probability."""
    if net is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(_pack(net))

    # Only texts go to Python, so that ids and other columns come back as they are, nulls included.
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _unpack(model.value)
        for texts in batches:
            out = [own.score([words(t) for t in texts.iloc[i:i + 500]]) for i in range(0, len(texts), 500)]
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.select(*keep, score("text").alias("score"))
