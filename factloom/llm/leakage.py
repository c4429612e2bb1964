"""Evaluation texts leaking into training text, by the q-gram lemma.

Two passages of at least L characters within k edits share at least L - q + 1 - k q of their q-grams, in order and near
one diagonal. The items' q-grams are indexed once; for each document the shared q-grams are counted in overlapping bands
of diagonals, regions that meet the bound are kept and verified by a banded alignment. With k = 0 an exact check
then asks for MIN_WORDS whole words in a row.

Shared q-grams aren't listed pair by pair: only those that begin a run on their diagonal are (the characters before
them differ), and the run's length is found by bisection over prefix hashes. So texts that repeat themselves cost as many
steps as they have runs, not as the product of their lengths, and a run tells at once how many q-grams it counts for.
Runs are listed in slices of PAIRS, so memory is bounded however often a q-gram occurs.

Texts are compared as their words (maximal runs of letters and digits, lower-cased) joined by single blanks.

Defined results: null and empty texts leak nothing, and rows without an id are left out. Items with fewer than MIN_WORDS words can't be leaked. Repeated
rows of a document or item give one row each pair. Ties don't arise. The items are sent to the executors in blocks of
BLOCK_CHARS characters, so what is broadcast stays bounded whatever their number; every document meets every block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
#: The least length of MIN_WORDS words joined by blanks.
MIN_CHARS = 2 * MIN_WORDS - 1
Q = 12
BAND = 16
#: Characters of items in one block.
BLOCK_CHARS = 4_000_000
#: Characters of documents handled at once in a task, and runs listed at once.
DOC_CHARS, PAIRS = 2_000_000, 1_000_000
#: What parts the items' texts, and the documents': two characters that no text holds and that never match.
ITEM_END, DOC_END = "\n", "\v"
WORD = re.compile(r"[^\W_]+")
OUT = "doc_id long, item_id long, n_words int, item_words int, doc_words int"


def joined(text: str | None) -> str:
    """The words of a text in lower case, joined by blanks."""
    return " ".join(WORD.findall(text)).lower() if text else ""


def words_of(text: str | None) -> list[str]:
    return joined(text).split()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Prefixes:
    """Polynomial hashes of all prefixes, so that any substring's hash takes one step."""

    BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, c: np.ndarray):
        n = len(c) + 1
        power, self.back = (np.cumprod(np.where(np.arange(n) > 0, x, np.uint64(1)), dtype=np.uint64) for x in (self.BASE, self.INVERSE))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))

    def of(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        h = (self.sums[at + length] - self.sums[at]) * self.back[at]
        return h ^ (h >> np.uint64(31))

    def qgrams(self, q: int) -> np.ndarray:
        n = len(self.sums) - q
        return self.of(np.arange(max(0, n)), q) * self.BASE


def run_lengths(a: Prefixes, i: np.ndarray, b: Prefixes, j: np.ndarray) -> np.ndarray:
    """How many characters are equal from i in one text and j in the other."""
    low = np.zeros(len(i), np.int64)
    high = np.minimum(len(a.sums) - 1 - i, len(b.sums) - 1 - j)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_] + 1) // 2
        same = a.of(i[open_], mid) == b.of(j[open_], mid)
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)
    return low


def banded_distance(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """The edit distance of two code arrays if it is at most k, else k + 1; only 2k + 1 diagonals are visited."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    if k == 0:
        return 0 if np.array_equal(a, b) else 1
    width = 2 * k + 1
    row = [j if 0 <= j <= m else k + 1 for j in range(-k, k + 1)]
    for i in range(1, n + 1):
        new = [k + 1] * width
        for d in range(width):
            j = i + d - k
            if not 0 <= j <= m:
                continue
            best = row[d] + (1 if j == 0 or a[i - 1] != b[j - 1] else 0) if j > 0 else k + 1
            if j == 0:
                best = i
            if d + 1 < width:
                best = min(best, row[d + 1] + 1)
            if d > 0:
                best = min(best, new[d - 1] + 1)
            new[d] = min(best, k + 1)
        row = new
        if min(row) > k:
            return k + 1
    return min(row[m - n + k], k + 1)


class ItemIndex:
    """The q-grams of a block of items, all items laid end to end."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int = 0, min_chars: int = MIN_CHARS):
        q = Q if k == 0 else max(3, min_chars // (k + 1))  # the bound needs shorter q-grams when edits are allowed
        self.k, self.q, self.min_chars = k, q, min_chars
        self.need = max(1, min_chars - q + 1 - k * q)
        plain = [joined(t) for t in texts]
        self.n_words = np.array([x.count(" ") + 1 if x else 0 for x in plain], np.int64)
        self.ids = ids
        self.starts = np.cumsum([0, *[len(x) + 1 for x in plain]])[:-1].astype(np.int64)
        self.text = codes(ITEM_END.join(plain))
        self.prefixes = Prefixes(self.text)
        h = self.prefixes.qgrams(q)
        inside = np.ones(len(h), bool)
        for cut in np.flatnonzero(self.text == ord(ITEM_END)):  # no q-gram spans two items
            inside[max(0, cut - q + 1):cut + 1] = False
        at = np.flatnonzero(inside)
        before = np.where(at > 0, self.text[at - 1], ord(ITEM_END)).astype(np.uint64)
        order = np.lexsort((before, h[at]))
        at, before = at[order], before[order]
        self.hashes, group = np.unique(h[at], return_inverse=True)
        self.first = np.searchsorted(group, np.arange(len(self.hashes) + 1))
        #: Group and character before, in the order of `at`.
        self.with_before = (group.astype(np.uint64) << np.uint64(21)) + before
        self.at = at.astype(np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def item_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, pos, side="right") - 1

    def runs(self, c: np.ndarray, own: Prefixes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(begin in the documents, begin in the items, length) of all runs of equal characters with a q-gram, in slices."""
        if not len(self.hashes) or len(c) < self.q:
            return
        h = own.qgrams(self.q)
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        group = np.searchsorted(self.hashes, h[maybe])
        group = np.minimum(group, len(self.hashes) - 1)
        same = self.hashes[group] == h[maybe]
        doc, group = maybe[same], group[same]
        # Of the places of an equal q-gram, those after the same character continue a run that began before.
        before = np.where(doc > 0, c[doc - 1], ord(DOC_END)).astype(np.uint64)
        key = (group.astype(np.uint64) << np.uint64(21)) + before
        low, high = np.searchsorted(self.with_before, key, side="left"), np.searchsorted(self.with_before, key, side="right")
        for a, b in ((self.first[group], low), (high, self.first[group + 1])):
            many = b - a
            keep = many > 0
            part, a, many = doc[keep], a[keep], many[keep]
            total = np.concatenate(([0], np.cumsum(many)))
            for lo in range(0, int(total[-1]), PAIRS):
                n = np.arange(lo, min(lo + PAIRS, int(total[-1])))
                which = np.searchsorted(total, n, side="right") - 1
                i, j = part[which], self.at[a[which] + n - total[which]]
                yield i, j, run_lengths(own, i, self.prefixes, j)

    def exact(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document place, item, words) of the regions that, without edits, hold MIN_WORDS whole words in a row."""
        own = Prefixes(c)
        t = self.text
        blanks = np.concatenate(([0], np.cumsum(c == 32)))
        edge = lambda x, at: (at < 0) | (at >= len(x)) | (x[np.clip(at, 0, len(x) - 1)] <= 32)
        out: list[tuple[np.ndarray, ...]] = []
        for i, j, n in self.runs(c, own):
            # Without edits a band's count is met by a run of that many q-grams on one diagonal.
            fits = n - self.q + 1 >= self.need
            i, j, n = i[fits], j[fits], n[fits]
            # Between two places that are edges of words in both texts lies one word.
            words = blanks[i + n] - blanks[i] + (edge(c, i - 1) & edge(t, j - 1)) + (edge(c, i + n) & edge(t, j + n)) - 1
            fits = words >= MIN_WORDS
            i, j, n, words = i[fits], j[fits], n[fits], words[fits]
            true = np.array([banded_distance(c[x:x + m], t[y:y + m], 0) == 0 for x, y, m in zip(i, j, n)], bool)
            out.append((i[true], self.item_of(j[true]), words[true]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3

    def regions(self, c: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, first and last shared place in `c`, diagonal) of the regions that meet the lemma's bound with edits."""
        found = []
        for i, j, n in self.runs(c, Prefixes(c)):
            # A run that meets the bound by itself is told by as many q-grams at its end and after each q characters.
            for x, y, m in zip(i, j, n - self.q + 1):
                steps = np.arange(m)
                steps = steps[(steps % self.q < self.need) | (steps >= m - self.need)]
                found.append((x + steps, np.full(len(steps), x - y), np.full(len(steps), self.item_of(y))))
        if not found:
            return []
        doc, diagonal, item = (np.concatenate(x) for x in zip(*found))
        band = diagonal // BAND
        twin = diagonal - band * BAND < self.k  # bands overlap by k diagonals
        doc, item, diagonal = (np.concatenate((x, x[twin])) for x in (doc, item, diagonal))
        band = np.concatenate((band, band[twin] - 1))
        order = np.lexsort((doc, band, item))
        doc, item, band, diagonal = doc[order], item[order], band[order], diagonal[order]
        # A window of `need` shared q-grams in a row of one item and band must fit into one passage's length.
        last = self.need - 1
        if len(doc) <= last:
            return []
        n = len(doc) - last
        fits = (item[:n] == item[last:]) & (band[:n] == band[last:]) & (doc[last:] - doc[:n] <= self.min_chars - self.q + self.k)
        out: list[tuple[int, int, int, int, int]] = []
        for i in np.flatnonzero(fits):
            j = i + last
            if out and out[-1][0] == item[i] and out[-1][4] == band[i] and doc[i] <= out[-1][2] + self.q:
                out[-1] = (*out[-1][:2], max(out[-1][2], int(doc[j])), out[-1][3], band[i])
            else:
                out.append((int(item[i]), int(doc[i]), int(doc[j]), int(diagonal[i]), band[i]))
        return [x[:4] for x in out]

    def near_words(self, c: np.ndarray, first: int, last: int, diagonal: int, low: int, high: int) -> int:
        """The words of a region within the document [low, high) if it has at most k edits a passage length, else 0."""
        a, b = max(low, first), min(high, last + self.q)
        if b - a < self.q:
            return 0
        budget = self.k * max(1, (b - a) // self.min_chars)
        x, y = max(0, a - diagonal), max(0, b - diagonal)
        return int((c[a:b] == 32).sum()) + 1 if banded_distance(c[a:b], self.text[x:y], budget) <= budget else 0


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[str]]]:
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for pdf in frames:
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            plain = joined(text)
            if plain.count(" ") + 1 < MIN_WORDS:
                continue
            ids.append(doc)
            texts.append(plain)
            size += len(plain)
            if size > DOC_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _finder(index):
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix: ItemIndex = index.value
        for ids, texts in _batches(frames):
            starts = np.cumsum([0, *[len(x) + 1 for x in texts]]).astype(np.int64)
            c = codes(DOC_END.join(texts))
            if ix.k == 0:
                place, item, n = ix.exact(c)
            else:
                place, item, n = [], [], []
                for it, first, last, diagonal in ix.regions(c):
                    d = int(np.searchsorted(starts, first, side="right")) - 1
                    place.append(first)
                    item.append(it)
                    n.append(ix.near_words(c, first, last, diagonal, int(starts[d]), int(starts[d + 1]) - 1))
            out = pd.DataFrame({"d": np.searchsorted(starts, np.asarray(place, np.int64), side="right") - 1, "item": np.asarray(item, np.int64), "n_words": np.asarray(n, np.int64)})
            out = out[out["n_words"] >= MIN_WORDS].groupby(["d", "item"], as_index=False)["n_words"].max()
            if len(out):
                yield pd.DataFrame({"doc_id": [ids[d] for d in out["d"]], "item_id": [ix.ids[i] for i in out["item"]], "n_words": out["n_words"], "item_words": ix.n_words[out["item"]], "doc_words": [texts[d].count(" ") + 1 for d in out["d"]]})

    return find


def leaks(docs: DataFrame, items: DataFrame, k: int = 0) -> DataFrame:
    """OUT: each document with each item it shares a passage with; n_words is the longest shared run of words.

    `docs` has doc_id and text, `items` item_id and text. With k > 0 passages within k edits count, and n_words is the
    length of the verified region.
    """
    spark = docs.sparkSession
    items = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    chars = items.select(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(chars) // BLOCK_CHARS))
    todo = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", "text").distinct().collect()
        index = spark.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows], k))
        part = todo.mapInPandas(_finder(index), OUT)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("item_words").alias("item_words"), F.max("doc_words").alias("doc_words"))
