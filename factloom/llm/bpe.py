"""Byte-level BPE of whole texts with a public vocabulary.

A pre-token's symbols form a doubly linked list; a priority queue holds (merge rank, position) of neighbouring pairs.
Popping the least rank merges its pair, links the new symbol to its neighbours and pushes the two new pairs; entries
whose pair has changed since are skipped as stale. So a pre-token of n bytes costs O(n log n), however long it is.

Defined results: empty and null texts give an empty list of ids, never null. The strings of special tokens in a text
are ordinary text. Tied or repeated rows are encoded each for itself; extra columns are left alone.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE vocabularies of this kind split a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept a worker, and the longest kept.
CACHE_WORDS, CACHE_CHARS = 200_000, 40


def default_vocabulary() -> str:
    """Where the vocabulary lies: $FACTLOOM_TOKENIZERS or the image's folder of public tokenizers."""
    return os.path.join(os.environ.get("FACTLOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such files: itself where printable, else from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairEncoder:
    """Encodes and decodes with the vocabulary and merges of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        vocab = model["vocab"]
        # Pieces outside the byte alphabet are special tokens, which texts never yield.
        self.pieces = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if all(c in alphabet for c in s)}
        self.byte_ids = [0] * 256
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        symbol = [self.byte_ids[b] for b in data]
        n = len(symbol)
        if n < 2:
            return symbol
        merges = self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m[0], i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (m := merges.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if j < 0 or symbol[i] != a or symbol[j] != b:
                continue  # stale
            symbol[i] = merges[a, b][1]
            symbol[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((symbol[i], symbol[k])):
                    heapq.heappush(queue, (m[0], i, symbol[i], symbol[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbol[h], symbol[i]))):
                heapq.heappush(queue, (m[0], h, symbol[h], symbol[i]))
        return [s for s in symbol if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for word in self.split(text):
            ids = cache.get(word)
            if ids is None:
                ids = self.merge(word.encode("utf-8", "surrogatepass"))
                if len(word) <= CACHE_CHARS:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word] = ids
            out += ids
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(self.pieces[i] for i in ids)

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """One encoder a worker process."""
    return BytePairEncoder(path)


def encode_column(text: Column | str, path: str | None = None) -> Column:
    """array<int> of a text column; [] for null and empty texts."""
    where = path or default_vocabulary()

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(where)
        for texts in batches:
            yield pd.Series([bpe.encode(t) for t in texts], dtype=object)

    return encode(text)


def decode_column(ids: Column | str, path: str | None = None) -> Column:
    """The text of a column of ids, '' for null and empty lists."""
    where = path or default_vocabulary()

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(where)
        for lists in batches:
            yield pd.Series(["" if x is None else bpe.decode(x) for x in lists], dtype=object)

    return decode(ids)
