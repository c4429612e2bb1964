"""A Bloom filter as a DataFrame: rows of LINE 64-bit words, built by an aggregation and probed by a broadcast lookup.

Every key sets PROBES bits of one word, so that building needs one partial aggregation (bit_or a word) and probing one
lookup of a line. A filter has BITS_A_KEY bits for each key, however many there are. What is broadcast is bounded: a filter
holds at most MAX_WORDS words (128 MB), and beyond that the keys are split by their hash into several filters (see
sharded), each probed by its own share of the references. It never denies a key that was added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut, union

#: Words of one filter at most and at least, and words of a row.
MAX_WORDS, MIN_WORDS, LINE = 1 << 24, 1 << 10, 1 << 6
BITS_A_KEY = 16
PROBES = 4


def words_for(keys: int) -> tuple[int, int]:
    """(words of a filter, a power of two, filters) for so many keys."""
    need = max(MIN_WORDS, keys * BITS_A_KEY // 64)
    return min(MAX_WORDS, 1 << (need - 1).bit_length()), -(-need // MAX_WORDS)


def _parts(cols: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("\0null")) for c in cols]


def _word(cols: list[Column], words: int) -> Column:
    return F.xxhash64(F.lit(11), *cols).bitwiseAND(F.lit(words - 1))


def _mask(cols: list[Column]) -> Column:
    h = F.xxhash64(F.lit(29), *cols)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def build(df: DataFrame, cols: list[str], words: int) -> DataFrame:
    """(line, bits) of the filter over the keys `cols` of `df`; null parts count as values of their own."""
    parts = _parts(cols)
    one = df.select(_word(parts, words).alias("word"), _mask(parts).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    line = one.groupBy(F.shiftright("word", LINE.bit_length() - 1).alias("line")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(LINE - 1)).alias("k"), "bits"))).alias("m"))
    return line.select("line", F.transform(F.sequence(F.lit(0), F.lit(LINE - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0).cast("long"))).alias("bits"))


def probe(df: DataFrame, cols: list[str], lines: DataFrame, words: int, out: str) -> DataFrame:
    """`df` with the boolean `out`: false proves that the key was never added."""
    parts = _parts(cols)
    side = F.broadcast(lines.select(F.col("line").alias("__l"), F.col("bits").alias("__b")))
    asked = df.withColumns({"__word": _word(parts, words), "__mask": _mask(parts)})
    bits = F.element_at("__b", F.col("__word").bitwiseAND(F.lit(LINE - 1)).cast("int") + 1)
    hit = F.coalesce(bits.bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False))
    return asked.join(side, F.shiftright("__word", LINE.bit_length() - 1) == F.col("__l"), "left").withColumn(out, hit).drop("__word", "__mask", "__l", "__b")


def sharded(df: DataFrame, cols: list[str], keys: DataFrame, n_keys: int, out: str) -> DataFrame:
    """`df` with the boolean `out` by filters over `keys`, as many as so many keys need; each sees its share of both."""
    words, filters = words_for(n_keys)
    if filters == 1:
        return probe(df, cols, build(keys, cols, words), words, out)
    share = F.pmod(F.xxhash64(F.lit(7), *_parts(cols)), F.lit(filters))
    df = cut(df)  # read once for each filter
    return union([probe(df.where(share == i), cols, build(keys.where(share == i), cols, words), words, out) for i in range(filters)])
