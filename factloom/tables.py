"""Reading tables, cutting lineage, de-duplicating keys and skew-proof lookups: what every operator shares."""

from __future__ import annotations

import os
import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that makes up at least this share of the left side of a lookup is treated as hot.
HOT_SHARE = 0.01
#: Rows up to which a lookup side counts as small enough to broadcast (about 16 MB of narrow rows).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is configured a single-machine session gets one of its own; any other
    one is refused, as its machines share no folder that we could choose."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not conf and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(conf or os.path.join(tempfile.gettempdir(), "factloom-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from the written copy; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def latest(df: DataFrame, keys: list[str], order: str, cols: list[str], first: str | None = None) -> DataFrame:
    """One row a key: `cols` of the row with the greatest `order`; ties go to the greatest contents, null orders lose.

    With `first`, also the least `order` of the key under that name. It is an aggregation, not a window, so repeated
    rows of a hot key are combined before the shuffle.
    """
    aggs = [F.max(F.struct(F.col(order), *[F.col(c) for c in cols])).alias("__last")]
    if first:
        aggs.append(F.min(F.col(order)).alias(first))
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in cols], *([first] if first else []))


def row_bound(df: DataFrame, bound: int) -> bool:
    """Whether `df` has at most `bound` rows; reads no further than that."""
    return df.limit(bound + 1).count() <= bound


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """The values of `key` that hold at least `share` of the rows; nulls are never among them.

    A Misra-Gries summary over all rows names at most 1/share candidates (a superset), a second pass counts just those;
    nothing is shuffled but summaries and counts.
    """
    keys = df.select(F.col(key).alias("k")).where(F.col("k").isNotNull())
    found = keys.stat.freqItems(["k"], max(share, 1e-3)).first()
    if not found or not found[0]:
        return []
    counts = keys.groupBy(F.when(F.col("k").isin(list(found[0])), F.col("k")).alias("k")).count().collect()
    least = share * sum(r["count"] for r in counts)
    return [r["k"] for r in counts if r["k"] is not None and r["count"] >= max(least, 2)]


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", small: bool | None = None, hot: list | None = None, hot_col: str | None = None) -> DataFrame:
    """`left` joined to `right`, which has one row a key at most.

    A right side of checked size is broadcast. Otherwise the hot keys of the left side (`hot`, hashes or values found in
    `hot_col` of either side) go through a broadcast of just their right rows (at most one a hot key), and only the
    rest is shuffled, so no task gets more than HOT_SHARE of the left rows by one key.
    """
    if small is None:
        small = row_bound(right, BROADCAST_ROWS)
    if small:
        return left.join(F.broadcast(right), on, how)
    if hot and hot_col:
        is_hot = F.coalesce(F.col(hot_col).isin(hot), F.lit(False))
        a = left.where(is_hot).join(F.broadcast(right.where(is_hot)), on, how)
        b = left.where(~is_hot).join(right.where(~is_hot), on, how)
        return a.unionByName(b)
    return left.join(right, on, how)


def key_hash(*cols: Column | str) -> Column:
    """16 bytes that name a tuple of texts; each part is length-prefixed, so no two tuples share one input."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    pieces = [F.concat(F.coalesce(F.length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c.cast("string"), F.lit(""))) for c in parts]
    return F.unhex(F.md5(F.concat(*pieces)))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
