"""What changed between consecutive full snapshots.

Snapshots of a series are numbered by time. Each key's rows are windowed by snapshot number: a lagged state hash shows
changes, gaps in the numbers show removals and later additions. Windows are cut into blocks of BLOCK numbers, and a
row at a block's end is repeated in the next block, so a key that lives in ever so many snapshots is never one task.

Defined results: repeated rows of a key in a snapshot count once (latest delivery, ties by the greater state). The
first snapshot of a series yields nothing. Rows of unknown snapshots or with a null key are left out; a snapshot
without rows removes every key of the one before. Texts that are no JSON object compare as plain text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import BROADCAST_ROWS, cut, hot_keys, key_hash, latest, lookup, row_bound

BLOCK = 256


def instant(text: Column) -> Column:
    """The instant of an ISO-8601 text with any offset; null where it is none."""
    return F.try_to_timestamp(text)


def numbered_scans(manifest: DataFrame, series: list[str], scan: str, at: str, order: str = "ingested_at") -> DataFrame:
    """(scan, series, idx, last): the scans of each series numbered from 0 by their instant, ties by name.

    Scans are numbered within each month, and a running sum over the series' months is added, so that a series with ever
    so many scans is sorted by several tasks. `last` is the number of its last scan; scans without instant come first.
    """
    src = manifest.where(F.col(scan).isNotNull()).select(F.col(scan).alias("scan"), F.col(order).alias("o"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(series)], F.col(at).alias("at"))
    names = [f"s{i}" for i in range(len(series))]
    one = latest(src, ["scan"], "o", [*names, "at"]).select("scan", key_hash(*names).alias("series"), instant(F.col("at")).alias("at"))
    one = one.withColumn("month", F.coalesce(F.date_format("at", "yyyyMM").cast("int"), F.lit(0)))
    months = one.groupBy("series", "month").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("series").orderBy("month")
    months = months.select("series", "month", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), (F.sum("n").over(Window.partitionBy("series")) - 1).cast("int").alias("last"))
    within = F.row_number().over(Window.partitionBy("series", "month").orderBy(F.col("at").asc_nulls_first(), "scan")) - 1
    return one.withColumn("r", within).join(months, ["series", "month"]).select("scan", "series", (F.col("before") + F.col("r")).cast("int").alias("idx"), "last")


def map_text(json_text: Column) -> Column:
    """A text equal for equal JSON objects of plain values, whatever their key order and spacing."""
    parsed = F.from_json(json_text, "map<string,string>")
    return F.coalesce(F.to_json(F.array_sort(F.map_entries(parsed))), json_text)


def state_hash(*parts: Column) -> Column:
    return F.xxhash64(*[F.coalesce(p, F.lit("\0null")) for p in parts])


def changes(rows: DataFrame, scans: DataFrame, block: int = BLOCK) -> DataFrame:
    """(scan_id, key, change_kind) from rows (scan, key, at, state) and numbered scans: added, removed or changed."""
    scans = cut(scans)  # looked up twice
    one = latest(rows.where(F.col("key").isNotNull() & F.col("scan").isNotNull()), ["scan", "key"], "at", ["state"])
    small = row_bound(scans, BROADCAST_ROWS)
    placed = lookup(one, scans, ["scan"], "inner", small=small, hot=None if small else hot_keys(rows, "scan"), hot_col="scan")
    here = F.struct(F.floor(F.col("idx") / block).alias("b"), F.lit(True).alias("own"))
    next_ = F.struct(F.floor((F.col("idx") + 1) / block).alias("b"), F.lit(False).alias("own"))
    spread = F.explode(F.when((F.col("idx") + 1) % block == 0, F.array(here, next_)).otherwise(F.array(here)))
    cut_up = placed.select("series", "key", "idx", "last", "state", spread.alias("x")).select("series", "key", "idx", "last", "state", "x.b", "x.own")
    w = Window.partitionBy("series", "key", "b").orderBy("idx")
    seen = cut_up.select("series", "key", "idx", "last", "state", "own", "b", F.lag("idx").over(w).alias("before"), F.lag("state").over(w).alias("state_before"), F.lead("idx").over(w).alias("after"))
    idx, own = F.col("idx"), F.col("own")
    follows = F.coalesce(F.col("before") == idx - 1, F.lit(False))
    came = F.when(own & ~follows & (idx > 0), F.struct(idx.alias("idx"), F.lit("added").alias("kind")))
    differs = F.when(own & follows & (F.col("state") != F.col("state_before")), F.struct(idx.alias("idx"), F.lit("changed").alias("kind")))
    # The copy at the block's end, not the row itself, sees the next number there.
    judges_next = F.when((idx + 1) % block == 0, ~own).otherwise(own)
    gone = F.when(judges_next & (idx < F.col("last")) & F.coalesce(F.col("after") != idx + 1, F.lit(True)), F.struct((idx + 1).alias("idx"), F.lit("removed").alias("kind")))
    events = seen.select("series", "key", F.explode(F.filter(F.array(came, differs, gone), lambda x: x.isNotNull())).alias("e")).select("series", "key", "e.idx", "e.kind")
    names = scans.select("series", "idx", F.col("scan").alias("scan_id"))
    told = events.join(F.broadcast(names) if small else names, ["series", "idx"])
    return told.select("scan_id", "key", F.col("kind").alias("change_kind"))
