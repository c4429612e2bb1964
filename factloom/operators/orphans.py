"""References to records that do not exist, or that arrived only after the record that refers to them.

A Bloom filter over all parent keys is broadcast (several, by the keys' hash, where one would grow beyond its bound); a
reference whose key it denies is a proven orphan. Only the
references that pass are joined to the parents' first deliveries. Orphans may then be looked up in other scopes, where
a second filter over the orphans' keys keeps the parents that matter.

Defined results: a null key refers to nothing and is never reported; an empty text is a key like any other. Repeated
rows of a record count once: the latest delivery holds its key, the earliest says when it came. A record or parent
without delivery time is never late and makes none late. Empty tables give no rows (or all references, if the
parents' table is empty). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import HOT_SHARE, cut, hot_keys, latest, lookup, union
from . import bloom


def references(df: DataFrame, table_name: str, row_key: str, fields: dict[str, str], scope: str | None, order: str = "ingested_at") -> DataFrame:
    """(table_name, field_name, parent, row_key, scope, key, seen_at): one row for each non-null reference.

    `fields` maps a column of `df` to the kind of parent it names; `scope` is the column within which keys are looked up.
    """
    cols = [*fields, *([scope] if scope and scope not in fields else [])]
    src = df.where(F.col(row_key).isNotNull()).select(F.col(row_key).alias("__key"), F.col(order).alias("__order"), *[F.col(c).alias(f"c_{c}") for c in cols])
    one = latest(src, ["__key"], "__order", [f"c_{c}" for c in cols], first="seen_at")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.lit(kind).alias("parent"), F.col(f"c_{c}").alias("key")) for c, kind in fields.items()]))
    out = one.select(F.col("__key").alias("row_key"), (F.col(f"c_{scope}") if scope else F.lit("")).alias("scope"), "seen_at", pairs.alias("r"))
    return out.select(F.lit(table_name).alias("table_name"), "r.field_name", "r.parent", "row_key", "scope", "r.key", "seen_at").where(F.col("key").isNotNull())


def parents(df: DataFrame, kind: str, key: str, scope: str | None, order: str = "ingested_at") -> DataFrame:
    """(parent, scope, key, at): the deliveries of the records that references of this kind may name."""
    return df.where(F.col(key).isNotNull()).select(F.lit(kind).alias("parent"), (F.col(scope) if scope else F.lit("")).alias("scope"), F.col(key).alias("key"), F.col(order).cast("timestamp").alias("at"))


def reference_keys(df: DataFrame, fields: dict[str, str], scope: str | None) -> DataFrame:
    """h: the keys' hashes of all delivered rows, repeats included; enough to tell hot keys, and read without a shuffle."""
    within = F.col(scope) if scope else F.lit("")
    keys = F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(kind), within, F.col(c))) for c, kind in fields.items()]))
    return df.select(keys.alias("h"))


def orphans(refs: DataFrame, parent_rows: DataFrame, elsewhere_tables: list[str], share: float = HOT_SHARE, raw_keys: DataFrame | None = None) -> DataFrame:
    """(table_name, field_name, row_key, status, seen_at) of the references that are `missing`, `late` or `elsewhere`.

    `elsewhere` is given only for references of `elsewhere_tables`: the key is absent in its own scope, present in another.
    `raw_keys` (see reference_keys) saves looking for hot keys in the references themselves.
    """
    id_cols = ["parent", "scope", "key"]
    asked = bloom.sharded(refs, id_cols, parent_rows, parent_rows.count(), "maybe")
    asked = asked.withColumn("h", F.xxhash64(*id_cols))
    definite = asked.where(~F.col("maybe"))
    positive = asked.where(F.col("maybe"))
    first = parent_rows.groupBy(*id_cols).agg(F.min("at").alias("first_at"), F.lit(True).alias("there")).withColumn("h", F.xxhash64(*id_cols))
    hot = hot_keys(refs.select(F.xxhash64(*id_cols).alias("h")) if raw_keys is None else raw_keys, "h", share)
    checked = lookup(positive, first, [*id_cols, "h"], "left", small=False, hot=hot, hot_col="h")
    status = F.when(F.col("there").isNull(), F.lit("missing")).when(F.col("first_at") > F.col("seen_at"), F.lit("late"))
    cols = ["table_name", "field_name", "parent", "key", "row_key", "seen_at", "status"]
    bad = union([definite.withColumn("status", F.lit("missing")).select(*cols), checked.withColumn("status", status).where(F.col("status").isNotNull()).select(*cols)])
    bad = cut(bad)

    strays = bad.where((F.col("status") == "missing") & F.col("table_name").isin(elsewhere_tables))
    near = bloom.sharded(parent_rows, ["parent", "key"], strays, strays.count(), "maybe")
    known = near.where(F.col("maybe")).select("parent", "key").distinct().withColumns({"known": F.lit(True), "h": F.xxhash64("parent", "key")})
    keyed = strays.withColumn("h", F.xxhash64("parent", "key"))
    told = lookup(keyed, known, ["parent", "key", "h"], "left", small=False, hot=hot_keys(keyed, "h", share), hot_col="h")
    told = told.withColumn("status", F.when(F.col("known"), F.lit("elsewhere")).otherwise(F.lit("missing")))
    rest = bad.where(~((F.col("status") == "missing") & F.col("table_name").isin(elsewhere_tables)))
    out = ["table_name", "field_name", "row_key", "status", "seen_at"]
    return told.select(*out).unionByName(rest.select(*out))


def orphans_by_month(found: DataFrame) -> DataFrame:
    """Counts a table, field, month of the referring row's first delivery and status; a row without time has month null."""
    month = F.date_format("seen_at", "yyyy-MM").alias("month")
    return found.groupBy("table_name", "field_name", month, "status").agg(F.count(F.lit(1)).alias("n_rows"))
