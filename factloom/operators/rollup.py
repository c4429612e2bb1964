"""Counts, precedence rollups, caps with gaps, budgets and islands.

Defined results: null groups are groups of their own; caps keep the first rows of a total order and name what they cut in
a gap row; an empty input rolls up to the given default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import tier_name, tier_rank


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def weakest_tier(tier: Column) -> Column:
    return tier_name(F.max(tier_rank(tier)))


def strongest_tier(tier: Column) -> Column:
    return tier_name(F.min(tier_rank(tier)))


def joined_set(value: Column, sep: str = ";") -> Column:
    """The distinct values of a group, sorted, in one text; the group must be an entity's evidence, not a table."""
    return F.array_join(F.array_sort(F.collect_set(value)), sep)


def precedence(value: Column, order: list[str], default: str) -> Column:
    """Of a group's values the one that comes first in `order`; others don't count. An aggregate."""
    rank = F.array_position(F.array(*map(F.lit, order)), value)
    best = F.min(F.when(rank > 0, rank)).cast("int")
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, order)), best), F.lit(default))


# Which class of a report's rows and gaps decides, reports differing in where Unknown stands.
PORTFOLIO = ["UnknownAnalysisGap", "Truncated", "Actionable", "NeedsReview", "PartialAnalysis", "SelectorNoMatch"]
RELEASE = ["UnknownAnalysisGap", "TruncatedByLimit", "ActionableEvidence", "NeedsReview", "PartialAnalysis", "SelectorNoMatch"]
CONTRACT = ["ChangedContract", "AddedContract", "RemovedContract", "NeedsReviewDiff", "UnknownAnalysisGap"]
PATHS = ["StrongStaticPath", "ProbableStaticPath", "NeedsReviewPath", "UnknownAnalysisGap"]


def shared_groups(rows: DataFrame, key: str, source: str, tier: str, id_: str) -> DataFrame:
    """Keys that more than one row has: rows, distinct sources, weakest tier and the sources' list."""
    out = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(source).alias("n_sources"), weakest_tier(F.col(tier)).alias("weakest_tier"), joined_set(F.col(source)).alias("sources"), F.min(id_).alias("first_id"))
    return out.where(F.col("n_rows") > 1)


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return count_by(rows, *keys).where(F.col("n") > 1)


def islands(rows: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values in the order of a partition: island number, value, length, first and last place."""
    w = Window.partitionBy(*part).orderBy(*order)
    new = (~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)).cast("int")
    numbered = rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*part, "island").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n_rows"), F.min(F.struct(*order)).alias("__a"), F.max(F.struct(*order)).alias("__b")).select(*part, "island", value, "n_rows", F.col(f"__a.{order[0]}").alias("first_at"), F.col(f"__b.{order[0]}").alias("last_at"))


def capped(rows: DataFrame, order: list[Column], cap: int, gap: str) -> tuple[DataFrame, DataFrame]:
    """The first `cap` rows of a total order, and one gap row with the number cut off, if any."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).limit(cap), total.where(F.col("total") > cap).select(F.lit(gap).alias("gap"), F.lit(cap).alias("kept"), (F.col("total") - cap).alias("cut"))


def with_budget(rows: DataFrame, order: list[str], wanted: str, budget: int) -> DataFrame:
    """How much of a total budget each row gets, in order: `granted`, at most what it wants and what is left.

    The running sum is taken in two steps, within ranges of the order and then over the ranges, so that no task sorts all.
    """
    first = rows.select(F.col(order[0]).alias("k")).stat.approxQuantile("k", [i / 32 for i in range(1, 32)], 0.01) if dict(rows.dtypes)[order[0]] in ("int", "bigint", "double", "float") else []
    part = F.lit(0)
    for edge in sorted(set(first)):
        part = part + (F.col(order[0]) > F.lit(edge)).cast("int")
    r = rows.withColumn("__part", part)
    sums = r.groupBy("__part").agg(F.sum(wanted).alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.join(F.broadcast(sums.select("__part", before.alias("__before"))), "__part")
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.col("__before") + F.coalesce(F.sum(wanted).over(w), F.lit(0))
    return r.withColumn("granted", F.greatest(F.lit(0), F.least(F.col(wanted), F.lit(budget) - used))).drop("__part", "__before")


def severity(classification: Column, tier: Column) -> Column:
    """The ordinal severity of a release finding."""
    strong = tier.isin("Tier1Semantic", "Tier2Structural")
    return F.when(classification.startswith("Unknown"), F.lit("Unknown")).when(classification == "NoActionableEvidence", F.lit("Info")).when(classification.isin("StaticImpactEvidence", "ProbableStaticImpact", "AddedEvidence", "RemovedEvidence") & strong, F.lit("High")).when(classification == "ChangedEvidence", F.lit("Medium")).otherwise(F.lit("Low"))


def attention(severity_: Column) -> Column:
    return F.when(severity_ == "High", F.lit("review-first")).when(severity_.isin("Medium", "Unknown"), F.lit("review")).otherwise(F.lit("note"))


def reduction_class(gap: Column, review: Column, definite: Column, probable: Column, structural: Column, textual: Column, combined: bool) -> Column:
    """The class of a contract change from what its matched facts hold; all arguments are aggregates."""
    names = ("StaticImpactEvidence", "ProbableStaticImpact", "NeedsReviewImpact") if combined else ("DefiniteImpact", "ProbableImpact", "NeedsReview")
    return F.when(gap, F.lit("UnknownAnalysisGap")).when(review, F.lit(names[2])).when(definite, F.lit(names[0])).when(probable | structural, F.lit(names[1])).when(textual, F.lit(names[2])).otherwise(F.lit("UnknownAnalysisGap"))


def no_match_class(full: Column, combined: bool) -> Column:
    if combined:
        return F.when(full, F.lit("NoImpactEvidence")).otherwise(F.lit("UnknownAnalysisGap"))
    return F.when(full, F.lit("NoEvidenceFullCoverage")).otherwise(F.lit("NoEvidenceReducedCoverage"))
