"""Queries p3, p4 and p6 to p9 over whole tables, and the SQL that checks what SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import latest, table
from . import abuse, bpe, handwritten, leakage, parsing, secrets


def _documents(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", *cols)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", bpe.encode_column("text").alias("ids"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Token counts a source, and how many texts don't come back whole when decoded (none should)."""
    coded = _documents(spark, d, "source").withColumn("ids", bpe.encode_column("text"))
    back = coded.withColumn("broken", (bpe.decode_column("ids") != F.coalesce("text", F.lit(""))).cast("int"))
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("ids")).cast("long").alias("n_tokens"), F.sum("broken").cast("long").alias("n_broken"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_documents(spark, d), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """For each leaked item: the documents that hold some of it, and those that hold all."""
    whole = (F.col("n_words") >= F.col("item_words")).cast("int")
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(whole).cast("long").alias("n_whole"), F.max("n_words").alias("longest_run"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items of which they hold a passage with at most one edit in each passage length."""
    return leakage.leaks(_documents(spark, d), table(spark, d, "benchmark"), k=1).select("doc_id", "item_id", "n_words")


def _fact_texts(spark: SparkSession, d: str) -> DataFrame:
    """(scan_id, fact_id, properties_json) of each fact's latest delivery; texts that can't hold a secret are null, so
    that the shuffle by key doesn't carry them."""
    text = F.when(secrets.may_hold("properties_json"), F.col("properties_json")).alias("properties_json")
    facts = table(spark, d, "facts").select("scan_id", "fact_id", "ingested_at", text)
    return latest(facts, ["scan_id", "fact_id"], "ingested_at", ["properties_json"]).where(F.col("properties_json").isNotNull())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    facts = secrets.found_lines(_fact_texts(spark, d), "properties_json", ["scan_id", "fact_id"], one_line=True)
    files = secrets.found_lines(table(spark, d, "file_inventory"), "content", ["scan_id", "relative_path"])
    parts = [x.select(F.lit(name).alias("table_name"), "scan_id", F.col(key).alias("item_key"), "line_no") for name, x, key in (("facts", facts, "fact_id"), ("file_inventory", files, "relative_path"))]
    return parts[0].unionByName(parts[1].distinct())


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The items that hold secrets, with their texts redacted."""
    facts = _fact_texts(spark, d).select(F.lit("facts").alias("table_name"), "scan_id", F.col("fact_id").alias("item_key"), F.col("properties_json").alias("text"))
    files = table(spark, d, "file_inventory").where(secrets.may_hold("content")).select(F.lit("file_inventory").alias("table_name"), "scan_id", F.col("relative_path").alias("item_key"), F.col("content").alias("text"))
    both = facts.unionByName(files).withColumn("clean", secrets.redacted("text"))
    return both.where(F.col("clean") != F.col("text")).select("table_name", "scan_id", "item_key", F.col("clean").alias("text")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Items and lines with secrets a scan and table."""
    return p3_found(spark, d).groupBy("table_name", "scan_id").agg(F.countDistinct("item_key").alias("n_items"), F.count(F.lit(1)).alias("n_lines"))


def _not_handwritten(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "file_inventory"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _not_handwritten(spark, d).select("scan_id", "relative_path").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Items that nobody wrote by hand a repository and kind of case."""
    return _not_handwritten(spark, d).groupBy("repo", "verdict").agg(F.count(F.lit(1)).alias("n_items"))


def p4_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts left a repository and type once those of such files are left out."""
    facts = latest(table(spark, d, "facts").select("scan_id", "fact_id", "ingested_at", "repo", "fact_type", "file_path"), ["scan_id", "fact_id"], "ingested_at", ["repo", "fact_type", "file_path"])
    drop = p4_found(spark, d).withColumnRenamed("relative_path", "file_path")
    return facts.join(drop, ["scan_id", "file_path"], "left_anti").groupBy("repo", "fact_type").agg(F.count(F.lit(1)).alias("n_facts"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.judged(table(spark, d, "file_inventory")).where(~F.col("ok")).select("scan_id", "relative_path").distinct()


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rates(parsing.judged(table(spark, d, "file_inventory")))


def _scores(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    docs = _documents(spark, d, "source")
    return abuse.scored(docs, abuse.fitted(docs, table(spark, d, "labels")), ["doc_id", *keep])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where(F.col("score") > abuse.THRESHOLD).select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each document's score and flag."""
    return _scores(spark, d, "source").select("doc_id", "source", F.round("score", 6).alias("score"), (F.col("score") > abuse.THRESHOLD).alias("flagged"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Flagged documents a source."""
    hit = (F.col("score") > abuse.THRESHOLD).cast("long")
    return _scores(spark, d, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(hit).alias("n_flagged"), F.round(F.avg(hit), 6).alias("rate"))


QUERIES = {f.__name__: f for f in (p3_found, p3_redacted, p3_report, p4_found, p4_report, p4_facts, p6_found, p6_rates, p7_ids, p7_report, p8_found, p8_items, p8_near, p9_found, p9_scores, p9_rates)}

_P8 = r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where text is not null),
     b as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from benchmark),
     g as (select distinct item_id, array_to_string(w[i:i+11], ' ') k from b, range(1, greatest(len(w) - 10, 1)) r(i)),
     h as (select distinct doc_id, array_to_string(w[i:i+11], ' ') k from d, range(1, greatest(len(w) - 10, 1)) r(i))
select distinct h.doc_id, g.item_id from h join g using (k)
"""
_P8_ITEMS = r"""
with d as (select distinct doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where text is not null),
     b as (select distinct item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from benchmark),
     g as (select item_id, len(w) item_words, i, array_to_string(w[i:i+11], ' ') k from b, range(1, greatest(len(w) - 10, 1)) r(i)),
     h as (select doc_id, i, array_to_string(w[i:i+11], ' ') k from d, range(1, greatest(len(w) - 10, 1)) r(i)),
     m as (select h.doc_id, g.item_id, g.item_words, h.i, h.i - g.i diagonal from h join g using (k)),
     runs as (select doc_id, item_id, item_words, diagonal, i - row_number() over (partition by doc_id, item_id, diagonal order by i) run from m),
     best as (select doc_id, item_id, item_words, max(n) + 11 n_words from (select doc_id, item_id, item_words, count(*) n from runs group by doc_id, item_id, item_words, diagonal, run) group by all)
select item_id, count(*) as n_docs, count_if(n_words >= item_words)::bigint as n_whole, max(n_words) as longest_run from best group by 1
"""
ORACLES = {"p8_found": _P8, "p8_items": _P8_ITEMS}
