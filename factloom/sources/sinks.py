"""Writing evidence: indexes as Parquet, NDJSON, bounded reports, graphs and chunks for search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.rollup import capped


def write_index(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet folder a table, facts split by type; what was there is replaced."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("fact_type") if name == "facts" else writer).parquet(f"{folder}/{name}.parquet")


def write_facts_ndjson(facts: DataFrame, path: str) -> None:
    """One fact a line, in the shape of the fact contract."""
    c = F.col
    evidence = F.struct(c("file_path").alias("filePath"), c("start_line").alias("startLine"), c("end_line").alias("endLine"), c("snippet_hash").alias("snippetHash"), c("extractor_id").alias("extractorId"), c("extractor_version").alias("extractorVersion"))
    names = {"factId": "fact_id", "scanId": "scan_id", "repo": "repo", "commitSha": "commit_sha", "projectPath": "project_path", "factType": "fact_type", "ruleId": "rule_id", "evidenceTier": "evidence_tier", "sourceSymbol": "source_symbol", "targetSymbol": "target_symbol", "contractElement": "contract_element"}
    facts.select(*[c(v).alias(k) for k, v in names.items()], evidence.alias("evidence"), T.properties(c("properties_json")).alias("properties")).write.mode("overwrite").json(path)


def summary_lines(rows: DataFrame, by: str, kind: str) -> DataFrame:
    """Each group's counts of kinds as one line: kind:count, in order."""
    counts = rows.groupBy(by, kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(kind, "n"))), lambda x: F.concat(x[kind], F.lit(":"), x["n"].cast("string"))), ";").alias("summary"))


def markdown(rows: DataFrame, title: str, order: list[str], cap: int = 500) -> str:
    """A table of at most `cap` rows in a total order, and a line that says what was cut."""
    kept, gap = capped(rows, [F.col(x) for x in order], cap, "ReportRowLimit")
    cells = lambda r: " | ".join(str("" if v is None else v).replace("|", "\\|").replace("\n", " ") for v in r)
    lines = [f"# {title}", "", f"| {' | '.join(rows.columns)} |", f"|{' --- |' * len(rows.columns)}", *[f"| {cells(r)} |" for r in kept.collect()]]
    lines += [f"\n{r['cut']} more rows were cut ({r['gap']} {r['kept']})." for r in gap.collect()]
    return "\n".join(lines) + "\n"


def mermaid(edges: DataFrame, cap: int = 500) -> str:
    """A flow chart of at most `cap` edges (source, kind, target), in their order, and a node that says what was cut."""
    kept, gap = capped(edges.select("source", "kind", "target").distinct(), [F.col("source"), F.col("kind"), F.col("target")], cap, "DiagramEdgeLimit")
    rows, cut = kept.collect(), gap.collect()
    ids = {n: f"n{i}" for i, n in enumerate(sorted({x for r in rows for x in (r["source"], r["target"])}))}
    label = lambda n: n.replace('"', "'")
    return "\n".join(["flowchart LR", *[f'  {i}["{label(n)}"]' for n, i in ids.items()], *[f"  {ids[r['source']]} -->|{r['kind']}| {ids[r['target']]}" for r in rows], *[f'  cut["{g["cut"]} more edges were cut ({g["gap"]} {g["kept"]})"]' for g in cut]]) + "\n"


def evidence_chunks(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(chunk_id, payload): rows as JSON with an id that depends on their key only."""
    return rows.select(T.piped_id("chunk-", 24, *[F.col(k) for k in key]).alias("chunk_id"), F.to_json(F.struct(*key, *fields)).alias("payload"))
