"""Reading evidence: fact NDJSON, indexes as Parquet or SQLite, deltas, manifests of packages and source trees.

Missing tables or columns of an index are read as empty ones, so that older or partial indexes degrade instead of
failing. Invalid lines keep their text in `_corrupt_record`.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema as S
from ..functions import text as T


def facts_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Facts of newline-delimited JSON, flattened to the columns of the facts table."""
    raw = spark.read.schema(S.FACT_JSON).json(path)
    return flatten_facts(raw)


def flatten_facts(raw: DataFrame) -> DataFrame:
    names = {"fact_id": "factId", "scan_id": "scanId", "repo": "repo", "commit_sha": "commitSha", "project_path": "projectPath", "fact_type": "factType", "rule_id": "ruleId", "evidence_tier": "evidenceTier", "source_symbol": "sourceSymbol", "target_symbol": "targetSymbol", "contract_element": "contractElement", "file_path": "evidence.filePath", "start_line": "evidence.startLine", "end_line": "evidence.endLine", "snippet_hash": "evidence.snippetHash", "extractor_id": "evidence.extractorId", "extractor_version": "evidence.extractorVersion"}
    props = F.to_json(F.map_from_entries(T.sorted_map(F.coalesce("properties", F.create_map().cast("map<string,string>")))))
    return raw.select(*[F.col(v).alias(k) for k, v in names.items()], props.alias("properties_json"))


def index_kind(names: list[str]) -> str:
    """'combined' or 'single', by the tables that are there; raises where neither is."""
    have = set(names)
    if {"index_sources", "combined_facts"} <= have:
        return "combined"
    if {"scan_manifest", "facts"} <= have:
        return "single"
    raise ValueError(f"no index: {sorted(have)}")


def conform(df: DataFrame, schema) -> DataFrame:
    """The columns of `schema`, missing ones null; extra ones are kept behind them."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema], *[c for c in df.columns if c not in schema.names])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder in whatever file system its scheme names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def index_parquet(spark: SparkSession, folder: str, names: list[str] | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables of an index of Parquet folders, absent ones empty, and the names of those."""
    out, absent = {}, []
    for name, schema in S.TABLES.items():
        if names and name not in names:
            continue
        path = next((p for p in (f"{folder}/{name}.parquet", f"{folder}/{name}") if exists(spark, p)), None)
        if path is None:
            absent.append(name)
            out[name] = spark.createDataFrame([], schema)
        else:
            out[name] = conform(spark.read.parquet(path), schema)
    return out, absent


class _Rows(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.paths = [p for p in options["path"].split(",") if p]
        self.table, self.rows = options.get("table", "facts"), int(options.get("rowsPerPartition", "500000"))
        if not self.table.replace("_", "").isalnum():
            raise ValueError("table name")
        self.schema = schema

    def partitions(self) -> list[_Rows]:
        out = []
        for path in self.paths:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                there = c.execute("select count(*) from sqlite_master where name = ?", (self.table,)).fetchone()[0]
                low, high = c.execute(f"select min(rowid), max(rowid) from {self.table}").fetchone() if there else (None, None)
            if low is not None:
                out += [_Rows(path, i, min(i + self.rows - 1, high)) for i in range(low, high + 1, self.rows)]
        return out

    def read(self, part: _Rows | None) -> Iterator[tuple]:
        if part is None:  # no file has the table
            return
        with sqlite3.connect(f"file:{part.path}?mode=ro", uri=True) as c:
            have = {r[1] for r in c.execute(f"pragma table_info({self.table})")}
            cols = ", ".join(f.name if f.name in have else f"null as {f.name}" for f in self.schema)
            yield from c.execute(f"select {cols} from {self.table} where rowid between ? and ?", (part.low, part.high))


class SqliteIndexSource(DataSource):
    """format("factloom_sqlite"): a table of SQLite index files that all executors can read, split by row ids."""

    @classmethod
    def name(cls) -> str:
        return "factloom_sqlite"

    def schema(self):
        return S.TABLES.get(self.options.get("table", "facts"), S.FACT)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


def index_sqlite(spark: SparkSession, paths: list[str], table: str) -> DataFrame:
    spark.dataSource.register(SqliteIndexSource)
    return spark.read.format("factloom_sqlite").option("table", table).option("path", ",".join(paths)).load()


# ---- deltas and other small inputs


def contract_delta(spark: SparkSession, path: str) -> DataFrame:
    """(change_id, contract, element, kind, change_type, reference) of a contract delta of version 1 or 2.

    Raises where an id repeats, a change names no element, or the version is another.
    """
    raw = spark.read.schema("version string, contract string, source string, changes array<struct<id:string,kind:string,element:string,changeType:string,oldType:string,newType:string,value:string,reference:map<string,string>>>").option("multiLine", True).json(path)
    c = raw.select("contract", F.posexplode("changes").alias("i", "c"))
    ref = lambda *k: T.first_value(F.coalesce("c.reference", F.create_map().cast("map<string,string>")), *k)
    element = F.coalesce("c.element", F.concat_ws(".", ref("type", "typeName", "containingType"), ref("member", "memberName", "property", "method")), ref("endpoint", "path"))
    if raw.where(~F.coalesce(F.col("version"), F.lit("1")).rlike(r"^(?:contract-delta\.)?v?[12](?:\.\d+)?$")).limit(1).count():
        raise ValueError("a contract delta of another version")
    told = c.select(F.coalesce("c.id", F.concat(F.lit("change-"), (F.col("i") + 1).cast("string"))).alias("change_id"), "contract", element.alias("element"), F.coalesce("c.kind", F.lit("element")).alias("kind"), F.col("c.changeType").alias("change_type"), F.col("c.reference").alias("reference"))
    if told.where(T.blank(F.col("element"))).limit(1).count() or told.groupBy("change_id").count().where("count > 1").limit(1).count():
        raise ValueError("a change without an element or with the id of another")
    return told


def sql_schema_delta(spark: SparkSession, path: str) -> DataFrame:
    """Changes of a SQL schema; raises where an id repeats or a reference holds SQL text."""
    raw = spark.read.schema("version string, source struct<name:string,kind:string>, changes array<struct<id:string,kind:string,changeType:string,reference:map<string,string>>>").option("multiLine", True).json(path)
    c = raw.where(F.col("version") == "sql-schema-delta.v1").select(F.explode("changes").alias("c")).select("c.*")
    bad = c.groupBy("id").count().where("count > 1").limit(1).count() or c.where(F.exists(F.map_values("reference"), lambda v: v.rlike(r"(?i)^\s*(select|insert|update|delete|create|alter|drop)\s"))).limit(1).count()
    if bad:
        raise ValueError("duplicate id or raw SQL in a schema delta")
    r = F.col("reference")
    return c.select(F.col("id").alias("change_id"), "kind", F.col("changeType").alias("change_type"), F.lower(T.first_value(r, "table", "tableName")).alias("table_name"), F.lower(T.first_value(r, "column", "columnName")).alias("column_name"), T.first_value(r, "queryShapeHash").alias("shape_hash"))


def package_delta(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("version string, sourceRepo string, sourceCommitSha string, changes array<struct<id:string,packageName:string,ecosystem:string,changeType:string,oldVersion:string,newVersion:string>>").option("multiLine", True).json(path)
    return raw.where(F.col("version") == "package-delta.v1").select(F.explode("changes").alias("c")).select(F.col("c.id").alias("change_id"), F.col("c.packageName").alias("package_name"), F.col("c.ecosystem").alias("ecosystem"), F.col("c.changeType").alias("change_type"), F.col("c.oldVersion").alias("old_version"), F.col("c.newVersion").alias("new_version"))


def portfolio_manifest(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("version string, portfolioId string, snapshotId string, inputs array<struct<label:string,indexPath:string,group:string,roleTags:array<string>>>").option("multiLine", True).json(path)
    return raw.select("portfolioId", "snapshotId", F.explode("inputs").alias("i")).select("portfolioId", "snapshotId", "i.*")


def observed_evidence(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("observedEvidence array<struct<label:string,safeMetadata:map<string,string>>>").option("multiLine", True).json(path)
    return raw.select(F.explode("observedEvidence").alias("o")).select("o.label", "o.safeMetadata")


# ---- source trees

#: Kinds of files by extension.
KINDS = {"cs": "CSharp", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "py": "Python", "java": "Java", "kt": "Kotlin", "swift": "Swift", "sql": "Sql", "json": "Json", "config": "Config", "csproj": "Project", "sln": "Solution", "xml": "Xml", "razor": "Razor", "cshtml": "Razor", "yml": "Yaml", "yaml": "Yaml", "md": "Markdown"}
#: Folders that are never read.
EXCLUDED = r"(?:^|/)(?:\.git|bin|obj|node_modules|dist|build|\.venv|__pycache__|target)(?:/|$)"


def file_kind(path: Column) -> Column:
    return S.lookup_map(KINDS, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.lit("File"))


def inventory(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(relative_path, kind, size_bytes, content) of the files below `root`, within the scope of the globs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.removeprefix("file:").rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^{T.glob_pattern(base)[1:-1]}", "")
    out = files.select(rel.alias("relative_path"), F.col("length").alias("size_bytes"), "content").where(~F.col("relative_path").rlike(EXCLUDED))
    if include:
        out = out.where(F.col("relative_path").rlike("|".join(map(T.glob_pattern, include))))
    if exclude:
        out = out.where(~F.col("relative_path").rlike("|".join(map(T.glob_pattern, exclude))))
    return out.select("relative_path", file_kind(F.col("relative_path")).alias("kind"), "size_bytes", F.decode("content", "utf-8").alias("content"))


def project_packages(files: DataFrame) -> DataFrame:
    """(relative_path, ecosystem, package_name, version) declared in project files: csproj, packages.config, package.json,
    requirements.txt, Gradle and Maven. XML attributes may stand in any order and take either quote; a version may also be an
    element of its own. A file that is no valid XML or JSON gives what it shows."""
    name = F.lower(F.regexp_extract("relative_path", r"([^/]+)$", 1))
    out = None
    # Elements of package references, and the attributes of name and version.
    for test, element, key, version in ((name.endswith(".csproj"), "PackageReference", "(?:Include|Update)", "Version"), (name == "packages.config", "package", "id", "version"), (name == "directory.packages.props", "PackageVersion", "Include", "Version")):
        found = F.explode(F.regexp_extract_all("content", F.lit(rf"(?s)(<{element}\b[^>]*?(?:/>|>(?:(?!</{element}>).)*</{element}>))"), 1)).alias("e")
        read = lambda a: F.regexp_extract("e", rf"\b{a}\s*=\s*[\"']([^\"']+)[\"']", 1)
        rows = files.where(test).select("relative_path", found).select("relative_path", F.lit("nuget").alias("ecosystem"), read(key).alias("package_name"), F.coalesce(F.nullif(read(version), F.lit("")), F.nullif(F.regexp_extract("e", rf"<{version}>\s*([^<\s]+)\s*</", 1), F.lit(""))).alias("version"))
        rows = rows.where(F.col("package_name") != "")
        out = rows if out is None else out.unionByName(rows)
    pair = lambda pattern: F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), 1).alias("name"), F.regexp_extract_all("content", F.lit(pattern), 2).alias("version"))
    rules = (("npm", name == "package.json", r"\"(@?[a-z0-9][\w./-]*)\"\s*:\s*\"([~^]?\d[\w.+-]*)\""), ("pypi", name == "requirements.txt", r"(?m)^([A-Za-z0-9][\w.-]*)==([\w.]+)"), ("maven", name.isin("build.gradle", "build.gradle.kts"), r"['\"]([\w.-]+:[\w.-]+):([\w.-]+)['\"]"), ("maven", name == "pom.xml", r"<artifactId>([^<]+)</artifactId>\s*<version>([^<]+)</version>"))
    for ecosystem, test, pattern in rules:
        part = files.where(test).select("relative_path", F.lit(ecosystem).alias("ecosystem"), F.explode(pair(pattern)).alias("p")).select("relative_path", "ecosystem", F.col("p").getField("name").alias("package_name"), F.col("p").getField("version").alias("version"))
        out = out.unionByName(part)
    return out


def config_keys(files: DataFrame) -> DataFrame:
    """(scan_id, relative_path, key_path) of settings in XML and JSON files; values are never read out."""
    import json

    import pandas as pd

    xml = files.where(F.lower("relative_path").endswith(".config")).select("scan_id", "relative_path", F.explode(F.regexp_extract_all("content", F.lit(r"<add\s+(?:key|name)=\"([^\"]+)\""), 1)).alias("key_path"))
    where = "scan_id string, relative_path string, key_path string"

    def flatten(frames):
        for pdf in frames:
            rows = []
            for scan, path, text in pdf.itertuples(index=False, name=None):
                try:
                    stack = [("", json.loads(text.lstrip("﻿")))]
                except (ValueError, RecursionError):
                    continue
                while stack:
                    at, value = stack.pop()
                    if isinstance(value, dict):
                        stack += [(f"{at}:{k}" if at else k, v) for k, v in value.items()]
                    elif isinstance(value, list):
                        stack += [(f"{at}:{i}", v) for i, v in enumerate(value)]
                    elif at:
                        rows.append((scan, path, at))
            yield pd.DataFrame(rows, columns=["scan_id", "relative_path", "key_path"])

    js = files.where(F.lower("relative_path").endswith(".json") & F.col("content").isNotNull()).select("scan_id", "relative_path", "content").mapInPandas(flatten, where)
    return xml.unionByName(js)
