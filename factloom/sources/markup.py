"""XML settings and metadata read safely into rows, and what they declare: settings, service endpoints, data models.

A document type declaration is refused before anything of it is expanded, so no entity is ever resolved. Documents are
read one by one in Arrow batches; what is asked of them afterwards are plain DataFrame operations on their elements.

Defined results: null and empty contents give no rows; a document that isn't well formed or has a document type
declaration gives one row with a `gap` and nothing else. Elements are numbered in document order from 1; names lose their
namespace prefix. Repeated rows of an item give their elements once for each row.
"""

from __future__ import annotations

import xml.parsers.expat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ELEMENTS = "scan_id string, relative_path string, at int, line_no int, path string, attributes map<string,string>, text string, gap string"


class _Refused(Exception):
    pass


def elements_of(text: str) -> list[tuple[int, int, str, dict[str, str], str]]:
    """(number, line, path, attributes, own text) of a document's elements; raises on what isn't read."""
    parser = xml.parsers.expat.ParserCreate()
    out: list[list] = []
    stack: list[int] = []
    names: list[str] = []
    plain = lambda n: n.rsplit(":", 1)[-1]

    def start(name: str, attributes: dict[str, str]) -> None:
        names.append(plain(name))
        stack.append(len(out))
        out.append([len(out) + 1, parser.CurrentLineNumber, "/".join(names), {plain(k): v for k, v in attributes.items() if k != "xmlns" and not k.startswith("xmlns:")}, []])

    def end(_name: str) -> None:
        names.pop()
        stack.pop()

    def data(chars: str) -> None:
        if stack:
            out[stack[-1]][4].append(chars)

    def refuse(*_args) -> None:
        raise _Refused

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, data, refuse
    parser.Parse(text.lstrip("﻿"), True)
    return [(n, line, path, attributes, "".join(chars).strip()) for n, line, path, attributes, chars in out]


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [x.strip().split()[0] for x in ELEMENTS.replace("map<string,string>", "map").split(",")]
    for pdf in frames:
        rows: list[tuple] = []
        for scan, path, text in pdf[["scan_id", "relative_path", "content"]].itertuples(index=False, name=None):
            try:
                rows += [(scan, path, n, line, at, attributes, own or None, None) for n, line, at, attributes, own in elements_of(text)]
            except _Refused:
                rows.append((scan, path, None, None, None, None, None, "document-type-refused"))
            except (xml.parsers.expat.ExpatError, ValueError):
                rows.append((scan, path, None, None, None, None, None, "not-well-formed"))
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def xml_elements(files: DataFrame, pattern: str = r"\.(?:config|xml|\w*proj|edmx|dbml|xsd|hbm\.xml|resx|svc|wsdl|disco)$") -> DataFrame:
    """ELEMENTS of the items whose path matches `pattern`."""
    src = files.where(F.col("content").isNotNull() & (F.col("content") != "") & F.lower("relative_path").rlike(pattern))
    return src.select("scan_id", "relative_path", "content").mapInPandas(_read, ELEMENTS)


def settings(elements: DataFrame) -> DataFrame:
    """(scan_id, relative_path, line_no, kind, key): the settings and connection strings that are declared, without values."""
    a = F.col("attributes")
    setting, connection = F.col("path").rlike(r"(?:^|/)appSettings/add$"), F.col("path").rlike(r"(?:^|/)connectionStrings/add$")
    rows = elements.where(setting | connection).select("scan_id", "relative_path", "line_no", F.when(setting, F.lit("setting")).otherwise(F.lit("connection-string")).alias("kind"), F.when(setting, a["key"]).otherwise(a["name"]).alias("key"))
    return rows.where(F.col("key").isNotNull())


def service_endpoints(elements: DataFrame) -> DataFrame:
    """(scan_id, relative_path, line_no, side, binding, contract, has_address, name): endpoints of services and their clients;
    addresses stay out, only whether one is given."""
    a = F.col("attributes")
    side = F.when(F.col("path").rlike(r"(?:^|/)client/endpoint$"), F.lit("client")).when(F.col("path").rlike(r"(?:^|/)services/service/endpoint$"), F.lit("service")).when(F.col("path").rlike(r"(?:^|/)(?:wellknown|channel)$"), F.lit("remoting"))
    return elements.where(side.isNotNull()).select("scan_id", "relative_path", "line_no", side.alias("side"), F.coalesce(a["binding"], a["ref"]).alias("binding"), F.coalesce(a["contract"], a["type"]).alias("contract"), F.coalesce(F.length(F.coalesce(a["address"], a["url"], a["objectUri"])) > 0, F.lit(False)).alias("has_address"), a["name"].alias("name"))


def data_models(elements: DataFrame) -> DataFrame:
    """(scan_id, relative_path, line_no, format, item, owner, name, type): tables, entities, columns and relations that
    mapping files declare; `owner` is the nearest table or entity above."""
    a = F.col("attributes")
    low = F.lower("relative_path")
    form = F.when(low.endswith(".dbml"), F.lit("dbml")).when(low.endswith(".edmx"), F.lit("edmx")).when(low.endswith(".hbm.xml"), F.lit("hbm")).when(low.endswith(".xsd"), F.lit("dataset"))
    last = F.element_at(F.split("path", "/"), -1)
    # What elements of mapping files declare.
    table = last.isin("Table", "EntityType", "class", "EntitySet")
    column = last.isin("Column", "Property", "property", "id", "many-to-one")
    relation = last.isin("Association", "NavigationProperty", "set", "bag", "list", "relation")
    item = F.when(table, F.lit("entity")).when(column, F.lit("property")).when(relation, F.lit("relation"))
    rows = elements.where(form.isNotNull() & F.col("at").isNotNull()).select("scan_id", "relative_path", "at", "line_no", form.alias("format"), item.alias("item"), F.coalesce(a["Name"], a["name"], a["Member"]).alias("name"), F.coalesce(a["Type"], a["type"], a["DbType"]).alias("type"))
    # Elements of one document only, in its own order.
    w = Window.partitionBy("scan_id", "relative_path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("item") == "entity", F.col("name")), ignorenulls=True).over(w)
    return rows.withColumn("owner", F.when(F.col("item") != "entity", owner)).where(F.col("item").isNotNull() & F.col("name").isNotNull()).select("scan_id", "relative_path", "line_no", "format", "item", "owner", "name", "type")


def project_diagnostics(elements: DataFrame) -> DataFrame:
    """(scan_id, relative_path, line_no, code, value): what project files say of the environment that they need to build.

    `value` is kept only where it is a plain version; anything else that was observed stays out.
    """
    a = F.col("attributes")
    # Codes of build diagnostics, and kinds of projects that can't be analysed by their type's id.
    kinds = {"{54435603-dbb4-11d2-8724-00a0c9a8b90c}": "setup-deployment", "{c8d11400-126e-41cd-887f-60bd40844f9e}": "database-project"}
    project = elements.where(F.lower("relative_path").rlike(r"\.\w*proj$"))
    root, name = F.col("path") == "Project", F.element_at(F.split("path", "/"), -1)
    sdk = F.coalesce(a["Sdk"], F.lit("")) != ""
    guid = F.lower("text")
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    rules = [
        (F.col("gap").isNotNull(), "UnknownLegacyProjectFormat", F.lit(None)), (root & ~sdk, "NonSdkStyleProject", F.lit(None)), (root & a["ToolsVersion"].isNotNull(), "OldMsBuildToolsVersion", a["ToolsVersion"]),
        (name.isin("TargetFrameworkVersion", "TargetFramework", "TargetFrameworks"), "TargetFramework", F.col("text")), ((name == "ProjectTypeGuids") & F.exists(F.split(guid, ";"), lambda x: x.isin(*kinds)), "UnsupportedProjectType", F.element_at(known, F.element_at(F.filter(F.split(guid, ";"), lambda x: x.isin(*kinds)), 1))),
    ]
    told = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), value.cast("string").alias("value"))) for test, code, value in rules]), lambda x: x.isNotNull())
    rows = project.select("scan_id", "relative_path", "line_no", F.explode(told).alias("d")).select("scan_id", "relative_path", "line_no", "d.code", "d.value")
    return rows.withColumn("value", F.when(F.col("value").rlike(r"^[A-Za-z0-9.;-]{1,80}$"), F.col("value")))
