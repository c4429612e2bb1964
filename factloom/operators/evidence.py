"""From delivered rows to evidence: current facts, typed edges, symbol roles, surfaces and the combined index.

Defined results for all of these: repeated rows count once (see tables.latest); properties that are no JSON object give
an empty map and the flag `malformed`; blank properties count as missing; empty tables give no rows; extra columns of the
inputs are dropped by the projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as T
from ..tables import latest, union

FACT_COLUMNS = [n for n in S.FACT.names if n not in ("fact_id", "scan_id")]


def current_facts(facts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each fact's latest delivery, one row for (scan_id, fact_id)."""
    return latest(facts, ["scan_id", "fact_id"], "ingested_at", columns or FACT_COLUMNS)


def current_combined(facts: DataFrame, columns: list[str]) -> DataFrame:
    return latest(facts, ["combined_fact_id"], "ingested_at", columns)


def with_properties(facts: DataFrame) -> DataFrame:
    """`props`, the map of properties_json, and `malformed` where there is none."""
    parsed = T.properties(F.col("properties_json"))
    return facts.withColumns({"props": F.coalesce(parsed, F.create_map().cast("map<string,string>")), "malformed": F.col("properties_json").isNotNull() & parsed.isNull()})


def current_manifest(manifest: DataFrame) -> DataFrame:
    """Each scan's latest manifest row, with its instant and its JSON parsed."""
    cols = ["repo", "commit_sha", "scanner_version", "scanned_at", "analysis_level", "build_status", "manifest_json", "scan_root_relative_path"]
    one = latest(manifest, ["scan_id"], "ingested_at", cols)
    return one.withColumns({"instant": F.try_to_timestamp("scanned_at"), "manifest": F.from_json("manifest_json", S.MANIFEST_JSON)})


def latest_scans(manifest: DataFrame) -> DataFrame:
    """The newest scan of each series (repo, root), ties by the greater scan_id."""
    pick = F.max(F.struct("instant", "scan_id", "commit_sha", "analysis_level", "build_status")).alias("m")
    return current_manifest(manifest).groupBy("repo", "scan_root_relative_path").agg(pick).select("repo", "scan_root_relative_path", "m.scan_id", "m.commit_sha", "m.analysis_level", "m.build_status", "m.instant")


def full_coverage(level: Column, status: Column, sha: Column) -> Column:
    """Whether a source was read in full: semantic analysis, a successful build and a known commit."""
    known = sha.rlike("^[0-9a-fA-F]{40}$")
    return F.coalesce((level == "Level1SemanticAnalysis") & (status == "Succeeded") & known, F.lit(False))


# ---- typed edges and roles

#: Kinds of edges by the type of the fact they come from.
EDGE_OF = {"CallEdge": "calls", "MethodInvoked": "calls", "ObjectCreated": "creates", "ArgumentPassed": "argument-passed", "LocalAlias": "local-alias", "FieldAlias": "field-alias", "SymbolRelationship": "inherits", "ParameterForwarded": "parameter-forward"}


def typed_edges(facts: DataFrame) -> DataFrame:
    """Edges between symbols by fact type; facts with only one end are kept with the other end null."""
    kind = S.lookup_map(EDGE_OF, F.col("fact_type"), F.lit(None).cast("string"))
    edges = facts.where(F.col("fact_type").isin(*EDGE_OF)).withColumn("edge_kind", kind)
    return edges.where(F.col("source_symbol").isNotNull() | F.col("target_symbol").isNotNull())


def symbol_roles(facts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One row for each role a symbol plays for a fact: named in the fact itself or in an occurrence."""
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("symbol")) for r, c in (("source", "source_symbol"), ("target", "target_symbol"), ("contract", "contract_element"))]))
    own = facts.select("scan_id", "fact_id", roles.alias("r")).select("scan_id", "fact_id", "r.role", "r.symbol").where(~T.blank(F.col("symbol")))
    seen = occurrences.select("scan_id", "fact_id", F.lower("role").alias("role"), F.col("symbol_id").alias("symbol"))
    return own.unionByName(seen).distinct()


# ---- surfaces

# Fact types by the surface they show, and property keys of the fact contract.
SQL_FACTS = ("QueryPatternDetected", "SqlTextUsed", "DapperCallDetected", "SqlCommandDetected", "SqlFileDeclared")
MESSAGE_FACTS = ("MessagePublisherSurface", "MessageConsumerSurface", "MessageBindingDeclared")
CONFIG_FACTS = ("ConfigBinding", "ConfigKeyDeclared", "ConnectionStringDeclared")
REMOTING = {"RemotingEndpointDeclared": "remoting-endpoint", "RemotingRegistrationDetected": "remoting-registration", "RemotingChannelDeclared": "remoting-channel", "RemotingObjectDeclared": "remoting-object", "RemotingApiUsed": "remoting-api"}


#: Kinds that a surface may have; a fact may declare others of its own.
SURFACE_KINDS = ("http-client", "http-route", "sql-persistence", "sql-query", *S.MESSAGE_KINDS, "wcf-operation", *REMOTING.values(), "package-config")


def surface_kind(fact_type: Column, props: Column) -> Column:
    """The kind of dependency surface a fact shows, null for none; the first rule that holds decides."""
    declared = T.first_value(props, "surfaceKind")
    message = F.when(declared.isin(*S.MESSAGE_KINDS), declared).otherwise(F.lit("message-unknown"))
    remoting = S.lookup_map(REMOTING, fact_type, F.lit(None).cast("string"))
    return (
        F.when(fact_type == "HttpCallDetected", F.lit("http-client")).when(fact_type.isin("HttpRouteBinding", "AspNetRouteDeclared"), F.lit("http-route"))
        .when(fact_type == "DatabaseColumnMapping", F.lit("sql-persistence")).when(fact_type.isin(*SQL_FACTS), F.lit("sql-query"))
        .when(fact_type.isin(*MESSAGE_FACTS), message).when(fact_type == "WcfServiceReferenceMapping", F.lit("wcf-operation")).when(remoting.isNotNull(), remoting)
        .when(declared.isNotNull(), F.when(F.lower(declared) == "package", F.lit("package-config")).otherwise(declared))
        .when(fact_type.isin("PackageReferenced", *CONFIG_FACTS), F.lit("package-config"))
    )


def surfaces(facts: DataFrame) -> DataFrame:
    """One wide row a surface, from facts with `props`: kind, display name, route, SQL shape, package and config key."""
    from ..functions import routes, sqltext

    p = F.col("props")
    route = routes.normalize(F.coalesce(T.first_value(p, "normalizedPathTemplate"), routes.joined_templates(T.first_value(p, "routeTemplate", "routePattern", "routeTemplates", "routes", "path", "urlPath", "url"))))
    kind = surface_kind(F.col("fact_type"), p)
    rows = facts.withColumn("surface_kind", kind).where(F.col("surface_kind").isNotNull())
    http = F.col("surface_kind").isin("http-client", "http-route")
    sql = F.col("surface_kind") == "sql-query"
    version, version_hash, reason = T.safe_version(T.first_value(p, "version", "packageVersion"))
    rows = rows.withColumns({
        "path_key": F.when(http, F.coalesce(T.first_value(p, "normalizedPathKey"), route["key"])),
        "http_method": F.when(http, F.coalesce(F.upper(T.first_value(p, "httpMethod", "httpMethods", "methodName")), F.lit("ANY"))),
        "sql_shape": F.when(sql & T.first_value(p, "sql").isNotNull(), sqltext.shape(T.first_value(p, "sql"))),
        "package_name": F.coalesce(T.first_value(p, "packageName", "package", "dependencyName", "moduleName"), F.when(F.col("fact_type") == "PackageReferenced", T.first_value(p, "name"))), "package_version": version, "version_hash": version_hash, "redaction_reason": reason,
        "config_key": T.first_value(p, "keyPath", "configKey", "key", "connectionStringName", "connectionName", "sectionName", "configurationKey", "environmentVariableName"),
        "ecosystem": T.first_value(p, "ecosystem", "packageEcosystem", "packageManager"), "safe_path": T.safe_path(F.col("file_path")),
    })
    tables = F.array_join(F.col("sql_shape.tables"), ";")
    name = (
        F.when(http, F.coalesce("path_key", F.concat("http_method", F.lit(" unknown"))))
        .when(sql, F.concat_ws(" ", F.col("sql_shape.operation"), F.when(tables != "", tables)))
        .when(F.col("surface_kind").startswith("message-"), F.coalesce(T.first_value(p, "destination", "topic", "queue", "exchange", "subscription", "channel", "eventName"), F.concat(F.lit("unknown-"), "surface_kind", F.lit(":"), "fact_id")))
        .when(F.col("surface_kind") == "wcf-operation", F.coalesce(F.concat_ws(".", T.first_value(p, "contract", "contractName", "serviceContract"), T.first_value(p, "operation", "operationName")), F.lit("")))
        .when(F.col("surface_kind").startswith("remoting-"), F.coalesce(T.first_value(p, "objectUri", "uri", "typeName", "channel", "api"), F.concat(F.lit("unknown-"), "surface_kind", F.lit(":"), "fact_id")))
        .when(F.col("surface_kind") == "sql-persistence", F.concat_ws(".", T.first_value(p, "tableName", "table", "entityName"), T.first_value(p, "columnName", "column")))
        .otherwise(F.coalesce("package_name", "config_key", F.concat(F.lit("unknown-"), "surface_kind", F.lit(":"), "fact_id")))
    )
    return rows.withColumns({"display_name": name, "table_names": F.when(sql, tables), "shape_hash": F.coalesce(T.first_value(p, "queryShapeHash", "patternHash"), F.col("sql_shape.shape_hash"))}).drop("sql_shape")


# ---- combining indexes

#: Tables of a single index with their key, and the columns that join it in the combined one.
COMBINED_KEYS = {"facts": ("fact_id", []), "symbols": ("symbol_id", ["scan_id"]), "symbol_occurrences": ("occurrence_id", [])}


def combine_stacked(tables: dict[str, DataFrame], label: str) -> dict[str, DataFrame]:
    """Single indexes stacked in one table each, told apart by the column `label`, as one combined index.

    Rows keep their ids and get the source's; keys are prefixed by it. One plan, however many sources there are.
    """
    out = {}
    for name, df in tables.items():
        source = F.concat(F.lit("src-"), T.hash_prefix(F.col(label), 20))
        row = df.withColumns({"source_index_id": source, "source_label": F.col(label)})
        key, parts = COMBINED_KEYS.get(name, (None, []))
        out[f"combined_{name}"] = row.withColumn(f"combined_{key}", F.concat_ws(":", source, *parts, key)) if key else row
    return out


def combine(sources: dict[str, dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Single indexes by label as one combined index (see combine_stacked). Tables or columns that a source lacks are empty."""
    stacked: dict[str, DataFrame] = {}
    for label, tables in sources.items():
        for name, df in tables.items():
            row = df.withColumn("__label", F.lit(label))
            stacked[name] = stacked[name].unionByName(row, allowMissingColumns=True) if name in stacked else row
    return {name: df.drop("__label") for name, df in combine_stacked(stacked, "__label").items()}


def shared_labels(sources: DataFrame, label: str, source: str) -> DataFrame:
    """(label, n_sources) of labels that several sources claim: such a combination is refused before any row is written."""
    return sources.groupBy(F.col(label).alias("label")).agg(F.countDistinct(source).alias("n_sources")).where(F.col("n_sources") > 1)


def edge_view(facts: DataFrame, relationships: DataFrame | None = None) -> DataFrame:
    """The unified edge relation of a combined index: calls, creations, forwards and symbol relationships."""
    cols = ["source_index_id", "edge_kind", "edge_id", "source_symbol", "target_symbol", "rule_id", "evidence_tier", "file_path", "start_line", "end_line"]
    parts = [typed_edges(facts).withColumn("edge_id", F.col("combined_fact_id")).select(*cols)]
    if relationships is not None:
        parts.append(relationships.withColumns({"edge_kind": T.edge_kind(F.col("relationship_kind")), "edge_id": F.col("relationship_id"), "source_symbol": F.col("source_symbol_id"), "target_symbol": F.col("target_symbol_id")}).select(*cols))
    return union(parts)


def named(edges: DataFrame, symbols: DataFrame, on: list[str]) -> DataFrame:
    """Edges with their ends' display names, or the ids where a symbol is unknown."""
    names = latest(symbols, [*on, "symbol_id"], "ingested_at", ["display_name"])
    out = edges
    for end in ("source", "target"):
        side = names.select(*on, F.col("symbol_id").alias(f"{end}_symbol"), F.col("display_name").alias("__name"))
        out = out.join(side, [*on, f"{end}_symbol"], "left").withColumn(f"{end}_name", F.coalesce("__name", f"{end}_symbol")).drop("__name")
    return out
