"""The shapes of the evidence tables and the small fixed vocabularies that operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(text: str, ints: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, T.IntegerType() if n in ints else T.StringType()) for n in text.split()])


LINES = ("start_line", "end_line")
FACT = _struct("fact_id scan_id repo commit_sha project_path fact_type rule_id evidence_tier source_symbol target_symbol contract_element file_path start_line end_line snippet_hash extractor_id extractor_version properties_json", LINES)
MANIFEST = _struct("scan_id repo commit_sha scanner_version scanned_at analysis_level build_status manifest_json")
SYMBOL = _struct("scan_id symbol_id language symbol_kind display_name assembly_name assembly_version containing_symbol_id")
OCCURRENCE = _struct("occurrence_id scan_id symbol_id fact_id role occurrence_kind evidence_tier rule_id file_path start_line end_line", LINES)
RELATIONSHIP = _struct("relationship_id scan_id source_symbol_id target_symbol_id relationship_kind rule_id evidence_tier file_path start_line end_line", LINES)
TABLES = {"facts": FACT, "scan_manifest": MANIFEST, "symbols": SYMBOL, "symbol_occurrences": OCCURRENCE, "symbol_relationships": RELATIONSHIP}

#: One fact of a newline-delimited JSON file.
FACT_JSON = T.StructType([
    *[T.StructField(n, T.StringType()) for n in "factId scanId repo commitSha projectPath factType ruleId evidenceTier sourceSymbol targetSymbol contractElement".split()],
    T.StructField("evidence", T.StructType([T.StructField("filePath", T.StringType()), T.StructField("startLine", T.IntegerType()), T.StructField("endLine", T.IntegerType()), T.StructField("snippetHash", T.StringType()), T.StructField("extractorId", T.StringType()), T.StructField("extractorVersion", T.StringType())])),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
])
MANIFEST_JSON = T.StructType([*[T.StructField(n, T.StringType()) for n in "scanId repoName branch scanRootRelativePath".split()], *[T.StructField(n, T.ArrayType(T.StringType())) for n in "solutions projects targetFrameworks knownGaps".split()]])

# Evidence tiers from the strongest to the weakest.
TIERS = ("Tier1Semantic", "Tier2Structural", "Tier3SyntaxOrTextual", "Tier4Unknown")
# Spellings of edge kinds that mean another one.
EDGE_SYNONYMS = {"call": "calls", "create": "creates", "parameter-forwarded": "parameter-forward", "argumentpassed": "argument-passed", "parameterforwarded": "parameter-forward", "factattachedtosymbol": "fact-attached-to-symbol", "surfaceevidence": "surface-evidence", "inheritsfrom": "inherits", "implementsinterface": "implements", "implementsinterfacemember": "implements", "extendsinterface": "inherits"}
# The order in which edges of a node are followed.
EDGE_RANKS = {"endpoint-match": 0, "calls": 1, "creates": 2, "parameter-forward": 3, "argument-passed": 4, "surface-evidence": 5, "remoting-evidence": 5, "remoting-channel-link": 5, "interface-candidate": 6, "override-candidate": 6, "fact-attached-to-symbol": 6, "symbol-reconciliation": 7, "inherits": 8, "implements": 9, "overrides": 10}
# Message surfaces.
MESSAGE_KINDS = ("message-queue", "message-topic", "message-subscription", "message-exchange", "message-stream", "message-event", "message-channel", "message-unknown")


def lookup_map(values: dict, key: Column, default: Column) -> Column:
    """The value of a small fixed mapping, evaluated as a literal map."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), default)


def tier_rank(tier: Column) -> Column:
    """1 for the strongest tier to 4; unknown tiers rank with the weakest."""
    return lookup_map({t: i + 1 for i, t in enumerate(TIERS)}, tier, F.lit(4))


def tier_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), rank)


def edge_rank(kind: Column) -> Column:
    return lookup_map(EDGE_RANKS, kind, F.lit(99))
