"""The user-visible commands, one function each: an index (tables by name) and options in, result tables by name out.

An index is what sources.readers gives: facts, scan_manifest, symbols and so on of a single index, or index_sources,
combined_facts, combined_symbols of a combined one. Limits default to the documented ones and are part of the results;
what they cut is told in a `gaps` table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import routes as R
from ..functions import text as T
from ..operators import diff as D
from ..operators import evidence as E
from ..operators import extract as X
from ..operators import graph as G
from ..operators import match as M
from ..operators import rollup as A
from ..schema import TIERS, tier_rank
from ..tables import cut, latest, union

Index = dict[str, DataFrame]
HTTP_FACTS = ("HttpCallDetected", "HttpRouteBinding", "AspNetRouteDeclared")
EDGE = ["edge_id", "source", "target", "kind", "evidence_tier", "classification"]
GRAPH_FACTS = (*E.EDGE_OF, *HTTP_FACTS, "RemotingRegistrationDetected", "RemotingObjectDeclared")
COMBINED = ["source_index_id", "fact_type", "rule_id", "evidence_tier", "source_symbol", "target_symbol", "contract_element", "file_path", "start_line", "end_line", "properties_json"]


def _facts(index: Index) -> DataFrame:
    """The current facts of either kind of index: fact_id, source_id and the contract's columns."""
    if "combined_facts" in index:
        return E.current_combined(index["combined_facts"], COMBINED).withColumnsRenamed({"combined_fact_id": "fact_id", "source_index_id": "source_id"})
    f = E.current_facts(index["facts"], [c for c in COMBINED if c != "source_index_id"])
    return f.withColumn("source_id", F.col("scan_id")).withColumn("fact_id", F.concat_ws(":", "scan_id", "fact_id")).drop("scan_id")


def scan(files: DataFrame) -> Index:
    """Inventory, declarations, statements and settings of source files as facts' raw material."""
    from ..sources.readers import config_keys, project_packages

    return {"inventory": files.select("scan_id", "relative_path", F.length("content").alias("n_chars")), "types": X.declared_types(files), "statements": X.sql_statements(files), "config_keys": config_keys(files), "packages": project_packages(files)}


def combine(indexes: dict[str, Index]) -> Index:
    return E.combine(indexes)


def surfaces(index: Index) -> DataFrame:
    return E.surfaces(E.with_properties(_facts(index)))


def _endpoint_sides(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Client calls and server routes among facts."""
    p = F.col("props")
    f = E.with_properties(facts).where(F.col("fact_type").isin(*HTTP_FACTS))
    route = T.first_value(p, "normalizedPathTemplate", "routeTemplate", "routePattern", "routeTemplates", "path", "urlPath", "url", "routes")
    f = f.withColumn("route", F.explode(F.split(F.coalesce(route, F.lit("")), ",")))
    f = f.select(F.col("fact_id").alias("id"), "source_id", "fact_type", "file_path", "start_line", R.methods(T.first_value(p, "httpMethod", "httpMethods", "methodName")).alias("methods"), F.when(~T.blank(F.col("route")), R.normalize(F.col("route"))["key"]).alias("path_key"), F.lower(F.coalesce(T.first_value(p, "isDynamic"), F.lit("false"))).eqNullSafe("true").alias("is_dynamic"), "route")
    return f.where(F.col("fact_type") == "HttpCallDetected"), f.where(F.col("fact_type") != "HttpCallDetected").withColumn("id", F.concat_ws("#", "id", "route"))


def endpoints(index: Index) -> Index:
    """Client calls aligned with server routes."""
    return {"endpoints": M.align_endpoints(*_endpoint_sides(_facts(index)))}


def report(index: Index) -> Index:
    """Counts by type, tier and source, surfaces by kind, gaps by category, and what needs review."""
    f = _facts(index)
    s = surfaces(index)
    gaps = X.gap_facts(f)
    review = union([gaps.select(F.lit("analysis-gap").alias("why"), "source_id", "fact_id"), f.where(F.col("evidence_tier") == TIERS[3]).select(F.lit("unknown-tier").alias("why"), "source_id", "fact_id"), endpoints(index)["endpoints"].where(F.col("classification").isin("AmbiguousMatch", "MethodMismatch", "DynamicClientUrlNeedsReview")).select(F.col("classification").alias("why"), F.col("server_source").alias("source_id"), F.col("client_id").alias("fact_id"))])
    return {"facts": A.count_by(f, "source_id", "fact_type", "evidence_tier"), "surfaces": A.count_by(s, "source_id", "surface_kind"), "gaps": A.count_by(gaps, "source_id", "category"), "needs_review": review}


def _parts(index: Index) -> Index:
    """graph() with its matched endpoints unpaired: edges, surface nodes, and the calls (source, client_id) and routes (target,
    server_id, classification) of a group, each pair of which is an edge."""
    f = cut(_facts(index).where(F.col("fact_type").isin(*GRAPH_FACTS)).drop("contract_element", "rule_id", "end_line"))
    s = surfaces(index).where(F.col("source_symbol").isNotNull() | F.col("target_symbol").isNotNull() | F.col("surface_kind").startswith("remoting-"))
    s = cut(s.select("fact_id", "source_id", "source_symbol", "target_symbol", "evidence_tier", "surface_kind", "display_name"))
    calls = E.typed_edges(f).where(F.col("source_symbol").isNotNull() & F.col("target_symbol").isNotNull()).select(F.col("fact_id").alias("edge_id"), F.col("source_symbol").alias("source"), F.col("target_symbol").alias("target"), F.col("edge_kind").alias("kind"), "evidence_tier", F.lit(None).cast("string").alias("classification"))
    node = F.concat(F.lit("surface:"), "fact_id")
    hung = s.where(F.coalesce("source_symbol", "target_symbol").isNotNull()).select(F.concat(F.lit("at:"), "fact_id").alias("edge_id"), F.coalesce("source_symbol", "target_symbol").alias("source"), node.alias("target"), F.lit("surface-evidence").alias("kind"), "evidence_tier", F.lit(None).cast("string").alias("classification"))
    served = s.where(F.col("surface_kind") == "http-route").select(node.alias("source"), F.coalesce("target_symbol", "source_symbol").alias("target"), F.concat(F.lit("of:"), "fact_id").alias("edge_id"), F.lit("fact-attached-to-symbol").alias("kind"), "evidence_tier", F.lit(None).cast("string").alias("classification"))
    # Calls on a type that is configured to be remote lead to its surface.
    props = E.with_properties(f)
    configured = props.where(F.col("fact_type").isin("RemotingRegistrationDetected", "RemotingObjectDeclared")).select(F.col("fact_id").alias("id"), T.first_value(F.col("props"), "typeName", "remoteType", "type").alias("type_name"), "source_id")
    sites = f.where(F.col("fact_type") == "CallEdge").select(F.col("fact_id").alias("id"), "target_symbol", "source_id", "source_symbol", "evidence_tier")
    remote = M.remoting_calls(configured, sites).join(sites.select(F.col("id").alias("site_id"), "source_symbol", "evidence_tier"), "site_id").where(F.col("source_symbol").isNotNull())
    remote = remote.select(F.concat_ws("->", "site_id", "configure_id").alias("edge_id"), F.col("source_symbol").alias("source"), F.concat(F.lit("surface:"), "configure_id").alias("target"), F.lit("remoting-call-site").alias("kind"), "evidence_tier", F.lit(None).cast("string").alias("classification"))
    known, told, _ = M.endpoint_groups(*map(cut, _endpoint_sides(f)))
    group = F.concat(F.lit("match:"), F.to_json(F.struct("path_key", "client_methods"))).alias("group")
    routes = cut(told.where(F.col("server_id").isNotNull()).select(group, F.concat(F.lit("surface:"), F.substring_index("server_id", "#", 1)).alias("target"), "server_id", "classification"))
    callers = known.where(F.col("client_id").isNotNull()).select(group, F.concat(F.lit("surface:"), "client_id").alias("source"), "client_id").join(routes.select("group").distinct(), "group", "left_semi")
    nodes = s.select(node.alias("node"), "source_id", "surface_kind", "display_name", "fact_id")
    return {"edges": cut(union([x.select(*EDGE) for x in (calls, hung, served, remote)])), "nodes": nodes, "callers": cut(callers), "routes": routes}


def _pairs(callers: DataFrame, routes: DataFrame) -> DataFrame:
    """The edges of matched endpoints."""
    return callers.join(routes, "group").select(F.concat_ws("->", "client_id", "server_id").alias("edge_id"), "source", "target", F.lit("endpoint-match").alias("kind"), F.lit(TIERS[1]).alias("evidence_tier"), "classification").distinct()


def graph(index: Index) -> tuple[DataFrame, DataFrame]:
    """(edges, surface nodes): symbols' edges, facts attached to symbols, surfaces hung on them, calls on remote types, and
    matched endpoints."""
    g = _parts(index)
    return g["edges"].unionByName(_pairs(g["callers"], g["routes"])), g["nodes"]


def _links(g: Index) -> DataFrame:
    """(source, target) of a graph's parts with a node for each group of endpoints: as many as there are facts, not pairs."""
    ends = F.col("group")
    return union([g["edges"].select("source", "target"), g["callers"].select("source", ends.alias("target")), g["routes"].select(ends.alias("source"), "target")])


def _edges_to(g: Index, to: DataFrame, max_depth: int, closed: DataFrame | None = None) -> DataFrame:
    """The edges of a graph's parts on ways of at most `max_depth` edges to a node of `to`. Nodes that are `closed` aren't left.

    Groups of endpoints whose routes don't lead there form no pairs, so the product of calls and routes is never made.
    """
    left = (lambda df: df) if closed is None else (lambda df: df.join(closed.select(F.col("node").alias("source")), "source", "left_anti"))
    met = cut(G.reaching(to, left(_links(g)), 2 * max_depth))
    at = lambda c: met.select(F.col("node").alias(c))
    pairs = _pairs(left(g["callers"]).join(at("group"), "group", "left_semi"), g["routes"].join(at("target"), "target", "left_semi"))
    return cut(left(g["edges"]).join(at("target"), "target", "left_semi").select(*EDGE).unionByName(pairs.select(*EDGE)))


def coverage(index: Index) -> DataFrame:
    """(source_id, full, commit_sha, scanner_version, identity): what each source's manifest says; of a single index each
    scan is a source. Below the full analysis level, or if its build failed, a source is read in part. Without any manifest
    nothing is known of gaps, and none are claimed."""
    if "index_sources" in index:
        m = index["index_sources"].withColumn("source_id", F.col("source_index_id"))
        identity = [F.col("repo_name"), F.col("scan_root_path_hash")]
    elif "scan_manifest" in index:
        cols = ["repo", "commit_sha", "scanner_version", "analysis_level", "build_status", "scan_root_relative_path"]
        m = latest(index["scan_manifest"], ["scan_id"], "ingested_at", cols).withColumn("source_id", F.col("scan_id"))
        identity = [F.col("repo"), F.col("scan_root_relative_path")]
    else:
        return _facts(index).select("source_id", F.lit(True).alias("full"), *[F.lit(None).cast("string").alias(c) for c in ("commit_sha", "scanner_version", "identity")]).distinct()
    full = F.coalesce((F.col("analysis_level") == "Level1SemanticAnalysis") & (F.col("build_status") == "Succeeded"), F.lit(False))
    return m.select("source_id", full.alias("full"), "commit_sha", "scanner_version", F.concat_ws("|", *identity).alias("identity")).dropDuplicates(["source_id"])


def reduced_sources(index: Index) -> DataFrame:
    """source_id of the sources that were read in part."""
    return coverage(index).where(~F.col("full")).select("source_id")


def _select(nodes: DataFrame, kind: str | None, name: str | None) -> DataFrame:
    out = nodes if kind is None else nodes.where(F.col("surface_kind") == kind)
    return out if name is None else out.where(T.contains_ci(F.col("display_name"), name))


def _ends(nodes: DataFrame, kind: str | None, name: str | None) -> DataFrame:
    """The surfaces at which ways end: routes only where asked for."""
    ends = _select(nodes, kind, name)
    return ends.where(F.col("surface_kind") != "http-route") if kind is None else ends


def _roots(edges: DataFrame) -> DataFrame:
    """The nodes that nothing leads to."""
    return edges.select(F.col("source").alias("node")).distinct().join(edges.select(F.col("target").alias("node")).distinct(), "node", "left_anti")


def paths(index: Index, from_symbol: str | None = None, to_kind: str | None = None, to_name: str | None = None, max_depth: int = 8, max_paths: int = 100, max_frontier: int = 10_000) -> Index:
    """Ways from symbols (all that nothing leads to, or those that contain a text) to surfaces."""
    edges, nodes = graph(index)
    if from_symbol:
        starts = edges.select(F.col("source").alias("node")).where(T.contains_ci(F.col("node"), from_symbol)).distinct()
    else:
        starts = _roots(edges)
    found, gaps = G.bounded_paths(starts, edges, _ends(nodes, to_kind, to_name).select("node"), max_depth, max_paths, max_frontier)
    return {"paths": found, "gaps": gaps, "classes": A.count_by(found, "classification")}


def reverse(index: Index, kind: str, name: str | None = None, max_depth: int = 8, max_roots: int | None = 100, per_root: int | None = 5, max_frontier: int | None = 10_000) -> Index:
    """Ways from surfaces back to the symbols where they begin, at most `per_root` of each, and each root's best class.

    A way over a source that was read in part is for review, whatever its edges say.
    """
    g = _parts(index)
    nodes, roots = g["nodes"], _roots(_links(g))
    starts = _select(nodes, kind, name).select("node")
    edges = _edges_to(g, starts, max_depth)
    total = max_roots * per_root if max_roots and per_root else None
    found, gaps = G.bounded_paths(starts, edges, roots, max_depth, total, max_frontier, reverse=True, on_cycle="silent", guard=False, per_start=per_root)
    partial = nodes.join(reduced_sources(index), "source_id").select(F.col("node").alias("start"), F.lit(True).alias("__part"))
    found = found.join(partial, "start", "left").withColumn("classification", G.reverse_class(F.col("tier"), F.col("review"), F.col("unknown"), F.coalesce("__part", F.lit(False)))).drop("__part")
    best = found.groupBy(F.col("node").alias("root")).agg(A.precedence(F.col("classification"), A.PATHS, "UnknownAnalysisGap").alias("classification"), F.count(F.lit(1)).alias("n_paths"))
    return {"paths": found, "roots": best, "gaps": gaps}


def flow(index: Index, symbol: str, max_depth: int = 5, max_paths: int = 50) -> Index:
    """Maximal ways along forward edges, without those that end another."""
    edges, _ = graph(index)
    starts = edges.select(F.col("source").alias("node")).where(T.contains_ci(F.col("node"), symbol)).distinct()
    return {"paths": G.drop_suffixes(G.edge_simple_paths(starts, edges, max_depth, max_paths))}


def relate(index: Index, symbol: str, direction: str = "both", max_depth: int = 5, max_paths: int = 100) -> Index:
    edges, _ = graph(index)
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).where(T.contains_ci(F.col("node"), symbol)).distinct()
    return {"paths": G.edge_simple_paths(ends, edges, max_depth, max_paths, direction)}


def route_flow(index: Index, path: str, max_depth: int = 8, max_paths: int = 100) -> Index:
    """From a route's surfaces through its handler to everything they reach, with the surfaces met."""
    edges, nodes = graph(index)
    key = R.normalize(F.lit(path))["key"]
    starts = nodes.where((F.col("surface_kind") == "http-route") & (F.col("display_name") == key)).select("node")
    found, gaps = G.bounded_paths(starts, edges, nodes.where(F.col("surface_kind") != "http-route").select("node"), max_depth, max_paths)
    missing = starts.join(edges.select(F.col("source").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.lit("MissingMethodSymbolBridge").alias("gap"))
    return {"paths": found, "gaps": gaps.unionByName(missing), "surfaces": found.join(nodes, "node").groupBy("surface_kind", "display_name").agg(F.count(F.lit(1)).alias("n_paths"))}


def property_flow(index: Index, element: str, max_depth: int = 10) -> Index:
    """Where a contract's property leads: one way to each node, from every symbol that names it."""
    edges, nodes = graph(index)
    roots = _facts(index).where(T.contains_ci(F.col("contract_element"), element)).select(F.explode(F.array("source_symbol", "target_symbol")).alias("node")).where(F.col("node").isNotNull()).distinct()
    tree = G.bfs_tree(roots, edges, max_depth)
    return {"tree": tree, "surfaces": tree.join(nodes, "node").select("start", "node", "distance", "surface_kind", "display_name")}


# ---- diffs


def records(index: Index) -> DataFrame:
    """Comparable rows of an index: a stable key without versions, what makes a row change, and where it was seen."""
    f = _facts(index)
    s = surfaces(index)
    name = F.coalesce("package_name", "display_name")
    surf = s.select(F.concat_ws("|", F.lit("surface"), "source_id", "surface_kind", name).alias("key"), F.lit("surface").alias("record_kind"), F.concat_ws("|", F.coalesce("package_version", "version_hash", F.lit("-")), F.coalesce("http_method", F.lit("-")), F.coalesce("shape_hash", F.lit("-"))).alias("metadata"), "rule_id", "evidence_tier", "file_path", "start_line", "end_line", "source_id")
    edge = E.typed_edges(f).select(F.concat_ws("|", F.lit("edge"), "source_id", "edge_kind", F.coalesce("source_symbol", F.lit("-")), F.coalesce("target_symbol", F.lit("-"))).alias("key"), F.lit("edge").alias("record_kind"), F.lit("").alias("metadata"), "rule_id", "evidence_tier", "file_path", "start_line", "end_line", "source_id")
    rows = surf.unionByName(edge)
    return rows.withColumns({"evidence": T.hash_prefix(F.concat_ws("|", "rule_id", "evidence_tier", "file_path", "start_line", "end_line"), 32), "metadata": T.hash_prefix(F.col("metadata"), 32), "review": tier_rank(F.col("evidence_tier")) >= 3})


def _flags(rows: DataFrame, before: Index, after: Index) -> DataFrame:
    """Rows (with before_source_id, after_source_id) and what their source's manifests say of either side: before_reduced,
    after_reduced, and whether the source isn't the same one (identity_blocked) or its commit isn't known (sha_unknown)."""
    one = lambda index, n: coverage(index).select("source_id", (~F.col("full")).alias(f"{n}_reduced"), F.col("identity").alias(f"{n}_identity"), F.col("commit_sha").alias(f"{n}_sha"), F.lit(True).alias(f"{n}_there"))
    both = one(before, "before").join(one(after, "after"), "source_id", "full_outer")
    met = F.coalesce(F.col("before_there") & F.col("after_there"), F.lit(False))
    unknown = lambda c: F.col(c).isNull() | F.lower(c).isin("", "unknown")
    differs = F.coalesce(met & (F.col("before_identity") != F.col("after_identity")), F.lit(False))
    told = both.select("source_id", F.coalesce("before_reduced", F.lit(False)).alias("before_reduced"), F.coalesce("after_reduced", F.lit(False)).alias("after_reduced"), differs.alias("identity_blocked"), (unknown("before_sha") | unknown("after_sha")).alias("sha_unknown"), F.coalesce(met & (F.col("before_sha") == F.col("after_sha")), F.lit(False)).alias("same_sha"))
    rows = rows.withColumn("source_id", F.coalesce("after_source_id", "before_source_id")).join(told, "source_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("before_reduced", "after_reduced", "identity_blocked", "sha_unknown", "same_sha")})


def _diff_rows(before: Index, after: Index) -> DataFrame:
    rows = D.keyed_diff(records(before), records(after), "key", "metadata", "evidence", review="review", keep=["record_kind", "evidence_tier", "source_id"])
    rows = _flags(rows, before, after)
    return rows.withColumn("classification", D.classify_combined(F.col("change"), F.col("duplicate"), F.col("needs_review"), F.col("identity_blocked"), F.col("sha_unknown"), F.col("before_reduced"), F.col("after_reduced")))


def diff(before: Index, after: Index, max_rows: int = 1000) -> Index:
    """What changed between two indexes: rows with their class, and gaps where a side was read in part or isn't the same source."""
    rows = _diff_rows(before, after)
    kept, gap = A.capped(rows, [F.col("key")], max_rows, "DiffRowLimit")
    return {"rows": kept, "gaps": gap, "classes": A.count_by(rows, "classification")}


def path_diff(before: Index, after: Index, from_symbol: str | None = None, to_kind: str | None = None, to_name: str | None = None, max_depth: int = 8, max_paths: int | None = 100, max_frontier: int | None = 10_000) -> Index:
    """Ways that one side has and the other lacks: the key is where a way begins, its edges' kinds and what it ends in, so
    that ids of facts don't count; a way changes with its class or length. Three times `max_paths` rows are kept."""
    def side(index: Index) -> DataFrame:
        if max_paths is None and max_frontier is None:
            g = _parts(index)
            nodes, links = g["nodes"], _links(g)
            starts = links.select(F.col("source").alias("node")).join(g["routes"].select(F.col("group").alias("node")), "node", "left_anti").where(T.contains_ci(F.col("node"), from_symbol)).distinct() if from_symbol else _roots(links)
            starts, ends = cut(starts), _ends(nodes, to_kind, to_name).select("node")
            edges = _edges_to(g, ends, max_depth, ends.join(starts, "node", "left_anti"))
            begun = starts.join(edges.select(F.col("source").alias("node")), "node", "left_semi")
            found = G.bounded_paths(begun, edges, ends, max_depth, None, None, on_cycle="silent")[0]
        else:
            found = paths(index, from_symbol, to_kind, to_name, max_depth, max_paths, max_frontier)["paths"]
            edges, nodes = graph(index)
        kinds = found.select("start", "order", F.posexplode("edges").alias("i", "edge_id")).join(edges.select("edge_id", "kind", "target"), "edge_id").groupBy("start", "order").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "kind"))), lambda x: x["kind"]), ">").alias("kinds"))
        ends = nodes.select("node", F.concat_ws(":", "surface_kind", "display_name").alias("end"), "source_id")
        whole = found.join(kinds, ["start", "order"]).join(ends, "node", "left")
        return whole.select(F.concat_ws("|", "start", "kinds", F.coalesce("end", "node")).alias("key"), T.hash_prefix(F.concat_ws("|", "classification", F.size("edges").cast("string")), 32).alias("metadata"), (F.col("classification") != "StrongStaticPath").alias("review"), "source_id")

    rows = _flags(D.keyed_diff(side(before), side(after), "key", "metadata", review="review", keep=["source_id"]), before, after)
    rows = rows.withColumn("classification", D.classify_combined(F.col("change"), F.lit(False), F.col("needs_review"), F.col("identity_blocked"), F.col("sha_unknown"), F.col("before_reduced"), F.col("after_reduced")))
    if max_paths is None:
        return {"rows": rows, "gaps": rows.limit(0).select("key")}
    kept, gap = A.capped(rows, [F.col("key")], 3 * max_paths, "PathDiffRowLimit")
    return {"rows": kept, "gaps": gap}


def snapshot_diff(before: Index, after: Index, same_sha: bool | None = None) -> Index:
    """Two scans of one source; where they are of the same commit nothing can have come or gone. `same_sha` overrides the manifests."""
    rows = _flags(D.keyed_diff(records(before), records(after), "key", "metadata", "evidence", review="review", keep=["source_id"]), before, after)
    same = F.col("same_sha") if same_sha is None else F.lit(same_sha)
    return {"rows": rows.withColumn("classification", D.classify_single(F.col("change"), F.col("needs_review"), same, F.col("before_reduced"), F.col("after_reduced")))}


def contract_diff(before: Index, after: Index) -> Index:
    """Declarations by metadata alone."""
    def side(index: Index) -> DataFrame:
        f = E.with_properties(_facts(index)).where(F.col("fact_type").isin("TypeDeclared", "MethodDeclared", "PropertyDeclared", "AspNetRouteDeclared"))
        return f.select(F.concat_ws("|", "source_id", "fact_type", F.coalesce(T.first_value(F.col("props"), "name", "routes"), F.col("fact_id"))).alias("key"), T.metadata_hash(F.col("props")).alias("metadata"), "source_id")

    rows = _flags(D.keyed_diff(side(before), side(after), "key", "metadata", multiplicity=False, keep=["source_id"]), before, after)
    opposite = F.when(F.col("change") == "added", ~F.col("before_reduced")).otherwise(~F.col("after_reduced"))
    rows = rows.withColumn("classification", D.classify_contract(F.col("change"), F.col("duplicate") | F.col("needs_review"), F.col("identity_blocked"), opposite))
    return {"rows": rows, "rollup": rows.agg(A.precedence(F.col("classification"), A.CONTRACT, "NoDiff").alias("classification"))}


def impact(before: Index, after: Index) -> Index:
    """Each change with its impact and what to search ways for: an edge's source symbol, or a surface's kind and name."""
    rows = _diff_rows(before, after)
    rows = rows.withColumn("impact", D.impact_of(F.col("classification"), F.coalesce("after_evidence_tier", "before_evidence_tier")))
    # What follows the source in a key; a source's id may hold the separator itself.
    edge = F.col("key").startswith("edge|")
    rest = F.expr("substring(key, length(coalesce(concat(source_id, '|'), '')) + 1 + if(startswith(key, 'edge|'), 5, 8))")
    parts = F.split(rest, r"\|")
    selector = F.when(edge, F.get(parts, F.lit(1))).otherwise(F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    rows = rows.withColumn("shown", F.when(~edge, rest))
    return {"items": rows.withColumn("selector", selector)}


def impact_context(before: Index, after: Index, max_depth: int = 8, per_item: int = 5, items: DataFrame | None = None) -> Index:
    """For each change the ways it lies on, on the after side (on the before side if it is gone), at most `per_item`: from a
    changed edge's symbol on to surfaces, and from a changed surface back to where ways begin. A gap for each item without one."""
    items = (impact(before, after)["items"] if items is None else items).select("key", "change", F.when(F.col("key").startswith("edge|"), F.col("selector")).alias("symbol"), F.col("shown").alias("name"))
    items, out = cut(items), []
    for index, gone in ((after, False), (before, True)):
        g = _parts(index)
        nodes = g["nodes"]
        mine = items.where((F.col("change") == "removed") if gone else (F.col("change") != "removed"))
        changed = mine.where(F.col("symbol").isNotNull()).select("key", F.col("symbol").alias("node"))
        shown = mine.where(F.col("symbol").isNull()).join(nodes.select("node", F.concat_ws("|", "surface_kind", "display_name").alias("name")), "name").select("key", "node")
        ends = _ends(nodes, None, None).select("node")
        onward, _ = G.bounded_paths(changed.select("node"), _edges_to(g, ends, max_depth, ends.join(changed, "node", "left_anti")), ends, max_depth, None, None, on_cycle="silent")
        back, _ = G.bounded_paths(shown.select("node"), _edges_to(g, shown.select("node"), max_depth), _roots(_links(g)), max_depth, None, None, reverse=True, on_cycle="silent", guard=False)
        for way, of in ((onward, changed), (back, shown)):
            out.append(way.select(F.col("start").alias("node"), "start", "order", "depth", "classification").join(of.distinct(), "node").drop("node"))
    held = M.first_per_key(union(out), ["key"], [F.col("depth"), F.col("start"), F.col("order")], per_item).select("key", "start", "depth", "classification", "rn")
    return {"paths": held, "gaps": items.join(held.select("key").distinct(), "key", "left_anti").select("key", F.lit("NoPathContext").alias("gap"))}


def _with_routes(facts: DataFrame) -> DataFrame:
    """Facts with the path key and methods of those that are endpoints."""
    p = F.col("props")
    route = T.first_value(p, "normalizedPathTemplate", "routeTemplate", "routePattern", "routeTemplates", "path", "urlPath", "url", "routes")
    http = F.col("fact_type").isin("HttpCallDetected", "HttpRouteBinding", "AspNetRouteDeclared")
    return E.with_properties(facts).withColumns({"path_key": F.when(http & ~T.blank(route), R.normalize(F.split(route, ",")[0])["key"]), "methods": F.when(http, R.methods(T.first_value(p, "httpMethod", "httpMethods", "methodName"))).otherwise(F.array().cast("array<string>"))})


def reduce(index: Index, changes: DataFrame, full: bool, budget: int = 10_000) -> Index:
    """Contract changes against an index: matches in the order of their strength, within a total budget, and a class each."""
    combined = "combined_facts" in index
    f = _with_routes(_facts(index))
    m = M.delta_matches(changes.select("change_id", "element"), f).join(f.select("fact_id", "fact_type", "evidence_tier", "file_path"), "fact_id")
    numbers = A.with_budget(m.groupBy("change_id").agg(F.count(F.lit(1)).cast("long").alias("wanted")), ["change_id"], "wanted", budget)
    ranked = M.first_per_key(m, ["change_id"], [F.col("rank").desc(), F.col("file_path"), F.col("fact_id")], None)
    kept = ranked.join(numbers, "change_id").where(F.col("rn") <= F.col("granted"))
    one = F.col("evidence_tier") == TIERS[0]
    cls = A.reduction_class(F.bool_or((F.col("fact_type") == "AnalysisGap") | (F.col("evidence_tier") == TIERS[3])), F.bool_or(F.col("strength").isin("Type", "Textual")), F.bool_or(one & F.col("fact_type").isin("PropertyAccessed", "MethodInvoked", "TypeDeclared")), F.bool_or(one & F.col("fact_type").isin("MethodDeclared", "PropertyDeclared", "FieldDeclared", "ParameterDeclared", "DbContextDeclared")), F.bool_or(F.col("evidence_tier") == TIERS[1]), F.bool_or(F.col("evidence_tier") == TIERS[2]), combined)
    told = m.groupBy("change_id").agg(cls.alias("classification"), F.count(F.lit(1)).alias("n_facts"), F.countDistinct("file_path").alias("n_files"))
    out = changes.join(told, "change_id", "left").withColumn("classification", F.coalesce("classification", A.no_match_class(F.lit(full), combined)))
    return {"findings": out, "evidence": kept.select("change_id", "fact_id", "strength", "rn"), "warnings": told.where(F.col("n_files") > 10).select("change_id", F.lit("fan-out").alias("warning"))}


def package_impact(index: Index, changes: DataFrame) -> Index:
    s = surfaces(index).where(F.col("package_name").isNotNull())
    m = M.package_matches(changes, s.select("fact_id", "source_id", "package_name", "ecosystem", "package_version", "evidence_tier"))
    none = changes.join(m.select("change_id").distinct(), "change_id", "left_anti").select("change_id", F.lit("NoPackageEvidence").alias("gap"))
    return {"findings": m, "gaps": none}


def sql_schema_impact(index: Index, changes: DataFrame) -> Index:
    """Facts with a changed table or shape, by changes of sources.readers.sql_schema_delta."""
    s = surfaces(index).where(F.col("surface_kind") == "sql-query").select("fact_id", "evidence_tier", "shape_hash", F.explode(F.split(F.lower(F.coalesce("table_names", F.lit(""))), ";")).alias("table_name"))
    by_table = s.join(F.broadcast(changes.where(F.col("table_name").isNotNull()).select("change_id", "table_name", "column_name")), "table_name").select("change_id", "fact_id", F.when(F.col("column_name").isNull(), F.lit("sql-table-only")).otherwise(F.lit("sql-table-and-column")).alias("evidence"))
    by_shape = s.join(F.broadcast(changes.where(F.col("shape_hash").isNotNull()).select("change_id", "shape_hash")), "shape_hash").select("change_id", "fact_id", F.lit("sql-shape").alias("evidence"))
    return {"findings": by_table.unionByName(by_shape).distinct()}


def portfolio(indexes: dict[str, Index]) -> Index:
    """Surfaces that several inputs share, and each input's class."""
    return portfolio_of(union([surfaces(i).select(F.lit(label).alias("label"), "fact_id", "surface_kind", "display_name", "evidence_tier") for label, i in indexes.items()]))


def portfolio_of(s: DataFrame) -> Index:
    """The same for surfaces stacked in one table with their input's label: one plan for ever so many inputs."""
    keyed = s.withColumn("key", F.concat_ws("|", "surface_kind", F.lower("display_name")))
    shared = A.shared_groups(keyed, "key", "label", "evidence_tier", "fact_id").where(F.col("n_sources") > 1)
    cls = F.when(tier_rank(F.col("evidence_tier")) <= 2, F.lit("Actionable")).when(F.col("evidence_tier") == TIERS[2], F.lit("NeedsReview")).otherwise(F.lit("UnknownAnalysisGap"))
    told = s.withColumn("class", cls).groupBy("label", "surface_kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") != "Actionable").alias("n_review"))
    status = F.when(F.col("n_review") == 0, F.lit("available")).when(F.col("n_review") < F.col("n"), F.lit("partial")).otherwise(F.lit("review"))
    return {"shared": shared, "inputs": s.groupBy("label").agg(F.count(F.lit(1)).alias("n_surfaces"), A.precedence(cls, A.PORTFOLIO, "None").alias("classification")), "sections": told.withColumn("status", status)}


def portfolio_diff(before: dict[str, Index], after: dict[str, Index]) -> Index:
    """Inputs by label against their earlier state; another repository or a source read in part limits what a row says."""
    def side(x: dict[str, Index]) -> tuple[DataFrame, DataFrame]:
        rows = union([records(i).withColumn("key", F.concat_ws("|", F.lit(label), "key")).withColumn("label", F.lit(label)) for label, i in x.items()])
        told = union([coverage(i).select(F.lit(label).alias("label"), "full", "identity") for label, i in x.items()]).groupBy("label").agg(F.bool_and("full").alias("full"), F.array_sort(F.collect_set("identity")).alias("identity"))
        return rows, told

    (b, b_told), (a, a_told) = side(before), side(after)
    rows = D.keyed_diff(b, a, "key", "metadata", "evidence", review="review", keep=["label"]).withColumn("label", F.coalesce("after_label", "before_label"))
    told = b_told.select("label", F.col("full").alias("bf"), F.col("identity").alias("bi")).join(a_told.select("label", F.col("full").alias("af"), F.col("identity").alias("ai")), "label", "full_outer")
    rows = rows.join(told, "label", "left")
    differs = F.coalesce((F.size("bi") > 0) & (F.size("ai") > 0) & (F.col("bi") != F.col("ai")), F.lit(False))
    part = ~(F.coalesce("bf", F.lit(True)) & F.coalesce("af", F.lit(True)))
    return {"rows": rows.withColumn("classification", D.classify_portfolio(differs, part, F.col("duplicate"), F.col("needs_review"))).drop("bf", "bi", "af", "ai")}


# Sections of a release review in their order, and what its checklist asks of each.
SECTIONS = {
    "changed_surfaces": "Review the surfaces that changed.", "changed_edges": "Review the calls that changed.", "path_context": "Follow the ways that pass a change.",
    "reverse": "Check who reaches the changed data.", "sql_evidence": "Check the SQL whose shape changed.", "contract": "Check the contract changes asked about.",
    "packages": "Check the package changes asked about.", "sql_schema": "Check the schema changes asked about.", "gaps": "Rescan the sources that were read in part.",
}


def release_review(before: Index, after: Index, changes: DataFrame | None = None, packages: DataFrame | None = None, max_rows: int = 100, schema: DataFrame | None = None, context: bool = False) -> Index:
    """Sections of a release, each capped, with their status, the findings' severity, a summary, a checklist and an overall
    class. The ways that pass a change are searched with `context`."""
    items = impact(before, after)["items"]
    items = items.withColumn("severity", A.severity(F.col("impact"), F.coalesce("after_evidence_tier", "before_evidence_tier"))).withColumn("attention", A.attention(F.col("severity")))
    items = cut(items)
    surface = F.col("key").startswith("surface|")
    parts: dict[str, DataFrame | None] = {"changed_surfaces": items.where(surface), "changed_edges": items.where(~surface), "sql_evidence": items.where(surface & F.col("key").contains("|sql-query|"))}
    seen = impact_context(before, after, items=items) if context else None
    parts["path_context"] = seen["paths"] if seen else None
    parts["reverse"] = reverse(after, "sql-query", max_roots=None, per_root=None, max_frontier=None)["roots"].withColumn("key", F.col("root")) if context else None
    parts["contract"] = None if changes is None else reduce(after, changes, True)["findings"].withColumn("key", F.col("change_id"))
    parts["packages"] = None if packages is None else package_impact(after, packages)["findings"].withColumn("key", F.col("change_id"))
    parts["sql_schema"] = None if schema is None else sql_schema_impact(after, schema)["findings"].withColumn("key", F.concat_ws("|", "change_id", "fact_id"))
    limited = coverage(before).where(~F.col("full")).select(F.concat(F.lit("before:"), "source_id").alias("key")).unionByName(coverage(after).where(~F.col("full")).select(F.concat(F.lit("after:"), "source_id").alias("key")))
    parts["gaps"] = limited
    out: Index = {}
    status, spark = [], items.sparkSession
    for at, name in enumerate(SECTIONS):
        rows = parts.get(name)
        if rows is None:
            status.append(spark.createDataFrame([(at, name, "not_requested", 0)], "at int, section string, status string, n_rows long"))
            continue
        order = [F.col("severity"), F.col("key")] if "severity" in rows.columns else [F.col("key")]
        out[name], _ = A.capped(rows, order, max_rows, name)
        n = F.col("n_rows")
        status.append(rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(at).alias("at"), F.lit(name).alias("section"), F.when(n > max_rows, F.lit("truncated")).when(n == 0, F.lit("empty")).otherwise(F.lit("available")).alias("status"), "n_rows"))
    sections = union(status)
    asks = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])[F.col("section")]
    out["sections"] = sections.select("section", F.when(F.col("status") == "empty", F.lit("available")).otherwise(F.col("status")).alias("status"))
    out["summary"] = sections.select("section", "status", "n_rows")
    out["checklist"] = sections.where((F.col("n_rows") > 0) & (F.col("status") != "not_requested")).select("at", "section", asks.alias("ask"), "n_rows")
    cls = F.when(F.col("impact") == "UnknownAnalysisGap", F.lit("UnknownAnalysisGap")).when(F.col("impact") == "ProbableStaticImpact", F.lit("ActionableEvidence")).otherwise(F.lit("NeedsReview"))
    out["rollup"] = items.agg(A.precedence(cls, A.RELEASE, "NoActionableEvidence").alias("classification"), F.count(F.lit(1)).alias("n_items"))
    return out


def select(index: Index, sources: list[str] | None = None, kinds: list[str] | None = None, tiers: list[str] | None = None) -> DataFrame:
    """Surfaces of the sources, kinds and tiers asked for; a word that isn't of the vocabulary is an error, not an empty result."""
    for given, known in ((kinds, E.SURFACE_KINDS), (tiers, TIERS)):
        if wrong := sorted(set(given or []) - set(known)):
            raise ValueError(f"unknown: {', '.join(wrong)}; known: {', '.join(known)}")
    s = surfaces(index)
    for column, given in (("source_id", sources), ("surface_kind", kinds), ("evidence_tier", tiers)):
        s = s if given is None else s.where(F.col(column).isin(given))
    return s


def export(index: Index) -> Index:
    """Counts by source and type, and the edge relation."""
    f = _facts(index)
    return {"counts": A.count_by(f, "source_id", "fact_type"), "edges": E.typed_edges(f).select("source_id", "fact_id", "edge_kind", "source_symbol", "target_symbol", "evidence_tier")}


def docs_export(index: Index) -> Index:
    from ..sources.sinks import evidence_chunks

    return {"chunks": evidence_chunks(surfaces(index), ["source_id", "fact_id"], ["surface_kind", "display_name", "evidence_tier", "safe_path", "start_line"])}


def vault(index: Index) -> Index:
    """A note for each symbol with what it links to, at most 200 links a note."""
    edges, _ = graph(index)
    ranked = M.first_per_key(edges.select("source", "kind", "target").distinct(), ["source"], [F.col("kind"), F.col("target")], 200)
    line = F.concat(F.lit("- "), "kind", F.lit(": [["), "target", F.lit("]]"))
    return {"notes": ranked.withColumn("line", line).groupBy(F.col("source").alias("note")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]), "\n").alias("text"))}


def baseline(index: Index) -> Index:
    """What a later run is compared with: counts by type and rule, and a hash over all of them."""
    c = A.count_by(_facts(index), "fact_type", "rule_id")
    total = c.agg(F.bit_xor(F.xxhash64("fact_type", "rule_id", "n")).alias("digest"), F.sum("n").alias("n_facts"))
    return {"counts": c, "digest": total}


def baseline_compare(before: Index, after: Index) -> Index:
    b, a = (x["counts"].select(F.concat_ws("|", "fact_type", "rule_id").alias("key"), F.col("n").cast("string").alias("n")) for x in (before, after))
    return {"rows": D.keyed_diff(b, a, "key", "n", multiplicity=False)}


def packet(index: Index) -> Index:
    """What is handed on: for each source, type and rule the number of facts and files, the weakest tier, and a hash over all."""
    f = _facts(index)
    rows = f.groupBy("source_id", "fact_type", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_path").alias("n_files"), F.max_by("evidence_tier", tier_rank(F.col("evidence_tier"))).alias("weakest"), F.bit_xor(F.xxhash64("file_path", "start_line", "end_line", "evidence_tier", "source_symbol", "target_symbol")).alias("digest"))
    return {"rows": rows}


def packet_diff(before: Index, after: Index) -> Index:
    """Two packets by source, type and rule: counts, files, tiers and hashes say whether a row changed."""
    side = lambda x: x["rows"].select(F.concat_ws("|", "source_id", "fact_type", "rule_id").alias("key"), F.concat_ws("|", "n", "n_files", "weakest", "digest").alias("metadata"))
    return {"rows": D.keyed_diff(side(before), side(after), "key", "metadata", multiplicity=False)}


def evidence_pack(index: Index) -> Index:
    """A pack's checks: every fact has a rule with a version, a known tier and a relative path."""
    f = _facts(index)
    rule = lambda name, ok: f.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_bad"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n_bad", "n", (F.col("n_bad") == 0).alias("passes"))
    checks: list[tuple[str, Column]] = [("rule-version", F.col("rule_id").rlike(r"\.v\d+$")), ("known-tier", F.col("evidence_tier").isin(*TIERS)), ("relative-path", ~T.safe_path(F.col("file_path")).startswith("absolute-path-hash:")), ("lines", F.col("start_line").between(1, 10**9) & (F.col("end_line") >= F.col("start_line")))]
    return {"checks": union([rule(n, ok) for n, ok in checks])}
