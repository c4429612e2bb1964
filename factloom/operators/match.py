"""Joins of evidence: endpoint alignment, as-of aliases, message pairs, reconciliation, deltas, packages, permissions.

What the reference tests pair by pair is an equality join on exploded keys here, with the rest as a residual filter.
Defined results: null keys match nothing; ties are broken by the listed order down to the id; caps are part of the
result and leave a truncation gap where they cut (see gaps); empty inputs give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import routes as R
from ..functions import text as T
from ..schema import tier_name, tier_rank

# ---- as-of


def asof_backward(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, take: list[str], tie: str, prefix: str = "asof_") -> DataFrame:
    """Each left row with `take` of the latest right row of its group at or before it; the greater `tie` wins.

    Both sides are merged and sorted once a group, and the last right row is carried on: no pair is ever formed, so a
    group with many rows on both sides costs its sort.
    """
    lefts = left.select(*on, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"{prefix}{c}") for c in take], F.lit(False).alias("__there"))
    rights = right.where(F.col(right_at).isNotNull()).select(*on, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(lefts.schema["__row"].dataType).alias("__row"), F.col(tie).alias("__tie"), *[F.col(c).alias(f"{prefix}{c}") for c in take], F.lit(True).alias("__there"))
    w = Window.partitionBy(*on).orderBy("__at", "__side", F.col("__tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = F.last(F.when(F.col("__there"), F.struct(*[f"{prefix}{c}" for c in take])), ignorenulls=True).over(w).alias("__got")
    keyed = F.lit(True)
    for c in on:
        keyed = keyed & F.col(c).isNotNull()
    merged = lefts.unionByName(rights).select("__side", "__row", "__at", keyed.alias("__keyed"), got)
    out = merged.where(F.col("__side") == 1)
    ok = F.col("__keyed") & F.col("__at").isNotNull()
    return out.select("__row.*", *[F.when(ok, F.col(f"__got.{prefix}{c}")).alias(f"{prefix}{c}") for c in take])


def resolve_aliases(flows: DataFrame, aliases: DataFrame, hops: int = 3) -> DataFrame:
    """Follows a flow's symbol through at most `hops` aliases of its method, each the latest at or before the flow.

    `flows` has flow_id, scan_id, container, symbol, line; `aliases` has scan_id, container, alias, origin, line,
    alias_id. A symbol met twice stops the walk. Adds resolved (the last symbol) and n_hops.
    """
    step = flows.withColumns({"resolved": F.col("symbol"), "n_hops": F.lit(0), "__seen": F.array("symbol")})
    side = aliases.select("scan_id", "container", F.col("alias").alias("resolved"), "origin", F.col("line").alias("alias_line"), "alias_id")
    for _ in range(hops):
        step = asof_backward(step, side, ["scan_id", "container", "resolved"], "line", "alias_line", ["origin"], "alias_id", "next_")
        go = F.col("next_origin").isNotNull() & ~F.array_contains("__seen", F.col("next_origin"))
        step = step.withColumns({"n_hops": F.col("n_hops") + go.cast("int"), "__seen": F.when(go, F.array_append("__seen", F.col("next_origin"))).otherwise(F.col("__seen")), "resolved": F.when(go, F.col("next_origin")).otherwise(F.col("resolved"))}).drop("next_origin")
    return step.drop("__seen")


def unique_assignment(assignments: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of each key that has exactly one distinct value: a field assigned once in its type's constructors."""
    return assignments.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__most")).where(F.col(value) == F.col("__most")).drop("__most")


# ---- endpoints


def endpoint_groups(clients: DataFrame, servers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What align_endpoints pairs, before the pairs are formed: calls (client_id, path_key, client_methods), what each
    path_key and client_methods meets in each source of servers, and the keys of the servers."""
    keys = servers.select("id", "source_id", F.col("path_key").alias("server_key"), F.col("methods").alias("server_methods"), "file_path", "start_line", F.explode(R.expand_keys(F.col("path_key"))).alias("path_key"))
    keys = keys.select(F.col("id").alias("server_id"), F.col("source_id").alias("server_source"), "server_key", "server_methods", F.col("file_path").alias("server_file"), F.col("start_line").alias("server_line"), "path_key").distinct()
    dynamic = F.coalesce(F.col("is_dynamic"), F.lit(False)) | T.blank(F.col("path_key"))
    known = clients.where(~dynamic).select(F.col("id").alias("client_id"), "path_key", F.col("methods").alias("client_methods"))
    # A key that many calls and routes share would give their product; routes are first reduced to what the counts need.
    per_route = keys.groupBy("path_key", "server_source", "server_methods").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("server_file", "server_line", "server_id", "server_key")).alias("first"),
        F.min(F.struct(F.array_join("server_methods", ","), "server_file", "server_line", "server_id", "server_key")).alias("first_by_method"),
    )
    asked = known.select("path_key", "client_methods").distinct()
    met = asked.join(per_route, "path_key")
    fits = R.methods_compatible(F.col("client_methods"), F.col("server_methods"))
    told = met.groupBy("path_key", "client_methods", "server_source").agg(
        F.sum(F.when(fits, F.col("n")).otherwise(0)).alias("n_fit"), F.min(F.when(fits, F.col("first"))).alias("fit"), F.min("first_by_method").alias("near"),
        F.collect_set(F.when(fits, F.col("server_methods"))).alias("fit_methods"), F.collect_set("server_methods").alias("near_methods"),
    )
    kind = F.when((F.col("n_fit") == 1) & (F.col("fit.server_key") == F.col("path_key")), F.lit("MatchedEndpoint")).when(F.col("n_fit") == 1, F.lit("OptionalSegmentMatch")).when(F.col("n_fit") > 1, F.lit("AmbiguousMatch")).otherwise(F.lit("MethodMismatch"))
    told = told.select("path_key", "client_methods", "server_source", kind.alias("classification"), F.when(F.col("n_fit") > 0, F.col("fit.server_id")).otherwise(F.col("near.server_id")).alias("server_id"), F.when(F.col("n_fit") > 0, F.col("fit_methods")).otherwise(F.col("near_methods")).alias("compared"))
    return known, told, keys


def align_endpoints(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """Client calls against server routes, for each source of servers.

    Both sides have id, source_id, path_key, methods (array), file_path, start_line; clients also is_dynamic. Rows:
    classification, client_id, server_source, server_id. One match of path and method is MatchedEndpoint, or
    OptionalSegmentMatch where the key differs; more are AmbiguousMatch, only the path MethodMismatch (the first by
    file and line stands for them); then what neither side matched, and dynamic calls for review.
    """
    known, told, keys = endpoint_groups(clients, servers)
    dynamic = F.coalesce(F.col("is_dynamic"), F.lit(False)) | T.blank(F.col("path_key"))
    out = known.join(told, ["path_key", "client_methods"]).select("classification", "client_id", "server_source", "server_id")
    alone = known.join(told.select("path_key", "client_methods").distinct(), ["path_key", "client_methods"], "left_anti").select(F.lit("ClientCallNoServerEndpoint").alias("classification"), "client_id", F.lit(None).cast("string").alias("server_source"), F.lit(None).cast("string").alias("server_id"))
    seen = told.select("path_key", "server_source", F.explode("compared").alias("server_methods")).distinct()
    compared = keys.join(seen, ["path_key", "server_source", "server_methods"], "left_semi").select("server_id").distinct()
    idle = servers.select(F.col("id").alias("server_id"), F.col("source_id").alias("server_source")).join(compared, "server_id", "left_anti").select(F.lit("ServerEndpointNoClientMatch").alias("classification"), F.lit(None).cast("string").alias("client_id"), "server_source", "server_id")
    review = clients.where(dynamic).select(F.lit("DynamicClientUrlNeedsReview").alias("classification"), F.col("id").alias("client_id"), F.lit(None).cast("string").alias("server_source"), F.lit(None).cast("string").alias("server_id"))
    return out.unionByName(alone).unionByName(idle).unionByName(review)


# ---- messages


def pair_messages(surfaces: DataFrame, per_key: int = 100, total: int | None = 1000) -> tuple[DataFrame, DataFrame]:
    """Publishers with the consumers of the same static destination, and the keys at which a cap cut.

    `surfaces` has id, direction, status, key, tier, label. Pairs come in the order of key, publisher, consumer; at most
    `per_key` a key and `total` in all (None: all). Ranks decide beforehand which pairs are formed, so no key yields more.
    """
    rows = surfaces.where((F.col("status") == "static") & ~T.blank(F.col("key")))
    order = [F.col("label").asc_nulls_first(), F.col("id")]
    side = lambda d: rows.where(F.col("direction") == d).select("key", "id", "tier", F.row_number().over(Window.partitionBy("key").orderBy(*order)).alias("r"))
    n_consumers = rows.where(F.col("direction") == "consume").groupBy("key").agg(F.count(F.lit(1)).alias("n_c"))
    p = side("publish").where(F.col("r") <= per_key).join(n_consumers, "key").where((F.col("r") - 1) * F.least(F.col("n_c"), F.lit(per_key)) < per_key)
    c = side("consume").where(F.col("r") <= per_key)
    pairs = p.select("key", F.col("id").alias("publisher"), F.col("tier").alias("p_tier"), F.col("r").alias("p_r"), "n_c").join(c.select("key", F.col("id").alias("consumer"), F.col("tier").alias("c_tier"), F.col("r").alias("c_r")), "key")
    pairs = pairs.where((F.col("p_r") - 1) * F.col("n_c") + F.col("c_r") <= per_key)
    kept = pairs if total is None else pairs.orderBy("key", "p_r", "c_r").limit(total)
    edges = kept.select("key", "publisher", "consumer", tier_name(F.greatest(tier_rank(F.col("p_tier")), tier_rank(F.col("c_tier")))).alias("tier"))
    sizes = rows.groupBy("key").agg(F.count_if(F.col("direction") == "publish").alias("n_p"), F.count_if(F.col("direction") == "consume").alias("n_c"))
    cut = sizes.where(F.col("n_p") * F.col("n_c") > per_key).select("key", (F.col("n_p") * F.col("n_c")).alias("n_pairs"))
    return edges, cut


# ---- symbols


def reconcile(symbols: DataFrame) -> DataFrame:
    """(source_id, from_id, to_id, kind) for names of one source that mean the same symbol.

    `symbols` has source_id, id, display_name. Equal member, type and signature link to the least id; a name without
    signature links to the only signed one of its type and member, a bare member to the only qualified one.
    """
    a = symbols.withColumn("a", T.symbol_alias(F.col("display_name"))).where(F.col("a").isNotNull()).select("source_id", "id", "a.*")
    full = a.where(F.col("type").isNotNull() & F.col("signature").isNotNull())
    same = full.groupBy("source_id", "member", "type", "signature").agg(F.min("id").alias("to_id"))
    equal = full.join(same, ["source_id", "member", "type", "signature"]).where(F.col("id") != F.col("to_id")).select("source_id", F.col("id").alias("from_id"), "to_id", F.lit("same-signature").alias("kind"))
    one_signed = full.groupBy("source_id", "member", "type").agg(F.min("id").alias("to_id"), F.count_distinct("signature").alias("n")).where(F.col("n") == 1)
    unsigned = a.where(F.col("type").isNotNull() & F.col("signature").isNull()).join(one_signed, ["source_id", "member", "type"]).select("source_id", F.col("id").alias("from_id"), "to_id", F.lit("unsigned-to-signed").alias("kind"))
    one_type = a.where(F.col("type").isNotNull()).groupBy("source_id", "member").agg(F.min("id").alias("to_id"), F.count_distinct("type").alias("n")).where(F.col("n") == 1)
    bare = a.where(F.col("type").isNull()).join(one_type, ["source_id", "member"]).select("source_id", F.col("id").alias("from_id"), "to_id", F.lit("bare-to-qualified").alias("kind"))
    return equal.unionByName(unsigned).unionByName(bare)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int | None = 1) -> DataFrame:
    """The first n rows of each key in a total order (all for None), with their rank `rn`."""
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if n is None else ranked.where(F.col("rn") <= n)


def remoting_calls(configures: DataFrame, sites: DataFrame) -> DataFrame:
    """(configure_id, site_id, type_name): code that configures a remote type with the calls made on it, by the type's last
    name without case. `configures` has id, type_name, source_id; `sites` id, target_symbol (Type.Member), source_id."""
    a = configures.select(F.col("id").alias("configure_id"), "source_id", F.lower(T.member_name(F.col("type_name"))).alias("name"), "type_name").where(F.col("name").isNotNull())
    b = sites.select(F.col("id").alias("site_id"), "source_id", F.lower(T.member_name(T.containing_type(F.col("target_symbol")))).alias("name")).where(F.col("name").isNotNull())
    return a.join(b, ["source_id", "name"]).select("configure_id", "site_id", "type_name").distinct()


def dispatch_candidates(relationships: DataFrame, fan_out: int = 10) -> tuple[DataFrame, DataFrame]:
    """Edges from interface or base members to what implements or overrides them, at most `fan_out` each, and who was cut.

    `relationships` has source_id, from_symbol, to_symbol, kind (implements or overrides).
    """
    kinds = {"implements": "interface-candidate", "overrides": "override-candidate"}
    rows = relationships.where(F.col("kind").isin(*kinds)).select("source_id", F.col("to_symbol").alias("from_symbol"), F.col("from_symbol").alias("to_symbol"), F.when(F.col("kind") == "implements", kinds["implements"]).otherwise(kinds["overrides"]).alias("edge_kind")).distinct()
    edges = first_per_key(rows, ["source_id", "from_symbol", "edge_kind"], [F.col("to_symbol")], fan_out).drop("rn")
    cut = rows.groupBy("source_id", "from_symbol", "edge_kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fan_out)
    return edges, cut


# ---- deltas

#: How strongly a fact matches a change, from none to all.
STRENGTH = ("None", "Textual", "Type", "Member", "TypeAndMember", "Endpoint", "Exact")


def delta_matches(changes: DataFrame, facts: DataFrame) -> DataFrame:
    """(change_id, fact_id, strength) of the facts that a contract change may touch.

    `changes` has change_id, element (Type.Member, a bare name, or METHOD /path); `facts` fact_id, source_symbol,
    target_symbol, contract_element, path_key, methods. Each fact's names are exploded once and joined by equality.
    """
    name = F.lower(F.trim("element"))
    endpoint = F.col("element").rlike(r"^[A-Za-z]+\s+/")
    c = changes.select("change_id", "element", endpoint.alias("is_endpoint"), name.alias("exact"), T.symbol_alias(F.col("element")).alias("a"), F.upper(F.regexp_extract("element", r"^(\S+)", 1)).alias("method"), R.normalize(F.when(endpoint, F.regexp_extract("element", r"\s(/.*)$", 1)))["key"].alias("path"))
    alias = lambda s: T.symbol_alias(F.col(s))
    cand = F.array(*[F.struct(F.lower(F.col(s)).alias("exact"), alias(s)["member"].alias("member"), alias(s)["type"].alias("type")) for s in ("source_symbol", "target_symbol", "contract_element")])
    names = facts.select("fact_id", F.explode(cand).alias("n")).select("fact_id", "n.*").where(F.col("exact").isNotNull())
    keys = lambda *pairs: F.explode(F.array_distinct(F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key"), F.lit(s).alias("rank")) for k, v, s in pairs]), lambda x: x["key"].isNotNull())))
    whole = lambda m, t: F.concat_ws(".", t, m)
    fk = names.select("fact_id", keys(("exact", F.col("exact"), 6), ("both", F.when(F.col("type").isNotNull(), whole(F.col("member"), F.col("type"))), 4), ("member", F.col("member"), 3), ("type", F.col("type"), 2)).alias("k")).select("fact_id", "k.kind", "k.key")
    ck = c.where(~F.col("is_endpoint")).select("change_id", keys(("exact", F.col("exact"), 6), ("both", F.when(F.col("a.type").isNotNull(), whole(F.col("a.member"), F.col("a.type"))), 4), ("member", F.col("a.member"), 3), ("type", F.when(F.col("a.type").isNull(), F.col("a.member")), 2)).alias("k")).select("change_id", "k.kind", "k.key", "k.rank")
    by_name = fk.distinct().join(F.broadcast(ck), ["kind", "key"]).select("change_id", "fact_id", "rank")
    by_path = facts.where(F.col("path_key").isNotNull()).select("fact_id", F.col("path_key").alias("path"), "methods").join(F.broadcast(c.where("is_endpoint").select("change_id", "path", "method")), "path").where((F.col("method") == "ANY") | F.array_contains("methods", "ANY") | F.expr("array_contains(methods, method)")).select("change_id", "fact_id", F.lit(5).alias("rank"))
    best = by_name.unionByName(by_path).groupBy("change_id", "fact_id").agg(F.max("rank").alias("rank"))
    return best.select("change_id", "fact_id", F.element_at(F.array(*map(F.lit, STRENGTH)), F.col("rank") + 1).alias("strength"), "rank")


def package_matches(changes: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Changed packages with the surfaces that use them: names without case, ecosystems equal where both are given."""
    c = F.broadcast(changes.select("change_id", F.lower("package_name").alias("name"), F.lower("ecosystem").alias("c_eco"), "old_version", "new_version"))
    s = surfaces.withColumns({"name": F.lower("package_name"), "s_eco": F.lower("ecosystem")})
    return s.join(c, "name").where(F.col("c_eco").isNull() | F.col("s_eco").isNull() | (F.col("c_eco") == F.col("s_eco"))).drop("name", "c_eco", "s_eco")


def permission_status(operations: DataFrame, permissions: DataFrame) -> DataFrame:
    """Each operation with the state of its evidence in permission scripts.

    `operations` has operation_id, capability, object_id, role_id, file_path, end_line, context, coverage; `permissions`
    capability, object_id, role_id, action, file_path, start_line, context, coverage. The order of the rules is fixed by the
    contract; the first that holds decides. Only permissions on the same object meet an operation.
    """
    o = operations.withColumn("object_key", F.lower("object_id")).alias("o")
    p = permissions.select("capability", F.col("object_id").alias("p_object"), F.col("role_id").alias("p_role"), "action", F.col("file_path").alias("p_file"), F.col("start_line").alias("p_line"), F.col("context").alias("p_context"), F.col("coverage").alias("p_coverage"), F.lower("object_id").alias("object_key"))
    missing = T.blank(F.col("object_id"))
    fits = ~missing & (F.coalesce(F.lower("p_object"), F.lit("")) == F.lower("object_id")) & (F.col("role_id").isNull() | F.col("p_role").isNull() | (F.lower("p_role") == F.lower("role_id")))
    j = o.join(p, ["capability", "object_key"], "left")
    grant = fits & F.col("action").isin("grant", "owner-change", "role-membership")
    agg = j.groupBy("operation_id").agg(
        F.first("capability").alias("capability"), F.bool_or(missing).alias("no_id"), F.count_if(grant).alias("grants"), F.count_if(fits & (F.col("action") == "revoke")).alias("revokes"),
        F.bool_or(F.col("o.coverage") == "reduced").alias("reduced"), F.bool_or(F.coalesce(fits & (F.col("p_file") != F.col("o.file_path")), F.lit(False))).alias("cross"),
        F.bool_or(F.coalesce(grant & (F.col("p_file") == F.col("o.file_path")) & (F.col("p_line") > F.col("o.end_line")), F.lit(False))).alias("after"),
        F.bool_or(F.coalesce(grant & (F.col("context") != "unknown") & (F.col("p_context") != "unknown") & (F.col("p_context") != F.col("context")), F.lit(False))).alias("clash"),
        F.bool_or(F.coalesce((F.col("context") == "unknown") | (grant & (F.col("p_context") == "unknown")), F.lit(True))).alias("no_context"), F.bool_or(F.coalesce(grant & (F.col("p_coverage") != "complete"), F.lit(False))).alias("thin"),
    )
    status = (
        F.when(F.col("capability").isin("superuser", "role-admin", "ownership"), F.lit("needs-owner-review")).when(F.col("no_id"), F.lit("unknown")).when(F.col("revokes") > 0, F.lit("conflicting-evidence"))
        .when(F.col("reduced"), F.lit("unknown")).when(F.col("grants") == 0, F.lit("missing-evidence")).when(F.col("clash"), F.lit("conflicting-evidence")).when(F.col("cross"), F.lit("needs-owner-review"))
        .when(F.col("after"), F.lit("needs-owner-review")).when(F.col("no_context"), F.lit("needs-owner-review")).when(F.col("thin"), F.lit("unknown")).otherwise(F.lit("present-in-scripts"))
    )
    return agg.select("operation_id", "capability", "grants", "revokes", status.alias("status"))


# ---- further joins


def align_two_indexes(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """One client index against one server index, where only the server's ANY stands for all methods.

    Both sides have id, path_key, method, parameters (array), file_path, start_line. Matched rows note where parameters are
    named differently; the rest of either side is told as unmatched.
    """
    s = servers.select(F.col("id").alias("server_id"), "path_key", F.col("method").alias("server_method"), F.col("parameters").alias("server_parameters"), F.col("file_path").alias("sf"), F.col("start_line").alias("sl"), F.explode(R.expand_keys(F.col("path_key"))).alias("k"))
    c = clients.select(F.col("id").alias("client_id"), F.col("path_key").alias("k"), "method", "parameters")
    fits = R.methods_compatible_two_index(F.col("method"), F.col("server_method"))
    best = s.groupBy("k", "server_method").agg(F.min(F.struct("sf", "sl", "server_id", "server_parameters")).alias("m"))
    found = c.join(best, "k").where(fits).groupBy("client_id", "k", "parameters").agg(F.min("m").alias("m"))
    note = F.when(F.array_sort("parameters") != F.array_sort("m.server_parameters"), F.lit("parameter names differ"))
    out = found.select(F.lit("Matched").alias("classification"), "client_id", F.col("m.server_id").alias("server_id"), note.alias("note"))
    none = F.lit(None).cast("string")
    lonely = c.join(found.select("client_id"), "client_id", "left_anti").select(F.lit("ClientCallNoServerEndpoint").alias("classification"), "client_id", none.alias("server_id"), none.alias("note"))
    used = s.join(c.select("k", "method").distinct(), "k").where(fits).select("server_id").distinct()
    idle = servers.select(F.col("id").alias("server_id")).join(used, "server_id", "left_anti").select(F.lit("ServerEndpointNoClientMatch").alias("classification"), none.alias("client_id"), "server_id", none.alias("note"))
    return out.unionByName(lonely).unionByName(idle)


def enrich(rows: DataFrame, evidence: DataFrame, ids: str, id_: str, take: list[str]) -> DataFrame:
    """Rows with the evidence that a ';'-joined list of ids names: one row for each id that is known."""
    return rows.withColumn(id_, F.explode(F.filter(F.transform(F.split(ids, ";"), lambda p: F.trim(p)), lambda x: x != ""))).join(evidence.select(id_, *take), id_)


def selected_only(rows: DataFrame, paths: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys the selected paths hold."""
    return rows.join(paths.select(*on).distinct(), on, "left_semi")


def context_changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, same): whether a key's set of values is the same before and after; the sets meet as sorted lists."""
    side = lambda df, n: df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(n))
    return side(before, "b").join(side(after, "a"), key, "full_outer").select(key, F.col("b").eqNullSafe(F.col("a")).alias("same"))


def property_bridges(views: DataFrame, models: DataFrame) -> DataFrame:
    """View bindings with the model properties they show: names and model types equal without case, endpoints aligned.

    `views` has view_id, property, model_type, path_key; `models` property_id, property, model_type, path_key (null: any).
    """
    low = lambda df: df.withColumns({"property": F.lower("property"), "model_type": F.lower(T.member_name(F.col("model_type")))})
    v, m = low(views), low(models).withColumnRenamed("path_key", "m_path")
    return v.join(m, ["property", "model_type"]).where(F.col("path_key").isNull() | F.col("m_path").isNull() | (F.col("path_key") == F.col("m_path"))).select("view_id", "property_id", "property", "model_type")


def select_surfaces(surfaces: DataFrame, kind: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Surfaces by kind and name, matched in what names that kind, and the names that several of them share."""
    keys = {"sql-query": ("table_names", "shape_hash"), "package-config": ("package_name", "config_key"), "http-client": ("path_key",), "http-route": ("path_key",)}.get(kind, ())
    out = surfaces.where(F.col("surface_kind") == kind)
    if name is not None:
        hit = T.contains_ci(F.col("display_name"), name)
        for k in keys:
            hit = hit | (F.lower(F.col(k)) == name.lower())
        out = out.where(F.coalesce(hit, F.lit(False)))
    return out, out.groupBy("display_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def data_descriptors(facts: DataFrame) -> DataFrame:
    """Descriptors of data models from metadata facts with `props`: a safe label, an identity that is hashed, and how many share it."""
    p = F.col("props")
    label = T.first_value(p, "entityName", "tableName", "className", "name")
    safe = label.rlike(r"^[A-Za-z_][A-Za-z0-9_. ]{0,99}$") & ~label.rlike(r"(?i)password|secret|token|://")
    identity = F.concat_ws("|", F.coalesce(T.first_value(p, "metadataFormat"), F.lit("")), F.coalesce(T.first_value(p, "modelKind"), F.lit("")), F.coalesce(label, F.lit("")))
    rows = facts.where(label.isNotNull()).select("fact_id", F.when(safe, label).otherwise(F.concat(F.lit("hash:"), T.hash_prefix(label, 16))).alias("display_name"), T.hash_prefix(identity, 32).alias("model_key"), F.when(~safe, F.lit("unsafe-label")).alias("redaction"))
    counts = rows.groupBy("model_key").agg(F.count(F.lit(1)).alias("n_same"))
    return rows.join(counts, "model_key")
