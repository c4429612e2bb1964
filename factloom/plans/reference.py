"""Queries over whole evidence tables, one for each operator family, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import routes as R
from ..functions import sqltext as Q
from ..functions import text as T
from ..operators import diff as D
from ..operators import evidence as E
from ..operators import extract as X
from ..operators import graph as G
from ..operators import match as M
from ..operators import rollup as A
from ..schema import TIERS, tier_rank
from ..tables import BROADCAST_ROWS, cut, ensure_checkpoint_dir, latest, row_bound, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Current rows of the stacked tables.
LF = "lf as (select distinct on (scan_id, fact_id) * from facts order by scan_id, fact_id, ingested_at desc)"
CF = "cf as (select distinct on (combined_fact_id) * from combined_facts order by combined_fact_id, ingested_at desc)"
LM = "lm as (select distinct on (scan_id) *, cast(scanned_at as timestamptz) t from scan_manifest order by scan_id, ingested_at desc)"
CS = "cs as (select distinct on (combined_symbol_id) * from combined_symbols order by combined_symbol_id, ingested_at desc)"
TIER = "case {0} when 'Tier1Semantic' then 1 when 'Tier2Structural' then 2 when 'Tier3SyntaxOrTextual' then 3 else 4 end"
TIER_NAME = "case {0} when 1 then 'Tier1Semantic' when 2 then 'Tier2Structural' when 3 then 'Tier3SyntaxOrTextual' else 'Tier4Unknown' end"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _facts(s: SparkSession, d: str, *cols: str) -> DataFrame:
    return E.current_facts(table(s, d, "facts"), list(cols) or None)


def _combined(s: SparkSession, d: str, *cols: str) -> DataFrame:
    return E.current_combined(table(s, d, "combined_facts"), list(cols))


def _symbols(s: SparkSession, d: str) -> DataFrame:
    return latest(table(s, d, "combined_symbols"), ["combined_symbol_id"], "ingested_at", ["source_index_id", "symbol_kind", "display_name", "language", "containing_combined_symbol_id"])


def _n() -> F.Column:
    return F.count(F.lit(1)).alias("n")


# ---- scans, sources, combining


@query(f"with {LM}, r as (select repo, scan_root_relative_path, max({{'t': t, 's': scan_id}}) m from lm group by all) select repo, scan_root_relative_path, m.s as scan_id from r")
def s8_latest_scans(s, d):
    return E.latest_scans(table(s, d, "scan_manifest")).select("repo", "scan_root_relative_path", "scan_id")


@query("select 'combined' as kind, count(*) as n from combined_facts union all select 'single', count(*) from facts")
def s7_index_kinds(s, d):
    """Which kind of index a set of tables is, by the tables that are there."""
    from ..sources.readers import index_kind

    rows = {"combined": table(s, d, "combined_facts"), "single": table(s, d, "facts")}
    names = {"combined": ["index_sources", "combined_facts"], "single": ["scan_manifest", "facts"]}
    out = [df.agg(_n()).select(F.lit(index_kind(names[k])).alias("kind"), "n") for k, df in rows.items()]
    return out[0].unionByName(out[1])


@query(f"with {CF} select x.label, cf.fact_type, count(*) as n from cf join index_sources x using (source_index_id) group by all")
def j1_facts_with_sources(s, d):
    sources = table(s, d, "index_sources").select("source_index_id", "label")
    return _combined(s, d, "source_index_id", "fact_type").join(sources, "source_index_id").groupBy("label", "fact_type").agg(_n())


@query("""with f as (select distinct on (scan_id, fact_id) scan_id, fact_id, repo, fact_type from facts order by scan_id, fact_id, ingested_at desc)
select 'src-' || left(sha256(repo), 20) as source_index_id, fact_type, count(*) as n, min('src-' || left(sha256(repo), 20) || ':' || fact_id) as first_id from f group by repo, fact_type""")
def u2_combined_index(s, d):
    """Every repository's facts as sources of one combined index, with ids prefixed by the source's."""
    whole = E.combine_stacked({"facts": _facts(s, d, "repo", "fact_type")}, "repo")["combined_facts"]
    return whole.groupBy("source_index_id", "fact_type").agg(_n(), F.min("combined_fact_id").alias("first_id"))


@query("with c as (select label, count(distinct source_index_id) n from index_sources group by 1) select label, n as n_sources from c where n > 1")
def u7_shared_labels(s, d):
    return E.shared_labels(table(s, d, "index_sources"), "label", "source_index_id")


# ---- projections


@query(f"""with {LF} select scan_id, fact_id, case fact_type when 'CallEdge' then 'calls' else 'creates' end as edge_kind, source_symbol, target_symbol
from lf where fact_type in ('CallEdge', 'ObjectCreated') and (source_symbol is not null or target_symbol is not null)""")
def d1_typed_edges(s, d):
    return E.typed_edges(_facts(s, d, "fact_type", "source_symbol", "target_symbol")).select("scan_id", "fact_id", "edge_kind", "source_symbol", "target_symbol")


@query(f"""with {LF}, r as (select scan_id, fact_id, 'source' as r, source_symbol s from lf union select scan_id, fact_id, 'target', target_symbol from lf
union select scan_id, fact_id, 'contract', contract_element from lf), o as (select scan_id, fact_id, lower(role) r, symbol_id s from symbol_occurrences)
select r as role, count(*) as n from (select * from r where s is not null and trim(s) <> '' union select * from o) group by 1""")
def d2_symbol_roles(s, d):
    facts = _facts(s, d, "source_symbol", "target_symbol", "contract_element")
    return E.symbol_roles(facts, table(s, d, "symbol_occurrences")).groupBy("role").agg(_n())


_VALUE = "coalesce(nullif(trim(json_extract_string(properties_json, '$.packageName')), ''), nullif(trim(json_extract_string(properties_json, '$.name')), ''), nullif(trim(json_extract_string(properties_json, '$.key')), ''))"


@query(f"with {LF} select fact_type, count({_VALUE}) as n_named, count(distinct {_VALUE}) as n_names from lf group by 1")
def pr1_first_values(s, d):
    v = T.first_value(T.properties(F.col("properties_json")), "packageName", "name", "key")
    return _facts(s, d, "fact_type", "properties_json").withColumn("v", v).groupBy("fact_type").agg(F.count("v").alias("n_named"), F.countDistinct("v").alias("n_names"))


_KIND = "case when fact_type = 'HttpCallDetected' then 'http-client' when fact_type = 'AspNetRouteDeclared' then 'http-route' when fact_type = 'SqlTextUsed' then 'sql-query' when fact_type in ('PackageReferenced', 'ConfigKeyDeclared', 'ConnectionStringDeclared') then 'package-config' end"


@query(f"with {LF} select repo, {_KIND} as surface_kind, count(*) as n from lf where {_KIND} is not null group by all")
def pr2_surface_kinds(s, d):
    facts = E.with_properties(_facts(s, d, "repo", "fact_type", "properties_json"))
    return facts.withColumn("surface_kind", E.surface_kind(F.col("fact_type"), F.col("props"))).where(F.col("surface_kind").isNotNull()).groupBy("repo", "surface_kind").agg(_n())


@query(f"""with {CF} select combined_fact_id, json_extract_string(properties_json, '$.packageName') as display_name, json_extract_string(properties_json, '$.version') as package_version
from cf where fact_type = 'PackageReferenced'""")
def pr3_package_surfaces(s, d):
    facts = E.with_properties(_combined(s, d, "fact_type", "file_path", "properties_json").withColumn("fact_id", F.col("combined_fact_id")))
    return E.surfaces(facts.where(F.col("fact_type") == "PackageReferenced")).select("combined_fact_id", "display_name", "package_version")


@query()
def pr3_surfaces(s, d):
    """Every surface of the combined index, wide."""
    facts = E.with_properties(_combined(s, d, "source_index_id", "fact_type", "rule_id", "evidence_tier", "file_path", "start_line", "properties_json").withColumn("fact_id", F.col("combined_fact_id")))
    return E.surfaces(facts).select("combined_fact_id", "source_index_id", "surface_kind", "display_name", "http_method", "path_key", "table_names", "shape_hash", "package_name", "package_version", "config_key", "evidence_tier", "safe_path", "start_line")


@query(f"""with {CF}, x as (select *, json_extract_string(properties_json, '$.url') u from cf where fact_type = 'HttpCallDetected')
select combined_fact_id, source_index_id, 'http-client' as surface_kind, {{key}} as display_name, {{key}} as path_key, upper(json_extract_string(properties_json, '$.httpMethod')) as http_method, evidence_tier, start_line from x
union all select combined_fact_id, source_index_id, 'package-config', json_extract_string(properties_json, '$.key'), null, null, evidence_tier, start_line from cf where fact_type in ('ConfigKeyDeclared', 'ConnectionStringDeclared')""".replace("{key}", "lower(regexp_replace('/' || trim(regexp_replace(regexp_replace(u, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/'), '\\{[^}]*\\}', '{}', 'g'))"))
def pr3_client_and_setting_surfaces(s, d):
    """Surfaces of HTTP clients and of settings, with what names them."""
    facts = E.with_properties(_combined(s, d, "source_index_id", "fact_type", "rule_id", "evidence_tier", "file_path", "start_line", "properties_json").withColumn("fact_id", F.col("combined_fact_id")))
    rows = E.surfaces(facts.where(F.col("fact_type").isin("HttpCallDetected", "ConfigKeyDeclared", "ConnectionStringDeclared")))
    return rows.select("combined_fact_id", "source_index_id", "surface_kind", "display_name", "path_key", "http_method", "evidence_tier", "start_line")


_DEST = "trim(coalesce(source_symbol, ''))"


@query(f"""with {LF}, x as (select source_symbol, case when {_DEST} = '' then 'unknown' when regexp_matches({_DEST}, '[*#]|(^|[./])>$') then 'dynamic'
when regexp_matches({_DEST}, '\\$\\{{|\\$\\(|\\{{[^}}]*\\}}|%[^%]+%|\\+|\\(\\)|<[^>]*>') then 'dynamic'
when regexp_matches({_DEST}, '://|@|(?i)password|secret|token|accountkey|sharedaccess|\\\\|;') or not regexp_matches({_DEST}, '^[A-Za-z0-9][A-Za-z0-9._:/-]{{0,199}}$') then 'hashed' else 'static' end status from lf)
select status, count(*) as n from x group by 1""")
def pr5_destinations(s, d):
    """How the names that facts hold could serve as message destinations."""
    return _facts(s, d, "source_symbol").groupBy(T.destination_identity(F.col("source_symbol"))["status"].alias("status")).agg(_n())


@query("""select occurrence_kind, lower(replace(replace(trim(occurrence_kind), '_', '-'), ' ', '-')) as edge_kind, count(*) as n from symbol_occurrences group by all""")
def pr6_edge_kinds(s, d):
    return table(s, d, "symbol_occurrences").groupBy("occurrence_kind", T.edge_kind(F.col("occurrence_kind")).alias("edge_kind")).agg(_n())


@query("select regexp_replace(rule_id, '\\.v\\d+$', '') as rule_family, count(*) as n, count(distinct rule_id) as n_rules from facts group by 1")
def pr7_rule_families(s, d):
    return table(s, d, "facts").groupBy(T.rule_family(F.col("rule_id")).alias("rule_family")).agg(_n(), F.countDistinct("rule_id").alias("n_rules"))


@query("""with x as (select distinct target_symbol t from facts where target_symbol is not null) select t as name, lower(regexp_extract(t, '([^.]*)$', 1)) as member,
nullif(lower(regexp_extract(t, '([^.]*)\\.[^.]*$', 1)), '') as type from x where regexp_matches(t, '^[^ ()]+$') and regexp_matches(regexp_extract(t, '([^.]*)$', 1), '^\\p{L}')""")
def pr8_symbol_aliases(s, d):
    names = table(s, d, "facts").select(F.col("target_symbol").alias("name")).where(F.col("name").isNotNull()).distinct().withColumn("a", T.symbol_alias(F.col("name")))
    return names.where(F.col("a").isNotNull()).select("name", "a.member", "a.type")


@query(f"with {CF} select combined_fact_id, upper(json_extract_string(properties_json, '$.httpMethod')) in ('GET', 'ANY') as fits from cf where fact_type = 'AspNetRouteDeclared'")
def pr10_method_compatibility(s, d):
    """Routes that a GET call could reach."""
    p = T.properties(F.col("properties_json"))
    got = R.methods(T.first_value(p, "httpMethod"))
    return _combined(s, d, "fact_type", "properties_json").where(F.col("fact_type") == "AspNetRouteDeclared").select("combined_fact_id", R.methods_compatible(F.array(F.lit("GET")), got).alias("fits"))


@query("select symbol_kind, count(*) as n from symbols where contains(lower(display_name), 'order') or contains(lower(display_name), 'ship') group by 1")
def pr11_contains_match(s, d):
    name = F.col("display_name")
    return table(s, d, "symbols").where(T.contains_ci(name, "order") | T.contains_ci(name, "ship")).groupBy("symbol_kind").agg(_n())


@query(f"with {LF} select file_path, case when trim(coalesce(file_path, '')) = '' then 'n/a' else replace(file_path, '\\', '/') end as safe_path, count(*) as n from lf group by all")
def pr16_safe_paths(s, d):
    return _facts(s, d, "file_path").groupBy("file_path", T.safe_path(F.col("file_path")).alias("safe_path")).agg(_n())


@query(f"with {LF}, r as (select repo, max({TIER.format('evidence_tier')}) w, min({TIER.format('evidence_tier')}) b from lf group by 1) select repo, {TIER_NAME.format('w')} as weakest_tier, {TIER_NAME.format('b')} as strongest_tier from r")
def pr17_tiers(s, d):
    return _facts(s, d, "repo", "evidence_tier").groupBy("repo").agg(A.weakest_tier(F.col("evidence_tier")).alias("weakest_tier"), A.strongest_tier(F.col("evidence_tier")).alias("strongest_tier"))


# ---- joins


@query("""with o as (select distinct on (combined_occurrence_id) * from combined_symbol_occurrences order by combined_occurrence_id, ingested_at desc),
sy as (select distinct on (source_index_id, combined_symbol_id) * from combined_symbols order by source_index_id, combined_symbol_id, ingested_at desc)
select coalesce(sy.display_name, o.combined_symbol_id) as name, count(*) as n from o left join sy on o.source_index_id = sy.source_index_id and o.combined_symbol_id = sy.combined_symbol_id group by 1""")
def j2_named_occurrences(s, d):
    o = latest(table(s, d, "combined_symbol_occurrences"), ["combined_occurrence_id"], "ingested_at", ["source_index_id", "combined_symbol_id"])
    names = latest(table(s, d, "combined_symbols"), ["source_index_id", "combined_symbol_id"], "ingested_at", ["display_name"])
    return o.join(names, ["source_index_id", "combined_symbol_id"], "left").groupBy(F.coalesce("display_name", "combined_symbol_id").alias("name")).agg(_n())


_KEY = "lower(regexp_replace('/' || trim(regexp_replace({0}, '^https?://[^/]*', ''), '/'), '\\{{[^}}]*\\}}', '{{}}', 'g'))"


def _endpoints(s, d) -> tuple[DataFrame, DataFrame]:
    p = F.col("props")
    facts = E.with_properties(_combined(s, d, "source_index_id", "fact_type", "file_path", "start_line", "properties_json"))
    base = facts.select(F.col("combined_fact_id").alias("id"), F.col("source_index_id").alias("source_id"), "fact_type", "file_path", "start_line", R.methods(T.first_value(p, "httpMethod")).alias("methods"), T.first_value(p, "url").alias("url"), T.first_value(p, "routes").alias("routes"))
    clients = base.where(F.col("fact_type") == "HttpCallDetected").withColumns({"path_key": R.normalize(F.col("url"))["key"], "is_dynamic": F.lit(False)})
    servers = base.where(F.col("fact_type") == "AspNetRouteDeclared").withColumn("route", F.explode(F.split("routes", ","))).withColumns({"path_key": R.normalize(F.col("route"))["key"], "id": F.concat_ws("#", "id", "route")})
    return clients, servers


_ENDS = f"""{CF}, c as (select combined_fact_id id, upper(json_extract_string(properties_json, '$.httpMethod')) m, {_KEY.format("json_extract_string(properties_json, '$.url')")} k, json_extract_string(properties_json, '$.url') r from cf where fact_type = 'HttpCallDetected'),
v as (select combined_fact_id, source_index_id src, file_path, start_line, upper(json_extract_string(properties_json, '$.httpMethod')) m, unnest(string_split(json_extract_string(properties_json, '$.routes'), ',')) r from cf where fact_type = 'AspNetRouteDeclared'),
w as (select combined_fact_id || '#' || r id, src, m, {_KEY.format('r')} k, r, file_path, start_line from v)"""


@query(f"""with {_ENDS},
j as (select c.id, w.src, w.id sid, (w.m = 'ANY' or c.m = 'ANY' or w.m = c.m) fit from c join w using (k)),
a as (select id, src, count_if(fit) n from j group by all),
seen as (select distinct j.sid from j join a on j.id = a.id and j.src = a.src where a.n = 0 or j.fit)
select classification, count(*) as n from (
 select case when n = 1 then 'MatchedEndpoint' when n > 1 then 'AmbiguousMatch' else 'MethodMismatch' end as classification from a
 union all select 'ClientCallNoServerEndpoint' from c where id not in (select id from a)
 union all select 'ServerEndpointNoClientMatch' from w where id not in (select sid from seen)) group by 1""")
def j3_endpoint_alignment(s, d):
    return M.align_endpoints(*_endpoints(s, d)).groupBy("classification").agg(_n())


@query("""with e as (select user_id, event_id, event_type, row_number() over (partition by user_id, event_type order by event_id) r from events where event_type in ('purchase', 'click')),
n as (select user_id, count(*) n_c from e where event_type = 'click' group by 1)
select p.user_id::varchar as key, p.event_id::varchar as publisher, c.event_id::varchar as consumer from (select *, row_number() over (partition by user_id order by event_id::varchar) r2 from e where event_type = 'purchase') p
join n using (user_id) join (select *, row_number() over (partition by user_id order by event_id::varchar) r2 from e where event_type = 'click') c using (user_id) where (p.r2 - 1) * n.n_c + c.r2 <= 100""")
def j5_message_pairs(s, d):
    """Purchases as publishers and clicks as consumers of one user's destination, at most 100 pairs a user."""
    e = table(s, d, "events").where(F.col("event_type").isin("purchase", "click"))
    rows = e.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("key"), F.lit("static").alias("status"), F.lit(TIERS[1]).alias("tier"), F.lit("events").alias("label"), F.when(F.col("event_type") == "purchase", F.lit("publish")).otherwise(F.lit("consume")).alias("direction"))
    return M.pair_messages(rows, total=ALL)[0].select("key", "publisher", "consumer")


@query("""with e as (select * from events where event_type in ('purchase', 'error')), v as (select user_id, ts, event_id from events where event_type = 'view'),
j as (select e.event_id, v.event_id vid, row_number() over (partition by e.event_id order by v.ts desc, v.event_id desc) r from e join v on e.user_id = v.user_id and v.ts <= e.ts)
select e.event_id, j.vid as asof_event_id from e left join j on e.event_id = j.event_id and j.r = 1""")
def j6_asof_view(s, d):
    """Each purchase or error with the user's latest view at or before it."""
    e = table(s, d, "events")
    left = e.where(F.col("event_type").isin("purchase", "error")).select("event_id", "user_id", "ts")
    return M.asof_backward(left, e.where(F.col("event_type") == "view"), ["user_id"], "ts", "ts", ["event_id"], "event_id").select("event_id", "asof_event_id")


@query()
def j6_alias_chains(s, d):
    """Symbols that calls name, followed through up to three assignments of the same scan, each the latest before the call."""
    f = _facts(s, d, "fact_type", "source_symbol", "target_symbol", "start_line").where(F.col("source_symbol").isNotNull() & F.col("target_symbol").isNotNull())
    container = lambda c: T.containing_type(F.col(c))
    flows = f.where(F.col("fact_type") == "CallEdge").select(F.concat_ws(":", "scan_id", "fact_id").alias("flow_id"), "scan_id", container("source_symbol").alias("container"), T.member_name(F.col("source_symbol")).alias("symbol"), F.col("start_line").alias("line"))
    aliases = f.where(F.col("fact_type") == "ObjectCreated").select("scan_id", container("source_symbol").alias("container"), T.member_name(F.col("source_symbol")).alias("alias"), T.member_name(F.col("target_symbol")).alias("origin"), F.col("start_line").alias("line"), F.col("fact_id").alias("alias_id"))
    return M.resolve_aliases(flows, aliases).groupBy("n_hops").agg(_n())


@query("""with x as (select distinct scan_id, symbol_kind k, display_name v from symbols), g as (select scan_id, k, min(v) a, max(v) b from x where v is not null group by all)
select scan_id, k as symbol_kind, a as display_name from g where a = b""")
def j6b_unique_assignment(s, d):
    return M.unique_assignment(table(s, d, "symbols"), ["scan_id", "symbol_kind"], "display_name")


_ALIAS = "(select distinct scan_id sid, target_symbol id, lower(regexp_extract(target_symbol, '([^.]*)$', 1)) m, nullif(lower(regexp_extract(target_symbol, '([^.]*)\\.[^.]*$', 1)), '') t from facts where target_symbol is not null)"


@query(f"""with b as {_ALIAS}, q as (select sid, m, min(id) id, count(distinct t) n from b where t is not null group by all)
select b.sid as source_id, b.id as from_id, q.id as to_id, 'bare-to-qualified' as kind from b join q using (sid, m) where b.t is null and q.n = 1""")
def j8_reconciled_symbols(s, d):
    rows = table(s, d, "facts").select(F.col("scan_id").alias("source_id"), F.col("target_symbol").alias("id"), F.col("target_symbol").alias("display_name")).where(F.col("id").isNotNull()).distinct()
    return M.reconcile(rows)


@query(f"""with {CF}, x as (select combined_fact_id, {_KIND} k, source_symbol, target_symbol from cf) select k as surface_kind, count(*) as n_unlinked from x
where k is not null and source_symbol is null and target_symbol is null group by 1""")
def j9_unlinked_surfaces(s, d):
    """Surfaces that no symbol is attached to."""
    facts = E.with_properties(_combined(s, d, "fact_type", "source_symbol", "target_symbol", "properties_json")).withColumn("surface_kind", E.surface_kind(F.col("fact_type"), F.col("props")))
    linked = facts.select("combined_fact_id", F.explode(F.array("source_symbol", "target_symbol")).alias("symbol")).where(F.col("symbol").isNotNull())
    return facts.where(F.col("surface_kind").isNotNull()).join(linked, "combined_fact_id", "left_anti").groupBy("surface_kind").agg(F.count(F.lit(1)).alias("n_unlinked"))


@query(f"""with {CS}, r as (select distinct source_index_id, containing_combined_symbol_id p, combined_symbol_id c from cs where containing_combined_symbol_id is not null and containing_combined_symbol_id <> ''),
w as (select *, row_number() over (partition by source_index_id, p order by c) rn from r) select source_index_id as source_id, p as from_symbol, c as to_symbol from w where rn <= 2""")
def j10_dispatch_candidates(s, d):
    """Members taken as implementations of what contains them, two for each at most."""
    rel = _symbols(s, d).where(~(F.coalesce("containing_combined_symbol_id", F.lit("")) == "")).select(F.col("source_index_id").alias("source_id"), F.col("combined_symbol_id").alias("from_symbol"), F.col("containing_combined_symbol_id").alias("to_symbol"), F.lit("implements").alias("kind"))
    return M.dispatch_candidates(rel, fan_out=2)[0].select("source_id", "from_symbol", "to_symbol")


_CHANGES = [("c1", "Kind"), ("c2", "LoadCarrierById"), ("c3", "Flag"), ("c4", "ScheduleClinic"), ("c5", "LedgerStore.CloseBatch")]


@query(f"""with {CF}, ch as (select * from (values {", ".join(repr(x) for x in _CHANGES)}) v(change_id, element)),
c as (select change_id, lower(element) e, lower(regexp_extract(element, '([^.]*)$', 1)) m, nullif(lower(regexp_extract(element, '([^.]*)\\.[^.]*$', 1)), '') t from ch),
n as (select combined_fact_id, unnest([source_symbol, target_symbol, contract_element]) s from cf),
k as (select combined_fact_id, lower(s) e, lower(regexp_extract(s, '([^.]*)$', 1)) m, nullif(lower(regexp_extract(s, '([^.]*)\\.[^.]*$', 1)), '') t from n where s is not null),
j as (select change_id, combined_fact_id, max(case when k.e = c.e then 6 when c.t is not null and k.t = c.t and k.m = c.m then 4 when k.m = c.m then 3 when c.t is null and k.t = c.m then 2 end) r
from c join k on k.e = c.e or k.m = c.m or (c.t is null and k.t = c.m) group by all)
select change_id, combined_fact_id as fact_id, case r when 6 then 'Exact' when 4 then 'TypeAndMember' when 3 then 'Member' else 'Type' end as strength from j where r is not null""")
def j12_delta_matches(s, d):
    facts = _combined(s, d, "source_symbol", "target_symbol", "contract_element").withColumnRenamed("combined_fact_id", "fact_id").withColumns({"path_key": F.lit(None).cast("string"), "methods": F.array().cast("array<string>")})
    return M.delta_matches(s.createDataFrame(_CHANGES, "change_id string, element string"), facts).select("change_id", "fact_id", "strength")


_PACKAGES = [("p1", "tamsin.address", None, "1.0.0", "2.0.0"), ("p2", "OSTREY.Loom", None, "1.0.0", "2.0.0"), ("p3", "Vantel.Quota", None, "1.0.0", "2.0.0")]


@query(f"""with {LF}, c as (select * from (values ('p1', 'tamsin.address'), ('p2', 'ostrey.loom'), ('p3', 'vantel.quota')) v(change_id, name))
select change_id, repo, count(*) as n from lf join c on lower(json_extract_string(properties_json, '$.packageName')) = c.name where fact_type = 'PackageReferenced' group by all""")
def j13_package_impact(s, d):
    p = T.properties(F.col("properties_json"))
    rows = _facts(s, d, "repo", "fact_type", "properties_json").where(F.col("fact_type") == "PackageReferenced").select("repo", T.first_value(p, "packageName").alias("package_name"), T.first_value(p, "ecosystem").alias("ecosystem"))
    changes = s.createDataFrame(_PACKAGES, "change_id string, package_name string, ecosystem string, old_version string, new_version string")
    return M.package_matches(changes, rows).groupBy("change_id", "repo").agg(_n())


@query(f"""with {LM}, r as (select repo, arg_min({{'v': scanner_version, 'l': analysis_level}}, {{'t': t, 's': scan_id}}) b, arg_max({{'v': scanner_version, 'l': analysis_level}}, {{'t': t, 's': scan_id}}) a from lm group by 1)
select repo as label, case when b.v <> a.v or b.l <> a.l then 'identity-conflict' else 'paired' end as status,
array_to_string(list_filter([case when b.v <> a.v then 'scanner_version' end, case when b.l <> a.l then 'analysis_level' end], lambda x: x is not null), ';') as conflicts from r""")
def j15_source_pairing(s, d):
    m = E.current_manifest(table(s, d, "scan_manifest"))
    cols = ["scanner_version", "analysis_level"]
    pick = F.struct("instant", "scan_id", *cols)
    b, a = (m.groupBy("repo").agg(agg(pick).alias("x")).select("repo", *[F.col(f"x.{c}").alias(c) for c in cols]) for agg in (F.min, F.max))
    return D.pair_sources(b, a, "repo", cols)


# ---- aggregations


@query(f"with {LF} select fact_type, evidence_tier, count(*) as n from lf group by all")
def a1_counts(s, d):
    return A.count_by(_facts(s, d, "fact_type", "evidence_tier"), "fact_type", "evidence_tier")


@query(f"with {LF} select repo, count(*) as n_facts, count_if(snippet_hash is null) as n_without_hash, count_if(fact_type = 'AnalysisGap') as n_gaps from lf group by 1")
def a3_filtered_counts(s, d):
    return _facts(s, d, "repo", "snippet_hash", "fact_type").groupBy("repo").agg(F.count(F.lit(1)).alias("n_facts"), F.count_if(F.col("snippet_hash").isNull()).alias("n_without_hash"), F.count_if(F.col("fact_type") == "AnalysisGap").alias("n_gaps"))


@query(f"with {LF} select repo, rule_id, json_extract_string(properties_json, '$.message') as message, count(*) as n from lf where fact_type = 'AnalysisGap' group by all")
def a4_gap_categories(s, d):
    gaps = _facts(s, d, "repo", "rule_id", "fact_type", "properties_json").where(F.col("fact_type") == "AnalysisGap")
    return gaps.groupBy("repo", "rule_id", T.first_value(T.properties(F.col("properties_json")), "message").alias("message")).agg(_n())


@query(f"with {LF}, x as (select distinct repo, rule_id r from lf) select repo, string_agg(r, ';' order by r) as rule_ids from x group by 1")
def a5_rule_lists(s, d):
    return _facts(s, d, "repo", "rule_id").groupBy("repo").agg(A.joined_set(F.col("rule_id")).alias("rule_ids"))


_PKG = "select *, json_extract_string(properties_json, '$.packageName') p from lf where fact_type = 'PackageReferenced'"


@query(f"""with {LF}, k as ({_PKG}), g as (select p, count(*) n, count(distinct repo) m, max({TIER.format('evidence_tier')}) w, min(fact_id) i from k where p is not null group by 1 having count(*) > 1)
select p as package_name, n as n_rows, m as n_sources, {TIER_NAME.format('w')} as weakest_tier, (select string_agg(r, ';' order by r) from (select distinct repo r from k where k.p = g.p)) as sources, i as first_id from g""")
def a6_shared_packages(s, d):
    f = _facts(s, d, "repo", "fact_type", "evidence_tier", "properties_json").where(F.col("fact_type") == "PackageReferenced")
    return A.shared_groups(f.withColumn("package_name", T.first_value(T.properties(F.col("properties_json")), "packageName")), "package_name", "repo", "evidence_tier", "fact_id")


@query("select scan_id, fact_id, count(*) as n from facts group by all having count(*) > 1")
def a8_duplicate_ids(s, d):
    return A.duplicates(table(s, d, "facts"), "scan_id", "fact_id")


_RANK = "case when fact_type = 'AnalysisGap' then 1 when evidence_tier in ('Tier1Semantic', 'Tier2Structural') then 3 when evidence_tier = 'Tier3SyntaxOrTextual' then 4 end"


@query(f"""with {LF}, r as (select repo, min({_RANK}) m from lf group by 1) select repo, case m when 1 then 'UnknownAnalysisGap' when 3 then 'Actionable' when 4 then 'NeedsReview' else 'None' end as classification from r""")
def a10_rollup(s, d):
    """Each repository's overall class: a gap outranks findings."""
    cls = F.when(F.col("fact_type") == "AnalysisGap", F.lit("UnknownAnalysisGap")).when(tier_rank(F.col("evidence_tier")) <= 2, F.lit("Actionable")).when(F.col("evidence_tier") == TIERS[2], F.lit("NeedsReview"))
    return _facts(s, d, "repo", "fact_type", "evidence_tier").groupBy("repo").agg(A.precedence(cls, A.PORTFOLIO, "None").alias("classification"))


@query(f"with {LF} select target_symbol as name, count(*) as n_facts, count(distinct file_path) as n_files from lf where target_symbol is not null group by 1 having count(*) > 10")
def a11_fan_out_warnings(s, d):
    f = _facts(s, d, "target_symbol", "file_path").where(F.col("target_symbol").isNotNull())
    return f.groupBy(F.col("target_symbol").alias("name")).agg(F.count(F.lit(1)).alias("n_facts"), F.countDistinct("file_path").alias("n_files")).where(F.col("n_facts") > 10)


@query(f"""with {LM}, r as (select repo, scan_root_relative_path, arg_max(analysis_level = 'Level1SemanticAnalysis' and build_status = 'Succeeded' and regexp_matches(commit_sha, '^[0-9a-fA-F]{{40}}$'), {{'t': t, 's': scan_id}}) f from lm group by all)
select repo, bool_and(f) as full, count(*) as n_roots from r group by 1""")
def a12_coverage(s, d):
    """Whether all of a repository's newest scans are full."""
    x = E.latest_scans(table(s, d, "scan_manifest"))
    return x.groupBy("repo").agg(F.bool_and(E.full_coverage(F.col("analysis_level"), F.col("build_status"), F.col("commit_sha"))).alias("full"), F.count(F.lit(1)).alias("n_roots"))


@query("""with x as (select *, case when lag(event_type) over w is distinct from event_type or row_number() over w = 1 then 1 else 0 end nw from events window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(nw) over (partition by user_id order by ts, event_id rows unbounded preceding) island from x)
select user_id, island::bigint as island, min(event_type) as event_type, count(*) as n_rows from i group by user_id, island""")
def a13_islands(s, d):
    return A.islands(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "island", "event_type", "n_rows")


@query(f"with {LF}, r as (select *, row_number() over (partition by rule_id order by file_path, start_line, scan_id, fact_id) rn from lf where fact_type = 'AnalysisGap') select rule_id, scan_id, fact_id from r where rn = 1")
def a14_first_per_code(s, d):
    gaps = _facts(s, d, "rule_id", "fact_type", "file_path", "start_line").where(F.col("fact_type") == "AnalysisGap")
    return gaps.groupBy("rule_id").agg(F.min(F.struct("file_path", "start_line", "scan_id", "fact_id")).alias("m")).select("rule_id", "m.scan_id", "m.fact_id")


@query(f"with {LF} select repo, file_path, count(*) as n, {TIER_NAME.format('max(' + TIER.format('evidence_tier') + ')')} as weakest_tier, min(start_line) as first_line, max(end_line) as last_line from lf group by all")
def a18_touched_files(s, d):
    f = _facts(s, d, "repo", "file_path", "evidence_tier", "start_line", "end_line")
    return f.groupBy("repo", "file_path").agg(_n(), A.weakest_tier(F.col("evidence_tier")).alias("weakest_tier"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


@query(f"""with {LF} select evidence_tier, case when evidence_tier in ('Tier1Semantic', 'Tier2Structural') then 'High' else 'Low' end as severity, count(*) as n from lf group by all""")
def a16_severity(s, d):
    sev = A.severity(F.lit("ProbableStaticImpact"), F.col("evidence_tier"))
    return _facts(s, d, "evidence_tier").groupBy("evidence_tier", sev.alias("severity")).agg(_n())


@query(f"""with {LF}, g as (select json_extract_string(properties_json, '$.message') m, count(*) n, min(fact_id) i from lf where fact_type = 'AnalysisGap' group by 1),
r as (select *, row_number() over (order by i, m) rn from g) select m as message, n from r where rn <= 20""")
def a19_diagnostics(s, d):
    """The first 20 groups of diagnostics by their first fact, with all their counts."""
    gaps = _facts(s, d, "fact_type", "properties_json").where(F.col("fact_type") == "AnalysisGap")
    g = gaps.groupBy(T.first_value(T.properties(F.col("properties_json")), "message").alias("message")).agg(_n(), F.min("fact_id").alias("i"))
    return g.orderBy("i", "message").limit(20).select("message", "n")


@query(f"with {LM}, x as (select repo, unnest(cast(json_extract(manifest_json, '$.knownGaps') as varchar[])) as gap from lm) select repo, gap, count(*) as n from x group by all")
def a21_known_gaps(s, d):
    m = E.current_manifest(table(s, d, "scan_manifest"))
    return m.select("repo", F.explode("manifest.knownGaps").alias("gap")).groupBy("repo", "gap").agg(_n())


# ---- windows, caps, sets


@query("with x as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders) select o_custkey, o_orderkey, rn as rank from x where rn <= 3")
def w3_top_per_group(s, d):
    return M.first_per_key(table(s, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", F.col("rn").cast("bigint").alias("rank"))


@query("select sha256(text) as h, min(doc_id) as doc_id, count(*) as n from documents where text is not null group by 1")
def w2_first_of_group(s, d):
    return table(s, d, "documents").where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), _n())


@query("select 'OrderLimit' as gap, 1000 as kept, count(*) - 1000 as cut from orders having count(*) > 1000")
def w4_truncation_gap(s, d):
    return A.capped(table(s, d, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 1000, "OrderLimit")[1]


@query("""with x as (select o_orderkey, cast(floor(o_totalprice) as bigint) w, coalesce(sum(cast(floor(o_totalprice) as bigint)) over (order by o_orderkey rows between unbounded preceding and 1 preceding), 0) u from orders)
select o_orderkey, greatest(0, least(w, 500000000 - u))::bigint as granted from x""")
def w5_budget(s, d):
    rows = table(s, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("w"))
    return A.with_budget(rows, ["o_orderkey"], "w", 500_000_000).select("o_orderkey", F.col("granted").cast("long").alias("granted"))


@query(f"with {CF} select source_index_id, case fact_type when 'CallEdge' then 'calls' else 'creates' end as edge_kind, count(*) as n from cf where fact_type in ('CallEdge', 'ObjectCreated') and (source_symbol is not null or target_symbol is not null) group by all")
def u1_edge_view(s, d):
    facts = _combined(s, d, "source_index_id", "fact_type", "source_symbol", "target_symbol", "rule_id", "evidence_tier", "file_path", "start_line", "end_line")
    return E.edge_view(facts).groupBy("source_index_id", "edge_kind").agg(_n())


@query("select source_symbol as symbol from combined_facts where source_symbol is not null intersect select target_symbol from combined_facts")
def u4_intersection(s, d):
    f = table(s, d, "combined_facts")
    return f.select(F.col("source_symbol").alias("symbol")).where(F.col("symbol").isNotNull()).intersect(f.select("target_symbol"))


@query("select distinct fact_id from facts where fact_id not in (select original_fact_id from combined_facts where original_fact_id is not null)")
def u5_never_imported(s, d):
    """Facts that no source has imported."""
    imported = table(s, d, "combined_facts").select(F.col("original_fact_id").alias("fact_id")).distinct()
    return table(s, d, "facts").select("fact_id").distinct().join(imported, "fact_id", "left_anti")


@query(f"""with {LM}, f as (select distinct scan_id, rule_id from facts), p as (select scan_id, lag(scan_id) over (partition by repo, scan_root_relative_path order by t, scan_id) b from lm),
a as (select scan_id, list_sort(list(rule_id)) l from f group by 1) select p.scan_id, x.l = y.l as same_rules from p join a x on p.scan_id = x.scan_id join a y on p.b = y.scan_id""")
def u6_set_equality(s, d):
    """Whether consecutive scans rest on the same set of rules."""
    m = E.current_manifest(table(s, d, "scan_manifest"))
    pairs = m.select("scan_id", F.lag("scan_id").over(Window.partitionBy("repo", "scan_root_relative_path").orderBy("instant", "scan_id")).alias("before")).where(F.col("before").isNotNull())
    sets = table(s, d, "facts").groupBy("scan_id").agg(F.array_sort(F.collect_set("rule_id")).alias("l"))
    return pairs.join(sets, "scan_id").join(sets.select(F.col("scan_id").alias("before"), F.col("l").alias("l2")), "before").select("scan_id", (F.col("l") == F.col("l2")).alias("same_rules"))


# ---- graphs: symbols and what contains them

_EDGES = f"""{CS}, e as (select c.combined_symbol_id b, p.combined_symbol_id a, c.symbol_kind k from cs c join cs p on c.containing_combined_symbol_id = p.combined_symbol_id),
roots as (select combined_symbol_id r from cs where combined_symbol_id not in (select b from e))"""


def _graph(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    sy = _symbols(s, d)
    ids = sy.select(F.col("combined_symbol_id").alias("source"))
    edges = sy.select("symbol_kind", F.col("combined_symbol_id").alias("target"), F.col("containing_combined_symbol_id").alias("source")).join(ids, "source", "left_semi")
    tier = F.when(F.col("symbol_kind") == "Method", F.lit(TIERS[1])).when(F.col("symbol_kind") == "Property", F.lit(TIERS[2])).otherwise(F.lit(TIERS[0]))
    edges = edges.select(F.col("target").alias("edge_id"), "source", "target", F.lit("calls").alias("kind"), tier.alias("evidence_tier"))
    roots = sy.select(F.col("combined_symbol_id").alias("node")).join(edges.select(F.col("target").alias("node")), "node", "left_anti")
    methods = sy.where(F.col("symbol_kind") == "Method").select(F.col("combined_symbol_id").alias("node"))
    return edges, roots, methods


ALL = None  # no cap


@query(f"""with recursive {_EDGES}, m as (select combined_symbol_id n from cs where symbol_kind = 'Method'),
p as (select r s, r n, 0 depth, 1 t, false f from roots union all select p.s, e.b, p.depth + 1, greatest(p.t, case e.k when 'Method' then 2 when 'Property' then 3 else 1 end), e.b in (select n from m)
from p join e on p.n = e.a where not p.f and p.depth < 8)
select s as start, n as node, depth, case t when 1 then 'StrongStaticPath' when 2 then 'ProbableStaticPath' else 'NeedsReviewPath' end as classification from p where f""")
def g2_forward_paths(s, d):
    """Every way from a root symbol to the first method below it."""
    edges, roots, methods = _graph(s, d)
    return G.bounded_paths(roots, edges, methods, 8, ALL, ALL)[0].select("start", "node", "depth", "classification")


@query(f"""with recursive {_EDGES}, p as (select combined_symbol_id s, combined_symbol_id n, 0 depth, [combined_symbol_id] path from cs where symbol_kind = 'Method'
union all select p.s, e.a, p.depth + 1, list_append(p.path, e.a) from p join e on p.n = e.b where p.depth < 8 and p.n not in (select r from roots) and not list_contains(p.path, e.a))
select s as start, n as node, depth from p where depth > 0 and n in (select r from roots)""")
def g5_reverse_paths(s, d):
    """Every way from a method up to its root."""
    edges, roots, methods = _graph(s, d)
    return G.bounded_paths(methods, edges, roots, 8, ALL, ALL, reverse=True, on_cycle="silent")[0].select("start", "node", "depth")


@query(f"""with recursive {_EDGES}, p as (select r s, r n, 0 depth from roots union all select p.s, e.b, p.depth + 1 from p join e on p.n = e.a where p.depth < 5)
select s as start, n as node, depth from p where depth > 0 and (depth = 5 or n not in (select a from e))""")
def g7_maximal_paths(s, d):
    edges, roots, _ = _graph(s, d)
    return G.drop_suffixes(G.edge_simple_paths(roots, edges, 5, ALL)).select("start", "node", "depth")


@query(f"""with recursive {_EDGES}, p as (select combined_symbol_id s, combined_symbol_id n, 0 depth, cast([] as varchar[]) path from cs where symbol_kind = 'Method'
union all select p.s, e.a, p.depth + 1, list_append(p.path, e.b) from p join e on p.n = e.b where p.depth < 3 and not list_contains(p.path, e.b))
select s as start, n as node, depth from p where depth > 0 and (depth = 3 or not exists (select 1 from e where e.b = p.n and not list_contains(p.path, e.b)))""")
def g9_incoming_paths(s, d):
    edges, _, methods = _graph(s, d)
    return G.edge_simple_paths(methods, edges, 3, ALL, direction="incoming").select("start", "node", "depth")


@query(f"""with recursive {_EDGES}, p as (select r s, r n, 0 distance from roots union all select p.s, e.b, p.distance + 1 from p join e on p.n = e.a) select s as start, n as node, distance from p""")
def g10_reachable(s, d):
    edges, roots, _ = _graph(s, d)
    return G.reachable(roots, edges)


@query(f"""with recursive {_EDGES}, p as (select r s, r n, 0 distance, null::varchar parent from roots union all select p.s, e.b, p.distance + 1, p.n from p join e on p.n = e.a where p.distance < 10) select s as start, n as node, distance, parent from p""")
def g19_bfs_tree(s, d):
    edges, roots, _ = _graph(s, d)
    return G.bfs_tree(roots, edges).select("start", "node", "distance", "parent")


# ---- diffs

_SNAP = f"""{LM}, b as (select repo, scan_root_relative_path root, arg_min(scan_id, {{'t': t, 's': scan_id}}) b, arg_max(scan_id, {{'t': t, 's': scan_id}}) a from lm group by all),
{LF}, bf as (select b.repo, b.root, lf.* exclude (repo) from lf join b on lf.scan_id = b.b where b.a <> b.b), af as (select b.repo, b.root, lf.* exclude (repo) from lf join b on lf.scan_id = b.a where b.a <> b.b)"""


def _snapshots(s, d) -> tuple[DataFrame, DataFrame]:
    """Facts of each series' first and last scan, with the series, a metadata and an evidence hash."""
    m = E.current_manifest(table(s, d, "scan_manifest"))
    ends = m.groupBy("repo", "scan_root_relative_path").agg(F.min(F.struct("instant", "scan_id")).alias("b"), F.max(F.struct("instant", "scan_id")).alias("a"))
    ends = ends.select(F.concat_ws("|", "repo", "scan_root_relative_path").alias("series"), F.col("b.scan_id").alias("b"), F.col("a.scan_id").alias("a")).where(F.col("a") != F.col("b"))
    facts = _facts(s, d, "fact_type", "evidence_tier", "rule_id", "file_path", "start_line", "end_line", "target_symbol")
    facts = facts.withColumns({"metadata": F.concat_ws("|", "fact_type", F.coalesce("target_symbol", F.lit("-"))), "evidence": F.concat_ws("|", "rule_id", "evidence_tier", "file_path", "start_line", "end_line")})
    return tuple(facts.join(ends.select("series", F.col(side).alias("scan_id")), "scan_id").withColumn("key", F.concat_ws("|", "series", "fact_id")) for side in ("b", "a"))


_CHANGE = """case when x.fact_id is null then 'added' when y.fact_id is null then 'removed' else 'changed' end"""
_FULL = "bf x full join af y on x.repo = y.repo and x.root = y.root and x.fact_id = y.fact_id"
_DIFF = """(x.fact_id is null or y.fact_id is null or x.fact_type <> y.fact_type or x.target_symbol is distinct from y.target_symbol
or (x.rule_id, x.evidence_tier, x.file_path, x.start_line, x.end_line) is distinct from (y.rule_id, y.evidence_tier, y.file_path, y.start_line, y.end_line))"""


@query(f"with {_SNAP} select coalesce(x.repo, y.repo) || '|' || coalesce(x.root, y.root) || '|' || coalesce(x.fact_id, y.fact_id) as key, {_CHANGE} as change from {_FULL} where {_DIFF}")
def o1_keyed_diff(s, d):
    b, a = _snapshots(s, d)
    return D.keyed_diff(b, a, "key", "metadata", "evidence").select("key", "change")


@query(f"""with {_SNAP}, c as (select repo, root, (select analysis_level = 'Level1SemanticAnalysis' and build_status = 'Succeeded' from lm where scan_id = b.b) fb, (select analysis_level = 'Level1SemanticAnalysis' and build_status = 'Succeeded' from lm where scan_id = b.a) fa from b)
select case {_CHANGE} when 'added' then case when c.fb then 'AddedEvidence' else 'AddedWithBeforeGap' end when 'removed' then case when c.fa then 'RemovedEvidence' else 'RemovedWithAfterGap' end else 'ChangedEvidence' end as classification,
count(*) as n from {_FULL} join c on c.repo = coalesce(x.repo, y.repo) and c.root = coalesce(x.root, y.root) where {_DIFF} group by 1""")
def o2_diff_classes(s, d):
    b, a = _snapshots(s, d)
    m = E.current_manifest(table(s, d, "scan_manifest")).select("scan_id", F.coalesce((F.col("analysis_level") == "Level1SemanticAnalysis") & (F.col("build_status") == "Succeeded"), F.lit(False)).alias("full"), F.concat_ws("|", "repo", "scan_root_relative_path").alias("series"), "instant")
    ends = m.groupBy("series").agg(F.min(F.struct("instant", "scan_id", "full")).alias("b"), F.max(F.struct("instant", "scan_id", "full")).alias("a"))
    rows = D.keyed_diff(b, a, "key", "metadata", "evidence", keep=["series"]).withColumn("series", F.coalesce("before_series", "after_series")).join(ends.select("series", F.col("b.full").alias("fb"), F.col("a.full").alias("fa")), "series")
    no = F.lit(False)
    return rows.groupBy(D.classify_combined(F.col("change"), F.col("duplicate"), F.col("needs_review"), no, no, ~F.col("fb"), ~F.col("fa")).alias("classification")).agg(_n())


@query(f"""with {_SNAP}, c as (select repo, root, (select analysis_level = 'Level1SemanticAnalysis' and build_status = 'Succeeded' from lm where scan_id = b.b) fb, (select analysis_level = 'Level1SemanticAnalysis' and build_status = 'Succeeded' from lm where scan_id = b.a) fa from b),
t as (select coalesce(y.evidence_tier, x.evidence_tier) tier, {_CHANGE} change, c.fb, c.fa from {_FULL} join c on c.repo = coalesce(x.repo, y.repo) and c.root = coalesce(x.root, y.root) where {_DIFF})
select case when (change = 'added' and not coalesce(fb, false)) or (change = 'removed' and not coalesce(fa, false)) or tier = 'Tier3SyntaxOrTextual' then 'NeedsReviewImpact' when tier = 'Tier4Unknown' then 'UnknownAnalysisGap' else 'ProbableStaticImpact' end as impact, count(*) as n from t group by 1""")
def o8_change_impact(s, d):
    """Impact of each change: what a gap on the other side may explain is for review."""
    b, a = _snapshots(s, d)
    m = E.current_manifest(table(s, d, "scan_manifest")).select("scan_id", F.coalesce((F.col("analysis_level") == "Level1SemanticAnalysis") & (F.col("build_status") == "Succeeded"), F.lit(False)).alias("full"), F.concat_ws("|", "repo", "scan_root_relative_path").alias("series"), "instant")
    ends = m.groupBy("series").agg(F.min(F.struct("instant", "scan_id", "full")).alias("b"), F.max(F.struct("instant", "scan_id", "full")).alias("a")).select("series", F.col("b.full").alias("fb"), F.col("a.full").alias("fa"))
    rows = D.keyed_diff(b, a, "key", "metadata", "evidence", keep=["evidence_tier", "series"]).withColumn("series", F.coalesce("before_series", "after_series")).join(ends, "series")
    no = F.lit(False)
    cls = D.classify_combined(F.col("change"), F.col("duplicate"), F.col("needs_review"), no, no, ~F.col("fb"), ~F.col("fa"))
    return rows.groupBy(D.impact_of(cls, F.coalesce("after_evidence_tier", "before_evidence_tier")).alias("impact")).agg(_n())


@query(f"""with {_SNAP} select {_CHANGE} as change, count(*) as n from (select * from bf where fact_type in ('TypeDeclared', 'MethodDeclared', 'PropertyDeclared')) x
full join (select * from af where fact_type in ('TypeDeclared', 'MethodDeclared', 'PropertyDeclared')) y on x.repo = y.repo and x.root = y.root and x.fact_id = y.fact_id
where x.fact_id is null or y.fact_id is null or x.fact_type <> y.fact_type or x.target_symbol is distinct from y.target_symbol group by 1""")
def o7_contract_diff(s, d):
    """Declarations only, by metadata alone: neither evidence nor multiplicity counts."""
    b, a = (x.where(F.col("fact_type").isin("TypeDeclared", "MethodDeclared", "PropertyDeclared")) for x in _snapshots(s, d))
    return D.keyed_diff(b, a, "key", "metadata", multiplicity=False).groupBy("change").agg(_n())


@query()
def o10_contract_reduction(s, d):
    """Each change's class from the facts that match it."""
    facts = _combined(s, d, "source_symbol", "target_symbol", "contract_element", "fact_type", "evidence_tier", "file_path").withColumnRenamed("combined_fact_id", "fact_id").withColumns({"path_key": F.lit(None).cast("string"), "methods": F.array().cast("array<string>")})
    changes = s.createDataFrame(_CHANGES, "change_id string, element string")
    m = M.delta_matches(changes, facts).join(facts.select("fact_id", "fact_type", "evidence_tier", "file_path"), "fact_id")
    one = F.col("evidence_tier") == TIERS[0]
    cls = A.reduction_class(F.bool_or((F.col("fact_type") == "AnalysisGap") | (F.col("evidence_tier") == TIERS[3])), F.bool_or(F.col("strength").isin("Type", "Textual")), F.bool_or(one & F.col("fact_type").isin("PropertyAccessed", "MethodInvoked", "TypeDeclared")), F.bool_or(one & F.col("fact_type").isin("TypeDeclared", "MethodDeclared", "PropertyDeclared", "FieldDeclared", "ParameterDeclared")), F.bool_or(F.col("evidence_tier") == TIERS[1]), F.bool_or(F.col("evidence_tier") == TIERS[2]), True)
    told = m.groupBy("change_id").agg(cls.alias("classification"), _n(), F.countDistinct("file_path").alias("n_files"))
    return changes.join(told, "change_id", "left").select("change_id", "element", F.coalesce("classification", F.lit("NoImpactEvidence")).alias("classification"), F.coalesce("n", F.lit(0)).alias("n_facts"))


# ---- scalar functions on whole tables


@query("select fact_type, count(distinct 'x-' || left(sha256(fact_id || '|' || coalesce(project_path, '') || '|' || file_path), 20)) as n_ids from facts group by 1")
def f1_piped_ids(s, d):
    return table(s, d, "facts").groupBy("fact_type").agg(F.countDistinct(T.piped_id("x-", 20, F.col("fact_id"), F.col("project_path"), F.col("file_path"))).alias("n_ids"))


@query(f"""with {LF}, q as (select distinct json_extract_string(properties_json, '$.sql') q from lf where fact_type = 'SqlTextUsed'),
n as (select q, trim(regexp_replace(regexp_replace(q, '''(?:''''|[^''])*''', ''' ''', 'g'), '\\s+', ' ', 'g')) m from q where q is not null)
select q as sql, left(sha256(q), 32) as text_hash, left(sha256(regexp_replace(m, ';+$', '')), 32) as shape_hash,
case when upper(split_part(m, ' ', 1)) in ('SELECT','INSERT','UPDATE','DELETE','MERGE','CREATE','ALTER','DROP','TRUNCATE','CALL','EXEC','EXECUTE') then upper(split_part(m, ' ', 1)) else '' end as operation from n""")
def f7_sql_shapes(s, d):
    sql = T.first_value(T.properties(F.col("properties_json")), "sql")
    texts = _facts(s, d, "fact_type", "properties_json").where(F.col("fact_type") == "SqlTextUsed").select(sql.alias("sql")).where(F.col("sql").isNotNull()).distinct()
    return texts.withColumn("x", Q.shape(F.col("sql"))).select("sql", "x.text_hash", "x.shape_hash", "x.operation")


@query(f"""with u as (select distinct json_extract_string(properties_json, '$.url') r from facts where fact_type = 'HttpCallDetected'), v as (select distinct unnest(string_split(json_extract_string(properties_json, '$.routes'), ',')) r from facts where fact_type = 'AspNetRouteDeclared'),
w as (select r, regexp_replace(regexp_replace(r, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@', '\\1') c from u union select r, regexp_replace(regexp_replace(r, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@', '\\1') from v)
select r as route, {_KEY.format('c')} as path_key from w where r is not null""")
def f8_routes(s, d):
    p = T.properties(F.col("properties_json"))
    f = table(s, d, "facts").where(F.col("fact_type").isin("HttpCallDetected", "AspNetRouteDeclared"))
    texts = f.select(F.explode(F.when(F.col("fact_type") == "HttpCallDetected", F.array(T.first_value(p, "url"))).otherwise(F.split(T.first_value(p, "routes"), ","))).alias("route"))
    return texts.where(F.col("route").isNotNull()).distinct().select("route", R.normalize(F.col("route"))["key"].alias("path_key"))


@query(f"""with {LF}, v as (select json_extract_string(properties_json, '$.version') v from lf where fact_type = 'PackageReferenced')
select v as version, not regexp_matches(v, '://|\\\\|^/|^\\.{{1,2}}/|^file:|^git\\+|\\$\\{{|\\$\\(|%') as safe, count(*) as n from v where v is not null and trim(v) <> '' group by all""")
def f12_package_versions(s, d):
    v = T.first_value(T.properties(F.col("properties_json")), "version")
    f = _facts(s, d, "fact_type", "properties_json").where(F.col("fact_type") == "PackageReferenced").select(v.alias("version")).where(F.col("version").isNotNull())
    return f.groupBy("version", (~T.unsafe_version(F.col("version"))).alias("safe")).agg(_n())


@query("""with x as (select distinct source_symbol s from facts where source_symbol is not null) select s as symbol, nullif(regexp_extract(s, '^(.+)\\.[^.]*$', 1), '') as owner, regexp_extract(s, '([^.]*)$', 1) as member from x""")
def f13_symbol_parts(s, d):
    x = table(s, d, "facts").select(F.col("source_symbol").alias("symbol")).where(F.col("symbol").isNotNull()).distinct()
    return x.select("symbol", T.containing_type(F.col("symbol")).alias("owner"), T.member_name(F.col("symbol")).alias("member"))


@query("select fact_type, count_if(not json_valid(properties_json)) as n_malformed, count(*) as n from facts group by 1")
def f16_malformed_properties(s, d):
    return E.with_properties(table(s, d, "facts")).groupBy("fact_type").agg(F.count_if("malformed").alias("n_malformed"), _n())


@query(f"""with {LF}, x as (select fact_type, list_sort(map_entries(cast(cast(properties_json as json) as map(varchar, varchar)))) l from lf)
select fact_type, count(distinct list_filter(l, lambda e: trim(coalesce(e.value, '')) <> '')) as n_hashes from x group by 1""")
def f17_metadata_hashes(s, d):
    h = T.metadata_hash(T.properties(F.col("properties_json")))
    return _facts(s, d, "fact_type", "properties_json").groupBy("fact_type").agg(F.countDistinct(h).alias("n_hashes"))


# ---- exports


@query(f"with {CF}, x as (select source_index_id i, fact_type t, count(*) n from cf group by all) select i as source_index_id, string_agg(t || ':' || n, ';' order by t) as summary from x group by 1")
def k3_export_summary(s, d):
    from ..sources.sinks import summary_lines

    return summary_lines(_combined(s, d, "source_index_id", "fact_type"), "source_index_id", "fact_type")


# ---- round trips through sinks and sources

_BACK = """with x as (select distinct * exclude (ingested_at) from facts) select fact_type, count(*) as n, count(distinct fact_id) as n_ids, count(project_path) as n_projects,
sum(coalesce(start_line, 0))::bigint as lines, count(distinct snippet_hash) as n_hashes from x group by 1"""


def _told(df: DataFrame) -> DataFrame:
    return df.groupBy("fact_type").agg(_n(), F.countDistinct("fact_id").alias("n_ids"), F.count("project_path").alias("n_projects"), F.sum(F.coalesce("start_line", F.lit(0))).cast("long").alias("lines"), F.countDistinct("snippet_hash").alias("n_hashes"))


def _shared(s, name: str) -> str:
    return f"{ensure_checkpoint_dir(s)}/{name}"


@query(_BACK)
def k2_ndjson_round_trip(s, d):
    """All facts written as NDJSON in the contract's shape and read again."""
    from ..sources import readers, sinks

    facts = table(s, d, "facts").drop("ingested_at").distinct()
    sinks.write_facts_ndjson(facts, _shared(s, "facts.ndjson"))
    return _told(readers.facts_ndjson(s, _shared(s, "facts.ndjson")))


@query(_BACK)
def k1_index_round_trip(s, d):
    """All facts and manifests written as an index and read again; tables that aren't there come back empty."""
    from ..sources import readers, sinks

    sinks.write_index({"facts": table(s, d, "facts").drop("ingested_at").distinct(), "scan_manifest": table(s, d, "scan_manifest")}, _shared(s, "index"))
    tables, _ = readers.index_parquet(s, _shared(s, "index"))
    return _told(tables["facts"])


@query(f"""with {CF}, k as (select 'chunk-' || left(sha256(source_index_id || '|' || combined_fact_id), 24) as chunk_id, case fact_type when 'HttpCallDetected' then 'http-client' when 'AspNetRouteDeclared' then 'http-route' when 'SqlTextUsed' then 'sql-query' else 'package-config' end as surface_kind
from cf where fact_type in ('HttpCallDetected', 'AspNetRouteDeclared', 'SqlTextUsed', 'PackageReferenced', 'ConfigKeyDeclared', 'ConnectionStringDeclared')) select chunk_id, surface_kind from k""")
def k5_evidence_chunks(s, d):
    """A chunk for each surface, with an id that depends on its key alone."""
    from . import commands as C

    return C.docs_export(_index(s, d))["chunks"].select("chunk_id", F.get_json_object("payload", "$.surface_kind").alias("surface_kind"))


# ---- extraction from source texts


def _files(s, d) -> DataFrame:
    return table(s, d, "file_inventory").select("scan_id", "relative_path", "content").distinct()


@query(r"""with f as (select distinct scan_id, relative_path, content from file_inventory where content is not null and regexp_matches(lower(relative_path), '\.py$')),
l as (select scan_id, relative_path, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) line_no from f)
select scan_id, relative_path, line_no::int as line_no, 'class' as keyword, regexp_extract(line, '^\s*class\s+([A-Za-z_]\w*)', 1) as name from l where regexp_matches(line, '^\s*class\s+[A-Za-z_]')""")
def x18_python_types(s, d):
    return X.declared_types(_files(s, d).where(F.lower("relative_path").endswith(".py")))


@query(r"""with f as (select distinct scan_id, relative_path, content from file_inventory where content is not null and regexp_matches(lower(relative_path), '\.(cs|java)$')),
l as (select scan_id, relative_path, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) line_no from f),
m as (select *, '^\s*(?:(?:\[[^\]]*\]|@\w+)\s*)*(?:(?:public|private|protected|internal|static|final|sealed|abstract|partial|readonly|file|ref)\s+)*(class|interface|struct|record|enum)\s+([A-Za-z_]\w*)' p from l)
select scan_id, relative_path, line_no::int as line_no, regexp_extract(line, p, 1) as keyword, regexp_extract(line, p, 2) as name from m where regexp_matches(line, p)
and not (lower(relative_path) like '%.java' and regexp_extract(line, p, 1) = 'struct')
and not (lower(relative_path) like '%.java' and regexp_matches(line, '^\s*(?:\[|(?:\w+\s+)*(?:internal|partial|readonly|file|ref)\s)'))
and not (lower(relative_path) like '%.cs' and regexp_matches(line, '^\s*(?:@|(?:\w+\s+)*final\s)'))""")
def x2_declared_types(s, d):
    """Types that C# and Java files declare."""
    return X.declared_types(_files(s, d).where(F.lower("relative_path").rlike(r"\.(?:cs|java)$")))


@query()
def x5_config_keys(s, d):
    from ..sources.readers import config_keys

    return config_keys(_files(s, d))


@query()
def x18_python_syntax(s, d):
    """Declarations, imports and calls of all Python texts by their syntax trees."""
    return X.python_syntax(_files(s, d)).groupBy(F.coalesce("kind", "gap").alias("kind")).agg(_n(), F.countDistinct("name").alias("n_names"))


@query()
def s16_xml_elements(s, d):
    """Elements of all XML settings, and documents that are refused or broken."""
    from ..sources.markup import xml_elements

    return xml_elements(_files(s, d)).groupBy(F.coalesce("path", "gap").alias("path")).agg(_n())


@query()
def s16_settings(s, d):
    from ..sources.markup import settings, xml_elements

    return settings(xml_elements(_files(s, d)))


@query()
def x3_integration_calls(s, d):
    return X.integration_calls(_files(s, d)).groupBy("kind").agg(_n())


@query()
def x7_sql_statements(s, d):
    return X.sql_statements(_files(s, d)).groupBy("kind").agg(_n())


@query()
def x9_permissions(s, d):
    return X.permissions(X.sql_statements(_files(s, d))).groupBy("action", "capability").agg(_n())


@query()
def a13_runbook_steps(s, d):
    return X.runbook(X.sql_statements(_files(s, d))).select("scan_id", "relative_path", "island", "kind", "n_rows")


@query(f"""with {LF}, g as (select repo, json_extract_string(properties_json, '$.message') m from lf where fact_type = 'AnalysisGap')
select repo, case when regexp_matches(m, '(?i)restore|package') then 'restore' when regexp_matches(m, '(?i)load|project') then 'project-load' when regexp_matches(m, '(?i)syntax|declaration') then 'syntax'
when regexp_matches(m, '(?i)dynamic') then 'dynamic-dispatch' else 'other' end as category, count(*) as n from g group by all""")
def x14_diagnostics(s, d):
    return X.gap_facts(_facts(s, d, "repo", "fact_type", "properties_json")).groupBy("repo", "category").agg(_n())


@query(f"with {LF} select fact_type, count(*) as n, count(distinct file_path) as n_files from lf group by 1")
def x20_deduplicated_facts(s, d):
    one = X.dedupe(_facts(s, d, "fact_type", "file_path", "start_line", "source_symbol", "target_symbol"))
    return one.groupBy("fact_type").agg(_n(), F.countDistinct("file_path").alias("n_files"))


# ---- commands


def _index(s, d) -> dict[str, DataFrame]:
    return {n: table(s, d, n) for n in ("index_sources", "combined_facts", "combined_symbols")}


def _sides(s, d) -> tuple[dict, dict]:
    """The first and the last scan of every series as two single indexes; the series stands for the scan in keys."""
    m = E.current_manifest(table(s, d, "scan_manifest"))
    ends = m.groupBy("repo", "scan_root_relative_path").agg(F.min(F.struct("instant", "scan_id")).alias("b"), F.max(F.struct("instant", "scan_id")).alias("a"))
    ends = ends.select(F.concat_ws("|", "repo", "scan_root_relative_path").alias("series"), F.col("b.scan_id").alias("b"), F.col("a.scan_id").alias("a")).where(F.col("a") != F.col("b"))
    facts, manifest, ends = table(s, d, "facts"), table(s, d, "scan_manifest"), cut(ends)
    near = F.broadcast(ends) if row_bound(ends, BROADCAST_ROWS) else ends
    of = lambda df, x: df.join(near.select("series", F.col(x).alias("scan_id")), "scan_id").withColumn("scan_id", F.col("series"))
    return tuple({"facts": of(facts, x), "scan_manifest": of(manifest, x)} for x in ("b", "a"))


@query(f"with {CF} select source_index_id as source_id, fact_type, evidence_tier, count(*) as n from cf group by all")
def c_report(s, d):
    from . import commands as C

    return C.report(_index(s, d))["facts"]


@query()
def c_report_review(s, d):
    from . import commands as C

    return C.report(_index(s, d))["needs_review"].groupBy("why").agg(_n())


@query()
def c_paths(s, d):
    from . import commands as C

    return C.paths(_index(s, d), max_paths=ALL, max_frontier=ALL)["paths"].select("start", "node", "depth", "classification")


@query()
def c_reverse(s, d):
    from . import commands as C

    return C.reverse(_index(s, d), "sql-query", max_roots=ALL, per_root=ALL, max_frontier=ALL)["roots"]


@query()
def c_diff(s, d):
    from . import commands as C

    return C.diff(*_sides(s, d))["classes"]


@query()
def c_path_diff(s, d):
    """Ways of the newest scans that the first ones lack, and the other way round."""
    from . import commands as C

    return C.path_diff(*_sides(s, d), max_paths=ALL, max_frontier=ALL)["rows"].groupBy("change", "classification").agg(_n())


@query()
def c_release_summary(s, d):
    """Sections of a release review over all series, with the ways that pass a change."""
    from . import commands as C

    return C.release_review(*_sides(s, d), context=True)["summary"]


@query()
def c_contract_diff(s, d):
    from . import commands as C

    return C.contract_diff(*_sides(s, d))["rows"].groupBy("classification").agg(_n())


@query()
def c_release_review(s, d):
    from . import commands as C

    return C.release_review(*_sides(s, d))["rollup"]


@query()
def c_portfolio(s, d):
    """Surfaces that owners in the combined index share, all owners in one plan."""
    from . import commands as C

    src = table(s, d, "index_sources").select(F.col("source_index_id").alias("source_id"), F.split_part("repo_name", F.lit("/"), F.lit(1)).alias("label"))
    return C.portfolio_of(C.surfaces(_index(s, d)).join(src, "source_id"))["shared"]


@query(f"""with {CF}, o as (select cf.*, split_part(x.repo_name, '/', 1) as label from cf join index_sources x using (source_index_id) where fact_type in ('HttpCallDetected', 'AspNetRouteDeclared', 'SqlTextUsed', 'PackageReferenced', 'ConfigKeyDeclared', 'ConnectionStringDeclared')),
k as (select label, case fact_type when 'HttpCallDetected' then 'http-client' when 'AspNetRouteDeclared' then 'http-route' when 'SqlTextUsed' then 'sql-query' else 'package-config' end as surface_kind, evidence_tier from o)
select label, surface_kind, count(*) as n, count_if(evidence_tier not in ('Tier1Semantic', 'Tier2Structural')) as n_review,
case when count_if(evidence_tier not in ('Tier1Semantic', 'Tier2Structural')) = 0 then 'available' when count_if(evidence_tier not in ('Tier1Semantic', 'Tier2Structural')) < count(*) then 'partial' else 'review' end as status from k group by all""")
def a22_portfolio_sections(s, d):
    """Each owner's surfaces by kind, and whether they are fit to act on."""
    from . import commands as C

    src = table(s, d, "index_sources").select(F.col("source_index_id").alias("source_id"), F.split_part("repo_name", F.lit("/"), F.lit(1)).alias("label"))
    return C.portfolio_of(C.surfaces(_index(s, d)).join(src, "source_id"))["sections"]


_CHECKS = {
    "rule-version": "regexp_matches(rule_id, '\\.v\\d+$')", "known-tier": "evidence_tier in ('Tier1Semantic', 'Tier2Structural', 'Tier3SyntaxOrTextual', 'Tier4Unknown')",
    "lines": "start_line between 1 and 1000000000 and end_line >= start_line",
}


@query(f"with {CF} " + " union all ".join(f"select '{k}' as \"check\", count_if(not coalesce({v}, false)) as n_bad, count(*) as n from cf" for k, v in _CHECKS.items())
       + " union all select 'relative-path', count_if(regexp_matches(file_path, '^(?:/|\\\\|[A-Za-z]:)')), count(*) from cf")
def c_evidence_pack(s, d):
    from . import commands as C

    return C.evidence_pack(_index(s, d))["checks"].select("check", "n_bad", "n")


@query(f"with {CF} select fact_type, rule_id, count(*) as n from cf group by all")
def c_baseline(s, d):
    from . import commands as C

    return C.baseline(_index(s, d))["counts"]


@query(f"with {CF} select source_index_id as source_id, fact_type, rule_id, count(*) as n, count(distinct file_path) as n_files, max(evidence_tier) as weakest from cf group by all")
def k10_packet(s, d):
    from . import commands as C

    return C.packet(_index(s, d))["rows"].drop("digest")


@query(f"""with {_SNAP}, x as (select repo || '|' || root s, fact_type t, rule_id r, count(*) n, count(distinct file_path) f, max(evidence_tier) w from bf group by all),
y as (select repo || '|' || root s, fact_type t, rule_id r, count(*) n, count(distinct file_path) f, max(evidence_tier) w from af group by all)
select coalesce(x.s, y.s) || '|' || coalesce(x.t, y.t) || '|' || coalesce(x.r, y.r) as key, case when x.s is null then 'added' else 'removed' end as change from x full join y on x.s = y.s and x.t = y.t and x.r = y.r where x.s is null or y.s is null""")
def k10_packet_diff(s, d):
    """Rows that only one of a series' first and last packets has."""
    from . import commands as C

    rows = C.packet_diff(*(C.packet(x) for x in _sides(s, d)))["rows"]
    return rows.where(F.col("change") != "changed").select("key", "change")


@query(f"""with {CF} select source_index_id as source_id, case fact_type when 'HttpCallDetected' then 'http-client' else 'sql-query' end as surface_kind, count(*) as n from cf
where fact_type in ('HttpCallDetected', 'SqlTextUsed') and evidence_tier in ('Tier2Structural', 'Tier3SyntaxOrTextual') group by all""")
def pr14_selected_surfaces(s, d):
    """Surfaces of two kinds and two tiers, both checked against their vocabularies."""
    from . import commands as C

    return C.select(_index(s, d), kinds=["http-client", "sql-query"], tiers=["Tier2Structural", "Tier3SyntaxOrTextual"]).groupBy("source_id", "surface_kind").agg(_n())


# ---- the graph of types that call each other: parallel edges, diamonds and cycles

_TYPES = """f as (select distinct on (fact_id) fact_id, fact_type, source_symbol, target_symbol from facts order by fact_id, ingested_at desc, scan_id desc),
e as (select fact_id id, split_part(source_symbol, '.', 1) a, split_part(target_symbol, '.', 1) b from f where fact_type in ('CallEdge', 'ObjectCreated') and source_symbol is not null and target_symbol is not null),
roots as (select distinct a n from e where a not in (select b from e)),
p as (select n s, n, 0 depth, [n] nodes, []::varchar[] edges from roots union all
select p.s, e.b, p.depth + 1, list_append(p.nodes, e.b), list_append(p.edges, e.id) from p join e on p.n = e.a where p.depth < 4 and not list_contains(p.nodes, e.b))"""


def _types(s, d) -> tuple[DataFrame, DataFrame]:
    one = table(s, d, "facts").groupBy("fact_id").agg(F.max(F.struct("ingested_at", "scan_id", "fact_type", "source_symbol", "target_symbol", "evidence_tier")).alias("x")).select("fact_id", "x.*")
    named = one.where(F.col("source_symbol").isNotNull() & F.col("target_symbol").isNotNull())
    of = lambda c: F.split_part(c, F.lit("."), F.lit(1))
    edges = E.typed_edges(named).select(F.col("fact_id").alias("edge_id"), of("source_symbol").alias("source"), of("target_symbol").alias("target"), F.col("edge_kind").alias("kind"), "evidence_tier")
    roots = edges.select(F.col("source").alias("node")).distinct().join(edges.select(F.col("target").alias("node")).distinct(), "node", "left_anti")
    return edges, roots


@query(f"with recursive {_TYPES} select s as start, n as node, depth, array_to_string(edges, '>') as edges from p where depth > 0 and (depth = 4 or n not in (select a from e))")
def g3_type_paths(s, d):
    """Maximal ways of at most four calls from type to type; each parallel call is a way of its own."""
    edges, roots = _types(s, d)
    return G.bounded_paths(roots, edges, None, 4, ALL, ALL)[0].select("start", "node", "depth", F.array_join("edges", ">").alias("edges"))


@query(f"""with recursive {_TYPES} select 'CycleDetected' as gap, count(*) as n from p join e on p.n = e.a where p.depth < 4 and list_contains(p.nodes, e.b) having count(*) > 0
union all select 'DepthLimit', count(*) from p where depth = 4 having count(*) > 0""")
def g14_type_gaps(s, d):
    """Where ways between types run into themselves or into the depth limit."""
    edges, roots = _types(s, d)
    return G.gap_counts(roots, edges, 4)


@query(f"""with recursive {_TYPES}, r as (select distinct a s, b n, 1 d from e union select r.s, e.b, r.d + 1 from r join e on r.n = e.a where r.d < 60)
select s as start, n as node, min(d)::int as distance from r where s <> n group by all union all select distinct x, x, 0 from (select a x from e)""")
def g12_type_reach(s, d):
    """All types that each type reaches, over cycles too, at their least distance."""
    edges, _ = _types(s, d)
    return G.reachable(edges.select(F.col("source").alias("node")).distinct(), edges)


@query(f"""with recursive {_TYPES}, t as (select a s, b n, 1 depth, [id] used from e where a in (select n from roots) union all select t.s, e.b, t.depth + 1, list_append(t.used, e.id) from t join e on t.n = e.a where t.depth < 3 and not list_contains(t.used, e.id))
select s as start, n as node, depth from t where depth = 3 or not exists (select 1 from e where e.a = t.n and not list_contains(t.used, e.id))""")
def g7_type_trails(s, d):
    """Maximal trails of at most three calls that use no call twice; they may pass a type twice."""
    edges, roots = _types(s, d)
    return G.edge_simple_paths(roots, edges, 3, ALL).select("start", "node", "depth")


@query(f"""with recursive {_TYPES}, n as (select a x from e union select b from e), h as (select b from e group by 1 having count(*) >= 2), up as (select b x from h union select e.a from up join e on up.x = e.b)
select x as node from up""")
def g16_reaching_hubs(s, d):
    """Types from which one that several calls lead to can be reached."""
    edges, _ = _types(s, d)
    hubs = edges.groupBy(F.col("target").alias("node")).agg(_n()).where(F.col("n") >= 2)
    return G.reaching(hubs, edges)


# ---- further joins and classes on whole tables


def _latest_sides(s, d, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Current facts of each series' first and last scan with the repository, the series' scans being joined by id."""
    m = E.current_manifest(table(s, d, "scan_manifest"))
    ends = m.groupBy("repo", "scan_root_relative_path").agg(F.min(F.struct("instant", "scan_id")).alias("b"), F.max(F.struct("instant", "scan_id")).alias("a"))
    facts = _facts(s, d, *cols)
    return tuple(facts.join(ends.select("repo", F.col(f"{x}.scan_id").alias("scan_id")), "scan_id") for x in ("b", "a"))


@query(f"""with {LM}, e as (select repo, scan_root_relative_path root, arg_min(scan_id, {{'t': t, 's': scan_id}}) b, arg_max(scan_id, {{'t': t, 's': scan_id}}) a from lm group by all), {LF},
x as (select e.repo, list_sort(list(distinct rule_id)) l from lf join e on lf.scan_id = e.b group by 1), y as (select e.repo, list_sort(list(distinct rule_id)) l from lf join e on lf.scan_id = e.a group by 1)
select coalesce(x.repo, y.repo) as repo, x.l is not distinct from y.l as same from x full join y on x.repo = y.repo""")
def a15_context_changes(s, d):
    """Whether a repository's first and newest scans rest on the same rules."""
    return M.context_changes(*_latest_sides(s, d, ["rule_id"]), "repo", "rule_id")


@query(f"""with {CF}, l as (select source_index_id i, string_agg(original_fact_id, ';' order by combined_fact_id) ids from cf group by 1),
e as (select i, trim(unnest(string_split(ids, ';'))) f from l), o as (select distinct on (fact_id) fact_id, fact_type from facts order by fact_id, ingested_at desc, scan_id desc)
select e.i as source_index_id, e.f as fact_id, o.fact_type from e join o on e.f = o.fact_id where e.f <> ''""")
def j20_enriched_lists(s, d):
    """The facts that lists of ids in text name; each of a source's facts is named by one."""
    one = _combined(s, d, "source_index_id", "original_fact_id").select("source_index_id", "original_fact_id", F.pmod(F.xxhash64("combined_fact_id"), F.lit(64)).alias("list"))
    # A source's ids stand in 64 lists, so that no text grows with the source.
    lists = one.groupBy("source_index_id", "list").agg(F.array_join(F.array_sort(F.collect_list("original_fact_id")), ";").alias("ids"))
    types = table(s, d, "facts").groupBy("fact_id").agg(F.max(F.struct("ingested_at", "scan_id", "fact_type")).alias("x")).select("fact_id", "x.fact_type")
    return M.enrich(lists, types, "ids", "fact_id", ["fact_type"]).select("source_index_id", "fact_id", "fact_type")


@query(f"""with {CS} select source_index_id as source_id, display_name, count(*) as n from cs group by all having count(*) > 1""")
def g15_duplicate_nodes(s, d):
    return G.duplicate_nodes(_symbols(s, d).withColumnRenamed("source_index_id", "source_id"))


@query(f"""with recursive {_EDGES}, p as (select b s, a n, 1 depth from e union all select p.s, e.a, p.depth + 1 from p join e on p.n = e.b where p.depth < 5)
select n as base, s as candidate, min(depth)::int as depth from p where n <> s group by all""")
def g11_override_candidates(s, d):
    """Members below a symbol, as candidates within five levels."""
    edges, _, _ = _graph(s, d)
    return G.override_candidates(edges.select(F.col("target").alias("from_symbol"), F.col("source").alias("to_symbol"), F.lit("overrides").alias("kind")))


@query(f"""with recursive {_EDGES}, m as (select combined_symbol_id n from cs where symbol_kind = 'Method'),
p as (select r s, r n, 0 depth, false f from roots union all select p.s, e.b, p.depth + 1, e.b in (select n from m) from p join e on p.n = e.a where not p.f and p.depth < 8),
part as (select combined_symbol_id n from cs join index_sources x using (source_index_id) where not coalesce(x.analysis_level = 'Level1SemanticAnalysis' and x.build_status = 'Succeeded', false)),
up as (select n from part union select e.a from up join e on up.n = e.b)
select r as start, case when r in (select n from up) then 'UnknownAnalysisGap' else 'NoPathFound' end as gap from roots where r not in (select s from p where f)""")
def g16_no_path_gaps(s, d):
    """Root symbols with no method below them; unknown where a source that was read in part can be reached."""
    edges, roots, methods = _graph(s, d)
    paths, _ = G.bounded_paths(roots, edges, methods, 8, ALL, ALL)
    nodes = _symbols(s, d).select(F.col("combined_symbol_id").alias("node"), F.col("source_index_id").alias("source_id"))
    full = F.coalesce((F.col("analysis_level") == "Level1SemanticAnalysis") & (F.col("build_status") == "Succeeded"), F.lit(False))
    return G.no_path_gaps(roots, paths, edges, nodes, table(s, d, "index_sources").where(~full).select(F.col("source_index_id").alias("source_id")))


@query(f"""with recursive {_EDGES}, m as (select combined_symbol_id n from cs where symbol_kind = 'Method'), src as (select combined_symbol_id n, source_index_id i from cs),
p as (select r s, r n, 0 depth, false f from roots union all select p.s, e.b, p.depth + 1, e.b in (select n from m) from p join e on p.n = e.a where not p.f and p.depth < 8),
w as (select src.i, p.s, p.n, p.depth, row_number() over (partition by src.i order by p.depth, p.s, p.n) r from p join src on p.s = src.n where f)
select i as source_id, count(*) as n_paths, min(depth) as shortest from w where r <= 5 group by 1""")
def g6_lifted_paths(s, d):
    """The first five ways of each source that they touch."""
    edges, roots, methods = _graph(s, d)
    paths, _ = G.bounded_paths(roots, edges, methods, 8, ALL, ALL)
    nodes = _symbols(s, d).select(F.col("combined_symbol_id").alias("node"), F.col("source_index_id").alias("source_id"))
    return G.lift_to_sources(paths, nodes).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_paths"), F.min("depth").alias("shortest"))


@query(f"""with {_ENDS}, names as (select 'c' side, id, list_sort(regexp_extract_all(r, '\\{{([A-Za-z_][A-Za-z0-9_]*)', 1)) p from c union all select 'w', id, list_sort(regexp_extract_all(r, '\\{{([A-Za-z_][A-Za-z0-9_]*)', 1)) from w),
j as (select c.id, w.id sid, w.file_path f, w.start_line l from c join w using (k) where w.m = 'ANY' or c.m = w.m),
best as (select id, first(sid order by f, l, sid) sid from j group by 1)
select classification, note, count(*) as n from (
 select 'Matched' as classification, case when x.p <> y.p then 'parameter names differ' end as note from best join names x on x.side = 'c' and x.id = best.id join names y on y.side = 'w' and y.id = best.sid
 union all select 'ClientCallNoServerEndpoint', null from c where id not in (select id from best)
 union all select 'ServerEndpointNoClientMatch', null from w where id not in (select sid from j)) group by all""")
def j4_two_index_endpoints(s, d):
    """Clients of all sources as one index against servers of all as the other."""
    clients, servers = _endpoints(s, d)
    one = lambda df, route: df.select("id", "path_key", F.get("methods", F.lit(0)).alias("method"), R.normalize(F.col(route))["parameters"].alias("parameters"), "file_path", "start_line")
    return M.align_two_indexes(one(clients, "url"), one(servers, "route")).groupBy("classification", "note").agg(_n())


@query()
def o11_sql_schema_impact(s, d):
    """SQL texts that name a table whose columns change."""
    from . import commands as C

    changes = s.createDataFrame([("t1", "tenant_log", None, None), ("t2", "loom", "status", None)], "change_id string, table_name string, column_name string, shape_hash string")
    return C.sql_schema_impact(_index(s, d), changes)["findings"].groupBy("change_id", "evidence").agg(_n())


@query(f"""with {CF}, x as (select combined_fact_id as fact_id, json_extract_string(properties_json, '$.name') l from cf where fact_type in ('TypeDeclared', 'PropertyDeclared')),
y as (select fact_id, l, regexp_matches(l, '^[A-Za-z_][A-Za-z0-9_. ]{{0,99}}$') and not regexp_matches(l, '(?i)password|secret|token|://') safe, left(sha256('||' || l), 32) model_key from x where l is not null and trim(l) <> '')
select fact_id, case when safe then l else 'hash:' || left(sha256(l), 16) end as display_name, model_key, case when not safe then 'unsafe-label' end as redaction, count(*) over (partition by model_key) as n_same from y""")
def d3_data_descriptors(s, d):
    """Declared types and properties as data descriptors: the evidence holds no mapping metadata of its own."""
    facts = E.with_properties(_combined(s, d, "fact_type", "properties_json").withColumn("fact_id", F.col("combined_fact_id")).where(F.col("fact_type").isin("TypeDeclared", "PropertyDeclared")))
    return M.data_descriptors(facts).select("fact_id", "display_name", "model_key", "redaction", "n_same")


@query(f"with {CF} select combined_fact_id as fact_id from cf where fact_type = 'SqlTextUsed' and contains(lower(json_extract_string(properties_json, '$.sql')), 'tenant_log')")
def pr12_surface_names(s, d):
    """SQL surfaces whose name or tables match a selector."""
    facts = E.with_properties(_combined(s, d, "source_index_id", "fact_type", "rule_id", "evidence_tier", "file_path", "start_line", "properties_json").withColumn("fact_id", F.col("combined_fact_id")))
    return M.select_surfaces(E.surfaces(facts.where(F.col("fact_type") == "SqlTextUsed")), "sql-query", "tenant_log")[0].select("fact_id")
