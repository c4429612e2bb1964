"""Queries p1, p2 and p5: the general operators applied to the whole evidence tables, and SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import orphans as O
from ..operators import snapshots as S
from ..tables import table, union

ELSEWHERE = ["symbol_occurrences"]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "index_sources").select("source_index_id", F.try_to_timestamp("imported_at").alias("ingested_at"))
    holders = [
        ("symbol_occurrences", "occurrence_id", {"fact_id": "facts", "symbol_id": "symbols"}, "scan_id"),
        ("combined_symbol_occurrences", "combined_occurrence_id", {"combined_fact_id": "combined_facts"}, None),
        ("combined_facts", "combined_fact_id", {"source_index_id": "index_sources"}, None),
    ]
    refs = union([O.references(table(spark, d, name), name, key, fields, scope) for name, key, fields, scope in holders])
    raw = union([O.reference_keys(table(spark, d, name), fields, scope) for name, _, fields, scope in holders])
    parents = union([
        O.parents(table(spark, d, "facts"), "facts", "fact_id", "scan_id"),
        O.parents(table(spark, d, "symbols"), "symbols", "symbol_id", "scan_id"),
        O.parents(table(spark, d, "combined_facts"), "combined_facts", "combined_fact_id", None),
        O.parents(sources, "index_sources", "source_index_id", None),
    ])
    return O.orphans(refs, parents, ELSEWHERE, raw_keys=raw)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "field_name", "row_key", "status").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return O.orphans_by_month(_orphans(spark, d))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return union([
        H.links(table(spark, d, "symbols"), "symbols", "scan_id", "symbol_id", "containing_symbol_id"),
        H.links(table(spark, d, "combined_symbols"), "combined_symbols", "source_index_id", "combined_symbol_id", "containing_combined_symbol_id"),
    ])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(_symbols(spark, d), with_paths=False).select("table_name", "scope_id", "node_id", "root_id", "depth", "n_descendants")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = H.hierarchy(_symbols(spark, d))
    path = F.when(F.col("depth") >= 0, F.array_join("path", " > ")).otherwise("")
    return tree.select("table_name", "scope_id", "node_id", "root_id", "depth", path.alias("path"), "back_edge")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy(_symbols(spark, d)))


def _fact_rows(spark: SparkSession, d: str) -> DataFrame:
    state = S.state_hash(F.lower("snippet_hash"), F.col("evidence_tier"), S.map_text(F.col("properties_json")))
    return table(spark, d, "facts").select(F.col("scan_id").alias("scan"), F.col("fact_id").alias("key"), F.col("ingested_at").alias("at"), state.alias("state"))


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return S.numbered_scans(table(spark, d, "scan_manifest"), ["repo", "scan_root_relative_path"], "scan_id", "scanned_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return S.changes(_fact_rows(spark, d), _scans(spark, d)).withColumnRenamed("key", "fact_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("scan_id", "change_kind").agg(F.count(F.lit(1)).alias("n_facts"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_paths, p2_descendants, p5_found, p5_report)}

_P1 = """
with occ as (select occurrence_id k, arg_max(scan_id, ingested_at) scan_id, arg_max(fact_id, ingested_at) fact_id,
                    arg_max(symbol_id, ingested_at) symbol_id, min(ingested_at) seen from symbol_occurrences group by 1),
     cocc as (select combined_occurrence_id k, arg_max(combined_fact_id, ingested_at) key, min(ingested_at) seen
              from combined_symbol_occurrences group by 1),
     cf as (select combined_fact_id k, arg_max(source_index_id, ingested_at) key, min(ingested_at) seen from combined_facts group by 1),
     refs as (select 'symbol_occurrences' table_name, 'fact_id' field_name, 'f' kind, k, scan_id scope, fact_id key, seen from occ
              union all select 'symbol_occurrences', 'symbol_id', 's', k, scan_id, symbol_id, seen from occ
              union all select 'combined_symbol_occurrences', 'combined_fact_id', 'c', k, '', key, seen from cocc
              union all select 'combined_facts', 'source_index_id', 'i', k, '', key, seen from cf),
     par as (select 'f' kind, scan_id scope, fact_id key, min(ingested_at) first from facts group by all
             union all select 's', scan_id, symbol_id, min(ingested_at) from symbols group by all
             union all select 'c', '', combined_fact_id, min(ingested_at) from combined_facts group by all
             union all select 'i', '', source_index_id, min(cast(imported_at as timestamptz)) from index_sources group by all),
     other as (select distinct kind, key from par),
     bad as (select r.table_name, r.field_name, r.k row_key, r.seen,
                    case when p.key is null then case when r.kind in ('f', 's') and o.key is not null then 'elsewhere' else 'missing' end
                         else 'late' end status
             from refs r left join par p on r.kind = p.kind and r.scope = p.scope and r.key = p.key
                         left join other o on r.kind = o.kind and r.key = o.key
             where r.key is not null and (p.key is null or p.first > r.seen))
"""
_P2 = """
with recursive n as (select 'symbols' table_name, scan_id scope_id, symbol_id node_id, arg_max(coalesce(containing_symbol_id, ''), ingested_at) up
                     from symbols group by all
                     union all select 'combined_symbols', source_index_id, combined_symbol_id, arg_max(coalesce(containing_combined_symbol_id, ''), ingested_at)
                     from combined_symbols group by all),
     l as (select a.table_name, a.scope_id, a.node_id, b.node_id up from n a left join n b
           on a.table_name = b.table_name and a.scope_id = b.scope_id and a.up = b.node_id and trim(a.up) <> ''),
     r as (select table_name, scope_id, node_id, node_id root_id, 0 depth, node_id path from l where up is null
           union all select l.table_name, l.scope_id, l.node_id, r.root_id, r.depth + 1, r.path || ' > ' || l.node_id
           from l join r on l.table_name = r.table_name and l.scope_id = r.scope_id and l.up = r.node_id),
     anc as (select table_name, scope_id, node_id, up anc, 1 distance from l where up is not null
             union select a.table_name, a.scope_id, a.node_id, l.up, a.distance + 1 from anc a join l
             on a.table_name = l.table_name and a.scope_id = l.scope_id and a.anc = l.node_id
             where l.up is not null and a.distance < 200),
     cnt as (select table_name, scope_id, anc, count(distinct node_id) n from anc where node_id <> anc group by all)
"""
_P5 = """
with m as (select scan_id, arg_max(repo, ingested_at) repo, arg_max(scan_root_relative_path, ingested_at) root,
                  arg_max(scanned_at, ingested_at) t from scan_manifest group by 1),
     s as (select scan_id, repo, root, row_number() over w idx, count(*) over (partition by repo, root) n from m
           window w as (partition by repo, root order by cast(t as timestamptz), scan_id)),
     f as (select scan_id, fact_id, arg_max({'s': lower(snippet_hash), 't': evidence_tier,
                  'p': list_sort(map_entries(cast(cast(properties_json as json) as map(varchar, varchar))))}, ingested_at) st
           from facts group by all),
     x as (select s.repo, s.root, s.idx, s.n, f.fact_id, f.st from f join s on f.scan_id = s.scan_id),
     e as (select b.repo, b.root, b.idx, b.fact_id, case when a.fact_id is null then 'added' else 'changed' end kind
           from x b left join x a on a.repo = b.repo and a.root is not distinct from b.root and a.fact_id = b.fact_id and a.idx = b.idx - 1
           where b.idx > 1 and (a.fact_id is null or a.st is distinct from b.st)
           union all select a.repo, a.root, a.idx + 1, a.fact_id, 'removed' from x a left join x b
           on a.repo = b.repo and a.root is not distinct from b.root and a.fact_id = b.fact_id and b.idx = a.idx + 1
           where a.idx < a.n and b.fact_id is null),
     found as (select s.scan_id, e.fact_id, e.kind change_kind from e join s on e.repo = s.repo and e.root is not distinct from s.root and e.idx = s.idx)
"""

ORACLES = {
    "p1_found": _P1 + "select distinct table_name, field_name, row_key, status from bad",
    "p1_report": _P1 + "select table_name, field_name, strftime(seen at time zone 'UTC', '%Y-%m') as month, status, count(*) as n_rows from bad group by all",
    "p2_found": _P2 + """select l.table_name, l.scope_id, l.node_id, coalesce(r.root_id, '') as root_id, coalesce(r.depth, -1)::int as depth,
        coalesce(c.n, 0)::int as n_descendants from l left join r using (table_name, scope_id, node_id)
        left join cnt c on c.table_name = l.table_name and c.scope_id = l.scope_id and c.anc = l.node_id""",
    "p2_descendants": _P2 + """select table_name, scope_id, anc as node_id, node_id as descendant_id, min(distance)::int as distance
        from anc where anc <> node_id group by all""",
    "p2_paths": _P2 + """, ring as (select table_name, scope_id, node_id from anc where anc = node_id group by all),
        least as (select g.table_name, g.scope_id, g.node_id from ring g
            where not exists (select 1 from anc a join ring h on a.table_name = h.table_name and a.scope_id = h.scope_id and a.anc = h.node_id
                where a.table_name = g.table_name and a.scope_id = g.scope_id and a.node_id = g.node_id and a.anc < g.node_id))
        select l.table_name, l.scope_id, l.node_id, coalesce(r.root_id, '') as root_id, coalesce(r.depth, -1)::int as depth, coalesce(r.path, '') as path,
        b.node_id is not null as back_edge from l left join r using (table_name, scope_id, node_id) left join least b using (table_name, scope_id, node_id)""",
    "p5_found": _P5 + "select scan_id, fact_id, change_kind from found",
    "p5_report": _P5 + "select scan_id, change_kind, count(*) as n_facts from found group by all",
}
