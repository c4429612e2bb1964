"""The commands on a small index, and properties that hold between them."""

import pytest
from pyspark.sql import functions as F

from factloom.plans import commands as C

FACT = "fact_id string, scan_id string, fact_type string, rule_id string, evidence_tier string, source_symbol string, target_symbol string, contract_element string, file_path string, start_line int, end_line int, properties_json string, ingested_at timestamp"
ROWS = [
    ("f1", "s", "HttpCallDetected", "http.v1", "Tier2Structural", "App.Client.Load", None, None, "a.ts", 1, 1, '{"url":"https://h/api/orders/{id}","httpMethod":"GET"}'),
    ("f2", "s", "HttpRouteBinding", "route.v1", "Tier2Structural", None, "Api.Orders.Get", None, "b.cs", 1, 1, '{"routeTemplate":"/api/orders/{key:int}","httpMethod":"GET"}'),
    ("f3", "s", "CallEdge", "call.v1", "Tier1Semantic", "Api.Orders.Get", "Data.Store.Read", None, "b.cs", 5, 5, "{}"),
    ("f4", "s", "SqlTextUsed", "sql.v1", "Tier3SyntaxOrTextual", "Data.Store.Read", None, None, "c.cs", 9, 9, '{"sql":"select a from orders where b = 1"}'),
    ("f5", "s", "PackageReferenced", "pkg.v1", "Tier2Structural", None, None, None, "p.csproj", 1, 1, '{"packageName":"Lib.A","version":"1.0"}'),
    ("f6", "s", "AnalysisGap", "gap.v1", "Tier4Unknown", None, None, None, "d.cs", 1, 1, '{"message":"Package restore was skipped."}'),
    ("f7", "s", "TypeDeclared", "type.v1", "Tier1Semantic", None, "Api.Orders", "Order", "b.cs", 1, 9, '{"name":"Orders"}'),
]


def index(spark, change=lambda r: r, drop=()):
    rows = [(*change(r), None) for r in ROWS if r[0] not in drop]
    return {"facts": spark.createDataFrame(rows, FACT)}


def test_report_and_endpoints(spark):
    out = C.report(index(spark))
    assert out["facts"].agg(F.sum("n")).first()[0] == len(ROWS)
    assert {(r.surface_kind, r.n) for r in out["surfaces"].collect()} == {("http-client", 1), ("http-route", 1), ("sql-query", 1), ("package-config", 1)}
    assert [(r.category, r.n) for r in out["gaps"].collect()] == [("restore", 1)]
    assert [r.classification for r in C.endpoints(index(spark))["endpoints"].collect()] == ["MatchedEndpoint"]


def test_paths_cross_the_http_boundary(spark):
    got = C.paths(index(spark), from_symbol="App.Client", to_kind="sql-query")
    rows = got["paths"].collect()
    assert [r.nodes for r in rows] == [["App.Client.Load", "surface:s:f1", "surface:s:f2", "Api.Orders.Get", "Data.Store.Read", "surface:s:f4"]]
    assert rows[0].classification == "NeedsReviewPath"
    back = C.reverse(index(spark), "sql-query", "orders")
    assert [(r.root, r.classification) for r in back["roots"].collect()] == [("App.Client.Load", "NeedsReviewPath")]
    assert C.route_flow(index(spark), "/api/orders/{x}")["surfaces"].count() == 1
    assert C.flow(index(spark), "Api.Orders")["paths"].count() == 1 and C.relate(index(spark), "Data.Store")["paths"].count() > 0
    assert {r.node for r in C.property_flow(index(spark), "order")["tree"].collect()} == {"Api.Orders"}


def test_identical_sides_give_nothing_and_sides_swap(spark):
    a, b = index(spark), index(spark, drop=("f5",))
    assert C.diff(a, a)["rows"].count() == 0 and C.impact(a, a)["items"].count() == 0 and C.contract_diff(a, a)["rollup"].first()[0] == "NoDiff"
    assert [r.classification for r in C.diff(a, b)["rows"].collect()] == ["RemovedEvidence"] and [r.classification for r in C.diff(b, a)["rows"].collect()] == ["AddedEvidence"]
    assert [r.classification for r in C.snapshot_diff(b, a, same_sha=True)["rows"].collect()] == ["ChangedEvidence"]
    up = index(spark, change=lambda r: (*r[:11], r[11].replace("1.0", "2.0")))
    assert [(r.change, r.classification) for r in C.diff(a, up)["rows"].collect()] == [("changed", "ChangedEvidence")]


def test_release_portfolio_and_packs(spark):
    a, b = index(spark), index(spark, drop=("f5",))
    out = C.release_review(a, b)
    assert {(r.section, r.status) for r in out["sections"].collect()} == {("changed_surfaces", "available"), ("changed_edges", "available"), ("sql_evidence", "available"), ("gaps", "available"), ("contract", "not_requested"), ("packages", "not_requested"), ("path_context", "not_requested"), ("reverse", "not_requested"), ("sql_schema", "not_requested")}
    assert [(r.section, r.n_rows) for r in out["checklist"].orderBy("at").collect()] == [("changed_surfaces", 1)]
    full = C.release_review(a, index(spark, drop=("f4",)), context=True)
    assert {r.section: r.n_rows for r in full["summary"].collect()}["path_context"] >= 1 and full["reverse"].count() == 0
    assert out["rollup"].first().classification == "ActionableEvidence" and C.release_review(a, a)["rollup"].first().classification == "NoActionableEvidence"
    p = C.portfolio({"x": a, "y": b})
    assert p["shared"].count() == 3 and p["inputs"].count() == 2
    assert C.portfolio_diff({"x": a}, {"x": a})["rows"].count() == 0
    assert all(r.passes for r in C.evidence_pack(a)["checks"].collect())
    assert C.baseline_compare(C.baseline(a), C.baseline(a))["rows"].count() == 0 and C.baseline_compare(C.baseline(a), C.baseline(b))["rows"].count() == 1
    assert C.export(a)["edges"].count() == 1 and C.docs_export(a)["chunks"].count() == 4
    assert "[[Data.Store.Read]]" in {r.note: r.text for r in C.vault(a)["notes"].collect()}["Api.Orders.Get"]


@pytest.mark.parametrize("full,none", [(True, "NoEvidenceFullCoverage"), (False, "NoEvidenceReducedCoverage")])
def test_reduce_by_strength_budget_and_coverage(spark, full, none):
    changes = spark.createDataFrame([("a", "Store.Read"), ("b", "Nowhere.Known"), ("c", "Order")], "change_id string, element string")
    out = C.reduce(index(spark), changes, full)
    got = {r.change_id: r.classification for r in out["findings"].collect()}
    assert got["b"] == none and got["a"] == "NeedsReview" and got["c"] == "DefiniteImpact"
    assert C.reduce(index(spark), changes, full, budget=1)["evidence"].count() == 1


def test_package_and_schema_impact(spark):
    ch = spark.createDataFrame([("1", "lib.a", None, "1.0", "2.0"), ("2", "other", None, "1", "2")], "change_id string, package_name string, ecosystem string, old_version string, new_version string")
    out = C.package_impact(index(spark), ch)
    assert [r.change_id for r in out["findings"].collect()] == ["1"] and [r.change_id for r in out["gaps"].collect()] == ["2"]
    sc = spark.createDataFrame([("t", "orders", "a", None), ("u", "nope", None, None)], "change_id string, table_name string, column_name string, shape_hash string")
    assert [(r.change_id, r.evidence) for r in C.sql_schema_impact(index(spark), sc)["findings"].collect()] == [("t", "sql-table-and-column")]


def test_empty_index(spark):
    empty = {"facts": spark.createDataFrame([], FACT)}
    assert C.paths(empty)["paths"].count() == 0 and C.diff(empty, empty)["rows"].count() == 0 and C.report(empty)["facts"].count() == 0


MANIFEST = "scan_id string, repo string, commit_sha string, scanner_version string, scanned_at string, analysis_level string, build_status string, scan_root_relative_path string, ingested_at timestamp"


def with_manifest(spark, idx, repo="o/r", sha="c1", level="Level1SemanticAnalysis", status="Succeeded"):
    return {**idx, "scan_manifest": spark.createDataFrame([("s", repo, sha, "1", "2025-01-01T00:00:00Z", level, status, ".", None)], MANIFEST)}


def test_diffs_heed_coverage_and_identity(spark):
    a, b = index(spark), index(spark, drop=("f5",))
    cls = lambda x, y, f=C.diff: [r.classification for r in f(x, y)["rows"].collect()]
    full, part = with_manifest(spark, a), with_manifest(spark, a, status="Failed")
    assert cls(with_manifest(spark, b), full) == ["AddedEvidence"] and cls(with_manifest(spark, b, status="Failed"), full) == ["AddedWithBeforeGap"]
    assert cls(full, with_manifest(spark, b, level="Level3SyntaxAnalysis")) == ["RemovedWithAfterGap"] and cls(part, with_manifest(spark, b)) == ["RemovedEvidence"]
    assert cls(full, with_manifest(spark, b, repo="o/other")) == ["NeedsReviewDiff"] and cls(full, with_manifest(spark, b, repo="o/other", sha="unknown")) == ["UnknownAnalysisGap"]
    assert cls(with_manifest(spark, b), full, C.snapshot_diff) == ["ChangedEvidence"]
    assert [r.impact for r in C.impact(with_manifest(spark, b, status="Failed"), full)["items"].collect()] == ["NeedsReviewImpact"]
    assert [r.classification for r in C.portfolio_diff({"x": with_manifest(spark, b, status="Failed")}, {"x": full})["rows"].collect()] == ["PartialAnalysis"]
    assert [r.classification for r in C.portfolio_diff({"x": with_manifest(spark, b, repo="o/other")}, {"x": full})["rows"].collect()] == ["NeedsReview"]
    assert [r.classification for r in C.reverse(part, "sql-query")["roots"].collect()] == ["NeedsReviewPath"]


def test_paths_that_come_and_go(spark):
    a, b = index(spark), index(spark, drop=("f3",))
    assert C.path_diff(a, a)["rows"].count() == 0
    lost = C.path_diff(a, b, to_kind="sql-query")["rows"].collect()
    assert {r.change for r in lost} == {"removed", "added"} and any(r.key.startswith("App.Client.Load|") for r in lost if r.change == "removed")
    ctx = C.impact_context(a, b)
    assert {r.key.split("|")[0] for r in ctx["paths"].collect()} >= {"edge"}


def test_filters_know_their_words(spark):
    a = index(spark)
    assert C.select(a, kinds=["sql-query"]).count() == 1 and C.select(a, sources=["nope"]).count() == 0 and C.select(a, tiers=["Tier2Structural"]).count() == 3
    with pytest.raises(ValueError):
        C.select(a, kinds=["sql-queries"])


def test_reverse_caps_each_root(spark):
    rows = [(f"e{i}", "s", "CallEdge", "c.v1", "Tier1Semantic", "Root.A", f"Mid.M{i}", None, "a.cs", 1, 1, "{}", None) for i in range(4)]
    rows += [(f"m{i}", "s", "CallEdge", "c.v1", "Tier1Semantic", f"Mid.M{i}", "Data.Read", None, "a.cs", 1, 1, "{}", None) for i in range(4)]
    rows += [("r2", "s", "CallEdge", "c.v1", "Tier1Semantic", "Root.B", "Mid.M0", None, "a.cs", 1, 1, "{}", None), ("q", "s", "SqlTextUsed", "q.v1", "Tier1Semantic", "Data.Read", None, None, "a.cs", 1, 1, '{"sql":"select 1"}', None)]
    out = C.reverse({"facts": spark.createDataFrame(rows, FACT)}, "sql-query", per_root=2)
    assert {r.root: r.n_paths for r in out["roots"].collect()} == {"Root.A": 2, "Root.B": 1}
    assert [r.gap for r in out["gaps"].collect()] == ["RootPathLimit"]
    assert {r.root: r.n_paths for r in C.reverse({"facts": spark.createDataFrame(rows, FACT)}, "sql-query", per_root=None)["roots"].collect()} == {"Root.A": 4, "Root.B": 1}


def met_everywhere(n: int) -> list[tuple]:
    """n calls of one route that n sources serve; in one of them the handler reads a table. A call without a symbol begins a way."""
    http = lambda i, s, kind, a, b, props: (i, s, kind, "h.v1", "Tier1Semantic", a, b, None, f"{i}.cs", 1, 1, props, None)
    rows = [http(f"c{i}", "s0", "HttpCallDetected", None if i else "App.Ask", None, '{"url":"/api/x","httpMethod":"GET"}') for i in range(n)]
    rows += [http(f"r{i}", f"s{i}", "AspNetRouteDeclared", None, f"Web{i}.Get", '{"routes":"/api/x","httpMethod":"GET"}') for i in range(n)]
    rows += [http("call", "s0", "CallEdge", "App.Main", "App.Ask", "{}"), http("deep", "s3", "CallEdge", "Web3.Get", "Data.Read", "{}")]
    return [*rows, http("q", "s3", "SqlTextUsed", "Data.Read", None, '{"sql":"select 1 from t"}')]


def written(monkeypatch) -> list[int]:
    """The numbers of rows that commands and searches write from now on."""
    from factloom.operators import graph as G

    sizes, real = [], G.cut

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(G, "cut", counted)
    monkeypatch.setattr(C, "cut", counted, raising=False)
    return sizes


def test_path_diff_forms_no_pairs_that_lead_nowhere(spark, monkeypatch):
    rows = met_everywhere(12)
    a, b = ({"facts": spark.createDataFrame(x, FACT)} for x in (rows, rows[:-1]))
    told = lambda most: sorted(map(str, C.path_diff(a, b, max_paths=most, max_frontier=most)["rows"].drop("__rank").collect()))
    want = told(100_000)
    sizes = written(monkeypatch)
    assert told(None) == want and len(want) == 11 and max(sizes) < 100


def test_context_of_sources_with_a_separator_in_their_id(spark):
    a, b = ({"facts": spark.createDataFrame([(r[0], "o/r|src", *r[2:]) for r in rows], FACT)} for rows in (met_everywhere(2)[:-3], met_everywhere(2)[:-1]))
    ctx = C.impact_context(b, a)["paths"]
    assert {r.key for r in ctx.collect()} == {"edge|o/r|src|calls|App.Main|App.Ask"}
