"""Joins, diffs, rollups and traversals on small fixtures, and properties that hold for all of them."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from factloom.operators import diff as D
from factloom.operators import evidence as E
from factloom.operators import graph as G
from factloom.operators import match as M
from factloom.operators import rollup as A

EDGE = "edge_id string, source string, target string, kind string, evidence_tier string"


def edges(spark, pairs, kind="calls", tier="Tier1Semantic"):
    return spark.createDataFrame([(f"e{i}", a, b, *(rest or (kind, tier))) for i, (a, b, *rest) in enumerate(pairs)], EDGE)


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def fifo(starts, pairs, ends, depth):
    out, q = [], deque((s, (s,)) for s in sorted(starts))
    adj = {}
    for i, (a, b) in enumerate(pairs):
        adj.setdefault(a, []).append((b, f"e{i}"))
    while q:
        start, path = q.popleft()
        if len(path) > 1 and path[-1] in ends:
            out.append(path)
            continue
        if len(path) - 1 == depth:
            continue
        for b, _ in sorted(adj.get(path[-1], ())):
            if b not in path:
                q.append((start, (*path, b)))
    return out


def test_paths_equal_a_queue(spark):
    rnd = random.Random(3)
    pairs = sorted({(f"n{rnd.randrange(10)}", f"n{rnd.randrange(10)}") for _ in range(26)})
    got, gaps = G.bounded_paths(nodes(spark, "n0", "n1"), edges(spark, pairs), nodes(spark, "n8", "n9"), 5, 1000)
    want = fifo(["n0", "n1"], pairs, {"n8", "n9"}, 5)
    assert [tuple(r.nodes) for r in got.orderBy("depth", "order").collect()] == want
    cut_, gap = G.bounded_paths(nodes(spark, "n0", "n1"), edges(spark, pairs), nodes(spark, "n8", "n9"), 5, 3)
    assert [tuple(r.nodes) for r in cut_.orderBy("depth", "order").collect()] == want[:3]
    assert "PathLimit" in {r.gap for r in gap.collect()}


def test_paths_gaps_guard_and_classes(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c", "implements", "Tier1Semantic"), ("c", "d", "interface-candidate", "Tier1Semantic"), ("b", "d", "calls", "Tier2Structural"), ("b", "x", "calls", "Tier3SyntaxOrTextual")])
    got, gaps = G.bounded_paths(nodes(spark, "a"), e, nodes(spark, "d", "x"), 3)
    assert {(tuple(r.nodes), r.classification) for r in got.collect()} == {(("a", "b", "d"), "ProbableStaticPath"), (("a", "b", "x"), "NeedsReviewPath")}
    assert {r.gap for r in gaps.collect()} == {"CycleDetected"}
    free, _ = G.bounded_paths(nodes(spark, "a"), e, nodes(spark, "d", "x"), 3, guard=False)
    assert ("a", "b", "c", "d") in {tuple(r.nodes) for r in free.collect()}
    short, gaps = G.bounded_paths(nodes(spark, "a"), e, nodes(spark, "d"), 1, on_cycle="silent")
    assert short.count() == 0 and {(r.node, r.gap) for r in gaps.collect()} == {("b", "DepthLimit")}
    assert G.bounded_paths(nodes(spark, "a"), e.limit(0), nodes(spark, "d"), 3)[0].count() == 0
    back, _ = G.bounded_paths(nodes(spark, "x"), e, nodes(spark, "a"), 3, reverse=True)
    assert [tuple(r.nodes) for r in back.collect()] == [("x", "b", "a")]


def test_frontier_limit(spark):
    e = edges(spark, [("a", f"b{i}") for i in range(9)])
    _, gaps = G.bounded_paths(nodes(spark, "a"), e, nodes(spark, "none"), 3, max_frontier=4)
    assert "FrontierLimit" in {r.gap for r in gaps.collect()}


def test_edge_simple_paths_and_suffixes(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("b", "d")])
    got = {tuple(r.nodes) for r in G.edge_simple_paths(nodes(spark, "a", "b"), e, 5, 100).collect()}
    assert got == {("a", "b", "c", "b", "d"), ("a", "b", "d"), ("b", "c", "b", "d"), ("b", "d")}
    kept = G.drop_suffixes(G.edge_simple_paths(nodes(spark, "a", "b"), e, 5, 100)).collect()
    assert {tuple(r.nodes) for r in kept} == {("a", "b", "c", "b", "d"), ("a", "b", "d")}
    both = G.edge_simple_paths(nodes(spark, "d"), e, 1, 100, direction="both")
    assert {tuple(r.nodes) for r in both.collect()} == {("d", "b")}


def test_reachable_and_tree(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", None)])
    assert {(r.node, r.distance) for r in G.reachable(nodes(spark, "a"), e).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert {(r.node, r.distance) for r in G.reachable(nodes(spark, "a"), e, 1, reverse=True).collect()} == {("a", 0), ("c", 1)}
    assert {(r.node, r.parent) for r in G.bfs_tree(nodes(spark, "a"), e).collect()} == {("a", None), ("b", "a"), ("c", "a")}


# ---- as-of and endpoints


def test_asof_against_brute_force(spark):
    rnd = random.Random(2)
    left = [(i, rnd.choice("ab") if i % 7 else None, rnd.randrange(20) if i % 11 else None) for i in range(60)]
    right = [(i, rnd.choice("ab"), rnd.randrange(20)) for i in range(25)]
    got = M.asof_backward(spark.createDataFrame(left, "id int, g string, at int"), spark.createDataFrame(right, "rid int, g string, rat int"), ["g"], "at", "rat", ["rid"], "rid").collect()
    for r in got:
        fits = [(t, i) for i, g, t in right if r.g is not None and r["at"] is not None and g == r.g and t <= r["at"]]
        assert r.asof_rid == (max(fits)[1] if fits else None)
    assert len(got) == 60


def test_alias_chains(spark):
    flows = spark.createDataFrame([("f1", "s", "m", "x", 10), ("f2", "s", "m", "loop", 10), ("f3", "s", "m", "none", 10), ("f4", "s", "m", "a", 10)], "flow_id string, scan_id string, container string, symbol string, line int")
    al = [("s", "m", "x", "old", 1), ("s", "m", "x", "y", 5), ("s", "m", "x", "late", 11), ("s", "m", "y", "p", 4), ("s", "m", "loop", "loop2", 1), ("s", "m", "loop2", "loop", 1), ("s", "m", "a", "b", 1), ("s", "m", "b", "c", 1), ("s", "m", "c", "d", 1), ("s", "m", "d", "e", 1)]
    aliases = spark.createDataFrame([(*r, f"i{i}") for i, r in enumerate(al)], "scan_id string, container string, alias string, origin string, line int, alias_id string")
    assert {r.flow_id: (r.resolved, r.n_hops) for r in M.resolve_aliases(flows, aliases).collect()} == {"f1": ("p", 2), "f2": ("loop2", 1), "f3": ("none", 0), "f4": ("d", 3)}


def test_unique_assignment(spark):
    df = spark.createDataFrame([("t", "f", "a"), ("t", "f", "a"), ("t", "g", "a"), ("t", "g", "b"), ("t", "h", None)], "t string, f string, v string")
    assert {(r.f, r.v) for r in M.unique_assignment(df, ["t", "f"], "v").collect()} == {("f", "a")}


def brute_endpoints(clients, servers):
    out = []
    seen_c, seen_s = set(), set()
    for cid, key, methods, dyn in clients:
        if dyn or not key:
            out.append(("DynamicClientUrlNeedsReview", cid, None))
            continue
        for src in {s[1] for s in servers}:
            path = [s for s in servers if s[1] == src and (s[2] == key or s[2].replace("/{?}", "") == key or s[2].replace("{?}", "{}") == key)]
            fit = [s for s in path if "ANY" in methods or "ANY" in s[3] or set(methods) & set(s[3])]
            if not path:
                continue
            seen_c.add(cid)
            if len(fit) == 1:
                out.append(("MatchedEndpoint" if fit[0][2] == key else "OptionalSegmentMatch", cid, src))
                seen_s.add(fit[0][0])
            elif fit:
                out.append(("AmbiguousMatch", cid, src))
                seen_s |= {s[0] for s in fit}
            else:
                out.append(("MethodMismatch", cid, src))
                seen_s |= {s[0] for s in path}
    out += [("ClientCallNoServerEndpoint", c[0], None) for c in clients if c[1] and not c[3] and c[0] not in seen_c]
    out += [("ServerEndpointNoClientMatch", None, s[1]) for s in servers if s[0] not in seen_s]
    return sorted(out, key=str)


def test_endpoint_alignment(spark):
    rnd = random.Random(8)
    keys = ["/a", "/a/{}", "/b", "/c/{}", "/d"]
    clients = [(f"c{i}", rnd.choice(keys), [rnd.choice(["GET", "POST", "ANY"])], False) for i in range(30)] + [("dyn", "/a", ["GET"], True), ("none", None, ["GET"], False)]
    servers = [(f"s{i}", rnd.choice(["x", "y"]), rnd.choice(["/a", "/a/{?}", "/b", "/e"]), [rnd.choice(["GET", "PUT", "ANY"])]) for i in range(9)]
    c = spark.createDataFrame([(i, "src", k, m, "f.cs", 1, d) for i, k, m, d in clients], "id string, source_id string, path_key string, methods array<string>, file_path string, start_line int, is_dynamic boolean")
    s = spark.createDataFrame([(i, x, k, m, "f.cs", 1) for i, x, k, m in servers], "id string, source_id string, path_key string, methods array<string>, file_path string, start_line int")
    got = sorted(((r.classification, r.client_id, r.server_source) for r in M.align_endpoints(c, s).collect()), key=str)
    assert got == brute_endpoints(clients, servers)
    assert {r.classification for r in M.align_endpoints(c, s.limit(0)).collect()} == {"ClientCallNoServerEndpoint", "DynamicClientUrlNeedsReview"}


def test_message_pairs_and_caps(spark):
    rows = [(f"p{i}", "publish", "static", "q", "Tier1Semantic", "l") for i in range(5)] + [(f"c{i}", "consume", "static", "q", "Tier3SyntaxOrTextual", "l") for i in range(4)] + [("d", "publish", "dynamic", "q", "Tier1Semantic", "l"), ("b", "publish", "static", " ", "Tier1Semantic", "l")]
    df = spark.createDataFrame(rows, "id string, direction string, status string, key string, tier string, label string")
    got, gaps = M.pair_messages(df, per_key=6)
    assert [(r.publisher, r.consumer, r.tier) for r in got.collect()] == [(p, c, "Tier3SyntaxOrTextual") for p in ("p0", "p1") for c in ("c0", "c1", "c2", "c3")][:6]
    assert [(r.key, r.n_pairs) for r in gaps.collect()] == [("q", 20)]
    assert M.pair_messages(df, per_key=100, total=7)[0].count() == 7


def test_reconciliation(spark):
    rows = [("s", "1", "A.Run(int)"), ("s", "2", "N.A.Run(int)"), ("s", "3", "A.Run"), ("s", "4", "Run"), ("s", "5", "B.Go"), ("s", "6", "C.Go"), ("s", "7", "Go"), ("t", "8", "A.Run")]
    got = {(r.from_id, r.to_id, r.kind) for r in M.reconcile(spark.createDataFrame(rows, "source_id string, id string, display_name string")).collect()}
    assert got == {("2", "1", "same-signature"), ("3", "1", "unsigned-to-signed"), ("4", "1", "bare-to-qualified")}


def test_delta_strengths(spark):
    facts = spark.createDataFrame([("f1", "N.Store.Close", None, None, None, ["ANY"]), ("f2", "Store.Close", None, None, None, ["ANY"]), ("f3", "Other.Close", None, None, None, ["ANY"]), ("f4", "Store.Open", None, None, None, ["ANY"]), ("f5", None, None, None, "/api/x/{}", ["GET"])], "fact_id string, source_symbol string, target_symbol string, contract_element string, path_key string, methods array<string>")
    ch = spark.createDataFrame([("a", "Store.Close"), ("b", "Store"), ("c", "GET /api/x/{id}"), ("d", "PUT /api/x/{id}")], "change_id string, element string")
    got = {(r.change_id, r.fact_id, r.strength) for r in M.delta_matches(ch, facts).collect()}
    assert got == {("a", "f1", "TypeAndMember"), ("a", "f2", "Exact"), ("a", "f3", "Member"), ("b", "f1", "Type"), ("b", "f2", "Type"), ("b", "f4", "Type"), ("c", "f5", "Endpoint")}


def test_packages_dispatch_and_permissions(spark):
    ch = spark.createDataFrame([("1", "Lib.A", "npm", "1", "2"), ("2", "lib.b", None, "1", "2")], "change_id string, package_name string, ecosystem string, old_version string, new_version string")
    su = spark.createDataFrame([("x", "lib.a", "NPM"), ("y", "LIB.A", "nuget"), ("z", "lib.B", "pypi"), ("n", None, None)], "id string, package_name string, ecosystem string")
    assert {(r.change_id, r.id) for r in M.package_matches(ch, su).collect()} == {("1", "x"), ("2", "z")}
    rel = spark.createDataFrame([("s", f"i{i}", "base", "implements") for i in range(12)] + [("s", "a", "b", "inherits")], "source_id string, from_symbol string, to_symbol string, kind string")
    e, cut_ = M.dispatch_candidates(rel)
    assert e.count() == 10 and [(r.from_symbol, r.n) for r in cut_.collect()] == [("base", 12)]
    op = "operation_id string, capability string, object_id string, role_id string, file_path string, end_line int, context string, coverage string"
    pe = "capability string, object_id string, role_id string, action string, file_path string, start_line int, context string, coverage string"
    ops = [("ok", "select", "t", None, "f", 9, "prod", "complete"), ("none", "select", "u", None, "f", 9, "prod", "complete"), ("cross", "select", "v", None, "g", 9, "prod", "complete"), ("revoked", "select", "w", None, "f", 9, "prod", "complete"), ("noid", "select", " ", None, "f", 9, "prod", "complete"), ("late", "select", "t", None, "f", 0, "prod", "complete"), ("owner", "ownership", "t", None, "f", 9, "prod", "complete"), ("ctx", "select", "t", None, "f", 9, "test", "complete")]
    perm = [("select", "T", None, "grant", "f", 1, "prod", "complete"), ("select", "v", None, "grant", "f", 1, "prod", "complete"), ("select", "w", None, "revoke", "f", 1, "prod", "complete")]
    got = {r.operation_id: r.status for r in M.permission_status(spark.createDataFrame(ops, op), spark.createDataFrame(perm, pe)).collect()}
    assert got == {"ok": "present-in-scripts", "none": "missing-evidence", "cross": "needs-owner-review", "revoked": "conflicting-evidence", "noid": "unknown", "late": "needs-owner-review", "owner": "needs-owner-review", "ctx": "conflicting-evidence"}


def test_remoting_calls(spark):
    conf = spark.createDataFrame([("c1", "App.Remote.Orders", "s"), ("c2", "orders", "t"), ("c3", None, "s")], "id string, type_name string, source_id string")
    sites = spark.createDataFrame([("x", "Lib.ORDERS.Get", "s"), ("y", "Lib.Other.Get", "s"), ("z", "Orders.Put", "t"), ("w", None, "s")], "id string, target_symbol string, source_id string")
    assert {(r.configure_id, r.site_id) for r in M.remoting_calls(conf, sites).collect()} == {("c1", "x"), ("c2", "z")}


def test_orders_without_a_single_task(spark):
    """No plan of a search without caps sorts everything in one task."""
    edges = spark.createDataFrame([("e1", "a", "b", "calls", "Tier1Semantic"), ("e2", "b", "a", "calls", "Tier1Semantic"), ("e3", "b", "c", "calls", "Tier1Semantic"), ("e4", "b", "c", "calls", "Tier1Semantic")], "edge_id string, source string, target string, kind string, evidence_tier string")
    starts = spark.createDataFrame([("a",)], "node string")
    found, gaps = G.bounded_paths(starts, edges, None, 5, None, None)
    assert sorted(tuple(r.edges) for r in found.collect()) == [("e1", "e3"), ("e1", "e4")] and [r.gap for r in gaps.collect()] == ["CycleDetected"]
    trails = G.edge_simple_paths(starts, edges, 5, None)
    assert sorted(tuple(r.edges) for r in trails.collect()) == [("e1", "e2"), ("e1", "e3"), ("e1", "e4")]
    for df in (found, trails):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "CollectLimit" not in plan and "TakeOrdered" not in plan
    assert {r.node for r in G.reaching(spark.createDataFrame([("c",)], "node string"), edges).collect()} == {"a", "b", "c"}


# ---- diffs and rollups

SIDE = "k string, m string, e string, extra int"


def test_keyed_diff_properties(spark):
    rnd = random.Random(5)
    mk = lambda: [(f"k{rnd.randrange(12)}" if rnd.random() > 0.05 else None, str(rnd.randrange(2)), str(rnd.randrange(2)), 1) for _ in range(30)]
    b, a = spark.createDataFrame(mk(), SIDE), spark.createDataFrame(mk(), SIDE)
    d = lambda x, y, **o: {(r.key, r.change, r.duplicate) for r in D.keyed_diff(x, y, "k", "m", "e", **o).collect()}
    assert d(b, b) == set()
    swap = {"added": "removed", "removed": "added", "changed": "changed"}
    assert {(k, swap[c], u) for k, c, u in d(b, a)} == d(a, b)
    assert d(b, a) == d(b.orderBy(F.rand()), a.orderBy(F.rand()))
    assert d(b, a, multiplicity=False) <= d(b, a)
    assert D.keyed_diff(b.limit(0), a.limit(0), "k", "m").count() == 0


def test_diff_classes(spark):
    df = spark.createDataFrame([("added", False, False, False, False, "AddedEvidence"), ("added", False, False, True, False, "AddedWithBeforeGap"), ("removed", False, False, False, True, "RemovedWithAfterGap"), ("removed", True, False, False, False, "NeedsReviewDiff"), ("changed", False, False, True, True, "ChangedEvidence")], "c string, d boolean, r boolean, rb boolean, ra boolean, want string")
    c = F.col
    no = F.lit(False)
    assert all(r.x == r.want for r in df.select("want", D.classify_combined(c("c"), c("d"), c("r"), no, no, c("rb"), c("ra")).alias("x")).collect())
    one = spark.range(1)
    pick = lambda col: one.select(col).first()[0]
    assert pick(D.classify_single(F.lit("added"), no, F.lit(True), no, no)) == "ChangedEvidence"
    assert pick(D.classify_single(F.lit("removed"), no, no, no, F.lit(True))) == "ChangedWithReducedCoverage"
    assert pick(D.classify_contract(F.lit("added"), no, no, no)) == "AddedWithGap" and pick(D.classify_contract(F.lit("changed"), F.lit(True), no, no)) == "NeedsReviewDiff"
    assert pick(D.classify_portfolio(no, F.lit(True), no, no)) == "PartialAnalysis"
    assert pick(D.impact_of(F.lit("AddedWithBeforeGap"), F.lit("Tier1Semantic"))) == "NeedsReviewImpact" and pick(D.impact_of(F.lit("AddedEvidence"), F.lit("Tier1Semantic"))) == "ProbableStaticImpact"


def test_source_pairing(spark):
    s = "label string, repo string, lang string"
    got = {r.label: (r.status, r.conflicts) for r in D.pair_sources(spark.createDataFrame([("a", "r", "cs"), ("b", "r", "cs"), ("c", "r", None)], s), spark.createDataFrame([("a", "r", "cs"), ("b", "q", "cs"), ("c", "r", "cs"), ("d", "r", "cs")], s), "label", ["repo", "lang"]).collect()}
    assert got == {"a": ("paired", ""), "b": ("identity-conflict", "repo"), "c": ("paired", ""), "d": ("added", "")}


def test_rollups(spark):
    df = spark.createDataFrame([("a", "NeedsReview"), ("a", "Actionable"), ("b", "odd"), ("c", "UnknownAnalysisGap"), ("c", "Actionable"), ("d", None)], "g string, c string")
    assert {r.g: r.x for r in df.groupBy("g").agg(A.precedence(F.col("c"), A.PORTFOLIO, "None").alias("x")).collect()} == {"a": "Actionable", "b": "None", "c": "UnknownAnalysisGap", "d": "None"}
    t = spark.createDataFrame([("Tier1Semantic",), ("Tier3SyntaxOrTextual",)], "t string").agg(A.weakest_tier(F.col("t")).alias("w"), A.strongest_tier(F.col("t")).alias("s")).first()
    assert (t.w, t.s) == ("Tier3SyntaxOrTextual", "Tier1Semantic")


@pytest.mark.parametrize("budget", [0, 7, 1000])
def test_budget_against_a_loop(spark, budget):
    rows = [(i, (i * 7) % 5) for i in range(40)]
    left, want = budget, {}
    for i, w in rows:
        want[i] = min(w, max(0, left))
        left -= w
    got = A.with_budget(spark.createDataFrame(rows, "i int, w int"), ["i"], "w", budget).collect()
    assert {r.i: r.granted for r in got} == want


def test_islands_and_caps(spark):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(["a", "a", None, None, "a", "b"])], "f string, i int, v string")
    assert [(r.v, r.n_rows, r.first_at, r.last_at) for r in A.islands(df, ["f"], ["i"], "v").orderBy("island").collect()] == [("a", 2, 0, 1), (None, 2, 2, 3), ("a", 1, 4, 4), ("b", 1, 5, 5)]
    kept, gap = A.capped(df, [F.col("i")], 4, "Limit")
    assert kept.count() == 4 and [(r.kept, r.cut) for r in gap.collect()] == [(4, 2)] and A.capped(df, [F.col("i")], 6, "Limit")[1].count() == 0


def test_surface_kinds(spark):
    df = spark.createDataFrame([("HttpCallDetected", "{}"), ("Other", '{"surfaceKind":"Package"}'), ("Other", '{"surfaceKind":" x "}'), ("Other", "bad"), ("MessagePublisherSurface", '{"surfaceKind":"odd"}'), ("PackageReferenced", None)], "fact_type string, properties_json string")
    got = [r.k for r in E.with_properties(df).select(E.surface_kind(F.col("fact_type"), F.col("props")).alias("k")).collect()]
    assert got == ["http-client", "package-config", "x", None, "message-unknown", "package-config"]


# ---- further classes and joins


def test_value_origin_reverse_legacy_and_missing_paths(spark):
    e = edges(spark, [("a", "b"), ("b", "Order.id", "argument-passed", "Tier2Structural"), ("a", "c")])
    paths, _ = G.bounded_paths(nodes(spark, "a"), e, nodes(spark, "Order.id", "c"), 4)
    assert [r.value_class for r in G.value_origin(paths, e).collect()] == ["ProbableStaticPath"]
    assert {(r.node, r.classification) for r in G.legacy_class(paths, e).collect()} == {("Order.id", "NeedsReviewPath"), ("c", "StrongStaticPath")}
    t, f = F.lit(True), F.lit(False)
    assert [r[0] for r in spark.range(1).select(G.reverse_class(F.lit(1), f, f, t)).collect()] == ["NeedsReviewPath"]
    owners = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("z", "s3")], "node string, source_id string")
    gaps = G.no_path_gaps(nodes(spark, "a", "b", "z"), paths, e, owners, spark.createDataFrame([("s2",)], "source_id string"))
    assert {(r.start, r.gap) for r in gaps.collect()} == {("b", "UnknownAnalysisGap"), ("z", "NoPathFound")}
    rel = spark.createDataFrame([(f"m{i + 1}", f"m{i}", "overrides") for i in range(8)] + [("m0", "m8", "overrides")], "from_symbol string, to_symbol string, kind string")
    assert G.override_candidates(rel, 5).where("base = 'm0'").count() == 5
    assert [r.display_name for r in G.duplicate_nodes(spark.createDataFrame([("s", "x"), ("s", "x"), ("t", "x")], "source_id string, display_name string")).collect()] == ["x"]


def test_two_indexes_and_small_joins(spark):
    ends = "id string, path_key string, method string, parameters array<string>, file_path string, start_line int"
    c = spark.createDataFrame([("c1", "/a/{}", "GET", ["id"], "f", 1), ("c2", "/a/{}", "ANY", ["id"], "f", 1), ("c3", "/x", "GET", [], "f", 1)], ends)
    s = spark.createDataFrame([("s1", "/a/{?}", "GET", ["key"], "f", 1), ("s2", "/b", "ANY", [], "f", 1)], ends)
    got = {(r.classification, r.client_id, r.server_id, r.note) for r in M.align_two_indexes(c, s).collect()}
    assert got == {("Matched", "c1", "s1", "parameter names differ"), ("ClientCallNoServerEndpoint", "c2", None, None), ("ClientCallNoServerEndpoint", "c3", None, None), ("ServerEndpointNoClientMatch", None, "s2", None)}
    rows = spark.createDataFrame([("r", "1; 2;;9"), ("q", None)], "r string, ids string")
    ev = spark.createDataFrame([("1", "a"), ("2", "b")], "fact_id string, v string")
    assert {(r.r, r.v) for r in M.enrich(rows, ev, "ids", "fact_id", ["v"]).collect()} == {("r", "a"), ("r", "b")}
    assert M.selected_only(ev, ev.where("v = 'a'"), ["fact_id"]).count() == 1
    kv = "k string, v string"
    ch = M.context_changes(spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1")], kv), spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], kv), "k", "v")
    assert {(r.k, r.same) for r in ch.collect()} == {("a", True), ("b", False), ("c", False)}
    v = spark.createDataFrame([("v1", "Name", "N.Order", "/o"), ("v2", "name", "Order", None), ("v3", "name", "Order", "/x")], "view_id string, property string, model_type string, path_key string")
    m = spark.createDataFrame([("p1", "NAME", "Order", "/o")], "property_id string, property string, model_type string, path_key string")
    assert {r.view_id for r in M.property_bridges(v, m).collect()} == {"v1", "v2"}


def test_descriptors_hide_unsafe_labels(spark):
    df = E.with_properties(spark.createDataFrame([("1", '{"entityName":"Order"}'), ("2", '{"entityName":"Order"}'), ("3", '{"name":"x://y"}'), ("4", "{}")], "fact_id string, properties_json string"))
    got = {r.fact_id: (r.display_name[:5], r.n_same, r.redaction) for r in M.data_descriptors(df).collect()}
    assert got == {"1": ("Order", 2, None), "2": ("Order", 2, None), "3": ("hash:", 1, "unsafe-label")}


def cut_sizes(monkeypatch) -> list[int]:
    """The numbers of rows that the graph operators write from now on."""
    sizes, real = [], G.cut

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(G, "cut", counted)
    return sizes


def layers(width: int, n: int) -> list[tuple[str, str]]:
    """A root and n layers, each node of which leads to all of the next."""
    return [("r", f"0.{j}") for j in range(width)] + [(f"{k}.{i}", f"{k + 1}.{j}") for k in range(n - 1) for i in range(width) for j in range(width)]


def test_large_levels_without_caps_are_not_written(spark, monkeypatch):
    rnd = random.Random(5)
    loops = sorted({(f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}") for _ in range(30)})
    for pairs, ends in ((layers(5, 4), None), (layers(5, 4), ["3.1", "3.2"]), (loops, None), (loops, ["n7"])):
        starts, to = nodes(spark, "r", "n0", "n1"), ends and nodes(spark, *ends)
        found = lambda: [sorted(map(str, df.collect())) for df in G.bounded_paths(starts, edges(spark, pairs), to, 4, None, None)]
        want = found()
        with monkeypatch.context() as m:
            m.setattr(G, "STREAM_ROWS", 30)
            sizes = cut_sizes(m)
            assert found() == want
        assert max(sizes) <= max(30, len(pairs), 125 if pairs is loops else 0) and (pairs is loops or len(want[0]) >= 250)


def test_reach_without_written_pairs(spark, monkeypatch):
    rnd = random.Random(8)
    sparse = sorted({(f"n{rnd.randrange(150)}", f"n{rnd.randrange(150)}") for _ in range(190)})
    ring = [(f"n{i}", f"n{(i + 1) % 150}") for i in range(150)]
    starts = nodes(spark, "alone", *[f"n{i}" for i in range(150)])
    for pairs, depth, back in ((sparse, None, False), (sparse, 3, True), (ring, None, False), (ring, 2, False), ([], None, False)):
        e = edges(spark, pairs) if pairs else edges(spark, ring).limit(0)
        with monkeypatch.context() as m:
            sizes = cut_sizes(m)
            got = sorted(map(tuple, G.reachable(starts, e, depth, back).collect()))
        assert len(got) == len(set(got)) and max(sizes) <= len(pairs)
        want, to = [], {}
        for a, b in pairs:
            to.setdefault(b if back else a, []).append(a if back else b)
        for s in ["alone", *[f"n{i}" for i in range(150)]]:
            seen, level, d = {s}, [s], 0
            want.append((s, s, 0))
            while level and (depth is None or d < depth):
                d += 1
                level = sorted({y for x in level for y in to.get(x, ())} - seen)
                seen |= set(level)
                want += [(s, x, d) for x in level]
        assert got == sorted(want)
    assert sorted(map(tuple, G.reachable(starts, edges(spark, sparse), 3, max_held=0).collect())) == sorted(map(tuple, G.reachable(starts, edges(spark, sparse), 3).collect()))


def test_gaps_are_counted_without_ways(spark, monkeypatch):
    rnd = random.Random(4)
    loops = [(f"n{rnd.randrange(8)}", f"n{rnd.randrange(8)}") for _ in range(24)]
    loops += [(f"r{i}", f"n{i % 3}") for i in range(6)] + loops[:4]
    for pairs, depth in ((loops, 4), (loops, 1), (loops, 0), (loops, 2), (layers(5, 4), 4)):
        starts, e = nodes(spark, "r", "r0", "r1", "r2", "n0", "n5", "alone"), edges(spark, pairs)
        gaps = G.bounded_paths(starts, e, None, depth, None, None, guard=False)[1]
        want = {r.gap: r["count"] for r in gaps.groupBy("gap").count().collect()}
        with monkeypatch.context() as m:
            m.setattr(G, "STREAM_ROWS", 30)
            sizes = cut_sizes(m)
            assert {r.gap: r.n for r in G.gap_counts(starts, e, depth).collect()} == want
        assert max(sizes) <= len(pairs) + 7
    assert G.gap_counts(nodes(spark, "a"), edges(spark, [("a", "b")]), 3).count() == 0
