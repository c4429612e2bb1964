"""Scalar functions: fixed cases of SQL shapes and routes, and texts that are null, blank or odd."""

import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.functions import routes as R
from factloom.functions import sqltext as Q
from factloom.functions import text as T


def h(s, n=32):
    return hashlib.sha256(s.encode()).hexdigest()[:n]


# (sql, operation, tables, columns, normalised text)
SHAPES = [
    ("SELECT a, b FROM t WHERE a = 42;", "SELECT", ["t"], ["a", "b"], "SELECT a, b FROM t WHERE a = 42"),
    ("select x.a, count(*) as n, coalesce(b, c) d from s.t x join u y on x.k = y.k", "SELECT", ["t", "u"], ["a", "n", "d"], None),
    ("INSERT INTO t (a, b) VALUES (1, 'it''s');", "INSERT", ["t"], ["a", "b"], "INSERT INTO t (a, b) VALUES (1, ' ')"),
    ("UPDATE [t] SET a = f(1, 2), b = 'x' WHERE c = 1", "UPDATE", [], ["a", "b"], None),
    ("CREATE TABLE IF NOT EXISTS t (a int, b numeric(12, 2) default 0, primary key (a));", "CREATE", ["t"], ["a", "b"], None),
    ("DROP TABLE t;;", "DROP", ["t"], [], "DROP TABLE t"),
    ("-- x\n/* y */ DELETE FROM t -- z", "DELETE", ["t"], [], "DELETE FROM t"),
    ("SELECT a FROM (SELECT a FROM inner_t) r", "SELECT", [], ["a"], None),
    ("WITH r AS (SELECT a FROM t) SELECT a FROM r", "", [], [], None),
    ("SELECT a FROM t WHERE n = 'a -- b'", "SELECT", ["t"], ["a"], "SELECT a FROM t WHERE n = 'a"),
    ("", "", [], [], ""),
]


def test_sql_shapes(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SHAPES)], "i int, q string").select("i", Q.shape(F.col("q")).alias("s"))
    for r in df.collect():
        sql, op, tables, columns, plain = SHAPES[r.i]
        assert (r.s.operation, r.s.text_hash) == (op, h(sql)), sql
        assert r.s.tables == tables, sql
        if plain is not None:
            assert r.s.shape_hash == h(plain), sql
        if "x.a" not in sql:
            assert r.s.columns == columns, sql


def test_sql_shapes_of_any_nesting(spark):
    deep = lambda x, n: "(" * n + x + ")" * n
    rows = [
        (f"SELECT a, f({deep('b, c', 30)}) d, {deep('e', 25)} g FROM t JOIN u ON {deep('1', 40)} = 1", ["t", "u"], ["a", "d", "g"]),
        (f"SELECT a FROM {deep('SELECT z FROM hidden', 15)} x JOIN v ON 1 = 1", ["v"], ["a"]),
        (f"CREATE TEMPORARY TABLE IF NOT EXISTS t (a int default {deep('1, 2', 20)}, b int, constraint c check (a in (1, 2)))", ["t"], ["a", "b"]),
        ("DROP t", ["t"], []), ("ALTER TABLE s.t ADD x int", ["t"], []), ("TRUNCATE TABLE t", ["t"], []), ("SELECT a FROM t WHERE (b", ["t"], ["a"]), ("UPDATE t SET a = 1 FROM u", ["t"], ["a"]), ("INSERT INTO t SELECT b FROM u", ["t"], []),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, q string").select("i", Q.shape(F.col("q")).alias("s"))
    for r in df.collect():
        assert (r.s.tables, r.s.columns) == rows[r.i][1:], rows[r.i][0][:60]


def test_shape_properties_leave_out_what_is_empty(spark):
    p = spark.createDataFrame([("CALL f('x')",)], "q string").select(Q.shape_properties(F.col("q"), "file").alias("p")).first().p
    assert p == {"textHash": h("CALL f('x')"), "sqlSourceKind": "file", "queryShapeHash": h("CALL f(' ')"), "operationName": "CALL"}


def test_statements_and_kinds(spark):
    script = "-- a;b\nset role x;\ngrant select on t to y;\n\nselect 'a;b' from \"c;d\"; do $$ begin; end $$;"
    got = Q.statements_of(script)
    assert [(s[0], s[1]) for s in got] == [(1, 2), (2, 3), (3, 5), (4, 5)]
    assert Q.statements_of(None) == [] and Q.statements_of("  ;; ") == []
    df = spark.createDataFrame([(script,)], "q string").select(F.explode(Q.statements(F.col("q"))).alias("s"))
    assert [r.k for r in df.select(Q.statement_kind(F.col("s.text")).alias("k")).collect()] == ["context", "permission", "read", "call"]


ROUTES = [
    ("/api/Orders/{id:int?}", "/api/orders/{?}", ["/api/orders", "/api/orders/{}"]),
    ("https://h.x/api/A/{id}?q=1&b=2#f", "/api/a/{}", ["/api/a/{}"]),
    ("~/a//b/", "/a/b", ["/a/b"]),
    ("x/{a?}/{b?}", "/x/{?}/{?}", ["/x", "/x/{}", "/x/{}/{}"]),
    ("{*rest}", "/{}", ["/{}"]),
    (None, "/", ["/"]),
    ("/v/%7Bid%7D/C+D", "/v/{}/c+d", ["/v/{}/c+d"]),
    ("/a/{p1?}/{p2?}/{p3?}/{p4?}/{p5?}/{p6?}", "/a" + "/{?}" * 6, ["/a" + "/{}" * 6]),
]


def test_routes(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ROUTES)], "i int, r string").select("i", R.normalize(F.col("r"))["key"].alias("k")).withColumn("e", R.expand_keys(F.col("k")))
    for r in df.collect():
        assert (r.k, r.e) == ROUTES[r.i][1:], ROUTES[r.i]


def test_route_parts_prefix_and_controller(spark):
    row = spark.createDataFrame([("[controller]/{id:int}/x?b=1&a=2&a=3", "/api/", "Orders")], "r string, p string, c string").select(R.normalize(F.col("r"), F.col("p"), F.col("c")).alias("n")).first().n
    assert row.template == "/api/Orders/{id}/x" and row.query == ["a", "b"] and row.constraints == ["id:int"] and row.parameters == ["id"]


def test_method_compatibility_differs_between_reports(spark):
    df = spark.createDataFrame([("get,post", "POST", True, False), ("GET", None, True, True), (None, "PUT", True, False), ("GET", "PUT", False, False)], "c string, s string, a boolean, b boolean")
    c, s = R.methods(F.col("c")), R.methods(F.col("s"))
    got = df.select("a", "b", R.methods_compatible(c, s).alias("x"), R.methods_compatible_two_index(F.get(c, F.lit(0)), F.get(s, F.lit(0))).alias("y")).collect()
    assert all((r.a, r.b) == (r.x, r.y) for r in got)


@pytest.mark.parametrize("name,want", [("A.B<T>.Do(int,  string)", ("do", "b", "int,string")), ("global::X.Y", ("y", "x", None)), ("Run", ("run", None, None)), ("two words", None), ("x):y", None), ("", None), (None, None), ("9a", None)])
def test_symbol_alias(spark, name, want):
    a = spark.createDataFrame([(name,)], "n string").select(T.symbol_alias(F.col("n")).alias("a")).first().a
    assert (None if a is None else tuple(a)) == want


def test_symbol_parts(spark):
    df = spark.createDataFrame([("N.T.T(int x = 1)",), ("N.T.Run",), ("Alone",), ("N.T..ctor",), (None,)], "s string")
    got = df.select(T.containing_type(F.col("s")).alias("t"), T.member_name(F.col("s")).alias("m"), T.is_constructor(F.col("s")).alias("c"), T.parameter_symbol(F.col("s")).alias("p")).collect()
    assert [(r.t, r.m, r.c) for r in got[:3]] == [("N.T", "T", True), ("N.T", "Run", False), (None, "Alone", False)]
    assert got[4].c is False and got[4].p is None


def test_paths_versions_and_destinations(spark):
    df = spark.createDataFrame([("a\\b.cs", "1.0", "Orders.created"), ("/etc/x", "git+ssh://h/x", "orders.*"), ("C:\\x", "  ", "a ${x}"), (None, None, ""), ("s3://b/x", "^1.2", "https://h/q")], "p string, v string, d string")
    rows = df.select(T.safe_path(F.col("p")).alias("p"), *[c.alias(f"v{i}") for i, c in enumerate(T.safe_version(F.col("v")))], T.destination_identity(F.col("d")).alias("d")).collect()
    assert rows[0].p == "a/b.cs" and rows[1].p == "absolute-path-hash:" + h("/etc/x", 16) and rows[2].p.startswith("absolute") and rows[3].p == "n/a" and rows[4].p.startswith("absolute")
    assert (rows[0].v0, rows[1].v0, rows[1].v2, rows[2].v0, rows[4].v0) == ("1.0", None, "unsafe-package-version", None, "^1.2")
    assert [r.d.status for r in rows] == ["static", "dynamic", "dynamic", "unknown", "hashed"] and rows[0].d.key == "orders.created"


def test_hashes_keep_empty_fields_and_ignore_order(spark):
    df = spark.createDataFrame([("a", None, "b", {"x": "1", "y": " "}, {"y": "", "x": "1"})], "a string, n string, b string, m map<string,string>, k map<string,string>")
    r = df.select(T.piped_id("p-", 20, F.col("a"), F.col("n"), F.col("b")).alias("i"), (T.metadata_hash(F.col("m")) == T.metadata_hash(F.col("k"))).alias("same"), T.first_value(F.col("m"), "y", "x").alias("v")).first()
    assert r.i == "p-" + h("a||b", 20) and r.same and r.v == "1"


def test_edge_kinds_rules_and_globs(spark):
    df = spark.createDataFrame([("Implements_Interface",), (" call ",), ("x y",)], "k string")
    assert [r[0] for r in df.select(T.edge_kind(F.col("k"))).collect()] == ["implements-interface", "calls", "x-y"]
    assert [r[0] for r in df.select(T.edge_kind(F.col("k"), synonyms=False)).collect()][1] == "call"
    assert spark.range(1).select(T.rule_family(F.lit("a.b.v12"))).first()[0] == "a.b"
    import re
    assert re.match(T.glob_pattern("src/**/*.cs"), "src/a/b.cs") and re.match(T.glob_pattern("src/**/*.cs"), "src/b.cs") and not re.match(T.glob_pattern("*.cs"), "a/b.cs")
