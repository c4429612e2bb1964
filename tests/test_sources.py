"""Readers and sinks: round trips, degraded inputs, and streams run to their end."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.operators import evidence as E
from factloom.operators import extract as X
from factloom.sources import readers, sinks
from factloom.streaming import facts as stream

ROW = {n: f"v-{n}" for n in S.FACT.names} | {"start_line": 3, "end_line": 4, "properties_json": '{"b":"2","a":"1"}', "project_path": None}


def test_facts_ndjson_round_trip(spark, tmp_path):
    df = spark.createDataFrame([ROW, ROW | {"fact_id": "f2", "properties_json": None}], S.FACT)
    sinks.write_facts_ndjson(df, f"{tmp_path}/facts")
    back = {r.fact_id: r for r in readers.facts_ndjson(spark, f"{tmp_path}/facts").collect()}
    assert back["v-fact_id"].asDict() == ROW | {"properties_json": '{"a":"1","b":"2"}'}
    assert back["f2"].properties_json == "{}"


def test_index_parquet_degrades(spark, tmp_path):
    df = spark.createDataFrame([ROW], S.FACT).drop("snippet_hash").withColumn("extra", F.lit(1))
    sinks.write_index({"facts": df}, str(tmp_path))
    tables, absent = readers.index_parquet(spark, str(tmp_path))
    assert set(absent) == set(S.TABLES) - {"facts"} and tables["symbols"].count() == 0
    got = tables["facts"].first()
    assert got.snippet_hash is None and got.extra == 1 and got.fact_type == "v-fact_type"
    plan = tables["facts"].where(F.col("fact_type") == "x")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan or tables["facts"].where(F.col("fact_type") == "x").count() == 0


def test_index_sqlite(spark, tmp_path):
    paths = []
    for k in range(2):
        paths.append(f"{tmp_path}/i{k}.sqlite")
        with sqlite3.connect(paths[-1]) as c:
            c.execute("create table facts (fact_id text, scan_id text, start_line integer)")
            c.executemany("insert into facts values (?, ?, ?)", [(f"f{k}-{i}", f"s{k}", i) for i in range(50)])
    got = readers.index_sqlite(spark, paths, "facts")
    assert got.count() == 100 and got.where("repo is not null").count() == 0 and got.agg(F.sum("start_line")).first()[0] == 2 * sum(range(50))
    assert readers.index_sqlite(spark, paths, "symbols").count() == 0


def test_index_kind():
    assert readers.index_kind(["facts", "scan_manifest"]) == "single" and readers.index_kind(["index_sources", "combined_facts", "facts"]) == "combined"
    with pytest.raises(ValueError):
        readers.index_kind([])


def write(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_deltas(spark, tmp_path):
    v1 = readers.contract_delta(spark, write(tmp_path / "a.json", {"contract": "c", "changes": [{"element": "T.M", "changeType": "removed"}]})).collect()
    assert [(r.change_id, r.element, r.change_type) for r in v1] == [("change-1", "T.M", "removed")]
    v2 = readers.contract_delta(spark, write(tmp_path / "b.json", {"version": "2", "changes": [{"id": "x", "kind": "member", "changeType": "changed", "reference": {"typeName": "T", "member": "M"}}]})).collect()
    assert [(r.change_id, r.element, r.kind) for r in v2] == [("x", "T.M", "member")]
    pk = readers.package_delta(spark, write(tmp_path / "p.json", {"version": "package-delta.v1", "changes": [{"id": "1", "packageName": "a", "oldVersion": "1", "newVersion": "2"}]})).collect()
    assert [(r.change_id, r.package_name, r.new_version) for r in pk] == [("1", "a", "2")]
    ok = {"version": "sql-schema-delta.v1", "changes": [{"id": "1", "kind": "column", "changeType": "dropped", "reference": {"table": "Orders", "column": "Id"}}]}
    assert [(r.table_name, r.column_name) for r in readers.sql_schema_delta(spark, write(tmp_path / "s.json", ok)).collect()] == [("orders", "id")]
    for bad in ({**ok, "changes": ok["changes"] * 2}, {**ok, "changes": [{"id": "1", "reference": {"x": "select 1"}}]}):
        with pytest.raises(ValueError):
            readers.sql_schema_delta(spark, write(tmp_path / "t.json", bad))
    pf = readers.portfolio_manifest(spark, write(tmp_path / "m.json", {"portfolioId": "p", "snapshotId": "s", "inputs": [{"label": "l", "indexPath": "x", "group": "g", "roleTags": ["a"]}]})).collect()
    assert pf[0].label == "l" and readers.observed_evidence(spark, write(tmp_path / "o.json", {"observedEvidence": [{"label": "l", "safeMetadata": {"a": "1"}}]})).count() == 1


def test_inventory_and_packages(spark, tmp_path):
    for name, text in {"a/x.cs": "class A { }", "a/node_modules/y.js": "1", "b/z.py": "x = 1", "b/app.csproj": '<PackageReference Include="Lib.A" Version="1.2.0" />', "b/package.json": '{"dependencies": {"left-pad": "^1.2.3"}}', "b/requirements.txt": "numpy==1.0\n# x\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    inv = readers.inventory(spark, str(tmp_path), exclude=["a/**"])
    assert {(r.relative_path, r.kind) for r in inv.collect()} == {("b/z.py", "Python"), ("b/app.csproj", "Project"), ("b/package.json", "Json"), ("b/requirements.txt", "File")}
    assert {(r.ecosystem, r.package_name, r.version) for r in readers.project_packages(inv).collect()} == {("nuget", "Lib.A", "1.2.0"), ("npm", "left-pad", "^1.2.3"), ("pypi", "numpy", "1.0")}


def test_config_keys_never_show_values(spark):
    rows = [("s", "a.json", '{"A": {"B": "secret", "C": [1, {"D": 2}]}}'), ("s", "b.config", '<add key="K" value="secret" />'), ("s", "c.json", "bad"), ("s", "d.json", None)]
    got = readers.config_keys(spark.createDataFrame(rows, "scan_id string, relative_path string, content string")).collect()
    assert {(r.relative_path, r.key_path) for r in got} == {("a.json", "A:B"), ("a.json", "A:C:0"), ("a.json", "A:C:1:D"), ("b.config", "K")}


def test_reports_and_graphs(spark):
    df = spark.createDataFrame([(i, "a|b", "c") for i in range(5)], "source int, kind string, target string")
    text = sinks.markdown(df, "T", ["source"], cap=3)
    assert text.count("\n| ") == 5 and "2 more rows were cut" in text and "a\\|b" in text
    chart = sinks.mermaid(spark.createDataFrame([("a", "calls", "b"), ("a", "calls", "b")], "source string, kind string, target string"))
    assert chart == 'flowchart LR\n  n0["a"]\n  n1["b"]\n  n0 -->|calls| n1\n'
    ids = [r.chunk_id for r in sinks.evidence_chunks(df, ["source"], ["kind"]).collect()]
    assert len(set(ids)) == 5 and ids == [r.chunk_id for r in sinks.evidence_chunks(df.withColumn("kind", F.lit("z")), ["source"], ["kind"]).collect()]


def test_combined_index_fills_missing_columns(spark):
    a = spark.createDataFrame([("f1", "s", "x")], "fact_id string, scan_id string, extra string")
    b = spark.createDataFrame([("f1", "s")], "fact_id string, scan_id string")
    got = E.combine({"a": {"facts": a}, "b": {"facts": b}})["combined_facts"].collect()
    assert len({r.combined_fact_id for r in got}) == 2 and {r.extra for r in got} == {"x", None}


def test_streams_end_like_batches(spark, tmp_path):
    rows = [("s", f"f{i % 30}", "T", f"2025-01-0{1 + i % 3} 00:00:00") for i in range(60)]
    df = spark.createDataFrame(rows, "scan_id string, fact_id string, fact_type string, t string").select("scan_id", "fact_id", "fact_type", F.col("t").cast("timestamp").alias("ingested_at"))
    df.write.parquet(f"{tmp_path}/in")
    counts = stream.counts_by_window(stream.fact_stream(spark, f"{tmp_path}/in", df.schema, "30 days"))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from counts").first()[0] == 30
    ev = spark.createDataFrame([(1, f"2025-01-01 00:{m:02d}:00") for m in (0, 10, 50)], "user_id int, t string").select("user_id", F.col("t").cast("timestamp").alias("ts"))
    assert {r.n for r in stream.sessions(ev).collect()} == {2, 1}


# ---- markup and syntax trees

ITEM = "scan_id string, relative_path string, content string, kind string"


def items(spark, *rows):
    return spark.createDataFrame([("s", p, t, "z") for p, t in rows], ITEM)


def test_xml_is_read_safely(spark):
    from factloom.sources import markup

    bomb = '<!DOCTYPE x [<!ENTITY a "aaaa"><!ENTITY b "&a;&a;">]><x>&b;</x>'
    good = '\ufeff<?xml version="1.0"?>\n<configuration xmlns:p="urn:x">\n <appSettings><add value="1" key="A:B"/></appSettings>\n <connectionStrings><add name="Main" connectionString="secret"/></connectionStrings>\n <p:system.serviceModel><client><endpoint name="e" address="http://h/x" binding="basicHttpBinding" contract="I.Orders"/></client></p:system.serviceModel>\n</configuration>'
    df = items(spark, ("a/Web.config", good), ("b.config", bomb), ("c.xml", "<a><b></a>"), ("d.config", None), ("e.config", ""), ("f.json", good))
    el = markup.xml_elements(df)
    assert {(r.relative_path, r.gap) for r in el.where("gap is not null").collect()} == {("b.config", "document-type-refused"), ("c.xml", "not-well-formed")}
    assert {(r.kind, r.key, r.line_no) for r in markup.settings(el).collect()} == {("setting", "A:B", 3), ("connection-string", "Main", 4)}
    assert [(r.side, r.binding, r.contract, r.has_address) for r in markup.service_endpoints(el).collect()] == [("client", "basicHttpBinding", "I.Orders", True)]
    assert markup.xml_elements(df.limit(0)).count() == 0


def test_project_diagnostics(spark):
    from factloom.sources import markup

    old = '<Project ToolsVersion="4.0"><PropertyGroup><TargetFrameworkVersion>v4.5</TargetFrameworkVersion><ProjectTypeGuids>{X};{C8D11400-126E-41CD-887F-60BD40844F9E}</ProjectTypeGuids></PropertyGroup></Project>'
    df = items(spark, ("a/Old.csproj", old), ("New.csproj", '<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup></Project>'), ("Bad.vbproj", "<Project>"), ("x.config", old))
    got = {(r.relative_path, r.code, r.value) for r in markup.project_diagnostics(markup.xml_elements(df)).collect()}
    assert got == {("a/Old.csproj", "NonSdkStyleProject", None), ("a/Old.csproj", "OldMsBuildToolsVersion", "4.0"), ("a/Old.csproj", "TargetFramework", "v4.5"), ("a/Old.csproj", "UnsupportedProjectType", "database-project"), ("New.csproj", "TargetFramework", "net8.0"), ("Bad.vbproj", "UnknownLegacyProjectFormat", None)}


def test_data_models_of_mapping_files(spark):
    from factloom.sources import markup

    dbml = '<Database><Table Name="dbo.Orders"><Type Name="Order"><Column Name="Id" Type="System.Int32"/><Association Name="O_L" Member="Lines" Type="Line"/></Type></Table></Database>'
    hbm = '<hibernate-mapping><class name="Item" table="items"><id name="Key"/><property name="Size" type="int"/></class></hibernate-mapping>'
    got = {(r.format, r.item, r.owner, r.name) for r in markup.data_models(markup.xml_elements(items(spark, ("m.dbml", dbml), ("i.hbm.xml", hbm)))).collect()}
    assert got == {("dbml", "entity", None, "dbo.Orders"), ("dbml", "property", "dbo.Orders", "Id"), ("dbml", "relation", "dbo.Orders", "O_L"), ("hbm", "entity", None, "Item"), ("hbm", "property", "Item", "Key"), ("hbm", "property", "Item", "Size")}


def test_python_syntax_trees(spark):
    text = "import os.path\nfrom .a import b\nclass C:\n    def m(self):\n        return requests.get('http://h/x', timeout=1)\nasync def f():\n    def g(): pass\n'class No: pass'\n"
    rows = X.python_syntax(items(spark, ("a.py", text), ("bad.py", "def f(:"), ("n.py", None), ("a.txt", "class D: pass"))).collect()
    got = {(r.kind, r.name, r.owner, r.line_no, r.argument) for r in rows if r.gap is None}
    assert got == {("import", "os.path", None, 1, None), ("import", ".a.b", None, 2, None), ("class", "C", None, 3, None), ("method", "m", "C", 4, None), ("call", "requests.get", "C.m", 5, "http://h/x"), ("function", "f", None, 6, None), ("function", "g", "f", 7, None)}
    assert [(r.relative_path, r.gap) for r in rows if r.gap] == [("bad.py", "not-parsed")]


def test_call_sites_views_and_swift(spark):
    cs = 'var r = await client.GetStringAsync("https://h/api/x");\n[HttpGet("orders/{id}")]\nvar c = new SqlCommand("select 1", k); bus.Publish<Order>("orders.created", o);\nbus.Subscribe("orders.paid", h);\n// nothing'
    got = {(r.kind, r.name, r.line_no) for r in X.integration_calls(items(spark, ("a.cs", cs), ("b.txt", cs), ("c.cs", None))).collect()}
    assert got == {("http-client", "https://h/api/x", 1), ("http-route", "orders/{id}", 2), ("sql-text", "select 1", 3), ("message-publish", "orders.created", 3), ("message-consume", "orders.paid", 4)}
    view = '@model Shop.OrderModel\n<input asp-for="Total" /> @Html.TextBoxFor(m => m.Customer.Name)\n<form asp-controller="Orders" asp-action="Save">@ViewBag.Title</form>'
    got = {(r.kind, r.name, r.model_type) for r in X.view_bindings(items(spark, ("v.cshtml", view))).collect()}
    assert got == {("bound", "Total", "Shop.OrderModel"), ("helper", "Customer.Name", "Shop.OrderModel"), ("controller", "Orders", "Shop.OrderModel"), ("action", "Save", "Shop.OrderModel"), ("untyped", "ViewBag.Title", "Shop.OrderModel")}
    swift = 'import Foundation\npublic final class Api {\n  func load() { let u = URL(string: "https://h/x") ; UserDefaults.standard.set(1) }\n}'
    assert {(r.kind, r.name) for r in X.swift_syntax(items(spark, ("a.swift", swift))).collect()} == {("import", "Foundation"), ("type", "Api"), ("function", "load"), ("http-client", "https://h/x"), ("storage", "UserDefaults")}


def test_sql_contexts(spark):
    sql = "-- x-sql-context: engineFamily=postgres; executionMode=manual\nselect 1;\n-- sql-context: nope=1\n--sql-context: engineFamily=A\n-- sql-context: stepKind=a; stepKind=b\n-- sql-context:\n"
    got = {r.line_no: (r.fields and r.fields["engineFamily"], r.fields and r.fields["serverRole"], r.gap) for r in X.sql_directives(items(spark, ("a.sql", sql), ("b.txt", sql))).collect()}
    assert got == {1: ("postgres", "unknown", None), **{n: (None, None, "invalid-context-directive") for n in (3, 4, 5, 6)}}
    side = '{"schemaVersion": "v1", "steps": [{"statementOrdinal": 1, "engineFamily": "postgres"}, {"statementOrdinal": 2}, {"statementOrdinal": 2}, {"statementOrdinal": 0}]}'
    rows = X.sql_sidecars(items(spark, ("a.sql.context.json", side), ("b.sql.context.json", "{"), ("c.sql.context.json", "[]"), ("d.json", side))).collect()
    assert sorted((r.relative_path, r.ordinal or -1, r.gap) for r in rows if r.gap) == [("a.sql", -1, "invalid-context-sidecar-step"), ("a.sql", 2, "invalid-context-sidecar-step"), ("a.sql", 2, "invalid-context-sidecar-step"), ("b.sql", -1, "invalid-context-sidecar"), ("c.sql", -1, "invalid-context-sidecar")]
    assert [(r.relative_path, r.ordinal, r.fields["engineFamily"]) for r in rows if not r.gap] == [("a.sql", 1, "postgres")]


def test_project_packages_in_any_attribute_order(spark):
    proj = "<Project><ItemGroup><PackageReference Version='2.0' Include='B' /><PackageReference Include=\"A\"><Version>1.0</Version></PackageReference></ItemGroup></Project>"
    got = {(r.package_name, r.version) for r in readers.project_packages(items(spark, ("x/P.csproj", proj), ("packages.config", '<packages><package version="3" id="C" /></packages>'))).collect()}
    assert got == {("A", "1.0"), ("B", "2.0"), ("C", "3")}


def test_deltas_are_validated(spark, tmp_path):
    def delta(text):
        (tmp_path / "d.json").write_text(text)
        return readers.contract_delta(spark, str(tmp_path / "d.json"))

    assert [r.change_id for r in delta('{"version": "2", "changes": [{"element": "A.B"}]}').collect()] == ["change-1"]
    for bad in ('{"version": "9", "changes": [{"element": "A"}]}', '{"version": "1", "changes": [{"id": "x", "element": "A"}, {"id": "x", "element": "B"}]}', '{"version": "1", "changes": [{"id": "x"}]}'):
        with pytest.raises(ValueError):
            delta(bad)


def test_existence_is_asked_of_the_file_system(spark, tmp_path):
    assert readers.exists(spark, f"file:{tmp_path}") and not readers.exists(spark, f"file://{tmp_path}/none")
    with pytest.raises(Exception):  # an unknown scheme is an error, not an absent table
        readers.index_parquet(spark, "nosuch://x/y")


def test_a_diagram_says_what_it_cut(spark):
    edges = spark.createDataFrame([(f"a{i}", "calls", "b") for i in range(5)], "source string, kind string, target string")
    assert "3 more edges were cut" in sinks.mermaid(edges, 2) and "more edges" not in sinks.mermaid(edges, 5)
