"""Facts from source texts that patterns can tell: declarations, SQL statements, permissions, links, configuration.

What needs a compiler (resolved calls, argument flow) is left to upstream producers, whose facts are read as they are.
Defined results: null and empty contents give no rows; line numbers count from 1; a statement that no pattern knows has
the kind `other`; names keep their case.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sqltext as Q
from ..functions import text as T
from .rollup import islands

#: How declarations of types look, by extension.
TYPE_PATTERNS = {
    "cs": r"^\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|file|ref)\s+)*(class|interface|struct|record|enum)\s+([A-Za-z_]\w*)",
    "java": r"^\s*(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(class|interface|enum|record)\s+([A-Za-z_]\w*)",
    "ts": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(class|interface|enum|type)\s+([A-Za-z_]\w*)",
    "js": r"^\s*(?:export\s+)?(?:default\s+)?(class)\s+([A-Za-z_]\w*)",
    "py": r"^\s*(class)\s+([A-Za-z_]\w*)",
}


def lines(files: DataFrame) -> DataFrame:
    """(scan_id, relative_path, ext, line_no, line) of every line of the items."""
    ext = F.lower(F.regexp_extract("relative_path", r"\.([A-Za-z0-9]+)$", 1))
    rows = files.where(F.col("content").isNotNull()).select("scan_id", "relative_path", ext.alias("ext"), F.posexplode(F.split("content", "\n")).alias("i", "line"))
    return rows.select("scan_id", "relative_path", "ext", (F.col("i") + 1).alias("line_no"), "line")


def declared_types(files: DataFrame) -> DataFrame:
    """(scan_id, relative_path, line_no, keyword, name) of the types that source lines declare."""
    wanted = files.where(F.lower("relative_path").rlike(r"\.(?:cs|java|ts|js|py)$"))
    word = name = F.lit("")
    for ext, pattern in TYPE_PATTERNS.items():
        word = F.when(F.col("ext") == ext, F.regexp_extract("line", pattern, 1)).otherwise(word)
        name = F.when(F.col("ext") == ext, F.regexp_extract("line", pattern, 2)).otherwise(name)
    return lines(wanted).withColumns({"keyword": word, "name": name}).where(F.col("name") != "").select("scan_id", "relative_path", "line_no", "keyword", "name")


def sql_statements(files: DataFrame) -> DataFrame:
    """(scan_id, relative_path, ordinal, start_line, end_line, text, kind) of the statements of SQL files."""
    rows = files.where(F.lower("relative_path").endswith(".sql") & F.col("content").isNotNull()).select("scan_id", "relative_path", F.explode(Q.statements(F.col("content"))).alias("s"))
    return rows.select("scan_id", "relative_path", "s.*").withColumn("kind", Q.statement_kind(F.col("text")))


_OBJECT = r"(DATABASE|SCHEMA|TABLE|SEQUENCE|FUNCTION|PROCEDURE|FOREIGN SERVER|FOREIGN DATA WRAPPER|TABLES|SEQUENCES|FUNCTIONS)"


def permissions(statements: DataFrame) -> DataFrame:
    """(..., action, capability, object_kind, object_id, role_id) of grants, revokes and changes of owners."""
    t = F.col("text")
    rows = statements.where(F.col("kind") == "permission")
    plain = rf"(?i)^(GRANT|REVOKE) (.+?) ON (?:{_OBJECT} )?([A-Za-z_][\w$.]*) (?:TO|FROM) ([A-Za-z_][\w$]*)"
    owner = rf"(?i)^ALTER {_OBJECT} (?:IF EXISTS )?([A-Za-z_][\w$.]*) OWNER TO ([A-Za-z_][\w$]*)"
    member = r"(?i)^(GRANT|REVOKE) ([A-Za-z_][\w$]*) (?:TO|FROM) ([A-Za-z_][\w$]*)$"
    is_plain, is_owner, is_member = t.rlike(plain), t.rlike(owner), t.rlike(member)
    action = F.when(is_plain, F.lower(F.regexp_extract(t, plain, 1))).when(is_owner, F.lit("owner-change")).when(is_member, F.when(t.rlike("(?i)^GRANT"), F.lit("role-membership")).otherwise(F.lit("revoke"))).otherwise(F.lit("unknown"))
    pick = lambda a, b, c: F.nullif(F.when(is_plain, F.regexp_extract(t, plain, a)).when(is_owner, F.regexp_extract(t, owner, b)).when(is_member, F.regexp_extract(t, member, c)), F.lit(""))
    capability = F.when(is_plain, F.lower(F.regexp_extract(t, plain, 2))).when(is_owner, F.lit("ownership")).when(is_member, F.lit("role-admin"))
    return rows.withColumns({"action": action, "capability": F.explode(F.transform(F.split(F.coalesce(capability, F.lit("unknown")), ","), lambda p: F.trim(p))), "object_kind": F.lower(F.coalesce(F.nullif(F.when(is_plain, F.regexp_extract(t, plain, 3)).when(is_owner, F.regexp_extract(t, owner, 1)), F.lit("")), F.lit("table"))), "object_id": pick(4, 2, 2), "role_id": pick(5, 3, 3)})


#: Surfaces of links between databases and what each needs beforehand.
LINKS = (("foreign-server", r"(?i)^CREATE SERVER (?:IF NOT EXISTS )?([A-Za-z_][\w$]*)", "create-extension"), ("user-mapping", r"(?i)^CREATE USER MAPPING .*\bSERVER ([A-Za-z_][\w$]*)", "foreign-server"), ("foreign-table", r"(?i)^CREATE FOREIGN TABLE .*\bSERVER ([A-Za-z_][\w$]*)", "user-mapping"), ("imported-schema", r"(?i)^IMPORT FOREIGN SCHEMA .*\bSERVER ([A-Za-z_][\w$]*)", "user-mapping"))


def link_surfaces(statements: DataFrame) -> DataFrame:
    """(..., surface_kind, link_id, prerequisite) of foreign servers and what hangs on them."""
    kind = link = need = F.lit(None).cast("string")
    for name, pattern, before in LINKS:
        hit = F.col("text").rlike(pattern)
        kind, link, need = F.when(hit, F.lit(name)).otherwise(kind), F.when(hit, F.lower(F.regexp_extract("text", pattern, 1))).otherwise(link), F.when(hit, F.lit(before)).otherwise(need)
    return statements.withColumns({"surface_kind": kind, "link_id": link, "prerequisite": need}).where(F.col("surface_kind").isNotNull())


def link_prerequisites(links: DataFrame) -> DataFrame:
    """Each link surface with whether the surface it needs is declared for the same link: established or missing."""
    there = links.select(F.col("surface_kind").alias("prerequisite"), "link_id", F.lit(True).alias("there")).distinct()
    out = links.where(F.col("prerequisite") != "create-extension").join(there, ["prerequisite", "link_id"], "left")
    return out.withColumn("status", F.when(F.col("there"), F.lit("established")).otherwise(F.lit("missing"))).drop("there")


def runbook(statements: DataFrame) -> DataFrame:
    """Runs of statements of one kind in each file, in their order: the steps of a script."""
    return islands(statements, ["scan_id", "relative_path"], ["ordinal"], "kind")


def url_literals(files: DataFrame) -> DataFrame:
    """(scan_id, relative_path, line_no, path_key) of route literals in source lines."""
    from ..functions import routes

    found = F.explode(F.regexp_extract_all("line", F.lit(r"[\"'`](/api/[^\"'`\s]*)[\"'`]"), 1)).alias("route")
    rows = lines(files.where(F.contains("content", F.lit("/api/")))).select("scan_id", "relative_path", "line_no", found)
    return rows.select("scan_id", "relative_path", "line_no", "route", routes.normalize(F.regexp_replace("route", r"\$\{[^}]*\}", "{v}"))["key"].alias("path_key"))


def dedupe(facts: DataFrame) -> DataFrame:
    """Facts normalised and without repeats: paths with slashes, symbols trimmed, the first of equal ids."""
    clean = facts.withColumns({"file_path": T.safe_path(F.col("file_path")), "source_symbol": F.nullif(F.trim("source_symbol"), F.lit("")), "target_symbol": F.nullif(F.trim("target_symbol"), F.lit(""))})
    cols = [c for c in clean.columns if c not in ("scan_id", "fact_id")]
    return clean.groupBy("scan_id", "fact_id").agg(F.min(F.struct("file_path", "start_line", *[c for c in cols if c not in ("file_path", "start_line")])).alias("x")).select("scan_id", "fact_id", "x.*")


def gap_facts(facts: DataFrame) -> DataFrame:
    """Diagnostics of a scan's environment: its gaps by category, rule and severity."""
    p = T.properties(F.col("properties_json"))
    message = T.first_value(p, "message")
    category = F.when(message.rlike("(?i)restore|package"), F.lit("restore")).when(message.rlike("(?i)load|project"), F.lit("project-load")).when(message.rlike("(?i)syntax|declaration"), F.lit("syntax")).when(message.rlike("(?i)dynamic"), F.lit("dynamic-dispatch")).otherwise(F.lit("other"))
    return facts.where(F.col("fact_type") == "AnalysisGap").withColumns({"message": message, "category": category})


def coverage_column(level: Column) -> Column:
    return F.when(level == "Level1SemanticAnalysis", F.lit("full")).when(level.isNull(), F.lit("unknown")).otherwise(F.lit("reduced"))


# ---- syntax trees, views and call sites


PYTHON = "scan_id string, relative_path string, line_no int, end_line int, kind string, name string, owner string, argument string, gap string"


def _python_rows(text: str) -> list[tuple]:
    """(line, end, kind, name, owner, first text argument) of declarations, imports and calls of a Python text."""
    out: list[tuple] = []
    todo: list[tuple[ast.AST, str]] = [(ast.parse(text), "")]
    while todo:
        node, owner = todo.pop()
        below = owner
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if owner and owner[-1] == "*" else "function"
            out.append((node.lineno, node.end_lineno, kind, node.name, owner.rstrip("*") or None, None))
            below = ".".join(x for x in (owner.rstrip("*"), node.name) if x) + ("*" if kind == "class" else "")
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            base = "." * getattr(node, "level", 0) + (getattr(node, "module", None) or "")
            for x in node.names:
                out.append((node.lineno, node.end_lineno, "import", f"{base}.{x.name}" if base.strip(".") else base + x.name, owner.rstrip("*") or None, None))
        elif isinstance(node, ast.Call):
            parts, at = [], node.func
            while isinstance(at, ast.Attribute):
                parts.append(at.attr)
                at = at.value
            parts.append(at.id if isinstance(at, ast.Name) else "?")
            first = node.args[0].value if node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str) else None
            out.append((node.lineno, node.end_lineno, "call", ".".join(parts[::-1]), owner.rstrip("*") or None, first))
        todo += [(x, below) for x in ast.iter_child_nodes(node)]
    return sorted(out, key=lambda r: (r[0], r[2], r[3]))


def python_syntax(files: DataFrame) -> DataFrame:
    """PYTHON rows of the .py items by their syntax trees; a text that doesn't parse gives one row with a gap."""
    columns = [x.split()[0] for x in PYTHON.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows: list[tuple] = []
            for scan, path, text in pdf[["scan_id", "relative_path", "content"]].itertuples(index=False, name=None):
                try:
                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        rows += [(scan, path, *r, None) for r in _python_rows(text.lstrip("﻿"))]
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    rows.append((scan, path, *[None] * 6, "not-parsed"))
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({"line_no": "Int32", "end_line": "Int32"})

    src = files.where(F.lower("relative_path").endswith(".py") & F.col("content").isNotNull() & (F.col("content") != ""))
    return src.select("scan_id", "relative_path", "content").mapInPandas(read, PYTHON)


def _matches(files: DataFrame, extensions: str, patterns: dict[str, str]) -> DataFrame:
    """(scan_id, relative_path, line_no, kind, name) of what each pattern's first group finds in lines."""
    rows = lines(files.where(F.lower("relative_path").rlike(rf"\.(?:{extensions})$")))

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), 1), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    found = F.array(*[of(k, p) for k, p in patterns.items()])
    told = rows.select("scan_id", "relative_path", "line_no", F.explode(F.flatten(found)).alias("m"))
    return told.select("scan_id", "relative_path", "line_no", "m.kind", "m.name").where(F.col("name") != "")


#: Calls and attributes of C# and Java that name a boundary; group 1 is the name, without its quotes.
INTEGRATION = {
    "http-client": r"\b(?:Get|Post|Put|Delete|Patch|Send)(?:StringAsync|AsJsonAsync|Async)\s*\(\s*\$?@?\"([^\"\n]+)\"",
    "http-route": r"(?:\[Http(?:Get|Post|Put|Delete|Patch)|\[Route|@(?:Get|Post|Put|Delete|Patch|Request)Mapping|\bMap(?:Get|Post|Put|Delete|Patch))\s*\(\s*(?:(?:value|path)\s*=\s*)?\"([^\"\n]*)\"",
    "sql-text": r"\b(?:new\s+\w*Command|(?:Query|Execute)\w*|FromSqlRaw|prepareStatement|createNativeQuery)\s*(?:<[^>\n]*>)?\s*\(\s*@?\"([^\"\n]+)\"",
    "message-publish": r"\b(?:Publish|SendMessage|BasicPublish|convertAndSend)(?:Async)?\s*(?:<[^>\n]*>)?\s*\(\s*\"([^\"\n]+)\"",
    "message-consume": r"(?:\b(?:Subscribe|BasicConsume|Consume)(?:Async)?\s*(?:<[^>\n]*>)?\s*\(\s*|@(?:RabbitListener|KafkaListener|JmsListener)\s*\(\s*\w+\s*=\s*)\"([^\"\n]+)\"",
}


def integration_calls(files: DataFrame) -> DataFrame:
    """(scan_id, relative_path, line_no, kind, name): clients, routes, SQL texts and messages named in C# and Java lines."""
    return _matches(files, "cs|java", INTEGRATION)


#: How views bind to models and where their forms lead.
VIEWS = {
    "model": r"^\s*@model\s+([A-Za-z_][\w.<>?, ]*)",
    "bound": r"\basp-for\s*=\s*[\"'](?:Model\.)?([A-Za-z_][\w.]*)[\"']",
    "helper": r"\bHtml\.\w+For\s*\(\s*\w+\s*=>\s*\w+\.([A-Za-z_][\w.]*)",
    "action": r"\basp-action\s*=\s*[\"']([^\"']+)[\"']",
    "controller": r"\basp-controller\s*=\s*[\"']([^\"']+)[\"']",
    "page": r"\basp-page\s*=\s*[\"']([^\"']+)[\"']",
    "untyped": r"\b(ViewBag\.\w+|ViewData\[\s*\"\w+\"\s*\])",
}


def view_bindings(files: DataFrame) -> DataFrame:
    """(scan_id, relative_path, line_no, kind, name, model_type): what .cshtml and .razor views show, with their model's type."""
    rows = _matches(files, "cshtml|razor", VIEWS)
    model = rows.where(F.col("kind") == "model").groupBy("scan_id", "relative_path").agg(F.min_by(F.trim("name"), "line_no").alias("model_type"))
    return rows.where(F.col("kind") != "model").join(model, ["scan_id", "relative_path"], "left")


#: Declarations and boundaries of Swift lines.
SWIFT = {
    "type": r"^\s*(?:(?:public|private|internal|fileprivate|open|final|indirect)\s+)*(?:class|struct|enum|protocol|actor|extension)\s+([A-Za-z_]\w*)",
    "function": r"^\s*(?:(?:public|private|internal|fileprivate|open|static|class|override|mutating|final)\s+)*func\s+([A-Za-z_]\w*)",
    "import": r"^\s*import\s+(?:\w+\s+)?([A-Za-z_][\w.]*)",
    "http-client": r"\bURL\s*\(\s*string:\s*\"([^\"\n]+)\"",
    "storage": r"\b(UserDefaults|FileManager|NSPersistentContainer|ModelContainer|Keychain\w*|SecItem\w+)\b",
    "unsupported": r"(#selector|@objc|NSClassFromString|Mirror\s*\(|@dynamicMemberLookup|#if\b)",
}


def swift_syntax(files: DataFrame) -> DataFrame:
    """(scan_id, relative_path, line_no, kind, name): declarations, clients, storage and what isn't followed in Swift lines."""
    return _matches(files, "swift", SWIFT)


#: The fields of a statement's execution context.
CONTEXT_FIELDS = {"engineFamily": "unknown", "serverRole": "unknown", "databaseRole": "unknown", "schemaRole": "unspecified", "executionMode": "unknown", "stepKind": "unknown-sql-step"}
_CONTEXT_WORD = r"^[a-z][a-z0-9-]{0,63}$"


def sql_directives(files: DataFrame, marker: str = r"[\w-]*sql-context") -> DataFrame:
    """(scan_id, relative_path, line_no, fields, gap): contexts that comment lines `-- <marker>: name=value; ...` declare.

    `fields` holds all of CONTEXT_FIELDS; an unknown name, a repeated one or a value that is no plain word gives a gap.
    """
    body = F.regexp_extract("line", rf"^\s*--\s*{marker}:\s*(.*?)\s*$", 1)
    rows = lines(files.where(F.lower("relative_path").endswith(".sql"))).where(F.col("line").rlike(rf"^\s*--\s*{marker}:"))
    pairs = F.filter(F.transform(F.split(body, r"[;\s]+"), F.trim), lambda x: x != "")
    names, values = F.transform(pairs, lambda x: F.split_part(x, F.lit("="), F.lit(1))), F.transform(pairs, lambda x: F.split_part(x, F.lit("="), F.lit(2)))
    known = F.array(*[F.lit(k) for k in CONTEXT_FIELDS])
    bad = (F.size(pairs) == 0) | F.exists(pairs, lambda x: ~x.rlike(r"^[A-Za-z]+=[^=]+$")) | (F.size(F.array_except(names, known)) > 0) | (F.size(F.array_distinct(names)) < F.size(names)) | F.exists(values, lambda v: ~v.rlike(_CONTEXT_WORD))
    defaults = F.create_map(*[F.lit(x) for pair in CONTEXT_FIELDS.items() for x in pair])
    given = F.map_from_arrays(F.array_distinct(names), F.slice(values, 1, F.size(F.array_distinct(names))))
    fields = F.map_from_arrays(known, F.transform(known, lambda k: F.coalesce(F.element_at(given, k), F.element_at(defaults, k))))
    return rows.select("scan_id", "relative_path", "line_no", F.when(~bad, fields).alias("fields"), F.when(bad, F.lit("invalid-context-directive")).alias("gap"))


def sql_sidecars(files: DataFrame, suffix: str = ".context.json") -> DataFrame:
    """(scan_id, relative_path, ordinal, fields, gap): contexts that a JSON file beside an SQL file declares by statement.

    `relative_path` is the SQL file's. A file that is no such JSON gives one gap, a step without a positive ordinal, with a
    repeated one or with a value that is no plain word a gap of its own.
    """
    step = ", ".join(f"{k} string" for k in CONTEXT_FIELDS)
    src = files.where(F.lower("relative_path").endswith(".sql" + suffix) & F.col("content").isNotNull())
    read = F.from_json("content", f"schemaVersion string, steps array<struct<statementOrdinal int, {step}>>", {"mode": "PERMISSIVE"})
    rows = src.select("scan_id", F.expr(f"left(relative_path, length(relative_path) - {len(suffix)})").alias("relative_path"), read.alias("r"))
    broken = rows.where(F.col("r").isNull() | F.col("r.steps").isNull() | F.col("r.schemaVersion").isNull())
    steps = rows.join(broken.select("scan_id", "relative_path"), ["scan_id", "relative_path"], "left_anti").select("scan_id", "relative_path", F.explode("r.steps").alias("s"))
    fields = F.create_map(*[x for k, v in CONTEXT_FIELDS.items() for x in (F.lit(k), F.coalesce(F.col(f"s.{k}"), F.lit(v)))])
    n = F.count(F.lit(1)).over(Window.partitionBy("scan_id", "relative_path", F.col("s.statementOrdinal")))
    told = steps.select("scan_id", "relative_path", F.col("s.statementOrdinal").alias("ordinal"), fields.alias("fields"), n.alias("n"))
    bad = F.coalesce(F.col("ordinal") <= 0, F.lit(True)) | (F.col("n") > 1) | F.exists(F.map_values("fields"), lambda v: ~v.rlike(_CONTEXT_WORD))
    told = told.select("scan_id", "relative_path", "ordinal", F.when(~bad, F.col("fields")).alias("fields"), F.when(bad, F.lit("invalid-context-sidecar-step")).alias("gap"))
    return told.unionByName(broken.select("scan_id", "relative_path", F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("map<string,string>").alias("fields"), F.lit("invalid-context-sidecar").alias("gap")))
