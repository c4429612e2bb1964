"""Scalar expressions over evidence texts; all are built-in column expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EDGE_SYNONYMS, lookup_map


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it; keeps plans small, too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_prefix(value: Column, n: int) -> Column:
    """The first n hex digits of a text's SHA-256; null stays null."""
    return F.substring(F.sha2(value, 256), 1, n)


def piped_id(prefix: str, n: int, *parts: Column) -> Column:
    """An id from parts joined by '|', where a missing part leaves an empty field and its separator."""
    return F.concat(F.lit(prefix), hash_prefix(F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit("|")] if i else []) + [F.coalesce(p.cast("string"), F.lit(""))]]), n))


def blank(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " ")) == ""


def first_value(props: Column, *keys: str) -> Column:
    """The first property among `keys` that isn't blank, trimmed."""
    return F.coalesce(*[F.when(~blank(F.try_element_at(props, F.lit(k))), F.regexp_replace(F.try_element_at(props, F.lit(k)), r"(?U)^\s+|\s+$", "")) for k in keys])


def properties(json_text: Column) -> Column:
    """The property map of a JSON text; null where it is no JSON object."""
    return F.from_json(json_text, "map<string,string>")


def sorted_map(props: Column) -> Column:
    """A map's entries in the order of their keys."""
    return F.array_sort(F.map_entries(props))


def metadata_hash(props: Column, n: int = 32) -> Column:
    """A hash of a map that doesn't depend on its order; blank values don't count."""
    lines = F.transform(F.filter(sorted_map(props), lambda e: ~blank(e["value"])), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"]))
    return hash_prefix(F.array_join(lines, "\n"), n)


def rule_family(rule: Column) -> Column:
    return F.regexp_replace(rule, r"\.v\d+$", "")


def edge_kind(kind: Column, synonyms: bool = True) -> Column:
    """A kind in lower case with dashes; diffs compare it without synonyms."""
    plain = F.lower(F.regexp_replace(F.trim(kind), "[_ ]", "-"))
    return lookup_map(EDGE_SYNONYMS, plain, plain) if synonyms else plain


def safe_path(path: Column) -> Column:
    """A relative path with slashes; a hash instead of an absolute path or URL, 'n/a' for none."""
    absolute = path.rlike(r"^[/\\]|^[A-Za-z]:[/\\]?|://|:/|:\\")
    return F.when(blank(path), F.lit("n/a")).when(absolute, F.concat(F.lit("absolute-path-hash:"), hash_prefix(path, 16))).otherwise(F.replace(path, F.lit("\\"), F.lit("/")))


def unsafe_version(version: Column) -> Column:
    """Whether a package version holds a path, URL or variable."""
    return F.trim(version).rlike(r"://|\\|^/|^\.{1,2}/|(?i)^file:|^git\+|\$\{|\$\(|%")


def safe_version(version: Column) -> tuple[Column, Column, Column]:
    """(version, hash, reason): an unsafe version is replaced by its hash and a reason."""
    bad = unsafe_version(version) & ~blank(version)
    return F.when(~bad & ~blank(version), F.trim(version)), F.when(bad, hash_prefix(F.trim(version), 32)), F.when(bad, F.lit("unsafe-package-version"))


def contains_ci(text: Column, part: Column | str) -> Column:
    return F.contains(F.lower(text), F.lower(part if isinstance(part, Column) else F.lit(part)))


def member_name(symbol: Column) -> Column:
    """The last name of a symbol, without its parameters."""
    return F.regexp_extract(F.regexp_replace(symbol, r"(?s)\(.*$", ""), r"([^.]*)$", 1)


def containing_type(symbol: Column) -> Column:
    """What stands before the last dot of a symbol without parameters; null where nothing does."""
    plain = F.regexp_replace(symbol, r"(?s)\(.*$", "")
    return F.when(plain.rlike(r"^.+\.[^.]*$"), F.regexp_extract(plain, r"^(.+)\.[^.]*$", 1))


def is_constructor(symbol: Column) -> Column:
    member, owner = member_name(symbol), containing_type(symbol)
    return F.coalesce(F.when(member.isin(".ctor", "#ctor", "ctor"), owner.isNotNull()).otherwise((member != "") & (member == member_name(owner))), F.lit(False))


def parameter_symbol(symbol: Column) -> Column:
    """A parameter without its default value."""
    return F.when(~blank(symbol), F.regexp_replace(symbol, r"(?s) = .*$", ""))


def node_key(method: Column, parameter: Column) -> Column:
    return F.concat(method, F.lit("::"), parameter)


def symbol_alias(name: Column) -> Column:
    """struct(member, type, signature) of a displayed symbol, lower-cased and without generics; null if it is none."""

    def parsed(s: Column) -> Column:
        signature = F.when(s.rlike(r"(?s)\(.*\)"), F.regexp_replace(F.regexp_extract(s, r"(?s)\((.*)\)", 1), r"\s*,\s*", ","))
        plain = F.regexp_replace(F.trim(F.regexp_replace(s, r"(?s)\(.*$", "")), r"\.+$", "")
        clean = lambda p: F.regexp_replace(F.regexp_replace(p, r"^.*global::", ""), r"(?s)<.*$", "")
        parts = lambda x: F.transform(F.filter(F.transform(F.split(x, r"\."), lambda p: F.trim(p)), lambda p: p != ""), clean)

        def row(x: Column) -> Column:
            member, owner = F.try_element_at(x, F.lit(-1)), F.try_element_at(x, F.lit(-2))
            ok = ~F.contains(F.trim(F.regexp_replace(s, r"(?s)\(.*$", "")), F.lit(" ")) & ~F.contains(s, F.lit("):")) & member.rlike(r"^\p{L}")
            return F.when(ok, F.struct(F.lower(member).alias("member"), F.when(owner != "", F.lower(owner)).alias("type"), signature.alias("signature")))

        return let(parts(plain), row)

    return let(F.trim(name), parsed)


def destination_identity(raw: Column) -> Column:
    """struct(status, key, hash, reason) of a message destination: static, dynamic, hashed or unknown."""
    def told(s: Column) -> Column:
        wild = s.rlike(r"[*#]|(^|[./])>$")
        dynamic = s.rlike(r"\$\{|\$\(|\{[^}]*\}|%[^%]+%|\+|\(\)|<[^>]*>")
        unsafe = s.rlike(r"(?i)://|@|password|secret|token|accountkey|sharedaccess|\\|;")
        renderable = s.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:/-]{0,199}$")
        row = lambda status, key, digest, reason: F.struct(F.lit(status).alias("status"), key.alias("key"), digest.alias("hash"), F.lit(reason).cast("string").alias("reason"))
        none, digest = F.lit(None).cast("string"), F.sha2(s, 256)
        return (
            F.when(s == "", row("unknown", none, none, "missing-destination-identity"))
            .when(wild, row("dynamic", none, digest, "wildcard-pattern-destination"))
            .when(dynamic, row("dynamic", none, digest, "dynamic-destination"))
            .when(unsafe | ~renderable, row("hashed", none, digest, "unsafe-omitted"))
            .otherwise(row("static", F.lower(s), none, None))
        )

    return let(F.trim(F.coalesce(raw, F.lit(""))), told)


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ** any folders, * and ? within one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" if glob[i] in r".()[]{}+^$|\\" else "") + glob[i], i + 1
    return f"^{out}$"
