"""HTTP route templates: normalised path keys, optional segments and method compatibility, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let

#: Optional segments up to which a path is expanded to all subsets.
MAX_OPTIONAL = 5
PARAMETER = r"^\{(\*?[A-Za-z_][A-Za-z0-9_]*)(?::([^}?]+))?(\?)?\}$"


def _slashes(v: Column) -> Column:
    v = F.regexp_replace(F.trim(F.replace(v, F.lit("\\"), F.lit("/"))), "/{2,}", "/")
    v = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(v, "^~/|^/", "")), "/+$", "")
    return F.coalesce(F.nullif(v, F.lit("")), F.lit("/"))


def _decoded(segment: Column) -> Column:
    """Percent escapes undone; a plus sign is no blank in a path."""
    return F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)


def normalize(route: Column, prefix: Column | None = None, controller: Column | None = None) -> Column:
    """struct(template, key, parameters, optional, constraints, query, catch_all, quality) of a route or URL."""
    def whole(v: Column) -> Column:
        # A question mark inside braces marks an optional parameter, not a query.
        path = F.regexp_extract(v, r"^((?:\{[^}]*\}|\{[^}]*$|[^?{])*)", 1)
        return let(path, lambda p: parts(p, F.substring(v, F.length(p) + 2, F.length(v))))

    def parts(path: Column, query: Column) -> Column:
        names = F.filter(F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, "^([^=]*)", 1)), lambda n: ~blank(n))
        path = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
        if controller is not None:
            path = F.regexp_replace(path, F.lit(r"(?i)\[controller\]"), F.when(~blank(controller), F.regexp_replace(controller, r"([\\$])", r"\\$1")).otherwise(F.lit("[controller]")))
        path = _slashes(path)
        if prefix is not None:
            path = let(path, lambda x: let(_slashes(F.coalesce(prefix, F.lit(""))), lambda p: F.when(blank(prefix) | (p == "/") | (F.lower(x) == F.lower(p)) | F.startswith(F.lower(x), F.concat(F.lower(p), F.lit("/"))), x).otherwise(_slashes(F.concat(p, F.lit("/"), x)))))
        segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _decoded)
        return let(segments, lambda s: described(s, F.array_sort(F.array_distinct(F.transform(names, _decoded)))))

    def described(segments: Column, query: Column) -> Column:
        is_parameter = lambda s: s.rlike(PARAMETER)
        optional = lambda s: is_parameter(s) & s.endswith("?}")
        name = lambda s: F.regexp_replace(F.regexp_extract(s, PARAMETER, 1), r"^\*", "")
        template = F.transform(segments, lambda s: F.when(is_parameter(s), F.concat(F.lit("{"), name(s), F.when(optional(s), F.lit("?")).otherwise(F.lit("")), F.lit("}"))).otherwise(s))
        key = F.transform(segments, lambda s: F.when(optional(s), F.lit("{?}")).when(is_parameter(s), F.lit("{}")).otherwise(F.lower(F.regexp_replace(s, r"\{[A-Za-z_][A-Za-z0-9_]*\??\}", "{}"))))
        inner = F.flatten(F.transform(segments, lambda s: F.when(is_parameter(s), F.array(name(s))).otherwise(F.regexp_extract_all(s, F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)\}"), 1))))
        optional_names = F.array_sort(F.array_distinct(F.transform(F.filter(segments, optional), name)))
        constraints = F.array_sort(F.array_distinct(F.transform(F.filter(segments, lambda s: is_parameter(s) & (F.regexp_extract(s, PARAMETER, 2) != "")), lambda s: F.concat(name(s), F.lit(":"), F.regexp_extract(s, PARAMETER, 2)))))
        return F.struct(
            F.concat(F.lit("/"), F.array_join(template, "/")).alias("template"), F.concat(F.lit("/"), F.array_join(key, "/")).alias("key"),
            F.array_sort(F.array_distinct(inner)).alias("parameters"), optional_names.alias("optional"), constraints.alias("constraints"), query.alias("query"),
            F.exists(segments, lambda s: s.rlike(r"^\{\*")).alias("catch_all"), F.when(F.exists(segments, optional), F.lit("OptionalSegments")).otherwise(F.lit("Exact")).alias("quality"),
        )

    return let(F.regexp_replace(F.trim(F.coalesce(route, F.lit(""))), r"(?s)#.*$", ""), whole)


def expand_keys(key: Column) -> Column:
    """All path keys that a key with optional segments stands for, sorted; beyond MAX_OPTIONAL only the fullest."""
    def spread(segments: Column, places: Column) -> Column:
        indexes = F.sequence(F.lit(0), F.greatest(F.size(segments) - 1, F.lit(0)))
        n = F.size(places)
        at = lambda i: F.coalesce(F.get(segments, i), F.lit(""))
        bit = lambda mask, i: F.floor(mask / F.pow(F.lit(2.0), (F.array_position(places, i) - 1).cast("double"))).cast("long").bitwiseAND(F.lit(1)) == 1
        one = lambda mask: F.concat(F.lit("/"), F.array_join(F.transform(F.filter(indexes, lambda i: (at(i) != "{?}") | bit(mask, i)), lambda i: F.replace(at(i), F.lit("{?}"), F.lit("{}"))), "/"))
        full = F.array(F.replace(key, F.lit("{?}"), F.lit("{}")))
        masks = F.sequence(F.lit(0).cast("long"), (F.pow(F.lit(2.0), F.least(n, F.lit(MAX_OPTIONAL)).cast("double")) - 1).cast("long"))
        return F.when((n == 0) | (n > MAX_OPTIONAL), full).otherwise(F.array_sort(F.array_distinct(F.concat(full, F.transform(masks, one)))))

    places = lambda segments: F.filter(F.sequence(F.lit(0), F.greatest(F.size(segments) - 1, F.lit(0))), lambda i: F.get(segments, i) == "{?}")
    return let(F.filter(F.split(key, "/"), lambda s: s != ""), lambda s: let(places(s), lambda p: spread(s, p)))


def methods(value: Column) -> Column:
    """The distinct upper-case methods of a list in text; ANY for none."""
    got = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(F.coalesce(value, F.lit("")), "[,;|]"), lambda m: ~blank(m)), lambda m: F.upper(F.trim(m)))))
    return F.when(F.size(got) == 0, F.array(F.lit("ANY"))).otherwise(got)


def methods_compatible(client: Column, server: Column) -> Column:
    """Within a combined index: ANY on either side, or a method in common."""
    return F.array_contains(client, "ANY") | F.array_contains(server, "ANY") | F.arrays_overlap(client, server)


def methods_compatible_two_index(client: Column, server: Column) -> Column:
    """Between two indexes: only the server's ANY is a wildcard."""
    return (server == "ANY") | (client == server)


def joined_templates(routes: Column) -> Column:
    """A controller's and an action's template, given as a list in text, as one."""
    parts = F.filter(F.transform(F.split(routes, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) == 0, routes).otherwise(F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, "^/+|/+$", "")), "/"))
