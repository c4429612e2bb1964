"""Files that nobody wrote by hand: generated, minified, vendored or data saved as code.

Generated, minified and data files are told by header rules (what tools write on top of their output) and layout rules
(repeated line shapes, line lengths, literal mass), a map without shuffle. Vendored copies are found by Merkle hashes: a
code file's normalised text is cut into blocks of statements at places that its own content chooses, the blocks' hashes
give the file's, and a folder's hash combines its children's names and hashes, bottom-up level by level. Any other file is
hashed by its bytes; files without content are neutral.

* Subtrees (files or folders with at least MIN_SHARED characters of code) shared by unrelated repositories (no common
  owner, the part before '/') are vendored, with all that lies in them.
* A file is a damaged or edited copy if NEAR of its mass lies in blocks of vendored files. A block counts as theirs if of
  the different texts that hold it at least THEIRS are vendored, so that customary lines prove nothing.
* A licence header of a third party with its version or authors, unless it names the repository's owner, says so by itself.

Folder hashes are sums and xors over their children, so a folder with ever so many children is combined before the
shuffle, as are the texts that hold a block. Known copies are joined by hash, one row a hash.

Defined results: files without content (null or empty) are hand-written, and so are those of a kind that isn't code (.env,
.json, .config) outside shared folders. Binary junk, patches, error pages and merely damaged hand-written files are none of
these cases. Repeated rows of an item count once (the greatest content wins a tie). Items without scan or path are dropped;
one without repository belongs to no owner and shares nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut, union

#: Normalised characters of code below which equal content proves nothing.
MIN_SHARED = 80
#: One of so many statements, chosen by its hash, ends a block.
STATEMENTS = 4
#: Share of a copy's mass in vendored blocks, and share of vendored ones among the texts that hold such a block.
NEAR, THEIRS = 0.5, 0.2
CODE = ("cs", "ts", "js", "py", "java", "sql")
FACTS = "scan_id string, repo string, relative_path string, verdict string, leaf binary, size int, blocks array<struct<h: bigint, n: int>>"

# What tools write on top of their output, as whole comment lines.
_HEADER = re.compile(r"""^\W{0,6}(?:rem\s)?\s*(?:
    <auto-generated\b[^<]*>?\s*$ | <autogenerated\b.*
  | code\s+generated\s+by\b.*\bdo\s+not\s+edit.* | generated\s+by\b(?!\s+hand).*\bdo\s+not\s+(?:edit|modify).*
  | this\s+(?:file|code|class)\s+(?:was|is|has\s+been)\s+(?:auto(?:matically|-)?\s*)?(?:produced|generated|created)\s+by\b(?!\s+hand).*
  | auto-?\s?generated\s+(?:file|code|by)\b.* | @generated\b.*
  | (?:automatisch\s+(?:erzeugt|generiert)|g[ée]n[ée]r[ée]\s+automatiquement|generado\s+autom[áa]ticamente|gerado\s+automaticamente|自動生成).*
  | written\s+by\s+\S+\s+on\s+build\b.*\bedit\s+the\s+template\b.*
  | do\s+not\s+(?:edit|modify)\b.*\b(?:generated|overwritten)\b.*
)$""", re.X | re.I)
_COMMENT = re.compile(r"^\s*(?://|\#|/\*|\*|--|'|<!--|;|\"\"\")")
# Licence lines of third parties. An in-house copyright names the owner itself.
_LICENCE = re.compile(r"(?i)SPDX-License-Identifier|licensed\s+under|released\s+under\s+the\s+\S+\s+licen[cs]e|distributed\s+under|permission is hereby granted|redistribution and use in source")
_VERSION = re.compile(r"(?m)^\W{0,4}!?\s*[\w.\-]+(?:\.js)?\s+v?\d+\.\d+(?:\.\d+)?\b")
_AUTHORS = re.compile(r"(?i)(?:\(c\)|©|copyright)\s.*\b(?:authors|contributors|foundation|inc|ltd|project)\b")
_INHOUSE = re.compile(r"(?i)internal use only|proprietary|confidential")
_LEAD = re.compile(r"\s*(?:/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z)|(?://|\#|--|;|'|\*|rem\b)[^\n]*(?:\n|\Z))", re.S | re.I)
_HOLDER = re.compile(r"(?i)(?:\(c\)|©|copyright)[^\n]*")
_JUNK = re.compile("[\x00-\x08\x0e-\x1f�]")
_NOT_CODE = re.compile(r"\A﻿?\s*(?:<[!?\w]|diff --git|--- a/|Index: )", re.I)
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_TABLE_LITERAL = re.compile(r"^[\s,;+(\[{]*(?:[\"'`][A-Za-z0-9+/=_\\x-]{24,}[\"'`][\s,;+)\]}]*|(?:0x[0-9a-f]+|-?\d+(?:\.\d+)?)(?:\s*,\s*(?:0x[0-9a-f]+|-?\d+(?:\.\d+)?)){2,}[\s,;)\]}]*)$", re.I)
_INSERT = re.compile(r"(?i)^\s*(?:insert\s+into\s+\S+(?:\s*\([^)]*\))?\s+values\b.*|\(.*\)\s*[,;])\s*$")
_KEEP = frozenset("private public protected internal static final class interface return if for foreach while var let const new get set partial namespace using import export function def self this string int bool switch case try catch void".split())


def _shape(line: str) -> str:
    line = _STRING.sub("s", line.strip())
    line = re.sub(r"[A-Za-z_]\w*", lambda m: m[0] if m[0] in _KEEP else "a", line)
    return re.sub(r"\d+", "0", line)


def leading_comments(text: str) -> str:
    """All comments before the first code, whatever their length, line and block comments alike."""
    text = text.lstrip("\ufeff")
    i = 0
    while m := _LEAD.match(text, i):
        i = m.end()
    return text[:i]


def generated_header(text: str) -> bool:
    """Whether a line of the leading comments is a tool's own header."""
    return any(_HEADER.match(x.strip().rstrip("*/ ")) for x in leading_comments(text).splitlines())


def generated_layout(lines: list[str]) -> bool:
    """Whether a few line shapes, always in the same order, make up the file."""
    if len(lines) < 6:
        return False
    shapes = [_shape(x) for x in lines]
    counts = Counter(shapes).most_common(4)
    if counts[0][1] >= 0.6 * len(shapes) and counts[0][1] >= 4 and len(counts[0][0]) >= 30:
        return True  # one long line again and again, such as a descriptor's fields
    few = sum(n for _, n in counts) / len(shapes)
    pairs = sum(n for _, n in Counter(zip(shapes, shapes[1:])).most_common(3)) / len(shapes)
    return len(lines) >= 12 and few >= 0.7 and pairs >= 0.5 and len(set(shapes)) <= 0.4 * len(shapes) and sum(map(len, lines)) > 25 * len(lines)


def minified(text: str, kind: str) -> bool:
    if kind not in ("js", "ts", "css"):
        return False
    code = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    lines = [x for x in code.splitlines() if x.strip()]
    longest = max(map(len, lines), default=0)
    if longest < 250:
        return False
    heavy = sum(len(x) for x in lines if len(x) >= 150)
    spaces = sum(x.count(" ") for x in lines if len(x) >= 150)
    words = _STRING.sub("", code)
    return heavy > 0.7 * len(code.strip()) and spaces < 0.16 * heavy and len(re.findall(r"[;{}(),]", words)) > 0.08 * len(words)


def data_blob(lines: list[str], text: str, kind: str) -> bool:
    """Whether literals of data, not code, make up nearly all of the file."""
    if not lines:
        return False
    size = sum(map(len, lines))
    if kind == "sql":
        return len(lines) >= 20 and sum(1 for x in lines if _INSERT.match(x)) >= 0.9 * len(lines)
    rows = sum(len(x) for x in lines if _TABLE_LITERAL.match(x))
    if size > 600 and rows > 0.8 * size:
        return True
    long_ = sum(len(m) for m in _STRING.findall(text) if len(m) >= 400 and re.fullmatch(r"[\"'`][A-Za-z0-9+/=_\s\\-]+[\"'`]", m))
    return size > 600 and long_ > 0.8 * size


def third_party_header(text: str, owner: str | None) -> bool:
    """Whether the leading comments hold a third party's licence; a copyright in the owner's name is in-house."""
    head = leading_comments(text)
    if not _LICENCE.search(head) or _INHOUSE.search(head) or not (_VERSION.search(head) or _AUTHORS.search(head)):
        return False
    return not (owner and any(re.search(rf"(?i)(?<!\w){re.escape(owner)}(?!\w)", x) for x in _HOLDER.findall(head)))


def statements(text: str, kind: str) -> list[str]:
    """The statements of a text without comments, byte-order mark and white space, however lines are broken."""
    t = text.lstrip("\ufeff")
    if kind == "py":
        t = re.sub(r"(?m)^\s*#.*$", "", t)
    elif kind == "sql":
        t = re.sub(r"(?m)^\s*--.*$", "", t)
    else:
        t = re.sub(r"(?s)/\*.*?\*/", "", re.sub(r"(?m)^\s*//.*$", "", t))
    return [x for x in (re.sub(r"\s+", "", u) for u in re.split(r"(?<=[;{}\n])", t)) if x]


def blocks_of(parts: list[str]) -> list[tuple[int, int]]:
    """(hash, size) of the blocks of statements; where one ends depends on its last statement alone."""
    out, now = [], []
    for x in parts:
        raw = x.encode("utf-8", "surrogatepass")
        now.append(raw)
        if xxhash.xxh64_intdigest(raw, 1) % STATEMENTS == 0:
            out.append(now)
            now = []
    return [(xxhash.xxh64_intdigest(b"\n".join(x)) - (1 << 63), sum(map(len, x))) for x in [*out, now] if x]


def judge(path: str, text: str | None, owner: str | None = None) -> tuple[str | None, bytes | None, int, list[tuple[int, int]]]:
    """(verdict by rules or None, leaf hash, normalised size of code, blocks)."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if not text:
        return None, None, 0, []
    junk = len(_JUNK.findall(text))
    if kind not in CODE or (junk > 2 and junk > len(text) / 2000) or _NOT_CODE.match(text):
        plain = text.lstrip("\ufeff").replace("\r\n", "\n")
        return None, hashlib.sha256(b"file\n" + plain.encode("utf-8", "surrogatepass")).digest()[:16], 0, []
    blocks = blocks_of(statements(text, kind))
    leaf = hashlib.sha256(b"code\n" + b"".join(h.to_bytes(8, "big", signed=True) for h, _ in blocks)).digest()[:16]
    lines = [x for x in text.lstrip("\ufeff").splitlines() if x.strip() and not _COMMENT.match(x) and x.strip() not in ("{", "}", "};", ");", ")", "(")]
    if generated_header(text):
        verdict = "generated"
    elif third_party_header(text, owner):
        verdict = "vendored"
    elif minified(text, kind):
        verdict = "minified"
    elif data_blob(lines, text, kind):
        verdict = "data"
    elif kind != "sql" and generated_layout(lines):
        verdict = "generated"
    else:
        verdict = None
    return verdict, leaf, sum(n for _, n in blocks), blocks


def _owner(repo: str | None) -> str | None:
    return repo.split("/", 1)[0] if isinstance(repo, str) else None


def _judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for s, r, p, c in pdf[["scan_id", "repo", "relative_path", "content"]].itertuples(index=False, name=None):
            *head, blocks = judge(p, c, _owner(r))
            out.append((s, r, p, *head, [{"h": h, "n": n} for h, n in blocks]))
        yield pd.DataFrame(out, columns=["scan_id", "repo", "relative_path", "verdict", "leaf", "size", "blocks"])


def file_facts(files: DataFrame) -> DataFrame:
    """FACTS of each item of `files` (scan_id, repo, relative_path, content)."""
    src = files.where(F.col("scan_id").isNotNull() & F.col("relative_path").isNotNull())
    facts = src.select("scan_id", "repo", "relative_path", "content").mapInPandas(_judge, FACTS)
    cols = ["repo", "verdict", "leaf", "size", "blocks"]
    one = facts.groupBy("scan_id", "relative_path").agg(F.max(F.struct(*cols)).alias("x"))
    return one.select("scan_id", "relative_path", *[F.col(f"x.{c}").alias(c) for c in cols])


def subtrees(facts: DataFrame) -> DataFrame:
    """(scan_id, repo, path, level, hash, size) of every file and folder, hashed bottom-up, one round a level.

    A folder's hash combines its children's names and hashes; files without a hash leave no trace in it.
    """
    nodes = cut(facts.select("scan_id", "repo", F.col("relative_path").alias("path"), F.size(F.split("relative_path", "/")).alias("level"), F.col("leaf").alias("hash"), F.col("size").cast("long").alias("size")))
    deepest = nodes.agg(F.max("level")).first()[0] or 0
    done, at = [nodes], nodes.where(F.col("level") == deepest)
    for level in range(deepest, 1, -1):
        name, child = F.substring_index("path", "/", -1), F.col("hash")
        mixed = lambda seed: F.when(child.isNotNull(), F.xxhash64(F.lit(seed), name, child))
        up = at.groupBy("scan_id", F.substring_index("path", "/", level - 1).alias("path")).agg(
            F.max("repo").alias("repo"), F.sum("size").alias("size"), F.count(child).alias("n"), F.bit_xor(mixed(1)).alias("x"), F.sum(mixed(2).cast("decimal(38,0)")).alias("s"),
        )
        digest = F.unhex(F.substring(F.sha2(F.concat_ws("|", "n", "x", "s"), 256), 1, 32))
        folders = cut(up.select("scan_id", "repo", "path", F.lit(level - 1).alias("level"), F.when(F.col("n") > 0, digest).alias("hash"), "size"))
        done.append(folders)
        at = folders.unionByName(nodes.where(F.col("level") == level - 1))
    return union(done)


def in_shared(facts: DataFrame) -> DataFrame:
    """(scan_id, relative_path) of the items in a subtree that repositories of different owners share."""
    tree = subtrees(facts).where(F.col("hash").isNotNull() & (F.col("size") >= MIN_SHARED))
    owner = F.split_part("repo", F.lit("/"), F.lit(1))
    shared = tree.groupBy("hash").agg(F.min(owner).alias("a"), F.max(owner).alias("b")).where(F.col("a") != F.col("b")).select("hash")
    covered = tree.join(shared, "hash", "left_semi").select("scan_id", "path").distinct()
    # An item lies in a shared subtree if its own path or that of one of its folders is one.
    parts = F.split("relative_path", "/")
    ways = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    under = facts.where("leaf is not null").select("scan_id", "relative_path", F.explode(ways).alias("path"))
    return under.join(covered, ["scan_id", "path"], "left_semi").select("scan_id", "relative_path").distinct()


def near_copies(facts: DataFrame, flags: DataFrame) -> DataFrame:
    """leaf of the texts without a verdict whose mass lies in blocks of the vendored ones.

    `flags` has leaf, known (vendored) and rest (no verdict), one row a leaf; blocks are looked at once a text.
    """
    texts = facts.where(F.size("blocks") > 0).groupBy("leaf").agg(F.first("blocks").alias("blocks"))
    texts = cut(texts.join(flags, "leaf").select(F.monotonically_increasing_id().alias("id"), "leaf", "known", "rest", "blocks"))
    held = texts.select("known", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["h"]))).alias("h"))
    counts = held.groupBy("h").agg(F.count_if("known").alias("yes"), F.count(F.lit(1)).alias("n"))
    theirs = counts.where((F.col("yes") > 0) & (F.col("yes") >= THEIRS * F.col("n"))).select("h")
    mass = F.aggregate("blocks", F.lit(0), lambda a, b: a + b["n"])
    rest = texts.where(F.col("rest")).withColumn("mass", mass).where(F.col("mass") >= MIN_SHARED)
    own = rest.select("id", F.explode("blocks").alias("b")).select("id", "b.h", "b.n")
    shared = own.join(theirs, "h", "left_semi").groupBy("id").agg(F.sum("n").alias("n"))
    return rest.select("id", "leaf", "mass").join(shared, "id").where(F.col("n") >= NEAR * F.col("mass")).select("leaf")


def not_handwritten(files: DataFrame) -> DataFrame:
    """(scan_id, relative_path, repo, verdict) of the items that nobody wrote by hand."""
    facts = cut(file_facts(files))
    keys = ["scan_id", "relative_path"]
    found = facts.select(*keys, "repo", "verdict", "leaf").join(in_shared(facts).withColumn("shared", F.lit(True)), keys, "left")
    shared = F.coalesce("shared", F.lit(False)) & F.col("verdict").isNull()
    known = (shared | (F.coalesce("verdict", F.lit("")) == "vendored")).alias("known")
    marked = cut(found.select(*keys, "repo", "verdict", "leaf", shared.alias("shared"), known, (F.col("verdict").isNull() & ~shared).alias("rest")))
    ruled = marked.where(F.col("verdict").isNotNull() | F.col("shared")).select(*keys, "repo", F.coalesce("verdict", F.lit("vendored")).alias("verdict"))
    flags = marked.where("leaf is not null").groupBy("leaf").agg(F.max("known").alias("known"), F.max("rest").alias("rest"))
    copies = marked.where("rest").join(near_copies(facts, flags), "leaf", "left_semi")
    return ruled.unionByName(copies.select(*keys, "repo", F.lit("vendored").alias("verdict")))
