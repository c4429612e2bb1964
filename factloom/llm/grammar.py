"""Local grammars: whether balanced source text reads as statements of its language.

One permissive descent serves C#, Java, JavaScript and TypeScript; it knows declarations, statements, types and the order
of operands and operators, but no names and no types' meaning. SQL statements are told by their first words and by
which words may follow each other. Python, JSON and XML use exact parsers.
"""

from __future__ import annotations

import ast
import io
import json
import re
import sys
import tokenize
import warnings
import xml.parsers.expat
from functools import wraps

# Operators by length, and words by role.
_OPS = ">>>= === !== **= <<= >>= >>> &&= ||= ??= ... => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << -> :: ** .. + - * / % = < > ! ~ & | ^ ? : ; , . ( ) [ ] { } @".split()
_TOKEN = re.compile(
    r"(?P<ws>[ \t\r\f\v\ufeff\u00a0]+)|(?P<nl>\n)|(?P<c>//[^\n]*|/\*(?:.|\n)*?\*/)|(?P<pre>(?m:^)[ \t]*\#(?:if|else|elif|endif|region|endregion|pragma|nullable|define|undef|error|warning|line|!)(?!\w)[^\n]*)"
    r"|(?P<s>\$*\"\"\"+(?:.|\n)*?\"\"\"+|(?:\$@|@\$|@)\"(?:\"\"|[^\"])*\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<i>\$\"(?:\\.|\{\{|\{[^}\n]*\}|[^\"\\\n{])*\")"
    r"|(?P<n>0[xXbBoO][0-9a-fA-F_]+[uUlLn]*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDmMlLuUn]*)|(?P<id>[@#]?[A-Za-z_$\u0080-\uffff][\w$]*)|(?P<op>" + "|".join(map(re.escape, _OPS)) + ")|(?P<bad>.)")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_ASSIGN = set("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=".split())
_BINARY = _ASSIGN | set("=> == != === !== < > <= >= && || ?? + - * / % ** & | ^ << >> >>> -> ..".split())
_PREFIX = set("+ - ! ~ ++ -- & * ^ .. ...".split())
_WORD_OPS = {"cs": {"is", "as", "in"}, "java": {"instanceof"}, "js": {"in", "instanceof", "of"}, "ts": {"in", "instanceof", "of", "as", "is", "satisfies"}}
_MODIFIERS = {
    "cs": set("public private protected internal static readonly sealed abstract virtual override partial async extern unsafe new const volatile required file ref event implicit explicit fixed".split()),
    "java": set("public private protected static final abstract synchronized native transient volatile strictfp default sealed".split()),
    "js": set("static async get set export default".split()),
    "ts": set("public private protected static readonly abstract async get set export default declare override accessor".split()),
}
_TYPES = {"cs": {"class", "struct", "interface", "enum", "record"}, "java": {"class", "interface", "enum", "record"}, "js": {"class"}, "ts": {"class", "interface", "enum"}}
_STATEMENT = set("if else for foreach while do switch case break continue return throw try catch finally goto lock using yield const let var function import export package namespace".split())
_NO_OPERAND = {
    "cs": set("if else for foreach while do case break continue return try catch finally goto lock namespace class struct interface enum public private protected internal static const void using in is as".split()),
    "java": set("if else for while do case break continue return try catch finally package import class interface enum public private protected static final void instanceof throw".split()),
    "js": set("if else for while do case break continue return try catch finally import export var let const in instanceof of throw enum".split()) - {"import", "of", "let"},
    "ts": set("if else for while do case break continue return try catch finally export var const in instanceof throw enum".split()),
}


#: Calls that one bracket may open.
CALLS = 24


class Bad(Exception):
    """No reading of the tokens exists."""


def _template(text: str, i: int) -> int:
    """The end of a template literal that begins at i."""
    n = len(text)
    i += 1
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == "`":
            return i + 1
        if c == "$" and text[i + 1:i + 2] == "{":
            depth, i = 1, i + 2
            while i < n and depth:
                c = text[i]
                if c == "`":
                    i = _template(text, i)
                    continue
                if c in "\"'":
                    m = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'").match(text, i)
                    if not m:
                        raise Bad("string in template")
                    i = m.end()
                    continue
                depth += (c == "{") - (c == "}")
                i += 1
            continue
        i += 1
    raise Bad("template not closed")


def tokens(text: str, lang: str) -> list[tuple[str, str, bool]]:
    """(kind, text, at the start of a line) for each token; comments and directives are dropped."""
    out: list[tuple[str, str, bool]] = []
    i, n, fresh = 0, len(text), True
    script = lang in ("js", "ts")
    while i < n:
        c = text[i]
        if script and c == "`":
            j = _template(text, i)
            out.append(("s", "`", fresh))
            i, fresh = j, False
            continue
        if script and c == "/" and text[i + 1:i + 2] not in ("/", "*"):
            last = out[-1] if out else None
            if last is None or last[0] == "op" and last[1] not in (")", "]", "}", "++", "--") or last[0] == "id" and last[1] in ("return", "typeof", "case", "in", "of", "throw") or last[1] == "}" and fresh:
                m = _REGEX.match(text, i)
                if m:
                    out.append(("s", "/", fresh))
                    i, fresh = m.end(), False
                    continue
        m = _TOKEN.match(text, i)
        kind = m.lastgroup
        if kind == "nl":
            fresh = True
        elif kind == "c":
            fresh = fresh or "\n" in m[0]
        elif kind == "bad":
            raise Bad(f"character {m[0]!r}")
        elif kind == "pre" and lang == "cs" or kind == "pre" and i == 0:
            pass
        elif kind == "pre":
            raise Bad("directive")
        elif kind != "ws":
            if kind == "s" and m[0][0] in "@$\"'" and lang == "java" and m[0][0] in "@$" or kind == "i" and lang != "cs":
                raise Bad("string of another language")
            if kind == "s" and m[0][0] == "'" and lang in ("cs", "java") and not re.fullmatch(r"'(?:[^\\']|\\(?:u+[0-9a-fA-F]{4}|x[0-9a-fA-F]{1,4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|.))'", m[0]):
                raise Bad("character literal")
            if kind == "n" and re.match(r"[A-Za-z_$]", text[m.end():m.end() + 1]):
                raise Bad("letters after a number")
            out.append((kind if kind != "i" else "s", m[0], fresh))
            fresh = False
        i = m.end()
    return out


def once(rule):
    """A rule whose result at a place is kept, so that brackets tried in several readings are read once, however deep."""
    @wraps(rule)
    def kept(self, i: int, *more) -> int:
        key = (rule, i, more)
        got = self.kept.get(key)
        if got is None:
            try:
                got = rule(self, i, *more)
            except Bad as e:
                got = e
            self.kept[key] = got
        if isinstance(got, Bad):
            raise got.with_traceback(None)
        return got

    return kept


class Parser:
    """A permissive reading of one file's tokens; raises Bad where no reading exists."""

    def __init__(self, toks: list[tuple[str, str, bool]], lang: str):
        self.kept: dict[tuple, int | Bad] = {}
        self.t, self.lang, self.n = toks, lang, len(toks)
        self.script = lang in ("js", "ts")
        self.typed = lang != "js"
        self.mods, self.types, self.word_ops, self.no_operand = _MODIFIERS[lang], _TYPES[lang], _WORD_OPS[lang], _NO_OPERAND[lang]

    def v(self, i: int) -> str:
        return self.t[i][1] if i < self.n else ""

    def is_id(self, i: int) -> bool:
        return i < self.n and self.t[i][0] == "id"

    def op(self, i: int, *ops: str) -> bool:
        return i < self.n and self.t[i][0] == "op" and self.t[i][1] in ops

    def need(self, i: int, op: str) -> int:
        if not self.op(i, op):
            raise Bad(f"{op} expected, not {self.v(i)!r} at {i}")
        return i + 1

    # ---- types

    @once
    def type(self, i: int) -> int:
        """The end of a type; raises Bad if there is none."""
        i = self.type_atom(i)
        while True:
            if self.op(i, "[") and self.op(i + 1, "]"):
                i += 2
            elif self.op(i, "[") and self.lang == "cs" and self.op(i + 1, ",") :
                i += 1
                while self.op(i, ","):
                    i += 1
                i = self.need(i, "]")
            elif self.op(i, "[") and self.lang == "ts" and not self.t[i][2]:
                i = self.need(self.type(i + 1), "]")
            elif self.lang == "cs" and self.op(i, "?", "*"):
                i += 1
            elif self.lang == "java" and self.op(i, "..."):
                i += 1
            elif self.lang == "java" and self.op(i, "&"):
                i = self.type_atom(i + 1)
            elif self.lang == "ts" and self.op(i, "|", "&"):
                i = self.type_atom(i + 1)
            elif self.lang == "ts" and self.is_id(i) and self.v(i) in ("is", "extends") and not self.t[i][2]:
                i = self.type(i + 1)
                if self.op(i, "?"):
                    i = self.type(self.need(self.type(i + 1), ":"))
            else:
                return i

    def type_atom(self, i: int) -> int:
        if self.lang == "ts":
            if self.op(i, "|", "&"):
                return self.type_atom(i + 1)
            if self.op(i, "{"):
                return self.members(i + 1, "}")
            if self.op(i, "["):
                i += 1
                while not self.op(i, "]"):
                    i = self.type(i + (1 if self.op(i, "...") else 0))
                    if self.op(i, "?"):
                        i += 1
                    if self.op(i, ":"):
                        i = self.type(i + 1)
                    if self.op(i, ","):
                        i += 1
                    elif not self.op(i, "]"):
                        raise Bad("tuple type")
                return i + 1
            if self.op(i, "("):
                j = self.group(i)
                return self.type(j + 1) if self.op(j, "=>") else j
            if i < self.n and (self.t[i][0] in ("s", "n") or self.op(i, "-")):
                return i + (2 if self.op(i, "-") else 1)
            if self.is_id(i) and self.v(i) in ("keyof", "typeof", "readonly", "infer", "unique", "asserts", "new", "abstract") and (self.is_id(i + 1) or self.op(i + 1, "(", "[", "{")):
                return self.type_atom(i + 1)
        if self.lang == "cs" and self.op(i, "("):
            return self.group(i)
        if self.lang == "java" and self.op(i, "?"):
            return self.type(i + 2) if self.v(i + 1) in ("extends", "super") else i + 1
        while self.lang == "java" and self.op(i, "@"):
            i += 2
        if not self.is_id(i) or self.v(i) in self.no_operand and self.v(i) not in ("void", "in", "const", "static"):
            raise Bad("type expected")
        i += 1
        while True:
            if self.op(i, "<"):
                i = self.type_args(i)
            elif self.op(i, ".", "::") and self.is_id(i + 1):
                i += 2
            else:
                return i

    @once
    def type_args(self, i: int) -> int:
        """The end of <...>; closing >> and >>> are split."""
        i = self.need(i, "<")
        if self.op(i, ">"):
            return i + 1
        if self.lang == "cs" and self.op(i, ","):
            while self.op(i, ","):
                i += 1
            return self.need(i, ">")
        while True:
            while self.lang == "cs" and self.v(i) in ("in", "out") and self.is_id(i + 1):
                i += 1
            i = self.type(i)
            if self.v(i) in ("extends", "super") and self.is_id(i):
                i = self.type(i + 1)
            if self.op(i, "=") and self.lang == "ts":
                i = self.type(i + 1)
            if self.op(i, ","):
                i += 1
            elif self.op(i, ">"):
                return i + 1
            elif self.op(i, ">>", ">>>"):
                kind, text, fresh = self.t[i]
                self.t[i:i + 1] = [("op", ">", fresh), ("op", text[1:], False)]
                self.n += 1
                return i + 1
            else:
                raise Bad("type arguments")

    def constraint(self, i: int) -> int:
        """What a type parameter of C# must be."""
        if self.v(i) == "new":
            return self.group(i + 1)
        if self.v(i) in ("class", "struct", "notnull", "unmanaged", "default"):
            return i + 2 if self.op(i + 1, "?") else i + 1
        return self.type(i)

    def attempt(self, rule, i: int) -> int | None:
        try:
            return rule(i)
        except Bad:
            return None

    # ---- expressions

    @once
    def group(self, i: int, declare: bool = True) -> int:
        """The end of a bracketed list that begins at i: of parameters, or without `declare` of arguments or elements."""
        close = {"(": ")", "[": "]"}[self.v(i)]
        i += 1
        while not self.op(i, close):
            if self.op(i, ","):
                if self.v(i - 1) == "," and not (self.script and close == "]") or self.v(i - 1) in "([" and not (self.script and close == "]"):
                    raise Bad("empty element")
                i += 1
                if self.op(i, close) and not self.script and not (self.lang == "cs" and close == "]"):
                    raise Bad("comma before bracket")
                continue
            i = self.element(i, declare)
            if not self.op(i, ",", close):
                raise Bad(f"{self.v(i)!r} in brackets")
        return i + 1

    def element(self, i: int, declare: bool) -> int:
        if self.op(i, "..."):
            i += 1
        while self.typed and self.op(i, "[") and self.lang == "cs" and self.is_id(i + 1):
            j = self.attempt(self.group, i)
            if j is None or not (self.is_id(j) or self.op(j, "[")):
                break
            i = j
        while self.op(i, "@") and self.lang in ("java", "ts"):
            i += 2
            if self.op(i, "("):
                i = self.group(i)
        if self.lang == "cs" and self.is_id(i) and self.op(i + 1, ":"):
            i += 2
        while self.is_id(i) and self.v(i) in ("ref", "out", "in", "params", "this", "scoped") and self.lang == "cs" and (self.is_id(i + 1) or self.op(i + 1, "(")):
            declare = declare or self.v(i) == "out"
            i += 1
        while self.is_id(i) and self.v(i) in ("final", "public", "private", "protected", "readonly", "override") and self.lang in ("java", "ts") and self.is_id(i + 1):
            i += 1
        if self.lang in ("cs", "java") and declare:
            j = self.attempt(self.type, i)
            if j is not None and self.is_id(j) and self.v(j) not in self.word_ops and self.v(j) not in ("switch", "with", "when", "and", "or", "not") and self.op(j + 1, ",", ")", "=", ":", "]", "["):
                j += 1
                while self.op(j, "[") and self.op(j + 1, "]"):
                    j += 2
                return self.expr(j + 1) if self.op(j, "=", ":") else j
        if self.lang == "ts" and declare and (self.is_id(i) or self.op(i, "{", "[")):
            # name?: type = default
            j = i + 1 if self.is_id(i) else self.attempt(self.operand, i)
            if j is not None:
                k = j + 1 if self.op(j, "?") and self.op(j + 1, ":", ",", ")") else j
                if self.op(k, ":"):
                    m = self.attempt(self.type, k + 1)
                    if m is not None and self.op(m, ",", ")", "="):
                        return self.expr(m + 1) if self.op(m, "=") else m
                elif k > j:
                    return k
        return self.expr(i)

    def operand(self, i: int) -> int:
        if i >= self.n:
            raise Bad("operand expected at the end")
        kind, text, _ = self.t[i]
        if kind in ("n", "s"):
            return i + 1
        if kind == "id":
            if text == "new" and (self.is_id(i + 1) or self.op(i + 1, "(", "[", "{", ".")):
                if self.op(i + 1, "."):
                    return i + 3
                if self.script:
                    j = self.operand_name(i + 1)
                    return j
                if self.op(i + 1, "("):
                    return self.initializer(self.group(i + 1))
                if self.op(i + 1, "["):
                    j = self.need(i + 2, "]")
                    return self.initializer(j)
                if self.op(i + 1, "{"):
                    return self.initializer(i + 1)
                j = self.type_atom(i + 1)
                sized = False
                while self.op(j, "["):
                    j = j + 2 if self.op(j + 1, "]") else self.group(j)
                    sized = True
                if self.op(j, "("):
                    j = self.group(j)
                elif not sized and not self.op(j, "{"):
                    raise Bad("new without arguments")
                if self.op(j, "{"):
                    if self.lang == "java" and not sized:
                        return self.body(j, "class")
                    return self.initializer(j)
                return j
            if text in ("await", "typeof", "void", "delete", "yield", "throw", "stackalloc") and text in {"cs": ("await", "throw", "stackalloc"), "java": (), "js": ("await", "typeof", "void", "delete", "yield"), "ts": ("await", "typeof", "void", "delete", "yield")}[self.lang]:
                if text == "yield" and self.op(i + 1, ")", ";", ",", "]", "}"):
                    return i + 1
                return self.operand(i + 1)
            if self.script and text == "async" and (self.is_id(i + 1) or self.op(i + 1, "(")) and not self.t[i + 1][2]:
                return self.operand(i + 1)
            if self.script and text == "function":
                return self.function(i)
            if self.script and text == "class":
                return self.type_decl(i)
            if text == "switch" and self.lang == "java" and self.op(i + 1, "("):
                return self.body(self.group(i + 1), "code")
            if text == "delegate" and self.lang == "cs" and self.op(i + 1, "(", "{"):
                j = self.group(i + 1) if self.op(i + 1, "(") else i + 1
                return self.body(j, "code")
            if text in self.no_operand or text == "void":
                raise Bad(f"{text} as operand")
            return i + 1
        if text == "(":
            j = self.attempt(lambda k: self.group(k, False), i)
            if j is None or self.op(j, "=>", "->") or self.lang == "ts" and self.op(j, ":"):
                j = self.group(i)  # parameters of a function, or a tuple that is taken apart
                if not self.op(j, "=>", "->", "=", ":") and self.v(j) != "in":
                    raise Bad("parameters without function")
            if not self.script and (self.is_id(j) and self.v(j) not in self.word_ops and self.v(j) not in ("switch", "with", "when", "and", "or") or j < self.n and self.t[j][0] in ("n", "s") or self.op(j, "(", "!", "~")):
                inner = self.attempt(self.type, i + 1)
                if inner is None or inner != j - 1:
                    if j < self.n and self.t[j][0] != "op":
                        raise Bad("no cast")
                    return j
                return self.operand(j) if not self.op(j, "(") else j
            return j
        if text == "[" and self.lang != "java":
            return self.group(i)
        if text == "{" and self.script:
            return self.object(i)
        if text == "<" and self.lang == "ts":
            j = self.type_args(i)
            return self.operand(j)
        if text in _PREFIX:
            return self.postfix(self.operand(i + 1))
        if text == "@" and self.lang == "java":
            raise Bad("annotation as operand")
        raise Bad(f"operand expected, not {text!r} at {i}")

    def operand_name(self, i: int) -> int:
        """new X.Y<T>(...) of scripts."""
        j = i + 1
        while self.op(j, ".") and self.is_id(j + 1):
            j += 2
        if self.lang == "ts" and self.op(j, "<"):
            j = self.type_args(j)
        return self.group(j) if self.op(j, "(") else j

    def initializer(self, i: int) -> int:
        """An optional {...} of values, assignments or nested ones."""
        if not self.op(i, "{"):
            return i
        i += 1
        while not self.op(i, "}"):
            if self.op(i, "{"):
                i = self.initializer(i)
            elif self.op(i, "[") and self.lang == "cs":
                j = self.group(i)
                i = self.value(self.need(j, "=")) if self.op(j, "=") else self.expr(i)
            else:
                i = self.expr(i)
                if self.op(i, "=") :
                    i = self.value(i + 1)
            if self.op(i, ","):
                i += 1
            elif not self.op(i, "}"):
                raise Bad("initializer")
        return i + 1

    def value(self, i: int) -> int:
        """What may follow an equals sign."""
        return self.initializer(i) if self.op(i, "{") and not self.script else self.expr(i)

    @once
    def object(self, i: int) -> int:
        i = self.need(i, "{")
        while not self.op(i, "}"):
            if self.op(i, "..."):
                i = self.expr(i + 1)
            else:
                while self.is_id(i) and self.v(i) in ("get", "set", "async", "static") and (self.is_id(i + 1) or self.op(i + 1, "[", "*") or i + 1 < self.n and self.t[i + 1][0] in ("s", "n")):
                    i += 1
                if self.op(i, "*"):
                    i += 1
                if self.op(i, "["):
                    i = self.group(i)
                elif i < self.n and self.t[i][0] in ("id", "s", "n"):
                    i += 1
                else:
                    raise Bad("property name")
                if self.lang == "ts" and self.op(i, "<"):
                    i = self.type_args(i)
                if self.op(i, "("):
                    i = self.group(i)
                    if self.lang == "ts" and self.op(i, ":"):
                        i = self.type(i + 1)
                    i = self.body(i, "code")
                elif self.op(i, ":"):
                    i = self.expr(i + 1)
                elif self.op(i, "="):
                    i = self.expr(i + 1)
                elif self.t[i - 1][0] != "id":
                    raise Bad("property without value")
            if self.op(i, ","):
                i += 1
            elif not self.op(i, "}"):
                raise Bad("object")
        return i + 1

    def postfix(self, i: int) -> int:
        while i < self.n:
            kind, text, fresh = self.t[i]
            if kind == "op":
                if text in (".", "?.") or text == "::" and self.lang in ("java", "cs") or text == "->" and self.lang == "cs":
                    if self.is_id(i + 1):
                        i += 2
                    elif text == "?." and self.op(i + 1, "(", "["):
                        i = self.group(i + 1)
                    elif text == "." and self.lang == "java" and self.op(i + 1, "<"):
                        i = self.type_args(i + 1) + 1
                    else:
                        raise Bad("member name")
                elif text in ("(", "["):
                    if fresh and self.script and text == "[":
                        return i
                    i = self.group(i, False) if not (text == "[" and self.op(i + 1, "]") and not self.script) else i + 2
                elif text == "?" and self.lang == "cs" and self.op(i + 1, "["):
                    j = self.attempt(self.group, i + 1)
                    if j is None or self.op(j, ":"):
                        return i
                    i = j
                elif text in ("++", "--") and not fresh:
                    i += 1
                elif text == "!" and self.lang in ("cs", "ts") and not fresh:
                    i += 1
                elif text == "<" and self.typed:
                    j = self.attempt(self.type_args, i)
                    if j is not None and (self.op(j, "(", ")", "]", "}", ":", ";", ",", ".", "==", "!=", "?", "?.", "::", "{", "&&", "||") or j >= self.n):
                        i = j
                        if self.op(j, "{"):
                            return i
                    else:
                        return i
                else:
                    return i
            elif kind == "s" and text == "`" and self.script:
                i += 1
            else:
                return i
        return i

    def expr(self, i: int) -> int:
        """The end of an expression, as far as it goes."""
        while True:
            i = self.postfix(self.operand(i))
            if i >= self.n:
                return i
            kind, text, fresh = self.t[i]
            if kind == "id":
                if text in self.word_ops and not (text == "of" and not self.script):
                    if self.lang == "cs" and text in ("is", "as") or self.lang == "java" or self.lang == "ts" and text in ("as", "is", "satisfies"):
                        i = self.pattern(i + 1)
                        while self.is_id(i) and self.v(i) in self.word_ops and not self.t[i][2]:
                            i = self.pattern(i + 1)
                        if i < self.n and self.t[i][0] == "op" and self.t[i][1] in _BINARY or self.op(i, "?"):
                            kind, text, fresh = self.t[i]
                        else:
                            return i
                    else:
                        i += 1
                        continue
                elif text in ("switch", "with") and self.lang == "cs" and self.op(i + 1, "{"):
                    i = self.arms(i + 2) if text == "switch" else self.initializer(i + 1)
                    if i >= self.n or self.t[i][0] != "op":
                        return i
                    kind, text, fresh = self.t[i]
                else:
                    return i
            if kind != "op":
                return i
            if text == "?":
                i = self.need(self.expr(i + 1), ":")
                continue
            if text == ":" and self.lang == "ts":
                # (a): type => body
                j = self.attempt(self.type, i + 1)
                if j is not None and self.op(j, "=>") and self.op(i - 1, ")"):
                    i, text = j, "=>"
            if text == "=>" or text == "->" and self.lang == "java":
                if self.op(i + 1, "{"):
                    i = self.body(i + 1, "code")
                    return self.postfix(i) if self.op(i, ".", "(") and not self.script else i
                i += 1
                continue
            if text in _BINARY:
                if text == ">" and self.op(i + 1, ">", ">=") and not self.t[i + 1][2]:
                    i += 1
                i += 1
                continue
            return i

    @once
    def pattern(self, i: int) -> int:
        """What follows is, as or instanceof."""
        while self.is_id(i) and self.v(i) in ("not", "final", "const"):
            i += 1
        if self.op(i, "{", "("):
            i = self.skip(i)
        elif i < self.n and self.t[i][0] in ("n", "s"):
            i += 1
        elif self.op(i, "<", ">", "<=", ">=", "-"):
            i = self.operand(i + 1)
        else:
            i = self.type(i)
            if self.op(i, "(", "{") and self.lang == "cs":
                i = self.skip(i)
        if self.is_id(i) and self.v(i) in ("and", "or"):
            return self.pattern(i + 1)
        if self.is_id(i) and self.lang in ("cs", "java") and self.v(i) not in ("when", "switch"):
            i += 1
        return i

    def skip(self, i: int) -> int:
        """The end of a balanced bracket, whatever it holds."""
        depth = 0
        while i < self.n:
            if self.op(i, "(", "[", "{"):
                depth += 1
            elif self.op(i, ")", "]", "}"):
                depth -= 1
                if not depth:
                    return i + 1
            i += 1
        raise Bad("bracket not closed")

    def arms(self, i: int) -> int:
        while not self.op(i, "}"):
            while i < self.n and not self.op(i, "=>"):
                i = self.skip(i) if self.op(i, "(", "[", "{") else i + 1
            i = self.expr(self.need(i, "=>"))
            if self.op(i, ","):
                i += 1
            elif not self.op(i, "}"):
                raise Bad("switch arms")
        return i + 1

    # ---- statements

    def end(self, i: int) -> int:
        """The end of a statement: a semicolon, or in scripts a line or block end."""
        if self.op(i, ";"):
            return i + 1
        if self.script and (i >= self.n or self.t[i][2] or self.op(i, "}")):
            return i
        raise Bad(f"; expected, not {self.v(i)!r} at {i}")

    def function(self, i: int) -> int:
        i += 1
        if self.op(i, "*"):
            i += 1
        if self.is_id(i):
            i += 1
        if self.lang == "ts" and self.op(i, "<"):
            i = self.type_args(i)
        if not self.op(i, "("):
            raise Bad("parameters")
        i = self.group(i)
        if self.lang == "ts" and self.op(i, ":"):
            i = self.type(i + 1)
        if self.lang == "ts" and not self.op(i, "{"):
            return self.end(i)
        return self.body(i, "code")

    def body(self, i: int, where: str) -> int:
        i = self.need(i, "{")
        return self.members(i, "}") if where == "class" else self.block(i)

    @once
    def block(self, i: int) -> int:
        while not self.op(i, "}"):
            if i >= self.n:
                raise Bad("block not closed")
            i = self.statement(i)
        return i + 1

    def attributes(self, i: int) -> int:
        while True:
            if self.lang == "cs" and self.op(i, "["):
                j = self.attempt(self.skip, i)
                if j is None:
                    return i
                i = j
            elif self.lang in ("java", "ts", "js") and self.op(i, "@") and self.is_id(i + 1) and self.v(i + 1) != "interface":
                i += 2
                while self.op(i, ".") and self.is_id(i + 1):
                    i += 2
                if self.op(i, "("):
                    i = self.skip(i)
            elif self.lang in ("java", "ts", "js") and self.is_id(i) and self.v(i)[0] == "@":
                i += 1
                while self.op(i, ".") and self.is_id(i + 1):
                    i += 2
                if self.op(i, "("):
                    i = self.skip(i)
            else:
                return i

    def modifiers(self, i: int) -> int:
        while True:
            i = self.attributes(i)
            if self.is_id(i) and self.v(i) in self.mods and not self.op(i + 1, "=", ";", "(", ":", ",", ")", "?", ".", "=>") and not (self.script and self.op(i + 1, "}")):
                if self.v(i) == "non":
                    i += 2
                i += 1
            else:
                return i

    def type_decl(self, i: int) -> int:
        """class, interface, enum, struct or record; i is at that word."""
        word = self.v(i)
        i += 1
        if word == "record" and self.v(i) in ("class", "struct"):
            i += 1
        if self.is_id(i) and not (self.script and self.v(i) in ("extends", "implements")):
            i += 1
        elif not self.script:
            raise Bad("name of a type")
        if self.typed and self.op(i, "<"):
            i = self.type_args(i)
        if self.op(i, "(") and (word == "record" or self.lang == "cs"):
            i = self.group(i)
        if word == "enum" and self.lang == "cs" and self.op(i, ":"):
            i = self.type(i + 1)
        while not self.op(i, "{", ";"):
            if i >= self.n:
                raise Bad("body of a type")
            if self.lang == "cs" and self.op(i, ":"):
                i = self.type(i + 1)
                if self.op(i, "("):
                    i = self.group(i)
            elif self.op(i, ",") and self.typed:
                i = self.type(i + 1)
            elif self.is_id(i) and self.v(i) in ("extends", "implements", "permits"):
                i = self.postfix(self.operand(i + 1)) if self.script and self.lang == "js" else self.type(i + 1)
                if self.script and self.op(i, "("):
                    i = self.group(i)
            elif self.lang == "cs" and self.v(i) == "where":
                i = self.need(i + 2, ":")
                while True:
                    i = self.constraint(i)
                    if not self.op(i, ","):
                        break
                    i += 1
            else:
                raise Bad(f"{self.v(i)!r} in the head of a type")
        if self.op(i, ";"):
            if word != "record" and self.lang != "cs":
                raise Bad("type without body")
            return i + 1
        if word == "enum":
            return self.enum(i + 1)
        return self.members(i + 1, "}")

    def enum(self, i: int) -> int:
        while not self.op(i, "}"):
            i = self.attributes(i)
            if self.op(i, ";") and self.lang == "java":
                return self.members(i + 1, "}")
            if not (self.is_id(i) or self.lang == "ts" and i < self.n and self.t[i][0] == "s"):
                raise Bad("enum member")
            i += 1
            if self.op(i, "(") and self.lang == "java":
                i = self.group(i)
            if self.op(i, "{") and self.lang == "java":
                i = self.body(i, "class")
            if self.op(i, "=") and self.lang != "java":
                i = self.expr(i + 1)
            if self.op(i, ","):
                i += 1
            elif not self.op(i, "}") and not (self.op(i, ";") and self.lang == "java"):
                raise Bad("enum")
        return i + 1

    @once
    def members(self, i: int, close: str) -> int:
        while not self.op(i, close):
            if i >= self.n:
                raise Bad("body not closed")
            i = self.script_member(i) if self.script else self.member(i)
        return i + 1

    def script_member(self, i: int) -> int:
        if self.op(i, ";", ",") :
            return i + 1
        i = self.modifiers(i)
        if self.op(i, "{") and self.v(i - 1) == "static":
            return self.body(i, "code")
        if self.op(i, "*"):
            i += 1
        if self.lang == "ts" and self.op(i, "-", "+") and self.v(i + 1) == "readonly":
            i += 2
        if self.op(i, "["):
            j = self.attempt(self.group, i)
            if j is None and self.lang == "ts":
                j = self.skip(i)  # a mapped type's key
            if j is None:
                raise Bad("computed name")
            i = j
        elif self.op(i, "(", "<") and self.lang == "ts":
            pass
        elif i < self.n and self.t[i][0] in ("id", "s", "n"):
            i += 1
        else:
            raise Bad(f"member expected, not {self.v(i)!r} at {i}")
        if self.lang == "ts" and self.op(i, "?", "!"):
            i += 1
        if self.lang == "ts" and self.op(i, "<"):
            i = self.type_args(i)
        if self.op(i, "("):
            i = self.group(i)
            if self.lang == "ts" and self.op(i, ":"):
                i = self.type(i + 1)
            if self.op(i, "{"):
                return self.body(i, "code")
            if self.lang == "js":
                raise Bad("method without body")
            if self.op(i, "=>"):
                i = self.type(i + 1)
        else:
            if self.lang == "ts" and self.op(i, ":"):
                i = self.type(i + 1)
            if self.op(i, "="):
                i = self.expr(i + 1)
        if self.op(i, ",") and self.lang == "ts":
            return i + 1
        return self.end(i)

    def member(self, i: int) -> int:
        """A member of a C# or Java type."""
        if self.op(i, ";"):
            return i + 1
        i = self.modifiers(i)
        if self.is_id(i) and self.v(i) in self.types and (self.is_id(i + 1) and (self.v(i) != "record" or self.op(i + 2, "(", "{", ";", ":", "<") or self.v(i + 1) in ("struct", "class"))):
            return self.type_decl(i)
        if self.op(i, "@") and self.v(i + 1) == "interface":
            return self.body(i + 3, "class")
        if self.op(i, "{") and self.lang == "java":
            return self.body(i, "code")
        if self.lang == "cs" and self.v(i) == "delegate":
            i = self.type(i + 1)
            i = self.group(i + 1) if self.op(i + 1, "(") else self.group(self.type_args(i + 1))
            return self.end(i)
        if self.lang == "cs" and self.op(i, "~"):
            i += 1
        if self.lang == "java" and self.op(i, "<"):
            i = self.type_args(i)
        if self.is_id(i) and self.op(i + 1, "("):
            i += 1  # a constructor
        elif self.lang == "cs" and self.v(i) == "operator":
            i = self.type(i + 1)
        elif self.lang == "java" and self.is_id(i) and self.op(i + 1, "{"):
            return self.body(i + 1, "code")
        else:
            i = self.type(i)
            if self.lang == "cs" and self.v(i) == "operator":
                i += 2
                if self.op(i, ">", "<", "="):
                    i += 1
            elif self.lang == "cs" and self.v(i) == "this" and self.op(i + 1, "["):
                i = self.group(i + 1)
            elif self.is_id(i):
                i += 1
                while self.op(i, ".") and self.is_id(i + 1) or self.op(i, "<") and self.lang == "cs":
                    i = self.type_args(i) if self.op(i, "<") else (self.group(i + 2) if self.op(i + 2, "[") else i + 2)
            else:
                raise Bad(f"member's name expected, not {self.v(i)!r} at {i}")
        if self.op(i, "("):
            i = self.group(i)
            while self.op(i, "[") and self.op(i + 1, "]"):
                i += 2
            while not self.op(i, "{", ";", "=>"):
                if self.lang == "java" and self.v(i) == "throws" or self.op(i, ",") and self.lang == "java":
                    i = self.type(i + 1)
                elif self.lang == "java" and self.v(i) == "default":
                    i = self.value(i + 1)
                elif self.lang == "cs" and self.op(i, ":") and self.v(i + 1) in ("base", "this"):
                    i = self.group(i + 2)
                elif self.lang == "cs" and self.v(i) == "where":
                    i = self.need(i + 2, ":")
                    while True:
                        i = self.constraint(i)
                        if not self.op(i, ","):
                            break
                        i += 1
                else:
                    raise Bad(f"{self.v(i)!r} after parameters")
            if self.op(i, "{"):
                return self.body(i, "code")
            if self.op(i, "=>") and self.lang == "cs":
                return self.end(self.expr(i + 1))
            return self.end(i)
        if self.op(i, "{") and self.lang == "cs":
            i += 1
            while not self.op(i, "}"):
                i = self.modifiers(i)
                if self.v(i) not in ("get", "set", "init", "add", "remove"):
                    raise Bad("accessor")
                i += 1
                if self.op(i, "{"):
                    i = self.body(i, "code")
                elif self.op(i, "=>"):
                    i = self.end(self.expr(i + 1))
                else:
                    i = self.end(i)
            i += 1
            return self.end(self.value(i + 1)) if self.op(i, "=") else i
        if self.op(i, "=>") and self.lang == "cs":
            return self.end(self.expr(i + 1))
        return self.declarators(i)

    def declarators(self, i: int) -> int:
        """The rest of a declaration after its first name."""
        while True:
            while self.op(i, "[") and self.op(i + 1, "]"):
                i += 2
            if self.op(i, "="):
                i = self.value(i + 1)
            if not self.op(i, ","):
                return self.end(i)
            if not self.is_id(i + 1):
                raise Bad("declared name")
            i += 2

    def head(self, i: int) -> int:
        """( ... ) of a loop, with its own separators."""
        i = self.need(i, "(")
        if self.op(i, ")"):
            return i + 1
        while not self.op(i, ")"):
            if self.op(i, ";", ","):
                i += 1
                continue
            i = self.simple(i)
            if not self.op(i, ";", ",", ")"):
                raise Bad(f"{self.v(i)!r} in the head of a loop")
        return i + 1

    def simple(self, i: int) -> int:
        """A declaration or expression without its end."""
        j = i
        while self.is_id(j) and self.v(j) in ("final", "await", "const", "let", "var", "using", "ref", "scoped"):
            if self.script and self.v(j) in ("const", "let", "var") or self.v(j) in ("final", "ref", "scoped", "const") and not self.script:
                j += 1
                if self.script:
                    break
            else:
                break
        if self.script and j > i:
            while True:
                j = j + 1 if self.is_id(j) else self.operand(j)
                if self.lang == "ts" and self.op(j, "!"):
                    j += 1
                if self.lang == "ts" and self.op(j, ":"):
                    j = self.type(j + 1)
                if self.op(j, "="):
                    return_to = self.expr(j + 1)
                    j = return_to
                elif self.v(j) in ("of", "in") and self.is_id(j):
                    return self.expr(j + 1)
                if not self.op(j, ","):
                    return j
                j += 1
        if not self.script:
            k = self.attempt(self.type, j)
            if k is not None and self.is_id(k) and self.v(k) not in self.word_ops and self.v(k) not in ("switch", "with", "when"):
                k += 1
                while self.op(k, "[") and self.op(k + 1, "]"):
                    k += 2
                if self.op(k, "="):
                    return self.value(k + 1)
                if self.v(k) == "in" and self.is_id(k) and self.lang == "cs" or self.op(k, ":") and self.lang == "java":
                    return self.expr(k + 1)
                if self.op(k, ";", ",", ")"):
                    return k
                raise Bad(f"{self.v(k)!r} after a declared name")
            if k is not None and self.op(j, "(") and self.lang == "cs" and self.op(k, "="):
                return self.expr(k + 1)
        return self.expr(j)

    def statement(self, i: int) -> int:
        if i >= self.n:
            raise Bad("statement expected")
        if self.op(i, "{"):
            return self.block(i + 1)
        if self.op(i, ";"):
            return i + 1
        word = self.v(i) if self.is_id(i) else ""
        after = i + 1
        if word in ("if", "while", "lock", "synchronized", "fixed") and self.op(after, "(") or word == "switch" and self.op(after, "(") and not self.lang == "java":
            if word == "switch":
                return self.cases(self.group(after))
            if word == "if" and self.op(after, "(") and self.op(after + 1, ")"):
                raise Bad("condition expected")
            i = self.statement(self.group(after))
            if word == "if" and self.v(i) == "else" and self.is_id(i):
                i = self.statement(i + 1)
            return i
        if word == "switch" and self.lang == "java" and self.op(after, "("):
            return self.cases(self.group(after))
        if word in ("for", "foreach"):
            if self.v(after) == "await":
                after += 1
            return self.statement(self.head(after))
        if word == "do" and (self.op(after, "{") or self.is_id(after)):
            i = self.statement(after)
            if self.v(i) != "while":
                raise Bad("while expected")
            i = self.group(i + 1)
            return i + 1 if self.op(i, ";") else (i if self.script else self.end(i))
        if word == "try":
            if self.op(after, "(") and self.lang == "java":
                after = self.skip(after)
            i = self.body(after, "code")
            some = False
            while self.v(i) == "catch" and self.is_id(i):
                i += 1
                if self.op(i, "("):
                    i = self.skip(i)
                if self.v(i) == "when" and self.lang == "cs":
                    i = self.group(i + 1)
                i = self.body(i, "code")
                some = True
            if self.v(i) == "finally" and self.is_id(i):
                i = self.body(i + 1, "code")
                some = True
            if not some and not (self.lang == "java"):
                raise Bad("try alone")
            return i
        if word in ("return", "throw", "yield") and (word != "yield" or self.v(after) in ("return", "break")):
            if word == "yield":
                after += 1
            if self.op(after, ";") or self.script and (after >= self.n or self.t[after][2] or self.op(after, "}")):
                return self.end(after)
            return self.end(self.expr(after))
        if word in ("break", "continue", "goto"):
            while self.is_id(after) and not (self.script and self.t[after][2]):
                after += 1
            if self.lang == "cs" and word == "goto" and after < self.n and self.t[after][0] in ("n", "s"):
                after += 1
            return self.end(after)
        if word in ("else", "catch", "finally", "case"):
            raise Bad(f"{word} alone")
        if word == "default" and self.op(after, ":"):
            raise Bad("default alone")
        if word == "using" and self.lang == "cs":
            if self.op(after, "("):
                i = self.need(self.simple(after + 1), ")")
                return self.statement(i)
            return self.end(self.simple(after + (self.v(after) == "var" and 0)))
        if self.script:
            return self.script_statement(i, word)
        if self.is_id(i) and self.op(i + 1, ":") and not self.op(i + 2, ":"):
            return self.statement(i + 2)
        j = self.modifiers(i)
        if self.is_id(j) and self.v(j) in self.types and self.is_id(j + 1) and (self.v(j) != "record" or self.op(j + 2, "(", "{", ";", "<", ":")):
            return self.type_decl(j)
        k = self.attempt(self.type, j)
        if k is not None and self.is_id(k) and self.v(k) not in self.word_ops and self.v(k) not in ("switch", "with"):
            # a local declaration or function
            m = k + 1
            if self.lang == "cs" and self.op(m, "<"):
                m = self.type_args(m)
            if self.op(m, "(") and self.lang == "cs":
                m = self.group(m)
                if self.op(m, "=>"):
                    return self.end(self.expr(m + 1))
                return self.body(m, "code")
            if not self.op(k + 1, "=", ";", ",", "["):
                raise Bad(f"{self.v(k + 1)!r} after a declared name")
            return self.declarators(k + 1)
        if j > i and not (self.lang == "cs" and self.v(i) in ("await", "new")):
            raise Bad("modifier without declaration")
        i = self.expr(i)
        while self.op(i, ",") :
            raise Bad("comma in a statement")
        return self.end(i)

    def cases(self, i: int) -> int:
        i = self.need(i, "{")
        while not self.op(i, "}"):
            if i >= self.n:
                raise Bad("switch not closed")
            if self.v(i) == "case" and self.is_id(i):
                i += 1
                while i < self.n and not self.op(i, ":", "->"):
                    i = self.skip(i) if self.op(i, "(", "[", "{") else i + 1
                    if self.op(i, ";", "}"):
                        raise Bad("case without colon")
                i += 1
            elif self.v(i) == "default" and self.op(i + 1, ":", "->"):
                i += 2
            else:
                i = self.statement(i)
        return i + 1

    def script_statement(self, i: int, word: str) -> int:
        i = self.attributes(i)
        word = self.v(i) if self.is_id(i) else ""
        if word == "import" and not self.op(i + 1, "(", "."):
            i += 1
            if self.v(i) == "type" and self.lang == "ts":
                i += 1
            if self.t[i][0] == "s":
                return self.end(i + 1)
            while not (self.v(i) == "from" and self.is_id(i)):
                if self.op(i, "{"):
                    i = self.skip(i)
                elif self.op(i, "*", ",") or self.is_id(i):
                    if self.op(i, "=") or i + 1 < self.n and self.t[i][0] == "id" and self.t[i + 1][0] == "id" and self.v(i) not in ("as", "type") and self.v(i + 1) not in ("from", "as"):
                        raise Bad("import")
                    i += 1
                elif self.op(i, "=") and self.lang == "ts":
                    return self.end(self.expr(i + 1))
                else:
                    raise Bad("import")
            if i + 1 >= self.n or self.t[i + 1][0] != "s":
                raise Bad("module name")
            i += 2
            if self.v(i) in ("with", "assert") and self.op(i + 1, "{"):
                i = self.skip(i + 1)
            return self.end(i)
        if word == "export":
            i += 1
            if self.op(i, "*"):
                while not self.v(i) == "from":
                    i += 1
                    if i >= self.n:
                        raise Bad("export")
                return self.end(i + 2)
            if self.op(i, "{"):
                i = self.skip(i)
                return self.end(i + 2 if self.v(i) == "from" else i)
            if self.op(i, "=") and self.lang == "ts":
                return self.end(self.expr(i + 1))
            if self.v(i) == "default":
                i += 1
                if self.v(i) in ("class", "function", "async", "abstract", "interface"):
                    return self.statement(i)
                return self.end(self.expr(i))
            return self.statement(i)
        if word in ("const", "let", "var") and (self.is_id(i + 1) or self.op(i + 1, "{", "[")):
            if self.lang == "ts" and word == "const" and self.v(i + 1) == "enum":
                return self.type_decl(i + 1)
            return self.end(self.simple(i))
        if word == "function" or word == "async" and self.v(i + 1) == "function":
            return self.function(i + (word == "async"))
        if word == "class":
            return self.type_decl(i)
        if self.lang == "ts":
            if word in ("declare", "abstract") and self.is_id(i + 1):
                return self.statement(i + 1)
            if word in ("interface", "enum") and self.is_id(i + 1):
                return self.type_decl(i)
            if word == "type" and self.is_id(i + 1):
                i += 2
                if self.op(i, "<"):
                    i = self.type_args(i)
                return self.end(self.type(self.need(i, "=")))
            if word in ("namespace", "module") and (self.is_id(i + 1) or i + 1 < self.n and self.t[i + 1][0] == "s") and not self.t[i + 1][2]:
                i += 2
                while self.op(i, "."):
                    i += 2
                return self.body(i, "code")
        if self.is_id(i) and self.op(i + 1, ":") and word not in ("default", "case"):
            return self.statement(i + 2)
        i = self.expr(i)
        while self.op(i, ","):
            i = self.expr(i + 1)
        return self.end(i)

    def file(self) -> None:
        i = 0
        while i < self.n:
            i = self.script_statement(i, "") if self.script and self.op(i, "@") else self.statement(i) if self.script else self.unit(i)

    def unit(self, i: int) -> int:
        """A C# or Java top-level declaration."""
        word = self.v(i) if self.is_id(i) else ""
        if self.lang == "java":
            if word in ("package", "import"):
                i += 1
                if self.v(i) == "static":
                    i += 1
                while self.is_id(i) or self.op(i, ".", "*"):
                    if self.is_id(i) and self.is_id(i + 1):
                        raise Bad(word)
                    i += 1
                return self.end(i)
            if self.op(i, ";"):
                return i + 1
            j = self.modifiers(i)
            if self.op(j, "@") and self.v(j + 1) == "interface":
                return self.body(j + 3, "class")
            if self.v(j) in self.types and self.is_id(j):
                return self.type_decl(j)
            raise Bad(f"{self.v(j)!r} at the top")
        if word in ("using", "global", "extern") and not self.op(i + 1, "("):
            i += 1
            while self.v(i) in ("using", "static", "alias"):
                i += 1
            if self.is_id(i) and self.op(i + 1, "="):
                return self.end(self.type(i + 2))
            j = self.attempt(self.type, i)
            if j is not None and self.op(j, ";"):
                return j + 1
            return self.end(self.simple(i))
        if word == "namespace":
            i = self.type_atom(i + 1)
            if self.op(i, ";"):
                return i + 1
            i = self.need(i, "{")
            while not self.op(i, "}"):
                if i >= self.n:
                    raise Bad("namespace not closed")
                i = self.unit(i)
            return i + 1
        if self.op(i, "[") or word:
            j = self.modifiers(i)
            if self.v(j) in self.types and self.is_id(j):
                return self.type_decl(j)
            if self.v(j) == "delegate":
                return self.member(i)
            if j >= self.n:
                return j  # only attributes of the assembly
            if self.op(i, "["):
                return j
        return self.statement(i)


# ---- SQL

_SQL_TOKEN = re.compile(r"\s+|--[^\n]*|/\*(?:.|\n)*?\*/|(?P<s>[NEBXnebx]?'(?:''|[^'])*'|\$(?P<tag>\w*)\$(?:.|\n)*?\$(?P=tag)\$)|(?P<q>\"(?:\"\"|[^\"])*\"|`[^`]*`|\[[^\]\n]*\])|(?P<n>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<id>[:@#$]{0,2}[A-Za-z_\u0080-\uffff][\w$#]*)|(?P<op>::|\|\||<>|<=|>=|!=|:=|->>?|=>|[-+*/%=<>(),;.&|^~!?:@\[\]])|(?P<bad>.)")
# Words that begin a statement, that need something after them, and that can't begin an operand.
_SQL_START = set("select insert update delete create alter drop with grant revoke begin commit rollback set declare exec execute use go merge truncate comment copy vacuum explain if call do print values analyze lock savepoint release start end while return raise pragma attach detach replace show describe desc load import refresh reindex cluster prepare deallocate fetch open close listen notify unlisten discard reset checkpoint table upsert waitfor throw else".split())
_SQL_OPEN = set("select from where and or not on set into by having join inner left right full cross union except intersect as values update delete insert alter create drop grant to in like between is case when then else distinct order group limit offset references default constraint primary foreign add column using returning".split()) - {"else", "default", "values"}
_SQL_WORDS = _SQL_OPEN | set("asc desc null end exists all any some table index view unique key check begin commit natural outer fetch first next rows row only for over partition window with recursive cascade restrict if temporary temp trigger procedure function returns language declare go nulls last ilike similar escape collate interval cast filter within".split())


def sql_ok(text: str) -> bool:
    statement: list[tuple[str, str]] = []
    i, n = 0, len(text)
    statements = []
    depth = 0
    while i < n:
        m = _SQL_TOKEN.match(text, i)
        i = m.end()
        kind = m.lastgroup if m.lastgroup != "tag" else "s"
        if kind is None:
            continue
        if kind == "bad":
            return False
        if m[0] == ";" and not depth:
            statements.append(statement)
            statement = []
            continue
        depth += (m[0] == "(") - (m[0] == ")")
        if depth < 0:
            return False
        statement.append((kind, m[0].lower()))
    if depth:
        return False
    statements.append(statement)
    return all(_sql_statement(s) for s in statements if s)


def _sql_statement(s: list[tuple[str, str]]) -> bool:
    while s and s[0] == ("op", "("):
        s = s[1:]
    if not s or s[0][0] != "id" or s[0][1] not in _SQL_START:
        return False
    # T-SQL separates batches by GO and allows statements without semicolons; words that begin one may stand anywhere.
    last = ("op", ";")
    for kind, word in [*s, ("op", ";")]:
        operator = last[0] == "op" and last[1] in "=<><=>=!=<>+-/%||:=" and last[1] not in ("(", ")")
        if kind == "op":
            if word in (")", ",", ";") and (operator or last[1] == "," and last[0] == "op" or last[0] == "id" and last[1] in _SQL_OPEN and not (last[1] == "by" or last[1] in ("to", "set", "left", "right", "to", "default", "insert", "update", "delete", "select", "create", "alter", "drop", "case", "full", "using", "as", "column", "add") and word != ";")):
                return False
            if word in ("=", "<>", "<=", ">=", "!=", "||") and (operator or last[0] == "op" and last[1] in ("(", ",") or last[0] == "id" and last[1] in ("where", "and", "or", "on", "from", "select", "having")):
                return False
            if word == "," and last == ("op", "("):
                return False
        elif kind == "id" and word in ("from", "where", "group", "order", "having", "into") and last[1] == "," and last[0] == "op":
            return False
        elif kind in ("s", "n"):
            if last[0] == "n" or last[0] == "s" and kind == "n":
                return False
        elif last[0] == "n" and word not in _SQL_WORDS and word not in _SQL_START and last[1] != "0" and kind == "id" and not re.match(r"[a-z_]\w*$", word):
            return False
        last = (kind, word)
    words = [w for k, w in s if k == "id"]
    first = words[0]
    if first == "insert" and not ("into" in words or "overwrite" in words or len(words) > 1):
        return False
    if first == "update" and "set" not in words and "statistics" not in words:
        return False
    if first == "delete" and len(s) < 2:
        return False
    if first == "create" and len(words) < 3:
        return False
    if first == "select" and len(s) < 2:
        return False
    if first in ("insert",) and not any(w in ("values", "select", "default", "with", "exec", "execute", "table", "set") for w in words):
        return False
    return True


# ---- exact parsers

def _python_reads(text: str) -> bool | None:
    """None: nested more deeply than the parser reads."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (RecursionError, MemoryError):
        return None
    except (SyntaxError, ValueError):
        return False


def python_ok(text: str) -> bool:
    """Whether a text is valid Python. Where it is nested too deeply for the parser its outer statements are read one by
    one, and only one that is itself too deep counts as valid, once its brackets match."""
    got = _python_reads(text)
    if got is not None:
        return got
    lines, begins, fresh = text.splitlines(keepends=True), [], True
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if fresh and t.type not in (tokenize.NL, tokenize.COMMENT, tokenize.INDENT, tokenize.DEDENT) and t.start[1] == 0 and t.string not in ("else", "elif", "except", "finally"):
                begins.append(t.start[0] - 1)
            fresh = t.type in (tokenize.NEWLINE, tokenize.NL, tokenize.COMMENT, tokenize.DEDENT) and (t.type != tokenize.COMMENT or fresh)
    except (tokenize.TokenError, SyntaxError):
        return False
    return all(_python_reads("".join(lines[a:b])) is not False for a, b in zip(begins, [*begins[1:], len(lines)]))


def _no_constant(name: str):
    raise ValueError(name)


_JSON = re.compile(r'[ \t\r\n]*(?:(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<v>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)|(?P<p>[\[\]{},:])|(?P<end>\Z))', re.A)


def deep_json_ok(text: str) -> bool:
    """Whether a text is strict JSON, however deep; what may come next is all the state besides the open brackets."""
    stack: list[str] = []
    want, i = "value", 0
    while True:
        m = _JSON.match(text, i)
        if not m:
            return False
        i, kind, got = m.end(), m.lastgroup, m[m.lastgroup]
        if kind == "end":
            return want == "after" and not stack
        if want in ("value", "value or ]") and (kind in "sv" or got in "[{"):
            if kind == "p":
                stack.append(got)
                want = "value or ]" if got == "[" else "key or }"
            else:
                want = "after"
        elif want in ("key", "key or }") and kind == "s":
            want = ":"
        elif want == ":" and got == ":":
            want = "value"
        elif want == "after" and got == "," and stack:
            want = "value" if stack[-1] == "[" else "key"
        elif stack and (got == "]" and stack[-1] == "[" and want in ("after", "value or ]") or got == "}" and stack[-1] == "{" and want in ("after", "key or }")):
            stack.pop()
            want = "after"
        else:
            return False


def json_ok(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_no_constant)
        return True
    except RecursionError:
        return deep_json_ok(text)
    except ValueError:
        return False


def xml_ok(text: str) -> bool:
    try:
        xml.parsers.expat.ParserCreate().Parse(text, True)
        return True
    except xml.parsers.expat.ExpatError:
        return False


def reads(text: str, lang: str) -> bool:
    """Whether a balanced text reads as statements of its language."""
    if lang == "py":
        return python_ok(text)
    if lang == "json":
        return json_ok(text)
    if lang == "config":
        return xml_ok(text)
    if lang == "sql":
        return not re.search(r"(?m)^(?:<<<<<<< |>>>>>>> )", text) and sql_ok(text)
    try:
        toks = tokens(text, lang)
    except (Bad, IndexError, KeyError):
        return False
    depth = most = 0
    for kind, word, _ in toks:
        if kind == "op":
            depth += (word in "([{") - (word in ")]}")
            most = max(most, depth)
    # Calls of Python functions need no room on the machine's stack; prefixes and else-ifs nest without brackets.
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(max(old, CALLS * most + 4 * len(toks) + 1_000))
    try:
        Parser(toks, lang).file()
        return True
    except (Bad, IndexError, KeyError):
        return False
    finally:
        sys.setrecursionlimit(old)
