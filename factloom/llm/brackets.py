"""Lexer-state maps and bracket summaries of chunks of source text, which combine associatively.

A chunk is scanned once from every state in which it may begin (code, a block comment, each kind of string that spans
lines). The result for a start state is the end state, whether something impossible was met, and a bracket summary:
the closers it leaves unmatched and the openers it leaves open. Two neighbouring chunks combine by looking up the
first one's end state in the second one's map and cancelling openers against closers, so chunks can be reduced in
any grouping, over tasks and machines.

An unmatched brace may close a hole of a string that was opened chunks before, at any nesting; scanning alone takes it
for a plain brace. So each unmatched brace carries the key of another reading, in which the string goes on after it; the
reduction takes that one where the brace meets a hole. What is wrong in a reading counts only after its unmatched braces.
"""

from __future__ import annotations

import re
from typing import NamedTuple

PAIRS = {")": "(", "]": "[", "}": "{"}
#: Openers that are holes of strings, and the state that goes on after them.
HOLES = {"${": "bt", "i{": "i"}
#: Characters of a chunk; it ends with a line.
CHUNK = 4_096
#: A start state, or the reading after an unmatched brace: (chunk, place).
Start = str | tuple[int, int]


class Part(NamedTuple):
    """What a chunk does from one start. ends: the end state; closes, opens: unmatched brackets, braces with the key of
    their other reading; bad: an error after the unmatched closers."""

    ends: str
    closes: tuple[tuple[str, tuple[int, int] | None], ...]
    opens: tuple[str, ...]
    bad: bool


# For each language what begins in code (state, pattern) and the states' ends.
_C_LIKE = r"(?P<line>//)|(?P<block>/\*)"
_CODE = {
    "cs": rf"{_C_LIKE}|(?P<raw>\$*\"\"\"+)|(?P<vi>\$@\"|@\$\")|(?P<v>@\")|(?P<i>\$\")|(?P<dq>\")|(?P<sq>')|(?P<pre>^[ \t]*\#(?:if|else|elif|endif|region|endregion|pragma|nullable|define|undef|error|warning|line)\b[^\n]*)|(?P<b>[()\[\]{{}}])",
    "java": rf"{_C_LIKE}|(?P<tdq>\"\"\")|(?P<dq>\")|(?P<sq>')|(?P<b>[()\[\]{{}}])",
    "ts": rf"{_C_LIKE}|(?P<bt>`)|(?P<dq>\")|(?P<sq>')|(?P<re>/)|(?P<b>[()\[\]{{}}])",
    "py": r"(?P<line>\#)|(?P<tdq>[rRbBuUfF]{0,2}\"\"\")|(?P<tsq>[rRbBuUfF]{0,2}''')|(?P<dq>\")|(?P<sq>')|(?P<b>[()\[\]{}])",
    "sql": r"(?P<line>--)|(?P<block>/\*)|(?P<dollar>\$\w*\$)|(?P<ms>')|(?P<md>\")|(?P<mb>`)|(?P<bq>\[[^\]\n]*\])|(?P<b>[()])",
    "json": r"(?P<dq>\")|(?P<b>[\[\]{}])",
}
_CODE["js"] = _CODE["ts"]
_CODE = {k: re.compile(v, re.M) for k, v in _CODE.items()}
_END = {
    "line": re.compile(r"\n|\Z"), "block": re.compile(r"\*/"), "dq": re.compile(r"\"|\n|\\(?:.|\n)|\Z", re.S), "sq": re.compile(r"'|\n|\\(?:.|\n)|\Z", re.S),
    "v": re.compile(r"\"\"|\""), "vi": re.compile(r"\"\"|\""), "i": re.compile(r"\"|\n|\\.|\{\{|\{|\Z"), "bt": re.compile(r"`|\\(?:.|\n)|\$\{", re.S),
    "tdq": re.compile(r"\\(?:.|\n)|\"\"\"", re.S), "tsq": re.compile(r"\\(?:.|\n)|'''", re.S), "ms": re.compile(r"''|\\'(?=\w)|'"), "md": re.compile(r"\"\"|\""), "mb": re.compile(r"`"),
}
#: States that may span lines, besides code, dollar tags and raw strings, by language.
SPANNING = {"cs": ("block", "v", "vi"), "java": ("block", "tdq"), "ts": ("block", "bt"), "js": ("block", "bt"), "py": ("tdq", "tsq"), "sql": ("block", "ms", "md", "mb"), "json": ()}
#: The state after a hole, by language.
RESUMED = {"cs": "i", "ts": "bt", "js": "bt"}
_BEFORE_REGEX = re.compile(r"(?:^|[=(,:;!&|?{}\[+\-*%<>~^]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new|await|yield))\s*$")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_QUOTES = re.compile(r'"{3,}')


def scan(text: str, lang: str, state: str = "code", i: int = 0, chunk: int = 0) -> Part:
    """Scan a chunk from a state and a place."""
    code, n = _CODE[lang], len(text)
    opens: list[str] = []
    closes: list[tuple[str, tuple[int, int] | None]] = []
    part = lambda ends, bad: Part(ends, tuple(closes), tuple(opens), bad)
    while i < n:
        if state == "code":
            m = code.search(text, i)
            if not m:
                break
            i, kind, got = m.end(), m.lastgroup, m[0]
            if kind == "b":
                if got not in PAIRS:
                    opens.append(got)
                elif not opens:
                    closes.append((got, (chunk, i) if got == "}" and lang in RESUMED else None))
                else:
                    top = opens.pop()
                    if top in HOLES and got == "}":
                        state = HOLES[top]
                    elif top != PAIRS[got]:
                        return part(state, True)
            elif kind == "re":
                line = text[max(0, text.rfind("\n", 0, m.start()) + 1):m.start()]
                if _BEFORE_REGEX.search(line) and (r := _REGEX.match(text, m.start())):
                    i = r.end()
            elif kind == "raw":
                state = "until " + got.lstrip("$")
            elif kind == "dollar":
                state = "until " + got
            elif kind in ("pre", "bq"):
                pass
            else:
                state = kind
            continue
        if state.startswith("until "):
            end = text.find(state[6:], i)
            if end < 0:
                break
            i, state = end + len(state) - 6, "code"
            continue
        m = _END[state].search(text, i)
        if not m:
            i = n
            break
        i, got = m.end(), m[0]
        if state == "line" or state == "block":
            state = "code"
        elif state in ("dq", "sq", "i"):
            if got in ("\n", "") or got == "\\" and i >= n:
                return part(state, True)
            if got in ("\"", "'"):
                state = "code"
            elif got == "{" and state == "i":
                opens.append("i{")
                state = "code"
        elif state == "bt":
            if got == "`":
                state = "code"
            elif got == "${":
                opens.append("${")
                state = "code"
        elif state in ("tdq", "tsq"):
            if got in ('"""', "'''"):
                state = "code"
        elif got in ("\"", "'", "`"):
            state = "code"
    if state == "line":
        state = "code"
    return part(state, state in ("dq", "sq", "i"))


def reached(parts: dict[Start, Part], starts: list[Start]) -> dict[Start, Part]:
    """The parts of `starts` and of the other readings that these may need."""
    out: dict[Start, Part] = {}
    todo = list(starts)
    while todo:
        k = todo.pop()
        if k not in out:
            out[k] = parts[k]
            todo += [key for _, key in parts[k].closes if key is not None]
    return out


def state_map(text: str, lang: str, number: int) -> dict[Start, Part]:
    """The chunk's part for each state in which it may begin, and for each other reading; chunk 0 of a file begins in code."""
    starts: list[str] = ["code"]
    if number:
        starts += SPANNING[lang]
        if lang == "sql":
            starts += [f"until {t}" for t in sorted(set(re.findall(r"\$\w*\$", text)))]
        if lang == "cs":
            starts += [f"until {'\"' * n}" for n in range(3, max(map(len, _QUOTES.findall(text)), default=2) + 1)]
    out: dict[Start, Part] = {s: scan(text, lang, s, 0, number) for s in starts}
    todo = list(out.values())
    while todo:
        for _, key in todo.pop().closes:
            if key is not None and key not in out:
                out[key] = scan(text, lang, RESUMED[lang], key[1], number)
                todo.append(out[key])
    return out


def join(a: Part, b: Part, readings: dict[Start, Part]) -> Part:
    """Two neighbouring parts as one; b begins in the state in which a ends. `readings`: the other ones of b's braces."""
    if a.bad:
        return a
    opens, closes = list(a.opens), list(a.closes)
    while True:
        for c, key in b.closes:
            if not opens:
                closes.append((c, key))
                continue
            top = opens.pop()
            if c == "}" and top in HOLES:
                b = readings[key]
                break
            if PAIRS[c] != top:
                return Part(b.ends, tuple(closes), tuple(opens), True)
        else:
            return Part(b.ends, tuple(closes), (*opens, *b.opens), b.bad)


def combine(a: dict[Start, Part], b: dict[Start, Part]) -> dict[Start, Part]:
    """The map of two neighbouring chunks."""
    out: dict[Start, Part] = {}
    for start, x in a.items():
        y = b.get(x.ends)
        # Only a string's end that the second chunk doesn't mention is no start of it: the string goes on.
        out[start] = join(x, y, b) if y is not None else x._replace(bad=x.bad or not x.ends.startswith("until "))
    passed = [k for k in b if isinstance(k, str) and k.startswith("until ") and k not in a]  # such strings go through the first chunk
    return reached({**b, **out}, [*a, *passed])


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """The text in pieces of about `size` characters, each ending with a line that doesn't go on by a backslash."""
    out, i, n = [], 0, len(text)
    while n - i > size:
        j = text.find("\n", i + size)
        while j > 0 and text[j - 1] == "\\":
            j = text.find("\n", j + 1)
        if j < 0:
            break
        out.append(text[i:j + 1])
        i = j + 1
    out.append(text[i:])
    return out


def balanced(whole: Part) -> bool:
    """Whether a file's part ends in code with every bracket matched."""
    return not whole.bad and whole.ends == "code" and not whole.closes and not whole.opens
