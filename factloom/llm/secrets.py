"""Credentials in source code and settings: found by context and by what a dictionary can't explain, and redacted.

Literals in assignment contexts (keys, parameters, connection strings, URLs, headers, comments) are segmented into
dictionary words by Viterbi; a residual that no words explain makes a secret, and the context's name only sets how long it
must be (NEED). A text that words explain is one only as a passphrase. Known formats of hashes, ids, placeholders and references are no secrets. Private keys are found by their
armour, tokens of known shapes anywhere.

Defined results: null and empty texts have no secrets. A secret counts on the line on which its value begins, several
on a line once. Redaction replaces just the secret's characters by REDACTED, so quotes and escapes around it stay; a
private key keeps its armour lines. Texts of any length are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import os
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import or_

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = "REDACTED"
#: Words a passphrase has at least, and unexplained characters that a text of words may have at most.
PASSPHRASE_WORDS, RESIDUAL = 4, 2
#: Unexplained characters and symbols that a secret has by its context's strength, and unexplained share of plain letters or a sentence.
NEED, UNKNOWN = {1: 3, 2: 2}, 0.4
#: Costs of an unexplained letter or digit (one of 36), and of a word's beginning.
UNKNOWN_COST, BEGINS = math.log(36), 1.5
#: Length, Shannon entropy (bits a character) and unexplained share from which an argument in no context at all is a token.
FREE_LENGTH, FREE_ENTROPY, FREE_RESIDUAL = 20, 3.5, 0.4

# Names of secrets in keys, in several languages.
NAMES = set("password passwd passwort kennwort contrasena motdepasse senha parola wachtwoord pwd pass pw psw passphrase secret token apikey credential credentials auth authorization bearer jwt sig signature accesskey accountkey secretkey privatekey signingkey subscriptionkey sharedkey login".split())
# Words before "key" that make it a secret's name, and words after such a name that make it another thing's.
KEY_OF = set("api access account secret private signing subscription shared encryption client auth master host function storage".split())
OTHER = set("hash sha digest checksum label field param parameter header name names endpoint url uri lifetime ttl expiry expires length min max policy id ids count path file type public hint rule rules regex pattern provider manager service handler validator builder factory timeout size enabled version format column table prompt title text message".split())

Q = r"(?:\\?[\"'`]|&quot;|&#34;|&apos;|&#39;)"
IDENT = r"[A-Za-z_][\w.:\-]*"
_CRED_WORD = r"(?:pass(?:word|wd|wort|phrase)?|pwd|pw|psw|kennwort|contrase[nñ]a|mot[_\- ]?de[_\- ]?passe|senha|secret|token|credential|login|auth|key|jwt|bearer|sig|\.DSN|_DSN)"

# Names that are also found when a key spells them as several words.
JOINED = ("motdepasse", "apikey", "accesskey", "accountkey", "signingkey", "subscriptionkey", "secretkey", "privatekey", "sharedkey", "contrasena")
# The keys of two rules that don't ask key_strength.
COUPLE = "login|credentials?|auth|account"
INNER = "password|passwd|passphrase|pwd|pass|pw|secret|accountkey|sharedaccesskey|accesskey|apikey|api_key|token|access_token|client_secret|sig|signature"

# What follows is one list of (name, pattern); group "v" is the value, "k" the key that gives the context.
_PATTERNS = (
    # "key": "value", key = "value", key="X" value="value", key => "value"
    *((f"pair {need}", rf"(?<![\w])(?:{Q})?(?P<k>{IDENT})(?:{Q})?\s*(?::|=>?|:=)\s*(?:@|N(?=')|b(?=[\"'])|r(?=[\"']))?(?<!\\){q}(?P<v>(?:(?!{q}|\n).)*){q}") for q, need in (('(?<!\\\\)"', '"'), ("'", "'"), ("`", "`"), ('\\\\"', '\\"'), ("&quot;", "&quot;"), ("&#34;", "&#34;"), ("&apos;", "&apos;"), ("\\\\'", "\\'"))),
    ("attr", rf"\b(?:key|name)\s*=\s*(?P<q1>[\"'])(?P<k>[^\"'\n]*)(?P=q1)\s+(?:value|connectionString)\s*=\s*(?P<q>[\"'])(?P<v>[^\"']*)(?P=q)"),
    ("attr", rf"\b(?:value|connectionString)\s*=\s*(?P<q>[\"'])(?P<v>[^\"']*)(?P=q)\s+(?:key|name)\s*=\s*(?P<q1>[\"'])(?P<k>[^\"'\n]*)(?P=q1)"),
    ("named", r"\"(?:key|name)\"\s*:\s*\"(?P<k>[^\"\n]*)\"(?:\s*,\s*\"[^\"\n]*\"\s*:\s*\"[^\"\n]*\")*?\s*,\s*\"value\"\s*:\s*\"(?P<v>(?:\\.|[^\"\\])*)\""),
    ("named", r"\"value\"\s*:\s*\"(?P<v>(?:\\.|[^\"\\])*)\"(?:\s*,\s*\"[^\"\n]*\"\s*:\s*\"[^\"\n]*\")*?\s*,\s*\"(?:key|name)\"\s*:\s*\"(?P<k>[^\"\n]*)\""),
    # f("KEY", "value"), also as a default
    ("call", rf"(?:setdefault|getProperty|getenv|get|setProperty|set|put|add|env)\s*\(\s*(?P<q1>[\"'])(?P<k>{IDENT})(?P=q1)\s*,\s*(?P<q>[\"'])(?P<v>[^\"'\n]*)(?P=q)\s*\)"),
    # login = ("user", "value"), Credential("user", "value")
    ("couple", rf"(?P<k>{COUPLE})\w*\W{{0,6}}\s*[({{\[]\s*(?P<q1>[\"'])[^\"'\n]*(?P=q1)\s*,\s*(?P<q>[\"'])(?P<v>[^\"'\n]*)(?P=q)\s*[)}}\]]"),
    # "pw=" + "value"
    ("joined", r"[\"'][^\"'\n]*\b(?P<k>pw|pwd|pass|password|secret|token)\s*=\s*[\"']\s*\+\s*(?P<q>[\"'])(?P<v>[^\"'\n]*)(?P=q)"),
    # password=value inside a longer text; quoted values may hold separators
    ("inner", r"(?<![\w$%{-])(?P<k>" + INNER + r")\s*=\s*(?:(?P<q>\\?'|\\?\"|&quot;|&apos;)(?P<v>(?:(?!(?P=q)|\n).)*)(?P=q)|(?P<u>[^\s;,&\"'`<>)\\]+))"),
    # user:value@host and user/value@host
    ("userinfo", r"\b[a-z][a-z0-9+.\-]*://(?P<k>[^\s:/@\"'<>]*):(?P<v>[^\s/@\"'<>]+)@"),
    ("userinfo", r"\bjdbc:oracle:thin:(?P<k>[^\s/@\"']+)/(?P<v>[^\s@\"']+)@"),
    # webhooks carry their secret in the path
    ("hook", r"https?://[^\s\"'<>]*/hooks?/[\w\-]+/(?P<v>[\w\-]{16,})(?P<k>)"),
    # KEY=value of an environment file, with or without export
    ("env", rf"^[ \t]*(?:export[ \t]+|set[ \t]+)?(?P<k>[A-Z][A-Z0-9_]*)=(?P<q>[\"']?)(?P<v>[^\n\"']*?)(?P=q)[ \t]*\r?$"),
    # --x-password value
    ("option", rf"(?<!\S)--?(?P<k>[\w\-]*(?:password|passwd|token|secret|key|pwd))(?:\s+|=)(?P<q>[\"']?)(?P<v>[^\s\"']+)(?P=q)"),
    # -u user:value
    ("user", r"(?<!\S)(?P<k>-u|--user|--proxy-user)(?:\s+|=)(?P<q>\\?[\"']?)[^\s:\"']+:(?P<v>[^\s\"'\\]+)(?P=q)"),
    # SQL: password 'value', identified by 'value', "value" or value
    ("sql", r"\b(?P<k>password|identified\s+by)\s+N?(?P<q>')(?P<v>[^'\n]*)'"),
    ("sql", r"\b(?P<k>identified\s+by)\s+(?P<q>\\?\")(?P<v>[^\"\\\n]*)(?P=q)"),
    ("sql", r"\b(?P<k>identified\s+by)\s+(?P<v>(?!values\b|password\b|externally\b|globally\b)\w[^\s;,\"'\\]*)"),
    # comments: login is user / value, login kept for ...: user:value, set KEY to value
    ("told", r"\b(?P<k>login|credentials?|account|password)\b[^\n\"'=]{0,40}?(?:\bis\b|:)\s*(?P<n>[\w.\-@]+)\s*(?:\s/\s|:)\s*(?P<v>[^\s\"'<>]+)"),
    ("told", rf"\bset\s+(?P<k>{IDENT})\s+to\s+(?P<v>\S+)"),
    ("told", r"\b(?P<k>password|passwd|pwd|passphrase|token|secret|api[ _-]?key)\s+(?:is|was)\s+(?P<v>[^\s\"'<>,]+)"),
    # HTTP headers
    ("basic", r"\b(?P<k>basic)\s+(?P<v>[A-Za-z0-9+/]{8,}={0,2})(?![\w+/=])"),
    ("bearer", r"\b(?P<k>bearer)\s+(?P<v>[^\s\"'<>\\]{8,})"),
    ("header", r"\b(?P<k>x-api-key|x-auth-token|x-access-token|api-key)\s*:\s*(?P<v>[^\s\"'<>\\]{6,})"),
)
# Texts of which a line must hold one (lower case) for a rule to be tried.
_NEEDS = {"pair": ("=", ":"), "attr": ("value", "connectionstring"), "call": ("(",), "couple": ("login", "credential", "auth", "account"), "joined": ("+",), "inner": ("=",), "userinfo": ("@",), "hook": ("hook",), "env": ("=",), "option": ("-",), "user": ("-u", "--user", "--proxy-user"), "sql": ("password", "identified"), "told": ("login", "credential", "account", "pass", "set ", "pwd", "token", "secret", "key"), "basic": ("basic",), "bearer": ("bearer",), "header": ("x-", "api-key")}
_RULES = [(n.split()[0], (n.split()[1],) if " " in n else _NEEDS[n], re.compile(p, re.M if n == "env" else re.I | re.M)) for n, p in _PATTERNS if n != "named"]
_NAMED = [re.compile(p, re.I) for n, p in _PATTERNS if n == "named"]
# Shapes of well-known tokens, as (beginning, rest).
_SHAPES = ((r"AKIA", r"[A-Z0-9]{16}"), (r"gh[pousr]_", r"[A-Za-z0-9]{30,}"), (r"xox[abprs]-", r"[A-Za-z0-9-]{20,}"), (r"AIza", r"[\w-]{30,}"), (r"sk_(?:live|test)_", r"[A-Za-z0-9]{16,}"), (r"sk-(?:proj-)?", r"[A-Za-z0-9]{20,}"), (r"glpat-", r"[\w-]{20}"), (r"npm_", r"[A-Za-z0-9]{30,}"), (r"eyJ", r"[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}"))
_TOKENS = re.compile(rf"(?<![\w+/=-])(?:{'|'.join(a + b for a, b in _SHAPES)})(?![\w+/])")
# A long literal without spaces that may be an argument, with or without its name; the JVM tests the same pattern.
ARGUMENT = rf"(?:[(,]|[\w)]\s*[:=])\s*[@bruN$]?\\?[\"'`]([\w+/=.~:!#%&*?^-]{{{FREE_LENGTH},}})\\?[\"'`](?=\s*[,)])"
_ARGUMENT = re.compile(ARGUMENT, re.A)
_PEM = re.compile(r"-----BEGIN (?P<t>[A-Z0-9 ]*PRIVATE KEY)-----(?P<b>(?:\\[nr]|&#xA;|&#10;|\s|[\"'+,]|[A-Za-z0-9+/=:,-])*?)(?:-----END [A-Z0-9 ]*PRIVATE KEY-----|\Z)")
_PEM_BODY = re.compile(r"(?<![\\&#])[A-Za-z0-9+/]{16,}={0,2}")

# What stands where a secret would, or names something else.
_NO_SECRET = re.compile(
    r"""^(?:
      \s* | (.)\1* | [*x•.\-#]+ | <.*> | &lt;.*(?:>|&gt;) | .*\$\{.*\}.* | .*\$\(.*\).* | %\w+% | \{\{.*\}\} | \#\{.*\} | .*\{\d*\}.* | \{\w+\} | __\w+__ | \$\w+ | [:@]\w+ | \?
      | env[:.]\S+ | vault[:.]\S+ | secret[:/]\S+ | kv[-:/]\S+ | ref\+\S+ | op://\S+ | arn:\S+ | @Microsoft\.KeyVault\(.*
      | (?:process\.env|os\.environ|System\.getenv|Environment\.|config\.|settings\.)\S*
      | (?:your|my|the|some|insert|enter|replace|put|add|change|fill|todo|dummy|example|sample|fake|test)[-_ ](?:.*[-_ ])?(?:here|key|token|password|secret|me|in|this|value|pass)(?:[-_ ].*)?
      | (?:your|my|insert|enter|replace|change|dummy|example|sample|fake|test)(?:api|access|secret|db)?(?:here|key|token|password|secret|me|this|value|pass)(?:here)? | changeme | redacted | \[?redacted\]? | removed | none | null | nil | undefined | true | false | yes | no | n/a | default | required | optional
      | \d{1,6} | \d\d:\d\d(?::\d\d)? | \d+(?:\.\d+)+ | [\d\s.,:/-]+
      | [0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}
      | \$2[aby]\$\d\d\$.* | \$argon2.* | \$[156]\$.* | (?:sha\d+|md5|pbkdf2|scrypt|bcrypt|argon2\w*)[:$-].* | \{(?:sha|ssha|bcrypt)\}.*
      | https?://[^\s@]*
      | -----BEGIN\ PUBLIC\ KEY.* | ssh-(?:rsa|ed25519)\s.*
    )$""", re.X | re.I | re.S)
_HEX = re.compile(r"^[0-9a-f]{24,128}$", re.I)
_CODE = re.compile(r"^[A-Za-z_][\w.]*\s*[\(\[]")
_SYMBOL = re.compile(r"[^\w\s.:/-]")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zçñé]+|\d+")


def default_words() -> str:
    """The vocabulary whose word tokens serve as dictionary."""
    return os.path.join(os.environ.get("FACTLOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")


class Dictionary:
    """Words with costs; a text is cut into words and unexplained characters at the least cost (Viterbi).

    A cost is the logarithm of how many things could have stood there: a word's rank and that a word begins, or UNKNOWN
    for any letter or digit. So a short rare word explains no more than chance does. A word is read only in lower case,
    with a capital or in capitals.
    """

    def __init__(self, words: dict[str, float], unknown: float = UNKNOWN_COST):
        self.words, self.unknown = words, unknown
        self.longest = max(map(len, words), default=0)

    def segment(self, text: str) -> tuple[list[str], int]:
        """The words found and the number of letters and digits that no word explains."""
        s = text.lower()
        if len(s) != len(text):  # a letter whose lower case is longer
            text = s
        n = len(s)
        cost = [0.0] * (n + 1)
        back: list[tuple[int, bool]] = [(0, False)] * (n + 1)
        for i in range(1, n + 1):
            free = not s[i - 1].isalnum()
            cost[i], back[i] = cost[i - 1] + (0.0 if free else self.unknown), (i - 1, False)
            for j in range(max(0, i - self.longest), i - 2):
                w = self.words.get(s[j:i])
                if w is not None and cost[j] + w < cost[i] and (text[j + 1:i].islower() or text[j:i].isupper()):
                    cost[i], back[i] = cost[j] + w, (j, True)
        found, rest, i = [], 0, n
        while i:
            j, known = back[i]
            if known:
                found.append(s[j:i])
            elif s[j].isalnum():
                rest += 1
            i = j
        return found[::-1], rest


@lru_cache(maxsize=2)
def dictionary(path: str) -> Dictionary:
    """Whole lower-case words of at least three letters in a byte-level BPE vocabulary; cost: logarithm of their rank, and BEGINS."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = {w[1:].lower(): math.log(2 + i) + BEGINS for w, i in sorted(vocab.items(), key=lambda x: -x[1]) if w[0] == "Ġ" and len(w) > 3 and w[1:].isascii() and w[1:].isalpha()}
    return Dictionary(words)


@lru_cache(maxsize=20_000)
def key_strength(key: str) -> int:
    """2: the key names a secret; 1: it may (an unspecified key); 0: it names something else."""
    words = [w.lower() for w in _SPLIT.findall(key)]
    if not words or "public" in words:
        return 0
    for i in range(len(words) - 1, -1, -1):
        w = words[i]
        joined = "".join(words[max(0, i - 2):i + 1])
        if w in NAMES or any(joined.endswith(x) for x in JOINED):
            return 0 if any(x in OTHER for x in words[i + 1:]) or (w == "login" and i < len(words) - 1) else 2
        if w == "key":
            if i and words[i - 1] in KEY_OF:
                return 0 if any(x in OTHER for x in words[i + 1:]) else 2
            return 1 if i == len(words) - 1 and i else 0
        if w in OTHER and i == len(words) - 1:
            return 0
    return 0


def _gate() -> tuple[list[str], list[str], str, str]:
    """What must be there for a rule to accept a value: sure pieces, possible pieces, a pattern for these, odd spellings.

    A lower-case line with a sure piece may hold a secret; one with a possible piece or an odd spelling must also match
    the pattern or spell one of JOINED. They are derived from what the rules need: a key that key_strength accepts, the fixed keys of the rules
    that don't ask it, and the beginnings of tokens; they match within a line. The JVM knows only ASCII spaces and word
    characters, so all others count as both.
    """
    high = "\u0080-\U0010ffff"
    space, gap, any_word = rf"[ \t\r\f\x0b\x1c-\x1f{high}]*", r"[^a-zA-Z0-9\"\n]", rf"[\w{high}]*"
    # Long names stand for the longer ones that hold them; short ones must be words as key_strength cuts them.
    names = {n for n in NAMES if not n.endswith("key")}
    long = sorted(n for n in names if len(n) > 4 or n in ("pass", "pwd", "jwt"))
    long = [n for n in long if not any(m != n and m in n for m in long)]
    short = [n for n in sorted(names) if not any(m in n for m in long)] + ["key"]
    word = {n: rf"(?:(?<![A-Za-z]){n}|{n.title()})(?![a-z])|(?<![A-Z]){n.upper()}(?![A-Za-z])" for n in short}
    word["key"] = rf"[A-Za-z0-9çñé]{gap}*(?:{word['key']})"
    # Rules that ask no more than their own keys; names put together from several words are seen to in _passes.
    parts = [*word.values()]
    parts += [rf"(?iu:(?<![A-Za-z0-9_$%{{-])(?:{INNER}){space}=)", rf"(?iu:(?:{COUPLE}){any_word}[^A-Za-z0-9_\n]{{0,6}}{space}[({{\[]{space}[\"'])"]
    parts += [rf"(?:-u|--user|--proxy-user)(?:[ \t\r\f\x0b\x1c-\x1f{high}]+|=)[^:\n]*:", r"://[^\s:/@\"'<>]*:[^\s/@\"'<>]+@", r"(?iu:basic[^A-Za-z0-9_]|api-key)", *(rf"(?<![A-Za-z0-9_+/=-]){a}" for a, _ in _SHAPES)]
    sure = [*long, "oracle:thin:", "/hook", "identified", "private key-----", "\u017f"]  # the last: a letter that equals s when case is ignored
    maybe = [*short, "account", "-u", "://", "basic", "akia", "gho_", "ghp_", "ghs_", "ghu_", "ghr_", "xox", "aiza", "sk_live_", "sk_test_", "sk-", "glpat-", "npm_", "eyj"]
    odd = [rf"k{gap}+e{gap}*y", rf"ke{gap}+y", *(f"{gap}*".join(n) for n in JOINED if not n.endswith("key"))]
    return sure, maybe, "|".join(parts), rf"(?iu:{'|'.join(odd)})"


#: Where a line may hold a secret; a text without such a line has none.
SURE, MAYBE, CANDIDATE, ODD = _gate()
_CANDIDATE, _ODD = re.compile(CANDIDATE), re.compile(ODD)
_GAP = re.compile(r"[^a-z0-9\"]+")


@lru_cache(maxsize=1)
def _pieces() -> ahocorasick.Automaton:
    """Finds all sure (True) and possible (False) pieces of a lower-case text in one pass."""
    found = ahocorasick.Automaton()
    for pieces, sure in ((MAYBE, False), (SURE, True)):
        for x in pieces:
            found.add_word(x, sure)
    found.make_automaton()
    return found


def _passes(line: str, sure: bool) -> bool:
    """The test of a line with a piece, sure or possible, or of a text with an odd spelling."""
    if sure:
        return True
    close = _GAP.sub("", line.lower())
    return any(x in close for x in JOINED) or _CANDIDATE.search(line) is not None


def candidate_lines(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines that may hold a secret."""
    low = text.lower()
    breaks = [i for i, c in enumerate(low) if c == "\n"] if "\n" in low else []
    ends = breaks if len(low) == len(text) else [i for i, c in enumerate(text) if c == "\n"]
    hit: dict[int, bool] = {}
    for end, sure in _pieces().iter(low):
        n = bisect_left(breaks, end)
        hit[n] = hit.get(n, False) or sure
    if _ODD.search(text):
        hit = {n: hit.get(n, False) for n in range(len(ends) + 1)}
    out = []
    for n in sorted(hit):
        start, end = (ends[n - 1] + 1 if n else 0), (ends[n] if n < len(ends) else len(text))
        if _passes(text[start:end], hit[n]):
            out.append((start, end))
    return out


def entropy(text: str) -> float:
    """Bits a character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def is_argument(text: str, at: int, known: dict[int, bool]) -> bool:
    """Whether what begins at `at` stands directly in the round brackets of a call or constructor.

    `known` has the answers for places before; the way back ends at one on the same level, so it is walked once.
    """
    depth, i, got = 0, at - 1, False
    while i >= 0:
        c = text[i]
        if not depth and i in known:
            got = known[i]
            break
        if c in ")]}":
            depth += 1
        elif c in "([{":
            if not depth:
                j = i - 1
                while j >= 0 and text[j].isspace():
                    j -= 1
                got = c == "(" and j >= 0 and (text[j].isalnum() or text[j] in "_>])")
                break
            depth -= 1
        i -= 1
    known[at] = got
    return got


class Scanner:
    def __init__(self, words: Dictionary):
        self.words = words

    def _explained(self, value: str) -> tuple[list[str], int]:
        return self.words.segment(value)

    def is_token(self, value: str) -> bool:
        """Whether a literal in no context is a token: long, of high entropy and not explained by words."""
        if len(value) < FREE_LENGTH or _NO_SECRET.match(value) or _CODE.match(value) or _HEX.match(value) or "://" in value:
            return False
        return entropy(value) >= FREE_ENTROPY and self._explained(value)[1] >= FREE_RESIDUAL * len(value)

    def is_secret(self, value: str, strength: int) -> bool:
        """Whether a value in a context of that strength is a secret."""
        v = value.strip()
        if len(v) < 4 or _NO_SECRET.match(v) or _CODE.match(v) or (strength < 2 and _HEX.match(v)):
            return False
        if "PRIVATE KEY-----" in v or re.match(r"(?i)(?:basic|bearer)\s|authorization:", v):
            return False  # other rules see to these
        if re.search(r"(?i)\b(?:password|pwd|accountkey|sharedaccesskey|pass)\s*(?:=|&quot;|\\?[\"']\s*:)", v) or re.search(r"://[^/\s]*:[^/\s]*@|://\S*[?&]|thin:\S+/\S+@", v):
            return False  # a longer text with a secret inside
        found, rest = self._explained(v)
        symbols = len(_SYMBOL.findall(v))
        parts = [p for p in re.split(r"[-_. ]", v) if p]
        passphrase = strength >= 1 and " " not in v and min(len(parts), len(found)) >= PASSPHRASE_WORDS and not any(w in NAMES for w in found)
        digits = any(c.isdigit() for c in v)
        if passphrase or (not symbols and not digits and rest <= RESIDUAL):
            return passphrase  # where words explain it all
        if " " in v:
            # A sentence isn't a secret, unless nothing explains it.
            return strength == 2 and rest > UNKNOWN * len(v)
        if not symbols and not digits:
            if any(w in NAMES for w in found):
                return False  # a name such as Rider:Password or X-Loom-Token
            if v.isalpha():
                return strength == 2 and len(v) >= 8 and rest > UNKNOWN * len(v)  # else a word or two
        return rest + symbols >= NEED[strength] and (strength == 2 or len(v) >= 8)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """The disjoint character spans of the secrets of a text, in order."""
        if not text:
            return []
        found: list[tuple[int, int]] = []
        starts = {}
        for m in _PEM.finditer(text):
            body = [(m.start("b") + b.start(), m.start("b") + b.end()) for b in _PEM_BODY.finditer(m["b"])]
            if body:
                found += body
                starts[body[0]] = m.start()
        found += [m.span() for m in _TOKENS.finditer(text)]
        known: dict[int, bool] = {}
        found += [m.span(1) for m in _ARGUMENT.finditer(text) if self.is_token(m[1]) and is_argument(text, m.start(1), known)]
        matches = []
        if '"value"' in text:
            matches += [("named", m) for rule in _NAMED for m in rule.finditer(text)]
        for start, end in candidate_lines(text):
            beyond = (text.find("\n", end + 1) + 1 or len(text) + 1) - 1
            low, both = text[start:end].lower(), text[start:beyond].lower()
            for name, need, rule in _RULES:
                two = name in ("attr", "pair")
                if any(x in (both if two else low) for x in need):
                    matches += [(name, m) for m in rule.finditer(text, start, beyond if two else end)]
        for name, m in matches:
            group = "v" if m["v"] is not None else "u"
            value, key = m[group], m["k"] or ""
            if name in ("inner", "userinfo", "user", "hook", "bearer", "header", "joined", "couple", "sql", "told"):
                strength = 2
                if name == "told" and key_strength(key) == 0:
                    continue
                if name == "inner" and group == "u" and not re.search(r"[\d\W_]", value) and not text[m.end():m.end() + 1] in (";", "&", ",") and not self.is_secret(value, 2):
                    continue  # an unquoted plain name is code
                if name == "inner" and (_CODE.match(text[m.start(group):m.end(group) + 1]) or re.match(r"(?i)get|self\.|this\.|request\.|args\.", value)):
                    continue
                value = value.rstrip(".") if name == "told" else value
            elif name == "basic":
                try:
                    plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
                except (binascii.Error, UnicodeDecodeError):
                    continue
                if ":" in plain and self.is_secret(plain.split(":", 1)[1], 2):
                    found.append(m.span("v"))
                continue
            else:
                strength = key_strength(key)
                if not strength:
                    continue
            if self.is_secret(value, strength):
                a = m.start(group) + len(m[group]) - len(m[group].lstrip())
                found.append((a, m.start(group) + len(value.rstrip())))
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            elif b > a:
                out.append((a, b))
        self.begins = {s: starts.get(s, s[0]) for s in out}
        return out

    def lines(self, text: str) -> list[int]:
        """The numbers, from 1, of the lines on which secrets begin."""
        spans = self.spans(text)
        if not spans:
            return []
        at = [self.begins[s] for s in spans]
        pem = {}
        out = set()
        for (a, _), b in zip(spans, at):
            # Later lines of one private key belong to its first.
            key = next((m for m in _PEM.finditer(text) if m.start() <= a < m.end()), None) if "PRIVATE KEY-----" in text else None
            if key is not None:
                if key.start() in pem:
                    continue
                pem[key.start()] = True
                b = key.start()
            out.add(text.count("\n", 0, b) + 1)
        return sorted(out)

    def redact(self, text: str | None) -> str | None:
        if not text:
            return text
        parts, last = [], 0
        for a, b in self.spans(text):
            parts += [text[last:a], MASK]
            last = b
        return "".join([*parts, text[last:]]) if parts else text


@lru_cache(maxsize=2)
def scanner(path: str) -> Scanner:
    return Scanner(dictionary(path))


def may_hold(text: Column | str) -> Column:
    """The JVM's cheap test that spares Python most rows: whether any line has a sure or possible piece, an odd spelling or
    a long argument. The pattern is left to Python, as few texts with a piece lack it."""
    raw = F.col(text) if isinstance(text, str) else text
    low = F.lower(raw)
    sure, maybe = (reduce(or_, [low.contains(x) for x in pieces]) for pieces in (SURE, MAYBE))
    return F.coalesce(sure | maybe | raw.rlike(ODD) | raw.rlike(ARGUMENT), F.lit(False))


def found_lines(df: DataFrame, text: str, keys: list[str], one_line: bool = False, words: str | None = None) -> DataFrame:
    """(*keys, line_no) for each line of `text` on which a secret begins; with `one_line` line_no is 1."""
    where = words or default_words()
    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "line_no int"])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = scanner(where)
        for pdf in frames:
            rows = []
            for *key, content in pdf[[*keys, text]].itertuples(index=False, name=None):
                lines = s.lines(content)
                rows += [(*key, n) for n in ([1] if one_line and lines else lines)]
            if rows:
                yield pd.DataFrame(rows, columns=[*keys, "line_no"])

    return df.where(may_hold(text)).select(*keys, text).mapInPandas(scan, schema)


def redacted(text: Column | str, words: str | None = None) -> Column:
    """The text with each secret replaced; null stays null."""
    where = words or default_words()

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = scanner(where)
        for texts in batches:
            yield pd.Series([s.redact(t) for t in texts], dtype=object)

    column = F.col(text) if isinstance(text, str) else text
    return F.when(may_hold(column), clean(column)).otherwise(column)
