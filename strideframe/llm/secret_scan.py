"""Secrets in texts: exact base spans, and literals that reach a name of a secret.

Base spans (assign, access, hex) come from fixed patterns and checks and always stay. The added
spans (kind ``literal``) come from a lexer that knows assignments: it reads source and
configuration syntax as tokens (names, string literals, bare values, operators, brackets) and
pairs a name with the literals of the expression given to it: ``name = "x" + "y"``,
``"name": "x"``, ``name["key"] = "x"``, ``f(name="x")``, ``setName("x")``, ``NAME=x``, ``name: x``,
``<name>x</name>``, ``key="name" value="x"``, ``--name x`` and ``scheme://user:x@host``. A name that was given literals
carries them on where it is used later in the text (``part = "x"; token = part + "y"``). A literal's
score is the sensitivity of the most sensitive name it reaches, less a little for each step, times a
value for its format (length, mix of characters, no placeholder, no prose); from ``THRESHOLD`` on it
is a span. The lexer reads each text once from its start to its end.

Offsets are code points, ends exclusive; a literal's span leaves out its quotes. A literal that
overlaps a base span isn't added. A null or empty text has no spans. Rows are judged one by one, so
repeated rows get equal answers, and a null id stays null. Other columns of the table aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from strideframe.llm.pii import Span, Taken

KINDS = ["assign", "access", "hex", "literal"]
BASE = 3
THRESHOLD = 0.6
#: what a literal loses with each name it passes on its way to a sensitive one
STEP = 0.95
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")


def base_spans(text: str) -> list[Span]:
    """Base spans in order of start, then kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- names

#: sensitivity of a word in a name
WORDS = {
    "password": 1.0, "passwords": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "secrets": 1.0, "token": 1.0, "tokens": 0.8,
    "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "creds": 1.0, "bearer": 0.9, "jwt": 0.9, "auth": 0.7, "authorization": 0.9, "salt": 0.7, "signature": 0.7,
    "cookie": 0.65, "webhook": 0.65, "dsn": 0.65, "key": 0.5,
}
#: words that make a key a secret one
KEY_OF = {"api", "access", "private", "secret", "encryption", "signing", "master", "account", "storage", "service", "ssh", "deploy", "client", "auth", "hmac", "aes", "shared"}
#: a name that ends in one of these speaks about a secret, it doesn't hold one
ABOUT = {
    "name", "id", "url", "uri", "path", "file", "type", "field", "label", "length", "len", "count", "size", "regex", "pattern", "format", "hint", "placeholder", "prompt", "message", "error",
    "expiry", "ttl", "limit", "policy", "reset", "help", "text", "title", "description", "column", "header", "prefix", "endpoint",
}
#: a call that begins so takes a secret's name, not its value
ASKS = {"get", "read", "fetch", "load", "find", "prompt", "input", "print", "log", "check", "verify", "validate", "is", "has", "assert", "require"}
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def parts(name: str) -> list[str]:
    """Lower-case words of a name in camel, snake, kebab or dotted case."""
    return [x.lower() for x in _PARTS.findall(name)]


def sensitivity(name: str) -> float:
    words = parts(name)
    if not words:
        return 0.0
    best = max(WORDS.get(w, 0.0) for w in words)
    best = max([best, *(WORDS.get(a + b, 0.0) for a, b in zip(words, words[1:], strict=False))])
    if ("key" in words or "keys" in words) and KEY_OF & set(words):
        best = 1.0
    if "public" in words or words[-1] in ABOUT:
        best *= 0.2
    return best


# --- literals

_PLACEHOLDER = re.compile(
    r"[$]|\{\{|\{[A-Za-z0-9_.]*\}|%[sd(]|<[^<>]*>|\.\.\.|(?:x|X|\*|0|-|_){4,}|change.?me|example|placeholder|redacted|^your|^(?:password|passwd|secret|token|none|null|true|false|undefined|default|required|optional)$",
    re.I,
)


def strength(literal: str, bare: bool) -> float:
    """How much a literal looks like a generated or chosen secret rather than a placeholder or prose."""
    n = len(literal)
    if n < 6 or _PLACEHOLDER.search(literal) or "\n" in literal:
        return 0.0
    digit = any("0" <= c <= "9" for c in literal)
    letter = any(c.isalpha() for c in literal)
    if not letter and n < 8 or bare and not (digit and letter):
        return 0.0
    spaces = literal.count(" ")
    if spaces > 1 or literal.startswith(("http://", "https://", "./", "../")):
        return 0.15
    counts = Counter(literal)
    bits = -sum(k / n * log2(k / n) for k in counts.values())
    kinds = sum((any("a" <= c <= "z" for c in literal), any("A" <= c <= "Z" for c in literal), digit, any(not c.isalnum() for c in literal)))
    value = 0.3 + 0.3 * min(1.0, bits / 3.5) + 0.2 * (kinds >= 2) + 0.1 * digit + 0.1 * (n >= 12)
    return value * (0.5 if spaces else 1.0)


# --- the lexer

_TOKEN = re.compile(
    r"""(?P<escape>\\[^\n])
    |(?P<string>"(?:[^"\\\n]|\\[^\n])*"|(?<![A-Za-z0-9_])'(?:[^'\\\n]|\\[^\n])*'|`[^`\n]*`)
    |(?P<name>[A-Za-z_$@][A-Za-z0-9_$]*(?:[.-][A-Za-z_$][A-Za-z0-9_$]*)*)
    |(?P<number>[0-9][A-Za-z0-9_.]*)
    |(?P<give>:=|=>|\?=|\+=|==|!=|=(?!=)|:(?!:|//))
    |(?P<open>[(\[{])
    |(?P<close>[)\]}])
    |(?P<end>[,;])
    |(?P<on>[+|?&.]+)
    |(?P<line>\n)""",
    re.X,
)
# stops at the next operator, so that a line of many is read once
_BARE = re.compile(r"[ \t]*([^\s\"'`,;(){}\[\]<>:=]{6,}={0,2})(?![^\s,;)}\]])")
_TAG = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*)>([^<>\n]{6,})</")
_ATTRIBUTES = re.compile(r"""(?:key|name|id)\s?=\s?"([^"\n]*)"\s{1,8}(?:value|content)\s?=\s?"([^"\n]*)\"""", re.I)
_FLAG = re.compile(r"--([A-Za-z][A-Za-z0-9_-]*)[ ]([^\s\"'-][^\s\"']{5,})")
_LOGIN = re.compile(r"://([^/\s:@]+):([^/\s:@]+)@")


@dataclass
class _Frame:
    """One bracket level: the open assignment, what the expression holds so far, and what could become a target."""

    bracket: str = ""
    target: int = -1
    last: str | None = None
    loose: list[int] = field(default_factory=list)
    going: bool = False  # the last token asks for more: a line end doesn't close the expression


class Pairs:
    """Names and the literals given to them as a graph: node -> literals and earlier nodes."""

    def __init__(self) -> None:
        self.weight: list[float] = []
        self.uses: list[list[int]] = []  # earlier nodes, or literals as -1 - number
        self.literals: list[tuple[int, int, bool]] = []
        self.known: dict[str, int] = {}

    def node(self, name: str, weight: float | None = None) -> int:
        self.weight.append(sensitivity(name) if weight is None else weight)
        self.uses.append([])
        return len(self.uses) - 1

    def literal(self, a: int, b: int, bare: bool = False) -> int:
        self.literals.append((a, b, bare))
        return -len(self.literals)

    def weights(self) -> list[float]:
        """The largest sensitivity that reaches each literal; later nodes hand it down to what they use."""
        out = [0.0] * len(self.literals)
        for i in range(len(self.uses) - 1, -1, -1):
            for use in self.uses[i]:
                if use < 0:
                    out[-1 - use] = max(out[-1 - use], self.weight[i])
                else:
                    self.weight[use] = max(self.weight[use], self.weight[i] * STEP)
        return out


def read_pairs(text: str) -> Pairs:
    """All name-literal pairs of a text, constants handed on."""
    pairs = Pairs()
    frames = [_Frame()]

    def close(frame: _Frame) -> None:
        frame.target, frame.last, frame.going = -1, None, False

    at = 0
    while m := _TOKEN.search(text, at):
        at, kind, token, frame = m.end(), m.lastgroup, m.group(), frames[-1]
        if kind == "escape":
            continue
        if kind == "name" or kind == "string":
            if kind == "string":
                use: int | None = pairs.literal(m.start() + 1, m.end() - 1)
                word = token[1:-1]
            else:
                use, word = pairs.known.get(token), token
            if use is not None:
                if frame.target >= 0:
                    pairs.uses[frame.target].append(use)
                else:
                    frame.loose.append(use)
            frame.last, frame.going = word, False
        elif kind == "number":
            frame.last, frame.going = None, False
        elif kind == "give":
            if frame.last is None:
                frame.going = True
                continue
            if frame.target < 0:
                del frame.loose[-1:]  # the key itself
                node = pairs.node(frame.last)
            else:  # a second operator: the first was an annotation, or the value so far is a target too
                node = pairs.node(frame.last, max(pairs.weight[frame.target], sensitivity(frame.last)))
            if token == "+=" and frame.last in pairs.known:
                pairs.uses[node].append(pairs.known[frame.last])
            if token not in ("==", "!="):
                pairs.known[frame.last] = node
            frame.target, frame.last, frame.going = node, None, True
            bare = _BARE.match(text, at)
            if bare and bare[1] not in pairs.known:
                pairs.uses[node].append(pairs.literal(bare.start(1), bare.end(1), True))
        elif kind == "open":
            frames.append(_Frame(token))
            if token == "(" and frame.last is not None and (parts(frame.last) or [""])[0] not in ASKS and sensitivity(frame.last):
                frames[-1].target = pairs.node(frame.last)
            frame.going = False
        elif kind == "close":
            if len(frames) > 1:
                inner = frames.pop()
                outer = frames[-1]
                if outer.target >= 0:
                    pairs.uses[outer.target] += inner.loose
                elif inner.bracket == "[" and inner.last is not None:
                    outer.last = inner.last
                    outer.loose.append(inner.loose[-1] if inner.loose else pairs.node(""))
                outer.going = False
            else:
                close(frame)
        elif kind == "end":
            if frame.bracket == "(" and frame.target >= 0 and not frame.going and frame.last is None:
                frame.target = -1
            close(frame)
        elif kind == "on":
            frame.going = True
            if token == ".":
                frame.last = None
        elif not frame.going and frame.bracket != "(":
            close(frame)
    for pattern in (_TAG, _ATTRIBUTES, _FLAG, _LOGIN):
        for m in pattern.finditer(text):
            node = pairs.node("password" if pattern is _LOGIN else m[1])
            pairs.uses[node].append(pairs.literal(m.start(2), m.end(2), pattern is _FLAG))
    return pairs


def literal_spans(text: str, base: list[Span]) -> list[Span]:
    """Literals that reach the threshold and overlap no base span; of overlapping ones the best, then the first."""
    pairs, found = read_pairs(text), []
    for (a, b, bare), weight in zip(pairs.literals, pairs.weights(), strict=True):
        if weight >= THRESHOLD and (score := weight * strength(text[a:b], bare)) >= THRESHOLD:
            found.append((-score, (a, BASE, b)))
    if not found:
        return []
    taken, out = Taken(base), []
    for _, span in sorted(found):
        if not taken.overlaps(span):
            out.append(span)
            taken.add(span)
    return out


_STEMS = r"(?i:pass|pwd|secret|token|key|cred|bearer|jwt|auth|salt|signature|cookie|webhook|dsn)"
_MAYBE_BASE = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
#: no pair reaches the threshold without a sensitive word in a name, and something that gives it a value
_MAYBE_PAIR = _STEMS + r"""[A-Za-z0-9_.$-]*["'`)\]\s]*[=:(>?+!]|--[A-Za-z0-9_-]*""" + _STEMS + r"|" + _STEMS + r"""[^"\n]*"\s+(?i:value|content)|://[^/\s:@]+:[^/\s:@]+@"""


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base spans, their digest, and all spans."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            n = len(texts)
            counts, digest, spans = np.zeros((BASE, n), np.int64), [nothing] * n, [""] * n
            based, paired = (pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for p in (_MAYBE_BASE, _MAYBE_PAIR))
            for i in np.flatnonzero(based | paired):
                s = texts[i].as_py()
                base = base_spans(s) if based[i] else []
                for _, kind, _ in base:
                    counts[kind, i] += 1
                digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(sorted(base + literal_spans(s, base))) if paired[i] else joined(base)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(find, SCHEMA)
