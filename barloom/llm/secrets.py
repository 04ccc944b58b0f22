"""Secret scan: fixed patterns, and assignment-aware lexing of source and configuration text."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import keep_columns, read

# The base patterns, in the order that settles ties.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH = 6
KINDS = ("assign", "access", "hex", "named", "flow")
# End of the fixed values.

# Name parts and what they add to the belief that a literal given to the name is secret.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3,
             "credentials": 3, "auth": 2, "authorization": 2, "bearer": 2, "signature": 1, "private": 2, "access": 1,
             "key": 1, "api": 1, "client": 1, "encryption": 2, "salt": 1, "session": 1, "cert": 1}
# Values that stand for a secret without being one.
PLACEHOLDERS = {"none", "null", "true", "false", "changeme", "example", "placeholder", "undefined", "redacted", "todo"}
# Literals reported from this score on, and the shortest one scored.
LEAST_SCORE, LEAST_LENGTH = 3.0, 8

# Where an assignment or an element may be.
_SPOT = re.compile(r"[=:<]")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_WORD = re.compile(r"[A-Za-z_][\w.]*")
_BLANK, _SPACE = re.compile(r"[ \t]*"), re.compile(r"\s*")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>#]+""")
_STRING = {q: re.compile(rf"[^{q}\\\n]*(?:\\.[^{q}\\\n]*)*{q}") for q in "\"'"}
_PREFIX = re.compile(r"[A-Za-z]{0,2}(?=[\"'])")
# A tag up to its end, and its attributes. Each of them begins at a character no other match of it can hold.
_TAG = re.compile(r"<(?:[A-Za-z_][\w-]*:)?([A-Za-z_][A-Za-z0-9_.-]*)((?:[\s/][^<>]*)?)>")
_ATTRIBUTE = re.compile(r"""(?<![\w:.-])([\w:.-]+)\s*=\s*(?:"([^"<>\n]*)"|'([^'<>\n]*)')""")
_CLOSE = re.compile(r"\s*</(?:[A-Za-z_][\w-]*:)?([A-Za-z_][A-Za-z0-9_.-]*)\s*>")
_INNER = re.compile(r"[^\s<>]+")
# Types written after a name: "name string = literal"; and the words that declare a name before any type.
_TYPE_WORDS = {"byte", "string", "text", "char", "varchar", "nchar", "nvarchar"}
_DECLARES = {"const", "var", "let"}
# Values that only say where a secret is: templates, and paths whose steps are words.
_TEMPLATE = re.compile(
    r"\$\{.*\}|\$\(.*\)|\{\{.*\}\}|\{[\w .:\[\]!-]*\}|\$(?:[A-Z_][A-Z0-9_]*|[A-Za-z_]+)|%\([\w.]+\)[sdr]|%[A-Za-z_]+%|%[sdr]|<[^<>]*>|<[%?].*[%?]>")
_ROOT = re.compile(r"(?:~|\.{1,2}|[A-Za-z]:|)[/\\]")
_KNOWN_ROOT = re.compile(r"/(?:home|etc|usr|var|opt|tmp|mnt|run|srv|root|dev|proc|Users)/")
_STEP = re.compile(r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+)[0-9]{0,4}|[0-9]{1,8}")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*")


def base_spans(text: str) -> list[tuple]:
    """(start, end, kind) of the base patterns: leftmost and non-overlapping per kind, too short ones dropped."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    # Runs are maximal, so a repeat count finds the same ones as a length test after the match.
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return found


def sensitivity(name: str) -> float:
    """Sum over the parts of a camelCase, snake_case or dotted name."""
    return float(sum(SENSITIVE.get(part.lower(), 0) for part in _PARTS.findall(name)))


def _is_path(literal: str) -> bool:
    """Whether a literal names a file: a root, then steps made of words and short numbers."""
    root = _ROOT.match(literal)
    if not root:
        return False
    steps = re.split(r"[._@ /\\-]+", literal[root.end():])
    return bool(_KNOWN_ROOT.match(literal)) or all(not s or _STEP.fullmatch(s) for s in steps) and any(steps)


def strength(literal: str) -> float:
    """How much a literal looks like key material: bits per character and mix of character classes."""
    if len(literal) < LEAST_LENGTH or literal.lower().strip("<>*x.-_$%{}") in PLACEHOLDERS | {""} or " " in literal.strip():
        return -10.0
    if "://" in literal or _TEMPLATE.fullmatch(literal) or _is_path(literal):
        return -10.0
    counts = Counter(literal)
    bits = -sum(c / len(literal) * math.log2(c / len(literal)) for c in counts.values())
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return (bits - 2.5) + 0.5 * (classes - 1)


def _assigns(text: str) -> bool:
    return "=" in text or ":" in text or "</" in text


class Lexer:
    """Name-literal pairs of a text in one forward pass over its operators and tags.

    At each operator the words before it give the name, what follows gives the value; nothing has a length limit. No
    stretch of text is read more often than a fixed number of times: looking back stops at the operator before, and what
    is looked for ahead (ends of strings and sections) is remembered where it was not found.
    """

    def __init__(self, text: str):
        self.text, self.end = text, len(text)
        self.section = -1  # the next end of a section, where it is known
        self.section_end = 0  # tags before this one lie in a section
        self.unclosed: dict[str, int] = {}  # up to here no string of this quote ends

    def pairs(self) -> list[tuple[str, str, int, int, bool]]:
        """(name, value, start, end, quoted) of each assignment in order; the span is the value's."""
        out, cursor, text = [], 0, self.text
        for m in _SPOT.finditer(text):
            at = m.start()
            if text[at] == "<":
                if at >= self.section_end:
                    out += self.element(at)
            elif at >= cursor:
                found, cursor = self.assignment(at, cursor)
                out += found
        return [p[1:] for p in sorted(out)]

    def element(self, at: int) -> list[tuple]:
        """The literal of an element, or of one that names it by an attribute."""
        tag = _TAG.match(self.text, at)
        if not tag:
            return []
        held = {}
        for a in _ATTRIBUTE.finditer(self.text, tag.start(2), tag.end(2)):
            held.setdefault(a[1], (a[2] if a[2] is not None else a[3], a.start(a.lastindex), a.end(a.lastindex)))
        inner = self.inner(tag)
        out = [(at, tag[1], *inner, True)] if inner else []
        key = next((held[k][0] for k in ("name", "key", "id") if k in held), None)
        value = held.get("value", inner)
        if key and value and _NAME.fullmatch(key.replace("-", "_")):
            out.append((at, key, *value, True))
        return out

    def inner(self, tag: re.Match) -> tuple[str, int, int] | None:
        text = self.text
        start = _SPACE.match(text, tag.end()).end()
        if text.startswith("<![CDATA[", start):
            start = _SPACE.match(text, start + 9).end()
            if self.section < start and self.section != self.end:
                found = text.find("]]>", start)
                self.section = found if found >= 0 else self.end
            if self.section >= self.end:
                return None
            self.section_end = self.section
            stop, after = self.section, self.section + 3
            close = _CLOSE.match(text, after)
            if not close or close[1] != tag[1]:
                return None
            value = text[start:stop].rstrip()
            return (value, start, start + len(value)) if value and not any(c.isspace() for c in value) else None
        run = _INNER.match(text, start)
        close = run and _CLOSE.match(text, run.end())
        return (run[0], run.start(), run.end()) if close and close[1] == tag[1] else None

    def assignment(self, at: int, floor: int) -> tuple[list[tuple], int]:
        """Pairs made by the operator at ``at``, and where reading goes on. Nothing before ``floor`` is a name."""
        text = self.text
        pair, sign = text[at:at + 2], text[at]
        if pair in ("==", "::") or text.startswith("://", at):
            after = at + 1
            while text[after:after + 1] == sign:
                after += 1
            return [], after
        after = at + 2 if pair in (":=", "=>") else at + 1
        if after < self.end and text[after] == "=":
            return [], after + 1
        stop = at
        if sign == ":" and stop > floor and text[stop - 1] == "?":
            stop -= 1
        name, start, before = self.name(stop, floor)
        if not name:
            return [], after
        if pair == ":" + text[after:after + 1] and sign == ":":  # one colon: a type may follow
            typed = self.type(_BLANK.match(text, after).end())
            if typed > 0:
                equal = _BLANK.match(text, typed).end()
                if text[equal:equal + 1] == "=" and text[equal + 1:equal + 2] not in ("=", ">", "~"):
                    value = self.value(equal + 1)
                    return ([(start, name, *value)], value[2]) if value else ([], equal + 1)
        value = self.value(after)
        if not value:
            return [], after
        out = [(start, name, *value)]
        if sign == "=" and after == at + 1 and before is not None:
            first, first_start, declared, of_type = before
            if of_type:
                out = [(first_start, first, *value)]
            elif declared and value[3]:
                out.insert(0, (first_start, first, *value))
        return out, value[2]

    def back(self, at: int, floor: int) -> int:
        while at > floor and self.text[at - 1] in " \t":
            at -= 1
        return at

    def word(self, at: int, floor: int) -> tuple[str, int]:
        """The name that ends at ``at``, empty if there is none."""
        start = at
        while start > floor and self.text[start - 1] in _NAME_CHARS:
            start -= 1
        while start < at and not (self.text[start].isalpha() or self.text[start] == "_"):
            start += 1
        return self.text[start:at], start

    def name(self, at: int, floor: int) -> tuple[str, int, tuple | None]:
        """(name, its start, the word before it) in front of an operator. The word before may be the name of a typed one:
        (word, start, whether a declaration begins there, whether what follows it is a type)."""
        text = self.text
        at = self.back(at, floor)
        sized = False
        if at > floor and text[at - 1] == ")":  # varchar(20)
            inside = self.back(at - 1, floor)
            while inside > floor and text[inside - 1].isalnum():
                inside -= 1
            inside = self.back(inside, floor)
            if inside <= floor or text[inside - 1] != "(":
                return "", at, None
            at, sized = self.back(inside - 1, floor), True
        else:
            if at > floor and text[at - 1] in "\"'":
                at -= 1
            if at > floor and text[at - 1] == "]":
                at -= 1
                if at > floor and text[at - 1] in "\"'":
                    at -= 1
                else:
                    inside = at
                    while inside > floor and text[inside - 1] in "0123456789":
                        inside -= 1
                    if inside > floor and text[inside - 1] == "[":
                        at = inside - 1
        name, start = self.word(at, floor)
        if not name:
            return "", at, None
        marks = start
        while marks > floor and text[marks - 1] in "*&[]":
            marks -= 1
        gap = self.back(marks, floor)
        if gap == marks:
            return ("", at, None) if sized else (name, start, None)
        first, first_start = self.word(gap, floor)
        of_type = name.lower() in _TYPE_WORDS and (name != "byte" or text[marks:start] == "[]")
        if not first or first in _DECLARES:
            return ("", at, None) if sized else (name, start, None)
        keyword, _ = self.word(self.back(first_start, floor), floor)
        if sized and not of_type:
            return "", at, None
        return name, start, (first, first_start, keyword in _DECLARES, of_type)

    def type(self, at: int) -> int:
        """End of a type that begins at ``at``, or -1: words, each with brackets of any depth, joined by bars."""
        text = self.text
        while True:
            while text[at:at + 1] in ("&", "*"):
                at += 1
            if text[at:at + 1] == "'":
                life = _WORD.match(text, at + 1)
                if not life:
                    return -1
                at = _BLANK.match(text, life.end()).end()
            word = _WORD.match(text, at)
            if word and word[0] == "mut":
                word = _WORD.match(text, _BLANK.match(text, word.end()).end())
            if not word:
                return -1
            at = word.end()
            while text[at:at + 1] in ("[", "<"):
                depth = 0
                while at < self.end:
                    c = text[at]
                    if c in "\n:;=":
                        return -1
                    depth += (c in "[<") - (c in "]>")
                    at += 1
                    if not depth:
                        break
                if depth:
                    return -1
            if text[at:at + 1] in ("?", "!"):
                at += 1
            bar = _BLANK.match(text, at).end()
            if text[bar:bar + 1] != "|":
                return at
            at = _BLANK.match(text, bar + 1).end()

    def value(self, at: int) -> tuple[str, int, int, bool] | None:
        """(value, start, end, quoted) of the literal or name that follows ``at`` on its line."""
        text = self.text
        at = _BLANK.match(text, at).end()
        quote = _PREFIX.match(text, at)
        if quote:
            mark = text[quote.end()]
            start = quote.end() + 1
            if start > self.unclosed.get(mark, -1):
                closed = _STRING[mark].match(text, start)
                if closed:
                    return text[start:closed.end() - 1], start, closed.end() - 1, True
                line = text.find("\n", start)
                self.unclosed[mark] = line if line >= 0 else self.end
            return None
        bare = _BARE.match(text, at)
        return (bare[0], at, bare.end(), False) if bare else None


def pairs(text: str) -> list[tuple[str, str, int, int, bool]]:
    return Lexer(text).pairs()


def assigned_spans(text: str) -> list[tuple]:
    """(start, end, kind, name, score) of literals that reach a sensitive name, directly or through constants.

    Assignments are read in order. A name assigned from another name takes its literal (the latest before it),
    so ``x = "..."; password = x`` reports the literal of ``x`` as ``flow``.
    """
    known: dict[str, tuple[str, int, int]] = {}
    out = []
    for name, value, start, end, quoted in pairs(text):
        source = (value, start, end)
        flows = not quoted and _NAME.fullmatch(value) is not None
        if flows:
            source = known.get(value)
            if source is None:
                continue
        known[name] = source
        named = sensitivity(name)
        if named <= 0:
            continue
        score = named + strength(source[0])
        if score >= LEAST_SCORE:
            out.append((source[1], source[2], 4 if flows else 3, name, score))
    return out


def scan_text(text: str) -> list[tuple]:
    """All spans of a text by (start, kind, end): base ones always, assigned ones that lie in no base one."""
    base = base_spans(text)
    found = {(s, k, e): (None, None) for s, e, k in base}
    if _assigns(text):
        for s, e, k, name, score in assigned_spans(text):
            if not any(b[0] <= s and e <= b[1] for b in base):
                held = found.get((s, k, e))
                if held is None or held[1] < score:
                    found[s, k, e] = name, score
    return [(KINDS[k], s, e, *found[s, k, e]) for s, k, e in sorted(found)]


SPANS = "array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: (kind, start, end, name, score) of each find, in code points, end exclusive.

    ``assign``, ``access`` and ``hex`` are the base patterns. ``named`` is a literal assigned to a sensitive name,
    ``flow`` one that reaches it through other names. Names, literals, types and tags have no length limit, and the time for
    a text grows with its length (``Lexer``). Types hold no colon or line end. Whole texts are read; null and empty ones have no finds.
    A column ``secrets`` is replaced; repeated rows are scanned alike; no rows give no rows.
    """
    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("name", pa.string()), ("score", pa.float64())]))
        fields = ("kind", "start", "end", "name", "score")
        return pa.array([[dict(zip(fields, s, strict=True)) for s in scan_text(t.as_py() or "")] for t in texts], kind)

    return docs.select(*[F.col(f"`{c}`") for c in keep_columns(docs, "secrets")],
                       run(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("secrets"))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed("secrets").alias("spans"), *[count(k) for k in KINDS[3:]])
