"""Secret scans: fixed patterns, and literals that source or configuration gives to sensitive names.

Three patterns make the base: assignments to a few names, access keys, and long hex. The
method reads every ``name = value`` of a text: assignments, keyword arguments, mappings,
``key: value`` lines, ``name: type = value``, subscripts (``env["NAME"] = value``) and XML
elements. A value is string literals and names joined by ``+`` or ``.``, or one bare word;
``${name}`` inside it is a name too. Names stand for what was given to them last before
that place, or else first after it, so that a constant counts where it was written. The
words of a target name (camel case, dots, dashes and underscores part them) and the shape
of what it gets make a score; literals of ``THRESHOLD`` or more are spans of kind
``literal``, without their quotes.

Defined cases: null texts are empty; texts without findings have empty lists; equal rows
are scanned alike; long texts are scanned whole, in time linear to their length, also
where a name refers to itself; columns other than the id are not carried over. Places
are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.columns import as_text
from textloom.plans.workdir import ship_package

# The patterns of the base, and how long what they find must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "literal")

# Words of a name, and words next to each other, that make it sensitive.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "token": 1.0,
             "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "accesskey": 1.0, "privatekey": 1.0,
             "secretkey": 1.0, "bearer": 0.9, "authorization": 0.9, "auth": 0.7, "jwt": 0.9, "salt": 0.7, "pin": 0.6}
SENSITIVE_PAIRS = {(a, "key") for a in ("api", "access", "private", "secret", "encryption", "signing", "master", "auth",
                                        "account", "shared", "service", "deploy", "storage")}
# What a name that ends so holds is about a secret, and not one.
ABOUT = {"name", "file", "path", "url", "uri", "type", "length", "len", "size", "count", "field", "hint", "id", "policy",
         "expires", "expiry", "ttl", "regex", "pattern", "label", "prompt", "message", "error", "enabled", "required",
         "header", "format", "min", "max", "timeout", "class", "endpoint", "algorithm", "column", "env", "var"}
STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "jwt", "salt", "pin")
PLACEHOLDER = re.compile(r"(?i)^(?:(?:your|my|the|some|insert|enter|change|replace|dummy|example|sample|placeholder|todo"
                         r"|none|null|nil|true|false|undefined|unknown|redacted|secret|password|passwd|token|string"
                         r"|key|test|foo|bar)[\W_]*|here|me|this|it|value|ed)+$|^(.)\1*$|^<.*>$|^\[.*\]$|^%\w+%?$|^\*+")
THRESHOLD = 0.5

NAME = r"[^\W\d][\w$]*+(?:[.\-][^\W\d][\w$]*+)*+"
TARGET = re.compile(rf"""(?<![\w$.\-])(?P<name>{NAME})["'`]?[ \t]*+(?:\][ \t]*+)?(?::=|=>|=(?![=>~])|:(?![:=/]))[ \t]*""")
STRING = re.compile(r'''[rbfuRBFU]{0,2}(?:"""(?P<a>[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+)"""|"(?P<b>(?:[^"\\\n]|\\.)*+)"'''
                    r"""|'(?P<c>(?:[^'\\\n]|\\.)*+)'|`(?P<d>[^`\n]*+)`)""", re.DOTALL)
REFERENCE = re.compile(rf"\$?(?P<name>{NAME})(?![\w$(\[])")
INSIDE = re.compile(rf"\$\{{\s*(?P<name>{NAME})\s*\}}")
BARE = re.compile(r"""(?:\$\{[^{}\s]*+\}|[^\s"'`,;()\[\]{}<>#])++""")
JOIN = re.compile(r"[ \t]*+(?:\+[ \t]*+\n?[ \t]*+|\.[ \t]*+(?=[\"'$])|(?<=[\"'`][ \t])(?=[\"']))")
TYPED = re.compile(r"[ \t]*=(?!=)[ \t]*")
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]*+)(?:\s[^<>]{0,512})?>\s*+(?P<value>[^<>\s][^<>\n]{0,4096}+)</(?P=name)>")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
MOST = 1000          # literals that one name stands for


def base_spans(text: str, lower: str | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three patterns."""
    lower = text.lower() if lower is None else lower
    out = []
    if any(w in lower for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return out


def name_score(name: str) -> float:
    """How much a name looks like that of a secret, 0 to 1."""
    words = [w.lower() for w in WORD.findall(name)]
    score = max([SENSITIVE.get(w, 0.0) for w in words], default=0.0)
    if any(p in SENSITIVE_PAIRS for p in zip(words, words[1:])):
        score = 1.0
    return score * 0.3 if words and words[-1] in ABOUT else score


def literal_score(value: str, quoted: bool) -> float:
    """How much a value looks like a secret, 0 to 1."""
    n = len(value)
    if n < 6 or PLACEHOLDER.match(value[:64]):
        return 0.0
    part = value[:256]
    kinds = sum(any(f(c) for c in part) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    entropy = -sum(c / len(part) * math.log2(c / len(part)) for c in Counter(part).values())
    if not quoted and not (any(c.isdigit() for c in part) and kinds >= 2 or entropy >= 3.5 and n >= 16):
        return 0.0
    score = 0.55 + 0.1 * (kinds - 1) + (0.1 if entropy >= 3 else 0) + (0.1 if n >= 16 else 0)
    return min(1.0, score) * (0.3 if value.count(" ") > 2 else 1.0)


class Pairs:
    """The names of a text with what they get: literals (start, end, quoted), or names."""

    def __init__(self, text: str):
        self.text = text
        self.given: list[tuple[int, str, list]] = []   # place, name, parts
        self.uses: dict[str, list[int]] = {}           # numbers in ``given`` by last part of the name
        at = 0
        while m := TARGET.search(text, at):
            parts, at = self._value(m.end())
            if parts:
                self._give(m.start(), m["name"], parts)
            # What follows the name may be a target itself, as in a mapping.
            at = max(at, m.end())
        for m in ELEMENT.finditer(text):
            end = m.start("value") + len(m["value"].rstrip())
            self._give(m.start(), m["name"], self._parts_of(m.start("value"), end, True))
        self.given.sort(key=lambda g: g[0])
        for k, (_, name, _) in enumerate(self.given):
            self.uses.setdefault(name, []).append(k)

    def _give(self, place: int, name: str, parts: list) -> None:
        self.given.append((place, name, parts))

    def _parts_of(self, start: int, end: int, quoted: bool) -> list:
        """A literal, cut at the names it holds."""
        parts, at = [], start
        for m in INSIDE.finditer(self.text, start, end):
            if m.start() > at:
                parts.append((at, m.start(), quoted))
            parts.append(m["name"])
            at = m.end()
        if end > at:
            parts.append((at, end, quoted))
        return parts

    def _value(self, at: int) -> tuple[list, int]:
        """The parts of a value, and where it ends."""
        parts: list = []
        while True:
            if m := STRING.match(self.text, at):
                group = next(g for g in "abcd" if m[g] is not None)
                parts += self._parts_of(m.start(group), m.end(group), True)
            elif (m := REFERENCE.match(self.text, at)) and not self._bare_goes_on(m.end()):
                if not parts and (typed := TYPED.match(self.text, m.end())):
                    at = typed.end()      # the type of a name: its value comes now
                    continue
                parts.append((m.start(), m.end(), m["name"]))
            elif not parts and (m := BARE.match(self.text, at)):
                called = self.text[m.end():m.end() + 1] in ("(", "[")
                return [] if called else self._parts_of(m.start(), m.end(), False), m.end()
            else:
                return parts, at
            at = m.end()
            if not (join := JOIN.match(self.text, at)):
                return parts, at
            at = join.end()

    def _bare_goes_on(self, at: int) -> bool:
        return at < len(self.text) and self.text[at] not in " \t\r\n,;)]}+\"'`#<" and not (
            self.text[at] == "." and not self.text[at + 1:at + 2].strip())

    def _defined(self, name: str, before: int) -> int | None:
        """Which pair tells what a name stands for at the pair ``before``."""
        found = self.uses.get(name) or self.uses.get(name.rsplit(".", 1)[-1])
        if not found:
            return None
        low, high = 0, len(found)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if found[middle] < before else (low, middle)
        return found[low - 1] if low else next((k for k in found if k != before), None)

    def literals(self) -> list[list[tuple[int, int, bool]]]:
        """The literals that each pair comes to, at most ``MOST``.

        Names given earlier stand for all that they came to, names given later for what is
        written there. A name that stands for nothing is a bare word if it is the whole value.
        """
        out: list[list[tuple[int, int, bool]]] = []
        for k, (_, _, parts) in enumerate(self.given):
            found: list[tuple[int, int, bool]] = []
            for part in parts:
                name = part if isinstance(part, str) else part[2] if isinstance(part[2], str) else None
                if name is None:
                    found.append(part)
                    continue
                other = self._defined(name, k)
                if other is not None:
                    found += out[other] if other < k else [
                        p for p in self.given[other][2] if not isinstance(p, str) and not isinstance(p[2], str)]
                elif len(parts) == 1 and not isinstance(part, str):
                    found.append((part[0], part[1], False))
            out.append(found[:MOST])
        return out

    def scored(self) -> Iterator[tuple[int, int, str, float]]:
        """(start, end, name, score) of the literals that sensitive names get."""
        if not any(name_score(name) >= THRESHOLD for name in self.uses):
            return
        for (_, name, _), found in zip(self.given, self.literals()):
            sensitive = name_score(name)
            if sensitive < THRESHOLD:
                continue
            whole = "".join(self.text[a:b] for a, b, _ in found[:64])
            score = sensitive * literal_score(whole, any(q for *_, q in found))
            if score >= THRESHOLD:
                yield from ((a, b, name, score) for a, b, _ in found if b > a)


def scan_text(text: str, may_hex: bool = True) -> list[dict]:
    """All spans of a text, by start, kind and end: kind, start, end, name and score."""
    lower = text.lower()
    spans = {(a, KINDS.index(kind), b): ("", 1.0) for kind, a, b in base_spans(text, lower) if may_hex or kind != "hex"}
    if any(s in lower for s in STEMS):
        for a, b, name, score in Pairs(text).scored():
            key = (a, KINDS.index("literal"), b)
            if key not in spans or spans[key][1] < score:
                spans[key] = (name, score)
    return [{"kind": KINDS[kind], "start": a, "end": b, "name": name, "score": score}
            for (a, kind, b), (name, score) in sorted(spans.items())]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()),
                   ("score", pa.float64())])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row; spans are (kind, start, end, name, score) by start, kind and end.

    ``name`` is the target of a literal and empty for the base.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hexes = pc.match_substring_regex(batch.column(1), f"[0-9a-f]{{{HEX_LEAST}}}")
            found = [scan_text(t.as_py(), h.as_py()) for t, h in zip(batch.column(1), hexes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), as_text(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long,name:string,score:double>>")
            .withColumnRenamed("id", id_col))
