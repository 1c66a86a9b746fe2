"""Secret scans by assignment-aware lexing.

Source and configuration text is read as pairs of a target name and a value. Targets come from assignments of all common
forms (``=``, ``:=``, ``=>``, ``:``, with type annotations, subscripts and braced initialisers), ``#define``, command-line
flags, XML elements and attributes, and ``name``/``value`` entries. Values are literals (quoted in one, three or back
quotes, with prefixes; YAML blocks; here-documents) and names, joined by ``+``, by standing side by side or inside
brackets; names inside interpolated strings count as names. Names are replaced by the literals they were assigned anywhere
in the text (constants propagate through any number of steps; a name assigned several times stands for each of its values
in turn, the others keeping their strongest). Each literal is then scored by the names it reaches: words of the name that
mark something sensitive, words that mark it harmless, and the look of the value.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
KINDS = ("assign", "access", "hex", "literal")

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]{32,}", re.ASCII)
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

SENSITIVE = {"password": 0.7, "passwd": 0.7, "pwd": 0.7, "pass": 0.5, "passphrase": 0.7, "secret": 0.7, "token": 0.6, "credential": 0.6, "credentials": 0.6, "apikey": 0.7, "auth": 0.4, "bearer": 0.5, "key": 0.3, "dsn": 0.4, "pin": 0.3}
#: Words that make a following or leading "key" a secret one.
KEY_WORDS = {"api": 0.4, "access": 0.3, "private": 0.4, "encryption": 0.4, "signing": 0.4, "master": 0.3, "account": 0.2, "shared": 0.2}
HARMLESS = {"public": 0.6, "id": 0.4, "name": 0.4, "url": 0.3, "uri": 0.3, "path": 0.4, "file": 0.4, "length": 0.6, "size": 0.6, "count": 0.6, "max": 0.5, "min": 0.5, "type": 0.5, "format": 0.5, "expires": 0.5, "ttl": 0.5, "hint": 0.5, "policy": 0.5, "field": 0.5, "label": 0.5, "index": 0.5}
PLACEHOLDER = re.compile(r"(?i)\$\{|\{\{|<[^>]*>|%\(|example|changeme|placeholder|your[_-]|dummy|sample|x{4,}|\*{3,}|^(none|null|true|false|undefined|todo)$")
CUTOFF = 0.75
#: A text without any of these can't hold an assignment that scores.
_HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer", "dsn")

TARGET = re.compile(r"(?<![\w$.-])-*+([\"']?)([A-Za-z_][\w.$-]*+)\1(?:\[[^\[\]\n\"']*+\]|\])?+[ \t]*+(?::=|=>|(?<![=!<>])=(?!=)|:(?!:)|(?=\{[ \t\n]*+[\"']))[ \t]*+", re.ASCII)
#: What follows the colon of an annotated name up to its value.
ANNOTATION = re.compile(r"[A-Za-z_][\w. \t\[\],|?]*+=(?![=>])[ \t]*+", re.ASCII)
DEFINE = re.compile(r"^[ \t]*+#[ \t]*+define[ \t]++([A-Za-z_]\w*+)[ \t]++", re.M | re.ASCII)
FLAG = re.compile(r"(?<![\w-])--([A-Za-z][\w-]*+)[ \t]++(?=[^\s-])", re.ASCII)
ELEMENT = re.compile(r"<([A-Za-z_][\w:.-]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>([^<]*+)(?=(</)?)", re.ASCII)
XML_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)')", re.ASCII)
NAMING, VALUED = ("key", "name", "id", "property"), ("value", "content", "default")
OPENED = re.compile(r"([fFrRbBuU]{0,2})(\"{3}|'{3}|[\"'`])")
CLOSED = {'"': re.compile(r"((?:[^\"\\\n]|\\.)*+)\""), "'": re.compile(r"((?:[^'\\\n]|\\.)*+)'"), "`": re.compile(r"((?:[^`\\]|\\.)*+)`", re.S)}
HELD_BY_BRACES, HELD_BY_DOLLAR = re.compile(r"\{([A-Za-z_][\w.]*+)\}", re.ASCII), re.compile(r"\$(?:\{([A-Za-z_]\w*+)\}|([A-Za-z_]\w*+))", re.ASCII)
BARE = re.compile(r"[^\s\"'`,;#<>(){}\[\]+&|]+")
BLANK, WIDE = re.compile(r"(?:[ \t]|\\\r?\n)*+"), re.compile(r"\s*+")
YAML_BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*+(?:#[^\n]*+)?\r?\n")
HERE = re.compile(r"<<[-~]?[ \t]*+([\"']?)([A-Za-z_]\w*+)\1[^\n]*+\n", re.ASCII)
BRACKETS = {"(": ")", "[": "]", "{": "}"}
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Span = tuple[int, int, int]
Part = tuple[str, int, int, bool]  # value, start, end, whether it may be a name


def base_spans(text: str) -> list[Span]:
    """``(start, kind number, end)`` of the base kinds, unsorted."""
    found: list[Span] = []
    lower = text.lower()
    if any(h in lower for h in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Source:
    """A text being read; line ends are looked up, not searched, so a text of many open blocks stays linear."""

    def __init__(self, text: str):
        self.text = text
        self._lines: dict[str, list[int]] | None = None

    def line_of(self, word: str, at: int) -> int | None:
        """Where the first line from ``at`` on starts that holds nothing but ``word``."""
        if self._lines is None:
            self._lines, start = {}, 0
            for line in self.text.split("\n"):
                stripped = line.strip()
                if stripped and len(stripped) <= 64:
                    self._lines.setdefault(stripped, []).append(start)
                start += len(line) + 1
        places = self._lines.get(word, [])
        k = bisect_left(places, at)
        return places[k] if k < len(places) else None

    def string(self, at: int) -> tuple[list[Part], int] | None:
        """The parts of a quoted literal that starts here, and where it ends."""
        text, m = self.text, OPENED.match(self.text, at)
        if m is None:
            return None
        prefix, quote, start = m[1], m[2], m.end()
        if len(quote) == 3:
            end = text.find(quote, start)
            if end < 0:
                return None
            after = end + 3
        elif (body := CLOSED[quote].match(text, start)) is not None:
            end, after = body.end(1), body.end()
        else:
            return None
        inner = HELD_BY_BRACES if "f" in prefix.lower() else HELD_BY_DOLLAR if quote[0] != "'" else None
        parts, last = [], start
        for held in inner.finditer(text, start, end) if inner else ():
            parts += [(text[last : held.start()], last, held.start(), False)] * (held.start() > last)
            parts.append((f"${{{held[1] or held[2]}}}", held.start(), held.end(), True))
            last = held.end()
        if last < end or not parts:
            parts.append((text[last:end], last, end, False))
        return parts, after

    def block(self, at: int, target: int) -> list[Part] | None:
        """A YAML block or here-document whose mark stands here."""
        text = self.text
        if (m := YAML_BLOCK.match(text, at)) is not None:
            line = text.rfind("\n", 0, target) + 1
            depth, lines, start = target - line - len(text[line:target].lstrip(" \t-")), [], m.end()
            first = last = None
            while start < len(text):
                end = text.find("\n", start)
                end = len(text) if end < 0 else end
                stripped = text[start:end].strip()
                indent = len(text[start:end]) - len(text[start:end].lstrip())
                if stripped and indent <= depth:
                    break
                if stripped:
                    first, last = (start + indent if first is None else first), start + indent + len(stripped)
                    lines.append(stripped)
                start = end + 1
            return [("\n".join(lines), first, last, False)] if lines else None
        if (m := HERE.match(text, at)) is not None and (end := self.line_of(m[2], m.end())) is not None:
            body = text[m.end() : end]
            return [(body.strip(), m.end(), max(m.end(), end - 1), False)] if body.strip() else None
        return None

    def values(self, at: int) -> list[list[Part]]:
        """The expressions that start here, as their parts: one, or one for each element inside brackets."""
        text, out, parts, closers = self.text, [], [], []
        wanted = True  # a part may come; side by side only strings do
        while True:
            at = (WIDE if closers else BLANK).match(text, at).end()
            c = text[at : at + 1]
            if c and c in BRACKETS and wanted and not parts:
                closers.append(BRACKETS[c])
                at += 1
            elif closers and c == closers[-1]:
                closers.pop()
                at, wanted = at + 1, False
            elif closers and c == ",":
                out.append(parts)
                parts, wanted, at = [], True, at + 1
            elif c == "+" and parts and not wanted:
                at, wanted = WIDE.match(text, at + 1).end(), True
            elif (found := self.string(at)) is not None:
                parts, at, wanted = parts + found[0], found[1], False
                if closers and text[WIDE.match(text, at).end() :][:1] in (":", "="):
                    return []  # a mapping, whose names are targets of their own
            elif wanted and (m := BARE.match(text, at)) is not None:
                if text[m.end() : m.end() + 1] == "(":
                    break  # what a call gives isn't written here
                if closers and m[0].endswith((":", "=")):
                    return []
                parts, at, wanted = [*parts, (m[0], at, m.end(), True)], m.end(), False
            else:
                break
        out.append(parts)
        return [x for x in out if x]

    def elements(self) -> list[tuple[int, str, list[Part]]]:
        """Targets and values of XML elements and their attributes."""
        found = []
        for m in ELEMENT.finditer(self.text):
            named: dict[str, tuple[str, int, int]] = {}
            for x in XML_ATTRIBUTE.finditer(self.text, m.start(2), m.end(2)):
                group = 2 if x[2] is not None else 3
                named.setdefault(x[1].lower(), (x[group], x.start(group), x.end(group)))
            target = next((named[k][0] for k in NAMING if k in named), None)
            for k in VALUED:
                if target is not None and k in named:
                    found.append((m.start(), target, [(*named[k], False)]))
            body = m[3].strip()
            if body and m[4] and not m[2].endswith("/"):
                start = m.start(3) + len(m[3]) - len(m[3].lstrip())
                found.append((m.start(), target if target is not None else m[1].rsplit(":", 1)[-1], [(body, start, start + len(body), False)]))
        return found


def assignments(text: str) -> list[tuple[str, list[Part]]]:
    """``(target, parts)`` in order of the targets; a bare part may be a name."""
    source, found = Source(text), []
    for m in TARGET.finditer(text):
        at = m.end()
        if text[m.start() : at].rstrip().endswith(":") and (typed := ANNOTATION.match(text, at)) is not None:
            at = typed.end()
        block = source.block(at, m.start())
        found += [(m.start(), m[2], parts) for parts in ([block] if block else source.values(at))]
    for pattern in (DEFINE, FLAG):
        found += [(m.start(), m[1], parts) for m in pattern.finditer(text) for parts in source.values(m.end())]
    found.sort(key=lambda x: x[0])
    entries = [(here[0], here[2][0][0], after[2]) for here, after in zip(found, found[1:]) if here[1].lower() in ("name", "key") and after[1].lower() == "value" and len(here[2]) == 1]
    if "<" in text:
        entries += source.elements()
    return [(name, parts) for _, name, parts in sorted(found + entries, key=lambda x: x[0])]


def sensitivity(name: str) -> float:
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    score = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    if "key" in words:
        score += max((KEY_WORDS.get(w, 0.0) for w in words), default=0.0)
    return score - max((HARMLESS.get(w, 0.0) for w in words), default=0.0) if score else 0.0


def strength(value: str) -> float:
    """How much a value looks like a secret, from its length, mixture and entropy."""
    n = len(value)
    if "PRIVATE KEY-----" in value:
        return 0.3
    if n < 6 or PLACEHOLDER.search(value):
        return -1.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = any(c.isdigit() for c in value) + any(c.isalpha() for c in value) + any(not c.isalnum() for c in value)
    return 0.1 * (n >= 8) + 0.1 * (entropy >= 2.5) + 0.1 * (mixed >= 2) - 0.3 * (" " in value)


def literal_spans(text: str) -> list[Span]:
    """Literals whose propagated targets are sensitive enough."""
    lower = text.lower()
    if not any(h in lower for h in _HINTS):
        return []
    groups: dict[str, dict[tuple, list]] = {}  # name: expression: where it stands
    for name, parts in assignments(text):
        groups.setdefault(name, {}).setdefault(tuple((value, bare) for value, _, _, bare in parts), []).append(parts)
    best: dict[str, tuple] = {}
    spans: set[Span] = set()
    for name, expressions in groups.items():
        weight = sensitivity(name)
        if weight <= 0:
            continue
        for expression, places in expressions.items():
            opened: set[str] = set()
            todo: list[tuple[dict[str, tuple], bool]] = [({}, True), ({}, False)]  # expressions of names; the first of all others, or the strongest
            while todo:
                chosen, first = todo.pop()
                literals, seen = [], {name}
                work = [(*part, places, k) for k, part in enumerate(expression)][::-1]
                while work:  # names stand for what they were assigned; a name met before is left out
                    value, bare, at, k = work.pop()
                    known = value.removeprefix("$").strip("{}") if bare else None
                    if known not in groups:
                        literals.append((value, at, k))
                    elif known not in seen:
                        seen.add(known)
                        if known not in best:
                            best[known] = max(groups[known], key=lambda e: (strength(v := "".join(x for x, _ in e)), len(v)))
                        taken = next(iter(groups[known])) if first else chosen.get(known, best[known])
                        if known not in opened and not first:
                            opened.add(known)
                            todo += [(chosen | {known: other}, False) for other in groups[known] if other != taken]
                        work += [(*part, groups[known][taken], k) for k, part in enumerate(taken)][::-1]
                if weight + strength("".join(v for v, _, _ in literals)) >= CUTOFF:
                    spans.update((parts[k][1], 3, parts[k][2]) for _, at, k in literals for parts in at if parts[k][2] > parts[k][1])
    return list(spans)


def scan(text: str) -> list[Span]:
    base = base_spans(text)
    found = list(base)
    for start, kind, end in literal_spans(text):
        if not any(a <= start and end <= b for a, _, b in base):
            found.append((start, kind, end))
    return sorted(found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text, one row per input row, without a shuffle; offsets are code points.

    Null text counts as empty (no span, hash of the empty string); a null id stays null; repeated rows come back each;
    an empty table gives an empty result; other columns are ignored."""

    def run(batch: pa.RecordBatch):
        out: list[list] = [[], [], [], [], []]
        for text in common.as_text(batch.column(1)):
            spans = scan(text)
            said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
            base = ",".join(s for s, (_, k, _) in zip(said, spans) if k < 3)
            counts = Counter(k for _, k, _ in spans)
            for column, value in zip(out, (counts[0], counts[1], counts[2], hashlib.sha256(base.encode()).hexdigest(), ",".join(said))):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return common.map_batches(common.pick(docs, doc_id=id_col, text=text_col), run, SCHEMA)
