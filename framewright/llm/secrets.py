"""Secret scanning by assignment-aware lexing.

Base detectors find what fixed formats prove. Beside them a lexer reads source and configuration syntax
(assignments, JSON and YAML pairs, keyword arguments, arrows, XML elements, URL credentials) into pairs of a
name and its literals, follows names that are assigned from other names, and joins concatenated literals.
A pair is reported where its name (or a name it is propagated to) is sensitive and its literal looks random
enough for how sensitive the name is.

The lexer starts at operators, not at words, so prose costs one scan; every step moves forward, and the work is
linear in the text. Comments, documents in triple quotes, heredocs and block scalars are read like other text: pairs in them
count. Defined results: null text counts as empty; repeated rows get equal results; texts are read whole, megabytes too;
an empty table gives an empty result; columns other than doc_id and text are ignored, whatever their names; positions are
code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

KINDS = ("assign", "access", "hex", "literal")

# Fixed formats of the base kinds. {16,} and {24,} keep exactly the runs that are long enough.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: How telling a word within a name is; names are split at case changes and non-letters.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.8, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.8,
    "bearer": 0.8, "private": 0.6, "signing": 0.6, "encryption": 0.6, "access": 0.5, "api": 0.5, "key": 0.5, "salt": 0.5, "dsn": 0.5, "cookie": 0.4, "session": 0.4,
}
#: Words that say that a name holds something about a secret, not the secret.
HARMLESS = {"public": -0.6, "count": -0.6, "length": -0.6, "limit": -0.6, "max": -0.4, "url": -0.5, "path": -0.5, "file": -0.5, "name": -0.5, "id": -0.3, "type": -0.6, "policy": -0.6, "expiry": -0.6, "hint": -0.5, "field": -0.5}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*|\{\{.*|%\(.*|your.*|change.?me|example.*|placeholder|none|null|true|false|undefined|todo|redacted|password|secret|token|test|dummy)$")
OPERATOR = re.compile(r"[:=]|->|<-")
NAME_END = re.compile(r"[\w.\-\[\]\"']")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
BARE = re.compile(r"[^\s\"'`,;)}\]<>&#]+")
IDENT = re.compile(r"[A-Za-z_][\w.]*\Z")
JOINT = re.compile(r"[ \t]*(?:\+|\.\.?|\\\n)?[ \t]*(?=[\"'])")
CALL = re.compile(r"(?:os\.)?(?:environ\.get|getenv|env|get|default|decode|b64decode|str|bytes|SecretString)\([ \t]*")
LONGEST_NAME = 128
REPORT_AT = 1.0


def name_score(name: str) -> float:
    words = [w.lower() for w in NAME_PART.findall(name)]
    pairs = {a + b for a, b in zip(words, words[1:])}  # noqa: B905
    good = max([SENSITIVE.get(w, 0.0) for w in (*words, *pairs)], default=0.0)
    both = good + (0.4 if {"key", "token", "id"} & set(words) and {"api", "access", "private", "secret", "signing", "encryption", "auth"} & set(words) else 0.0)
    return both + sum(HARMLESS.get(w, 0.0) for w in words) if both else 0.0


def literal_score(value: str) -> float:
    """0 for placeholders and prose, near 1 for random strings."""
    n = len(value)
    if n < 6 or PLACEHOLDER.match(value) or " " in value.strip() and n < 20:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(any(f(c) for c in value) for f in (str.isdigit, str.islower, str.isupper)) + (not value.isalnum())
    return min(1.0, entropy / 4.5 * 0.6 + classes * 0.1 + min(n, 40) / 40 * 0.2) * (0.5 if value.isalpha() and value.islower() else 1.0)


def name_before(text: str, at: int, floor: int = 0) -> str:
    """The name that ends before an operator, after any blanks: identifier, quoted key or subscript. Blanks end at
    floor, where the operator before ends, so that none is read twice."""
    end = at
    while end > floor and text[end - 1] in " \t":
        end -= 1
    start = end
    while start > 0 and end - start < LONGEST_NAME and NAME_END.match(text[start - 1]):
        start -= 1
    return text[start:end].strip("\"'[]-.")


def quoted(text: str, at: int, ends: dict[str, int]) -> int:
    """Where the literal that starts at a quote ends (before its closing quote), or -1. ends: where searches
    for a quote found none, so that a text with unclosed quotes is searched once."""
    q = text[at]
    if ends.get(q, -1) == 0:
        return -1
    i = at + 1
    while (i := text.find(q, i)) >= 0:
        back = i - 1
        while text[back] == "\\":
            back -= 1
        if (i - 1 - back) % 2 == 0:
            return i
        i += 1
    ends[q] = 0
    return -1


def literal_at(text: str, at: int, ends: dict[str, int]) -> tuple[int, int] | None:
    """Where the literal that starts at a quote starts and ends within its quotes. Those of three quotes and of
    backticks may hold any lines; others lines without blanks, or PEM."""
    q = text[at]
    if text.startswith(q * 3, at) and q != "`":
        if ends.get(q * 3, -1) != 0:
            if (stop := text.find(q * 3, at + 3)) >= 0:
                return at + 3, stop
            ends[q * 3] = 0
        return None
    if (stop := quoted(text, at, ends)) < 0:
        return None
    if q != "`" and "\n" in text[at + 1 : stop]:
        value = text[at + 1 : stop]
        if not value.lstrip().startswith("-----BEGIN") and any(" " in line.strip() or "\t" in line.strip() for line in value.split("\n")):
            return None
    return at + 1, stop


def pairs(text: str) -> Iterator[tuple[str, str, list[tuple[int, int]], str]]:
    """(name, literal, its pieces' spans, the name it refers to instead) in order of the text."""
    ends: dict[str, int] = {}
    done = last = 0
    for m in OPERATOR.finditer(text):
        floor, last = last, m.end()
        if m.start() < done:
            continue
        at = m.end()
        while at < len(text) and text[at] in "=:> \t":
            at += 1
        name = name_before(text, m.start(), floor)
        if not name or at >= len(text) or text[at] == "\n":
            continue
        if c := CALL.match(text, at):
            at = c.end()
            if at < len(text) and text[at] in "\"'" and (stop := quoted(text, at, ends)) >= 0 and (k := re.compile(r"[ \t]*,[ \t]*(?=[\"'])").match(text, stop + 1)):
                at = k.end()
        if at < len(text) and text[at] in "\"'`":
            pieces, value = [], ""
            while at < len(text) and text[at] in "\"'`" and (piece := literal_at(text, at, ends)):
                pieces.append(piece)
                value += text[piece[0] : piece[1]]
                at = piece[1] + (3 if text.startswith(text[at] * 3, at) and piece[0] == at + 3 else 1)
                j = JOINT.match(text, at)
                at = j.end() if j else at
            if pieces:
                done = at
                yield name, value, pieces, ""
        elif b := BARE.match(text, at):
            value = b.group()
            if IDENT.match(value):
                yield name, value, [b.span()], value
            else:
                yield name, value, [b.span()], ""


# No upper bounds; possessive, so that a run is read once.
URL = re.compile(r"://[^\s:/@]++:([^\s:/@]{6,}+)@")
ELEMENT = re.compile(r"<([A-Za-z_][\w.-]++)>([^<>\s]{6,}+)</\1>")


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that sensitive names hold, directly or through other names."""
    found: dict[tuple[int, int], float] = {}
    values: dict[str, tuple[str, list[tuple[int, int]]]] = {}
    if "=" in text or ":" in text or "<-" in text or "->" in text:
        for name, value, spans, refers in pairs(text):
            if refers and refers in values:
                value, spans = values[refers]
            sensitive = name_score(name)
            if spans and not refers or refers in values:
                values[name] = (value, spans)
            if sensitive >= 0.4 and (s := sensitive + literal_score(value)) > REPORT_AT and literal_score(value) > 0.35:
                if refers and refers not in values and value.isalpha():
                    continue
                for span in spans:
                    found[span] = max(found.get(span, 0), s)
        if "://" in text:
            for m in URL.finditer(text):
                if literal_score(m.group(1)) > 0.3:
                    found[m.span(1)] = 1.5
    if "</" in text:
        for m in ELEMENT.finditer(text):
            if (s := name_score(m.group(1))) >= 0.4 and literal_score(m.group(2)) + s > REPORT_AT:
                found[m.span(2)] = s
    return sorted(found)


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans. A literal within a base span adds nothing."""
    own = base(text)
    starts, reach = [s for s, _, _ in own], []
    for _, _, e in own:
        reach.append(max(e, reach[-1] if reach else 0))
    from bisect import bisect_right

    added = [(s, 3, e) for s, e in literals(text) if e > s and not ((i := bisect_right(starts, s)) and reach[i - 1] >= e)]
    return own, sorted(own + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_literal bigint"


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): counts, digest of base spans, all spans. Ids pass as Arrow buffers, unchanged."""
    prepare(docs.sparkSession)
    fields = [c.split() for c in SCHEMA.split(", ")]
    types = [pa.string() if t == "string" else pa.int64() for _, t in fields[1:]]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            rows = []
            for text in b.column(1).to_pylist():
                own, every = scan(text or "")
                n = Counter(k for _, k, _ in every)
                rows.append((n[0], n[1], n[2], hashlib.sha256(joined(own).encode()).hexdigest(), joined(every), n[3]))
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, t) for v, t in zip(columns, types, strict=True)]], [c for c, _ in fields])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(batches, SCHEMA)
