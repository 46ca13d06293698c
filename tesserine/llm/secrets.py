"""Secret scan: three fixed patterns, and a lexer that follows assignments.

The lexer reads source and configuration syntax (``name = "..."``, ``"name": "..."``, ``name: bare``, ``NAME := ...``,
``name => ...``, ``a + b``, ``${NAME}``) into pairs of a name and the literals that make its value, follows constants
from name to name, and scores each literal by how sensitive its target's name is and how unlike prose it looks.
Its spans have the kind ``literal`` and are added where no span of a fixed pattern already holds the literal.

Null and empty texts hold nothing; nothing is cut off long texts, and time and memory are linear in a text's length: a
name's value is shared with the names it was made of, scored once, and each literal is reached once, so ``x = x + x`` costs
no more than any other line.  Repeated rows give repeated rows; an empty table gives an empty result; of the columns only
the key and the text are read (``redacted`` keeps all others, whatever their names).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed patterns and the least length: of group 2 for ``assign``, of the match for the others.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of fewer is no match
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "literal")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How sensitive a part of a name is.
SENSITIVE = {"password": 1.0, "pass": 0.8, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 0.9, "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 0.9, "bearer": 0.8, "auth": 0.7, "private": 0.6, "access": 0.4, "signing": 0.4, "api": 0.4, "key": 0.5, "salt": 0.5}
#: A text without these holds no sensitive name; two parts of a name count together, so marks may stand between the letters.
HINT = re.compile("|".join("[_.-]*".join(k) for k in SENSITIVE if not any(o in k for o in SENSITIVE if o != k)), re.IGNORECASE | re.ASCII)
PLACEHOLDER = re.compile(r"example|sample|dummy|change.?me|your|placeholder|redacted|todo|none|null|true|false|x{4}|\*{3}", re.IGNORECASE)
#: Characters of joined literals that are scored; one literal alone is scored whole.
WHOLE = 1_024
THRESHOLD = 0.55
LEXEME = re.compile(
    r"""(?P<quote>["'])
      |\$\{?(?P<ref>[A-Za-z_][A-Za-z0-9_.]*)\}?
      |(?P<bare>[A-Za-z0-9_][A-Za-z0-9_./@%^*!~-]*)
      |(?P<assign>:=|=>|(?<![=!<>])=(?!=)|:)
      |(?P<plus>\+)
      |(?P<end>[\n;,{}()\[\]])""",
    re.VERBOSE,
)
#: What follows a quote up to the one that closes it.
CLOSED = {q: re.compile(rf"(?:\\.|[^{q}\\\n])*+{q}") for q in ("\"", "'")}
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*\Z")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def name_score(name: str) -> float:
    """Between 0 and 1: parts of a name count together, as independent hints."""
    low = [p.lower() for p in PART.findall(name)]
    keep = 1.0
    for part in {*low, *map("".join, zip(low, low[1:]))}:
        keep *= 1 - SENSITIVE.get(part, 0.0)
    return 1 - keep


def literal_score(value: str) -> float:
    """Between 0 and 1: long, varied literals of several kinds of characters score high."""
    n = len(value)
    if n < 8 or PLACEHOLDER.search(value) or 0 <= value.find("<") < value.rfind(">") or " " in value.strip():
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.3 * min(entropy / 3.0, 1.0) + 0.2 * kinds + 0.15 * min(n / 20, 1.0))


def lexemes(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Kind, value, start and end of each lexeme.

    A quote that its line does not close is no lexeme.  Whether a quote can close a string depends on the backslashes before
    it alone, so where one finds no closing quote on its line, no later one does, and the line is not read again.
    """
    at, open_until = 0, {'"': -1, "'": -1}
    while m := LEXEME.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "quote":
            quote = m[0]
            if m.start() < open_until[quote]:
                continue
            rest = CLOSED[quote].match(text, at)
            if rest is None:
                line_end = text.find("\n", at)
                open_until[quote] = line_end if line_end >= 0 else len(text)
                continue
            at = rest.end()
            yield "literal", text[m.end() : at - 1], m.end(), at - 1
        elif kind == "ref":
            yield "name", m["ref"], 0, 0
        else:
            yield kind, m[0], m.start(), at


def pairs(text: str) -> Iterator[tuple[str, list[tuple[str, str, int, int]]]]:
    """Names and the parts of their values: ("literal" or "bare", value, start, end) or ("name", name, 0, 0)."""
    last, target, parts, glue = None, None, [], False
    for lexeme in lexemes(text):
        kind, value = lexeme[:2]
        if kind in ("assign", "end"):
            # "a: b: c" and "a = b = c": what was read as a value is the next name
            if target and parts:
                yield target, parts
            target = last if kind == "assign" and last and NAME.match(last) else None
            last, parts, glue = None, [], False
        elif kind == "plus":
            glue = bool(parts)
        else:
            if target and (not parts or glue):
                parts.append(lexeme)
                glue = False
            elif target:
                yield target, parts
                target, parts = None, []
            last = value
    if target and parts:
        yield target, parts


class Value:
    """What a name stands for: a literal's span, or two values in a row.  Values are shared, never copied.

    ``text`` is a literal as it stands, and of a row of values as much as fills ``WHOLE`` characters; it is scored once.
    """

    __slots__ = ("span", "first", "second", "text", "scored", "reached")

    def __init__(self, span: tuple[int, int] | None, text: str, first: Value | None = None, second: Value | None = None):
        self.span, self.text, self.first, self.second, self.scored, self.reached = span, text, first, second, None, False

    def then(self, other: Value) -> Value:
        if len(self.text) < WHOLE:
            return Value(None, self.text + other.text[: WHOLE - len(self.text)], self, other)
        row = Value(None, self.text, self, other)
        row.scored = self.score()
        return row

    def score(self) -> float:
        if self.scored is None:
            self.scored = literal_score(self.text)
        return self.scored

    def new_spans(self) -> Iterator[tuple[int, int]]:
        """The spans of all literals below that were not given before."""
        waiting = [self]
        while waiting:
            value = waiting.pop()
            if value.reached:
                continue
            value.reached = True
            if value.span:
                yield value.span
            else:
                waiting += (value.second, value.first)


def literal_spans(text: str) -> list[tuple[int, str, int]]:
    """Literals that reach a sensitive name, directly or through constants."""
    if not (("=" in text or ":" in text) and HINT.search(text)):
        return []
    found: list[tuple[int, str, int]] = []
    constants: dict[str, Value | None] = {}
    for name, parts in pairs(text):
        whole = None
        for kind, value, start, end in parts:
            if kind == "literal" or (kind == "bare" and value not in constants and re.search("[0-9]", value)):
                part = Value((start, end), value) if end > start else None
            else:  # a name: what it stands for, if that was read above
                part = constants.get(value)
            if part is not None:
                whole = part if whole is None else whole.then(part)
        constants[name] = whole
        if whole is not None and (sensitive := name_score(name)) and sensitive * whole.score() >= THRESHOLD:
            found += ((s, "literal", e) for s, e in whole.new_spans())
    return sorted(found)


def scan(text: str) -> list[tuple[int, str, int]]:
    """All spans, by start, then by kind as listed; code points, end exclusive."""
    base = sorted(base_spans(text), key=lambda s: s[0])
    starts, reach = [s[0] for s in base], list(accumulate((s[2] for s in base), max))
    inside = lambda s: (i := bisect_right(starts, s[0])) and s[2] <= reach[i - 1]
    added = [s for s in literal_spans(text) if not inside(s)]
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans array<struct<kind, start, end, value>>`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for part in slices(batches, 1):
            rows = []
            for value in part.column(1).to_pylist():
                value = value or ""
                rows.append([{"kind": k, "start": s, "end": e, "value": value[s:e]} for s, k, e in scan(value)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, shape)], names=["key", "spans"])

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint,value:string>>").withColumnRenamed("key", key)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of scanned rows."""
    spans = F.col("spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        key,
        *(of(k).alias(f"n_{k}") for k in BASE_KINDS),
        of("literal").alias("n_literal"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )


def redacted(docs: DataFrame, text: str = "text", mark: str = "[redacted]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; overlapping spans are one.  Names of assignments stay readable."""

    place, names = docs.columns.index(text), docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    inner = inner.withColumn(f"c{place}", F.col(f"c{place}").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, place):
            clean = pa.array([None if t is None else redact(t, mark) for t in part.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([clean if i == place else c for i, c in enumerate(part.columns)], names=part.schema.names)

    return inner.mapInArrow(run, inner.schema).toDF(*names)


def redact(text: str, mark: str = "[redacted]") -> str:
    spans = []
    for start, kind, end in scan(text):
        if kind == "assign":
            start = ASSIGN.match(text, start).start(2)
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([start, end])
    out, at = [], 0
    for start, end in spans:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]]) if spans else text
