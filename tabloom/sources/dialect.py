"""Dialect detection on a sample: which separator, quote and escape give even, typed columns."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field, replace
from functools import cmp_to_key


@dataclass(frozen=True)
class Dialect:
    separator: str = ","
    quote: str = '"'
    escape: str = ""
    double_quote: bool = True
    comment: str = ""
    line_ending: str = "unknown"

    def problems(self) -> list[str]:
        out = []
        if not self.separator or any(c in "\r\n" for c in self.separator):
            out.append("the separator is empty or a line end")
        if self.quote and self.quote == self.separator:
            out.append("the quote is the separator")
        if self.quote in ("\r", "\n") or self.escape in ("\r", "\n"):
            out.append("the quote or the escape is a line end")
        if self.escape and self.escape == self.separator:
            out.append("the escape is the separator")
        return out

    @property
    def valid(self) -> bool:
        return not self.problems()

    def __str__(self) -> str:
        show = {"\t": "tab", "": "none"}
        how = "doubled" if self.double_quote else f"escape {self.escape}"
        return f"separator {show.get(self.separator, self.separator)}, quote {show.get(self.quote, self.quote)} ({how})" + (f", comment {self.comment}" if self.comment else "")


CSV, TSV, SEMICOLON, PIPE = Dialect(), Dialect("\t"), Dialect(";"), Dialect("|")
COMMENTED = Dialect(comment="#")


@dataclass
class Candidate:
    dialect: Dialect
    columns: int = 0
    pattern_score: float = 0.0
    type_score: float = 0.0
    score: float = 0.0


@dataclass
class Detection:
    dialect: Dialect = CSV
    confidence: float = 0.0
    has_header: bool = True
    columns: int = 0
    rows: int = 0
    candidates: list[Candidate] = field(default_factory=list)
    warning: str = ""
    ambiguous: bool = False

    @property
    def success(self) -> bool:
        return self.confidence > 0.5


@dataclass(frozen=True)
class DetectionOptions:
    sample: int = 10_240
    most: int = 1 << 20
    min_rows: int = 2
    max_rows: int = 100
    separators: tuple[str, ...] = (",", ";", "\t", "|", ":")
    quotes: tuple[str, ...] = ('"', "'")
    escapes: tuple[str, ...] = ("\\",)
    comments: tuple[str, ...] = ("#",)


# Shapes of typed cells.
CELLS = (
    ("BOOLEAN", r"true|false|TRUE|FALSE|True|False"),
    ("INTEGER", r"[+-]?\d+"),
    ("FLOAT", r"[+-]?(?:(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)"),
    ("DATE", r"\d{4}([-/])\d\d\1\d\d|\d\d([-/])\d\d\2\d{4}"),
    ("TIME", r"\d\d:\d\d(?::\d\d)?"),
    ("DATETIME", r"(?:\d{4}([-/])\d\d\1\d\d|\d\d([-/])\d\d\2\d{4})[T ][^+]{5,}(?:\+.*)?"),
)
CELL = [(kind, re.compile(pattern, re.A | re.S)) for kind, pattern in CELLS]


def cell_type(cell: str) -> str:
    bare = cell.strip(" \t\n\r\v\f")
    if not bare:
        return "EMPTY"
    return next((kind for kind, pattern in CELL if pattern.fullmatch(bare) and (kind != "DATETIME" or len(bare) >= 16)), "STRING")


def rows_of(text: str, dialect: Dialect, options: DetectionOptions) -> list[str]:
    """Records up to max_rows, without blank ones and comments; line ends inside quotes don't count."""
    q, e = re.escape(dialect.quote), re.escape(dialect.escape)
    if not dialect.quote:
        record = r"[^\r\n]*"
    elif dialect.escape and not dialect.double_quote:
        record = rf"(?:{e}[\s\S]|{q}(?:{e}[\s\S]|[^{q}{e}])*+(?:{q}|\Z)|[^\r\n{q}{e}])*"
    else:
        record = rf"(?:{q}[^{q}]*+(?:{q}|\Z)|[^\r\n{q}])*"
    out = []
    for m in re.finditer(rf"({record})(?:\r\n|\r|\n|\Z)", text):
        line = m[1]
        if line.strip(" \t") and not any(line.lstrip(" \t").startswith(c) for c in options.comments):
            out.append(line)
            if len(out) == options.max_rows:
                break
    return out


def fields_of(row: str, dialect: Dialect) -> list[str]:
    """Fields of a record by one pass; quotes toggle anywhere, outer ones are taken off."""
    out, at, inside, start = [], 0, False, 0
    while at < len(row):
        c = row[at]
        if dialect.escape and not dialect.double_quote and c == dialect.escape:
            at += 2
            continue
        if dialect.quote and c == dialect.quote:
            if inside and dialect.double_quote and row[at + 1 : at + 2] == c:
                at += 2
                continue
            inside = not inside
        elif c == dialect.separator and not inside:
            out.append(row[start:at])
            start = at + 1
        at += 1
    out.append(row[start:])
    q = dialect.quote
    return [f[1:-1] if q and len(f) >= 2 and f[0] == q == f[-1] else f for f in out]


def candidates(options: DetectionOptions) -> list[Dialect]:
    out = []
    for s in options.separators:
        for q in options.quotes:
            out.append(Dialect(s, q))
            out += [Dialect(s, q, e, False) for e in options.escapes]
        out.append(Dialect(s, "", "", False))
    return out


# Fixed values of the score: the shares, floors and boosts that are written out in score(), has_header() and detect_dialect().
def score(dialect: Dialect, text: str, options: DetectionOptions) -> Candidate:
    found = Candidate(dialect)
    rows = [fields_of(r, dialect) for r in rows_of(text, dialect, options)]
    if len(rows) < options.min_rows:
        return found
    widths = Counter(map(len, rows))
    found.columns = max(widths, key=lambda n: (widths[n], n))
    found.pattern_score = p = widths[found.columns] / len(rows)
    cells = [cell_type(c) for row in (rows[1:] if len(rows) > 1 else rows) for c in row]
    found.type_score = max(1e-10, sum(k != "STRING" for k in cells) / max(1, len(cells)))
    softened = math.sqrt(max(0.1, found.type_score))
    if found.columns > 1 and p > 0.8:
        found.score = p * (max(0.6, softened) if p > 0.9 else softened)
    else:
        found.score = p * found.type_score
    if q := dialect.quote:
        doubled = q * 2 in text
        if dialect.double_quote and doubled:
            found.score *= 1.1
        elif not dialect.double_quote and dialect.escape + q in text and not doubled:
            found.score *= 1.2
    return found


def _better(a: Candidate, b: Candidate) -> int:
    if abs(a.score - b.score) > 1e-9:
        return -1 if a.score > b.score else 1
    key = lambda c: (-c.columns, c.dialect.quote != '"', not c.dialect.double_quote, c.dialect.separator != ",")
    return (key(a) > key(b)) - (key(a) < key(b))


def has_header(rows: list[list[str]]) -> bool:
    """The first row is mostly text, and the second has typed cells or the first has nothing but text."""
    if len(rows) < 2 or not rows[0] or not rows[1]:
        return False
    texts = sum(cell_type(c) == "STRING" for c in rows[0])
    filled = sum(c != "" for c in rows[0])
    typed = any(cell_type(c) not in ("STRING", "EMPTY") for c in rows[1])
    return filled > 0 and texts / filled > 0.5 and (typed or texts == len(rows[0]))


def line_ending(text: str) -> str:
    found = {k for k, p in (("crlf", r"\r\n"), ("lf", r"(?<!\r)\n"), ("cr", r"\r(?!\n)")) if re.search(p, text)}
    return "mixed" if len(found) > 1 else found.pop() if found else "unknown"


def leading_comment(text: str, options: DetectionOptions) -> tuple[str, str]:
    """(the comment sign of the leading lines, the text after them)."""
    for sign in options.comments:
        if m := re.match(rf"(?:[ \t]*{re.escape(sign)}[^\r\n]*(?:\r\n|\r|\n|\Z))+", text):
            return sign, text[m.end() :]
    return "", text


def detect_dialect(text: str, options: DetectionOptions | None = None) -> Detection:
    options = options or DetectionOptions()
    if not text:
        return Detection(warning="Empty or null input")
    comment, body = leading_comment(text, options)
    if not body:
        return Detection(Dialect(comment=comment), warning="the input has comments only")
    first = re.search(r"[\r\n]", body)
    size = options.sample
    if first is None:
        size *= 4
    elif first.start() * (options.min_rows + 1) > size:
        size = min(first.start() * (options.min_rows + 1), options.most)
    sample = body[:size]
    found = sorted((score(d, sample, options) for d in candidates(options)), key=cmp_to_key(_better))
    best = found[0]
    out = Detection(candidates=found)
    if best.score <= 0:
        out.warning = "Could not detect a valid CSV dialect"
        return out
    rows = [fields_of(r, best.dialect) for r in rows_of(sample, best.dialect, options)]
    out.dialect = replace(best.dialect, comment=comment, line_ending=line_ending(sample))
    out.confidence, out.columns, out.rows = min(1.0, best.score), best.columns, len(rows)
    out.has_header = has_header(rows)
    if len(found) > 1 and found[1].score > 0.9 * best.score:
        out.ambiguous, out.warning = True, f"ambiguous: {found[1].dialect} fits nearly as well"
    return out
