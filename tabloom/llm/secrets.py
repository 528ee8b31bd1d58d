"""Operator 7: secrets in texts.

Three kinds of spans follow fixed patterns (assign, access, hex). Beyond them, values in a
credential context (a word such as "pwd", then a separator) are judged by how many guesses they
would take: the cheapest segmentation into dictionary words, dates, repeats, keyboard walks and
brute-force spans, found by dynamic programming. A value that takes many guesses is a `guess` span.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, with_fields

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_HINT = re.compile(rb"password|passwd|secret|token|api_?key")
KINDS = ("assign", "access", "hex", "guess")

#: Contexts whose values the guess cost judges: a word that ends in one of these, a separator, maybe the name of an authentication scheme.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|credentials?|client[_-]?secret|private[_-]?key|login)\b["']?\x20*(?:[:=]|=>|\x20is\x20)\x20*["']?(?:(?:basic|bearer|digest|dpop|negotiate|ntlm|oauth|token|api_?key)\x20+["']?)?([^\s"'<>,;|]{6,})""",
    re.A | re.I,
)
CONTEXT_HINT = re.compile(rb"pass|pwd|secret|token|key|auth|bearer|credential|login")

# Rows of the common keyboard layout.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in ROWS for a, b in zip(row, row[1:])}
NEXT |= {(a, b) for up, down in zip(ROWS, ROWS[1:]) for i, a in enumerate(up) for b in down[max(0, i - 1) : i + 1]}
NEXT |= {(b, a) for a, b in NEXT}

DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
LEET = str.maketrans("@430$517", "aaeossit")
BRUTE, PER_SEGMENT = 1.0, math.log10(2)
#: Repeats and walks are tried at every length up to this and at the whole run's, so that time grows with the value's length alone.
ARC = 128


@lru_cache(maxsize=2)
def ranks(path: str | None) -> dict[str, int]:
    """Whole lower-case words of a vocabulary with word ends, by place: earlier means more common."""
    if path is None:
        return {}
    vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    words = (w[:-4] for w, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if w.endswith("</w>"))
    return {w: i for i, w in enumerate((w for w in words if len(w) > 2 and w.isascii() and w.isalpha()), 1)}


def arcs(run: int) -> list[int]:
    """Lengths of the arcs that end in a run of that length."""
    return [*range(3, min(run, ARC) + 1), *([run] if run > ARC else ())]


def guess_cost(value: str, words: dict[str, int], most_word: int = 20) -> float:
    """log10 of the guesses for the cheapest segmentation of value."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    dates: dict[int, list[int]] = {}
    if any(c.isdigit() for c in value):
        for i in range(n):
            if value[i].isdigit():
                for j in range(i + 4, min(n, i + 10) + 1):
                    if DATE.fullmatch(value, i, j):
                        dates.setdefault(j, []).append(i)
    walk = repeat = 0
    for j in range(1, n + 1):
        # a character of a brute-force span: ten guesses
        cost = best[j - 1] + BRUTE
        for i in range(max(0, j - most_word), j - 2):
            rank = words.get(low[i:j])
            extra = 0.0
            if rank is None and (rank := words.get(plain[i:j])):
                extra = 1.0
            if rank:
                upper = sum(c.isupper() for c in value[i:j])
                extra += 0 if not upper else PER_SEGMENT if upper in (1, j - i) else 1.0
                cost = min(cost, best[i] + math.log10(rank + 1) + extra + PER_SEGMENT)
        for i in dates.get(j, ()):
            cost = min(cost, best[i] + math.log10(365 * 120) + PER_SEGMENT)
        repeat = repeat + 1 if j > 1 and low[j - 1] == low[j - 2] else 1
        walk = walk + 1 if j > 1 and (low[j - 2], low[j - 1]) in NEXT else 1
        for length in arcs(repeat):
            cost = min(cost, best[j - length] + math.log10(12 * length) + PER_SEGMENT)
        for length in arcs(walk):
            cost = min(cost, best[j - length] + math.log10(40 * length) + 0.3 * length + PER_SEGMENT)
        best[j] = cost
    return best[n]


def base_spans(text: str, lowered: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed patterns, in code points."""
    out = []
    if ASSIGN_HINT.search(lowered):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"akia" in lowered:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, lowered: bytes, base: list[tuple[int, int, int]], words: dict[str, int], threshold: float) -> list[tuple[int, int, int]]:
    """Spans of context values that take 10**threshold guesses or more and aren't covered by one base span."""
    out = []
    if CONTEXT_HINT.search(lowered):
        starts, reach = [s for s, _, _ in base], [-1, *accumulate((e for _, _, e in base), max)]
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            if reach[bisect_right(starts, start)] < end and guess_cost(m[1], words) >= threshold:
                out.append((start, 3, end))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, dictionary: str | None = None, threshold: float = 8.0, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_guess, base_sha256, spans and redacted added.

    spans: "kind:start:end" in code points, end exclusive, by start and kind, comma-joined; base_sha256:
    hex digest of the same of the three fixed kinds; redacted: the text with every span replaced by
    "[secret]", overlapping spans as one. dictionary: a vocabulary file with word ends; without one,
    no word is known. Null texts have no spans and stay null; texts and values of any length are scanned whole; empty tables and repeated rows are as
    any; of the input's columns, those with the added names are replaced.
    """
    added = {"n_assign": "long", "n_access": "long", "n_hex": "long", "n_guess": "long", "base_sha256": "string", "spans": "string", "redacted": "string"}
    kept = docs.drop(*added)
    schema = with_fields(kept, added)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranks(dictionary)
        for batch in slices(batches, text):
            rows = []
            texts = batch.column(batch.schema.get_field_index(text))
            for t, raw in zip(texts.to_pylist(), texts.cast(pa.binary()).to_pylist()):
                lowered = raw.lower() if raw else b""
                base = base_spans(t, lowered) if t else []
                spans = sorted(base + guess_spans(t, lowered, base, words, threshold)) if t else []
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redact(t, spans)))
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(columns))], [*batch.schema.names, *added])

    return kept.mapInArrow(find, schema)


def redact(text: str | None, spans: list[tuple[int, int, int]], by: str = "[secret]") -> str | None:
    if not spans:
        return text
    out, at, end = [], 0, -1
    for s, _, e in spans:
        if s >= end:
            out += [text[at:s], by]
        at = end = max(end, e)
    return "".join([*out, text[at:]])
