"""Fields of a record, as Column expressions and as plain Python over the same patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(text: str) -> str:
    """text as a pattern that stands for itself, in Java and in Python."""
    return re.sub(r"([^\w\s]|_)", r"\\\1", text)


def field_pattern(sep: str, quote: str, backslash: bool = False, stop: str = "") -> str:
    """A pattern for one field.

    A field that begins with a quote goes on while the number of quotes is odd, to the end of the
    record if need be; in another one quotes stand for themselves. With separators of several
    characters, quotes count anywhere in a field. With backslash, a character after one is data.
    stop: a character that ends the field as well, outside of quotes.
    """
    s = literal(sep)
    if not quote:
        return rf"(?:(?!{s})[^{stop}])*+" if len(sep) > 1 and stop else rf"(?:(?!{s})[\s\S])*+" if len(sep) > 1 else rf"[^{s}{stop}]*+"
    q = literal(quote)
    if len(sep) > 1:
        return rf"(?:(?:(?!{s})[^{q}{stop}])++|{q}[^{q}]*+(?:{q}|\z))*+"
    if backslash:
        quoted = rf"{q}[^{q}\\]*+(?:\\(?:[\s\S]|\z)[^{q}\\]*+)*+(?:{q}|\z)"
        return rf"(?:{quoted}(?:[^{q}{s}{stop}\\]++|\\(?:[\s\S]|\z)|{quoted})*+|(?!{q})[^{s}{stop}\\]*+(?:\\(?:[\s\S]|\z)[^{s}{stop}\\]*+)*+)"
    return rf"(?:{q}[^{q}]*+(?:{q}|\z)(?:[^{q}{s}{stop}]++|{q}[^{q}]*+(?:{q}|\z))*+|(?!{q})[^{s}{stop}]*+)"


def record_pattern(sep: str, quote: str, backslash: bool, stop: str) -> str:
    """A pattern for one record, which ends at `stop` outside of quotes."""
    field = field_pattern(sep, quote, backslash, stop)
    return rf"{field}(?:{literal(sep)}{field})*+"


def split_fields(record: Column, sep: str, quote: str = '"', backslash: bool = False) -> Column:
    """Raw fields of a record, quotes and all; records without a quote take the plain split."""
    plain = F.split(record, literal(sep), -1)
    if not quote and not backslash:
        return plain
    pattern = literal(sep) + "(" + field_pattern(sep, quote, backslash) + ")"
    found = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(pattern), F.lit(1))
    odd = F.contains(record, F.lit("\\")) if backslash else F.lit(False)
    return F.when(F.contains(record, F.lit(quote)) | odd, found).otherwise(plain) if quote else found


def split_python(record: str, sep: str, quote: str = '"', backslash: bool = False) -> list[str]:
    """split_fields for one string; Python writes the end of input as \\Z."""
    if not quote or (quote not in record and not (backslash and "\\" in record)):
        return record.split(sep)
    pattern = field_pattern(sep, quote, backslash).replace(r"\z", r"\Z")
    return re.findall(literal(sep) + "(" + pattern + ")", sep + record)


def is_quoted(raw: Column, quote: str) -> Column:
    return F.startswith(raw, F.lit(quote)) if quote else F.lit(False)


def unescape(text: Column, quote: str, backslash: bool = False) -> Column:
    """Contents between quotes: doubled quotes are one; with backslash, its sequences instead."""
    if not backslash:
        return F.replace(text, F.lit(quote * 2), F.lit(quote))
    parts = F.regexp_replace(text, r"\\\\", "\u0000")
    for mark, meant in (("n", "\n"), ("t", "\t"), ("r", "\r")):
        parts = F.replace(parts, F.lit("\\" + mark), F.lit(meant))
    # an unknown sequence drops its backslash; one at the very end stays
    parts = F.regexp_replace(parts, r"\\([\s\S])", "$1")
    return F.when(F.contains(text, F.lit("\\")), F.replace(parts, F.lit("\u0000"), F.lit("\\"))).otherwise(text)


def unescape_python(text: str, quote: str, backslash: bool = False) -> str:
    if not backslash:
        return text.replace(quote * 2, quote)
    return re.sub(r"\\([\s\S])", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text)


def text_of_field(raw: Column, bare: Column, quote: str, backslash: bool, nulls: list[str]) -> Column:
    """A field's text: null if bare, the raw field trimmed outside of quotes, is a null token, else unquoted."""
    plain = unescape(bare, quote, True) if backslash else bare
    out = plain
    if quote:
        both = F.endswith(bare, F.lit(quote)) & (F.length(bare) >= 2)
        inner = F.substring(bare, F.lit(2), F.length(bare) - 2)
        out = F.when(is_quoted(raw, quote) & both, unescape(inner, quote, backslash)).otherwise(plain)
    return F.when(bare.isin(nulls), F.lit(None)).otherwise(out) if nulls else out


def with_texts(df: DataFrame, width: int, quote: str, backslash: bool, trim: bool, nulls: list[str]) -> DataFrame:
    """df, which has an array `fields`, with its first `width` as texts in __t0, __t1, ...

    Each step is a projection of its own, so that what later steps use often is worked out once.
    """
    raw = [F.get("fields", F.lit(i)) for i in range(width)]
    df = df.select("*", *((F.btrim(r, F.lit(" \t")) if trim else r).alias(f"__b{i}") for i, r in enumerate(raw)))
    texts = (text_of_field(r, F.col(f"__b{i}"), quote, backslash, nulls).alias(f"__t{i}") for i, r in enumerate(raw))
    return df.select("*", *texts).drop(*(f"__b{i}" for i in range(width)))


def value_python(raw: str, quote: str, backslash: bool, trim: bool) -> str:
    bare = raw.strip(" \t") if trim else raw
    if quote and raw.startswith(quote) and len(bare) >= 2 and bare.endswith(quote):
        return unescape_python(bare[1:-1], quote, backslash)
    return unescape_python(bare, quote, True) if backslash else bare
