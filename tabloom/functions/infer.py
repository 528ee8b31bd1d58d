"""The type of a text, by one list of patterns for Spark and Python alike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import DataType, wider
from .coerce import DATE, INTEGER, floats

#: Shape of a timestamp: no more is asked for than that.
STAMP = r"^[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}[T ][0-9]{2}(?::[0-9][0-9]|[0-9])[\s\S]*\z"
#: A time of day in range.
CLOCK = r"^(?:(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]*)?)? ?|(?:0?[1-9]|1[0-2]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]*)?)? [AaPp][Mm])\z"
MOST_INT = 2_147_483_647


def rules(mark: str = ".") -> list[tuple[str, DataType]]:
    """Patterns in the order in which they are tried, after nulls, booleans and integers."""
    return [(floats(mark).replace("^", r"^\+?", 1), DataType.FLOAT64), (DATE, DataType.DATE), (STAMP, DataType.TIMESTAMP), (CLOCK, DataType.TIME)]


def infer_field(x: Column, nulls: list[str], trues: list[str], falses: list[str], guess_integer: bool = True, mark: str = ".") -> Column:
    """The type's number in DataType."""
    whole = F.lit(int(DataType.FLOAT64))
    if guess_integer:
        small = (F.length(x) <= 10) & (F.abs(x.try_cast("bigint")) <= MOST_INT)
        whole = F.when(small, int(DataType.INT32)).otherwise(int(DataType.INT64))
    out = F.when(x.isNull() | (x == "") | x.isin([*nulls, ""]), int(DataType.NA))
    if trues or falses:
        out = out.when(x.isin([*trues, *falses]), int(DataType.BOOL))
    out = out.when(x.rlike(INTEGER), whole)
    for pattern, kind in rules(mark):
        fits = x.rlike(pattern) if kind != DataType.TIMESTAMP else x.rlike(pattern) & (F.length(x) >= 15)
        out = out.when(fits, int(kind))
    return out.otherwise(int(DataType.STRING))


def infer_python(x: str | None, nulls: list[str], trues: list[str], falses: list[str], guess_integer: bool = True, mark: str = ".") -> DataType:
    if not x or x in nulls:
        return DataType.NA
    if x in trues or x in falses:
        return DataType.BOOL
    if re.match(_python(INTEGER), x):
        if not guess_integer:
            return DataType.FLOAT64
        return DataType.INT32 if len(x) <= 10 and abs(int(x)) <= MOST_INT else DataType.INT64
    for pattern, kind in rules(mark):
        if re.match(_python(pattern), x) and (kind != DataType.TIMESTAMP or len(x) >= 15):
            return kind
    return DataType.STRING


def _python(pattern: str) -> str:
    return pattern.replace(r"\z", r"\Z")


def fold(kinds: Column) -> list[Column]:
    """Aggregates over infer_field's numbers, from which folded() tells the column's type."""
    return [F.bit_or(F.when(kinds == int(DataType.NA), 0).otherwise(F.call_function("shiftleft", F.lit(1), kinds.cast("int")))).alias("kinds")]


def folded(kinds: int | None) -> DataType:
    """The least type of all whose bit is set; NA if none is."""
    out = DataType.NA
    for kind in DataType:
        if kind != DataType.NA and (kinds or 0) >> kind & 1:
            out = wider(out, kind)
    return out


def column_types(rows: list[list[str | None]], width: int, *how) -> list[DataType]:
    """Types of columns from sampled rows of texts."""
    out = [DataType.NA] * width
    for row in rows:
        for i, x in enumerate(row[:width]):
            if out[i] != DataType.STRING:
                out[i] = wider(out[i], infer_python(x, *how))
    return out
