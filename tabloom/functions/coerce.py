"""Typed values of texts, as Column expressions; what doesn't parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import FALSES, TRUES, tokens
from ..types import DataType

INTEGER = r"^[+-]?[0-9]+\z"
DATE = r"^[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}\z"
TIMESTAMP = r"^([0-9]{4}([-/])[0-9]{2}\2[0-9]{2})[T ]([0-9]{2})(?::([0-9]{2})(?::([0-9]{2}))?|([0-9]{2})([0-9]{2})?)(?:\.([0-9]{0,6})(?:[0-9][^Z+-]*)?)?(?:Z[\s\S]*|([+-])([0-9]{2}):?+(?:([0-9]{2})[\s\S]*|(?![0-9])[\s\S]*))?\z"
USUAL = r"^[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?\z"
TIME = r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]*))?)?(?: ?\z| ([AaPp])[Mm]\z)"
SECOND = 1_000_000


def floats(mark: str) -> str:
    """A number with this decimal mark; one plus has gone before."""
    m = "\\" + mark
    return rf"^-?(?:(?:[0-9]+(?:{m}[0-9]*)?|{m}[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))\z"


def guarded(x: Column, pattern: str, out: Column) -> Column:
    return F.when(x.rlike(pattern), out)


def int32(x: Column) -> Column:
    return F.when(x.rlike(INTEGER) & (F.length(x) <= 11), x.try_cast("int"))


def int64(x: Column) -> Column:
    return F.when(x.rlike(INTEGER) & (F.length(x) <= 20), x.try_cast("bigint"))


def float64(x: Column, mark: str = ".") -> Column:
    bare = F.when(F.startswith(x, F.lit("+")), F.substring(x, F.lit(2), F.length(x))).otherwise(x)
    number = bare if mark == "." else F.replace(bare, F.lit(mark), F.lit("."))
    return guarded(bare, floats(mark), number.try_cast("double"))


def boolean(x: Column, trues: list[str] | None = None, falses: list[str] | None = None) -> Column:
    yes = [*dict.fromkeys([*(tokens(TRUES) if trues is None else trues), "1"])]
    no = [*dict.fromkeys([*(tokens(FALSES) if falses is None else falses), "0"])]
    return F.when(x.isin(yes), True).when(x.isin(no), False)


def dashed(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("/")), F.translate(x, "/", "-")).otherwise(x)


def date(x: Column) -> Column:
    return guarded(x, DATE, dashed(x).try_cast("date"))


def part(x: Column, pattern: str, k: int) -> Column:
    """A group of digits as a number; 0 if it isn't there."""
    return F.coalesce(F.regexp_extract(x, pattern, k).try_cast("bigint"), F.lit(0))


def fraction(digits: Column) -> Column:
    return F.rpad(F.substring(digits, 1, 6), 6, "0").try_cast("bigint")


def timestamp(x: Column) -> Column:
    """A time of day on a date, with or without colons; moved to UTC if it has an offset."""
    take = lambda groups, kind: F.regexp_replace(x, TIMESTAMP, groups).try_cast(kind)
    minute = F.translate(F.regexp_replace(x, TIMESTAMP, "$1 $3:$4$6"), "/", "-").try_cast("timestamp_ntz")
    second = take("0$5$7.$8", "decimal(18,6)")
    ahead, behind = F.coalesce(take("$9$10", "int"), F.lit(0)), F.coalesce(take("$9$11", "int"), F.lit(0))
    valid = x.rlike(TIMESTAMP) & (second < 60) & (F.abs(ahead) <= 14) & (F.abs(behind) <= 59) & (F.length(x) >= 15)
    general = F.when(valid, minute + F.make_dt_interval(F.lit(0), F.lit(0), -(ahead * 60 + behind), second))
    # the usual form needs no taking apart
    return F.when(x.rlike(USUAL), dashed(x).try_cast("timestamp_ntz")).otherwise(general)


def micros_ntz(micros: Column) -> Column:
    """Microseconds since the epoch as a timestamp without a zone, whatever the session's zone."""
    seconds = F.call_function("div", micros - F.pmod(micros, F.lit(SECOND)), F.lit(SECOND))
    days = F.call_function("div", seconds - F.pmod(seconds, F.lit(86_400)), F.lit(86_400))
    rest = ((micros - days * 86_400 * SECOND) / F.lit(SECOND)).cast("decimal(18,6)")
    return F.date_from_unix_date(days.cast("int")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), rest)


def time(x: Column) -> Column:
    """Microseconds since midnight."""
    hour, minute, second = (part(x, TIME, k) for k in (1, 2, 3))
    half = F.lower(F.regexp_extract(x, TIME, 5))
    of_day = F.when(half == "", hour).when(half == "p", hour % 12 + 12).otherwise(hour % 12)
    valid = F.when(half == "", hour <= 23).otherwise((hour >= 1) & (hour <= 12)) & (minute <= 59) & (second <= 59) & (F.length(x) >= 4)
    return F.when(x.rlike(TIME) & valid, ((of_day * 60 + minute) * 60 + second) * SECOND + fraction(F.regexp_extract(x, TIME, 4)))


def coerce(x: Column, kind: DataType, mark: str = ".", trues: list[str] | None = None, falses: list[str] | None = None) -> Column:
    if kind == DataType.BOOL:
        return boolean(x, trues, falses)
    if kind == DataType.FLOAT64:
        return float64(x, mark)
    of = {DataType.INT32: int32, DataType.INT64: int64, DataType.DATE: date, DataType.TIMESTAMP: timestamp, DataType.TIME: time}
    return of[kind](x) if kind in of else x
