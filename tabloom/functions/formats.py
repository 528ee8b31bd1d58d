"""strptime-like formats compiled to one anchored pattern and arithmetic over its groups.

A format is a list of parts; each part is a pattern with groups and what the groups say. Nothing is
parsed row by row: a compiled format is a Column expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import DataType
from .coerce import SECOND, fraction, micros_ntz
from .fields import literal


@dataclass(frozen=True)
class Locale:
    # English names.
    months: tuple[str, ...] = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
    months_short: tuple[str, ...] = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
    days: tuple[str, ...] = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
    days_short: tuple[str, ...] = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
    am: str = "AM"
    pm: str = "PM"
    date_format: str = "%Y-%m-%d"
    time_format: str = "%H:%M:%S"


ENGLISH = Locale()
SHORT = {"D": "%m/%d/%y", "F": "%Y-%m-%d", "T": "%H:%M:%S", "R": "%H:%M"}
TWO = "([0-9]{1,2}+)"
#: Between the groups of a match.
MARK = "\u0001"


@dataclass
class Plan:
    pattern: str = "^"
    groups: int = 0
    says: list[tuple[str, tuple[int, ...]]] = field(default_factory=list)

    def add(self, pattern: str, *says: tuple[str, int | tuple[int, ...]]) -> None:
        """says: what each group of the pattern (counted from 1) is."""
        self.pattern += re.sub(r"\\g(\d)", lambda m: f"\\{int(m[1]) + self.groups}", pattern)
        for what, which in says:
            self.says.append((what, tuple(self.groups + k for k in (which if isinstance(which, tuple) else (which,)))))
        self.groups += len(re.findall(r"(?<!\\)\((?!\?)", pattern))


def names(of: tuple[str, ...]) -> str:
    return "(?i:" + "|".join(map(literal, of)) + ")"


SIMPLE = {
    "Y": ("([0-9]{4})", "year"), "m": (TWO, "month"), "d": (TWO, "day"), "e": (" ?" + TWO, "day"), "H": (TWO, "hour24"), "I": (TWO, "hour12"), "M": (TWO, "minute"), "S": (TWO, "second"),
}


def plan(format_: str, locale: Locale = ENGLISH) -> Plan | None:
    """None where the format has a part that doesn't exist."""
    text = format_.replace("%x", locale.date_format).replace("%X", locale.time_format)
    text = re.sub(r"%([DFTR])", lambda m: SHORT[m[1]], text) if "%%" not in text else _expand(text)
    out, at = Plan(), 0
    while at < len(text):
        c = text[at]
        if c.isspace():
            out.add(r"\s*+")
            at += 1
            continue
        if c != "%":
            out.add(literal(c))
            at += 1
            continue
        spec, more = text[at + 1 : at + 2], text[at + 2 : at + 3]
        at += 2
        if spec in SIMPLE and spec:
            pattern, what = SIMPLE[spec]
            out.add(pattern, (what, 1))
        elif spec == "y":
            out.add("([0-9]{2})", ("short_year", 1))
        elif spec == "h":
            out.add("(-?)([0-9]{1,10}+)", ("negative", 1), ("hours", 2))
        elif spec == "O" and more == "S":
            out.add(TWO + r"(?:\.([0-9]*+))?+", ("second", 1), ("fraction", 2))
            at += 1
        elif spec == "p":
            out.add("(?i:(" + literal(locale.am) + ")|(" + literal(locale.pm) + "))", ("am", 1), ("pm", 2))
        elif spec in ("b", "B"):
            out.add("(" + names(locale.months_short if spec == "b" else locale.months) + ")", ("month_short" if spec == "b" else "month_name", 1))
        elif spec == "a":
            out.add(names(locale.days_short))
        elif spec == "A" and more == "D":
            out.add(rf"(?:([0-9]{{4}})([-/]){TWO}\g2{TWO}|{TWO}([-/]){TWO}\g6(?:([0-9]{{4}})|([0-9]{{1,2}}+)(?![0-9])))", ("auto_date", (1, 3, 4, 5, 7, 8, 9)))
            at += 1
        elif spec == "A" and more == "T":
            out.add(rf"{TWO}:{TWO}(?::{TWO}(?:\.([0-9]*+))?+)?+", ("hour24", 1), ("minute", 2), ("second", 3), ("fraction", 4))
            at += 1
        elif spec == "A":
            out.add(names(locale.days))
        elif spec == "z":
            out.add("(?:Z|([+-])([0-9]{2}):?+(?:([0-9]{2})|(?![0-9])))", ("zone", (1, 2, 3)))
        elif spec == "Z":
            out.add(r"\S*+")
        elif spec == ".":
            out.add("[^0-9]")
        elif spec == "%":
            out.add("%")
        else:
            return None
    out.pattern += r"\z"
    return out


def _expand(text: str) -> str:
    return "%%".join(re.sub(r"%([DFTR])", lambda m: SHORT[m[1]], p) for p in text.split("%%"))


def compile_format(format_: str, kind: DataType = DataType.TIMESTAMP, locale: Locale = ENGLISH) -> Callable[[Column], Column]:
    """A function from text to a date, a timestamp in UTC, or microseconds of a time or duration."""
    made = plan(format_, locale)

    def parse(x: Column) -> Column:
        if made is None:
            return F.lit(None).cast({DataType.DATE: "date", DataType.TIMESTAMP: "timestamp_ntz"}.get(kind, "bigint"))
        # all groups at once, then bound to one name: the text is matched once however often they are used
        groups = F.split(F.regexp_replace(x, made.pattern, MARK.join(f"${k}" for k in range(1, made.groups + 1))), MARK)
        found = F.when(x.rlike(made.pattern), groups if made.groups else F.array(F.lit("")))
        return F.get(F.transform(F.array(found), value), F.lit(0))

    def value(found: Column) -> Column:
        group = lambda k: F.get(found, F.lit(k - 1))
        number = lambda k: F.coalesce(group(k).try_cast("bigint"), F.lit(0))
        year, month, day = F.lit(1970), F.lit(1), F.lit(1)
        hour, minute, second, micros, zone = (F.lit(0) for _ in range(5))
        half, sign, valid = None, F.lit(1), found.isNotNull()
        short = lambda n: F.when(n < 69, n + 2000).otherwise(n + 1900)
        index = lambda k, of: F.array_position(F.array(*(F.lit(n.lower()) for n in of)), F.lower(group(k)))
        for what, k in made.says:
            if what == "year":
                year = number(k[0])
            elif what == "short_year":
                year = short(number(k[0]))
            elif what == "month":
                month = number(k[0])
            elif what == "month_short":
                month = index(k[0], locale.months_short)
            elif what == "month_name":
                month = index(k[0], locale.months)
            elif what == "day":
                day = number(k[0])
            elif what == "hour24":
                hour, valid = number(k[0]), valid & (number(k[0]) <= 23)
            elif what == "hour12":
                hour, valid = number(k[0]) % 12, valid & number(k[0]).between(1, 12)
            elif what == "hours":
                hour, valid = number(k[0]), valid & (number(k[0]) <= 2_147_483_647)
            elif what == "negative":
                sign = F.when(group(k[0]) == "-", -1).otherwise(1)
            elif what == "minute":
                minute, valid = number(k[0]), valid & (number(k[0]) <= 59)
            elif what == "second":
                second, valid = number(k[0]), valid & (number(k[0]) <= 59)
            elif what == "fraction":
                micros = fraction(group(k[0]))
            elif what == "pm":
                half = k[0]
            elif what == "zone":
                zone = (number(k[1]) * 60 + number(k[2])) * F.when(group(k[0]) == "-", -1).otherwise(1)
            elif what == "auto_date":
                first = group(k[0]) != ""
                last = group(k[5]) != ""
                year = F.when(first, number(k[0])).when(last, number(k[5])).otherwise(short(number(k[3])))
                month = F.when(first, number(k[1])).when(last, number(k[3])).otherwise(number(k[4]))
                day = F.when(first, number(k[2])).when(last, number(k[4])).otherwise(number(k[6]))
        if half is not None:
            hour = F.when(group(half) != "", F.when(hour < 12, hour + 12).otherwise(hour)).otherwise(F.when(hour == 12, 0).otherwise(hour))
        date = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")).try_cast("date")
        of_day = ((hour * 60 + minute) * 60 + second) * SECOND + micros
        valid = valid & date.isNotNull() & month.between(1, 12)
        if kind == DataType.DATE:
            return F.when(valid, date)
        if kind == DataType.TIME:
            return F.when(valid, of_day * sign)
        return F.when(valid, micros_ntz(F.unix_date(date).cast("bigint") * 86_400 * SECOND + of_day - zone * 60 * SECOND))

    return parse
