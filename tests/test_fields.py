import random

import pytest
from pyspark.sql import functions as F

from tabloom.functions.coerce import boolean, date, float64, int32, int64, time, timestamp
from tabloom.functions.fields import split_fields, split_python, unescape, unescape_python
from tabloom.functions.formats import Locale, compile_format
from tabloom.functions.infer import infer_field, infer_python
from tabloom.options import FALSES, NULLS, TRUES, tokens
from tabloom.types import DataType as D


def machine(record, sep=",", quote='"'):
    """Field by field: one that begins with a quote ends at a separator after an even number of quotes."""
    out, at = [], 0
    while True:
        end, quotes = at, 0
        whole = record[at : at + 1] == quote
        while end < len(record) and not (record[end] == sep and (not whole or quotes % 2 == 0)):
            quotes += record[end] == quote
            end += 1
        out.append(record[at:end])
        if end >= len(record):
            return out
        at = end + 1


def texts(n, alphabet, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_splitting_against_a_state_machine(spark):
    rows = texts(3000, 'ab,"\n ', 1)
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    got = [x.f for x in df.select("r", split_fields(F.col("r"), ",").alias("f")).collect()]
    assert got == [machine(r) for r in rows]
    assert [split_python(r, ",") for r in rows] == got


def test_splitting_with_backslashes(spark):
    rows = [r'"a\"b",c', r"a\,b,c", r'"x\\",y', r'a,"b\,c"', 'plain,b']
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    got = [x.f for x in df.select(split_fields(F.col("r"), ",", '"', True).alias("f")).collect()]
    assert got == [[r'"a\"b"', "c"], [r"a\,b", "c"], [r'"x\\"', "y"], ["a", r'"b\,c"'], ["plain", "b"]]
    assert [split_python(r, ",", '"', True) for r in rows] == got


def test_separators_of_several_characters(spark):
    df = spark.createDataFrame([('a~|"b~|c"~|d',), ("~|~|",), ("a~b|c",)], "r string")
    assert [x.f for x in df.select(split_fields(F.col("r"), "~|").alias("f")).collect()] == [["a", '"b~|c"', "d"], ["", "", ""], ["a~b|c"]]


@pytest.mark.parametrize("text, plain", [(r"a\nb", "a\nb"), (r"a\\nb", "a\\nb"), (r"\q\t", "q\t"), ("x\\", "x\\"), (r"\\\\", "\\\\")])
def test_unescaping(spark, text, plain):
    assert unescape_python(text, '"', True) == plain
    assert spark.createDataFrame([(text,)], "t string").select(unescape(F.col("t"), '"', True)).first()[0] == plain


def column(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_integers(spark):
    assert column(spark, int32, ["1", "+7", "-2147483648", "2147483648", " 5", "1.0", "00000000001", "000000000001", None]) == [1, 7, -2147483648, None, None, None, 1, None, None]
    assert column(spark, int64, ["9223372036854775807", "9223372036854775808", "-1", "+", ""]) == [9223372036854775807, None, -1, None, None]


def test_floats_and_booleans(spark):
    assert column(spark, float64, ["1.5", "+.5e1", "5.", "1d", "1f", "inf", " 1", "+-5", "++5", "1,5"]) == [1.5, 5.0, 5.0, None, None, float("inf"), None, -5.0, None, None]
    assert column(spark, lambda x: float64(x, ","), ["1,5", "1.5"]) == [1.5, None]
    assert column(spark, boolean, ["true", "1", "No", "0", "tRUE"]) == [True, True, False, False, None]


def test_dates_and_timestamps(spark):
    got = column(spark, lambda x: date(x).cast("string"), ["2024-02-29", "2023/02/29", "2024/01/05", "2024-1-5", "0001-01-01"])
    assert got == ["2024-02-29", None, "2024-01-05", None, "0001-01-01"]
    cases = {
        "2024-01-02T10:11:12": "2024-01-02 10:11:12", "2024-01-02 1011": None if len("2024-01-02 1011") < 15 else "2024-01-02 10:11:00", "2024-01-02T101112.5Z": "2024-01-02 10:11:12.5",
        "2024-01-02T10:11:12+02:30": "2024-01-02 07:41:12", "2024-01-02T10:11:12-05": "2024-01-02 15:11:12", "2024-01-02T10:11:12.1234567": "2024-01-02 10:11:12.123456", "2024-01-02T10:11:60": None,
        "2024-01-02T24:00": None, "2024-02-30T10:00": None, "2024-01-02T10:11:12 ": None, "2024-01-02T10:11:12+15:00": None, "2024-01-02T10:11:12Z and more": "2024-01-02 10:11:12", "2024/01/02 10:11": "2024-01-02 10:11:00",
        "2024-01-02T10:11:12+05:3": None,
    }
    assert column(spark, lambda x: timestamp(x).cast("string"), list(cases)) == list(cases.values())


def test_times(spark):
    second = 1_000_000
    cases = {"9:05": (9 * 60 + 5) * 60 * second, "12:00 AM": 0, "12:00 pm": 43_200 * second, "1:02:03.1234567": 3_723_123_456, "24:00": None, "1:2": None, "13:00 PM": None, "10:20:30 ": 37_230 * second, "10:20PM": None}
    assert column(spark, time, list(cases)) == list(cases.values())


def test_inference_agrees_with_itself(spark):
    rows = texts(4000, "0129-+/:.TZ eENAtrue", 3) + ["2024-01-02", "2024-01-02T10:11", "10:20 PM", "1e5", "NA", "true"]
    how = (tokens(NULLS), tokens(TRUES), tokens(FALSES))
    assert column(spark, lambda x: infer_field(x, *how), rows) == [int(infer_python(r, *how)) for r in rows]


@pytest.mark.parametrize(
    "fmt, kind, text, out",
    [
        ("%Y-%m-%d", D.DATE, "2024-2-29", "2024-02-29"), ("%Y-%m-%d", D.DATE, "2023-2-29", None), ("%d %b %Y", D.DATE, "5 JAN 2024", "2024-01-05"), ("%d. %B %Y", D.DATE, "5. may 2024", "2024-05-05"), ("%D", D.DATE, "1/2/68", "2068-01-02"),
        ("%D", D.DATE, "1/2/69", "1969-01-02"), ("%A, %e %B %Y", D.DATE, "Monday,  5 May 2025", "2025-05-05"), ("%AD", D.DATE, "24-3-1", "2024-03-01"), ("%AD", D.DATE, "3/14/2024", "2024-03-14"), ("%AD", D.DATE, "2024/3/1", "2024-03-01"),
        ("%F %T", D.TIMESTAMP, "2024-01-02   03:04:05", "2024-01-02 03:04:05"), ("%F %I:%M %p", D.TIMESTAMP, "2024-01-02 12:04 am", "2024-01-02 00:04:00"), ("%FT%H:%M:%OS%z", D.TIMESTAMP, "2024-01-02T03:04:05.25+0130", "2024-01-02 01:34:05.25"),
        ("%F %R %Z", D.TIMESTAMP, "2024-01-02 03:04 CET", "2024-01-02 03:04:00"), ("%h:%M", D.TIME, "-100:30", -361_800_000_000), ("%AT", D.TIME, "1:2:3.5", 3_723_500_000), ("%H%.%M", D.TIME, "10x20", 37_200_000_000),
        ("100%%", D.DATE, "100%", "1970-01-01"), ("%q", D.DATE, "1", None), ("%Y", D.DATE, "2024 ", None), ("%H", D.TIME, "24", None), ("%x", D.DATE, "2024-03-04", "2024-03-04"),
    ],
)
def test_formats(spark, fmt, kind, text, out):
    got = spark.createDataFrame([(text,)], "t string").select(compile_format(fmt, kind)(F.col("t")).cast("string")).first()[0]
    assert got == (None if out is None else str(out))


def test_locales(spark):
    french = Locale(months=("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"))
    got = spark.createDataFrame([("3 février 2024",)], "t string").select(compile_format("%d %B %Y", D.DATE, french)(F.col("t")).cast("string")).first()[0]
    assert got == "2024-02-03"
