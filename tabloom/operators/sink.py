"""Writing tables: Parquet, delimited text, boxes of text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import ParquetOptions
from .errors import CsvError
from .profile import dictionary_analysis
from .table import Table


@dataclass
class Conversion:
    rows: int
    columns: int
    errors: int
    path: str


def write_parquet(df: DataFrame, path: str, options: ParquetOptions | None = None, mode: str = "overwrite") -> None:
    o = options or ParquetOptions()
    if o.compression not in o.CODECS:
        raise ValueError(f"compression is one of {', '.join(o.CODECS)}")
    writer = df.write.mode(mode).option("compression", o.CODECS[o.compression])
    if o.enable_dictionary == "auto":
        # one more scan counts the distinct values, approximately
        writer.option("parquet.enable.dictionary", "false")
        for r in dictionary_analysis(df, exact=False).where("viable").select("column").collect():
            writer.option(f"parquet.enable.dictionary#{r.column}", "true")
    else:
        writer.option("parquet.enable.dictionary", str(o.enable_dictionary).lower())
    writer.option("maxRecordsPerFile", 0).option("parquet.block.row.count.limit", o.row_group_size).option("parquet.compression.codec.zstd.level", o.compression_level).parquet(path)


def convert(table: Table, path: str, options: ParquetOptions | None = None, fail_fast: bool = False) -> Conversion:
    """table as Parquet; with fail_fast, any error refuses it."""
    found = table.error_count
    if fail_fast and found:
        raise CsvError(f"{found} errors", table.errors.collect())
    seen = Observation()
    write_parquet(table.df.observe(seen, F.count(F.lit(1)).alias("rows")), path, options)
    return Conversion(seen.get["rows"], table.num_columns, found, path)


#: Powers of ten from 10**LOW on. Up to 10**22 they are exact.
LOW, POWERS = -17, [float(f"1e{k}") for k in range(-17, 24)]


def with_double_texts(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """df with a column of texts beside each of these double columns, under its name and "_text".

    Six significant digits, trailing zeros off, an exponent where it is under -4 or over the digits; rounded by the
    number's exact value, half to even. Steps are projections of their own, so that each is worked out once.
    """

    def power(k: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, POWERS)), k - LOW + 1)

    def step(of) -> None:
        nonlocal df
        df = df.select("*", *(c.alias(f"{n}_{k}") for n in names for k, c in of(lambda k, n=n: F.col(f"`{n}`" if k is None else f"`{n}_{k}`"))))

    # where all powers that are used are exact; the few other numbers are left to the formatter
    step(lambda c: [("usual", F.coalesce(F.abs(c(None)).between(1e-16, 1e20), F.lit(False)))])
    step(lambda c: [("a", F.when(c("usual"), F.abs(c(None))).otherwise(1.0))])
    step(lambda c: [("e0", F.floor(F.log10(c("a"))).cast("int"))])
    step(lambda c: [("e", c("e0") + F.when(c("a") >= power(c("e0") + 1), 1).when(c("a") < power(c("e0")), -1).otherwise(0))])
    step(lambda c: [("up", c("e") < digits), ("d", power(F.abs(digits - 1 - c("e"))))])
    step(lambda c: [("m", F.when(c("up"), c("a") * c("d")).otherwise(c("a") / c("d")))])
    # what rounding took from the product: halves of the factors' bits multiply without loss
    step(lambda c: [("f", F.when(c("up"), c("a")).otherwise(c("m")))])
    step(lambda c: [("p", c("f") * c("d")), ("t", c("f") * 134217729.0), ("u", c("d") * 134217729.0)])
    step(lambda c: [("fh", c("t") - (c("t") - c("f"))), ("dh", c("u") - (c("u") - c("d"))), ("whole", F.floor(c("m")))])
    step(lambda c: [("fl", c("f") - c("fh")), ("dl", c("d") - c("dh")), ("rest", c("m") - c("whole"))])
    step(lambda c: [("err", ((c("fh") * c("dh") - c("p")) + c("fh") * c("dl") + c("fl") * c("dh")) + c("fl") * c("dl"))])
    step(lambda c: [("off", F.when(c("up"), c("err")).otherwise((c("a") - c("p")) - c("err")))])
    step(lambda c: [("k", c("whole") + F.when(c("rest") > 0.5, 1).when(c("rest") < 0.5, 0).when(c("off") > 0, 1).when(c("off") < 0, 0).otherwise(c("whole") % 2))])
    step(lambda c: [("x", c("e") + F.when(c("k") == 10**digits, 1).otherwise(0)), ("s", F.when(c("k") == 10**digits, F.lit("1" + "0" * (digits - 1))).otherwise(c("k").cast("string")))])

    def text(c) -> Column:
        x, s, v = c("x"), c("s"), c(None)
        trim = lambda t: F.rtrim(t, F.lit("0"))
        dotted = lambda lead, rest: F.when(rest != "", F.concat(lead, F.lit("."), rest)).otherwise(lead)
        above = dotted(F.substring(s, F.lit(1), x + 1), trim(F.substring(s, x + 2, F.lit(digits))))
        below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -x - 1), trim(s))
        sign = F.when(x < 0, "-").otherwise("+")
        raised = F.concat(dotted(F.substring(s, 1, 1), trim(F.substring(s, 2, digits))), F.lit("e"), sign, F.lpad(F.abs(x).cast("string"), 2, "0"))
        usual = F.concat(F.when(v < 0, "-").otherwise(""), F.when(x.between(0, digits - 1), above).when(x.between(-4, -1), below).otherwise(raised))
        formatted = F.format_string(f"%.{digits - 1}e", v)
        other = F.concat(F.regexp_replace(F.substring_index(formatted, "e", 1), r"\.?0+$", ""), F.lit("e"), F.substring_index(formatted, "e", -1))
        return F.when(c("usual"), usual).when(F.isnan(v), "nan").when(v == 0, "0").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").when(v.isNotNull(), other)

    kept = [c for c in df.columns if not any(c.startswith(f"{n}_") for n in names)]
    return df.select(*(f"`{c}`" for c in kept), *(text(lambda k, n=n: F.col(f"`{n}`" if k is None else f"`{n}_{k}`")).alias(f"{n}_text") for n in names))


def text_of(x: Column, kind: T.DataType, time: bool = False, exact: bool = False) -> Column:
    """A value as text. exact: all digits of numbers and of seconds, so that reading gives the value again.

    Numbers with fewer digits than all are made by cells(), which takes several steps for them.
    """
    if isinstance(kind, T.BooleanType):
        return x.cast("string")
    if isinstance(kind, T.DateType):
        return F.date_format(x, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss" + (".SSSSSS" if exact else ""))
    if time:
        second = F.call_function("div", x, F.lit(1_000_000))
        parts = F.format_string("%02d:%02d:%02d", F.call_function("div", second, F.lit(3600)), F.call_function("div", second, F.lit(60)) % 60, second % 60)
        rest = F.format_string(".%06d", x % 1_000_000)
        return F.when(x.isNull(), None).when(x % 1_000_000 == 0, parts).otherwise(F.concat(parts, rest))
    return x.cast("string")


def cells(df: DataFrame, times: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """df with all values as texts, under c0, c1 and so on."""
    fields = df.schema.fields
    rounded = [] if exact else [i for i, f in enumerate(fields) if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    out = df.select(*((F.col(f"`{f.name}`").cast("double") if i in rounded else F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)))
    out = with_double_texts(out, [f"c{i}" for i in rounded]) if rounded else out
    return out.select(*((F.col(f"c{i}_text") if i in rounded else text_of(F.col(f"c{i}"), f.dataType, f.name in times, exact)).alias(f"c{i}") for i, f in enumerate(fields)))


def quoted(text: Column, sep: str = ",", quote: str = '"') -> Column:
    """In quotes where the text has the separator, a quote or a line end; null is empty."""
    needs = F.contains(text, F.lit(sep)) | F.contains(text, F.lit(quote)) | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
    inner = F.replace(text, F.lit(quote), F.lit(quote * 2))
    return F.coalesce(F.when(needs, F.concat(F.lit(quote), inner, F.lit(quote))).otherwise(text), F.lit(""))


#: Characters that texts of numbers, times and truth values are made of.
PLAIN = frozenset("0123456789+-.:TZEe") | frozenset("truefalsenaniInfinity")


def csv_lines(df: DataFrame, sep: str = ",", quote: str = '"', times: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """One line of text a row, in a column `value`."""
    bare = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    safe = not PLAIN.intersection(sep) and quote not in PLAIN
    texts = [F.coalesce(f"c{i}", F.lit("")) if safe and isinstance(f.dataType, bare) else quoted(F.col(f"c{i}"), sep, quote) for i, f in enumerate(df.schema.fields)]
    return cells(df, times, exact).select(F.concat_ws(sep, *texts).alias("value"))


def header_line(names: list[str], sep: str = ",", quote: str = '"') -> str:
    return sep.join(quote + n.replace(quote, quote * 2) + quote if any(c in n for c in (sep, quote, "\n", "\r")) else n for n in names)


def write_csv(df: DataFrame, path: str, sep: str = ",", quote: str = '"', header: bool = True, mode: str = "overwrite") -> None:
    """Files of lines, each with the header."""
    texts = cells(df, exact=True).toDF(*df.columns)
    texts.write.mode(mode).csv(path, sep=sep, quote=quote, escape=quote, header=header, emptyValue='""', nullValue="")


def pretty(df: DataFrame, n: int = 10, most: int = 40, names: list[str] | None = None) -> str:
    """The first n rows in a box; cells over `most` characters end in dots."""
    cut = lambda s: s if len(s) <= most else s[: most - 3] + "..."
    heads = [cut(c) for c in (names or df.columns)]
    rows = [[cut(v or "") for v in r] for r in cells(df.limit(n)).collect()]
    widths = [max(len(r[i]) for r in [heads, *rows]) for i in range(len(heads))]
    bar = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r: "|" + "|".join(f" {c:<{w}} " for c, w in zip(r, widths)) + "|"
    return "\n".join([bar, line(heads), bar, *map(line, rows), bar])


def write_arrow_ipc(table: Table, path: str) -> None:
    """An Arrow IPC file on the driver's disk, a batch at a time."""
    import pyarrow as pa

    kind = table.df.limit(0).toArrow().schema
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, kind) as out:
        for batch in table.batches():
            out.write_batch(batch)


def decode_files(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(path, text) of whole files in an encoding."""
    from ..sources.encoding import CODECS, encoding_name

    name = encoding_name(encoding)
    codec = CODECS.get(name, name)

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [b.decode(codec, "replace") for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "path string, text string")
