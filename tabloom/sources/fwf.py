"""Reading fixed-width text."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import coerce
from ..functions.infer import column_types
from ..operators.table import FILE, PLACE, Plan, Table
from ..options import FwfOptions, tokens
from ..types import DataType
from .csv import how, line_sep, memory_lines, physical
from .dialect import Dialect
from .encoding import CODECS, Encoding, decode, detect_encoding, encoding_name
from .records import bare_line, body_of, decoded_lines, lines, placed, read_head, unfolded


def slice_of(line: Column, start: int, end: int) -> Column:
    """Bytes start to end (-1: all that follow) of a line; empty where the line is shorter."""
    raw = line.cast("binary")
    part = F.substring(raw, F.lit(start + 1), F.lit(1 << 30 if end == -1 else end - start))
    return F.when(F.octet_length(line) <= start, F.lit("")).otherwise(part.cast("string"))


def slice_python(line: str, start: int, end: int) -> str:
    return line.encode()[start : None if end == -1 else end].decode("utf-8", "replace")


def _kept(rows: list[str], o: FwfOptions) -> list[str]:
    """Comments go first, then the lines to skip."""
    rows = [r for r in rows if not (o.comment and r.startswith(o.comment))][o.skip :]
    return [r for r in rows if r or not o.skip_empty_rows]


def table_of(rows: DataFrame, head: str, o: FwfOptions, encoding: Encoding, ends: str, whole: bool, source: str, size: int, schema: list[DataType] | None, in_order: bool = True) -> Table:
    """The table of lines (file, block, index, line) of a text that starts with `head`; comments go first, then the lines to skip."""
    found = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z", head)
    if not whole and len(found) > 1 and not found[-1].endswith("\n"):
        found.pop()
    width = len(o.col_starts)
    spans = list(zip(o.col_starts, o.col_ends))
    trim = (lambda s: s.strip(" \t")) if o.trim_ws else (lambda s: s)
    cells = [[trim(slice_python(r, a, b)) for a, b in spans] for r in _kept([r.rstrip("\r\n") for r in found], o)[: o.sample_rows or None]]
    kinds = schema or column_types(cells, width, *how(o))
    if len(kinds) != width:
        raise ValueError(f"the schema has {len(kinds)} columns, the specification {width}")
    names = o.col_names or [f"V{i}" for i in range(1, width + 1)]
    left, split = o.skip, 0
    while left and split < len(found):
        # the lines to skip lie at the start; comments among them don't count
        left -= not (o.comment and found[split].startswith(o.comment))
        split += 1
    body = unfolded(body_of(rows, "".join(found[:split]), ends), "\0", "", False, ends)
    found = placed(body).withColumn("line", bare_line(F.col("line"), ends))
    if o.comment:
        found = found.where(~F.startswith("line", F.lit(o.comment)))
    if o.skip_empty_rows:
        found = found.where(F.length("line") > 0)
    if o.max_rows >= 0:
        found = found.orderBy("file", "place").limit(o.max_rows)
    nulls = tokens(o.null_values)
    values = []
    for (a, b), kind in zip(spans, kinds):
        text = slice_of(F.col("line"), a, b)
        text = F.btrim(text, F.lit(" \t")) if o.trim_ws else text
        text = F.when(text.isin(nulls), F.lit(None)).otherwise(text) if nulls else text
        values.append(coerce(text, kind, ".", tokens(o.true_values), tokens(o.false_values)))
    out = found.select(F.col("file").alias(FILE), F.col("place").alias(PLACE), *(v.alias(n) for v, n in zip(values, physical(list(names)))))
    return Table(Plan(out, in_order), list(names), list(kinds), physical(list(names)), {}, Dialect(separator=" ", quote=""), encoding, source, size)


def read_fwf(spark: SparkSession, path: str, options: FwfOptions | None = None, schema: list[DataType] | None = None, **named) -> Table:
    """A fixed-width file: col_starts and col_ends (exclusive, -1 for the end of the line) in bytes of UTF-8."""
    o = replace(options or FwfOptions(), **named)
    o.check()
    head, size, _, folder = read_head(spark, path)
    encoding = Encoding(encoding_name(o.encoding)) if o.encoding else detect_encoding(head)
    text = decode(head[: len(head) - len(head) % encoding.wide], encoding)
    ends = "\n" if encoding.transcodes else line_sep(text)
    rows = decoded_lines(spark, path, CODECS.get(encoding.name, encoding.name), encoding.mark) if encoding.transcodes else lines(spark, path, ends)
    return table_of(rows, text, o, encoding, ends, len(head) == size, path, size, schema, not folder)


def read_fwf_text(spark: SparkSession, text: str, options: FwfOptions | None = None, schema: list[DataType] | None = None, **named) -> Table:
    o = replace(options or FwfOptions(), **named)
    o.check()
    ends = line_sep(text)
    return table_of(memory_lines(spark, text, ends), text, o, Encoding("utf-8"), ends, True, "<memory>", len(text.encode()), schema)


def read_fwf_lines(rows: DataFrame, options: FwfOptions | None = None, schema: list[DataType] | None = None, sample: str = "", **named) -> Table:
    """Lines that are already in a DataFrame's one string column; sample: some of them, for the types."""
    o = replace(options or FwfOptions(), **named)
    o.check()
    given = rows.select(F.lit("").alias("file"), F.lit(1).cast("long").alias("block"), F.lit(0).cast("long").alias("index"), F.col(rows.columns[0]).alias("line"))
    return table_of(given, sample, o, Encoding("utf-8"), "\n", True, "<lines>", 0, schema)
