"""Errors of records as rows: one for each finding, from one expression over a record's fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SEVERITY = {
    "DUPLICATE_COLUMN_NAMES": "WARNING", "EMPTY_HEADER": "FATAL", "UNCLOSED_QUOTE": "ERROR", "INVALID_QUOTE_ESCAPE": "ERROR", "QUOTE_IN_UNQUOTED_FIELD": "ERROR", "INCONSISTENT_FIELD_COUNT": "ERROR",
    "NULL_BYTE": "ERROR", "TYPE_COERCION": "ERROR",
}
SCHEMA = "code string, severity string, line bigint, `column` int, byte_offset bigint, message string, context string"


class CsvError(ValueError):
    """A reading that its error mode doesn't let pass; errors: the rows found."""

    def __init__(self, message: str, errors: list | None = None):
        super().__init__(message)
        self.errors = errors or []


def numbered(records: DataFrame, in_order: bool) -> DataFrame:
    """Errors of records, with `row` and `before`: how many kept records and bytes of the file come before.

    records: file, block, place, size (with the line's end), kept, and errors, null or an array of structs. Within a
    partition they are numbered where they are read, unless they aren't in order: then these few columns are shuffled.
    What comes before a partition is a sum over partitions, joined by partition.
    """
    part = F.shiftright("place", 33)
    light = records.select("file", "block", part.alias("part"), "place", "size", F.col("kept").cast("long").alias("kept"), "errors")
    if not in_order:
        light = light.repartition("file", "part").sortWithinPartitions("file", "part", "place")
    of_row = light.schema["errors"].dataType
    schema = StructType([*light.select("file", "part", "place").schema.fields, StructField("row", LongType()), StructField("before", LongType()), StructField("errors", of_row)])
    # the file's name only where there is something to say, and a number in its place elsewhere
    wanted = F.col("errors").isNotNull()
    sent = light.select(F.xxhash64("file", "part").alias("run"), "size", "kept", F.when(wanted, F.col("file")).alias("file"), F.when(wanted, F.col("part")).alias("part"), F.when(wanted, F.col("place")).alias("place"), "errors")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, before = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            run, size, kept = (batch.column(i).to_numpy() for i in range(3))
            at = np.flatnonzero(batch.column(6).is_valid().to_numpy(zero_copy_only=False))
            starts = np.flatnonzero(np.concatenate(([run[0] != now], run[1:] != run[:-1])))
            rows, bytes_ = np.cumsum(kept) - kept + row, np.cumsum(size) - size + before
            row, before, now = int(rows[-1] + kept[-1]), int(bytes_[-1] + size[-1]), run[-1]
            if len(starts):
                # a new partition's or file's numbers begin at 0
                of = np.searchsorted(starts, np.arange(len(run)), "right") - 1
                rows_at, bytes_at = rows[starts], bytes_[starts]
                rows = rows - np.where(of >= 0, rows_at[of], 0)
                bytes_ = bytes_ - np.where(of >= 0, bytes_at[of], 0)
                row, before = int(rows[-1] + kept[-1]), int(bytes_[-1] + size[-1])
            if len(at):
                some = batch.take(pa.array(at))
                columns = [some.column(3), some.column(4), some.column(5), pa.array(rows[at], pa.int64()), pa.array(bytes_[at], pa.int64()), some.column(6)]
                yield pa.RecordBatch.from_arrays(columns, ["file", "part", "place", "row", "before", "errors"])

    found = sent.mapInArrow(number, schema)
    earlier = Window.partitionBy("file").orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1)
    totals = light.groupBy("file", "part").agg(F.min("block").alias("first"), F.sum("size").alias("size"), F.sum("kept").alias("n"))
    totals = totals.select("file", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("bytes"))
    return found.join(totals, ["file", "part"]).select("file", "place", (F.col("row") + F.col("rows")).alias("row"), (F.col("before") + F.col("bytes")).alias("before"), "errors")


def finding(code: str, column: Column, message: Column, context: Column, when: Column) -> Column:
    made = F.struct(F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"), column.cast("int").alias("column"), message.alias("message"), F.substring(context, 1, 100).alias("context"))
    return F.when(when, made)


def findings(width: int, quote: str, backslash: bool, names: list[str], typed: list[tuple[Column, Column, str]]) -> Column:
    """All findings of a record with columns line and fields; null where there are none. typed: (text, value, type name) by column."""
    out = []
    size = F.size("fields")
    out.append(F.array(finding("INCONSISTENT_FIELD_COUNT", F.lit(0), F.concat(F.lit(f"Expected {width} fields, got "), size.cast("string")), F.col("line"), size != width)))
    if quote:
        def quoted(f: Column, i: Column) -> Column:
            bare = F.rtrim(f)
            body = F.substring(bare, F.lit(2), F.length(bare) - F.when(F.endswith(bare, F.lit(quote)) & (F.length(bare) >= 2), 2).otherwise(1))
            rest = F.replace(F.regexp_replace(body, r"\\[\s\S]", "") if backslash else body, F.lit(quote * 2), F.lit(""))
            odd = (F.length(f) - F.length(F.replace(F.regexp_replace(f, r"\\[\s\S]", "") if backslash else f, F.lit(quote)))) % 2 == 1
            starts = F.startswith(f, F.lit(quote))
            return F.array(
                finding("UNCLOSED_QUOTE", i + 1, F.lit("a quoted field isn't closed"), f, starts & odd),
                finding("INVALID_QUOTE_ESCAPE", i + 1, F.lit("a quote inside a quoted field isn't doubled"), f, starts & F.contains(rest, F.lit(quote))),
                finding("QUOTE_IN_UNQUOTED_FIELD", i + 1, F.lit("a quote in a field that doesn't begin with one"), f, ~starts & F.contains(f, F.lit(quote))),
            )
        out.append(F.flatten(F.transform("fields", quoted)))
    nulls = F.length("line") - F.length(F.replace("line", F.lit("\u0000")))
    out.append(F.transform(F.when(nulls > 0, F.sequence(F.lit(1), nulls)).otherwise(F.array().cast("array<int>")), lambda i: finding("NULL_BYTE", F.lit(0), F.lit("a null byte"), F.col("line"), F.lit(True))))
    for i, (text, value, kind) in enumerate(typed):
        out.append(F.array(finding("TYPE_COERCION", F.lit(i + 1), F.lit(f"Cannot convert to {kind} in column '{names[i]}'"), text, text.isNotNull() & value.isNull())))
    some = F.filter(F.concat(*out), lambda e: e.isNotNull())
    return F.when(suspicious(width, quote, typed), some)


def suspicious(width: int, quote: str, typed: list[tuple[Column, Column, str]]) -> Column:
    """Can a record have a finding? A plain comparison of what is at hand, so that most records need no more."""
    out = (F.size("fields") != width) | F.contains("line", F.lit("\u0000"))
    if quote:
        out = out | F.contains("line", F.lit(quote))
    for text, value, _ in typed:
        out = out | (text.isNotNull() & value.isNull())
    return out


def header_errors(names: list[str], header: bool) -> list[tuple]:
    """Findings of the header, which is row 1."""
    out = []
    if header and not any(names):
        out.append(("EMPTY_HEADER", SEVERITY["EMPTY_HEADER"], 1, 0, 0, "the header is empty", ""))
    for i, n in enumerate(names):
        if n and names.index(n) != i and names[:i].count(n) == 1:
            out.append(("DUPLICATE_COLUMN_NAMES", SEVERITY["DUPLICATE_COLUMN_NAMES"], 1, i + 1, 0, f"Duplicate column name: '{n}'", n))
    return out


def summary(errors: DataFrame) -> str:
    counts = errors.groupBy("severity", "code").count().orderBy("severity", "code").collect()
    total = sum(r["count"] for r in counts)
    return "\n".join([f"Total errors: {total}", *(f"  {r.severity} {r.code}: {r['count']}" for r in counts)])
