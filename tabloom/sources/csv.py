"""Reading delimited text: what a sample of the file's start tells, then one plan over the whole file."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import coerce
from ..functions.fields import split_fields, split_python, value_python, with_texts
from ..functions.formats import compile_format
from ..functions.infer import column_types, fold, folded, infer_field
from ..operators.errors import SCHEMA, CsvError, findings, header_errors, numbered
from ..operators.table import FILE, PLACE, Plan, Table
from ..options import CsvOptions, tokens
from ..types import DataType, parse_type
from .cache import load_cache, save_cache
from .dialect import CSV, Dialect, detect_dialect
from .encoding import CODECS, Encoding, decode, detect_encoding, encoding_name
from .records import Quotes, bare_line, body_of, decoded_lines, joined, lines, odd_quotes, placed, read_head, unfolded


@dataclass
class Start:
    """What the start of a text tells. before: the text that comes before the first record; sample: the records after it."""

    names: list[str]
    separator: str
    has_header: bool
    before: str
    dialect: Dialect
    warning: str
    sample: list[str]
    confidence: float | None = None
    ambiguous: bool = False


def physical(names: list[str]) -> list[str]:
    """Unique names: empty ones by place, repeated ones with a number."""
    out: list[str] = []
    taken = {FILE.lower(), PLACE.lower()}
    for i, n in enumerate(names, 1):
        base = n or f"V{i}"
        name, k = base, 1
        while name.lower() in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def start_of(text: str, o: CsvOptions, whole: bool) -> Start:
    """whole: text is all there is, so that its last line is complete."""
    lines_ = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z", text)
    if not whole and len(lines_) > 1 and not lines_[-1].endswith("\n"):
        lines_.pop()  # the sample may end inside of a line, or between the two halves of its end
    rows = [x.rstrip("\r\n") if x.endswith(("\r", "\n")) else x for x in lines_]
    at = min(o.skip, len(rows))
    if not rows:
        raise CsvError("Empty file")
    if at >= len(rows):
        raise CsvError("All data skipped")
    blank = (lambda r: not r.strip(" \t\r")) if o.skip_empty_rows else (lambda r: False)
    while at < len(rows) and (blank(rows[at]) or o.comment and rows[at].lstrip(" \t").startswith(o.comment)):
        at += 1
    if at >= len(rows):
        raise CsvError("File contains only comment lines" if o.comment else "Empty file")
    dialect, comment, header, warning = replace(CSV, separator=o.separator or ",", quote=o.quote, comment=o.comment), o.comment, o.has_header, ""
    confidence, ambiguous = None, False
    if not o.separator:
        found = detect_dialect("\n".join(rows[at:]))
        warning, confidence, ambiguous = found.warning, found.confidence, found.ambiguous
        if found.success:
            dialect = found.dialect
            comment = o.comment or dialect.comment
            header = header and found.has_header
        while at < len(rows) and comment and rows[at].startswith(comment):
            at += 1
    if dialect.separator == o.decimal_mark:
        raise CsvError("the separator is the decimal mark")
    found_records = join_python(lines_[at:], dialect.separator, dialect.quote, o.escape_backslash)
    first, n = found_records[0] if found_records else ("", 0)
    raw = [value_python(f, dialect.quote, o.escape_backslash, True) for f in split_python(first, dialect.separator, dialect.quote, o.escape_backslash)]
    names = raw if header else [f"V{i}" for i in range(1, len(raw) + 1)]
    rest = found_records[1:] if header else found_records
    kept = [r for r, _ in rest if (r or not o.skip_empty_rows) and not (comment and r.startswith(comment))]
    before = "".join(lines_[: at + (n if header else 0)])
    return Start(names, dialect.separator, header, before, replace(dialect, comment=comment), warning, kept, confidence, ambiguous)


def join_python(lines_: list[str], sep: str, quote: str, backslash: bool) -> list[tuple[str, int]]:
    """(record, its lines) of a list of lines with their ends."""
    bare = lambda x: x[: len(x.rstrip("\r\n"))] if x.endswith(("\r", "\n")) else x
    if not quote:
        return [(bare(x), 1) for x in lines_]
    quotes, out, held = Quotes(sep, quote, backslash), [], []
    inside = False
    for x in lines_:
        held.append(x)
        inside = quotes.ends_inside(bare(x), inside)
        if not inside:
            out.append((bare("".join(held)), len(held)))
            held = []
    return out + ([(bare("".join(held)), len(held))] if held else [])


def typed(text: Column, kind: DataType, o: CsvOptions, format_: str | None = None) -> Column:
    if format_:
        return compile_format(format_, kind)(text)
    return coerce(text, kind, o.decimal_mark, tokens(o.true_values), tokens(o.false_values))


def how(o) -> tuple:
    return tokens(o.null_values), tokens(o.true_values), tokens(o.false_values), o.guess_integer, getattr(o, "decimal_mark", ".")


class Reading:
    """The plan over lines (file, block, index, line) of a text that starts so; in_order: do a scan's partitions follow the file?"""

    def __init__(self, rows: DataFrame, start: Start, o: CsvOptions, ends: str = "\n", in_order: bool = True, multiline: bool | None = None, place: Callable[[DataFrame], DataFrame] = placed):
        self.start, self.o, self.ends, self.in_order, self.place = start, o, ends, in_order, place
        self.sep, self.quote = start.separator, start.dialect.quote
        self.body = body_of(rows, start.before, ends)
        asked = o.multiline if o.multiline is not None else multiline
        self.multiline = False if not self.quote else asked
        self.kinds: list[DataType] = []

    def lines(self) -> DataFrame:
        """Records, if none goes on in the next line."""
        return self.place(unfolded(self.body, self.sep, self.quote, self.o.escape_backslash, self.ends))

    def look(self) -> bool:
        """Does some line have an odd number of quotes? One scan, the first time that it matters."""
        if self.multiline is None:
            self.multiline = bool(self.lines().where(odd_quotes(self.quote)).limit(1).count())
        return self.multiline

    def records(self) -> DataFrame:
        """(file, block, place, size, kept, line) of all records, size with the line's end; kept: neither blank nor a comment."""
        found = joined(self.body, self.sep, self.quote, self.o.escape_backslash, self.ends) if self.look() else self.lines()
        return self.marked(found)

    def marked(self, found: DataFrame) -> DataFrame:
        kept = F.lit(True)
        if self.o.skip_empty_rows:
            kept = kept & (F.col("line") != "")
        if self.start.dialect.comment:
            kept = kept & ~F.startswith("line", F.lit(self.start.dialect.comment))
        bare = found.withColumn("size", F.octet_length("line") + 1).withColumn("line", bare_line(F.col("line"), self.ends))
        return bare.withColumn("kept", kept)

    def count(self) -> int:
        """Rows, by a scan that sees in passing whether records go over lines."""
        if self.multiline is None:
            odd = odd_quotes(self.quote)
            n, some = self.marked(self.lines()).agg(F.count(F.when(F.col("kept"), 1)), F.count(F.when(odd, 1))).first()
            self.multiline = bool(some)
            if not some:
                return n
        return self.records().where("kept").count()

    def fields(self, found: DataFrame) -> DataFrame:
        return found.withColumn("fields", split_fields(F.col("line"), self.sep, self.quote, self.o.escape_backslash))

    def plan(self) -> Plan:
        start, o, kinds, width = self.start, self.o, self.kinds, len(self.start.names)
        all_ = self.records()
        strict = o.error_mode != "disabled"
        if not strict:
            all_ = all_.where("kept").drop("size", "kept")
        fields = with_texts(self.fields(all_), width, self.quote, o.escape_backslash, o.trim_ws, tokens(o.null_values))
        fields = fields.select("*", *(typed(F.col(f"__t{i}"), k, o, o.formats.get(n)).alias(f"__v{i}") for i, (k, n) in enumerate(zip(kinds, start.names))))
        columns = [F.col(f"__v{i}").alias(n) for i, n in enumerate(physical(start.names))]
        in_order = self.in_order and not self.multiline
        if not strict:
            return Plan(fields.select(F.col("file").alias(FILE), F.col("place").alias(PLACE), *columns), in_order)
        triples = [(F.col(f"__t{i}"), F.col(f"__v{i}"), k.name) for i, k in enumerate(kinds)]
        found = F.when(F.col("kept"), findings(width, self.quote, o.escape_backslash, start.names, triples))
        each = numbered(fields.select("file", "block", "place", "size", "kept", found.alias("errors")), not self.multiline)
        each = each.select("file", "place", "row", "before", F.explode("errors").alias("e"))
        first, offset = 2 if start.has_header else 1, len(start.before.encode())
        each = each.select("file", "place", F.col("e.code"), F.col("e.severity"), (F.col("row") + first).cast("bigint").alias("line"), F.col("e.column"), (F.col("before") + offset).cast("bigint").alias("byte_offset"), F.col("e.message"), F.col("e.context"))
        top = header_errors(start.names, start.has_header)
        errors = each.drop("file", "place")
        errors = errors.sparkSession.createDataFrame(top, SCHEMA).unionByName(errors) if top else errors
        if o.error_mode == "fail_fast":
            stop = each.orderBy("file", "byte_offset").first()
            kept = errors.where("severity <> 'WARNING'").orderBy("byte_offset", "column").limit(1)
            if stop is not None:
                fields = fields.where((F.col("file") < stop.file) | (F.col("file") == stop.file) & (F.col("place") < stop.place))
        else:
            kept = errors.orderBy("byte_offset", "column").limit(o.max_errors)
        rows = fields.where("kept").select(F.col("file").alias(FILE), F.col("place").alias(PLACE), *columns)
        return Plan(rows, in_order, errors, kept)


def table_of(reading: Reading, encoding: Encoding, source: str = "", size: int = 0, kinds: list[DataType] | None = None) -> Table:
    """The table of a reading; nothing is read before it is needed, but where the types are to come from all rows."""
    o, start = reading.o, reading.start
    kinds = list(kinds or infer_kinds(reading))
    for name, kind in o.dtype.items():
        if name not in start.names:
            raise ValueError(f"dtype names no column: {name}")
        kinds[start.names.index(name)] = parse_type(kind)
    for name in o.formats:
        if name in start.names and kinds[start.names.index(name)] not in (DataType.DATE, DataType.TIMESTAMP, DataType.TIME):
            kinds[start.names.index(name)] = DataType.TIMESTAMP
    if o.error_mode in ("fail_fast", "permissive"):
        top = header_errors(start.names, start.has_header)
        if any(e[1] == "FATAL" for e in top):
            raise CsvError(top[0][5], top)
    reading.kinds = kinds
    made = Table(reading.plan, list(start.names), kinds, physical(start.names), dict(o.formats), start.dialect, encoding, source, size, start.warning, start.confidence, start.ambiguous, max_errors=o.max_errors)
    return narrowed(made, o, reading)


def narrowed(table: Table, o: CsvOptions, reading: Reading) -> Table:
    """The columns and rows asked for."""
    columns = table.columns
    if o.columns is not None:
        at = [c if isinstance(c, int) else table.names.index(c) if c in table.names else -1 for c in o.columns]
        if any(not 0 <= i < len(table.names) for i in at):
            raise ValueError(f"no such columns: {o.columns}")
        columns = [table.columns[i] for i in at]
        table = replace(table, names=[table.names[i] for i in at], kinds=[table.kinds[i] for i in at], columns=columns)

    def plan() -> Plan:
        made = reading.plan()
        rows = made.rows.select(FILE, PLACE, *(f"`{c}`" for c in columns))
        if o.n_rows is not None:
            rows = rows.orderBy(FILE, PLACE).limit(o.n_rows)
        return replace(made, rows=rows)

    # where reading stops at an error, only the plan knows how many rows there are
    counted = None if o.error_mode == "fail_fast" else reading.count if o.n_rows is None else lambda: min(o.n_rows, reading.count())
    return replace(table, plan=plan, counted=counted)


def infer_kinds(reading: Reading) -> list[DataType]:
    start, o, width = reading.start, reading.o, len(reading.start.names)
    if o.sample_rows:
        rows = [[inferred(f, start.dialect.quote, o) for f in split_python(r, start.separator, start.dialect.quote, o.escape_backslash)] for r in start.sample[: o.sample_rows] if r.strip(" \t")]
        return column_types(rows, width, *how(o))
    # every row counts: one aggregate over the whole file, a number for each column
    fields = reading.fields(reading.records().where("kept"))
    texts = with_texts(fields, width, start.dialect.quote, o.escape_backslash, o.trim_ws, [])
    kinds = texts.select(*(infer_field(F.col(f"__t{i}"), *how(o)).alias(f"k{i}") for i in range(width)))
    return [folded(k) for k in kinds.agg(*(fold(F.col(f"k{i}"))[0].alias(f"k{i}") for i in range(width))).first()]


def inferred(raw: str, quote: str, o: CsvOptions) -> str:
    """A field as inference sees it: unquoted even where a null token is quoted."""
    text = value_python(raw, quote, o.escape_backslash, o.trim_ws)
    return text.rstrip(" \t") if o.trim_ws and raw.startswith(quote or "\0") else text


def read_csv(spark: SparkSession, path: str, options: CsvOptions | None = None, schema: list[DataType] | None = None, **named) -> Table:
    """A delimited text file (or a folder of such files with one header each) as a Table.

    Options are those of CsvOptions, by name. schema: the columns' types in place of inferred ones.
    """
    o = replace(options or CsvOptions(), **named)
    o.check()
    head, size, changed, folder = read_head(spark, path)
    encoding = Encoding(encoding_name(o.encoding), _mark(head, encoding_name(o.encoding))) if o.encoding else detect_encoding(head)
    text = decode(head[: len(head) - len(head) % encoding.wide], encoding)
    ends = "\n" if encoding.transcodes else line_sep(text)
    kept = None if o.force_cache_refresh or not o.cache else load_cache(spark, path, size, changed, o)
    start = start_of(text, replace(o, separator=kept["separator"]) if kept else o, len(head) == size)
    kinds = list(schema) if schema else [DataType[k] for k in kept["kinds"]] if kept else None
    if kinds and len(kinds) != len(start.names):
        raise ValueError(f"the schema has {len(kinds)} columns, the file {len(start.names)}")
    if encoding.transcodes:
        rows = decoded_lines(spark, path, CODECS.get(encoding.name, encoding.name), encoding.mark)
    else:
        rows = lines(spark, path, ends)
    reading = Reading(rows, start, o, ends, not folder, kept.get("multiline") if kept else None)
    table = replace(table_of(reading, encoding, path, size, kinds), many_files=folder)
    if o.cache and not folder:
        known = {"separator": start.separator, "kinds": [k.name for k in reading.kinds], "multiline": reading.multiline, "rows": kept.get("rows") if kept else None}
        if not kept:
            save_cache(spark, path, size, changed, o, known)

        def counted() -> int:
            # the file's rows and whether records go over lines stay in the side-car
            if known["rows"] is None:
                known["rows"], known["multiline"] = reading.count(), reading.multiline
                save_cache(spark, path, size, changed, o, known)
            return known["rows"] if o.n_rows is None else min(o.n_rows, known["rows"])

        table = replace(table, counted=counted if table.counted else None)
    return table


def _mark(head: bytes, name: str) -> int:
    found = detect_encoding(head)
    return found.mark if found.name.removesuffix("-bom") == name.removesuffix("-bom") else 0


def line_sep(text: str) -> str:
    """What the text source cuts at: LF, or CR where the start of the text has no other line end."""
    return "\r" if "\r" in text and "\n" not in text else "\n"


def cut(text: str, ends: str) -> list[str]:
    found = text.split(ends)
    return found[:-1] if not found[-1] else found


def memory_lines(spark: SparkSession, text: str, ends: str) -> DataFrame:
    found = cut(text, ends)
    return spark.createDataFrame([("", 0, i, r) for i, r in enumerate(found)], "file string, block long, index long, line string").coalesce(1)


def read_csv_text(spark: SparkSession, text: str | bytes, options: CsvOptions | None = None, schema: list[DataType] | None = None, **named) -> Table:
    """A delimited text in memory."""
    o = replace(options or CsvOptions(), **named)
    o.check()
    data = text.encode() if isinstance(text, str) else text
    encoding = Encoding(encoding_name(o.encoding), _mark(data, encoding_name(o.encoding))) if o.encoding else detect_encoding(data)
    plain = decode(data, encoding)
    ends = line_sep(plain)
    return table_of(Reading(memory_lines(spark, plain, ends), start_of(plain, o, True), o, ends), encoding, "<memory>", len(data), schema)


def read_csv_lines(rows: DataFrame, sample: str, options: CsvOptions | None = None, schema: list[DataType] | None = None, **named) -> Table:
    """Lines that are already in a DataFrame, in its one string column; sample: the text's start with its header.

    The rows hold records only, without the header.
    """
    o = replace(options or CsvOptions(), **named)
    o.check()
    start = replace(start_of(sample, o, True), before="")
    given = rows.select(F.lit("").alias("file"), F.lit(1).cast("long").alias("block"), F.lit(0).cast("long").alias("index"), F.col(rows.columns[0]).alias("line"))
    return table_of(Reading(given, start, o), Encoding("utf-8"), "<lines>", 0, schema)
