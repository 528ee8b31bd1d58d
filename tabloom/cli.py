"""The command line: python -m tabloom COMMAND FILE ..."""

from __future__ import annotations

import argparse
import json
import sys
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from . import __version__
from .operators import profile
from .operators.errors import CsvError, summary
from .operators.sink import convert, csv_lines, header_line, pretty
from .operators.table import Table
from .options import CsvOptions, ParquetOptions
from .sources.csv import read_csv, read_csv_text

#: Confidence up to which a detected dialect is a guess.
LEAST_SURE = 0.5
SEPARATORS = {"auto": "", "comma": ",", "tab": "\t", "semicolon": ";", "pipe": "|", "colon": ":"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tabloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("convert", "count", "head", "tail", "sample", "info", "select", "pretty", "schema", "stats", "dialect"):
        p = commands.add_parser(name)
        p.add_argument("file", nargs="?", default="-")
        p.add_argument("-d", "--delimiter", default="auto")
        p.add_argument("-q", "--quote", default='"')
        p.add_argument("-e", "--encoding")
        p.add_argument("-H", "--no-header", action="store_true")
        p.add_argument("--guess-integer", dest="guess_integer", action="store_true", default=True)
        p.add_argument("--no-guess-integer", dest="guess_integer", action="store_false")
        p.add_argument("--no-trim-ws", action="store_true")
        p.add_argument("--escape-backslash", action="store_true")
        p.add_argument("--decimal-mark", default=".")
        p.add_argument("--comment", default="")
        p.add_argument("--skip", type=int, default=0)
        p.add_argument("--strict", action="store_true")
        p.add_argument("--permissive", action="store_true")
        p.add_argument("--max-errors", type=int)
        p.add_argument("--cache", action="store_true")
        p.add_argument("--cache-dir")
        p.add_argument("--no-cache", action="store_true")
        p.add_argument("-j", "--json", action="store_true")
        p.add_argument("-t", "--threads", type=int)
        p.add_argument("-p", "--progress", action="store_true")
        p.add_argument("-v", "--verbose", action="store_true")
        if name in ("head", "tail", "sample", "pretty"):
            p.add_argument("-n", type=int, default=10)
        if name == "sample":
            p.add_argument("-s", "--seed", type=int, default=0)
        if name == "select":
            p.add_argument("-c", "--columns", required=True)
        if name == "convert":
            p.add_argument("-o", "--output", required=True)
            p.add_argument("-c", "--compression", default="zstd")
            p.add_argument("-r", "--row-group-size", type=int, default=1_000_000)
        if name in ("schema", "stats"):
            p.add_argument("-m", "--sample-size", type=int, default=1000)
        if name == "dialect":
            p.add_argument("-f", "--force", action="store_true", help="show the best guess where none is convincing")
    commands.add_parser("version")
    commands.add_parser("help")
    return top


@contextmanager
def watched(spark: SparkSession, a: argparse.Namespace) -> Iterator[None]:
    """-p: how many tasks are done, while it runs; -v: how long it took."""
    done, began = threading.Event(), time.monotonic()

    def tell() -> None:
        tracker, shown = spark.sparkContext.statusTracker(), ""
        while not done.wait(0.2):
            stages = [s for i in tracker.getActiveStageIds() if (s := tracker.getStageInfo(i))]
            line = f"{sum(s.numCompletedTasks for s in stages)} of {sum(s.numTasks for s in stages)} tasks"
            if stages and line != shown:
                print(f"\r{line}", end="", file=sys.stderr, flush=True)
                shown = line
        print(f"\r{100}%" + " " * len(shown), file=sys.stderr)

    teller = threading.Thread(target=tell, daemon=True) if a.progress else None
    if teller:
        teller.start()
    try:
        yield
    finally:
        done.set()
        if teller:
            teller.join()
        if a.verbose:
            print(f"{a.command}: {time.monotonic() - began:.3f} s", file=sys.stderr)


def options(a: argparse.Namespace) -> CsvOptions:
    mode = "fail_fast" if a.strict else "permissive" if a.permissive or a.max_errors is not None else "disabled"
    return CsvOptions(
        separator=SEPARATORS.get(a.delimiter, a.delimiter), quote=a.quote, encoding=a.encoding, has_header=not a.no_header, guess_integer=a.guess_integer, trim_ws=not a.no_trim_ws, escape_backslash=a.escape_backslash,
        decimal_mark=a.decimal_mark, comment=a.comment, skip=a.skip, error_mode=mode, max_errors=10_000 if a.max_errors is None else a.max_errors, cache=(a.cache or a.cache_dir is not None) and not a.no_cache, cache_dir=a.cache_dir, sample_rows=getattr(a, "sample_size", 1000),
    )


def opened(spark: SparkSession, a: argparse.Namespace) -> Table:
    if a.file == "-":
        return read_csv_text(spark, sys.stdin.buffer.read(), options(a))
    return read_csv(spark, a.file, options(a))


def show(table: Table, df) -> None:
    print(header_line(table.names if df.columns == table.df.columns else df.columns, table.dialect.separator))
    times = tuple(n for n, k in zip(table.df.columns, table.kinds) if k.name == "TIME")
    for row in csv_lines(df, table.dialect.separator, table.dialect.quote or '"', times).toLocalIterator():
        print(row.value)


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in ("-h", "--help") and not argv[0].startswith("-") and "." in argv[0]:
        argv.insert(0, "convert")
    top = parser()
    a = top.parse_args(argv)
    if a.command == "version":
        print(f"tabloom {__version__}")
        return 0
    if a.command == "help":
        top.print_help()
        return 0
    made = SparkSession.builder.appName("tabloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    # -t: cores, where there is no session yet and no cluster is named
    spark = SparkSession.getActiveSession() or (made.master(f"local[{a.threads}]") if a.threads else made).getOrCreate()
    try:
        with watched(spark, a):
            return run(spark, a)
    except (CsvError, ValueError, FileNotFoundError) as e:
        if a.command in ("count", "info", "head") and str(e) == "Empty file":
            print(0 if a.command == "count" else "Rows: 0" if a.command == "info" else "")
            return 0
        print(f"Error: {e}", file=sys.stderr)
        return 1


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    table = opened(spark, a)
    if a.verbose:
        print(f"{table.source}: {table.size} bytes, {table.dialect}, {table.encoding.name}" + (f", {table.warning}" if table.warning else ""), file=sys.stderr)
    if a.command == "count":
        print(table.num_rows)
    elif a.command in ("head", "tail"):
        show(table, getattr(table, a.command)(a.n))
    elif a.command == "sample":
        show(table, table.sample(a.n, a.seed))
    elif a.command == "select":
        show(table, table.select([c.strip() for c in a.columns.split(",") if c.strip()]))
    elif a.command == "pretty":
        print(pretty(table.head(a.n), a.n, names=table.names))
    elif a.command == "info":
        found = table.info()
        if a.json:
            print(json.dumps(found))
        else:
            lines = [f"{k.capitalize()}: {found[k]}" for k in ("source", "size", "dialect", "encoding", "rows")]
            print("\n".join([*lines, f"Columns: {len(found['columns'])}", *(f"  {i}. {c['name']} ({c['type']})" for i, c in enumerate(found["columns"], 1))]))
    elif a.command == "schema":
        rows = table.schema()
        print(json.dumps(rows) if a.json else "\n".join(f"{r['name']}\t{r['type']}\tnullable" for r in rows))
    elif a.command == "stats":
        rows = [r.asDict(True) for r in profile.statistics(table.df).orderBy("place").collect()]
        print(json.dumps(rows, default=str) if a.json else "\n".join(f"{r['column']}: " + ", ".join(f"{k}={v}" for k, v in r.items() if k not in ("column", "place", "hist") and v is not None) for r in rows))
    elif a.command == "dialect":
        return tell_dialect(table, a)
    elif a.command == "convert":
        made = convert(table, a.output, ParquetOptions(compression=a.compression, row_group_size=a.row_group_size), a.strict)
        print(f"{made.rows} rows, {made.columns} columns, {made.errors} errors", file=sys.stderr)
    if options(a).error_mode != "disabled" and a.command in ("count", "convert", "info") and table.error_count:
        print(summary(table.errors), file=sys.stderr)
        if table.suppressed_count:
            print(f"  suppressed: {table.suppressed_count}", file=sys.stderr)
    return 0


def tell_dialect(table: Table, a: argparse.Namespace) -> int:
    d, sure = table.dialect, 1.0 if table.confidence is None else table.confidence
    low = sure <= LEAST_SURE
    if low and not a.force:
        print(f"Error: no convincing dialect (confidence {sure:.2f})\nHint: --force shows the best guess", file=sys.stderr)
        return 1
    if low:
        print(f"Warning: Low confidence ({sure:.2f})", file=sys.stderr)
    if table.ambiguous:
        print(f"Warning: {table.warning}", file=sys.stderr)
    if a.json:
        print(json.dumps({"delimiter": d.separator, "quote": d.quote, "escape": d.escape, "comment": d.comment, "line_ending": d.line_ending, "header": table.names, "encoding": table.encoding.name, "confidence": round(sure, 4), "low_confidence": low, "ambiguity": table.warning if table.ambiguous else "", "warning": table.warning}))
        return 0
    name = next((n for n, x in SEPARATORS.items() if x == d.separator), d.separator)
    flags = f"-d {name}" + (f" -q '{d.quote}'" if d.quote != '"' else "") + (" --escape-backslash" if d.escape == "\\" else "") + (f" --comment '{d.comment}'" if d.comment else "")
    print(f"Delimiter: {name}\nQuote: {d.quote or 'none'}\nEncoding: {table.encoding.name}\nLine ends: {d.line_ending}\nConfidence: {sure:.2f}" + (" (LOW CONFIDENCE)" if low else "") + f"\nCLI flags: {flags}")
    return 0
