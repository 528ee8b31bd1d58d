import json
import random

import pytest

from tabloom.operators.errors import CsvError
from tabloom.operators.profile import dictionary_analysis, statistics
from tabloom.operators.sink import cells, convert, csv_lines, pretty, write_arrow_ipc, write_parquet
from tabloom.options import ParquetOptions
from tabloom.sources.cache import cache_path
from tabloom.sources.csv import read_csv, read_csv_text
from tabloom.sources.dialect import COMMENTED, CSV, Dialect, cell_type, detect_dialect, line_ending
from tabloom.sources.encoding import detect_encoding, encoding_name
from tabloom.sources.fwf import read_fwf, read_fwf_text
from tabloom.streaming.parser import StreamingParser
from tabloom.types import DataType as D


def rows(table):
    return [tuple(r) for r in table.df.collect()]


def kinds(table):
    return [s["type"] for s in table.schema()]


def test_plain(spark):
    t = read_csv_text(spark, "A,B,C\n1,2,3\n4,5,6\n")
    assert t.names == ["A", "B", "C"] and kinds(t) == ["INT32"] * 3 and rows(t) == [(1, 2, 3), (4, 5, 6)]
    assert t.num_rows == 2 and t.num_columns == 3


@pytest.mark.parametrize("sep", [";", "\t", "|", ":"])
def test_separators_are_detected(spark, sep):
    t = read_csv_text(spark, f"A{sep}B\n1{sep}x\n2{sep}y\n")
    assert t.dialect.separator == sep and rows(t) == [(1, "x"), (2, "y")]


def test_quotes_and_nulls(spark):
    t = read_csv_text(spark, 'A,B,C,D\n"",NA,"NA",1\n"a ""b"", c",," x ",2\n', separator=",")
    assert rows(t) == [("", None, "NA", 1), ('a "b", c', None, " x ", 2)]
    assert kinds(t) == ["STRING", "NA", "STRING", "INT32"]


def test_no_null_tokens(spark):
    assert rows(read_csv_text(spark, "A,B\nNA,x\n", separator=",", null_values="")) == [("NA", "x")]


def test_no_header_and_duplicate_names(spark):
    assert read_csv_text(spark, "1,2\n3,4\n", separator=",", has_header=False).names == ["V1", "V2"]
    t = read_csv_text(spark, "A,A,,a\n1,2,3,4\n", separator=",", error_mode="permissive")
    assert t.names == ["A", "A", "", "a"] and t.df.columns == ["A", "A_2", "V3", "a_3"]
    assert [r.code for r in t.errors.collect()] == ["DUPLICATE_COLUMN_NAMES"]


@pytest.mark.parametrize("ends", ["\n", "\r\n", "\r"])
def test_line_ends(spark, tmp_path, ends):
    path = tmp_path / "x.csv"
    path.write_bytes(ends.join(["A,B", "1,x", "2,y", ""]).encode())
    assert rows(read_csv(spark, str(path))) == [(1, "x"), (2, "y")]


def test_mixed_line_ends(spark, tmp_path):
    (path := tmp_path / "x.csv").write_bytes(b"A,B\n1,x\r2,y\r\n3,z")
    assert sorted(rows(read_csv(spark, str(path)))) == [(1, "x"), (2, "y"), (3, "z")]


def test_records_over_many_splits(spark, tmp_path):
    """Quoted line ends, with splits that begin inside of quotes and records longer than a split."""
    body = [(i, f"line {i}\n" + "\n".join("x," * (i % 7) for _ in range(i % 40)) + '"q"', i * 2) for i in range(400)]
    quoted = lambda s: '"' + s.replace('"', '""') + '"'
    (path := tmp_path / "x.csv").write_text("i,t,j\n" + "".join(f"{i},{quoted(t)},{j}\n" for i, t, j in body))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (700, 3000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            assert sorted(rows(read_csv(spark, str(path), separator=","))) == body
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("split", [40, 300, 1 << 27])
def test_folders(spark, tmp_path, split):
    """Headers, skipped lines and open quotes are each file's own, be it a row, a split or many."""
    want = []
    for k in range(12):
        n = (k * 7) % 9
        body = "".join(f'{k},"{i}\n{i}"\n' if i % 3 == 0 else f"{k},{i}\r\n" for i in range(n))
        want += [(k, f"{i}\n{i}" if i % 3 == 0 else str(i)) for i in range(n)]
        if k == 5:
            body, want = body + '5,"open', [*want, (5, '"open')]
        (tmp_path / f"{k:02}.csv").write_bytes(f"note\na,b\n{body}".encode())
    (tmp_path / "_hidden").write_text("x,y\n1,2\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        t = read_csv(spark, str(tmp_path), separator=",", skip=1, schema=[D.INT32, D.STRING], error_mode="permissive")
        assert sorted(rows(t)) == sorted(want) and t.num_rows == len(want)
        assert [r.a for r in t.head(5).collect()] == [k for k, _ in want[:5]] and [r.a for r in t.tail(2).collect()] == [k for k, _ in want[-2:]]
        assert [(r.code, r.line) for r in t.errors.collect()] == [("UNCLOSED_QUOTE", 2 + (5 * 7) % 9)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_ends_far_into_a_file(spark, tmp_path):
    """CRs that come after the part of the file that is looked at; quoted ones stay, in split files too."""
    head = "a,b\n" + "".join(f"{i},{'x' * 90}\n" for i in range(13_000))
    tail = "\r".join(f"{i},y" for i in range(13_000, 13_050)) + '\r13050,"p\rq"\n13051,"r\r\ns\nt"\r\n13052,z'
    (path := tmp_path / "x.csv").write_bytes((head + tail).encode())
    want = [(i, "x" * 90) for i in range(13_000)] + [(i, "y") for i in range(13_000, 13_050)] + [(13_050, "p\rq"), (13_051, "r\r\ns\nt"), (13_052, "z")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in (100_000, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            t = read_csv(spark, str(path), separator=",")
            assert sorted(rows(t)) == want and t.num_rows == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (path := tmp_path / "y.csv").write_bytes(head.replace("\n", "\r").encode() + b'1,"p\rq"\n2,"r\r\ns"\r\n3,u\r')
    assert sorted(rows(read_csv(spark, str(path), separator=",")))[:5] == [(0, "x" * 90), (1, "p\rq"), (1, "x" * 90), (2, "r\r\ns"), (2, "x" * 90)]


@pytest.mark.parametrize("ends", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("sep, backslash", [(",", False), ("~|", False)])
def test_mixed_ends_against_the_push_parser(spark, ends, sep, backslash):
    """Any mixture of line ends, quotes and separators gives what the byte by byte parser gives."""
    rng = random.Random(f"{ends}{sep}{backslash}")
    for _ in range(12):
        parts = ["a", '"', sep, "\n", "\r", "\r\n", '"b', '""', "c"] + ["\\"] * backslash
        text = f"h1{sep}h2{ends}" + "".join(rng.choice(parts) for _ in range(40)) + ends
        p = StreamingParser(separator=sep, escape_backslash=backslash, null_values="", trim_ws=False)
        p.feed(text.encode())
        p.finish()
        want = [tuple(r) for b in p for r in zip(*b.columns.values())]
        got = read_csv_text(spark, text, separator=sep, schema=[D.STRING, D.STRING], escape_backslash=backslash, null_values="", trim_ws=False, multiline=True)
        plain = [tuple(x if x is None else x.replace("\r\n", "\n").replace("\r", "\n") for x in r) for r in rows(got)]
        assert plain == [tuple(x if x is None else x.replace("\r\n", "\n").replace("\r", "\n") for x in r) for r in want], text


def test_opening_reads_the_start_alone(spark, tmp_path):
    (path := tmp_path / "x.csv").write_text('A,B\n1,"x"\n2,"y\nz"\n')
    jobs = spark.sparkContext.statusTracker()
    seen = len(jobs.getJobIdsForGroup(None))
    t = read_csv(spark, str(path), cache=True)
    assert t.names == ["A", "B"] and kinds(t) == ["INT32", "STRING"] and len(jobs.getJobIdsForGroup(None)) == seen
    assert t.num_rows == 2 and len(jobs.getJobIdsForGroup(None)) > seen
    # rows, and whether records go over lines, are in the side-car now
    seen = len(jobs.getJobIdsForGroup(None))
    assert read_csv(spark, str(path), cache=True).num_rows == 2 and len(jobs.getJobIdsForGroup(None)) == seen
    assert rows(read_csv(spark, str(path), cache=True)) == [(1, "x"), (2, "y\nz")]


def test_errors_beyond_the_most(spark):
    t = read_csv_text(spark, "A,B\n" + "1\n" * 7 + "2,x\n", separator=",", error_mode="best_effort", max_errors=3)
    assert (t.errors.count(), t.error_count, t.suppressed_count) == (3, 7, 4)


def test_null_bytes(spark):
    t = read_csv_text(spark, "A,B\n1,a\0b\0\n", separator=",", error_mode="permissive", schema=[D.INT32, D.STRING])
    assert [(r.code, r.line) for r in t.errors.collect()] == [("NULL_BYTE", 2)] * 2


def test_line_ends_in_quotes_between_long_separators(spark):
    t = read_csv_text(spark, 'A~|B\n1~|x "y\nz" w\n2~|"p~|q"\n', separator="~|")
    assert rows(t) == [(1, 'x "y\nz" w'), (2, "p~|q")]


def test_skipping(spark):
    text = "junk\n\n  \n# note\nA,B\n1,x\n\n# gone\n  \n2,y\n"
    assert rows(read_csv_text(spark, text, skip=1, comment="#", separator=",")) == [(1, "x"), (None, None), (2, "y")]
    assert read_csv_text(spark, "A\n1\n\n2\n", separator=",", skip_empty_rows=False).num_rows == 3


@pytest.mark.parametrize("text, options, message", [("", {}, "Empty"), ("a\nb\n", {"skip": 5}, "skipped"), ("# x\n# y\n", {"comment": "#"}, "comment"), ("a,b\n1,2\n", {"decimal_mark": ","}, "decimal")])
def test_errors_on_opening(spark, text, options, message):
    with pytest.raises(ValueError, match=message):
        read_csv_text(spark, text, **options)


def test_ragged_rows(spark):
    assert rows(read_csv_text(spark, "A,B,C\n1\n1,2,3,4\n", separator=",")) == [(1, None, None), (1, 2, 3)]


def test_error_modes(spark):
    text = 'A,B\n1,x\n2\n3,"y" z\nq,w\n4,v\n'
    t = read_csv_text(spark, text, separator=",", schema=[D.INT32, D.STRING], error_mode="permissive")
    found = [(r.code, r.line, r.byte_offset) for r in t.errors.collect()]
    assert found == [("INCONSISTENT_FIELD_COUNT", 3, 8), ("INVALID_QUOTE_ESCAPE", 4, 10), ("TYPE_COERCION", 5, 18)]
    assert t.num_rows == 5
    fast = read_csv_text(spark, text, separator=",", schema=[D.INT32, D.STRING], error_mode="fail_fast")
    assert fast.errors.count() == 1 and rows(fast) == [(1, "x")]
    few = read_csv_text(spark, text, separator=",", schema=[D.INT32, D.STRING], error_mode="best_effort", max_errors=2)
    assert few.errors.count() == 2


def test_empty_header_is_fatal(spark):
    with pytest.raises(CsvError):
        read_csv_text(spark, "\n1,2\n", separator=",", skip_empty_rows=False, error_mode="permissive")


def test_projection_rows_and_types(spark):
    t = read_csv_text(spark, "A,B,C\n1,x,2024-01-02\n2,y,05.03.2024\n", separator=",", columns=["C", 0], n_rows=2, dtype={"A": "int64"}, formats={"C": "%d.%m.%Y"})
    assert t.names == ["C", "A"] and t.kinds == [D.TIMESTAMP, D.INT64]
    assert [str(r[0]) for r in rows(t)] == ["None", "2024-03-05 00:00:00"]


def test_selecting(spark):
    t = read_csv_text(spark, "A,B\n1,x\n2,y\n3,z\n", separator=",")
    assert t.select(["B", 0, "B"]).columns == ["B", "A", "B_2"]
    for bad in ([], ["Z"], [7]):
        with pytest.raises(ValueError):
            t.select(bad)
    assert [r.A for r in t.head(2).collect()] == [1, 2] and [r.A for r in t.tail(2).collect()] == [2, 3]
    assert t.sample(2, 1).collect() == t.sample(2, 1).collect() and t.sample(9).count() == 3
    assert [b.num_rows for b in t.batches(2)] == [2, 1] and [r["A"] for r in t.iter_rows()] == [1, 2, 3]


def test_arrow(spark):
    import pyarrow as pa

    t = read_csv_text(spark, "A,B\n1,x\n", separator=",")
    assert pa.table(t).to_pydict() == {"A": [1], "B": ["x"]}
    assert pa.schema(t).names == ["A", "B"]


@pytest.mark.parametrize("codec, name", [("utf-8-sig", "utf-8-bom"), ("utf-16", "utf-16-le"), ("utf-16-be", "utf-16-be"), ("utf-32-le", "utf-32-le"), ("latin-1", "latin-1"), ("cp1252", "windows-1252")])
def test_encodings(spark, tmp_path, codec, name):
    text = "name,value\ncafé,1\nnaïve,2\n" + ("“x”,3\n" if codec == "cp1252" else "")
    (path := tmp_path / "x.csv").write_bytes(text.encode(codec))
    t = read_csv(spark, str(path))
    assert t.encoding.name == name and t.names == ["name", "value"] and rows(t)[:2] == [("café", 1), ("naïve", 2)]
    assert encoding_name("ISO_8859-1") == "latin-1" and detect_encoding(b"abc").name == "utf-8"


def test_dialects():
    found = detect_dialect("# c\nname|'x'\nfoo|1\nbar|2\n")
    assert found.dialect.separator == "|" and found.dialect.comment == "#" and found.has_header and found.success
    assert detect_dialect("").warning and not detect_dialect("abc").success
    assert detect_dialect('a,b\n"x \\"y\\"",1\n"z\\"",2\n').dialect.escape == "\\"
    assert CSV.valid and COMMENTED.valid and not Dialect("\n").valid and not Dialect('"').valid
    assert line_ending("a\r\nb\n") == "mixed" and line_ending("a\rb") == "cr" and line_ending("") == "unknown"
    assert [cell_type(c) for c in ("", "true", "1", "1.", "2024-01-02", "10:11", "2024-01-02T10:11:12Z", "x")] == ["EMPTY", "BOOLEAN", "INTEGER", "FLOAT", "DATE", "TIME", "DATETIME", "STRING"]


def test_fixed_width(spark, tmp_path):
    text = "note\n# c\nJohn 25  NYC\nZoë  7   Łódź\n\nAl\n"
    spec = dict(col_starts=[0, 5, 9], col_ends=[5, 9, -1], col_names=["name", "age", "city"], comment="#", skip=1)
    t = read_fwf_text(spark, text.replace("Zoë  7", "Zoe  7"), **spec)
    assert kinds(t) == ["STRING", "INT32", "STRING"] and rows(t) == [("John", 25, "NYC"), ("Zoe", 7, "Łódź"), ("Al", None, None)]
    (path := tmp_path / "x.txt").write_text("  1 2.5  true 2024-01-15\r\n  2 3.5  false2024-01-16\r\n")
    t = read_fwf(spark, str(path), col_starts=[0, 4, 9, 14], col_ends=[4, 9, 14, -1], max_rows=1)
    assert kinds(t) == ["INT32", "FLOAT64", "BOOL", "DATE"] and t.num_rows == 1


def test_cache(spark, tmp_path):
    (path := tmp_path / "x.csv").write_text("A;B\n1;x\n2;y\n")
    first = read_csv(spark, str(path), cache=True)
    side = tmp_path / cache_path("x.csv")
    assert side.exists() and rows(read_csv(spark, str(path), cache=True)) == rows(first)
    side.write_text("{broken")
    assert rows(read_csv(spark, str(path), cache=True)) == rows(first)
    (tmp_path / "kept").mkdir()
    read_csv(spark, str(path), cache=True, cache_dir=str(tmp_path / "kept"))
    assert len([p for p in (tmp_path / "kept").iterdir() if p.name.endswith(".tabloom.json") and not p.name.startswith(".")]) == 1


def test_writing(spark, tmp_path):
    t = read_csv_text(spark, 'A,B,C\n1.5,"x,y",10:20\n1000000.25,"say ""hi""",\n', separator=",")
    made = convert(t, str(tmp_path / "out"), ParquetOptions(compression="snappy"))
    assert (made.rows, made.columns) == (2, 3)
    assert [r.value for r in csv_lines(t.df, times=("C",)).collect()] == ['1.5,"x,y",10:20:00', '1e+06,"say ""hi""",']
    box = pretty(t.df, names=t.names)
    assert box.splitlines()[1].split() == ["|", "A", "|", "B", "|", "C", "|"]
    with pytest.raises(ValueError):
        convert(t, str(tmp_path / "bad"), ParquetOptions(compression="zip"))
    write_arrow_ipc(t, str(tmp_path / "x.arrow"))
    import pyarrow as pa

    assert pa.ipc.open_file(str(tmp_path / "x.arrow")).read_all().num_rows == 2


def test_numbers_as_text(spark):
    rng = random.Random(3)
    values = [0.0, 1.0, -2.5, 1234567.0, 0.0001, 0.00001, 123456.0, 3.14159265, 1e100, float("nan"), float("inf"), -float("inf"), 1e-300, 999999.5, 9999995.0, 99999.95, 0.99999949999, 1e21, 1e22, 1e-16, 9.99999e-17]
    # halves in the seventh digit, as numbers and as they are stored
    values += [n + k / 10**d for n in (1234, 99999, 12) for d in (2, 3, 5) for k in (5, 15, 25, 35, 45, 55)]
    values += [round(rng.uniform(0, 10 ** rng.randint(0, 9)), 2) for _ in range(2000)] + [rng.choice([-1, 1]) * rng.randint(10**5, 10**7) * 10.0 ** rng.randint(-20, 14) * rng.choice([1, 0.5, 0.1]) for _ in range(3000)]
    got = [r[0] for r in cells(spark.createDataFrame([(v,) for v in values], "v double")).collect()]
    assert got == [f"{v:g}" for v in values]
    assert cells(spark.createDataFrame([(None,)], "v double")).first()[0] is None


def test_dictionaries_where_they_pay(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(20_000).selectExpr("id", "concat('v', id % 7) AS few", "concat('v', id) AS many").repartition(1)
    write_parquet(df, str(tmp_path / "out"), ParquetOptions(enable_dictionary="auto"))
    row = pq.ParquetFile(next((tmp_path / "out").glob("*.parquet"))).metadata.row_group(0)
    assert {row.column(i).path_in_schema: row.column(i).has_dictionary_page for i in range(3)} == {"id": False, "few": True, "many": False}


def test_profiles(spark):
    t = read_csv_text(spark, "n,s,e\n" + "".join(f"{i},{'ab' * (i % 3)},\n" for i in range(1, 21)), separator=",")
    found = {r["column"]: r for r in statistics(t.df).collect()}
    assert found["n"].p50 == 10.5 and found["n"]["count"] == 20 and found["s"].max_length == 4 and found["e"].n_unique == 0 and found["e"].max_length is None
    kept = {r["column"]: r.viable for r in dictionary_analysis(t.df).collect()}
    assert kept == {"n": False, "s": True, "e": False}


TEXT = b'a,b\r\n1,"x\r\ny"\n\n2,z\r\n3,"q"'


def test_streaming_at_every_split():
    whole = None
    for cut in range(len(TEXT) + 1):
        p = StreamingParser(batch_size=2)
        p.feed(TEXT[:cut])
        p.feed(TEXT[cut:])
        p.finish()
        batches = list(p)
        got = [row for b in batches for row in zip(*b.columns.values())]
        whole = whole or got
        assert got == whole and [b.is_last for b in batches] == [False] * (len(batches) - 1) + [True]
    assert whole == [("1", "x\ny"), ("2", "z"), ("3", "q")]
    with pytest.raises(ValueError):
        p.feed(b"x")


def test_streaming_errors():
    text = b'a,a\n1,2\n3\n4,x"y\n5,"p"q"\n6,"open'
    p = StreamingParser(error_mode="permissive")
    p.feed(text[:9])
    assert p.has_errors() and [e.code for e in p.errors()] == ["DUPLICATE_COLUMN_NAMES"]
    p.feed(text[9:])
    p.finish()
    found = [(e.code, e.line, e.column, e.byte_offset) for e in p.errors()]
    assert found[1:3] == [("INCONSISTENT_FIELD_COUNT", 3, 0, 8), ("QUOTE_IN_UNQUOTED_FIELD", 4, 2, 10)] and found[-1][0] == "INVALID_QUOTE_ESCAPE"
    few = StreamingParser(error_mode="best_effort", max_errors=1)
    few.feed(text)
    few.finish()
    assert len(few.errors()) == 1 and few.suppressed_count == few.error_count - 1 > 0
    fast = StreamingParser(error_mode="fail_fast")
    fast.feed(b"a,b\n1,2\n3\n4,5\n")
    fast.finish()
    assert [r for b in fast for r in zip(*b.columns.values())] == [("1", "2")] and fast.errors()[0].line == 3
    quiet = StreamingParser()
    quiet.feed(text)
    quiet.finish()
    assert not quiet.has_errors()


def test_streaming_a_large_feed():
    data = b"a,b\n" + b"1,x\n" * 200_000
    p = StreamingParser()
    p.feed(data)
    p.finish()
    assert sum(b.num_rows for b in p) == 200_000


def test_streaming_types(spark):
    p = StreamingParser()
    for i in range(len(TEXT)):
        p.feed(TEXT[i : i + 1])
    p.finish()
    assert p.schema_ready
    assert [tuple(r) for r in p.to_dataframe(spark, p.next_batch()).collect()] == [(1, "x\ny"), (2, "z"), (3, "q")]


def test_command_line(spark, tmp_path, capsys):
    from tabloom.cli import main

    (path := tmp_path / "x.csv").write_text("A,B\n1,x\n2,y\n3,z\n")
    for args, out in ((["count"], "3"), (["head", "-n", "1"], "A,B\n1,x"), (["select", "-c", "B"], "B\nx\ny\nz"), (["tail", "-n", "1"], "A,B\n3,z"), (["schema"], "A\tINT32\tnullable\nB\tSTRING\tnullable")):
        assert main([args[0], str(path), *args[1:]]) == 0
        assert capsys.readouterr().out.strip() == out
    assert main(["convert", str(path), "-o", str(tmp_path / "o")]) == 0 and spark.read.parquet(str(tmp_path / "o")).count() == 3
    assert main(["select", str(path), "-c", "Q"]) == 1 and main(["version"]) == 0
    capsys.readouterr()
    assert main(["dialect", str(path), "-j"]) == 0
    assert json.loads(capsys.readouterr().out)["low_confidence"] is False
    (one := tmp_path / "one.csv").write_text("abc\n")
    assert main(["dialect", str(one)]) == 1 and "--force" in capsys.readouterr().err
    assert main(["dialect", str(one), "-f", "-j"]) == 0
    shown = capsys.readouterr()
    assert json.loads(shown.out)["low_confidence"] is True and "Low confidence" in shown.err
    assert main(["count", str(path), "-p", "-v"]) == 0
    shown = capsys.readouterr()
    assert shown.out.strip() == "3" and "100%" in shown.err and "separator ," in shown.err
    assert main(["help"]) == 0 and "dialect" in capsys.readouterr().out
    assert main(["info", str(path)]) == 0 and main(["stats", str(path), "-j"]) == 0 and main(["dialect", str(path)]) == 0 and main(["pretty", str(path)]) == 0 and main(["sample", str(path)]) == 0


def test_functions_with_keywords(spark, tmp_path):
    import tabloom
    from tabloom import api

    (path := tmp_path / "x.csv").write_text("# note\nA;B;C\n1;x;2,5\n\n2;y;3,5\n3;z;4,5\n")
    t = tabloom.read_csv(str(path), separator=";", comment="#", decimal_mark=",", num_threads=3, usecols=["A", "C"], n_rows=2, dtype={"A": "int64"}, encoding=None)
    assert t.names == ["A", "C"] and rows(t) == [(1, 2.5), (2, 3.5)] and t.num_rows == 2
    assert [r["B"] for r in api.read_csv_rows(str(path), separator=";", comment="#", skip_rows=0)] == ["x", "y", "z"]
    assert [b.num_rows for b in api.read_csv_batched(str(path), batch_size=2, separator=";", comment="#")] == [2, 1]
    made = tabloom.to_parquet(str(path), str(tmp_path / "out"), compression="gzip", row_group_size=2, separator=";", comment="#", error_mode="permissive")
    assert (made.rows, made.columns, made.errors) == (3, 3, 0) and spark.read.parquet(str(tmp_path / "out")).count() == 3
    (bad := tmp_path / "bad.csv").write_text("A,B\n1\n")
    with pytest.raises(CsvError):
        tabloom.to_parquet(str(bad), str(tmp_path / "none"), separator=",", error_mode="fail_fast")
    (wide := tmp_path / "x.txt").write_text("ab 12\ncd 34\n")
    f = tabloom.read_fwf(str(wide), col_starts=[0, 3], col_ends=[2, -1], col_names=["s", "n"], guess_integer=True, num_threads=1)
    assert f.names == ["s", "n"] and rows(f) == [("ab", 12), ("cd", 34)]
    assert api.detect_dialect(str(path)).dialect.separator == ";"


def test_standard_input(spark, capsys, monkeypatch):
    import io
    import sys

    from tabloom.cli import main

    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(b"A,B\n1,x\n2,y\n")))
    assert main(["count", "-"]) == 0 and capsys.readouterr().out.strip() == "2"


def test_streamed_files_with_headers(spark, tmp_path):
    from tabloom.streaming.parser import read_csv_stream

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.csv").write_text(f"note\nA,B\n{k},x\nA,B\n{k},y\n")
    got = read_csv_stream(spark, str(tmp_path / "in"), "note\nA,B\n", separator=",", skip=1, schema=[D.STRING, D.STRING])
    q = got.writeStream.format("memory").queryName("headed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("headed").collect()) == sorted([(str(k), v) for k in range(3) for v in "xy"] + [("A", "B")] * 3)


def top_by_place(df):
    """Are rows limited by their place in the file? What a plain limit gets from a shuffle comes in any order."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "TakeOrderedAndProject" in plan and "GlobalLimit" not in plan and "CollectLimit" not in plan


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_first_rows_of_a_split_fixed_width_file(spark, tmp_path, small_splits):
    (path := tmp_path / "x.txt").write_text("".join(f"{i:6}\n" for i in range(2000)))
    t = read_fwf(spark, str(path), schema=[D.INT32], col_starts=[0], col_ends=[6], max_rows=300)
    assert top_by_place(t.df) and rows(t) == [(i,) for i in range(300)]


def test_first_rows_of_a_split_file(spark, tmp_path, small_splits):
    (path := tmp_path / "x.csv").write_text("A\n" + "".join(f"{i}\n" for i in range(2000)))
    t = read_csv(spark, str(path), separator=",", schema=[D.INT32])
    some = read_csv(spark, str(path), separator=",", schema=[D.INT32], n_rows=300)
    assert t.df.rdd.getNumPartitions() > 2
    assert top_by_place(t.head(300)) and [r.A for r in t.head(300).collect()] == list(range(300))
    assert top_by_place(some.df) and rows(some) == [(i,) for i in range(300)]


@pytest.mark.parametrize("quoted", [False, True])
def test_a_sample_of_a_split_file(spark, tmp_path, small_splits, quoted):
    """Drawn by the rows' numbers, whatever the splits; blank lines and comments are no rows."""
    from hashlib import md5

    value = (lambda i: f"v\n{i}" if quoted and i % 5 == 0 else f"v{i}")
    body = "".join(f"{i},\"{value(i)}\"\n" + "# c\n\n" * (i % 7 == 0) for i in range(2000))
    (path := tmp_path / "x.csv").write_text("A,B\n" + body)
    t = read_csv(spark, str(path), separator=",", comment="#", schema=[D.INT32, D.STRING])
    drawn = sorted(sorted(range(2000), key=lambda i: md5(f"7:{i}".encode()).hexdigest())[:50])
    assert [tuple(r) for r in t.sample(50, 7).collect()] == [(i, value(i)) for i in drawn]
