"""Registered queries of the engine with their SQL: tables are rendered to text, read again, and must come back the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import boolean, date, float64, int32, int64, time, timestamp
from ..functions.fields import split_fields, unescape
from ..functions.formats import compile_format
from ..functions.infer import fold, folded, infer_field
from ..operators import profile
from ..operators.errors import CsvError
from ..operators.sink import cells, convert, csv_lines, header_line, quoted, text_of, write_parquet
from ..options import FALSES, NULLS, TRUES, ParquetOptions, tokens
from ..scratch import scratch
from ..sources.csv import read_csv, read_csv_lines, read_csv_text
from ..sources.dialect import line_ending
from ..sources.encoding import detect_encoding, encoding_name
from ..sources.fwf import read_fwf, read_fwf_lines
from ..streaming.parser import StreamingParser, read_csv_stream
from ..types import DataType, wider

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
I32, I64, DBL, STR, TS, DAY, BOOL = DataType.INT32, DataType.INT64, DataType.FLOAT64, DataType.STRING, DataType.TIMESTAMP, DataType.DATE, DataType.BOOL


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def again(df: DataFrame, kinds: list[DataType], sep: str = ",", **options) -> DataFrame:
    """df rendered to lines and read again with these types."""
    lines = csv_lines(df, sep, exact=True)
    return read_csv_lines(lines, header_line(df.columns, sep) + "\n", separator=sep, schema=kinds, multiline=False, **options).df


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem GROUP BY ALL")
def csv_lineitem_summary(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    got = again(df, [STR, STR, DBL, DBL])
    return got.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def csv_roundtrip_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    return again(df, [I64, I64, I64, I32, DBL, DBL, DBL, DBL, STR, STR, TS])


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def csv_roundtrip_quotes(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return again(df, [I64, TS, I64, STR, DBL, STR], null_values="")


@query("SELECT doc_id, text, lang FROM documents")
def csv_file_multiline(spark, sf_dir):
    """A folder of files whose quoted texts have line ends of every kind."""
    path = scratch(spark, "multiline")
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    csv_lines(df, exact=True).write.text(path)
    return read_csv(spark, path, separator=",", has_header=False, schema=[I64, STR, STR], null_values="", trim_ws=False).df.toDF("doc_id", "text", "lang")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file as it is, through Spark's file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def one_text(lines: DataFrame, path: str, ends: str = "\n") -> str:
    """A single file of (part, key, value) in that order."""
    lines.repartition(1).sortWithinPartitions("part", "key").select("value").write.option("lineSep", ends).text(path)
    return files(lines.sparkSession, path)[0]


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def csv_folder(spark, sf_dir):
    """A folder of 50 files, each with a line to skip, a comment and a header of its own."""
    path = scratch(spark, "folder")
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    lines = df.select((F.col("c_custkey") % 50).alias("part"), F.concat_ws(",", *(F.col(c).cast("string") for c in df.columns)).alias("line"))
    texts = lines.groupBy("part").agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    one_each = spark.range(50, numPartitions=50).join(F.broadcast(texts), F.col("id") == F.col("part"), "left")
    one_each.select(F.concat_ws("\n", F.lit("made by hand"), F.lit("# a note"), F.lit(header_line(df.columns)), "text").alias("value")).write.text(path)
    return read_csv(spark, path, separator=",", skip=1, comment="#", schema=[I64, STR, I32]).df


@query("SELECT l_orderkey, l_linenumber, CAST('a' || chr(13) || chr(10) || 'b' || chr(13) || 'c' AS VARCHAR) AS held, repeat('x', 300) AS wide FROM lineitem")
def csv_file_late_line_ends(spark, sf_dir):
    """Over a megabyte of lines that end in LF, then lines that end in CR; CRs and LFs inside of quotes stay."""
    path = scratch(spark, "late")
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    line = F.concat(F.col("l_orderkey").cast("string"), F.lit(","), F.col("l_linenumber").cast("string"), F.lit(',"a\r\nb\rc",' + "x" * 300))
    lines = df.select(key.alias("key"), line.alias("value"), (F.col("l_linenumber") >= 3).alias("late"))
    late = lines.where("late").groupBy((F.col("key") / 100).cast("long").alias("key")).agg(F.array_join(F.array_sort(F.collect_list("value")), "\r").alias("value")).withColumn("part", F.lit(2))
    head = spark.createDataFrame([(0, 0, "l_orderkey,l_linenumber,held,wide")], "part int, key long, value string")
    every = head.unionByName(lines.where("NOT late").select(F.lit(1).alias("part"), "key", "value")).unionByName(late.select("part", "key", "value"))
    return read_csv(spark, one_text(every, path), separator=",", schema=[I64, I32, STR, STR], trim_ws=False).df


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_file_crlf(spark, sf_dir):
    return _ended(spark, sf_dir, "\r\n")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_file_cr(spark, sf_dir):
    return _ended(spark, sf_dir, "\r")


def _ended(spark, sf_dir, ends):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    lines = df.select(F.lit(1).alias("part"), F.col("c_custkey").alias("key"), F.concat_ws(",", *cells_of(df)).alias("value"))
    head = spark.createDataFrame([(0, 0, header_line(df.columns))], "part int, key long, value string")
    return read_csv(spark, one_text(head.unionByName(lines), scratch(spark, "ended"), ends), dtype={"c_custkey": "int64", "c_acctbal": "float64"}).df


def cells_of(df: DataFrame, sep: str = ",") -> list:
    return [quoted(text_of(F.col(f.name), f.dataType, exact=True), sep) for f in df.schema.fields]


def files(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith("part") and f.getLen())


def one_file(df: DataFrame, path: str, key: str, sep: str = ",") -> None:
    """A file with a header and the rows in order of a key, as a single text."""
    lines = df.select(F.lit(1).alias("part"), F.col(key).cast("long").alias("key"), F.concat_ws(sep, *cells_of(df, sep)).alias("value"))
    head = df.sparkSession.createDataFrame([(0, 0, header_line(df.columns, sep))], "part int, key long, value string")
    one_text(head.unionByName(lines), path)


def _orders(spark, sf_dir, sep, **options):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return again(df, [I64, I64, STR, DBL, TS, STR], sep, **options)


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query(ORDERS)
def sep_pipe(spark, sf_dir):
    return _orders(spark, sf_dir, "|")


@query(ORDERS)
def sep_semicolon(spark, sf_dir):
    return _orders(spark, sf_dir, ";")


@query(ORDERS)
def sep_tab(spark, sf_dir):
    return _orders(spark, sf_dir, "\t")


@query(ORDERS)
def sep_multibyte(spark, sf_dir):
    return _orders(spark, sf_dir, "~|")


@query(ORDERS)
def csv_file_detected(spark, sf_dir):
    """A file with a header, its dialect and types found out from its start."""
    path = scratch(spark, "detected")
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    one_file(df, path, "o_orderkey", ";")
    got = read_csv(spark, files(spark, path)[0], dtype={"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "string", "o_totalprice": "float64"})
    return got.df


@query(r"""SELECT event_id, props, event_type FROM events""")
def backslash_escape(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "props", "event_type")
    text = F.concat(F.lit('"'), F.replace(F.replace(F.col("props"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = df.select(F.concat_ws(",", F.col("event_id").cast("string"), text, "event_type").alias("value"))
    return read_csv_lines(lines, "event_id,props,event_type\n", separator=",", schema=[I64, STR, STR], escape_backslash=True, multiline=False).df


@query("SELECT p_partkey, p_retailprice FROM part")
def decimal_comma(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")).alias("p_retailprice"))
    lines = df.select(F.concat_ws(";", F.col("p_partkey").cast("string"), "p_retailprice").alias("value"))
    return read_csv_lines(lines, "p_partkey;p_retailprice\n", separator=";", decimal_mark=",", schema=[I64, DBL], multiline=False).df


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1, 2) THEN NULL ELSE o_orderpriority END AS bare, CASE o_orderkey % 4 WHEN 0 THEN 'NA' WHEN 1 THEN 'null' WHEN 2 THEN '' ELSE o_orderpriority END AS quoted FROM orders")
def null_tokens(spark, sf_dir):
    """Bare null tokens are null, quoted ones are texts."""
    word = F.when(F.col("o_orderkey") % 4 == 0, "NA").when(F.col("o_orderkey") % 4 == 1, "null").when(F.col("o_orderkey") % 4 == 2, "").otherwise(F.col("o_orderpriority"))
    lines = table(spark, sf_dir, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(","), word, F.lit(',"'), word, F.lit('"')).alias("value"))
    return read_csv_lines(lines, "o_orderkey,bare,quoted\n", separator=",", schema=[I64, STR, STR], multiline=False).df


@query("SELECT c_custkey, c_name, '  ' || c_mktsegment || ' ' AS kept FROM customer")
def trim_ws(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").select(F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit(" ,\t"), "c_name", F.lit("  ,"), F.lit('"  '), "c_mktsegment", F.lit(' "')).alias("value"))
    return read_csv_lines(lines, "c_custkey,c_name,kept\n", separator=",", schema=[I64, STR, STR], multiline=False).df


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def skip_comment_blank(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    body = "".join(f"{r.n_nationkey},{r.n_name},{r.n_regionkey}\n" + ("# a note\n\n" if i % 5 == 0 else "") for i, r in enumerate(rows))
    return read_csv_text(spark, "to be skipped\n\n  \n# more\nn_nationkey,n_name,n_regionkey\n" + body, skip=1, comment="#", separator=",").df


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer")
def ragged_pad_truncate(spark, sf_dir):
    key = F.col("c_custkey")
    line = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, F.concat_ws(",", key.cast("string"), "c_name", F.col("c_nationkey").cast("string"), F.lit("more"), F.lit("and more"))).otherwise(F.concat_ws(",", key.cast("string"), "c_name", F.col("c_nationkey").cast("string")))
    return read_csv_lines(table(spark, sf_dir, "customer").select(line.alias("value")), "c_custkey,c_name,c_nationkey\n", separator=",", schema=[I64, STR, I32], multiline=False).df


@query("SELECT * FROM (VALUES ('l_orderkey','INT32'),('l_linenumber','INT32'),('l_quantity','FLOAT64'),('l_shipdate','TIMESTAMP'),('l_returnflag','STRING'),('wide','INT64'),('day','DATE'),('clock','TIME'),('flag','BOOL'),('none','NA')) t(\"column\", \"type\")")
def infer_schema(spark, sf_dir):
    """Types from all rows, as an aggregate."""
    df = table(spark, sf_dir, "lineitem")
    texts = df.select(
        F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string"), text_of(F.col("l_shipdate"), df.schema["l_shipdate"].dataType).alias("l_shipdate"), F.concat("l_returnflag", F.lit("_")).alias("l_returnflag"),
        (F.col("l_orderkey") + 3_000_000_000).cast("string").alias("wide"), F.date_format("l_shipdate", "yyyy/MM/dd").alias("day"), F.concat(F.lit("1"), F.col("l_linenumber") % 10, F.lit(":05")).alias("clock"),
        F.when(F.col("l_linenumber") == 1, "T").otherwise("false").alias("flag"), F.lit("NA").alias("none"),
    )
    how = (tokens(NULLS), tokens(TRUES), tokens(FALSES))
    kinds = texts.agg(*(fold(infer_field(F.col(c), *how))[0].alias(c) for c in texts.columns)).first()
    return spark.createDataFrame([(c, folded(kinds[c]).name) for c in texts.columns], "`column` string, type string")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS i64, CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE CAST(-(o_orderkey % 1000) AS INTEGER) END AS i32 FROM orders")
def coerce_integers(spark, sf_dir):
    key = F.col("o_orderkey")
    wide = F.when(key % 5 == 0, F.concat(key.cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("+"), key.cast("string")))
    short = F.when(key % 5 == 1, F.lit("99999999999")).otherwise((-(key % 1000)).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", int64(wide).alias("i64"), int32(short).alias("i32"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS f64, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM orders")
def coerce_floats_booleans(spark, sf_dir):
    key = F.col("o_orderkey")
    number = F.when(key % 7 == 0, F.concat(F.col("o_totalprice").cast("string"), F.lit("d"))).when(key % 2 == 0, F.concat(F.lit("+"), F.col("o_totalprice").cast("string"))).otherwise(F.col("o_totalprice").cast("string"))
    flag = F.when(key % 3 == 0, F.when(key % 2 == 0, "Yes").otherwise("1")).when(key % 3 == 1, F.when(key % 2 == 0, "F").otherwise("no")).otherwise("maybe")
    return table(spark, sf_dir, "orders").select("o_orderkey", float64(number).alias("f64"), boolean(flag).alias("flag"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 6 = 1 THEN NULL ELSE CAST(o_orderdate AS DATE) + INTERVAL (o_orderkey % 24) HOUR + INTERVAL (o_orderkey % 60) MINUTE - CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 90 MINUTE ELSE INTERVAL 0 MINUTE END END AS stamp FROM orders")
def coerce_dates_timestamps(spark, sf_dir):
    key = F.col("o_orderkey")
    day = F.when(key % 6 == 0, F.lit("2024-02-30")).when(key % 2 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    clock = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(key % 2 == 0, "T").otherwise(" "), F.format_string("%02d", key % 24), F.when(key % 3 == 0, "").otherwise(":"), F.format_string("%02d", key % 60))
    stamp = F.when(key % 6 == 1, F.concat(clock, F.lit("x"))).when(key % 2 == 0, F.concat(clock, F.lit("+01:30"))).otherwise(clock)
    return table(spark, sf_dir, "orders").select("o_orderkey", date(day).alias("day"), timestamp(stamp).alias("stamp"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE ((o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + (o_orderkey % 59)) * 1000000 + CASE WHEN o_orderkey % 2 = 0 THEN 250000 ELSE 0 END END AS micros FROM orders")
def coerce_times(spark, sf_dir):
    key = F.col("o_orderkey")
    hour = key % 24
    rest = F.concat(F.lit(":"), F.format_string("%02d", key % 60), F.lit(":"), F.format_string("%02d", key % 59))
    text = F.when(key % 9 == 0, F.concat(F.lit("25"), rest)).when(key % 2 == 0, F.concat(hour.cast("string"), rest, F.lit(".25"))).otherwise(F.concat(F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), rest, F.when(hour < 12, " AM").otherwise(" pm")))
    return table(spark, sf_dir, "orders").select("o_orderkey", time(text).alias("micros"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d1, CAST(o_orderdate AS DATE) AS d2, o_orderdate - INTERVAL 2 HOUR AS t1, CAST(-(o_orderkey * 3600 + 61) * 1000000 AS BIGINT) AS h1 FROM orders")
def format_strptime(spark, sf_dir):
    when = F.col("o_orderdate")
    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(when, "d MMM yyyy").alias("a"), F.date_format(when, "M/d/yyyy").alias("b"), F.concat(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(" +02:00")).alias("c"), F.concat(F.lit("-"), F.col("o_orderkey").cast("string"), F.lit(":01:01")).alias("d"))
    return texts.select("o_orderkey", compile_format("%d %b %Y", DAY)(F.col("a")).alias("d1"), compile_format("%AD", DAY)(F.col("b")).alias("d2"), compile_format("%Y-%m-%dT%H:%M:%OS %z", TS)(F.col("c")).alias("t1"), compile_format("%h:%M:%S", DataType.TIME)(F.col("d")).alias("h1"))


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def fwf_read(spark, sf_dir):
    line = F.concat(F.rpad(F.col("c_custkey").cast("string"), 12, " "), F.rpad("c_name", 25, " "), F.lpad(F.col("c_nationkey").cast("string"), 6, " "), "c_mktsegment")
    lines = table(spark, sf_dir, "customer").select(line.alias("value"))
    return read_fwf_lines(lines, schema=[I64, STR, I32, STR], col_starts=[0, 12, 37, 43], col_ends=[12, 37, 43, -1], col_names=["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).df


def _customers(spark, sf_dir):
    path = scratch(spark, "customers")
    one_file(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "c_custkey")
    return read_csv(spark, files(spark, path)[0], separator=",", dtype={"c_custkey": "int64", "c_acctbal": "float64"})


@query("SELECT c_acctbal, c_custkey, c_acctbal AS c_acctbal_2 FROM customer")
def select_columns(spark, sf_dir):
    return _customers(spark, sf_dir).select(["c_acctbal", 0, "c_acctbal"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 10")
def head_n(spark, sf_dir):
    return _customers(spark, sf_dir).head(10)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey DESC LIMIT 10")
def tail_n(spark, sf_dir):
    return _customers(spark, sf_dir).tail(10)


@query("SELECT c_custkey, c_name, c_acctbal FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer) ORDER BY md5('7:' || place) LIMIT 10")
def sample_n(spark, sf_dir):
    return _customers(spark, sf_dir).sample(10, 7)


@query("SELECT count(*) AS n FROM customer")
def count_rows(spark, sf_dir):
    return _customers(spark, sf_dir).df.agg(F.count("*").alias("n"))


@query("SELECT 'l_quantity' AS \"column\", count(*) AS count, 0 AS nulls, count(DISTINCT l_quantity) AS n_unique, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS p0, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.75) AS p75, max(l_quantity) AS p100 FROM lineitem")
def column_stats(spark, sf_dir):
    got = profile.statistics(again(table(spark, sf_dir, "lineitem").select("l_quantity"), [DBL]))
    return got.select("column", "count", F.col("nulls").cast("int").alias("nulls"), "n_unique", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "p0", "p25", "p50", "p75", "p100")


@query("SELECT 'o_orderstatus' AS \"column\", count(o_orderstatus) AS value_count, CAST(0 AS BIGINT) AS null_count, min(o_orderstatus) AS min, max(o_orderstatus) AS max FROM orders UNION ALL SELECT 'o_orderkey', count(o_orderkey), 0, CAST(min(o_orderkey) AS VARCHAR), CAST(max(o_orderkey) AS VARCHAR) FROM orders")
def basic_stats(spark, sf_dir):
    return profile.basic_statistics(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")).drop("place")


@query("WITH t AS (SELECT 'l_returnflag' AS \"column\", count(l_returnflag) AS \"rows\", count(DISTINCT l_returnflag) AS \"distinct\", 2048 AS most FROM lineitem UNION ALL SELECT 'l_linenumber', count(l_linenumber), count(DISTINCT l_linenumber), 512 FROM lineitem UNION ALL SELECT 'l_partkey', count(l_partkey), count(DISTINCT l_partkey), 256 FROM lineitem) SELECT \"column\", \"rows\", \"distinct\", \"rows\" > 0 AND (\"distinct\" <= 16 OR (\"distinct\" <= most AND \"distinct\" / \"rows\" < 0.75)) AS viable FROM t")
def dictionary_viability(spark, sf_dir):
    return profile.dictionary_analysis(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber", "l_partkey"]).select("column", "rows", "distinct", "viable")


@query("SELECT value, row_number() OVER (ORDER BY first) - 1 AS index FROM (SELECT o_orderpriority AS value, min(o_orderkey) AS first FROM orders GROUP BY 1)")
def dictionary_build(spark, sf_dir):
    return profile.dictionary(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


@query("SELECT code, count(*) AS n FROM (SELECT 'INCONSISTENT_FIELD_COUNT' AS code FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'QUOTE_IN_UNQUOTED_FIELD' FROM customer WHERE c_custkey % 5 = 1 UNION ALL SELECT 'TYPE_COERCION' FROM customer WHERE c_custkey % 5 = 2 UNION ALL SELECT 'INVALID_QUOTE_ESCAPE' FROM customer WHERE c_custkey % 5 = 3) GROUP BY 1")
def error_log_counts(spark, sf_dir):
    key = F.col("c_custkey")
    name = F.when(key % 5 == 1, 'a "b" c').when(key % 5 == 3, '"a "b" c"').otherwise(F.col("c_name"))
    number = F.when(key % 5 == 2, F.lit("x1")).otherwise(F.col("c_nationkey").cast("string"))
    line = F.concat(key.cast("string"), F.lit(","), name, F.lit(","), number, F.when(key % 5 == 0, ",more").otherwise(""))
    lines = table(spark, sf_dir, "customer").select(line.alias("value"))
    got = read_csv_lines(lines, "k,name,number\n", separator=",", schema=[I64, STR, I32], error_mode="permissive", max_errors=10_000_000, multiline=False)
    return got.errors.groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(event_id AS VARCHAR) || ',' || event_type || ',' || CASE WHEN contains(props, '\"') OR contains(props, ',') OR contains(props, chr(10)) THEN '\"' || replace(props, '\"', '\"\"') || '\"' ELSE props END AS line FROM events")
def csv_render(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select("event_id", F.concat_ws(",", F.col("event_id").cast("string"), quoted(F.col("event_type")), quoted(F.col("props"))).alias("line"))


@query("SELECT event_id, 3 AS n, props AS third FROM events")
def split_and_unescape(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    line = F.concat_ws(",", F.col("event_id").cast("string"), "event_type", F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('""')), F.lit('"')))
    fields = df.select("event_id", split_fields(line, ",").alias("fields"))
    third = F.col("fields")[2]
    return fields.select("event_id", F.size("fields").alias("n"), unescape(F.substring(third, F.lit(2), F.length(third) - 2), '"').alias("third"))


@query("SELECT * FROM (VALUES (',', true, 4, 'lf'), (';', true, 4, 'lf'), ('|', true, 4, 'lf'), (chr(9), true, 4, 'lf')) t(separator, has_header, \"columns\", line_ending)")
def dialect_candidates(spark, sf_dir):
    """Files of all customers, whose dialects are found out."""
    out = []
    for sep in (",", ";", "|", "\t"):
        path = scratch(spark, "dialect")
        one_file(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path, "c_custkey", sep)
        got = read_csv(spark, files(spark, path)[0])
        out.append((got.dialect.separator, got.names[0] == "c_custkey", got.num_columns, got.dialect.line_ending))
    return spark.createDataFrame(out, "separator string, has_header boolean, columns int, line_ending string")


@query("SELECT * FROM (VALUES ('a,b\\n1,2\\n', 'lf'), ('a,b\\r\\n1,2\\r\\n', 'crlf'), ('a,b\\r1,2\\r', 'cr'), ('a,b\\r\\n1,2\\n', 'mixed'), ('a,b', 'unknown')) t(\"text\", ending)")
def line_endings(spark, sf_dir):
    texts = ["a,b\n1,2\n", "a,b\r\n1,2\r\n", "a,b\r1,2\r", "a,b\r\n1,2\n", "a,b"]
    shown = lambda t: t.replace("\r", "\\r").replace("\n", "\\n")
    return spark.createDataFrame([(shown(t), line_ending(t)) for t in texts], "text string, ending string")


@query("SELECT * FROM (VALUES ('UTF8', 'utf-8'), ('Utf-16LE', 'utf-16-le'), ('ISO_8859-1', 'latin-1'), ('latin1', 'latin-1'), ('CP1252', 'windows-1252')) t(given, encoding)")
def encoding_names(spark, sf_dir):
    return spark.createDataFrame([(x, encoding_name(x)) for x in ("UTF8", "Utf-16LE", "ISO_8859-1", "latin1", "CP1252")], "given string, encoding string")


@query("SELECT * FROM (VALUES ('utf-8'), ('utf-8-bom'), ('utf-16-le'), ('utf-16-be'), ('utf-32-le'), ('latin-1'), ('windows-1252')) t(encoding)")
def encoding_detect(spark, sf_dir):
    text = "name,value\ncafé,1\nnaïve,2\n"
    data = [text.encode(), b"\xef\xbb\xbf" + text.encode(), text.encode("utf-16-le"), b"\xfe\xff" + text.encode("utf-16-be"), text.encode("utf-32-le"), text.encode("latin-1"), text.replace("é", "€").encode("cp1252")]
    return spark.createDataFrame([(detect_encoding(d).name,) for d in data], "encoding string")


@query(ORDERS)
def parquet_roundtrip(spark, sf_dir):
    path = scratch(spark, "parquet")
    write_parquet(_orders(spark, sf_dir, ","), path)
    return spark.read.parquet(path)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def stream_microbatch(spark, sf_dir):
    """The files of a folder, without headers, as a stream to a table and back."""
    source, sink, marks = (scratch(spark, x) for x in ("stream", "streamed", "marks"))
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    csv_lines(df, exact=True).repartition(3).write.text(source)
    got = read_csv_stream(spark, source, header_line(df.columns) + "\n", separator=",", schema=[I64, STR, DBL], header_in_files=False)
    return streamed(spark, got, sink, marks)


@query("SELECT c_name, c_mktsegment FROM customer UNION ALL SELECT 'c_name', 'c_mktsegment' FROM region")
def stream_headers(spark, sf_dir):
    """Files with a header each, as a stream; a row that equals the header is a row."""
    source, sink, marks = (scratch(spark, x) for x in ("headed", "streamed", "marks"))
    df = table(spark, sf_dir, "customer").select("c_name", "c_mktsegment")
    same = table(spark, sf_dir, "region").select(F.lit("c_name").alias("c_name"), F.lit("c_mktsegment").alias("c_mktsegment"))
    df.unionByName(same).repartition(4).write.option("header", True).csv(source)
    got = read_csv_stream(spark, source, header_line(df.columns) + "\n", separator=",", schema=[STR, STR])
    return streamed(spark, got, sink, marks)


def streamed(spark, got, sink, marks):
    got.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(got.schema).parquet(sink)


@query("SELECT a.t AS a, b.t AS b, CASE WHEN a.t = b.t THEN a.t WHEN a.t = 'NA' THEN b.t WHEN b.t = 'NA' THEN a.t WHEN a.k <= 4 AND b.k <= 4 THEN CASE WHEN a.k > b.k THEN a.t ELSE b.t END ELSE 'STRING' END AS wider FROM (VALUES ('BOOL', 1), ('INT32', 2), ('INT64', 3), ('FLOAT64', 4), ('STRING', 5), ('DATE', 6), ('TIMESTAMP', 7), ('TIME', 8), ('NA', 255)) a(t, k), (VALUES ('BOOL', 1), ('INT32', 2), ('INT64', 3), ('FLOAT64', 4), ('STRING', 5), ('DATE', 6), ('TIMESTAMP', 7), ('TIME', 8), ('NA', 255)) b(t, k)")
def type_lattice(spark, sf_dir):
    kinds = [k for k in DataType if k != DataType.UNKNOWN]
    return spark.createDataFrame([(a.name, b.name, wider(a, b).name) for a in kinds for b in kinds], "a string, b string, wider string")


@query("SELECT n_nationkey, n_name || ' – café' AS name FROM nation")
def transcode_files(spark, sf_dir):
    """A file in UTF-16, decoded and read."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name").collect()
    text = "n_nationkey,name\n" + "".join(f"{r.n_nationkey},{r.n_name} – café\n" for r in rows)
    path = scratch(spark, "utf16") + "/nation.csv"
    write_bytes(spark, path, b"\xff\xfe" + text.encode("utf-16-le"))
    return read_csv(spark, path, separator=",").df


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_file_projection(spark, sf_dir):
    """usecols by place and name, over a file with more columns."""
    path = scratch(spark, "projection")
    one_file(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), path, "c_custkey", "|")
    return read_csv(spark, files(spark, path)[0], separator="|", dtype={"c_custkey": "int64", "c_acctbal": "float64"}, columns=[0, "c_name", 3]).df


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25")
def csv_file_n_rows(spark, sf_dir):
    path = scratch(spark, "rows")
    one_file(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), path, "c_custkey")
    return read_csv(spark, files(spark, path)[0], separator=",", dtype={"c_custkey": "int64"}, n_rows=25).df


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey < 20")
def fail_fast(spark, sf_dir):
    """Reading ends before the first faulty record, here the one of customer 20."""
    path = scratch(spark, "fail")
    name = F.when(F.col("c_custkey") == 20, F.lit("one,field more")).otherwise(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(",", F.col("c_custkey").cast("string"), name).alias("value"))
    head = spark.createDataFrame([(-1, "c_custkey,c_name")], "c_custkey long, value string")
    head.unionByName(rows).repartition(1).sortWithinPartitions("c_custkey").select("value").write.text(path)
    return read_csv(spark, files(spark, path)[0], separator=",", error_mode="fail_fast", dtype={"c_custkey": "int64"}).df


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS stamp, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_orderkey % 2 = 0 AS VARCHAR) AS flag, printf('%02d:%02d:%02d', o_orderkey % 24, o_orderkey % 60, 5) AS clock FROM orders")
def values_as_text(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    typed = df.select("o_orderkey", F.col("o_orderdate").alias("stamp"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 2 == 0).alias("flag"), (((F.col("o_orderkey") % 24) * 60 + F.col("o_orderkey") % 60) * 60_000_000 + 5_000_000).alias("clock"))
    texts = cells(typed, ("clock",)).toDF(*typed.columns)
    return texts.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "stamp", "day", "flag", "clock")


@query("SELECT l_orderkey, l_linenumber, printf('%g', l_extendedprice) AS price, printf('%g', l_extendedprice / 1000000) AS small, printf('%g', l_extendedprice * 100000) AS large, printf('%g', -l_quantity) AS quantity FROM lineitem")
def doubles_as_text(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    texts = cells(df.select("l_orderkey", "l_linenumber", price, (price / 1_000_000).alias("small"), (price * 100_000).alias("large"), (-F.col("l_quantity")).alias("quantity")))
    return texts.select(F.col("c0").cast("long").alias("l_orderkey"), F.col("c1").cast(df.schema["l_linenumber"].dataType).alias("l_linenumber"), F.col("c2").alias("price"), F.col("c3").alias("small"), F.col("c4").alias("large"), F.col("c5").alias("quantity"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 40")
def fwf_file_options(spark, sf_dir):
    """A file of all customers with a line to skip, comments and blank lines; the first 40 rows, as max_rows says."""
    df = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    line = F.concat(F.rpad(key.cast("string"), 10, " "), F.rpad("c_name", 30, " "), F.col("c_mktsegment"))
    rows = df.select(F.lit(1).alias("part"), (key * 3).alias("key"), line.alias("value"))
    notes = df.where(key % 7 == 0).select(F.lit(1).alias("part"), (key * 3 + 1).alias("key"), F.explode(F.array(F.lit("# more"), F.lit(""))).alias("value"))
    head = spark.createDataFrame([(0, i, v) for i, v in enumerate(("# a note", "title", "# another", ""))], "part int, key long, value string")
    path = one_text(head.unionByName(rows).unionByName(notes), scratch(spark, "fwf"))
    return read_fwf(spark, path, schema=[I64, STR, STR], col_starts=[0, 10, 40], col_ends=[10, 40, -1], col_names=["c_custkey", "c_name", "c_mktsegment"], skip=1, comment="#", max_rows=40).df


@query("SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day, o_orderpriority FROM orders")
def fwf_file_inferred(spark, sf_dir):
    """A fixed-width file whose types are found out."""
    df = table(spark, sf_dir, "orders")
    line = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, " "), F.lit(" "), F.lpad(F.col("o_totalprice").cast("decimal(20,2)").cast("string"), 22, " "), F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), F.col("o_orderpriority"))
    path = one_text(df.select(F.lit(1).alias("part"), F.col("o_orderkey").alias("key"), line.alias("value")), scratch(spark, "inferred"))
    return read_fwf(spark, path, col_starts=[0, 11, 34, 45], col_ends=[10, 33, 44, -1], col_names=["o_orderkey", "o_totalprice", "day", "o_orderpriority"]).df


@query("SELECT (i // 40) AS batch, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) GROUP BY 1")
def batched_reader(spark, sf_dir):
    """Batches of 40 over a file of all customers."""
    got = _customers(spark, sf_dir)
    batches = ((i, b.num_rows, b.column(0)[0].as_py(), b.column(0)[-1].as_py()) for i, b in enumerate(got.batches(40)))
    return spark.createDataFrame(list(batches), "batch long, n long, first long, last long")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def row_iterator(spark, sf_dir):
    """All customers of a file, row by row, put together again."""
    got = _customers(spark, sf_dir)
    return spark.createDataFrame(([r["c_custkey"], r["c_name"], r["c_acctbal"]] for r in got.iter_rows()), "c_custkey long, c_name string, c_acctbal double")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def arrow_stream(spark, sf_dir):
    """All customers of a file as a stream of Arrow batches."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table(_customers(spark, sf_dir)))


@query("SELECT c_custkey, c_name FROM customer")
def push_parser(spark, sf_dir):
    """All customers' bytes, fed in pieces of 17; batches are written as they come."""
    path = scratch(spark, "pushed")
    parser = StreamingParser()
    parser.set_schema(["c_custkey", "c_name"], [I64, STR])

    def drain() -> None:
        for batch in parser:
            if batch.num_rows:
                parser.to_dataframe(spark, batch).write.mode("append").parquet(path)

    rest = b"c_custkey,c_name\r\n"
    for r in table(spark, sf_dir, "customer").orderBy("c_custkey").select("c_custkey", "c_name").toLocalIterator():
        rest += f'{r.c_custkey},"{r.c_name}"\r\n'.encode()
        while len(rest) >= 17:
            parser.feed(rest[:17])
            rest = rest[17:]
        drain()
    parser.feed(rest)
    parser.finish()
    drain()
    return spark.read.schema("c_custkey long, c_name string").parquet(path)


FAULTY = "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'INCONSISTENT_FIELD_COUNT' WHEN 1 THEN 'QUOTE_IN_UNQUOTED_FIELD' WHEN 2 THEN 'INVALID_QUOTE_ESCAPE' WHEN 3 THEN 'NULL_BYTE' END AS code FROM customer"


def faulty(df: DataFrame):
    """A customer's line, with a fault by its key."""
    key = F.col("c_custkey")
    name = F.when(key % 5 == 1, 'a "b" c').when(key % 5 == 2, '"a "b" c"').when(key % 5 == 3, "a\0b").otherwise(F.col("c_name"))
    return df.select(key, F.concat(key.cast("string"), F.lit(","), name, F.when(key % 5 == 0, ",more").otherwise("")).alias("value"))


@query(f"SELECT row_number() OVER (ORDER BY c_custkey) + 1 AS line, code FROM ({FAULTY}) QUALIFY code IS NOT NULL")
def error_lines(spark, sf_dir):
    """The rows at which a file's faults are, numbered through the file."""
    lines = faulty(table(spark, sf_dir, "customer")).select(F.lit(1).alias("part"), F.col("c_custkey").alias("key"), "value")
    head = spark.createDataFrame([(0, 0, "c_custkey,c_name")], "part int, key long, value string")
    path = one_text(head.unionByName(lines), scratch(spark, "faults"))
    return read_csv(spark, path, separator=",", schema=[I64, STR], error_mode="permissive", max_errors=1 << 30).errors.select("line", "code")


@query(f"SELECT row_number() OVER (ORDER BY c_custkey) + 1 AS line, code FROM ({FAULTY}) QUALIFY code IS NOT NULL")
def push_parser_errors(spark, sf_dir):
    parser = StreamingParser(separator=",", error_mode="best_effort", max_errors=1 << 30)
    parser.feed(b"c_custkey,c_name\n")
    for r in faulty(table(spark, sf_dir, "customer")).orderBy("c_custkey").toLocalIterator():
        parser.feed(r.value.encode() + b"\n")
    parser.finish()
    return spark.createDataFrame([(e.line, e.code) for e in parser.errors()], "line long, code string")


@query("SELECT 25 AS kept, count(*) - 25 AS suppressed, count(*) AS found FROM customer WHERE c_custkey % 5 < 4")
def errors_suppressed(spark, sf_dir):
    """Errors beyond the most that are kept, counted."""
    lines = faulty(table(spark, sf_dir, "customer")).select("value")
    got = read_csv_lines(lines, "c_custkey,c_name\n", separator=",", schema=[I64, STR], error_mode="best_effort", max_errors=25, multiline=False)
    return spark.createDataFrame([(got.errors.count(), got.suppressed_count, got.error_count)], "kept int, suppressed long, found long")


@query("SELECT * FROM (VALUES ('DUPLICATE_COLUMN_NAMES', 'a,a'), ('EMPTY_HEADER', ',,'), ('UNCLOSED_QUOTE', 'a,b')) t(code, header)")
def header_and_quote_errors(spark, sf_dir):
    out = []
    for header, row in (("a,a", "1,2"), (",,", "1,2,3"), ("a,b", '1,"open')):
        try:
            found = read_csv_text(spark, f"{header}\n{row}\n", separator=",", error_mode="permissive").errors.collect()
        except CsvError as e:
            found = [spark.createDataFrame(e.errors, "code string, severity string, line bigint, `column` int, byte_offset bigint, message string, context string").first()]
        out += [(e.code, header) for e in found]
    return spark.createDataFrame(out, "code string, header string")


@query("SELECT o_orderkey, o_totalprice, o_orderpriority, codec FROM orders, (VALUES ('zstd'), ('snappy'), ('gzip'), ('lz4'), ('none')) t(codec)")
def parquet_codecs(spark, sf_dir):
    df, out = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), None
    for codec in ("zstd", "snappy", "gzip", "lz4", "none"):
        path = scratch(spark, codec)
        write_parquet(df, path, ParquetOptions(compression=codec, row_group_size=1000, enable_dictionary=codec == "gzip"))
        got = spark.read.parquet(path).withColumn("codec", F.lit(codec))
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT count(*) AS \"rows\", 6 AS \"columns\", 0 AS errors, count(*) AS again FROM orders")
def csv_conversion(spark, sf_dir):
    """A file converted to Parquet, and what the conversion says of it."""
    path, out = scratch(spark, "orders"), scratch(spark, "converted")
    one_file(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), path, "o_orderkey")
    made = convert(read_csv(spark, files(spark, path)[0], error_mode="permissive"), out)
    return spark.createDataFrame([(made.rows, made.columns, made.errors, spark.read.parquet(out).count())], "rows long, columns int, errors int, again long")


@query("SELECT 'c_custkey' AS name, 'INT64' AS type, 0 AS index, count(*) AS \"rows\" FROM customer UNION ALL SELECT 'c_name', 'STRING', 1, count(*) FROM customer UNION ALL SELECT 'c_acctbal', 'FLOAT64', 2, count(*) FROM customer")
def table_info(spark, sf_dir):
    """What info and schema say of a file."""
    got = _customers(spark, sf_dir)
    info = got.info()
    return profile.schema_rows(got).select("name", "type", "index", F.lit(info["rows"]).cast("long").alias("rows"))


@query("SELECT 'c_name' AS \"column\", count(*) AS count, CAST(sum(CASE WHEN c_name IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, count(DISTINCT c_name) AS n_unique, min(length(c_name)) AS min_length, max(length(c_name)) AS max_length FROM customer UNION ALL SELECT 'c_mktsegment', count(*), CAST(sum(CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END) AS BIGINT), count(DISTINCT c_mktsegment), min(length(c_mktsegment)), max(length(c_mktsegment)) FROM customer")
def text_stats(spark, sf_dir):
    got = profile.statistics(table(spark, sf_dir, "customer").select("c_name", "c_mktsegment"))
    return got.select("column", "count", "nulls", "n_unique", F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"))


@query("SELECT o_orderkey, coalesce(rank, -1) AS index FROM (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders) LEFT JOIN (SELECT p AS q, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS rank FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders) WHERE p IS NOT NULL GROUP BY p) ON p = q")
def dictionary_index_column(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("p"))
    return profile.dictionary_indexes(df, "p", "o_orderkey").select("o_orderkey", F.col("index").cast("long").alias("index"))
