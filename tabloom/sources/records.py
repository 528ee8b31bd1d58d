"""Records of text files as a DataFrame: (file, block, place, line), in the order of the file.

Lines come from Spark's text source, split over the cluster, at line feeds (at carriage returns, where the
start of the text has no others); what the other of the two ends, outside of quotes, is found in the plan, wherever it
lies. Where quotes can hold line ends, each
partition tells how it would end if it began outside or inside of quotes; from these two bits a
partition, the driver knows how each begins, and a second pass joins lines to records. Only what
crosses from one partition into the next is shuffled.

Files of a folder that are smaller than a split come whole, a row each, and are cut in the plan, so that their
lines have numbers within the file; a larger file's first split has a task of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import field_pattern, literal, record_pattern

IN_PARTITION = (1 << 33) - 1
#: What else ends a line, where the text source cuts at this.
OTHER = {"\n": "\r", "\r": "\n"}


def read_head(spark: SparkSession, path: str, most: int = 1 << 20) -> tuple[bytes, int, int, bool]:
    """(first bytes, size, time of change in seconds, is the path a folder of several files?) through Spark's file systems; of a folder's first file."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(where)
    folder = False
    if status.isDirectory():
        found = listed(spark, path)
        status, folder = found[0], len(found) > 1
        where = status.getPath()
    size = status.getLen()
    stream = fs.open(where)
    try:
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, most))) if size else b""
    finally:
        stream.close()
    return data, size, status.getModificationTime() // 1000, folder


def listed(spark: SparkSession, path: str) -> list:
    """Status of each file of a folder (of the one file) that isn't hidden, by path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(where)
    if not status.isDirectory():
        return [status]
    found = [f for f in fs.listStatus(where) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(f"no files in {path}")
    return sorted(found, key=lambda f: f.getPath().toString())


def without_last(text: Column, ends: str) -> Column:
    """A text without the end of its last line."""
    return F.when(F.endswith(text, F.lit(ends)), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def lines(spark: SparkSession, path: str, ends: str = "\n") -> DataFrame:
    """(file, block, index, line): block is where the line's split begins, and index, in a file's first block, how many lines come before it."""
    found = [(f.getPath().toString(), f.getLen()) for f in listed(spark, path)]
    whole = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    parts = [[p for p, n in found if n >= whole], [p for p, n in found if n < whole]] if len(found) > 1 else [[path], []]
    out = None
    if parts[0]:
        text = spark.read.option("lineSep", ends).text(parts[0]).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
        out = text.select("file", "block", F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION)).alias("index"), "line")
    if parts[1]:
        text = spark.read.text(parts[1] if parts[0] else path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), without_last(F.col("value"), ends).alias("text")).where("text <> ''")
        cut = text.select("file", F.lit(0).cast("long").alias("block"), F.posexplode(F.split("text", literal(ends), -1)).alias("index", "line"))
        cut = cut.withColumn("index", F.col("index").cast("long"))
        out = cut if out is None else out.unionByName(cut)
    return out


def body_of(rows: DataFrame, before: str, ends: str) -> DataFrame:
    """Lines without `before`, the text that comes before the first record, or, where it is empty, without the mark of an encoding."""
    skipped = before.count(ends)
    rest = before[before.rfind(ends) + 1 :]
    at_start = (F.col("block") == 0) & (F.col("index") == skipped)
    line = F.col("line")
    if rest:
        line = F.when(at_start & F.startswith(line, F.lit(rest)), F.substring(line, F.lit(len(rest) + 1), F.length(line))).otherwise(line)
    elif not skipped:
        line = F.when(at_start, F.regexp_replace(line, "^\ufeff", "")).otherwise(line)
    return (rows.where((F.col("block") > 0) | (F.col("index") >= skipped)) if skipped else rows).withColumn("line", line)


def bare_line(line: Column, ends: str) -> Column:
    """A line without the other half of its line end."""
    if ends == "\r":
        return F.when(F.startswith(line, F.lit("\n")), F.substring(line, F.lit(2), F.length(line))).otherwise(line)
    return F.when(F.endswith(line, F.lit("\r")), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def placed(rows: DataFrame) -> DataFrame:
    """With `place`, which grows along the file, in place of the index; its upper bits are the partition's number."""
    return rows.select("file", "block", F.monotonically_increasing_id().alias("place"), "line")


def unfolded(rows: DataFrame, sep: str, quote: str, backslash: bool, ends: str) -> DataFrame:
    """Lines cut at the other line end too, outside of quotes."""
    other = OTHER[ends]
    bare = bare_line(F.col("line"), ends)
    pattern = f"{other}({record_pattern(sep, quote, backslash, other)})"
    more = F.when(F.contains(bare, F.lit(other)), F.regexp_extract_all(F.concat(F.lit(other), bare), F.lit(pattern), F.lit(1))).otherwise(F.array("line"))
    return rows.select("file", "block", "index", F.explode(more).alias("line"))


def decoded_lines(spark: SparkSession, path: str, codec: str, mark: int) -> DataFrame:
    """lines() of files in an encoding whose line ends Spark's text source can't see: whole files, one a task."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = data[mark:].decode(codec, "replace")
                found = text.split("\n")
                if found and not found[-1]:
                    found.pop()
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.string())], ["file", "index", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "file string, index long, line string").select("file", F.lit(0).cast("long").alias("block"), "index", "line")


def pieces(line: str, ends: str) -> list[tuple[str, str]]:
    """(what comes before it, text) of a line's parts between line ends of the other kind."""
    if ends == "\r":
        lead, line = ("\r\n", line[1:]) if line.startswith("\n") else ("\r", line)
        found = line.split("\n")
    else:
        lead, found = "\n", re.split(r"\r(?!\Z)", line)
    return [(lead, found[0]), *((OTHER[ends], x) for x in found[1:])]


class Quotes:
    """Does a line, begun outside or inside of quotes, end inside?"""

    def __init__(self, sep: str, quote: str, backslash: bool):
        self.quote = quote
        field = field_pattern(sep, quote, backslash).replace(r"\z", r"\Z")
        # the last field of the line: does its quoting close?
        self.last = re.compile(rf"(?:{field}{literal(sep)})*+({field})\Z")
        self.sep, self.backslash = sep, backslash

    def ends_inside(self, line: str, inside: bool) -> bool:
        if self.quote not in line:
            return inside
        whole = self.quote + line if inside else line
        m = self.last.match(whole)
        last = m[1] if m else whole
        if len(self.sep) == 1 and not last.startswith(self.quote):
            return False
        if self.backslash:
            last = re.sub(r"\\[\s\S]", "", last)
        return last.count(self.quote) % 2 == 1


def odd_quotes(quote: str) -> Column:
    """Has the line an odd number of quotes, so that one may go on in the next?"""
    line, size = F.col("line"), len(quote.encode())
    odd = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(quote)))) % (2 * size) == size
    return F.contains(line, F.lit(quote)) & odd


def joined(rows: DataFrame, sep: str, quote: str, backslash: bool, ends: str) -> DataFrame:
    """(file, block, place, line): records of lines, those inside of quotes joined by what was between them.

    A record has the block and the place of its first line. No record goes on from one file into the next.
    """
    numbered = rows.select("file", "block", "line", F.spark_partition_id().alias("part"))
    seen = pa.schema([("file", pa.string()), ("block", pa.int64()), ("out", pa.bool_()), ("in", pa.bool_()), ("closes", pa.bool_())])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, found = Quotes(sep, quote, backslash), []
        for batch in batches:
            for file, block, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not found or (found[-1]["file"], found[-1]["block"]) != (file, block):
                    found.append({"file": file, "block": block, "out": False, "in": True, "closes": False})
                row = found[-1]
                for _, text in pieces(line, ends):
                    row["out"], row["in"] = quotes.ends_inside(text, row["out"]), quotes.ends_inside(text, row["in"])
                    row["closes"] |= not row["in"]
            yield pa.RecordBatch.from_pylist(found[:-1], schema=seen)
            del found[:-1]
        yield pa.RecordBatch.from_pylist(found, schema=seen)

    # one row for each block of a split file: how it ends if begun outside or inside, whether the latter ends its record
    blocks = numbered.mapInArrow(states, "file string, block long, out boolean, `in` boolean, closes boolean")
    split = blocks.withColumn("n", F.count("*").over(Window.partitionBy("file"))).where("n > 1").collect()
    begins: dict[tuple[str, int], bool] = {}
    owner: dict[tuple[str, int], int] = {}
    last, before = None, None
    for r in sorted(split, key=lambda r: (r.file, r.block)):
        at = r.file, r.block
        inside = last is not None and last.file == r.file and (last["in"] if begins[before] else last.out)
        begins[at] = inside
        owner[at] = r.block if not inside else owner[before] if begins[before] and not last.closes else last.block
        last, before = r, at
    linked = rows.sparkSession.sparkContext.broadcast((begins, owner))
    kind = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("line", pa.string()), ("owner", pa.int64()), ("whole", pa.bool_())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, owner = linked.value
        quotes, held, head, inside, now, at = Quotes(sep, quote, backslash), [], False, False, None, 0
        first: tuple = ()
        out: list[tuple] = []

        def done(whole: bool) -> None:
            out.append((*first, "".join(held), owner.get(first[:2], first[1]) if head else first[1], whole))
            held.clear()

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, kind.types)], schema=kind)
            out.clear()
            return batch

        for batch in batches:
            for file, block, line, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (file, block) != now:
                    if held:
                        done(False)
                    now = file, block
                    inside = head = begins.get(now, False)
                for lead, text in pieces(line, ends):
                    if held:
                        held.append(lead)
                    else:
                        first = file, block, part << 33 | at
                    held.append(text)
                    at += 1
                    inside = quotes.ends_inside(text, inside)
                    if not inside:
                        done(not head)
                        head = False
            yield made()
        if held:
            done(False)
        yield made()

    found = numbered.mapInArrow(join, "file string, block long, place long, line string, owner long, whole boolean")
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "line")))
    crossing = found.where(~F.col("whole")).groupBy("file", "owner").agg(parts.alias("parts"))
    crossing = crossing.select("file", *(F.col("parts")[0][c].alias(c) for c in ("block", "place")), F.array_join(F.transform("parts", lambda p: p["line"]), ends).alias("line"))
    return found.where("whole").select("file", "block", "place", "line").unionByName(crossing)
