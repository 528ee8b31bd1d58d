"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts handled at once in a Python worker; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where none is set (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.sparkContext.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='tabloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows with about `most` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(batch.schema.get_field_index(column))
        sizes = sizes.cast(pa.binary()) if pa.types.is_string(sizes.type) else sizes
        total, start = 0, 0
        lengths = pa.compute.binary_length(sizes).to_pylist()
        for i, n in enumerate(lengths):
            n = n or 0
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together to about `rows` rows; for columns of words, not of texts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` hashes."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(29)


def split_words(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(lists, words, counts): runs of anything but ASCII white space of each text, all of them in order, and how many a text has.

    Null texts have none. The list of a text without words is one empty word.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(texts)
    counts = np.where(pc.binary_length(texts).to_numpy() == 0, 0, pc.list_value_length(lists).to_numpy()).astype(np.int64)
    words = pc.list_flatten(lists)
    return lists, words.filter(pc.greater(pc.binary_length(words), 0)), counts


def block_of(blocks: int, *keys: str | Column) -> Column:
    """A block number that depends on the row alone, so that a recomputed task gives it again."""
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def with_fields(df: DataFrame, added: dict[str, str]) -> StructType:
    """df's schema and further fields; the schema that df keeps stays as it is."""
    more = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in added.items()))
    return StructType([*df.schema.fields, *more.fields])


def fields_of(ddl: str) -> dict[str, str]:
    """Names and types of a flat "a long, b string"."""
    return dict(x.split(" ", 1) for x in ddl.split(", "))


class Buckets:
    """Distinct sorted 64-bit keys, found by their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(1, len(keys)).bit_length())
        self.begins = np.searchsorted(keys >> self.shift, np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.begins[bucket], self.begins[bucket + 1]
        rows = np.flatnonzero(at < end)
        at, end, h = at[rows], end[rows], h[rows]
        while len(rows):
            same = self.keys[at] == h
            out[rows[same]] = at[same]
            more = ~same & (at + 1 < end)
            rows, at, end, h = rows[more], at[more] + 1, end[more], h[more]
        return out
