"""Functions with the keyword names of a delimited-text library, over the session that is active."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

from .operators.sink import Conversion, convert
from .operators.table import Table
from .options import ParquetOptions
from .sources import csv as _csv
from .sources import fwf as _fwf
from .types import parse_type

RENAMED = {"usecols": "columns", "skip_rows": "skip"}


def session() -> SparkSession:
    """The active session, or one of our own, in which generated methods stay small enough for HotSpot to compile them."""
    return SparkSession.getActiveSession() or SparkSession.builder.appName("tabloom").config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate()


def _options(named: dict) -> dict:
    """Drops what only a machine of its own needs, and None for "not given"."""
    out = {RENAMED.get(k, k): v for k, v in named.items() if k not in ("num_threads", "spark") and v is not None}
    if "dtype" in out:
        out["dtype"] = {k: parse_type(v).name for k, v in out["dtype"].items()}
    return out


def read_csv(path: str, spark: SparkSession | None = None, **named) -> Table:
    return _csv.read_csv(spark or session(), path, **_options(named))


def read_fwf(path: str, spark: SparkSession | None = None, **named) -> Table:
    return _fwf.read_fwf(spark or session(), path, **_options(named))


def to_parquet(input_path: str, output_path: str, compression: str = "zstd", row_group_size: int = 1_000_000, spark: SparkSession | None = None, **named) -> Conversion:
    fail = named.get("error_mode") == "fail_fast"
    table = read_csv(input_path, spark, **named)
    return convert(table, output_path, ParquetOptions(compression=compression, row_group_size=row_group_size), fail)


def read_csv_batched(path: str, batch_size: int = 10_000, spark: SparkSession | None = None, **named) -> Iterator:
    return read_csv(path, spark, **named).batches(batch_size)


def read_csv_rows(path: str, spark: SparkSession | None = None, **named) -> Iterator[dict]:
    return read_csv(path, spark, **named).iter_rows()


def detect_dialect(path: str, spark: SparkSession | None = None):
    from .sources.dialect import detect_dialect as detect
    from .sources.encoding import decode, detect_encoding
    from .sources.records import read_head

    head, *_ = read_head(spark or session(), path)
    encoding = detect_encoding(head)
    return detect(decode(head[: len(head) - len(head) % encoding.wide], encoding))
