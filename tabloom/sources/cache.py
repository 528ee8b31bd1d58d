"""A side-car file with what reading a file found out: separator, types, rows, whether records go over lines; good while the file's size and time stay."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..options import CsvOptions
from ..types import DataType


def cache_path(path: str, folder: str | None = None) -> str:
    """Beside the file, or in a folder under a name made of the file's path."""
    if folder is None:
        return f"{path}.tabloom.json"
    return f"{folder}/{hashlib.sha256(path.encode()).hexdigest()[:32]}.tabloom.json"


def _key(o: CsvOptions) -> str:
    kept = {k: v for k, v in asdict(o).items() if k not in ("cache", "cache_dir", "force_cache_refresh", "columns", "n_rows", "error_mode", "max_errors")}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def load_cache(spark: SparkSession, path: str, size: int, changed: int, o: CsvOptions) -> dict | None:
    """What was kept; None if there is nothing, it is damaged, or the file or the options are others."""
    where, fs = _fs(spark, cache_path(path, o.cache_dir))
    if not fs.exists(where):
        return None
    try:
        stream = fs.open(where)
        try:
            data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        kept = json.loads(data)
        fresh = (kept["size"], kept["changed"], kept["options"]) == (size, changed, _key(o))
        return kept if fresh and all(k in DataType.__members__ for k in kept["kinds"]) else None
    except (ValueError, KeyError, TypeError, Py4JJavaError):
        return None


def save_cache(spark: SparkSession, path: str, size: int, changed: int, o: CsvOptions, known: dict) -> None:
    """known: separator, kinds, and, once they are known, rows and whether records go over lines. Written beside the file and then renamed, so that no reader sees half of it."""
    body = json.dumps({"size": size, "changed": changed, "options": _key(o)} | known)
    where, fs = _fs(spark, cache_path(path, o.cache_dir))
    draft, _ = _fs(spark, cache_path(path, o.cache_dir) + ".draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(body.encode()))
    finally:
        stream.close()
    fs.delete(where, False)
    fs.rename(draft, where)
