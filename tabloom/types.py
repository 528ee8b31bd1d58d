"""Types of delimited text, their order, and what they are in Spark."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T


class DataType(IntEnum):
    UNKNOWN = 0
    BOOL = 1
    INT32 = 2
    INT64 = 3
    FLOAT64 = 4
    STRING = 5
    DATE = 6
    TIMESTAMP = 7
    TIME = 8
    NA = 255


NUMERIC = (DataType.BOOL, DataType.INT32, DataType.INT64, DataType.FLOAT64)
SPARK = {
    DataType.BOOL: T.BooleanType(),
    DataType.INT32: T.IntegerType(),
    DataType.INT64: T.LongType(),
    DataType.FLOAT64: T.DoubleType(),
    DataType.STRING: T.StringType(),
    DataType.DATE: T.DateType(),
    DataType.TIMESTAMP: T.TimestampNTZType(),
    # microseconds since midnight
    DataType.TIME: T.LongType(),
    DataType.NA: T.StringType(),
    DataType.UNKNOWN: T.StringType(),
}


def wider(a: DataType, b: DataType) -> DataType:
    """The least type that holds both: nothing known < booleans < numbers by width; all else meets in strings."""
    if a == b:
        return a
    if a in (DataType.NA, DataType.UNKNOWN):
        return b
    if b in (DataType.NA, DataType.UNKNOWN):
        return a
    if a in NUMERIC and b in NUMERIC:
        return max(a, b)
    return DataType.STRING


def can_promote(a: DataType, b: DataType) -> bool:
    return a <= b


def parse_type(name: str | DataType) -> DataType:
    """A type by its name, or by a common name of it."""
    if isinstance(name, DataType):
        return name
    known = {"bool": "BOOL", "boolean": "BOOL", "int": "INT32", "integer": "INT32", "int32": "INT32", "bigint": "INT64", "long": "INT64", "int64": "INT64", "double": "FLOAT64", "float": "FLOAT64", "float64": "FLOAT64", "string": "STRING", "str": "STRING", "date": "DATE", "timestamp": "TIMESTAMP", "datetime": "TIMESTAMP", "time": "TIME"}
    found = known.get(name.lower(), name.upper())
    if found not in DataType.__members__:
        raise ValueError(f"no such type: {name}")
    return DataType[found]
