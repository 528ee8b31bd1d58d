"""A Spark-native engine for delimited and fixed-width text."""

from .api import detect_dialect, read_csv, read_csv_batched, read_csv_rows, read_fwf, to_parquet
from .operators.errors import CsvError
from .operators.table import Table
from .options import CsvOptions, FwfOptions, ParquetOptions
from .types import DataType, can_promote, wider

__version__ = "0.1.0"
__all__ = ["CsvError", "CsvOptions", "DataType", "FwfOptions", "ParquetOptions", "Table", "can_promote", "detect_dialect", "read_csv", "read_csv_batched", "read_csv_rows", "read_fwf", "to_parquet", "wider"]
