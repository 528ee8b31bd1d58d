"""Options of the readers and writers."""

from __future__ import annotations

from dataclasses import dataclass, field

# The default tokens, comma-separated; an empty token makes an empty field null.
NULLS = "NA,null,NULL,"
TRUES = "true,TRUE,True,T,t,yes,YES,Yes"
FALSES = "false,FALSE,False,F,f,no,NO,No"

ERROR_MODES = ("disabled", "fail_fast", "permissive", "best_effort")


def tokens(line: str) -> list[str]:
    """"" names no token at all, while "a," names "a" and the empty one."""
    return line.split(",") if line else []


@dataclass
class CsvOptions:
    separator: str = ""  # "": detected
    quote: str = '"'
    escape_backslash: bool = False
    comment: str = ""
    has_header: bool = True
    skip_empty_rows: bool = True
    guess_integer: bool = True
    trim_ws: bool = True
    decimal_mark: str = "."
    skip: int = 0
    null_values: str = NULLS
    true_values: str = TRUES
    false_values: str = FALSES
    sample_rows: int = 1000  # 0: all rows
    columns: list[str | int] | None = None
    dtype: dict[str, str] = field(default_factory=dict)
    formats: dict[str, str] = field(default_factory=dict)
    n_rows: int | None = None
    error_mode: str = "disabled"
    max_errors: int = 10_000
    encoding: str | None = None  # None: detected
    cache: bool = False
    cache_dir: str | None = None  # None: beside the file
    force_cache_refresh: bool = False
    multiline: bool | None = None  # None: looked for

    def check(self) -> None:
        if self.error_mode not in ERROR_MODES:
            raise ValueError(f"error_mode is one of {', '.join(ERROR_MODES)}")
        if len(self.quote) > 1:
            raise ValueError("quote is one character or none")
        if self.decimal_mark not in (".", ","):
            raise ValueError("decimal_mark is . or ,")
        if self.separator and self.separator == self.decimal_mark:
            raise ValueError("separator and decimal_mark are the same")
        if self.skip < 0 or self.max_errors < 0:
            raise ValueError("skip and max_errors can't be negative")


@dataclass
class FwfOptions:
    col_starts: list[int] = field(default_factory=list)
    col_ends: list[int] = field(default_factory=list)  # exclusive; -1: end of line
    col_names: list[str] | None = None
    trim_ws: bool = True
    guess_integer: bool = True
    comment: str = ""
    skip_empty_rows: bool = True
    skip: int = 0
    max_rows: int = -1
    null_values: str = NULLS
    true_values: str = TRUES
    false_values: str = FALSES
    sample_rows: int = 1000
    encoding: str | None = None

    def check(self) -> None:
        if not self.col_starts or len(self.col_starts) != len(self.col_ends):
            raise ValueError("col_starts and col_ends have the same number of columns, at least one")
        if self.col_names is not None and len(self.col_names) != len(self.col_starts):
            raise ValueError("col_names has another number of columns")
        for a, b in zip(self.col_starts, self.col_ends):
            if a < 0 or (b != -1 and b < a):
                raise ValueError(f"no such columns: {a} to {b}")


@dataclass
class ParquetOptions:
    compression: str = "zstd"
    compression_level: int = 3
    row_group_size: int = 1_000_000
    enable_dictionary: bool | str = False  # "auto": for the columns where it pays

    CODECS = {"zstd": "zstd", "snappy": "snappy", "gzip": "gzip", "lz4": "lz4_raw", "none": "uncompressed", "uncompressed": "uncompressed"}
