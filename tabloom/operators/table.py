"""What a reader returns: a DataFrame with the types, dialect, encoding and errors it came with."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dialect import CSV, Dialect
from ..sources.encoding import Encoding
from ..types import DataType

FILE, PLACE = "__file", "__place"


@dataclass
class Plan:
    """rows: the typed columns under unique names, and FILE and PLACE, the order of the file; found: all errors, errors: as many as are kept."""

    rows: DataFrame
    in_order: bool = True
    found: DataFrame | None = None
    errors: DataFrame | None = None


@dataclass
class Table:
    """plan: what reads the records, or a function that makes it when it is first needed; counted: the number of rows, in a way of its own."""

    plan: Plan | Callable[[], Plan]
    names: list[str]
    kinds: list[DataType]
    columns: list[str]
    formats: dict[str, str] = field(default_factory=dict)
    dialect: Dialect = CSV
    encoding: Encoding = Encoding("utf-8")
    source: str = ""
    size: int = 0
    warning: str = ""
    confidence: float | None = None
    ambiguous: bool = False
    counted: Callable[[], int] | None = None
    max_errors: int = 0
    many_files: bool = False

    @property
    def made(self) -> Plan:
        if not isinstance(self.plan, Plan):
            self.plan = self.plan()
        return self.plan

    @property
    def rows(self) -> DataFrame:
        return self.made.rows

    @property
    def in_order(self) -> bool:
        return self.made.in_order

    @property
    def errors(self) -> DataFrame | None:
        return self.made.errors

    @property
    def error_count(self) -> int:
        """All errors, those beyond the most that are kept too."""
        return self.made.found.count() if self.made.found is not None else 0

    @property
    def suppressed_count(self) -> int:
        return max(0, self.error_count - self.max_errors)

    @property
    def df(self) -> DataFrame:
        return self.rows.drop(FILE, PLACE)

    @property
    def column_names(self) -> list[str]:
        return list(self.names)

    @property
    def num_columns(self) -> int:
        return len(self.names)

    @property
    def num_rows(self) -> int:
        return self.counted() if self.counted else self.rows.count()

    def schema(self) -> list[dict[str, Any]]:
        return [{"name": n, "type": k.name, "nullable": True, "index": i, "format": self.formats.get(n, "")} for i, (n, k) in enumerate(zip(self.names, self.kinds))]

    def ordered(self) -> DataFrame:
        return self.rows.orderBy(FILE, PLACE)

    def head(self, n: int = 10) -> DataFrame:
        """The first n rows; each partition's first ones meet, in whatever order they come there."""
        return self.ordered().limit(n).drop(FILE, PLACE)

    def tail(self, n: int = 10) -> DataFrame:
        last = self.rows.orderBy(F.desc(FILE), F.desc(PLACE)).limit(n)
        return last.orderBy(FILE, PLACE).drop(FILE, PLACE)

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        """n rows, the same for the same seed, however the file is split, in the file's order; drawn by their numbers within the file."""
        part = F.shiftright(PLACE, 33).alias("part")
        light = self.rows.select(FILE, PLACE, part)
        earlier = Window.partitionBy(FILE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        totals = light.groupBy(FILE, "part").agg(F.count("*").alias("n"))
        totals = totals.select(F.col(FILE).alias("file"), F.col("part").alias("of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        numbered = light.withColumn("row", F.row_number().over(Window.partitionBy(FILE, "part").orderBy(PLACE)) - 1)
        numbered = numbered.join(totals, (F.col(FILE) == F.col("file")) & (F.col("part") == F.col("of")))
        whose = (F.lit(seed).cast("string"), *((F.col(FILE),) if self.many_files else ()), (F.col("before") + F.col("row")).cast("string"))
        drawn = numbered.select(FILE, PLACE, F.md5(F.concat_ws(":", *whose).cast("binary")).alias("draw")).orderBy("draw").limit(n)
        return self.rows.join(F.broadcast(drawn.select(FILE, PLACE)), [FILE, PLACE], "left_semi").orderBy(FILE, PLACE).drop(FILE, PLACE)

    def select(self, columns: list[str | int]) -> DataFrame:
        """Columns by name (the first of that name) or place, in any order and as often as asked for."""
        physical, out = self.df.columns, []
        for c in columns:
            if isinstance(c, str) and not c.isdigit():
                if c not in self.names:
                    raise ValueError(f"no column {c}")
                c = self.names.index(c)
            at = int(c)
            if not 0 <= at < len(physical):
                raise ValueError(f"column {at} is out of range: there are {len(physical)}")
            out.append(physical[at])
        if not out:
            raise ValueError("no columns asked for")
        seen: dict[str, int] = {}
        named = []
        for name in out:
            seen[name] = seen.get(name, 0) + 1
            named.append(F.col(f"`{name}`").alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
        return self.df.select(*named)

    def _in_order(self) -> DataFrame:
        return (self.rows if self.in_order else self.ordered()).drop(FILE, PLACE)

    def batches(self, n: int = 10_000) -> Iterator:
        """Arrow record batches of n rows in the file's order, a partition at a time."""
        import pyarrow as pa

        kind = self.df.limit(0).toArrow().schema
        rows = []
        source = self._in_order()
        for row in source.toLocalIterator(prefetchPartitions=True):
            rows.append(tuple(row))
            if len(rows) == n:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    def iter_rows(self) -> Iterator[dict[str, Any]]:
        for row in self._in_order().toLocalIterator():
            yield row.asDict()

    def to_arrow(self):
        """All rows as one Arrow table, in the file's order."""
        return self._in_order().toArrow()

    def reader(self, n: int = 10_000):
        """A reader of record batches; partitions come to the driver one after another."""
        import pyarrow as pa

        return pa.RecordBatchReader.from_batches(self.df.limit(0).toArrow().schema, self.batches(n))

    def __arrow_c_stream__(self, requested_schema=None):
        return self.reader().__arrow_c_stream__(requested_schema)

    def __arrow_c_schema__(self):
        return self.df.limit(0).toArrow().schema.__arrow_c_schema__()

    def info(self) -> dict[str, Any]:
        return {"source": self.source, "size": self.size, "dialect": str(self.dialect), "encoding": self.encoding.name, "rows": self.num_rows, "columns": [{"name": n, "type": k.name} for n, k in zip(self.names, self.kinds)]}
