"""Profiles of tables: statistics, dictionary viability, types as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Up to how many entries, and with what share of distinct values, a dictionary pays.
ALWAYS, RATIO, LIMITS = 16, 0.75, {"string": 2048, "int": 512, "bigint": 256}
QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def basic_statistics(df: DataFrame) -> DataFrame:
    """(column, value_count, null_count, min, max) of every column, in one pass; min and max as text."""
    return _unpivoted(df, {"value_count": lambda c: F.count(c), "null_count": lambda c: F.count(F.when(c.isNull(), 1)), "min": lambda c: F.min(c).cast("string"), "max": lambda c: F.max(c).cast("string")})


def _unpivoted(df: DataFrame, what: dict) -> DataFrame:
    """One aggregate of all columns, then a row for each column."""
    aggregates = [f(F.col(f"`{c}`")).alias(f"{i}_{k}") for i, c in enumerate(df.columns) for k, f in what.items()]
    row = df.agg(*aggregates)
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(i).alias("place"), *(F.col(f"`{i}_{k}`").alias(k) for k in what)) for i, c in enumerate(df.columns)))
    return row.select(F.explode(parts).alias("s")).select("s.*")


def statistics(df: DataFrame, bins: int = 10) -> DataFrame:
    """count, nulls, complete_rate, n_unique; mean, sd, p0 to p100 and a histogram of numbers; lengths of texts.

    Quantiles are interpolated. n_unique is exact. Columns come in the table's order.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def of(i: int, name: str) -> list[Column]:
        c, kind = F.col(f"`{name}`"), kinds[name]
        n = c.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
        length = F.length(c) if isinstance(kind, T.StringType) else F.lit(None).cast("int")
        p = F.percentile(n, F.array(*map(F.lit, QUANTILES)))
        made = {
            "count": F.count("*"), "nulls": F.count(F.when(c.isNull(), 1)), "complete_rate": F.count(c) / F.count("*"), "n_unique": F.count_distinct(c),
            "mean": F.avg(n), "sd": F.stddev_samp(n), **{f"p{int(100 * q)}": p[k] for k, q in enumerate(QUANTILES)},
            "min_length": F.min(length), "max_length": F.max(length), "hist": F.histogram_numeric(n, F.lit(bins)),
        }
        return [x.alias(f"{i}_{k}") for k, x in made.items()]

    # one aggregate over one scan, then a row for each column
    row = df.agg(*(x for i, name in enumerate(df.columns) for x in of(i, name)))
    names = [c.split("_", 1)[1] for c in row.columns if c.startswith("0_")]
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(i).alias("place"), *(F.col(f"`{i}_{k}`").alias(k) for k in names)) for i, c in enumerate(df.columns)))
    return row.select(F.explode(parts).alias("s")).select("s.*")


def dictionary_analysis(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, rows, distinct, ratio, index_bits, viable) of texts and integers."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = columns or [c for c in df.columns if kinds[c] in LIMITS]
    count = F.count_distinct if exact else F.approx_count_distinct
    aggregates = [x for i, c in enumerate(columns) for x in (F.count(f"`{c}`").alias(f"{i}_rows"), count(F.col(f"`{c}`")).alias(f"{i}_distinct"))]
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{i}_rows`").alias("rows"), F.col(f"`{i}_distinct`").alias("distinct"), F.lit(LIMITS[kinds[c]]).alias("most")) for i, c in enumerate(columns)))
    out = df.agg(*aggregates).select(F.explode(parts).alias("s")).select("s.*")
    ratio = F.when(F.col("rows") > 0, F.col("distinct") / F.col("rows")).otherwise(F.lit(0.0))
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.col("distinct"), F.lit(1)).cast("double")))).cast("int")
    viable = (F.col("rows") > 0) & ((F.col("distinct") <= ALWAYS) | (F.col("distinct") <= F.col("most")) & (ratio < RATIO))
    return out.select("column", "rows", "distinct", ratio.alias("ratio"), bits.alias("index_bits"), viable.alias("viable"))


def dictionary(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, index) of a column's distinct values, numbered as first seen by `order`. A dictionary is small: it is numbered in one task."""
    first = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).agg(F.min(order).alias("_first"))
    return first.select("value", (F.row_number().over(Window.orderBy("_first")) - 1).alias("index"))


def dictionary_indexes(df: DataFrame, column: str, order: str) -> DataFrame:
    """df with `index`: each value's place in dictionary(), -1 for null."""
    entries = dictionary(df, column, order).withColumnRenamed("value", "_value")
    return df.join(entries, F.col(f"`{column}`") == F.col("_value"), "left").withColumn("index", F.coalesce("index", F.lit(-1))).drop("_value")


def schema_rows(table) -> DataFrame:
    """(index, name, type, nullable) of a table."""
    rows = [(s["index"], s["name"], s["type"], s["nullable"]) for s in table.schema()]
    return table.df.sparkSession.createDataFrame(rows, "index int, name string, type string, nullable boolean")
