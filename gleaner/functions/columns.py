"""Columns by name and as numbers."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col(f"`{column.replace('`', '``')}`")


def all_named(columns: list[str]) -> list[Column]:
    return [named(c) for c in columns]


def number(column: str) -> Column:
    """The column as a double; NaN and infinities count as missing."""
    value = named(column).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns as null."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select([
        F.when(~F.isnan(named(c)) & (F.abs(named(c)) < float("inf")), named(c)).alias(c) if c in floating else named(c) for c in df.columns])


def quoted(column: str) -> str:
    """The column of exactly this name in SQL text."""
    return "`" + column.replace("`", "``") + "`"


def number_sql(column: str) -> str:
    """:func:`number` as SQL text. Wide tables are planned much faster from one text than from a Python call for each part of it."""
    value = f"cast({quoted(column)} as double)"
    return f"case when not isnan({value}) and abs({value}) < double('Infinity') then {value} end"


def long_form(df: DataFrame, cells: list[str]) -> DataFrame:
    """A row for each cell of each row; ``cells`` are SQL texts of structs."""
    return df.select(F.expr("inline(array(" + ", ".join(cells) + "))"))


ARROW_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def literal_rows(spark: SparkSession, rows: list[dict], types: dict[str, str]) -> DataFrame:
    """A table of known values, such as a row per column of another table."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, pa.schema([(c, ARROW_TYPES[t]) for c, t in types.items()])))
