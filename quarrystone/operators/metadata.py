"""Structural metadata: typed property tables, one DataFrame per class. Pairs of type and operator without a meaning raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The canonical class of buildings.
BUILDING = T.StructType([T.StructField("height", T.DoubleType()), T.StructField("yearBuilt", T.LongType()), T.StructField("name", T.StringType()), T.StructField("flag", T.BooleanType())])
_SUPPORTED = {("double", ">"), ("double", "<"), ("double", "between"), ("bigint", ">"), ("string", "contains"), ("string", "equals"), ("boolean", "equals")}


def condition(kind: str, column: Column, op: str, value: object) -> Column:
    if (kind, op) not in _SUPPORTED:
        raise ValueError(f"{op} is not supported for {kind}")
    if op == "between":
        return column.between(*value)
    return {">": lambda: column > value, "<": lambda: column < value, "contains": lambda: column.contains(value), "equals": lambda: column == value}[op]()


def filtered(table: DataFrame, name: str, op: str, value: object) -> DataFrame:
    return table.where(condition(dict(table.dtypes)[name], F.col(name), op, value))


def stats(table: DataFrame, name: str) -> DataFrame:
    """min, max, mean and count of a property; no row for an empty table."""
    out = table.agg(F.min(name).alias("min"), F.max(name).alias("max"), F.avg(name).alias("mean"), F.count(name).alias("count"))
    return out.where("count > 0")


def feature_table(rows: DataFrame, names: list[str]) -> DataFrame:
    """The distinct features of a tile, numbered from 0, with how many rows have each. A tile's features are few."""
    own = rows.groupBy(*names).agg(F.count("*").alias("n"))
    return own.withColumn("feature_id", (F.row_number().over(Window.orderBy(*names)) - 1).cast("long"))


def class_counts(rows: DataFrame, by: str) -> DataFrame:
    """How many rows each class has."""
    return rows.groupBy(by).agg(F.count("*").alias("n"))
