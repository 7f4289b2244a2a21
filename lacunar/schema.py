"""Canonical column sets and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES = ("series_id", "idx", "ts", "value", "y")
POINTS = ("id", "features", "label")


class SchemaError(ValueError):
    """A table lacks a column or has it in the wrong type."""


def require(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return df


def check_time_series(df: DataFrame) -> DataFrame:
    """A Series with typed columns; absent or null annotations count as 0.

    ts may be any timestamp type; equal lengths need no check, since the three
    vectors are columns of one table.
    """
    require(df, "series_id", "ts", "value")
    kind = df.schema["ts"].dataType
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        raise SchemaError(f"ts is {kind.simpleString()}, not a timestamp")
    if not isinstance(df.schema["value"].dataType, T.NumericType):
        raise SchemaError("value is not numeric")
    y = F.coalesce(F.col("y").cast("int"), F.lit(0)) if "y" in df.columns else F.lit(0)
    return df.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "value": F.col("value").cast("double"), "y": y})


def check_points(df: DataFrame) -> DataFrame:
    """Points with ARRAY<DOUBLE> features; a number becomes a vector of one; label 0 by default."""
    require(df, "id", "features")
    kind = df.schema["features"].dataType
    if isinstance(kind, T.NumericType):
        df = df.withColumn("features", F.array(F.col("features")))
    elif not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.NumericType):
        raise SchemaError("features is neither a number nor an array of numbers")
    label = F.coalesce(F.col("label").cast("int"), F.lit(0)) if "label" in df.columns else F.lit(0)
    return df.withColumns({"features": F.col("features").cast("array<double>"), "label": label})
