"""Scans: raw customer files, tolerant scans and the column check for uploads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ebbline.config import SCORING_REQUIRED, raw_schema


class MissingColumns(ValueError):
    """An upload lacks columns that scoring needs."""

    def __init__(self, missing: Iterable[str]):
        self.missing = sorted(missing)
        super().__init__("missing required columns: " + ", ".join(self.missing))


def read_customers(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None
) -> DataFrame:
    """Raw customer table with an explicit schema (no inference pass over the file).

    Blanks inside values are kept: a blank ``TotalCharges`` marks a new customer.
    """
    reader = spark.read.schema(schema or raw_schema())
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def read_or_empty(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv"
) -> DataFrame:
    """As :func:`read_customers`, but a path that does not exist gives an empty table."""
    try:
        return read_customers(spark, path, fmt, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def require_columns(df: DataFrame, required: Iterable[str] = SCORING_REQUIRED) -> DataFrame:
    """Pass ``df`` on when all required columns are there, else raise :class:`MissingColumns`."""
    missing = set(required) - set(df.columns)
    if missing:
        raise MissingColumns(missing)
    return df
