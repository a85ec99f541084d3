"""Level counts of many columns in one pass: the base of most profile reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.operators.reshape import stack_columns


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n`` for every level of every column, nulls as their own level.

    One scan and one shuffle for any number of columns. Counts are combined before the shuffle,
    so a frequent level costs one row per task.
    """
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return (
        stack_columns(text, [], list(columns), "column", "value")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count, share and percent per level of one column; null is not a level."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(
        column,
        "n",
        F.try_divide(F.col("n"), F.col("total")).alias("share"),
        (F.try_divide(F.col("n"), F.col("total")) * 100).alias("percent"),
    )


def top_levels(df: DataFrame, columns: Sequence[str], limit: int) -> DataFrame:
    """The ``limit`` most frequent levels per column, ties by level text.

    Spark keeps only ``limit`` rows per column and task ahead of the shuffle.
    """
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return (
        level_counts(df, columns)
        .where(F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= limit)
    )


def sample_values(df: DataFrame, columns: Sequence[str], limit: int = 3) -> DataFrame:
    """The ``limit`` smallest distinct values (as text) per column."""
    order = Window.partitionBy("column").orderBy("value")
    return (
        level_counts(df, columns)
        .where(F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= limit)
        .select("column", "place", "value")
    )
