"""Ordered computations that never put a whole table, column or group into one task.

A running total over a sorted column is taken in two steps. Rows are first put into value ranges
("buckets"); the bucket totals form a small table whose running sum gives every bucket its start.
Inside a bucket a window finishes the work, so the rows of one group are spread over as many tasks
as there are buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.scalars import double_array
from ebbline.operators.reshape import stack_columns

BUCKETS = 256


def running_totals(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], sums: Sequence[str]
) -> DataFrame:
    """Add ``<c>_before`` (total of the rows sorted before this one) and ``<c>_all`` per key.

    ``bucket`` must be monotone in ``order``. The bucket table has at most keys x buckets rows.
    """
    keys = list(keys)
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(c).alias(f"{c}_bucket") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    starts = totals.select(
        *keys,
        bucket,
        *[
            F.coalesce(F.sum(f"{c}_bucket").over(earlier), F.lit(0)).alias(f"{c}_start")
            for c in sums
        ],
        *[F.sum(f"{c}_bucket").over(everything).alias(f"{c}_all") for c in sums],
    )
    inside = (
        Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = df.join(starts, [*keys, bucket])
    return joined.withColumns(
        {
            f"{c}_before": F.col(f"{c}_start") + F.coalesce(F.sum(c).over(inside), F.lit(0))
            for c in sums
        }
    ).drop(*[f"{c}_start" for c in sums])


def value_splits(df: DataFrame, columns: Sequence[str], buckets: int = BUCKETS) -> dict[str, list]:
    """Approximate quantiles of every column: range borders, at most ``buckets`` per column.

    They only balance the work; results do not depend on them.
    """
    row = df.agg(*[splits_of(F.col(c), buckets).alias(c) for c in columns]).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def splits_of(value: Column, buckets: int = BUCKETS) -> Column:
    probabilities = double_array(i / buckets for i in range(1, buckets))
    return F.percentile_approx(value.cast("double"), probabilities, F.lit(4 * buckets))


def range_bucket(value: Column, splits: Column, buckets: int = BUCKETS) -> Column:
    """How many of the (sorted, at most ``buckets``) borders lie below the value.

    A binary search: each step of the halving list moves on when the border there is still lower.
    """
    steps = [1 << i for i in reversed(range(max(buckets, 1).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(splits, at + step - 1) < value, at + step).otherwise(at),
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Mapping[str, float],
    by: str | None = None,
    buckets: int = BUCKETS,
    splits: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """Exact interpolated quantiles of many columns, optionally per group.

    Returns ``column[, by], <name per probability>``. Equal values are merged before the sort, so
    a value held by a third of the rows is one row here. ``splits`` passes range borders that are
    known already; else one pass finds them.
    """
    columns = list(columns)
    keys = ["column"] + ([by] if by else [])
    splits = value_splits(df, columns, buckets) if splits is None else splits
    borders = F.create_map(
        *[
            part
            for c in columns
            for part in (F.lit(c), double_array(splits[c]))
        ]
    )
    long = df.select(*([by] if by else []), *[F.col(c).cast("double").alias(c) for c in columns])
    long = stack_columns(long, [by] if by else [], columns, "column", "value")
    present = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    if by:
        present = present.where(F.col(by).isNotNull())
    merged = (
        present.groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", range_bucket(F.col("value"), borders[F.col("column")], buckets))
    )
    ranked = running_totals(merged, keys, "bucket", [F.col("value")], ["n"])
    picks = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("n_all") - 1)
        for side, rank in (("low", F.floor(position)), ("high", F.ceil(position))):
            here = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
            picks.append(F.max(F.when(here, F.col("value"))).alias(f"{name}_{side}"))
        picks.append(F.max(position - F.floor(position)).alias(f"{name}_part"))
    found = ranked.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (
                F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")
            ).alias(n)
            for n in probabilities
        ],
    )


def exact_medians(
    df: DataFrame, columns: Sequence[str], splits: Mapping[str, Sequence[float]] | None = None
) -> dict[str, float]:
    """Interpolated medians on the driver: one number per column."""
    rows = exact_quantiles(df, columns, {"median": 0.5}, splits=splits).collect()
    return {r["column"]: r["median"] for r in rows}
