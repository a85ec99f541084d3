"""Profiling reports of a customer table.

Reports that look at many columns use one pass: either a single global ``agg`` or the level counts
of :mod:`ebbline.operators.frequency`. Global windows are only used on tables with one row per
column or per bin.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions.scalars import (
    correlation_strength,
    direction,
    effect_flag,
    half_even,
    imbalanced,
    looks_numeric,
    outcome_value,
    rate_class,
)
from ebbline.operators.clean import columns_by_type
from ebbline.operators.frequency import level_counts
from ebbline.operators.joins import join_small
from ebbline.operators.ordered import exact_quantiles, splits_of
from ebbline.operators.reshape import stack_columns
from ebbline.operators.splitting import sample_rows

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _rows_from_wide(row: DataFrame, columns: Sequence[str], **parts: str) -> DataFrame:
    """Turn a one-row table with ``<column><suffix>`` cells into one row per column."""
    items = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"{c}{suffix}").alias(name) for name, suffix in parts.items()],
        )
        for c in columns
    ]
    return row.select(F.inline(F.array(*items)))


def overall_rate(df: DataFrame, outcome: str) -> DataFrame:
    return df.agg(F.avg(outcome_value(df, outcome)).alias("rate"))


def rate_summary(df: DataFrame, outcome: str) -> DataFrame:
    """Churn percent with its class and the imbalance flag."""
    percent = df.agg((F.avg(outcome_value(df, outcome)) * 100).alias("percent"))
    return percent.select(
        "percent",
        rate_class("percent").alias("rate_class"),
        imbalanced("percent").alias("imbalanced"),
    )


def rate_by_level(df: DataFrame, column: str, outcome: str) -> DataFrame:
    """Outcome rate per level; rows without a level are left out."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.avg(outcome).alias("churn_rate"))
    )


def percent_by_text_label(
    df: DataFrame, column: str, label: str = "Churn", positive: str = "Yes"
) -> DataFrame:
    """Percent of rows whose text label is the positive one, per level."""
    hit = F.coalesce((F.col(label) == positive).cast("double"), F.lit(0.0))
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg((F.avg(hit) * 100).alias("churn_percent"))
    )


def rate_and_count(df: DataFrame, column: str, label: str = "Churn") -> DataFrame:
    """Churn percent joined with the level's row count: the report's one equi-join.

    Both sides come from the same key, so a single aggregation gives the joined result.
    """
    hit = F.coalesce((F.col(label) == "Yes").cast("double"), F.lit(0.0))
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg((F.avg(hit) * 100).alias("churn_percent"), F.count(F.lit(1)).alias("n"))
    )


def treatment_profile(df: DataFrame, treatment: str, outcome: str) -> DataFrame:
    return (
        df.where(F.col(treatment).isNotNull())
        .groupBy(treatment)
        .agg(
            half_even(F.avg(outcome), 3).alias("churn_mean"),
            F.count(outcome).alias("churn_count"),
            half_even(F.avg("tenure"), 3).alias("tenure_mean"),
            half_even(F.avg("MonthlyCharges"), 3).alias("charges_mean"),
        )
    )


def numeric_by_label(
    df: DataFrame, columns: Sequence[str], label: str, digits: int = 2
) -> DataFrame:
    """Mean, median and sample deviation per numeric column and label value."""
    long = df.where(F.col(label).isNotNull()).select(
        label, *[F.col(c).cast("double").alias(c) for c in columns]
    )
    moments = (
        stack_columns(long, [label], list(columns), "column", "value")
        .groupBy("column", label)
        .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    )
    medians = exact_quantiles(df, columns, {"median": 0.5}, by=label)
    return moments.join(medians, ["column", label]).select(
        "column",
        label,
        half_even("mean", digits).alias("mean"),
        half_even("median", digits).alias("median"),
        half_even("std", digits).alias("std"),
    )


def contingency(df: DataFrame, column: str, outcome: str) -> DataFrame:
    """Counts per level and outcome value 0/1, zeros included."""
    return (
        df.where(F.col(column).isNotNull() & F.col(outcome).isNotNull())
        .groupBy(column)
        .agg(
            F.count_if(F.col(outcome) == 0).alias("n_0"),
            F.count_if(F.col(outcome) == 1).alias("n_1"),
        )
    )


def top_rates(
    df: DataFrame, columns: Sequence[str], outcome: str, levels: int = 5
) -> DataFrame:
    """The levels with the highest churn percent, with their size, for several columns at once."""
    text = df.select(F.col(outcome), *[F.col(c).cast("string").alias(c) for c in columns])
    rates = (
        stack_columns(text, [outcome], list(columns), "column", "level")
        .where(F.col("level").isNotNull())
        .groupBy("column", "level")
        .agg((F.avg(outcome) * 100).alias("churn_percent"), F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("column").orderBy(F.desc("churn_percent"), "level")
    return (
        rates.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= levels)
        .select("column", "place", "level", "churn_percent", "n")
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per numeric column.

    Two passes: one aggregate for the moments, which also finds the range borders of the quartile
    search, and the quartiles. The moments arrive as one row per column. NaN counts as missing.
    """
    fractional = [c for c in columns if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fractional})
    row = df.agg(
        *[
            f
            for c in columns
            for f in (
                F.count(c).alias(f"{c}:count"),
                F.avg(c).cast("double").alias(f"{c}:mean"),
                F.stddev_samp(c).alias(f"{c}:std"),
                F.min(c).cast("double").alias(f"{c}:min"),
                F.max(c).cast("double").alias(f"{c}:max"),
                splits_of(F.col(c)).alias(f"{c}:splits"),
            )
        ]
    ).first()
    parts = ("count", "mean", "std", "min", "max")
    moments = df.sparkSession.createDataFrame(
        [(c, *[row[f"{c}:{p}"] for p in parts]) for c in columns],
        "column string, count bigint, mean double, std double, min double, max double",
    )
    splits = {c: sorted(set(row[f"{c}:splits"] or [])) for c in columns}
    quartiles = exact_quantiles(df, columns, QUARTILES, splits=splits)
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def feature_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum per column in one pass."""
    row = df.agg(
        *[
            f
            for c in columns
            for f in (
                F.avg(c).cast("double").alias(f"{c}:mean"),
                F.stddev_samp(c).alias(f"{c}:std"),
                F.min(c).cast("double").alias(f"{c}:min"),
                F.max(c).cast("double").alias(f"{c}:max"),
            )
        ]
    )
    return _rows_from_wide(row, columns, mean=":mean", std=":std", min=":min", max=":max")


def _null_flag(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.col(column).isNull() | F.isnan(column)
    return F.col(column).isNull()


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percent per column: one global aggregate, no shuffle of rows."""
    columns = list(columns or df.columns)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(_null_flag(df, c)).alias(f"{c}:nulls") for c in columns],
    )
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"{c}:nulls").alias("null_count"),
            (F.try_divide(F.col(f"{c}:nulls"), F.col("rows")) * 100).alias("null_percent"),
        )
        for c in columns
    ]
    return row.select(F.inline(F.array(*items)))


def columns_with_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Only the columns with missing values, the worst first."""
    return (
        null_counts(df, columns)
        .where(F.col("null_count") > 0)
        .orderBy(F.desc("null_count"), "column")
    )


def completeness(df: DataFrame) -> DataFrame:
    """Percent of cells that hold a value."""
    nulls = sum((F.count_if(_null_flag(df, c)) for c in df.columns), F.lit(0))
    share = 1 - F.try_divide(nulls, F.count(F.lit(1)) * len(df.columns))
    return df.agg((share * 100).alias("completeness_percent"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Type, non-null, null and exact distinct counts per column from one set of level counts."""
    columns = list(columns or df.columns)
    types = F.create_map(
        *[part for c in columns for part in (F.lit(c), F.lit(df.schema[c].dataType.simpleString()))]
    )
    known = F.col("value").isNotNull()
    return (
        level_counts(df, columns)
        .groupBy("column")
        .agg(
            F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("non_null"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"),
            F.count_if(known).alias("distinct_values"),
        )
        .withColumn("type", types[F.col("column")])
        .select("column", "type", "non_null", "nulls", "distinct_values")
    )


def column_profile_approx(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """As :func:`column_profile` with sketch-based distinct counts: one pass and no shuffle of
    values, for wide tables with many distinct keys."""
    columns = list(columns or df.columns)
    row = df.agg(
        *[
            f
            for c in columns
            for f in (
                F.count(c).alias(f"{c}:non_null"),
                F.count_if(F.col(c).isNull()).alias(f"{c}:nulls"),
                F.approx_count_distinct(c).alias(f"{c}:distinct"),
            )
        ]
    )
    return _rows_from_wide(
        row, columns, non_null=":non_null", nulls=":nulls", distinct_values=":distinct"
    )


def constant_columns(df: DataFrame) -> DataFrame:
    return column_profile(df).where(F.col("distinct_values") == 1).select("column")


def high_cardinality(
    df: DataFrame, columns: Sequence[str], ratio: float = 0.5, count: int = 20
) -> DataFrame:
    """Distinct-to-rows ratio per column with both high-cardinality flags."""
    profile = column_profile(df, columns)
    rows = F.col("non_null") + F.col("nulls")
    return profile.select(
        "column",
        "distinct_values",
        F.try_divide(F.col("distinct_values"), rows).alias("distinct_ratio"),
        (F.try_divide(F.col("distinct_values"), rows) > ratio).alias("over_ratio"),
        (F.col("distinct_values") > count).alias("over_count"),
    )


def low_cardinality(df: DataFrame, columns: Sequence[str], limit: int = 10) -> DataFrame:
    return (
        column_profile(df, columns)
        .where(F.col("distinct_values") <= limit)
        .select("column", "distinct_values")
    )


def type_tally(df: DataFrame) -> DataFrame:
    """How many columns have each type, with the row count they were read over."""
    return (
        column_profile(df)
        .groupBy("type")
        .agg(
            F.count(F.lit(1)).alias("columns"),
            F.max(F.col("non_null") + F.col("nulls")).alias("rows"),
        )
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of every group of equal rows."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))


def categorical_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct levels, most frequent level (smallest text on ties), its count and percent."""
    counts = level_counts(df, columns)
    known = F.col("value").isNotNull()
    # The smallest (-n, value) pair is the mode; min() combines before the shuffle.
    best = F.min(F.when(known, F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value"))))
    return (
        counts.groupBy("column")
        .agg(F.count_if(known).alias("distinct_values"), best.alias("best"), F.sum("n").alias("rows"))
        .select(
            "column",
            "distinct_values",
            F.col("best.value").alias("most_frequent"),
            (-F.col("best.neg")).alias("most_frequent_count"),
            (F.try_divide(-F.col("best.neg"), F.col("rows")) * 100).alias("most_frequent_percent"),
        )
    )


def safe_corr(x: str, y: str) -> Column:
    """Pearson r over the rows where both are known; null for a constant column."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a = F.when(both, F.col(x).cast("double"))
    b = F.when(both, F.col(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation_with(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Correlation of every column with the target in one aggregate."""
    row = df.agg(*[safe_corr(c, target).alias(f"{c}:r") for c in columns])
    return _rows_from_wide(row, columns, correlation=":r")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs of a handful of columns, both triangles, from one aggregate."""
    pairs = list(combinations(columns, 2))
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[safe_corr(c, c).alias(f"{c}|{c}") for c in columns],
        *[safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs],
    )
    cells = [(c, c, f"{c}|{c}") for c in columns]
    cells += [(a, b, f"{a}|{b}") for a, b in pairs] + [(b, a, f"{a}|{b}") for a, b in pairs]
    items = [
        F.struct(
            F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(name).alias("correlation")
        )
        for a, b, name in cells
    ]
    return row.select(F.inline(F.array(*items)))


def high_correlations(df: DataFrame, columns: Sequence[str], limit: float = 0.7) -> DataFrame:
    """Pairs above the limit, each once, in column order."""
    order = {c: i for i, c in enumerate(columns)}
    position = F.create_map(*[p for c, i in order.items() for p in (F.lit(c), F.lit(i))])
    return correlation_matrix(df, columns).where(
        (position[F.col("column_a")] < position[F.col("column_b")])
        & (F.abs("correlation") > limit)
    )


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width bins, the last one closed; with ``by`` every group has its own range."""
    value = F.col(column).cast("double")
    data = df.select(*([by] if by else []), value.alias("value")).where(F.col("value").isNotNull())
    if by:
        data = data.where(F.col(by).isNotNull())
    spans = (data.groupBy(by) if by else data.groupBy()).agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    )
    spread = join_small(data, spans, by) if by else data.crossJoin(F.broadcast(spans))
    width = (F.col("high") - F.col("low")) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("low"), width)), F.lit(0))
    return (
        spread.withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
        .groupBy(*([by] if by else []), "bin")
        .agg(
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            *([by] if by else []),
            "bin",
            (F.col("low") + F.col("bin") * (F.col("high") - F.col("low")) / bins).alias("bin_start"),
            "n",
        )
    )


def density_curve(df: DataFrame, column: str, bins: int = 30, points: int = 50) -> DataFrame:
    """Gaussian kernel density over the histogram bins, bandwidth by the n^(-1/5) rule.

    Works on ``bins`` x ``points`` rows whatever the table size.
    """
    counts = histogram(df, column, bins)
    row = df.where(F.col(column).isNotNull()).agg(
        F.count(F.lit(1)).alias("total"),
        F.min(F.col(column).cast("double")).alias("low"),
        F.max(F.col(column).cast("double")).alias("high"),
        F.stddev_samp(column).alias("std"),
    )
    grid = row.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    x = F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / (points - 1)
    bandwidth = F.col("std") * F.pow(F.col("total").cast("double"), F.lit(-0.2))
    center = F.col("bin_start") + (F.col("high") - F.col("low")) / bins / 2
    z = F.try_divide(F.col("x") - center, F.col("h"))
    kernel = F.col("n") * F.exp(-z * z / 2)
    return (
        # At most bins x points rows: both sides have a fixed number of rows.
        grid.withColumns({"x": x, "h": bandwidth})
        .crossJoin(F.broadcast(counts))
        .groupBy("point", "x", "h", "total")
        .agg(F.sum(kernel).alias("mass"))
        .select(
            "point",
            "x",
            F.try_divide(
                F.col("mass"), F.col("total") * F.col("h") * F.sqrt(2 * F.pi())
            ).alias("density"),
        )
    )


def box_statistics(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Quartiles and 1.5-IQR whiskers per column and group."""
    quartiles = exact_quantiles(df, columns, QUARTILES, by=by)
    values = df.where(F.col(by).isNotNull()).select(
        by, *[F.col(c).cast("double").alias(c) for c in columns]
    )
    long = stack_columns(values, [by], list(columns), "column", "value")
    long = long.where(F.col("value").isNotNull())
    reach = (F.col("q75") - F.col("q25")) * 1.5
    inside = F.col("value").between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        join_small(long, quartiles, ["column", by])
        .groupBy("column", by)
        .agg(
            F.max("q25").alias("q25"),
            F.max("q50").alias("q50"),
            F.max("q75").alias("q75"),
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def factor_report(df: DataFrame, column: str, outcome: str) -> DataFrame:
    """Rate, difference from the overall rate, size and flag per level of a text factor."""
    overall = df.agg(F.avg(outcome).alias("overall"))
    levels = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.avg(outcome).alias("churn_rate"), F.count(F.lit(1)).alias("n"))
    )
    effect = F.col("churn_rate") - F.col("overall")
    return levels.crossJoin(F.broadcast(overall)).select(
        F.col(column).alias("level"), "churn_rate", "n", effect.alias("effect"),
        effect_flag(effect).alias("flag"),
    )


def numeric_factor_report(df: DataFrame, column: str, outcome: str) -> DataFrame:
    row = df.agg(
        safe_corr(column, outcome).alias("correlation"),
        F.avg(column).alias("mean"),
        F.min(column).cast("double").alias("min"),
        F.max(column).cast("double").alias("max"),
    )
    return row.select(
        F.lit(column).alias("factor"), "correlation", "mean", "min", "max",
        correlation_strength("correlation").alias("strength"),
        direction("correlation").alias("direction"),
    )


def extreme_levels(rates: DataFrame, level: str, rate: str = "churn_rate") -> DataFrame:
    """Levels with the highest and the lowest rate; the first level text wins ties."""
    best = F.struct((-F.col(rate)).alias("r"), F.col(level).alias("level"))
    least = F.struct(F.col(rate).alias("r"), F.col(level).alias("level"))
    known = rates.where(F.col(rate).isNotNull())
    picked = known.agg(F.min(best).alias("worst"), F.min(least).alias("best"))
    return picked.select(
        F.col("worst.level").alias("highest_level"),
        (-F.col("worst.r")).alias("highest_rate"),
        F.col("best.level").alias("lowest_level"),
        F.col("best.r").alias("lowest_rate"),
    )


def scoring_summary(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col(prediction).cast("bigint")).alias("predicted_churners"),
        (F.avg(F.col(prediction).cast("double")) * 100).alias("churn_percent"),
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (classes * n_class)``; one row per class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    return counts.crossJoin(F.broadcast(whole)).select(
        label, "n", F.try_divide(F.col("total"), F.col("classes") * F.col("n")).alias("weight")
    )


def with_class_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Attach the balanced weight to every row, ready as ``weightCol``."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(weight_col))
    return join_small(df, weights, label, "left")


def numeric_looking_text(
    df: DataFrame, columns: Sequence[str], key: str | None = None, first: int | None = None
) -> DataFrame:
    """Share of values that look like numbers per text column; flagged above 0.8.

    By default every row counts. ``first`` checks only that many rows in key order.
    """
    data = df if first is None else df.orderBy(key).limit(first)
    row = data.agg(
        *[F.avg(looks_numeric(F.col(c)).cast("double")).alias(f"{c}:share") for c in columns]
    )
    return _rows_from_wide(row, columns, numeric_share=":share").withColumn(
        "numeric_looking", F.coalesce(F.col("numeric_share") > 0.8, F.lit(False))
    )


def scatter_extract(
    df: DataFrame, x: str, y: str, label: str, key: str, limit: int | None = None
) -> DataFrame:
    """Two features and the label, keyed; with a limit a seeded sample of that many rows."""
    points = df.select(key, F.col(x).alias("x"), F.col(y).alias("y"), label)
    return points if limit is None else sample_rows(points, limit, key)


def exploration_summary(df: DataFrame, label: str, many: int = 20) -> DataFrame:
    """Shape, label counts, missing values, types and cardinality as long rows.

    ``section, name, value`` holds numbers; ``detail`` holds texts such as a column type.
    """
    kinds = columns_by_type(df)
    profile = column_profile(df)
    numeric = set(kinds["numeric"])
    kind = F.when(F.col("column").isin(list(numeric)), "numerical_feature").otherwise(
        "categorical_feature"
    )
    per_column = profile.where(F.col("column") != label).select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("missing_values").alias("section"), F.col("column").alias("name"),
                    F.col("nulls").cast("double").alias("value"), F.col("type").alias("detail"),
                ),
                F.struct(
                    kind.alias("section"), F.col("column").alias("name"),
                    F.col("distinct_values").cast("double").alias("value"),
                    F.when(F.col("distinct_values") > many, "high_cardinality").alias("detail"),
                ),
            )
        )
    )
    counts = level_counts(df, [label]).where(F.col("value").isNotNull())
    target = counts.select(
        F.lit("target_distribution").alias("section"), F.col("value").alias("name"),
        F.col("n").cast("double").alias("value"), F.lit(None).cast("string").alias("detail"),
    )
    positive = F.sum(F.when(F.col("value").isin("Yes", "1"), F.col("n")).otherwise(0))
    percent = F.try_divide(F.col("positive"), F.col("rows")) * 100
    figures = (
        ("rows", F.col("rows").cast("double"), F.lit(None).cast("string")),
        ("columns", F.lit(float(len(df.columns))), F.lit(None).cast("string")),
        ("churn_percent", percent, rate_class(percent)),
    )
    shape = counts.agg(F.sum("n").alias("rows"), positive.alias("positive")).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("shape").alias("section"), F.lit(name).alias("name"),
                        value.alias("value"), detail.alias("detail"),
                    )
                    for name, value, detail in figures
                ]
            )
        )
    )
    return per_column.unionByName(target).unionByName(shape)


def feature_statistics_long(long: DataFrame, feature: str, value: str) -> DataFrame:
    """As :func:`feature_statistics` for features stacked in long rows."""
    return long.groupBy(feature).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def feature_summary(
    df: DataFrame, target: str, columns: Sequence[str], importance: DataFrame | None = None
) -> DataFrame:
    """Type, missing values and correlation per feature, plus model importances, as long rows."""
    kinds = columns_by_type(df.select(*columns))
    numeric = F.col("column").isin(kinds["numeric"])
    nulls = null_counts(df, columns).select(
        F.when(numeric, "numeric_feature").otherwise("categorical_feature").alias("section"),
        "column",
        F.col("null_count").cast("double").alias("value"),
    )
    parts = nulls
    if kinds["numeric"]:
        parts = parts.unionByName(
            correlation_with(df, kinds["numeric"], target).select(
                F.lit("correlation").alias("section"), "column", F.col("correlation").alias("value")
            )
        )
    if importance is not None:
        parts = parts.unionByName(
            importance.select(
                F.lit("importance").alias("section"), F.col("feature").alias("column"),
                F.col("importance").alias("value"),
            )
        )
    return parts
