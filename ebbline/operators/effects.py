"""How the outcome differs between treatment levels: tests, correlations and effect tables.

All text treatments are handled together: one stacking, one aggregation to (treatment, level)
counts, and everything else works on that small table. A level may be arbitrarily frequent; counts
are combined before the shuffle.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.config import ROLES
from ebbline.functions.distributions import chi2_tail, f_tail
from ebbline.functions.scalars import half_even, outcome_value, relative_effect
from ebbline.operators.profile import safe_corr
from ebbline.operators.reshape import stack_columns

log = logging.getLogger(__name__)
ALPHA = 0.05
LINEAR_ALPHA = 0.1


def treatment_kinds(df: DataFrame, treatments: Sequence[str]) -> tuple[list[str], list[str]]:
    """Text and numeric treatments that exist; the others are reported and skipped."""
    text, numeric = [], []
    for name in treatments:
        if name not in df.columns:
            log.warning("treatment %s not found", name)
        elif isinstance(df.schema[name].dataType, (T.StringType, T.BooleanType)):
            text.append(name)
        elif isinstance(df.schema[name].dataType, T.NumericType):
            numeric.append(name)
        else:
            log.warning("treatment %s has no usable type", name)
    return text, numeric


def level_outcomes(df: DataFrame, treatments: Sequence[str], outcome: str) -> DataFrame:
    """``treatment, level, n, positives, other`` over rows with a known outcome, null levels kept.

    positives is the sum of the outcome, whatever numbers it has; other counts those that are not 0 or 1.
    """
    data = df.select(
        outcome_value(df, outcome).alias("__y"),
        *[F.col(c).cast("string").alias(c) for c in treatments],
    ).where(F.col("__y").isNotNull())
    return (
        stack_columns(data, ["__y"], list(treatments), "treatment", "level")
        .groupBy("treatment", "level")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("__y").alias("positives"),
            F.count_if(~F.col("__y").isin(0, 1)).alias("other"),
        )
    )


def _treatment_totals(cells: DataFrame) -> DataFrame:
    """Per treatment: overall rate over all rows, margins over rows with a level, and the test.

    For a 0/1 outcome the chi-square statistic of a levels x 2 table needs only sums over levels:
    ``N^2 / (S (N - S)) * (sum(s^2 / n) - S^2 / N)``. A 2x2 table gets the continuity correction;
    there both levels deviate equally from their expected count, so one of them is enough. A table
    with one level or one outcome value, or an outcome that is not 0/1, has no test: null p-value, not
    significant.
    """
    known = F.col("level").isNotNull()
    n, s = F.col("total"), F.col("total_positives")
    sums = cells.groupBy("treatment").agg(
        F.try_divide(F.sum("positives"), F.sum("n")).alias("overall"),
        F.sum(F.when(known, F.col("n"))).alias("total"),
        F.sum(F.when(known, F.col("positives"))).alias("total_positives"),
        F.count_if(known).alias("levels"),
        F.sum(F.when(known, F.col("positives") / F.col("n") * F.col("positives"))).alias("squares"),
        F.sum(F.when(known, 1 / F.col("n"))).alias("inverse"),
        F.min(F.when(known, F.struct("level", "n", "positives"))).alias("one"),
        F.sum("other").alias("other"),
    )
    dof = F.col("levels") - 1
    gap = F.abs(F.col("one.positives") - F.col("one.n") * (s / n))
    slack = F.greatest(gap - 0.5, F.lit(0.0))
    corrected = slack * slack * n * F.col("inverse") * (1 / s + 1 / (n - s))
    plain = (n / s) * (n / (n - s)) * (F.col("squares") - s / n * s)
    testable = (F.col("levels") >= 2) & (s > 0) & (s < n) & (F.col("other") == 0)
    tested = sums.select(
        "treatment", "overall",
        F.when(testable, F.when(dof == 1, corrected).otherwise(F.greatest(plain, F.lit(0.0)))).alias("chi2"),
        F.when(testable, dof).alias("dof"),
    )
    return tested.withColumn("p_value", chi2_tail(F.col("chi2"), F.col("dof"))).withColumn(
        "significant", F.coalesce(F.col("p_value") < ALPHA, F.lit(False))
    )


def _with_totals(cells: DataFrame) -> DataFrame:
    """Level rows with the totals and test of their treatment."""
    # The condition needs the count, so it is applied after the aggregation and both uses of the
    # cells share one shuffle; a plain filter on the level would be pushed below it in one of them.
    # It names all counts, as the shuffles are shared only while both uses keep the same columns.
    known = cells.where(F.when(F.col("level").isNotNull(), F.col("n") + F.col("other")) > 0)
    # One row per listed treatment: its size is the length of an argument, so it may be broadcast.
    return known.join(F.broadcast(_treatment_totals(cells)), "treatment")


def chi_square(df: DataFrame, treatments: Sequence[str], outcome: str) -> DataFrame:
    """Independence test of every text treatment against a 0/1 outcome, all in one pass."""
    totals = _treatment_totals(level_outcomes(df, treatments, outcome))
    return totals.select("treatment", "chi2", "dof", "p_value", "significant")


def independence_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square test of two text columns with any number of levels each.

    Only cells that occur are needed: the statistic is ``N * sum(o^2 / (row * column)) - N``. The
    2x2 case uses its closed form with the continuity correction.
    """
    cells = (
        df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
        .agg(F.count(F.lit(1)).alias("o"))
    )
    rows = cells.groupBy("a").agg(F.sum("o").alias("r"))
    columns = cells.groupBy("b").agg(F.sum("o").alias("c"))
    joined = cells.join(rows, "a").join(columns, "b")
    core = joined.agg(
        F.sum(F.try_divide(F.col("o") * F.col("o"), F.col("r").cast("double") * F.col("c"))).alias("q"),
        F.sum("o").alias("n"),
        # Any one cell gives the deviation of a 2x2 table; take the same one always.
        F.min(F.struct("a", "b", "o", "r", "c")).alias("cell"),
    )
    row_part = rows.agg(F.count(F.lit(1)).alias("nr"), F.sum(1 / F.col("r")).alias("ir"))
    column_part = columns.agg(F.count(F.lit(1)).alias("nc"), F.sum(1 / F.col("c")).alias("ic"))
    # Three one-row tables.
    one = core.crossJoin(F.broadcast(row_part)).crossJoin(F.broadcast(column_part))
    n = F.col("n")
    gap = F.abs(F.col("cell.o") - F.col("cell.r") * F.col("cell.c") / n)
    slack = F.greatest(gap - 0.5, F.lit(0.0))
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    chi2 = F.when(dof == 1, slack * slack * n * F.col("ir") * F.col("ic")).otherwise(
        F.greatest(n * F.col("q") - n, F.lit(0.0))
    )
    testable = (F.col("nr") >= 2) & (F.col("nc") >= 2)
    found = one.select(F.when(testable, chi2).alias("chi2"), F.when(testable, dof).alias("dof"))
    p = chi2_tail(F.col("chi2"), F.col("dof"))
    return found.select(
        "chi2", "dof", p.alias("p_value"), F.coalesce(p < ALPHA, F.lit(False)).alias("significant")
    )


def level_effects(df: DataFrame, treatments: Sequence[str], outcome: str) -> DataFrame:
    """Rate per level (rounded to 4 digits first), its difference from the overall rate, size."""
    return _level_effects_from(level_outcomes(df, treatments, outcome)).drop("p_value", "significant")


def _level_effects_from(cells: DataFrame) -> DataFrame:
    rate = half_even(F.try_divide(F.col("positives"), F.col("n")), 4)
    effect = rate - F.col("overall")
    return _with_totals(cells).select(
        "treatment",
        "level",
        rate.alias("churn_rate"),
        F.col("overall").alias("overall_churn_rate"),
        effect.alias("effect_size"),
        F.try_divide(effect, F.col("overall")).alias("relative_effect"),
        F.col("n").alias("sample_size"),
        "p_value",
        "significant",
    )


def _slope(x: str, y: str) -> Column:
    return F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double"))


def numeric_effects(df: DataFrame, treatments: Sequence[str], outcome: str) -> DataFrame:
    """Correlation, slope and R-squared of the outcome on each numeric treatment, one aggregate."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            f
            for t in treatments
            for f in (
                safe_corr(t, outcome).alias(f"{t}:r"),
                _slope(t, outcome).alias(f"{t}:slope"),
            )
        ],
    )
    items = [
        F.struct(
            F.lit(t).alias("treatment"),
            F.col(f"{t}:r").alias("correlation"),
            F.col(f"{t}:slope").alias("regression_coefficient"),
            # With one variable R-squared is the squared correlation.
            (F.col(f"{t}:r") * F.col(f"{t}:r")).alias("r_squared"),
            F.col("rows").alias("sample_size"),
        )
        for t in treatments
    ]
    return row.select(F.inline(F.array(*items)))


def analyze_treatment(df: DataFrame, treatment: str, outcome: str = ROLES.target) -> DataFrame | None:
    """Effect table of one treatment by its type; ``None`` when the column does not exist."""
    text, numeric = treatment_kinds(df, [treatment])
    if text:
        return level_effects(df, text, outcome)
    if numeric:
        return numeric_effects(df, numeric, outcome)
    return None


def effect_summary(
    df: DataFrame, treatments: Sequence[str] = ROLES.treatments, outcome: str = ROLES.target
) -> DataFrame:
    """One row per level of every text treatment and one row per numeric treatment."""
    text, numeric = treatment_kinds(df, treatments)
    parts = []
    if text:
        parts.append(
            _level_effects_from(level_outcomes(df, text, outcome)).select(
                F.col("treatment").alias("Treatment"),
                F.col("level").alias("Category"),
                F.col("churn_rate").alias("Churn_Rate"),
                F.col("overall_churn_rate").alias("Overall_Churn_Rate"),
                F.col("effect_size").alias("Effect_Size"),
                (F.col("relative_effect") * 100).alias("Relative_Effect_Percent"),
                F.col("sample_size").alias("Sample_Size"),
                F.col("p_value").alias("P_Value"),
                F.col("significant").alias("Significant"),
            )
        )
    if numeric:
        r = F.col("correlation")
        parts.append(
            numeric_effects(df, numeric, outcome).select(
                F.col("treatment").alias("Treatment"),
                F.lit("Numerical").alias("Category"),
                r.alias("Effect_Size"),
                (F.abs(r) * 100).alias("Relative_Effect_Percent"),
                F.col("sample_size").alias("Sample_Size"),
                F.coalesce(F.abs(r) > LINEAR_ALPHA, F.lit(False)).alias("Significant"),
                r.alias("Correlation"),
                F.col("regression_coefficient").alias("Regression_Coefficient"),
                F.col("r_squared").alias("R_Squared"),
            )
        )
    if not parts:
        raise ValueError("none of the treatments exists in the table")
    columns = (
        "Treatment string, Category string, Churn_Rate double, Overall_Churn_Rate double, "
        "Effect_Size double, Relative_Effect_Percent double, Sample_Size bigint, P_Value double, "
        "Significant boolean, Correlation double, Regression_Coefficient double, R_Squared double"
    )
    summary = df.sparkSession.createDataFrame([], columns)
    for part in parts:
        summary = summary.unionByName(part, allowMissingColumns=True)
    return summary


def simple_effects(
    df: DataFrame, treatments: Sequence[str] = ROLES.treatments, outcome: str = ROLES.target
) -> DataFrame:
    """Unrounded effects per level plus one correlation row per numeric treatment."""
    text, numeric = treatment_kinds(df, treatments)
    parts = []
    if text:
        rate = F.try_divide(F.col("positives"), F.col("n"))
        effect = rate - F.col("overall")
        parts.append(
            _with_totals(level_outcomes(df, text, outcome)).select(
                F.col("treatment").alias("Treatment_Variable"),
                F.col("level").alias("Treatment_Level"),
                rate.alias("Churn_Rate"),
                F.col("overall").alias("Base_Churn_Rate"),
                effect.alias("Effect_Size"),
                relative_effect(effect, "overall").alias("Relative_Effect"),
            )
        )
    if numeric:
        parts.append(
            numeric_effects(df, numeric, outcome).select(
                F.col("treatment").alias("Treatment_Variable"),
                F.lit("Numerical").alias("Treatment_Level"),
                F.col("correlation").alias("Correlation_with_Churn"),
                F.lit("Correlation").alias("Analysis_Type"),
            )
        )
    if not parts:
        raise ValueError("none of the treatments exists in the table")
    columns = (
        "Treatment_Variable string, Treatment_Level string, Churn_Rate double, "
        "Base_Churn_Rate double, Effect_Size double, Relative_Effect double, "
        "Correlation_with_Churn double, Analysis_Type string"
    )
    table = df.sparkSession.createDataFrame([], columns)
    for part in parts:
        table = table.unionByName(part, allowMissingColumns=True)
    return table


def strongest(effects: DataFrame, value: str, *names: str) -> DataFrame:
    """The row with the largest absolute value; names decide ties, smallest first."""
    pick = F.min(F.struct((-F.abs(F.col(value))).alias("size"), *names, F.col(value).alias("__v")))
    row = effects.where(F.col(value).isNotNull()).agg(pick.alias("best"))
    return row.select(*[F.col(f"best.{n}").alias(n) for n in names], F.col("best.__v").alias(value))


def top_effects(effects: DataFrame, n: int = 10, value: str = "Effect_Size", by: str = "signed") -> DataFrame:
    """The n largest effects, ties with the n-th kept; ``by='abs'`` ranks absolute sizes.

    The n-th value is found with a bounded top-n, not with a ranking over the whole table.
    """
    size = F.abs(F.col(value)) if by == "abs" else F.col(value)
    ranked = effects.where(F.col(value).isNotNull()).withColumn("__size", size)
    border = ranked.select("__size").orderBy(F.desc("__size")).limit(n).agg(
        F.min("__size").alias("__border")
    )
    return (
        ranked.crossJoin(F.broadcast(border))
        .where(F.col("__size") >= F.col("__border"))
        .drop("__size", "__border")
    )


def significant_effects(effects: DataFrame, value: str = "Effect_Size") -> DataFrame:
    return effects.where(F.col("Significant") & F.col(value).isNotNull())


def significant_effect_summary(effects: DataFrame, value: str = "Effect_Size") -> DataFrame:
    return significant_effects(effects, value).agg(
        F.count(F.lit(1)).alias("significant_effects"),
        F.avg(value).alias("average_effect"),
        F.max(F.abs(F.col(value))).alias("strongest_effect"),
    )


def anova(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """F statistic and p-value per numeric feature across the label classes.

    Two aggregations over few rows of state: class means and within-class deviations come from
    ``var_pop``, which is stable for large values where raw sums of squares are not.
    """
    long = df.where(F.col(label).isNotNull()).select(
        label, *[F.col(c).cast("double").alias(c) for c in features]
    )
    classes = (
        stack_columns(long, [label], list(features), "feature", "value")
        .where(F.col("value").isNotNull())
        .groupBy("feature", label)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean"),
            F.var_pop("value").alias("variance"),
        )
    )
    return anova_from_classes(classes)


def anova_from_classes(classes: DataFrame) -> DataFrame:
    """F test from ``feature, n, mean, variance`` (population) with one row per class."""
    # Between-class part: n-weighted variance of the class means around the grand mean.
    grand = classes.groupBy("feature").agg(
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("grand")
    )
    gap = F.col("mean") - F.col("grand")
    # One row per listed feature.
    sums = classes.join(F.broadcast(grand), "feature").groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * F.col("variance")).alias("within"),
        F.sum(F.col("n") * gap * gap).alias("between"),
    )
    dof1 = (F.col("k") - 1).cast("double")
    dof2 = (F.col("n") - F.col("k")).cast("double")
    between, within = F.try_divide(F.col("between"), dof1), F.try_divide(F.col("within"), dof2)
    scored = sums.select(
        "feature", F.try_divide(between, within).alias("score"), dof1.alias("dof1"), dof2.alias("dof2")
    )
    return scored.select("feature", "score", f_tail(F.col("score"), F.col("dof1"), F.col("dof2")).alias("p_value"))


def select_k_best(scores: DataFrame, k: int = 20) -> DataFrame:
    """The k highest scores. Complementary levels score the same up to the last digits, so scores
    are compared rounded and the feature name decides."""
    return scores.orderBy(F.desc_nulls_last(F.round("score", 9)), "feature").limit(k)


def treatment_check(df: DataFrame, treatments: Sequence[str], outcome: str) -> DataFrame:
    """Level counts, outcome counts and rate for every treatment, null levels included."""
    data = df.select(
        outcome_value(df, outcome).alias("__y"),
        *[F.col(c).cast("string").alias(c) for c in treatments],
    )
    return (
        stack_columns(data, ["__y"], list(treatments), "treatment", "level")
        .groupBy("treatment", "level")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("__y") == 0).alias("n_0"),
            F.count_if(F.col("__y") == 1).alias("n_1"),
            F.avg("__y").alias("churn_rate"),
        )
    )
