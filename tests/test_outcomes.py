"""Tail probabilities of large tables, outcomes of every type, and missing numbers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from ebbline.functions.distributions import chi2_tail, f_tail
from ebbline.operators.adjust import stratified_effect
from ebbline.operators.effects import chi_square, effect_summary, treatment_check
from ebbline.operators.profile import describe, overall_rate


def log_poisson_sum(h, terms):
    """P(X > 2 h) for 2 * terms degrees of freedom: a Poisson sum in logarithms."""
    logs = [j * math.log(h) - h - math.lgamma(j + 1) for j in range(terms)]
    top = max(logs)
    return math.exp(top) * math.fsum(math.exp(x - top) for x in logs)


@pytest.mark.parametrize("dof", [2, 1400, 1500, 2000, 5000, 100_000])
def test_chi_square_tail_of_many_degrees(spark, dof):
    for statistic in (0.97 * dof, dof, dof + 2 * math.sqrt(2 * dof)):
        found = spark.range(1).select(chi2_tail(F.lit(float(statistic)), F.lit(dof))).first()[0]
        assert found == pytest.approx(log_poisson_sum(statistic / 2, dof // 2), rel=1e-6)


def test_chi_square_tail_beyond_the_sum(spark):
    """The approximation agrees with the sum where both are at hand."""
    dof = 200_002
    for shift in (-2.0, 0.0, 1.5):
        statistic = dof + shift * math.sqrt(2 * dof)
        found = spark.range(1).select(chi2_tail(F.lit(statistic), F.lit(dof))).first()[0]
        assert found == pytest.approx(log_poisson_sum(statistic / 2, dof // 2), rel=1e-5)


def test_f_tail_of_a_huge_second_degree(spark):
    for dof2 in (10**9, 10**11, 10**12):
        found = spark.range(1).select(f_tail(F.lit(0.5), F.lit(1), F.lit(dof2))).first()[0]
        assert found == pytest.approx(math.erfc(math.sqrt(0.25)), rel=1e-6)


def test_a_treatment_of_many_levels_is_not_significant(spark):
    rows = spark.range(40_000).select(
        (F.col("id") % 2_000).cast("string").alias("t"), F.when(F.xxhash64("id") % 3 == 0, 1).otherwise(0).alias("y")
    )
    test = chi_square(rows, ["t"], "y").first()
    assert test.dof == 1999
    assert 0.001 < test.p_value < 0.999
    assert not test.significant


def test_outcomes_of_every_type(spark):
    rows = [("a", "Yes", 1, True, 1.0, 0.9), ("a", "Yes", 1, True, 1.0, 0.9), ("b", "No", 0, False, 0.0, 1.9), ("b", "Yes", 1, True, 1.0, 1.9), ("b", None, None, None, None, float("nan"))]
    df = spark.createDataFrame(rows, "t string, text string, whole int, flag boolean, real double, amount double")
    for outcome in ("text", "whole", "flag", "real"):
        assert overall_rate(df, outcome).first().rate == 0.75
        checked = {r.level: r.churn_rate for r in treatment_check(df, ["t"], outcome).collect()}
        assert checked == {"a": 1.0, "b": 0.5}
        assert chi_square(df, ["t"], outcome).first().p_value is not None
    checked = {r.level: r.churn_rate for r in treatment_check(df, ["t"], "amount").collect()}
    assert checked == pytest.approx({"a": 0.9, "b": 1.9})
    assert chi_square(df, ["t"], "amount").first().p_value is None
    assert effect_summary(df.withColumn("Churn", F.col("amount")), ["t"]).count() > 0


def test_stratified_effect_of_a_text_label(spark):
    df = spark.range(400).select(
        (F.col("id") % 2).cast("int").alias("t"), (F.col("id") % 5).alias("s"), F.when(F.col("id") % 3 == 0, "Yes").otherwise("No").alias("y")
    )
    as_number = df.withColumn("y", F.when(F.col("y") == "Yes", 1).otherwise(0))
    assert stratified_effect(df, "t", "y", ["s"]).collect() == stratified_effect(as_number, "t", "y", ["s"]).collect()


def test_nan_is_missing_in_describe(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "x double")
    row = describe(df, ["x"]).first()
    assert (row["count"], row["mean"], row["max"], row["q50"]) == (2, 2.0, 3.0, 2.0)
