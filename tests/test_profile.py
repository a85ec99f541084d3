import pytest
from pyspark.sql import functions as F

from ebbline.operators import frequency as Q
from ebbline.operators import joins
from ebbline.operators import profile as P


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, "a", 1.0, 0), (2, "a", None, 1), (3, "b", 5.0, 1), (4, None, 5.0, None), (4, None, 5.0, None)]
    return spark.createDataFrame(rows, "id int, level string, x double, y int").cache()


def rows_by(df, *key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


def test_level_counts_keep_nulls(small):
    got = {(r["column"], r["value"]): r["n"] for r in Q.level_counts(small, ["level", "y"]).collect()}
    assert got == {("level", "a"): 2, ("level", "b"): 1, ("level", None): 2, ("y", "0"): 1, ("y", "1"): 2, ("y", None): 2}


def test_column_profile(small):
    got = rows_by(P.column_profile(small), "column")
    assert tuple(got["x",])[1:] == ("double", 4, 1, 2)
    assert tuple(got["level",])[1:] == ("string", 3, 2, 2)


def test_null_reports(small):
    got = rows_by(P.null_counts(small), "column")
    assert got["y",].null_count == 2 and got["y",].null_percent == pytest.approx(40)
    assert [r["column"] for r in P.columns_with_nulls(small).collect()] == ["level", "y", "x"]
    assert P.completeness(small).first()[0] == pytest.approx(100 * (1 - 5 / 20))


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert P.null_counts(df).first().null_count == 1


def test_duplicates_and_constants(small):
    assert P.duplicate_rows(small).first()[0] == 1
    assert P.constant_columns(small.withColumn("k", F.lit(1))).collect()[0][0] == "k"


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "level string")
    row = P.categorical_summary(df, ["level"]).first()
    assert (row.most_frequent, row.most_frequent_count, row.distinct_values) == ("a", 2, 2)
    assert row.most_frequent_percent == pytest.approx(40)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, None)], "c double, x double")
    assert P.correlation_with(df, ["c"], "x").first().correlation is None


def test_histogram_last_bin_is_closed_and_constant_column_works(spark):
    df = spark.createDataFrame([(float(i),) for i in range(31)], "x double")
    got = P.histogram(df, "x", 30).collect()
    assert sum(r.n for r in got) == 31 and max(r.bin for r in got) == 29
    assert rows_by(P.histogram(df, "x", 30), "bin")[29,].n == 2
    same = P.histogram(df.withColumn("x", F.lit(3.0)), "x").collect()
    assert [(r.bin, r.n) for r in same] == [(0, 31)]


def test_density_integrates_to_about_one(spark):
    df = spark.range(2000).select((F.col("id") % 100 + F.col("id") % 37).cast("double").alias("x"))
    rows = sorted((r.x, r.density) for r in P.density_curve(df, "x", points=200).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(rows, rows[1:]))
    assert 0.85 < area < 1.01


def test_class_weights_balance_the_classes(cleaned):
    total = P.with_class_weights(cleaned, "Churn").groupBy("Churn").agg(F.sum("weight").alias("w"))
    a, b = [r.w for r in total.collect()]
    assert a == pytest.approx(b)


def test_exploration_summary_sections(base):
    rows = P.exploration_summary(base, "Churn").collect()
    found = {(r.section, r.name): r for r in rows}
    assert found["shape", "rows"].value == base.count()
    assert found["numerical_feature", "tenure"].value > 1
    assert found["categorical_feature", "TotalCharges"].detail == "high_cardinality"
    assert found["target_distribution", "Yes"].value + found["target_distribution", "No"].value == base.count()


def test_numeric_looking_text(base):
    got = rows_by(P.numeric_looking_text(base, ["TotalCharges", "Contract"]), "column")
    assert got["TotalCharges",].numeric_looking and not got["Contract",].numeric_looking
    first = P.numeric_looking_text(base, ["TotalCharges"], "customerID", first=10).first()
    assert first.numeric_share <= 1


def test_join_small_falls_back_to_a_shuffle(spark, monkeypatch):
    large = spark.range(100).select((F.col("id") % 4).alias("k"))
    small = spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    expected = sorted(tuple(r) for r in large.join(small, "k").collect())
    joined = joins.join_small(large, small, "k")
    assert sorted(tuple(r) for r in joined.collect()) == expected
    assert "BroadcastExchange" in joined._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 3)
    assert sorted(tuple(r) for r in joins.join_small(large, small, "k").collect()) == expected
