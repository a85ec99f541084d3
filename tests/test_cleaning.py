from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions import scalars as S
from ebbline.operators import clean as C
from ebbline.operators.features import engineer, tenure_band

RAW = "gender string, SeniorCitizen int, tenure int, MonthlyCharges double, TotalCharges string, Churn string"


def sample(spark):
    rows = [
        ("Male", 0, 1, 29.85, "29.85", "No"),
        ("Female", 1, 34, 56.95, "1889.5", "No"),
        ("Male", 0, 2, 53.85, "108.15", "Yes"),
        ("Male", 0, 0, 20.0, " ", "Maybe"),
    ]
    return spark.createDataFrame(rows, RAW)


def test_clean_types_and_values(spark):
    df = C.clean(sample(spark))
    assert isinstance(df.schema["TotalCharges"].dataType, T.DoubleType)
    assert isinstance(df.schema["SeniorCitizen"].dataType, T.StringType)
    rows = df.collect()
    assert [r.Churn for r in rows] == [0, 0, 1, None]
    assert [r.TotalCharges for r in rows] == [29.85, 1889.5, 108.15, 0.0]
    assert {r.SeniorCitizen for r in rows} == {"0", "1"}


def test_clean_is_idempotent_and_takes_uploads_without_label(spark):
    once = C.clean(sample(spark))
    assert C.clean(once).collect() == once.collect()
    upload = sample(spark).select("tenure", "TotalCharges")
    assert C.clean(upload).columns == ["tenure", "TotalCharges"]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([("NaN",), ("x",), ("-3.5",)], "TotalCharges string")
    assert [r[0] for r in C.clean(df).collect()] == [0.0, 0.0, -3.5]


def test_bands_are_right_closed(spark):
    ages = [0, 1, 12, 13, 24, 25, 48, 49, 72, None]
    df = spark.createDataFrame([(a,) for a in ages], "tenure int")
    got = [r[0] for r in df.select(tenure_band()).collect()]
    assert got == [None, "0-1yr", "0-1yr", "1-2yr", "1-2yr", "2-4yr", "2-4yr", "4+yr", "4+yr", None]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5,), (-0.125,)], "x double")
    assert [r[0] for r in df.select(S.half_even("x", 2)).collect()] == [0.12, 0.38, 2.5, -0.12]


def test_rule_score_and_tiers(spark):
    rows = [("Month-to-month", 1, 80.0), ("One year", 20, 50.0), ("Two year", 60, 20.0)]
    df = spark.createDataFrame(rows, "Contract string, tenure int, MonthlyCharges double")
    score = F.round(S.rule_score(), 6)
    got = df.select(score.alias("s"), S.rule_tier(score).alias("t")).collect()
    assert [(r.s, r.t) for r in got] == [(0.9, "High"), (0.4, "Medium"), (0.3, "Low")]


def test_key_factors_follow_the_given_features(spark):
    df = spark.createDataFrame(
        [("Month-to-month", 3, 99.5)], "Contract string, tenure int, MonthlyCharges double"
    )
    names = F.array(F.lit("tenure"), F.lit("Partner"), F.lit("Contract"))
    got = df.select(S.key_factors(names)).first()[0]
    assert got == ["Low tenure (3 months)", "Month-to-month contract (high risk)"]


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame([(0.3,), (0.5,), (0.7,), (0.71,)], "p double")
    got = df.select(S.decide("p"), S.risk_tier("p")).collect()
    assert [tuple(r) for r in got] == [(0, "Low"), (0, "Medium"), (1, "Medium"), (1, "High")]


def test_engineered_features_skip_missing_inputs(spark):
    df = spark.createDataFrame([(5, "Yes", None)], "tenure int, OnlineBackup string, TechSupport string")
    out = engineer(df)
    assert out.columns[3:] == ["tenure_group", "total_services"]
    assert out.first().total_services == 1
    assert engineer(spark.createDataFrame([(1,)], "other int")).columns == ["other"]


def test_columns_by_type(base):
    kinds = C.columns_by_type(base)
    assert kinds["numeric"] == ["customerID", "SeniorCitizen", "tenure", "MonthlyCharges"]
    assert "TotalCharges" in kinds["text"]
