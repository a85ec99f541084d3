"""Customer tables derived from the star-schema tables, for queries, tests and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.config import ROLES
from ebbline.functions.scalars import rule_score
from ebbline.operators.clean import clean
from ebbline.operators.reshape import stack_columns

CUTOFF = "TIMESTAMP_NTZ '2001-02-01 00:00:00'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def churn_base(spark: SparkSession, folder: str) -> DataFrame:
    """Raw customer table: behaviour before the cut-off date, label "no order after it".

    ``orders`` is read and shuffled once, on its customer key: the earlier and the later orders
    are two sets of conditional aggregates over the same groups, combined before the shuffle, so
    a customer holding a third of all orders is no problem. Money is summed in whole cents, which
    gives the same total in any order, and bills are rounded to cents (half up) with integers.
    """
    orders = table(spark, folder, "orders")
    early = F.col("o_orderdate") < F.expr(CUTOFF)

    def early_count(condition):
        return F.count_if(early & condition)

    behaviour = (
        orders.groupBy("o_custkey")
        .agg(
            F.count_if(early).alias("n_orders"),
            F.sum(F.when(early, F.round(F.col("o_totalprice") * 100).cast("bigint"))).alias("cents"),
            early_count(F.col("o_orderpriority") == "1-URGENT").alias("p1"),
            early_count(F.col("o_orderpriority") == "2-HIGH").alias("p2"),
            early_count(F.col("o_orderpriority") == "3-MEDIUM").alias("p3"),
            early_count(F.col("o_orderpriority") == "4-NOT SPECIFIED").alias("p4"),
            early_count(F.col("o_orderpriority") == "5-LOW").alias("p5"),
            early_count(F.col("o_orderstatus") == "P").alias("sp"),
            F.count_if(F.col("o_orderdate") >= F.expr(CUTOFF)).alias("later_orders"),
        )
        .where(F.col("n_orders") > 0)
    )
    customer = table(spark, folder, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    joined = customer.join(behaviour, F.col("c_custkey") == F.col("o_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("c_custkey")
    region = F.col("n_regionkey")

    def flag(condition):
        return F.when(condition, "Yes").otherwise("No")

    def service(condition):
        return F.when(region == 0, "No internet service").when(condition, "Yes").otherwise("No")

    monthly = F.expr("(2 * cents + 3000 * n_orders) div (6000 * n_orders)")
    total = F.expr("(2 * cents + 3000) div 6000")
    total_text = F.concat_ws(
        ".", F.floor(total / 100).cast("string"), F.lpad((total % 100).cast("string"), 2, "0")
    )
    return joined.select(
        key.alias("customerID"),
        F.when(key % 3 == 0, "Female").otherwise("Male").alias("gender"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("SeniorCitizen"),
        flag(key % 2 == 0).alias("Partner"),
        flag(key % 5 == 0).alias("Dependents"),
        F.when(key % 50 == 0, 0)
        .otherwise(F.least(F.col("n_orders") * 4, F.lit(72)))
        .cast("int")
        .alias("tenure"),
        F.when(key % 10 == 0, "No").otherwise("Yes").alias("PhoneService"),
        F.when(key % 10 == 0, "No phone service")
        .when(key % 4 == 0, "Yes")
        .otherwise("No")
        .alias("MultipleLines"),
        F.when(region == 0, "No")
        .when(region < 3, "DSL")
        .otherwise("Fiber optic")
        .alias("InternetService"),
        service(F.col("p1") >= 2).alias("OnlineSecurity"),
        service(F.col("p2") >= 2).alias("OnlineBackup"),
        service(F.col("p3") >= 2).alias("DeviceProtection"),
        service(F.col("p4") >= 2).alias("TechSupport"),
        service(F.col("p5") >= 2).alias("StreamingTV"),
        service(F.col("sp") >= 4).alias("StreamingMovies"),
        F.when(F.col("n_orders") < 8, "Month-to-month")
        .when(F.col("n_orders") < 11, "One year")
        .otherwise("Two year")
        .alias("Contract"),
        flag(key % 7 < 4).alias("PaperlessBilling"),
        F.col("c_mktsegment").alias("PaymentMethod"),
        (monthly / 100.0).alias("MonthlyCharges"),
        F.when(key % 50 == 0, " ").otherwise(total_text).alias("TotalCharges"),
        flag(F.col("later_orders") == 0).alias("Churn"),
    )


def churn_clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean(churn_base(spark, folder))


def rule_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Scores that need no fitted model, one row per customer and score name.

    ``contract_rule`` is the heuristic risk score, ``tenure_rule`` falls with tenure and
    ``charges_rule`` grows with the monthly bill.
    """
    scores = {
        "contract_rule": F.round(rule_score(), 6),
        "tenure_rule": F.round(1 - F.col("tenure") / 73, 6),
        "charges_rule": F.round(F.least(F.col("MonthlyCharges") / 100, F.lit(1.0)), 6),
    }
    wide = churn_clean(spark, folder).select(
        ROLES.key,
        F.col(ROLES.target).alias("label"),
        *[p.alias(name) for name, p in scores.items()],
    )
    long = stack_columns(wide, [ROLES.key, "label"], list(scores), "model", "probability")
    return long.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


def planted(spark: SparkSession, folder: str) -> DataFrame:
    """Table with a known treatment effect of 0.15, confounded by ``c``; one row per order."""
    keys = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))

    def uniform(factor, modulus):
        return (F.col("id") * F.lit(factor).cast("bigint")) % modulus / F.lit(float(modulus))

    u1, u2, u3 = uniform(7919, 10007), uniform(104729, 10009), uniform(1299709, 10037)
    with_c = keys.withColumn("c", F.when(u1 < 0.5, 1).otherwise(0))
    with_t = with_c.withColumn("t", F.when(u2 < 0.2 + 0.5 * F.col("c"), 1).otherwise(0))
    chance = 0.2 + 0.15 * F.col("t") + 0.3 * F.col("c")
    return with_t.withColumn("y", F.when(u3 < chance, 1).otherwise(0))
